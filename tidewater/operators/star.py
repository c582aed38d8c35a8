"""Staging, facts and dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater import schemas
from tidewater.functions import columns as fn
from tidewater.operators.clean import EVENT_TYPES, keep_latest


def _now(as_of: Column | None) -> Column:
    return as_of if as_of is not None else F.current_timestamp()


def staging(silver: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Valid events, once each, in the staging layout."""
    kept = keep_latest(silver.where("is_valid AND event_fingerprint IS NOT NULL"), ["event_fingerprint"])
    return schemas.conform(kept, schemas.STG_EVENTS, time_id=fn.hour_id(F.col("event_ts")), session_id="user_session", gold_processed_at=_now(as_of))


def fact_events(stg: DataFrame, as_of: Column | None = None) -> DataFrame:
    flags = {f"is_{t}": F.col("event_type") == t for t in EVENT_TYPES}
    return schemas.conform(stg, schemas.FACT_EVENTS, gold_processed_at=_now(as_of), **flags)


def fact_sales(events: DataFrame, as_of: Column | None = None) -> DataFrame:
    """One sale per purchase event, of one unit."""
    bought = events.where(F.col("event_type") == "purchase")
    return schemas.conform(
        bought, schemas.FACT_SALES, sale_id="event_fingerprint", sale_ts="event_ts", sale_date="event_date", unit_price="price",
        quantity=F.lit(1), gross_amount=F.col("price") * 1, gold_processed_at=_now(as_of),
    )


def dim_time(stg: DataFrame, as_of: Column | None = None) -> DataFrame:
    """One row per hour; every attribute follows from the hour."""
    hours = stg.select(F.date_trunc("hour", "event_ts").alias("h")).distinct()
    h = F.col("h")
    return schemas.conform(
        hours, schemas.DIM_TIME, time_id=fn.hour_id(h), event_date=F.to_date(h), event_year=F.year(h), event_month=F.month(h),
        event_day=F.dayofmonth(h), event_hour=F.hour(h), day_of_week=F.dayofweek(h), day_name=F.date_format(h, "EEEE"),
        month_name=F.date_format(h, "MMMM"), quarter=F.quarter(h), is_weekend=F.dayofweek(h).isin(1, 7), created_at=_now(as_of), updated_at=_now(as_of),
    )


def first_known(c: str, *order: str) -> Column:
    """The earliest non-null value by the order columns."""
    key = F.struct(*order)
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), key))


def dim_product(stg: DataFrame, as_of: Column | None = None) -> DataFrame:
    known = ("category_id", "category_code", "category_l1", "category_l2", "category_l3", "brand")
    found = stg.groupBy("product_id").agg(
        *[first_known(c, "event_ts", "event_fingerprint").alias(c) for c in known],
        F.min("event_ts").alias("first_seen_at"),
        F.max("event_ts").alias("last_seen_at"),
        fn.money(F.avg("price")).alias("avg_observed_price"),
        F.min("price").alias("min_observed_price"),
        F.max("price").alias("max_observed_price"),
        F.count(F.lit(1)).alias("record_count"),
    )
    return schemas.conform(found, schemas.DIM_PRODUCT, created_at=_now(as_of), updated_at=_now(as_of))


def _activity(events: DataFrame, key: str, names: dict[str, str], *more: Column) -> DataFrame:
    """Counts by event type per key."""
    counts = [fn.count_of(F.col("event_type"), t).alias(n) for t, n in names.items()]
    return events.groupBy(key).agg(*more, F.count(F.lit(1)).alias("n"), *counts)


def dim_user(events: DataFrame, sales: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Both sides are aggregated to the user before they meet."""
    names = {"view": "total_views", "cart": "total_cart_adds", "remove_from_cart": "total_remove_from_carts", "purchase": "total_purchases"}
    seen = _activity(events, "user_id", names, F.min("event_ts").alias("first_seen_at"), F.max("event_ts").alias("last_seen_at"), F.count_distinct("session_id").alias("total_sessions"))
    spent = sales.groupBy("user_id").agg(F.sum("gross_amount").alias("spent"))
    return schemas.conform(seen.join(spent, "user_id", "left"), schemas.DIM_USER, total_events="n", total_revenue=F.coalesce("spent", fn.money(0)), created_at=_now(as_of), updated_at=_now(as_of))


def dim_session(events: DataFrame, sales: DataFrame, as_of: Column | None = None) -> DataFrame:
    names = {"view": "view_count", "cart": "cart_count", "remove_from_cart": "remove_from_cart_count", "purchase": "purchase_count"}
    seen = _activity(events, "session_id", names, first_known("user_id", "event_ts", "event_fingerprint").alias("user_id"), F.min("event_ts").alias("session_start_at"), F.max("event_ts").alias("session_end_at"))
    spent = sales.groupBy("session_id").agg(F.sum("gross_amount").alias("spent"))
    return schemas.conform(
        seen.join(spent, "session_id", "left"), schemas.DIM_SESSION, event_count="n", session_revenue=F.coalesce("spent", fn.money(0)),
        session_duration_sec=fn.seconds_between(F.col("session_start_at"), F.col("session_end_at")), has_purchase=F.col("purchase_count") > 0,
        created_at=_now(as_of), updated_at=_now(as_of),
    )


def star_join(fact: DataFrame, *dims: tuple[DataFrame, str, list[str]], how: str = "left") -> DataFrame:
    """The fact with columns of each (dimension, key, columns); keys are unique in a dimension."""
    for dim, key, columns in dims:
        fact = fact.join(dim.select(key, *columns), key, how)
    return fact
