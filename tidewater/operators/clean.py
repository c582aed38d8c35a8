"""Typing, cleaning and validation of raw events; latest-wins deduplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater import schemas
from tidewater.functions import columns as fn

EVENT_TYPES = ("view", "cart", "remove_from_cart", "purchase")
ARRIVAL = ("bronze_ingested_at", "kafka_ts", "kafka_partition", "kafka_offset")
_KEY_PARTS = ("event_type", "product_id", "category_id", "category_code", "brand", "price", "user_id", "user_session")


def typed(bronze: DataFrame) -> DataFrame:
    """Raw text columns as typed, normalised ones; what does not parse is NULL."""
    c = F.col
    return bronze.select(
        fn.event_time(c("event_time")).alias("event_ts"),
        F.lower(F.trim(c("event_type"))).alias("event_type"),
        *[c(n).try_cast("bigint").alias(n) for n in ("product_id", "category_id", "user_id")],
        fn.text_or_null(c("category_code")).alias("category_code"),
        fn.or_unknown(fn.text_or_null(c("brand"))).alias("brand"),
        c("price").try_cast("decimal(10,2)").alias("price"),
        fn.session_or_null(c("user_session")).alias("user_session"),
        c("kafka_ts").try_cast("timestamp").alias("kafka_ts"),
        c("kafka_partition").try_cast("int").alias("kafka_partition"),
        c("kafka_offset").try_cast("bigint").alias("kafka_offset"),
        c("ingested_at").try_cast("timestamp").alias("bronze_ingested_at"),
    )


def rules() -> dict[str, Column]:
    """Why a typed event is invalid, in the order of the report; none is ever NULL."""
    missing = {f"missing_{n}": F.col(n).isNull() for n in ("product_id", "category_id", "user_id", "user_session")}
    return {
        "missing_event_ts": F.col("event_ts").isNull(),
        "invalid_event_type": F.coalesce(~F.col("event_type").isin(*EVENT_TYPES), F.lit(True)),
        **missing,
        "invalid_price": F.coalesce(F.col("price") < 0, F.lit(True)),
    }


def silver(bronze: DataFrame, processed_at: Column | None = None) -> DataFrame:
    """All events of a bronze table with calendar, category levels, fingerprint and validity."""
    found = rules()
    broken = reduce(lambda a, b: a | b, found.values())
    ts = F.col("event_ts")
    l1, l2, l3 = fn.category_levels(F.col("category_code"))
    return schemas.conform(
        typed(bronze),
        schemas.SILVER,
        source_event_id=F.concat_ws("_", F.col("kafka_partition").cast("string"), F.col("kafka_offset").cast("string")),
        event_fingerprint=fn.fingerprint(fn.seconds_text(ts), *[F.col(n) for n in _KEY_PARTS]),
        event_date=F.to_date(ts),
        event_year=F.year(ts),
        event_month=F.month(ts),
        event_day=F.dayofmonth(ts),
        event_hour=F.hour(ts),
        category_l1=l1,
        category_l2=l2,
        category_l3=l3,
        silver_processed_at=processed_at if processed_at is not None else F.current_timestamp(),
        is_valid=~broken,
        invalid_reason=F.when(broken, F.concat_ws("; ", *[F.when(r, F.lit(n)) for n, r in found.items()])),
    )


def split_valid(silver_df: DataFrame, processing_date: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine)."""
    day = processing_date if processing_date is not None else F.to_date("silver_processed_at")
    return silver_df.where("is_valid"), schemas.conform(silver_df.where("NOT is_valid"), schemas.QUARANTINE, processing_date=day)


def keep_latest(df: DataFrame, keys: list[str], order: tuple[str, ...] = ARRIVAL) -> DataFrame:
    """One row per key: the last to arrive (nulls last); columns that ``df`` lacks do not order.  Rows
    are combined before the shuffle; select what is needed first."""
    by = F.struct(*[F.col(c) for c in order if c in df.columns] or [F.lit(0)])
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.dropDuplicates(keys)
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), by).alias("__last")).select(*[c if c in keys else F.col(f"__last.`{c}`").alias(c) for c in df.columns])


def new_rows(df: DataFrame, existing: DataFrame, key: str = "event_fingerprint") -> DataFrame:
    """Rows whose key is not in ``existing`` (the key is never NULL)."""
    return df.join(existing.select(key).distinct(), key, "left_anti")


def known_rows(df: DataFrame, existing: DataFrame, key: str = "event_fingerprint") -> DataFrame:
    return df.join(existing.select(key).distinct(), key, "left_semi")
