"""Daily summaries.  Events are enriched once and revenue comes from the same grouping: a sale is a
purchase event of one unit, so the sum of purchase prices at any grain is the sum of its sales.  Facts hold a
fingerprint once (the fact contract checks it), so unique events are counted without a distinct."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater import schemas
from tidewater.functions import columns as fn
from tidewater.operators.star import _now

_LEVELS = ["category_l1", "category_l2", "category_l3"]


def revenue(sales: DataFrame, *grain: Column | str, name: str = "revenue") -> DataFrame:
    """Gross amount by day and further columns."""
    return sales.groupBy(F.col("sale_date").alias("event_date"), *grain).agg(fn.money(F.sum("gross_amount")).alias(name))


def revenue_by_date(sales: DataFrame) -> DataFrame:
    return revenue(sales, name="total_revenue")


def revenue_by_product(sales: DataFrame) -> DataFrame:
    return revenue(sales, "product_id")


def with_product(df: DataFrame, dim_product: DataFrame) -> DataFrame:
    """Brand and category levels of each product; the dimension is unique by product."""
    return df.join(dim_product.select("product_id", "brand", *_LEVELS), "product_id", "left")


def _known(*names: str) -> list[Column]:
    return [fn.or_unknown(F.col(n)).alias(n) for n in names]


def revenue_by_category(sales: DataFrame, dim_product: DataFrame) -> DataFrame:
    return revenue(with_product(sales, dim_product), *_known(*_LEVELS))


def revenue_by_brand(sales: DataFrame, dim_product: DataFrame) -> DataFrame:
    return revenue(with_product(sales, dim_product), *_known("brand"))


def _counts(views: str, carts: str, removed: str, purchases: str) -> list[Column]:
    pairs = ((views, "is_view"), (carts, "is_cart"), (removed, "is_remove_from_cart"), (purchases, "is_purchase"))
    return [F.count_if(F.col(flag)).alias(name) for name, flag in pairs]


def _distinct(**names: str) -> list[Column]:
    return [F.count_distinct(c).alias(n) for n, c in names.items()]


def _unique_events() -> Column:
    return F.count("event_fingerprint").alias("unique_events")


def _earned() -> Column:
    return F.coalesce(F.sum(F.when(F.col("is_purchase"), F.col("price"))), fn.money(0))


def _finish(df: DataFrame, schema, purchases: str, views: str, carts: str, as_of: Column | None, key: list[Column] | None = None) -> DataFrame:
    made = {
        "conversion_rate": fn.safe_rate(F.col(purchases), F.col(views)),
        "cart_to_purchase_rate": fn.safe_rate(F.col(purchases), F.col(carts)),
        "gold_processed_at": _now(as_of),
    }
    if key:
        made["summary_id"] = F.concat_ws("_", F.date_format("event_date", "yyyyMMdd"), *key)
    return schemas.conform(df, schema, **made)


_PRODUCT_COUNTS = ("view_count", "cart_count", "remove_from_cart_count", "purchase_count")


def daily_events(events: DataFrame, as_of: Column | None = None) -> DataFrame:
    found = events.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("total_events"),
        *_counts("total_views", "total_carts", "total_remove_from_carts", "total_purchases"),
        *_distinct(unique_users="user_id", unique_sessions="session_id", unique_products="product_id"),
        _unique_events(),
        _earned().alias("total_revenue"),
        F.avg("price").alias("avg_event_price"),
    )
    return _finish(found, schemas.DAILY_EVENT, "total_purchases", "total_views", "total_carts", as_of)


def daily_products(events: DataFrame, dim_product: DataFrame, as_of: Column | None = None) -> DataFrame:
    found = with_product(events, dim_product).groupBy("event_date", "product_id", "brand", *_LEVELS).agg(
        *_counts(*_PRODUCT_COUNTS),
        _unique_events(),
        *_distinct(unique_users="user_id", unique_sessions="session_id"),
        _earned().alias("revenue"),
        F.avg("price").alias("avg_price"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
    )
    return _finish(found, schemas.DAILY_PRODUCT, "purchase_count", "view_count", "cart_count", as_of, [F.col("product_id").cast("string")])


def daily_categories(events: DataFrame, dim_product: DataFrame, as_of: Column | None = None) -> DataFrame:
    found = with_product(events, dim_product).groupBy("event_date", *_known(*_LEVELS)).agg(
        F.count(F.lit(1)).alias("total_events"),
        *_counts(*_PRODUCT_COUNTS),
        _unique_events(),
        *_distinct(unique_users="user_id", unique_products="product_id"),
        _earned().alias("revenue"),
    )
    return _finish(found, schemas.DAILY_CATEGORY, "purchase_count", "view_count", "cart_count", as_of, [F.col(c) for c in _LEVELS])


def daily_brands(events: DataFrame, dim_product: DataFrame, as_of: Column | None = None) -> DataFrame:
    found = with_product(events, dim_product).groupBy("event_date", *_known("brand")).agg(
        *_counts(*_PRODUCT_COUNTS),
        _unique_events(),
        *_distinct(unique_users="user_id", unique_products="product_id"),
        _earned().alias("revenue"),
    )
    return _finish(found, schemas.DAILY_BRAND, "purchase_count", "view_count", "cart_count", as_of, [F.col("brand")])


def build(which: str, events: DataFrame, dim_product: DataFrame, as_of: Column | None = None) -> dict[str, DataFrame]:
    """The summaries asked for: all, event, product, category or brand."""
    makers: dict[str, Callable[[], DataFrame]] = {
        "event": lambda: daily_events(events, as_of),
        "product": lambda: daily_products(events, dim_product, as_of),
        "category": lambda: daily_categories(events, dim_product, as_of),
        "brand": lambda: daily_brands(events, dim_product, as_of),
    }
    if which != "all" and which not in makers:
        raise ValueError(f"no summary {which!r}")
    return {k: make() for k, make in makers.items() if which in ("all", k)}
