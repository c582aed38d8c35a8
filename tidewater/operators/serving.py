"""Questions over the summaries: date filters, leaderboards, KPIs, top items, paging."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import columns as fn


def _date(value: str | datetime.date | None) -> datetime.date | None:
    """A bound as a date; a malformed one counts as absent."""
    if isinstance(value, datetime.date):
        return value
    try:
        return datetime.date.fromisoformat(value) if value and len(value) == 10 else None
    except ValueError:
        return None


def between_dates(df: DataFrame, column: str = "event_date", start: str | datetime.date | None = None, end: str | datetime.date | None = None) -> DataFrame:
    """Inclusive bounds on the bare column, so that partitions are pruned."""
    if (a := _date(start)) is not None:
        df = df.where(F.col(column) >= F.lit(a))
    if (b := _date(end)) is not None:
        df = df.where(F.col(column) <= F.lit(b))
    return df


def as_of(df: DataFrame, day: str | datetime.date | None, column: str = "event_date") -> DataFrame:
    return between_dates(df, column, end=day)


def latest_month(df: DataFrame, column: str = "event_date") -> DataFrame:
    """Rows of the month of the latest day."""
    last = df.agg(F.trunc(F.max(column), "month").alias("__month"))  # one row
    return df.join(F.broadcast(last), F.trunc(F.col(column), "month") == F.col("__month")).drop("__month")


def clamp(n: int, low: int = 1, high: int = 100) -> int:
    return max(low, min(high, n))


def top(df: DataFrame, by: str, k: int = 10, *ties: str) -> DataFrame:
    return df.orderBy(F.col(by).desc_nulls_last(), *[F.col(t).asc_nulls_first() for t in ties]).limit(clamp(k))


def leaderboard(summary: DataFrame, keys: dict[str, Column], cart_rate: bool = False, total: bool = False) -> DataFrame:
    """Summed counters per key; rates are re-derived from the sums, not averaged."""
    sums = {"views": "view_count", "carts": "cart_count", "purchases": "purchase_count"}
    out = summary.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(
        F.sum("revenue").cast("double").alias("revenue"),
        *[F.sum(c).alias(n) for n, c in sums.items()],
        *([F.sum(F.col("view_count") + F.col("cart_count") + F.col("purchase_count") + F.col("remove_from_cart_count")).alias("total_events")] if total else []),
    )
    out = out.withColumn("conversion_rate", fn.safe_rate(F.col("purchases"), F.col("views")))
    return out.withColumn("cart_to_purchase_rate", fn.safe_rate(F.col("purchases"), F.col("carts"))) if cart_rate else out


def brands(daily_brand: DataFrame, exclude_unknown: bool = False) -> DataFrame:
    board = leaderboard(daily_brand, {"brand": fn.or_unknown(F.col("brand"))})
    return board.where(fn.known_member(F.col("brand"))) if exclude_unknown else board


def _levels() -> dict[str, Column]:
    return {"category_l1": fn.or_unknown(F.col("category_l1")), "category_l2": F.coalesce("category_l2", F.lit("")), "category_l3": F.coalesce("category_l3", F.lit(""))}


def categories(daily_category: DataFrame) -> DataFrame:
    return leaderboard(daily_category, _levels(), cart_rate=True, total=True)


def products(daily_product: DataFrame) -> DataFrame:
    return leaderboard(daily_product, {"product_id": F.col("product_id").cast("string"), "brand": fn.or_unknown(F.col("brand")), **_levels()})


def revenue_series(daily_event: DataFrame, start: str | None = None, end: str | None = None, cap: int = 366) -> DataFrame:
    cols = ["event_date", F.col("total_revenue").cast("double").alias("total_revenue"), "total_events", "total_purchases", "conversion_rate", "cart_to_purchase_rate"]
    return between_dates(daily_event, start=start, end=end).select(*cols).orderBy("event_date").limit(cap)


def latest_day(daily_event: DataFrame, day: str | None = None) -> DataFrame:
    """The last row up to a day."""
    cols = {"today_revenue": F.col("total_revenue").cast("double"), "today_events": F.col("total_events"), "today_purchases": F.col("total_purchases"), "today_conversion_rate": F.col("conversion_rate")}
    return as_of(daily_event, day).orderBy(F.col("event_date").desc_nulls_last()).limit(1).select("event_date", *[c.alias(n) for n, c in cols.items()])


def _month_to(df: DataFrame, last: DataFrame) -> DataFrame:
    """Rows from the start of the month of the one row of ``last`` up to its day."""
    day = F.broadcast(last.select(F.col("event_date").alias("__day")))
    return df.join(day, (F.col("event_date") <= F.col("__day")) & (F.col("event_date") >= F.trunc("__day", "month")))


def month_to_date(daily_event: DataFrame, day: str | None = None) -> DataFrame:
    rows = _month_to(daily_event, latest_day(daily_event, day))
    return rows.agg(F.sum("total_events").alias("mtd_events"), F.sum("total_revenue").cast("double").alias("mtd_revenue"))


def overview(daily_event: DataFrame, daily_brand: DataFrame, day: str | None = None) -> DataFrame:
    """One row: latest day, month to date, best brand of the month; all NULL without data."""
    last = latest_day(daily_event, day)
    totals = _month_to(daily_brand, last).groupBy(F.col("brand").alias("top_brand_mtd")).agg(F.sum("revenue").cast("double").alias("top_brand_mtd_revenue"))
    best = top(totals, "top_brand_mtd_revenue", 1, "top_brand_mtd")
    mtd = month_to_date(daily_event, day)  # exactly one row; the others have at most one
    return mtd.join(F.broadcast(last), F.lit(True), "left").join(F.broadcast(best), F.lit(True), "left")


def top_related(df: DataFrame, group: str, item: str, metric: str, n_groups: int = 10) -> DataFrame:
    """The groups with the highest total of a metric, each with its best item."""
    per_item = df.groupBy(group, item).agg(F.sum(metric).alias("item_total"))
    totals = top(per_item.groupBy(group).agg(F.sum("item_total").alias("group_total")), "group_total", n_groups, group)
    w = Window.partitionBy(group).orderBy(F.col("item_total").desc_nulls_last(), F.col(item).asc_nulls_last())
    ranked = per_item.join(F.broadcast(totals), group).withColumn("__r", F.row_number().over(w)).where("__r = 1")
    return ranked.select(group, "group_total", F.col(item).alias("top_item"), F.col("item_total").alias("top_item_total"))


def top_with_best(df: DataFrame, group: str, items: list[str], metric: str, n_groups: int = 10) -> DataFrame:
    """The groups with the highest total of a metric, each with its best value of every item column: ``top_x`` and
    ``top_x_total``; ties go to the smaller value.  What does not belong to a leading group is dropped before it is
    counted by item."""
    totals = top(df.groupBy(group).agg(F.sum(metric).alias("group_total")), "group_total", n_groups, group)
    inside = df.join(F.broadcast(totals.select(group)), group)  # at most n_groups rows
    for item in items:
        each = inside.groupBy(group, item).agg(F.sum(metric).alias("n"))
        best = each.groupBy(group).agg(F.min_by(F.struct(F.col(item).alias("v"), "n"), F.struct(-F.col("n"), F.col(item))).alias("b"))
        totals = totals.join(best.select(group, F.col("b.v").alias(f"top_{item}"), F.col("b.n").alias(f"top_{item}_total")), group, "left")
    return totals


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """One page with ``has_next``; one row more is read than shown."""
    more = df.orderBy(*order).offset((number - 1) * size).limit(size + 1)
    w = Window.orderBy(*order)
    ranked = more.withColumn("__r", F.row_number().over(w)).withColumn("has_next", F.count(F.lit(1)).over(Window.partitionBy()) > size)
    return ranked.where(F.col("__r") <= size).drop("__r")


def last_n(df: DataFrame, by: str, n: int = 50) -> DataFrame:
    """The last n rows, oldest first."""
    return df.orderBy(F.col(by).desc()).limit(clamp(n)).orderBy(F.col(by).asc())


def preview(df: DataFrame, n: int, *keys: str) -> DataFrame:
    return df.orderBy(*keys).limit(n)


def with_default_limit(df: DataFrame, n: int = 100) -> DataFrame:
    return df.limit(n) if n > 0 else df


def truncated(df: DataFrame, n: int = 100) -> DataFrame:
    """At most n rows, each with whether there were more (``truncated``); n + 1 rows are read, once."""
    every = F.count(F.lit(1)).over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.lit(1)))
    return df.limit(n + 1).withColumns({"__place": place, "truncated": every > n}).where(F.col("__place") <= n).drop("__place")


def with_total(page_rows: DataFrame, listing: DataFrame) -> DataFrame:
    """A page with the number of all rows of its listing."""
    return page_rows.crossJoin(F.broadcast(listing.agg(F.count(F.lit(1)).alias("total"))))  # one row


def search_all(df: DataFrame, text: str) -> DataFrame:
    """Rows in which any column, as text, holds the words."""
    return df.where(F.lower(F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in df.columns])).contains(text.lower()))


def column_totals(df: DataFrame, most: int = 4) -> DataFrame:
    """Sums of the first numeric columns, one row each."""
    from pyspark.sql.types import NumericType

    names = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)][:most]
    sums = df.agg(*[F.sum(F.col(n).cast("double")).alias(n) for n in names])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("total")) for n in names])).alias("x")).select("x.*")
