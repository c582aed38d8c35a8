"""Data contracts.  A check gives rows (check_name, table_name, n_violations); ``enforce`` raises."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidewater.functions import columns as fn
from tidewater.operators.summaries import revenue_by_date


class ContractError(RuntimeError):
    pass


def require_columns(df: DataFrame, names: list[str], table: str) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ContractError(f"{table} lacks columns: {', '.join(missing)}")


def _report(df: DataFrame, table: str, checks: dict[str, Column]) -> DataFrame:
    """All checks as aggregates of one pass."""
    one = df.agg(*[c.cast("bigint").alias(n) for n, c in checks.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("check_name"), F.lit(table).alias("table_name"), F.col(n).alias("n_violations")) for n in checks])
    return one.select(F.explode(pairs).alias("x")).select("x.*")


def not_null(name: str) -> dict[str, Column]:
    return {f"null_{name}": F.count_if(F.col(name).isNull())}


def unique(name: str) -> dict[str, Column]:
    """Rows beyond one per value."""
    return {f"duplicate_{name}": F.count(name) - F.count_distinct(name)}


def key_contract(df: DataFrame, key: str, table: str) -> DataFrame:
    return _report(df, table, {**not_null(key), **unique(key)})


def equal_counts(left: DataFrame, right: DataFrame, name: str, table: str) -> DataFrame:
    sides = left.select(F.lit(1).alias("d")).unionByName(right.select(F.lit(-1).alias("d")))
    return sides.agg(F.coalesce(F.abs(F.sum("d")), F.lit(0)).cast("bigint").alias("n")).select(F.lit(name).alias("check_name"), F.lit(table).alias("table_name"), F.col("n").alias("n_violations"))


def fact_contract(events: DataFrame, sales: DataFrame) -> DataFrame:
    bought = events.where("is_purchase")
    parts = [key_contract(events, "event_fingerprint", "fact_events"), key_contract(sales, "sale_id", "fact_sales"), equal_counts(sales, bought, "sales_are_purchases", "fact_sales")]
    return reduce(DataFrame.unionByName, parts)


def reconcile(summary: DataFrame, events: DataFrame, sales: DataFrame) -> DataFrame:
    """Days on which the summary and the facts disagree, with both sides."""
    want = events.groupBy("event_date").agg(F.count(F.lit(1)).alias("fact_events"), F.count_if("is_purchase").alias("fact_purchases"))
    want = want.join(revenue_by_date(sales).withColumnRenamed("total_revenue", "fact_revenue"), "event_date", "full_outer")
    both = summary.select("event_date", "total_events", "total_purchases", "total_revenue").join(want, "event_date", "full_outer")
    off = F.coalesce("total_events", F.lit(-1)) != F.coalesce("fact_events", F.lit(-1))
    off |= F.coalesce("total_purchases", F.lit(-1)) != F.coalesce("fact_purchases", F.lit(-1))
    off |= F.coalesce("total_revenue", fn.money(0)) != F.coalesce("fact_revenue", fn.money(0))
    return both.where(off)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(df: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(parent.select(*keys).distinct(), keys, "left_anti")


def enforce(report: DataFrame) -> None:
    """Raises if any check of the (small) report has violations."""
    if bad := report.where("n_violations > 0").collect():
        raise ContractError("; ".join(f"{r['table_name']}: {r['check_name']} = {r['n_violations']}" for r in bad))


def refresh_counters(silver: DataFrame, existing: DataFrame, key: str = "event_fingerprint") -> DataFrame:
    """One row: valid, invalid, deduped (repeats within the batch), skipped (keys that exist), written.  Both tables are
    read once: rows are counted by key before they meet the existing keys."""
    by_key = silver.groupBy(key).agg(F.count_if("is_valid").alias("good"), F.count_if(~F.col("is_valid")).alias("bad"))
    have = existing.select(key).distinct().withColumn("__have", F.lit(True))
    kept, known = F.count_if(F.col("good") > 0), F.count_if((F.col("good") > 0) & F.col("__have"))
    valid, none = F.coalesce(F.sum("good"), F.lit(0)), F.lit(0)
    return by_key.join(have, key, "left").agg(valid.alias("valid"), F.coalesce(F.sum("bad"), none).alias("invalid"), (valid - kept).alias("deduped"), known.alias("skipped"), (kept - known).alias("written"))


def observed(df: DataFrame, name: str = "refresh") -> tuple[DataFrame, Observation]:
    """Counts of valid and invalid rows taken while another action runs."""
    seen = Observation(name)
    return df.observe(seen, F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid")), seen
