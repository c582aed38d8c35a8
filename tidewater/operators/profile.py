"""Column profiles of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TIME_WORDS = ("date", "time", "month", "year", "day")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column, from one pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in df.columns])).alias("x")).select("x.*")


def category_depth(df: DataFrame, column: str = "category_code") -> DataFrame:
    c = F.trim(F.coalesce(F.col(column), F.lit("")))
    depth = F.when(c == "", 0).otherwise(F.size(F.split(c, "[.]")))
    return df.groupBy(depth.alias("depth")).agg(F.count(F.lit(1)).alias("n"))


def kinds(df: DataFrame) -> dict[str, list[str]]:
    """Column names by kind; a numeric column named like a date is of both kinds."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    time = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) or any(w in f.name.lower() for w in _TIME_WORDS)]
    return {"numeric": numeric, "time": time, "categorical": [c for c in df.columns if c not in numeric and c not in time]}


def profile(df: DataFrame) -> DataFrame:
    """Per column: kind, rows, nulls, approximate distinct values."""
    found = kinds(df)
    kind = {c: "+".join(k for k, names in found.items() if c in names) for c in df.columns}
    one = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in df.columns], *[F.approx_count_distinct(c).alias(f"d_{c}") for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(kind[c]).alias("kind"), F.col("__rows").alias("rows"), F.col(f"n_{c}").alias("nulls"), F.col(f"d_{c}").alias("distinct_values")) for c in df.columns])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def repeated_values(df: DataFrame, column: str) -> DataFrame:
    return value_counts(df, column).where("n > 1")
