"""Row numbers by key for keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.sources.scratch import settled


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "n") -> DataFrame:
    """``df`` with each row's number from 1 within its key.

    Rows are dealt by range of (keys, order), so a key with a third of all rows is sorted by many tasks.  A row's
    number is its place within its range of the key and the sizes of the key's ranges before; of those there
    is a row for each key and range.  Rows that tie in the order take numbers in any order.
    """
    by = [*[F.col(k).asc_nulls_first() for k in keys], *order]
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    dealt = settled(ranged, "numbered").withColumn("__part", F.shiftright("__at", 33))
    names = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    sizes = dealt.groupBy(*names, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__size"))
    before = Window.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0))).withColumnRenamed("__part", "__p").drop("__size")
    same = dealt["__part"] == starts["__p"]
    for i, k in enumerate(keys):
        same &= dealt[k].eqNullSafe(starts[f"__k{i}"])
    number = F.col("__at") - F.col("__first") + F.col("__before") + 1
    return dealt.join(starts, same).select(*df.columns, number.cast("bigint").alias(name))
