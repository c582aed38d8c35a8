"""Daily summaries that are refreshed by day.

Tables below one folder, each partitioned by ``event_date``.  A refresh of some days reads Silver in these
partitions only, builds their summaries anew and replaces their partitions; other days' files stay as they are.

Rows of a summary also depend on the product dimension, whose attributes are the first known ones of all days.
A *state* keeps, for each product and attribute, the earliest (time, fingerprint, value): a minimum, so states of
any days can be merged in any order and repeatedly.  Where late events change a product's attributes, the days
of that product, which the stored product summary lists, are refreshed too.

States are written as versions; a refresh is done when its version is in the log.  One that broke off is repeated
from the version before and comes to the same tables.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewater import schemas
from tidewater.operators import star, summaries
from tidewater.sources import tables

KNOWN = ("category_id", "category_code", "category_l1", "category_l2", "category_l3", "brand")
SUMMARIES = {"event": schemas.DAILY_EVENT, "product": schemas.DAILY_PRODUCT, "category": schemas.DAILY_CATEGORY, "brand": schemas.DAILY_BRAND}
_LOG = "version long, asked array<date>, refreshed array<date>"


def product_state(stg: DataFrame) -> DataFrame:
    """Per product the earliest known (time, fingerprint, value) of each attribute."""
    first = [F.min(F.when(F.col(c).isNotNull(), F.struct("event_ts", "event_fingerprint", F.col(c).alias("value")))).alias(c) for c in KNOWN]
    return stg.groupBy("product_id").agg(*first)


def merged_state(*states: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, states).groupBy("product_id").agg(*[F.min(c).alias(c) for c in KNOWN])


def attributes(state: DataFrame) -> DataFrame:
    return state.select("product_id", *[F.col(f"{c}.value").alias(c) for c in KNOWN])


def changed_products(before: DataFrame, after: DataFrame) -> DataFrame:
    """Products of both whose attributes differ."""
    old = attributes(before).select("product_id", F.struct(*KNOWN).alias("old"))
    new = attributes(after).select("product_id", F.struct(*KNOWN).alias("new"))
    return old.join(new, "product_id").where(~F.col("old").eqNullSafe(F.col("new"))).select("product_id")


class DailyTables:
    """The summaries below ``root``."""

    def __init__(self, spark: SparkSession, silver_path: str, root: str):
        self.spark, self.silver_path, self.root = spark, silver_path, root.rstrip("/")

    def read(self, which: str) -> DataFrame | None:
        schema = SUMMARIES[which]
        found = tables.read_or_none(self.spark, f"{self.root}/daily_{which}", schema)
        return None if found is None else found.select(*schema.names)

    def log(self) -> DataFrame | None:
        return tables.read_or_none(self.spark, f"{self.root}/refreshes", StructType.fromDDL(_LOG))

    def version(self) -> int | None:
        log = self.log()
        return None if log is None else log.agg(F.max("version")).first()[0]

    def _state_path(self, version: int) -> str:
        return f"{self.root}/product_state/{version}"

    def staging(self, days: list[date] | None, as_of: Column | None) -> DataFrame:
        silver = self.spark.read.schema(schemas.SILVER).parquet(self.silver_path)
        return star.staging(silver if days is None else tables.in_days(silver, days), as_of)

    def refresh(self, days: list[date] | None = None, as_of: Column | None = None) -> list[date]:
        """Refreshes these days (all by default), and those in which a product has other attributes than before;
        the days that were rebuilt."""
        if days is not None and not days:
            return []
        version = self.version()
        if version is None:
            days = None
        state = product_state(self.staging(days, as_of))
        path = self._state_path(0 if version is None else version + 1)
        more: list[date] = []
        if version is None:
            state.write.mode("overwrite").parquet(path)
        else:
            before = self.spark.read.parquet(self._state_path(version))
            merged_state(before, state).write.mode("overwrite").parquet(path)
            if days is not None:
                changed = changed_products(before, self.spark.read.parquet(path))
                sold = self.read("product").select("product_id", "event_date")
                more = [r[0] for r in sold.join(changed, "product_id", "left_semi").select("event_date").distinct().collect()]
        rebuilt = None if days is None else sorted({*days, *more})
        product = attributes(self.spark.read.parquet(path))
        events = star.fact_events(self.staging(rebuilt, as_of), as_of)
        for which, df in summaries.build("all", events, product, as_of).items():
            tables.replace_days(df, f"{self.root}/daily_{which}")
        if rebuilt is None:
            rebuilt = [r[0] for r in self.read("event").select("event_date").distinct().orderBy("event_date").collect()]
        done = [(0 if version is None else version + 1, days if days is not None else rebuilt, rebuilt)]
        self.spark.createDataFrame(done, _LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/refreshes")
        if version is not None:
            tables.remove(self.spark, self._state_path(version))
        return rebuilt
