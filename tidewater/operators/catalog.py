"""Schemas described as data: semantic catalogs of tables and columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater import schemas
from tidewater.operators import quality

#: What is common to columns of one name, and what a table says of its own.
COMMON = {
    "event_date": ("Event date", "Calendar day of the event, UTC", "time"),
    "brand": ("Brand", "Brand in lower case; unknown if missing", "dimension"),
    "category_l1": ("Category", "First category level", "dimension"),
    "revenue": ("Revenue", "Sum of purchase prices", "metric"),
    "total_revenue": ("Revenue", "Sum of purchase prices", "metric"),
    "conversion_rate": ("Conversion rate", "Purchases per view; may exceed one", "metric"),
    "product_id": ("Product", "Product identifier", "key"),
    "user_id": ("User", "User identifier", "key"),
    "session_id": ("Session", "Session identifier", "key"),
}
OWN = {("fact_events", "price"): ("Price", "Price shown with the event", "metric"), ("fact_sales", "unit_price"): ("Unit price", "Price of the unit sold", "metric")}
_GRAIN = {"fact": "one row per event", "dim": "one row per member", "daily": "one row per day and member", "stg": "one row per event"}


def table_catalog(spark: SparkSession, tables: dict[str, T.StructType] = schemas.GOLD, hidden: tuple[str, ...] = ("stg_events",)) -> DataFrame:
    rows = [(t, t.replace("_", " ").capitalize(), f"{t.replace('_', ' ')} of the event lakehouse", _GRAIN[t.split("_")[0]], f"questions about {t.split('_', 1)[1].replace('_', ' ')}", None, t not in hidden) for t in tables]
    return spark.createDataFrame(rows, schemas.TABLE_CATALOG)


def column_catalog(spark: SparkSession, tables: dict[str, T.StructType] = schemas.GOLD) -> DataFrame:
    """Live columns with the table's own definition, else the common one, else one from the name."""
    live = spark.createDataFrame([(t, f.name, f.dataType.simpleString()) for t, s in tables.items() for f in s.fields], "table_name string, column_name string, data_type string")
    common = spark.createDataFrame([(k, *v) for k, v in COMMON.items()], "column_name string, c1 string, c2 string, c3 string")
    own = spark.createDataFrame([(*k, *v) for k, v in OWN.items()], "table_name string, column_name string, o1 string, o2 string, o3 string")
    both = live.join(common, "column_name", "left").join(own, ["table_name", "column_name"], "left")
    name = F.initcap(F.replace("column_name", F.lit("_"), F.lit(" ")))
    return schemas.conform(both, schemas.COLUMN_CATALOG, display_name=F.coalesce("o1", "c1", name), meaning=F.coalesce("o2", "c2", name), role=F.coalesce("o3", "c3", F.lit("attribute")), is_agent_visible=~F.col("column_name").endswith("processed_at"))


def visible(catalog: DataFrame) -> DataFrame:
    return catalog.where("is_agent_visible")


def nested(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """A row per table with its columns, in name order, and their number."""
    held = columns.groupBy("table_name").agg(F.array_sort(F.collect_list(F.struct("column_name", "data_type", "meaning"))).alias("columns"), F.count(F.lit(1)).alias("n_columns"))
    return tables.join(held, "table_name", "left").withColumn("n_columns", F.coalesce("n_columns", F.lit(0)))


def search(tables: DataFrame, columns: DataFrame, text: str, n: int = 20) -> DataFrame:
    """Tables, then columns, of which any describing field holds the text."""
    q = text.lower()

    def holds(*names: str):
        return reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).contains(q), F.lit(False)) for c in names])

    hit = tables.where(holds("table_name", "display_name", "purpose", "grain", "use_for", "notes")).select("table_name", F.lit(None).cast("string").alias("column_name"), F.lit("table").alias("kind"))
    inner = columns.where(holds("column_name", "display_name", "meaning", "role", "data_type")).select("table_name", "column_name", F.lit("column").alias("kind"))
    both = hit.unionByName(inner)
    return both.orderBy("table_name", F.col("column_name").asc_nulls_first()).limit(n)


def definition_problems(spark: SparkSession, tables: dict[str, T.StructType], defined: DataFrame) -> DataFrame:
    """Definitions that are repeated, blank or of unknown columns, and columns without one."""
    live = spark.createDataFrame([(t, f.name) for t, s in tables.items() for f in s.fields], "table_name string, column_name string")
    keys = ["table_name", "column_name"]
    parts = [
        ("repeated", quality.duplicate_keys(defined, keys).select(*keys)),
        ("blank", defined.where("trim(coalesce(meaning, '')) = ''").select(*keys)),
        ("unknown", quality.orphans(defined.select(*keys), live, keys)),
        ("undefined", live.join(defined.select(*keys).distinct(), keys, "left_anti")),
    ]
    return reduce(DataFrame.unionByName, [d.withColumn("problem", F.lit(p)) for p, d in parts])


def live_problems(spark: SparkSession, catalog: DataFrame, namespace: str) -> DataFrame:
    """Catalog rows whose table or column does not exist in a live database."""
    names = [t.name for t in spark.catalog.listTables(namespace)]
    live = spark.createDataFrame([(t, f.name) for t in names for f in spark.table(f"{namespace}.{t}").schema.fields], "table_name string, column_name string")
    return quality.orphans(catalog.select("table_name", "column_name"), live, ["table_name", "column_name"])
