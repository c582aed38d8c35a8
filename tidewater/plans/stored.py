"""Registered queries over tables that are written, exported, streamed or described before they are read."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewater import schemas
from tidewater.functions import columns as fn
from tidewater.operators import catalog, clean, quality, serving, summaries
from tidewater.plans.queries import Gold, _at, _layer
from tidewater.sources import fixtures as fx
from tidewater.sources import tables
from tidewater.streaming import ingest

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _QUERIES[f.__name__] = f
    return f


def _bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.conform(fx.raw_events(spark, sf_dir), schemas.BRONZE)


# ---------------------------------------------------------------- files


@_query
def csv_exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events exported as CSV, read back as messages and cleaned: each content's fingerprint and rows.  An export
    trims blanks, which cleaning does as well."""
    names = [f.name for f in schemas.RAW_EVENT.fields]
    path = _layer(spark, sf_dir, "csv-export", lambda to: tables.export_csv(fx.raw_events(spark, sf_dir).select(*names), to, ";"))
    sent = spark.read.csv(path, header=True, inferSchema=False, sep=";").select(F.to_json(F.struct("*")).alias("value"))
    at = F.lit("2024-02-01").cast("timestamp")
    placed = sent.select("value", at.alias("timestamp"), F.lit(0).alias("partition"), F.lit(0).cast("bigint").alias("offset"))
    return clean.silver(tables.bronze(placed, _at()), _at()).groupBy("event_fingerprint").agg(F.count(F.lit(1)).alias("n"))


@_query
def csv_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts exported as CSV and read as JSON messages of text."""
    path = _layer(spark, sf_dir, "csv-parts", lambda to: tables.export_csv(fx.table(spark, sf_dir, "part"), to))
    data = F.from_json("value", "p_partkey string, p_name string, p_brand string, p_size string")
    return tables.csv_messages(spark, path).select(data.alias("d")).select("d.*")


@_query
def bronze_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze appended twice, the second time with one more column: rows by day in a scan that merges schemas, those
    that have the column, and the rows that the files of the day hold."""

    def make(path: str) -> None:
        raw = _bronze(spark, sf_dir)
        tables.write_partitioned(raw.where("kafka_partition = 0"), path, "date_partition")
        tables.write_partitioned(raw.where("kafka_partition > 0").withColumn("producer", F.concat(F.lit("p"), F.col("kafka_partition"))), path, "date_partition")

    path = _layer(spark, sf_dir, "bronze-files", make)
    scan = tables.read_or_none(spark, path, merge=True)
    held = scan.groupBy(F.col("date_partition").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("rows"), F.count("producer").alias("with_producer"))
    listed = tables.files(scan).groupBy(F.regexp_extract("file_path", "date_partition=([0-9-]+)", 1).alias("day")).agg(F.sum("rows").alias("in_files"))
    return held.join(listed, "day")


@_query
def silver_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sinks of a batch read back: valid rows by event day, the others by the day they were processed."""

    def make(path: str) -> None:
        tables.write_silver(*clean.split_valid(Gold(spark, sf_dir).silver), f"{path}/valid", f"{path}/quarantine")

    path = _layer(spark, sf_dir, "sinks", make)
    sinks = (("valid", "event_date"), ("quarantine", "processing_date"))
    parts = [spark.read.parquet(f"{path}/{s}").groupBy(F.lit(s).alias("sink"), F.col(day).cast("string").alias("day")).agg(F.count(F.lit(1)).alias("rows"), F.count("invalid_reason").alias("with_reason")) for s, day in sinks]
    return reduce(DataFrame.unionByName, parts)


@_query
def optional_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables that may be missing; NULL for one that is."""

    def rows(name: str) -> DataFrame:
        found = tables.read_or_none(spark, f"{sf_dir}/{name}.parquet")
        n = spark.range(1).select(F.lit(None).cast("bigint").alias("rows")) if found is None else found.agg(F.count(F.lit(1)).alias("rows"))
        return n.select(F.lit(name).alias("table_name"), "rows")

    return reduce(DataFrame.unionByName, [rows(n) for n in ("events", "orders", "returns")])


# ---------------------------------------------------------------- listings, values


@_query
def listing_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listing of at most 100 rows shows of each table, and whether it says that there is more."""
    out = []
    for name in ("events", "nation", "region"):
        df = fx.table(spark, sf_dir, name)
        cut = serving.truncated(df, 100).agg(F.count(F.lit(1)).alias("shown"), F.coalesce(F.max("truncated"), F.lit(False)).alias("more"))
        plain = serving.with_default_limit(df).agg(F.count(F.lit(1)).alias("by_default"))
        out.append(cut.crossJoin(F.broadcast(plain)).select(F.lit(name).alias("table_name"), "shown", "more", "by_default"))  # one row each
    return reduce(DataFrame.unionByName, out)


@_query
def summaries_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and revenue of the summaries that a refresh asks for: all, or one."""
    g, out = Gold(spark, sf_dir), []
    for which in ("all", "brand"):
        for name, df in summaries.build(which, g.events, g.product, _at()).items():
            out.append(df.agg(F.count(F.lit(1)).alias("rows"), fn.money(F.sum("total_revenue" if name == "event" else "revenue")).alias("revenue")).select(F.lit(which).alias("asked"), F.lit(name).alias("summary"), "rows", "revenue"))
    return reduce(DataFrame.unionByName, out)


@_query
def json_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of events, some broken, no object or missing, parsed with a default, and written as JSON again."""
    n = F.col("event_id")
    text = F.when(n % 7 == 1, F.concat(F.lit("{"), "props")).when(n % 7 == 2, F.lit("[1]")).when(n % 7 == 3, F.lit("")).when(n % 7 == 4, F.lit(None)).otherwise(F.col("props"))
    value = fn.json_or(text, "k bigint", F.struct(F.lit(-1).cast("bigint").alias("k")))
    return fx.table(spark, sf_dir, "events").select("event_id", value.alias("v")).select("event_id", F.col("v.k").alias("k"), F.to_json("v").alias("again"))


@_query
def audit_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the time at which each layer says it was made."""
    g = Gold(spark, sf_dir)
    layers = {"silver": (g.silver, "silver_processed_at"), "fact_events": (g.events, "gold_processed_at"), "dim_product": (g.product, "updated_at"), "daily_brand": (g.daily("brand"), "gold_processed_at")}
    return reduce(DataFrame.unionByName, [df.groupBy(F.lit(name).alias("layer"), F.unix_timestamp(c).alias("made_at")).agg(F.count(F.lit(1)).alias("rows")) for name, (df, c) in layers.items()])


# ---------------------------------------------------------------- catalog


_LIVE = ("events", "orders", "part")


def _described(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    live = {n: fx.table(spark, sf_dir, n) for n in _LIVE}
    filled = [df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).unpivot([], df.columns, "column_name", "filled").select(F.lit(n).alias("table_name"), "column_name", "filled") for n, df in live.items()]
    return live, catalog.column_catalog(spark, {n: df.schema for n, df in live.items()}), reduce(DataFrame.unionByName, filled)


@_query
def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of live tables as an agent sees them, by their own, common or derived definition, and their values."""
    _, columns, filled = _described(spark, sf_dir)
    return catalog.visible(columns).join(filled, ["table_name", "column_name"]).select("table_name", "column_name", "display_name", "meaning", "role", "filled")


@_query
def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and columns whose description holds a text, with the rows of their table."""
    live, columns, _ = _described(spark, sf_dir)
    described = catalog.table_catalog(spark, {f"fact_{n}": df.schema for n, df in live.items()}, hidden=()).withColumn("table_name", F.replace("table_name", F.lit("fact_"), F.lit("")))
    rows = reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in live.items()])
    return catalog.search(described, columns, "ORDER").join(rows, "table_name")


@_query
def catalog_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions with a fault of each kind, and the values that the column holds (NULL if there is none)."""
    live, columns, filled = _described(spark, sf_dir)
    name = F.concat_ws(".", "table_name", "column_name")
    shaped = columns.where(name != "orders.o_custkey").withColumn("meaning", F.when(name == "events.user_id", " ").otherwise(F.col("meaning")))
    gone = columns.where(name == "part.p_name").withColumn("column_name", F.lit("p_gone"))
    defined = shaped.unionByName(columns.where(name == "part.p_brand")).unionByName(gone)
    for n, df in live.items():
        quality.require_columns(df, df.columns[:1], n)
    found = catalog.definition_problems(spark, {n: df.schema for n, df in live.items()}, defined)
    return found.join(filled, ["table_name", "column_name"], "left").select("table_name", "column_name", "problem", "filled").distinct()


# ---------------------------------------------------------------- streams


def _written(stream: DataFrame, path: str, mode: str) -> StreamingQuery:
    """Runs a stream over what is there.  In complete mode each batch replaces the table."""
    to = stream.writeStream.option("checkpointLocation", f"{path}/check").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        return to.format("parquet").option("path", f"{path}/out").start()
    return to.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/out")).start()


@_query
def streamed_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of messages taken in by three runs of one stream, the last without news: rows by day and partition."""

    def make(path: str) -> None:
        raw = _bronze(spark, sf_dir)
        for rows in (raw.where("kafka_partition = 0"), raw.where("kafka_partition > 0"), None):
            if rows is not None:
                rows.write.mode("append").parquet(f"{path}/in")
            ingest.ingest(ingest.raw_stream(spark, f"{path}/in"), f"{path}/out", f"{path}/check").awaitTermination()

    out = spark.read.parquet(f"{_layer(spark, sf_dir, 'streamed-bronze', make)}/out")
    return out.groupBy(F.col("date_partition").cast("string").alias("day"), "kafka_partition").agg(F.count(F.lit(1)).alias("rows"))


@_query
def streamed_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid events once each, from a stream that delivers some again within its lateness."""

    def make(path: str) -> None:
        clean.silver(_bronze(spark, sf_dir), _at()).where("is_valid").write.parquet(f"{path}/in")
        _written(ingest.drop_repeats(spark.readStream.schema(schemas.SILVER).parquet(f"{path}/in"), "400 days"), path, "append").awaitTermination()

    out = spark.read.schema(schemas.SILVER).parquet(f"{_layer(spark, sf_dir, 'streamed-distinct', make)}/out")
    return out.select("event_fingerprint", "event_type", "product_id", "price")


@_query
def streamed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The additive columns of the daily summary, kept by a stream of facts that arrive in two parts."""

    def make(path: str) -> None:
        events = Gold(spark, sf_dir).events
        for rest in (0, 1):
            events.where(F.col("kafka_partition") % 2 == rest).write.mode("append").parquet(f"{path}/in")
            counters = ingest.daily_counters(spark.readStream.schema(schemas.FACT_EVENTS).parquet(f"{path}/in"), "400 days")
            _written(counters, path, "complete").awaitTermination()

    out = spark.read.parquet(f"{_layer(spark, sf_dir, 'streamed-counters', make)}/out")
    return out.select("event_date", "total_events", *[f"total_{t}" for t in clean.EVENT_TYPES], fn.money(F.col("total_revenue")).alias("total_revenue"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)
