"""Reading and writing tables: messages, Parquet folders, catalog tables, exports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater import schemas

# ---------------------------------------------------------------- messages


def csv_messages(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header as JSON messages of its columns, all text."""
    return spark.read.csv(path, header=True, inferSchema=False).select(F.to_json(F.struct("*")).alias("value"))


def bronze(messages: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """Messages (value, timestamp, partition, offset) parsed by the fixed schema; a malformed one has
    NULL fields.  Works on batches and streams."""
    parsed = F.from_json(F.col("value").cast("string"), schemas.RAW_EVENT).alias("data")
    rows = messages.select(parsed, F.col("timestamp").alias("kafka_ts"), F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"))
    at = ingested_at if ingested_at is not None else F.current_timestamp()
    return schemas.conform(rows.select("data.*", "kafka_ts", "kafka_partition", "kafka_offset"), schemas.BRONZE, ingested_at=at, date_partition=F.to_date("kafka_ts"))


def kafka_stream(spark: SparkSession, servers: str, topic: str, starting: str = "earliest") -> DataFrame:
    """The topic as a stream; needs the Kafka connector on the class path.  Lost offsets are skipped."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return reader.option("startingOffsets", starting).option("failOnDataLoss", "false").load()


def next_offsets(rows: DataFrame, topic: str, stored: DataFrame | None = None) -> DataFrame:
    """Per partition the offset after the highest one read; silent partitions keep theirs."""
    high = rows.groupBy(F.col("kafka_partition").alias("partition")).agg((F.max("kafka_offset") + 1).alias("__new"))
    if stored is None:
        return schemas.conform(high, schemas.OFFSETS, topic=F.lit(topic), next_offset="__new")
    both = high.join(stored.where(F.col("topic") == topic).select("partition", "next_offset"), "partition", "full_outer")
    return schemas.conform(both, schemas.OFFSETS, topic=F.lit(topic), next_offset=F.coalesce("__new", "next_offset"))


def starting_offsets(offsets: DataFrame, topic: str) -> Column:
    """The stored offsets as the JSON text that a Kafka reader takes."""
    held = F.map_from_entries(F.collect_list(F.struct(F.col("partition").cast("string"), "next_offset")))
    return offsets.where(F.col("topic") == topic).agg(F.to_json(F.create_map(F.lit(topic), held)).alias("starting_offsets"))


#: Offsets of a message log that share a folder.
SEGMENT = 1_000_000


def append_messages(messages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Adds messages (value, timestamp, partition, offset) to a log below ``path``: a folder for each partition and
    segment of ``segment`` offsets, as a reader that begins at an offset needs them.  Rows are dealt by folder and evened
    out, so that a segment becomes few files."""
    placed = messages.withColumns({"log_partition": F.col("partition"), "log_segment": F.floor(F.col("offset") / segment)})
    placed.hint("rebalance", "log_partition", "log_segment").write.mode("append").partitionBy("log_partition", "log_segment").parquet(path)


def messages_from(spark: SparkSession, path: str, stored: DataFrame | None, topic: str, segment: int = SEGMENT) -> DataFrame | None:
    """The messages of a log from the stored offsets on; partitions without one from their start; None without a log.

    The offsets (a row per partition) become filters on the folders, so segments that lie below are not listed for
    reading, and on the offsets themselves, which the row groups' statistics skip by.
    """
    log = read_or_none(spark, path)
    if log is None or stored is None:
        return None if log is None else log.drop("log_partition", "log_segment")
    at = {r["partition"]: r["next_offset"] for r in stored.where(F.col("topic") == topic).select("partition", "next_offset").collect()}
    part, seg = F.col("log_partition"), F.col("log_segment")
    folders, rows = ~part.isin(list(at)), ~F.col("partition").isin(list(at))
    for p, o in at.items():
        folders |= (part == p) & (seg >= o // segment)
        rows |= (F.col("partition") == p) & (F.col("offset") >= o)
    found = log.where(folders & rows) if at else log
    return found.drop("log_partition", "log_segment")


def ingest_messages(spark: SparkSession, log_path: str, offsets_path: str, topic: str, bronze_path: str, ingested_at: Column | None = None, segment: int = SEGMENT) -> int:
    """Appends what is new in a message log to Bronze and moves the stored offsets on; the number of rows.  Offsets are
    written last: a run that breaks off is repeated from the old ones (Silver tells repeats by content)."""
    stored = read_or_none(spark, offsets_path, schemas.OFFSETS)
    new = messages_from(spark, log_path, stored, topic, segment)
    if new is None:
        return 0
    parsed = bronze(new, ingested_at)
    seen = Observation()
    evened = parsed.hint("rebalance", "date_partition")  # few files a day
    write_partitioned(evened.observe(seen, F.count(F.lit(1)).alias("n")), bronze_path, "date_partition")
    if n := seen.get["n"]:
        high = next_offsets(new.select(F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset")), topic, stored)
        others = [] if stored is None else [tuple(r) for r in stored.where(F.col("topic") != topic).collect()]
        rows = [tuple(r) for r in high.collect()] + others  # a row per partition
        spark.createDataFrame(rows, schemas.OFFSETS).coalesce(1).write.mode("overwrite").parquet(offsets_path)
    return n


# ---------------------------------------------------------------- folders


def read_or_none(spark: SparkSession, path: str, schema: T.StructType | None = None, merge: bool = False) -> DataFrame | None:
    """A Parquet folder, or None where it is missing or cannot be read."""
    if not exists(spark, path):
        return None
    try:
        reader = spark.read.option("mergeSchema", merge)
        return (reader.schema(schema) if schema is not None else reader).parquet(path)
    except AnalysisException:
        return None


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, size and change time of every file at or below a path, in name order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
    out = []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or one that it is a pattern of, is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def in_days(df: DataFrame, days: list, column: str = "event_date", most: int = 1000) -> DataFrame:
    """Rows of these days, as a filter on partitions: the days themselves, or their span where they are many."""
    if len(days) > most:
        return df.where(F.col(column).between(min(days), max(days)))
    return df.where(F.col(column).isin(list(days)) if days else F.lit(False))


def write_mode(mode: str | None) -> str:
    return mode if mode in ("append", "overwrite") else "append"


def write_partitioned(df: DataFrame, path: str, by: str, mode: str | None = "append") -> None:
    df.write.mode(write_mode(mode)).partitionBy(by).parquet(path)


def write_silver(valid: DataFrame, quarantine: DataFrame, valid_path: str, quarantine_path: str, mode: str | None = "append") -> None:
    write_partitioned(valid, valid_path, "event_date", mode)
    write_partitioned(quarantine, quarantine_path, "processing_date", mode)


def replace_days(df: DataFrame, path: str, by: str = "event_date") -> None:
    """Only the partitions that ``df`` has rows of are replaced.  Rows are dealt by day and evened out, so that a day
    becomes few files and a large one more than one task."""
    df.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def files(df: DataFrame) -> DataFrame:
    """The files behind a Parquet table: rows, size, change time."""
    m = "_metadata"
    return df.groupBy(F.col(f"{m}.file_path").alias("file_path")).agg(F.count(F.lit(1)).alias("rows"), F.max(f"{m}.file_size").alias("file_size"), F.max(f"{m}.file_modification_time").alias("modified_at"))


def export_csv(df: DataFrame, path: str, delimiter: str = ",") -> None:
    df.write.mode("overwrite").csv(path, header=True, sep=delimiter)


# ---------------------------------------------------------------- catalog tables


def required_table(spark: SparkSession, name: str) -> DataFrame:
    if not spark.catalog.tableExists(name):
        raise LookupError(f"table {name} does not exist")
    return spark.table(name)


def create_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")


def create_table(spark: SparkSession, name: str, schema: T.StructType, partition: str | None = None, provider: str = "parquet") -> None:
    """Created with the declared schema unless it is there."""
    split = f" PARTITIONED BY (`{partition}`)" if partition else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schemas.ddl(schema)}) USING {provider}{split}")


def full_refresh(df: DataFrame, name: str, schema: T.StructType) -> None:
    """Replaces all rows of a table with ``df`` in the table's columns and types."""
    columns = df.sparkSession.table(name).columns if df.sparkSession.catalog.tableExists(name) else [f.name for f in schema.fields]
    schemas.conform(df, schema).select(*columns).write.mode("overwrite").insertInto(name, overwrite=True)
