"""Idempotent upsert of batches into Silver, for any number of streams.

A batch is named by its stream and number, and a *commit* of the two is appended when its rows are in both
tables.  A batch that has one is not looked at again; another stream with the same numbers is.  A batch that broke
off between the writes has none: it is repeated, and what is there already is left out by content.

Only what a batch may meet is read.  The fingerprint holds the second of the event, so equal events have one
``event_date``: Silver is read in the batch's days alone, as partition filters.  Quarantine is read within the
batch's span of offsets, which the row groups' statistics skip by.

Writers of one table take turns: two batches at one time could each add an event that the other adds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructField, StructType, StringType

from tidewater import schemas
from tidewater.operators import clean
from tidewater.sources import tables

COMMITS = "stream string, batch_id long, valid long, invalid long, deduped long, skipped long, written long, quarantined long, days array<date>"
#: Days of a batch whose new events are counted one by one; of more, all count as touched.
MOST_DAYS = 366


@dataclass
class Upserted:
    """What a batch did: its valid and invalid rows, valid ones that it repeats itself, keys that Silver had, rows added to
    each table, and the days with new events; ``repeated`` if it was committed before and so nothing was done."""

    valid: int = 0
    invalid: int = 0
    deduped: int = 0
    skipped: int = 0
    written: int = 0
    quarantined: int = 0
    days: list[date] = field(default_factory=list)
    repeated: bool = False


def commits(spark: SparkSession, silver_path: str) -> DataFrame:
    """The commits beside a Silver table."""
    found = tables.read_or_none(spark, f"{silver_path.rstrip('/')}-commits", schemas_of(COMMITS))
    return found if found is not None else spark.createDataFrame([], COMMITS)


def schemas_of(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def known_in_days(spark: SparkSession, silver_path: str, days: list[date]) -> DataFrame | None:
    """Fingerprints that Silver holds in some days: only these partitions and this column are read."""
    have = tables.read_or_none(spark, silver_path, StructType([StructField("event_fingerprint", StringType()), schemas.SILVER["event_date"]]))
    return None if have is None else tables.in_days(have, days).select("event_fingerprint")


def upsert(batch: DataFrame, stream: str, batch_id: int, silver_path: str, quarantine_path: str, processed_at: Column | None = None) -> Upserted:
    """Adds a batch's valid events that Silver lacks, once each, and its invalid rows that quarantine lacks."""
    spark = batch.sparkSession
    done = commits(spark, silver_path).where((F.col("stream") == stream) & (F.col("batch_id") == batch_id))
    if not done.isEmpty():
        return Upserted(repeated=True)
    every = clean.silver(batch, processed_at)
    days = sorted(r[0] for r in every.where("is_valid").select("event_date").distinct().collect())  # calendar days of one batch
    seen, kept, added = Observation(), Observation(), Observation()
    every = every.observe(seen, F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid"))
    valid, bad = clean.split_valid(every)
    fresh = clean.keep_latest(valid, ["event_fingerprint"]).observe(kept, F.count(F.lit(1)).alias("n"))
    have = known_in_days(spark, silver_path, days)
    if have is not None:
        fresh = fresh.join(have, "event_fingerprint", "left_anti")
    by_day = [F.count_if(F.col("event_date") == F.lit(d)).alias(f"d{i}") for i, d in enumerate(days[:MOST_DAYS])]
    fresh = fresh.observe(added, F.count(F.lit(1)).alias("n"), *by_day)
    # the counters are taken while the rows are written
    tables.write_partitioned(fresh, silver_path, "event_date")
    new = added.get
    touched = days if len(days) > MOST_DAYS else [d for i, d in enumerate(days) if new[f"d{i}"]]
    quarantined = _quarantine(spark, bad, quarantine_path) if seen.get["invalid"] else 0
    out = Upserted(seen.get["valid"], seen.get["invalid"], seen.get["valid"] - kept.get["n"], kept.get["n"] - new["n"], new["n"], quarantined, touched if new["n"] else [])
    row = (stream, batch_id, out.valid, out.invalid, out.deduped, out.skipped, out.written, out.quarantined, out.days)
    spark.createDataFrame([row], COMMITS).coalesce(1).write.mode("append").parquet(f"{silver_path.rstrip('/')}-commits")
    return out


def _quarantine(spark: SparkSession, bad: DataFrame, path: str) -> int:
    """Adds invalid rows, once each by lineage; how many."""
    low, high = bad.agg(F.min("kafka_offset"), F.max("kafka_offset")).first()
    bad = bad.dropDuplicates(["source_event_id"])
    kept = tables.read_or_none(spark, path, schemas.QUARANTINE)
    if kept is not None:
        inside = F.col("kafka_offset").isNull() if low is None else F.col("kafka_offset").between(low, high) | F.col("kafka_offset").isNull()
        bad = clean.new_rows(bad, kept.where(inside), "source_event_id")
    added = Observation()
    tables.write_partitioned(bad.observe(added, F.count(F.lit(1)).alias("n")), path, "processing_date")
    return added.get["n"]


def silver_writer(silver_path: str, quarantine_path: str, stream: str = "silver", processed_at: Column | None = None, then: Callable[[SparkSession, Upserted], object] | None = None):
    """For ``foreachBatch``; ``then`` is called with what each new batch did, say to refresh its days."""

    def write(batch: DataFrame, batch_id: int) -> None:
        done = upsert(batch, stream, batch_id, silver_path, quarantine_path, processed_at)
        if then is not None and not done.repeated:
            then(batch.sparkSession, done)

    return write


def silver_stream(events: DataFrame, silver_path: str, quarantine_path: str, checkpoint: str, stream: str = "silver", processed_at: Column | None = None, then: Callable[[SparkSession, Upserted], object] | None = None) -> StreamingQuery:
    """Takes what is new in a stream, then stops.  ``stream`` names it in the commits: a stream that starts again with
    another checkpoint counts its batches from 0 and needs another name, or its first batches count as done."""
    return events.writeStream.foreachBatch(silver_writer(silver_path, quarantine_path, stream, processed_at, then)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
