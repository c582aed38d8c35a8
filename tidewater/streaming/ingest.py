"""Streaming forms: ingest, bounded-lateness deduplication, daily counters, rate limits."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewater import schemas
from tidewater.operators import clean


def raw_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of Bronze Parquet files as a stream."""
    return spark.readStream.schema(schemas.BRONZE).parquet(folder)


def ingest(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends what is new in a stream, then stops; progress is in the checkpoint."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).partitionBy("date_partition").trigger(availableNow=True).start()


def drop_repeats(silver: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Events once each, where a bound on lateness is acceptable."""
    return silver.withWatermark("event_ts", lateness).dropDuplicatesWithinWatermark(["event_fingerprint"])


def daily_counters(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """The additive columns of the daily summary over a stream of fact events."""
    day = F.window("event_ts", "1 day")
    out = events.withWatermark("event_ts", lateness).groupBy(day.alias("w")).agg(
        F.count(F.lit(1)).alias("total_events"),
        *[F.count_if(F.col(f"is_{t}")).alias(f"total_{t}") for t in clean.EVENT_TYPES],
        F.sum(F.when(F.col("is_purchase"), F.col("price"))).alias("total_revenue"),
    )
    return out.select(F.to_date("w.start").alias("event_date"), "total_events", *[f"total_{t}" for t in clean.EVENT_TYPES], "total_revenue")


_LIMIT_OUT = "key string, ts timestamp, window_start timestamp, hit long, allowed boolean, remaining long, retry_after long"


def first_hit_limit(hits: DataFrame, limit: int = 30, seconds: int = 60) -> DataFrame:
    """Exact rate limit on a stream (key, ts): a window starts at the first hit after the last one's
    end.  State is one window start and count per key."""

    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (0, 0)
        times = sorted(t for b in batches for t in b["ts"])
        rows = []
        for t in times:
            at = int(t.timestamp())
            if not n or at >= start + seconds:
                start, n = at, 0
            n += 1
            rows.append((key[0], t, pd.Timestamp(start, unit="s"), n, n <= limit, max(limit - n, 0), start + seconds - at))
        state.update((start, n))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _LIMIT_OUT.split(", ")])

    grouped = hits.select(F.col("key").cast("string"), "ts").groupBy("key")
    return grouped.applyInPandasWithState(run, _LIMIT_OUT, "start long, n long", "append", GroupStateTimeout.NoTimeout)
