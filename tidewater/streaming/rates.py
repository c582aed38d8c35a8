"""Sliding rates and latency quantiles of a stream, with bounded state.

Events are first counted in panes as wide as the slide, as histograms of fixed buckets; a window adds the histograms of
its panes.  A pane's or window's state is one row of counters, and goes when the watermark has passed its end, so that
the state follows the lateness and not the stream.  Rows come out once, when their window is closed (append mode);
later events are dropped and counted by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import columns as fn
from tidewater.operators import logs


def sliding_windows(log: DataFrame, lateness: str = "10 minutes", size: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """``window_start, requests, errors, counts`` per window; works on tables too."""
    panes = log.withWatermark("created_at", lateness).groupBy(F.window("created_at", slide).alias("pane")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "failed").alias("bad"), *[c.alias(f"b{i}") for i, c in enumerate(logs.bucket_counts(F.col("latency_ms") / 1000.0))]
    )
    names = [c for c in panes.columns if c != "pane"]
    whole = panes.groupBy(F.window(F.window_time("pane"), size, slide).alias("w")).agg(*[F.sum(c).alias(c) for c in names])
    return whole.select(F.col("w.start").alias("window_start"), F.col("n").alias("requests"), F.col("bad").alias("errors"), F.array(*[c for c in names if c.startswith("b") and c != "bad"]).alias("counts"))


def sliding_quantiles(log: DataFrame, *qs: float, lateness: str = "10 minutes", size: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Requests, error share and latency quantiles (``p95`` of 0.95) of every window."""
    found = sliding_windows(log, lateness, size, slide)
    named = [logs.counts_quantile(F.col("counts"), q).alias(f"p{round(q * 100)}") for q in qs or (0.95,)]
    return found.select("window_start", "requests", "errors", fn.safe_rate(F.col("errors"), F.col("requests")).alias("error_ratio"), *named)
