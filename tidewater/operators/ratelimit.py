"""Rate limits whose windows start at a key's first hit after the last window's end, on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.order import numbered
from tidewater.sources.scratch import settled

_ALL_BEFORE = (Window.unboundedPreceding, -1)


def _seconds(hits: DataFrame, key: str, ts: str) -> DataFrame:
    """``k, t``: the distinct seconds of each key; many hits of one second are one row."""
    return hits.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("k"), F.unix_timestamp(ts).alias("t")).distinct()


def pointers(seconds_of: DataFrame, length: int) -> DataFrame:
    """``k, t, b, prev, next``: the hit before each, and the first that is ``length`` seconds later or more.

    Time is cut into blocks of ``length``: the next hit lies in the following block, or is the first of the block
    after.  So no window of a key spans more than two blocks; across blocks there is a row for each block.
    """
    rows = seconds_of.withColumn("b", F.floor(F.col("t") / length))
    line = Window.partitionBy("k").orderBy("b")
    blocks = rows.groupBy("k", "b").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    blocks = blocks.select("k", "b", F.lag("last").over(line).alias("last_before"), F.lead("b").over(line).alias("b1"), F.lead("first").over(line).alias("f1"), F.lead("first", 2).over(line).alias("f2"))
    # a hit looks for the first one at t + length or later in the following block
    asked = rows.select("k", (F.col("b") + 1).alias("b"), (F.col("t") + length).alias("at"), F.lit(None).cast("long").alias("hit"), F.col("t").alias("of"))
    held = rows.select("k", "b", F.col("t").alias("at"), F.col("t").alias("hit"), F.lit(None).cast("long").alias("of"))
    falling = Window.partitionBy("k", "b").orderBy(F.col("at").desc(), F.col("of").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = asked.unionByName(held).withColumn("next", F.min("hit").over(falling)).where("of IS NOT NULL").select("k", F.col("of").alias("t"), "next")
    before = F.coalesce(F.lag("t").over(Window.partitionBy("k", "b").orderBy("t")), F.col("last_before"))
    out = rows.join(blocks, ["k", "b"]).withColumn("prev", before).join(found, ["k", "t"])
    later = F.when(F.col("b1") == F.col("b") + 1, F.coalesce("next", "f2")).otherwise(F.col("f1"))
    return out.select("k", "t", "b", "prev", later.alias("next"))


def window_starts(jumps: DataFrame, length: int) -> DataFrame:
    """``k, t`` of the hits that start a window.

    A hit that comes ``length`` or more after the one before starts one for certain.  From these the others are
    reached along the pointers, which double in every round: a chain of n windows takes log2(n) rounds, and
    every key and stretch of time goes on at once.
    """
    reached = settled(jumps.where((F.col("prev").isNull()) | (F.col("t") - F.col("prev") >= length)).select("k", "t"), "starts")
    step = settled(jumps.where("next IS NOT NULL").select("k", "t", "next"), "jumps")
    while True:
        new = reached.join(step, ["k", "t"]).select("k", F.col("next").alias("t")).distinct().join(reached, ["k", "t"], "left_anti")
        new = settled(new, "starts")
        if new.isEmpty():
            return reached
        reached = reached.unionByName(new)
        twice = step.select("k", F.col("t").alias("next"), F.col("next").alias("far"))
        step = settled(step.join(twice, ["k", "next"]).select("k", "t", F.col("far").alias("next")), "jumps")


def first_hit_windows(hits: DataFrame, key: str, ts: str, limit: int = 30, seconds: int = 60, *ties: str) -> DataFrame:
    """Each hit with ``window_start`` (seconds), its number in the window, and whether it is allowed.

    A window opens at the first hit that no window covers and lasts ``seconds``; times count in whole
    seconds.  Hits are numbered by time and ``ties``.  A limit of 0 or less allows all (``remaining`` is -1).  Hits
    with a null key or time belong to no window: they are allowed, and their other new columns are null.
    """
    jumps = settled(pointers(_seconds(hits, key, ts), seconds), "pointers")
    starts = window_starts(jumps, seconds).withColumn("start", F.col("t"))
    marked = jumps.select("k", "t", "b").join(starts, ["k", "t"], "left")
    last = marked.groupBy("k", "b").agg(F.max("start").alias("s"))
    carried = last.select("k", "b", F.max("s").over(Window.partitionBy("k").orderBy("b").rowsBetween(*_ALL_BEFORE)).alias("carried"))
    within = F.max("start").over(Window.partitionBy("k", "b").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    of = marked.withColumn("within", within).join(carried, ["k", "b"]).select("k", "t", F.coalesce("within", "carried").alias("window_start"))
    at = hits.withColumn("__t", F.unix_timestamp(ts))
    joined = at.join(of, (at[key] == of["k"]) & (at["__t"] == of["t"]), "left").drop("k", "t")
    covered = numbered(joined.where("window_start IS NOT NULL"), [key, "window_start"], [F.col(c) for c in (ts, *ties)], "hit")
    n, open_to_all = F.col("hit"), F.lit(limit <= 0)
    left = F.when(open_to_all, F.lit(-1)).otherwise(F.greatest(limit - n, F.lit(0)))
    found = covered.select(*hits.columns, "window_start", "hit", (open_to_all | (n <= limit)).alias("allowed"), left.cast("bigint").alias("remaining"), (F.col("window_start") + seconds - F.col("__t")).cast("bigint").alias("retry_after"))
    none: Column = F.lit(None).cast("bigint")
    outside = joined.where("window_start IS NULL").select(*hits.columns, none.alias("window_start"), none.alias("hit"), F.lit(True).alias("allowed"), none.alias("remaining"), none.alias("retry_after"))
    return found.unionByName(outside)
