"""Alerts that hold for a time, and rates of counters that reset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held(evaluations: DataFrame, at: str, condition: Column, hold: int, step: int, *series: str, value: Column | None = None) -> DataFrame:
    """The firings of a rule with ``for``: ``series, active_at, firing_at, resolved_at, evaluations, worst``.

    A rule is evaluated every ``step`` seconds for each series; an evaluation without a row, or whose condition is not
    true, ends what is active.  An alert is active from the first true evaluation and fires when it has been for
    ``hold`` seconds; it is resolved at the evaluation after its last true one.  What stays below ``hold`` is no
    firing.  Several rows of one evaluation count as true if any is.  ``worst`` is the largest ``value``.
    """
    tick = F.floor(F.unix_timestamp(at) / step)
    true = evaluations.where(F.coalesce(condition, F.lit(False)) & F.col(at).isNotNull())
    true = true.groupBy(*series, tick.alias("tick")).agg(F.max(value if value is not None else F.lit(None).cast("double")).alias("v"))
    # of neighbours without a gap, tick less row number is the same: an island
    island = F.col("tick") - F.row_number().over(Window.partitionBy(*series).orderBy("tick"))
    runs = true.withColumn("island", island).groupBy(*series, "island").agg(F.min("tick").alias("a"), F.max("tick").alias("z"), F.max("v").alias("worst"))
    need = -(-hold // step)
    when = lambda c: F.timestamp_seconds(c * step)
    fired = runs.where(F.col("z") - F.col("a") >= need)
    return fired.select(*series, when(F.col("a")).alias("active_at"), when(F.col("a") + need).alias("firing_at"), when(F.col("z") + 1).alias("resolved_at"), (F.col("z") - F.col("a") + 1).alias("evaluations"), "worst")


def counter_steps(samples: DataFrame, at: str, value: str, *series: str, block: int = 3600) -> DataFrame:
    """``series, t, v, inc``: each sample's growth over the one before it; a smaller value than before means that the
    counter began again at 0.  A series' first sample grows by nothing.  Times count in whole seconds; of
    several samples of a second the largest counts; null times and values are none.

    Samples are compared within blocks of time, and a block's first with the last of the block before, so that a series
    of any length is no single group.
    """
    rows = samples.where(F.col(at).isNotNull() & F.col(value).isNotNull()).groupBy(*series, F.unix_timestamp(at).alias("t")).agg(F.max(F.col(value).cast("double")).alias("v"))
    rows = rows.withColumn("b", F.floor(F.col("t") / block))
    ends = rows.groupBy(*series, "b").agg(F.max_by("v", "t").alias("end"))
    ends = ends.withColumn("carried", F.lag("end").over(Window.partitionBy(*series).orderBy("b"))).drop("end")
    before = F.coalesce(F.lag("v").over(Window.partitionBy(*series, "b").orderBy("t")), F.col("carried"))
    stepped = _null_safe(rows, ends, [*series, "b"])
    grown = F.when(before.isNull(), 0.0).when(F.col("v") < before, F.col("v")).otherwise(F.col("v") - before)
    return stepped.withColumn("inc", grown).select(*series, "t", "v", "inc")


def _null_safe(rows: DataFrame, ends: DataFrame, keys: list[str]) -> DataFrame:
    other = ends.select(*[F.col(k).alias(f"__{k}") for k in keys], "carried")
    on = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = c if on is None else on & c
    return rows.join(other, on).drop(*[f"__{k}" for k in keys])


def counter_increase(samples: DataFrame, at: str, value: str, window: int, step: int, *series: str) -> DataFrame:
    """``series, end, samples, increase, rate``: growth of counters over windows of ``window`` seconds that end at every
    multiple of ``step``; a window holds the samples after its start and up to its end and needs two.

    What lies between the first and last sample is known; it is carried on to the window's ends, by the whole distance where
    that is less than 1.1 times the mean distance of samples, else by half that mean, and towards the start
    not beyond where the counter would have been 0.
    """
    steps = counter_steps(samples, at, value, *series)
    first_end = F.ceil(F.col("t") / step) * step
    ends = F.sequence(first_end, F.floor((F.col("t") + window - 1) / step) * step, F.lit(step).cast("long"))
    cut = steps.where(F.floor((F.col("t") + window - 1) / step) * step >= first_end).withColumn("end", F.explode(ends))
    held_ = cut.groupBy(*series, "end").agg(
        F.count(F.lit(1)).alias("samples"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.min_by("v", "t").alias("v0"),
        (F.sum("inc") - F.min_by("inc", "t")).alias("known"),
    ).where("samples > 1")
    whole = (F.col("t1") - F.col("t0")).cast("double")
    mean = whole / (F.col("samples") - 1)
    left, right = (F.col("t0") - (F.col("end") - window)).cast("double"), (F.col("end") - F.col("t1")).cast("double")
    left = F.when(left >= 1.1 * mean, mean / 2).otherwise(left)
    to_zero = whole * F.col("v0") / F.col("known")
    left = F.when((F.col("known") > 0) & (F.col("v0") >= 0) & (to_zero < left), to_zero).otherwise(left)
    right = F.when(right >= 1.1 * mean, mean / 2).otherwise(right)
    grown = F.col("known") * (whole + left + right) / whole
    return held_.select(*series, F.timestamp_seconds("end").alias("end"), "samples", grown.alias("increase"), (grown / window).alias("rate"))
