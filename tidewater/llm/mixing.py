"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Documents of a source are numbered in the order of md5(doc_id) and cut into blocks of ``block``
documents (an odd number above one counts as the even one below), each scheduled as two halves (a block
of one document as one).  Time runs in slots of a
half block.  The target is the fluid schedule: every source that has documents left progresses in
proportion to its weight, and when one is used up the others go on at their weights among themselves.

Slots are planned in *periods* of at most ``quantum``, with an end where a source is used up.  At the end
of each, a source has the halves that are due in the fluid schedule by then, and of those begun there as
many as there are slots left, those due first; so every source is less than one half from its target at
the end of every period, however many there are, and a source may have no half in one.  Within a period
of Q slots a source with quota p of them has its j-th half (from 0) released at floor(j Q / p) and due at
ceil((j + 1) Q / p); earliest deadline first among the released halves keeps every source less than one
half from p / Q of the slots passed.  The two together are less than two halves: **every source is less
than one block from its target at every slot**.

Nothing is dropped or repeated.  Consecutive periods of equal quotas are one row per source in the plan,
which has at most a row per half block; it is joined by half, and broadcast up to ``BROADCAST_BYTES``.

Numbering is by shards of the md5 order: counts per (source, shard), their running sums, and row
numbers within a shard, so a source with a third of all rows is numbered by many tasks.

A null source is a source of its own (and keeps its null), an empty one too.  A null doc_id sorts as
md5 of nothing.  Rows with one doc_id are ordered by all their columns' hash; equal rows are
interchangeable.  Input columns named as the added ones are replaced.  An empty table stays empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.shared import row_of

BLOCK = 32
QUANTUM = 1000
SHARD_ROWS = 8192
BROADCAST_BYTES = 32 << 20
ADDED = ("mix_block", "mix_half", "mix_slot", "mix_release", "mix_deadline", "mix_position")


def _source_key(source: str) -> Column:
    return F.when(F.col(source).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(source).cast("string")))


def _used_up(blocks: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slots after which sources are used up in the fluid schedule, ascending; the blocks of all that
    are used up before, and the weight of the others."""
    order = np.argsort(blocks / weights, kind="stable")
    n, w = blocks[order], weights[order]
    before, rest = np.cumsum(n) - n, np.cumsum(w[::-1])[::-1]
    return before + n / w * rest, before, rest


def fluid(blocks: np.ndarray, weights: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """(slots, sources): the blocks of each source after so many slots of the fluid schedule."""
    at, before, rest = _used_up(blocks, weights)
    i = np.minimum(np.searchsorted(at, slots), len(at) - 1)
    time = (slots - before[i]) / rest[i]  # by which a source has weight * time blocks
    return np.minimum(blocks[None, :], time[:, None] * weights[None, :])


def plan_periods(blocks: dict[str, int], weights: dict[str, float], quantum: int = QUANTUM) -> list[dict]:
    """The periods in order; each row gives one source's quota in one kind of period: ``phase,
    first_slot, period, repeats, src, quota, first_block``."""
    names = sorted(s for s, n in blocks.items() if n > 0)
    n, w = np.array([blocks[s] for s in names], np.int64), np.array([weights[s] for s in names], np.float64)
    total, done, kinds = int(n.sum()), np.zeros(len(names), np.int64), []
    breaks = _used_up(n, w)[0] if total else np.zeros(0)
    ends = np.unique(np.concatenate([np.arange(quantum, total, quantum), np.floor(breaks + 1e-6), np.ceil(breaks - 1e-6), [total]]).astype(np.int64))
    ends = ends[(ends > 0) & (ends <= total)].tolist()
    for slot, end in zip([0, *ends], ends):  # within a period the target grows evenly
        target = n.astype(np.float64) if end == total else fluid(n, w, np.array([end]))[0]
        near = 1e-9 * np.maximum(target, 1.0)  # rounding is no part of a block
        have = np.maximum(done, np.floor(target + near).astype(np.int64))
        begun = np.flatnonzero(np.ceil(target - near) > have)
        due = begun[np.argsort((have[begun] + 1) / w[begun], kind="stable")]
        have[due[: end - int(have.sum())]] += 1
        if int(have.sum()) != end:
            raise ArithmeticError("quotas do not fill the period")
        quota, first = have - done, done
        if kinds and kinds[-1][1] == end - slot and np.array_equal(kinds[-1][3], quota):
            kinds[-1][2] += 1
        else:
            kinds.append([slot, end - slot, 1, quota, first])
        done = have
    rows = []
    for phase, (slot, period, repeats, quota, first) in enumerate(kinds):
        for i in np.flatnonzero(quota).tolist():
            rows.append({"phase": phase, "first_slot": slot, "period": period, "repeats": repeats, "src": names[i], "quota": int(quota[i]), "first_block": int(first[i])})
    return rows


def deadline_order(plan: DataFrame, parts: int) -> DataFrame:
    """Adds ``slots``: the slot within the period of each of the source's quota of halves, by earliest
    deadline first over one period.

    Units of one slot that start at once when released: the schedule follows from taking them by
    deadline, each into the first free slot from its release on, as no later one can delay it.
    """
    row = F.struct("src", "quota", "first_slot", "repeats", "first_block")
    each = plan.repartition(parts, "phase").groupBy("phase", "period").agg(F.sort_array(F.collect_list(row)).alias("s"))

    def units(x: Column, i: Column) -> Column:
        due = lambda d: F.ceil((d + 1) * F.col("period") / x["quota"])
        released = lambda d: F.floor(d * F.col("period") / x["quota"])
        return F.transform(F.sequence(F.lit(0), x["quota"] - 1), lambda d: F.struct(due(d).alias("due"), i.alias("i"), released(d).alias("at")))

    def place(state: Column, unit: Column) -> Column:
        slot = F.position(F.lit("0"), state["free"], (unit["at"] + 1).cast("int"))
        return F.struct(F.overlay(state["free"], F.lit("1"), slot, F.lit(1)).alias("free"), F.concat(state["slots"], F.array(slot - 1)).alias("slots"))

    each = each.withColumn("units", F.sort_array(F.flatten(F.transform("s", units))))
    start = F.struct(F.repeat(F.lit("0"), F.col("period").cast("int")).alias("free"), F.array().cast("array<int>").alias("slots"))
    each = each.withColumn("taken", F.arrays_zip(F.col("units.i").alias("i"), F.aggregate("units", start, place, lambda x: x["slots"]).alias("t")))
    each = each.select("phase", "period", "taken", F.posexplode("s").alias("i", "x"))
    slots = F.transform(F.filter("taken", lambda u: u["i"] == F.col("i")), lambda u: u["t"])
    return each.select("phase", "period", "x.*", slots.alias("slots"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, block: int = BLOCK, quantum: int = QUANTUM, source: str = "source", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the block's number within its source, which half of it the row is in, that half's
    slot, release and deadline, and the row's position; ascending positions are the mixture.

    ``weights``: by source (a null source is the key None); a source without one gets the least.
    Without weights, a source's weight is its number of rows to the power ``alpha``.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ADDED]
    keyed = docs.select(row_of(names), F.col(id_col).alias("__id"), _source_key(source).alias("__src"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("__h"))
    totals = {r["__src"]: r["count"] for r in keyed.groupBy("__src").count().collect()}  # one row per source
    if weights is not None:
        named = {("-" if s is None else f"+{s}"): float(w) for s, w in weights.items() if w > 0}
        least = min(named.values(), default=1.0)
        target = {s: named.get(s, least) for s in totals}
    else:
        target = {s: float(n) ** alpha for s, n in totals.items()}
    half, per_block = max(1, block // 2), min(2, block)
    plan_rows = plan_periods({s: -(-n // half) for s, n in totals.items()}, target, quantum)
    schema = "phase long, first_slot long, period long, repeats long, src string, quota long, first_block long"
    phases = plan_rows[-1]["phase"] + 1 if plan_rows else 1
    plan = deadline_order(spark.createDataFrame(plan_rows, schema), parts=-(-phases // 8))

    digits = 1
    while max(totals.values(), default=0) > SHARD_ROWS * 16**digits:
        digits += 1
    keyed = keyed.withColumn("__shard", F.substring("__h", 1, digits))
    sizes = keyed.groupBy("__src", "__shard").count()
    before = Window.partitionBy("__src").orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("__src", "__shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__src", "__shard").orderBy("__h", "__id", F.xxhash64("row"))
    numbered = keyed.withColumn("__n", F.row_number().over(within)).join(bases, ["__src", "__shard"])
    numbered = numbered.withColumn("__n", F.col("__base") + F.col("__n") - 1).withColumn("__half", F.floor(F.col("__n") / half))

    plan = plan.select(*[F.col(c).alias(f"__p_{c}") for c in plan.columns if c != "phase"])
    last = F.col("__p_first_block") + F.col("__p_quota") * F.col("__p_repeats")
    each = plan.withColumn("__p_k", F.explode(F.sequence(F.col("__p_first_block"), last - 1)))
    within = (F.col("__p_k") - F.col("__p_first_block")) % F.col("__p_quota")
    each = each.withColumn("__p_at", F.get("__p_slots", within.cast("int"))).drop("__p_slots", "__p_repeats")
    if sum(r["quota"] * r["repeats"] for r in plan_rows) * 64 <= BROADCAST_BYTES:
        each = F.broadcast(each)
    joined = numbered.join(each, (F.col("__src") == F.col("__p_src")) & (F.col("__half") == F.col("__p_k")))
    j = F.col("__half") - F.col("__p_first_block")
    at = F.col("__p_at")
    slot = F.col("__p_first_slot") + F.floor(j / F.col("__p_quota")) * F.col("__p_period") + at
    return joined.select(
        "row.*",
        F.floor(F.col("__half") / per_block).cast("long").alias("mix_block"),
        (F.col("__half") % per_block).cast("int").alias("mix_half"),
        slot.cast("long").alias("mix_slot"),
        (F.col("__p_first_slot") + F.floor(j * F.col("__p_period") / F.col("__p_quota"))).cast("long").alias("mix_release"),
        (F.col("__p_first_slot") + F.ceil((j + 1) * F.col("__p_period") / F.col("__p_quota"))).cast("long").alias("mix_deadline"),
        (slot * half + F.col("__n") % half).cast("long").alias("mix_position"),
    )
