"""Rate windows, held alerts, counters that reset, sliding quantiles of streams, numbering of hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import alerts, logs, order, ratelimit
from tidewater.streaming import rates


def hits_of(spark, rows):
    return spark.createDataFrame(rows, "id long, key string, t double").select("id", "key", F.timestamp_seconds("t").alias("ts"))


def brute_windows(rows, limit, length):
    out, state = {}, {}
    for i, k, t in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (r[1], r[2], r[0])):
        s = int(t // 1)
        start, n = state.get(k, (None, 0))
        if start is None or s >= start + length:
            start, n = s, 0
        state[k] = (start, n + 1)
        out[i] = (start, n + 1, limit <= 0 or n + 1 <= limit, -1 if limit <= 0 else max(0, limit - n - 1), start + length - s)
    return out


@pytest.mark.parametrize(("limit", "length"), [(3, 60), (1, 7), (0, 60), (30, 86400)])
def test_first_hit_windows_equal_brute_force(spark, limit, length):
    """A hot key without pauses, keys with many hits a second, pauses of exactly the length, nulls."""
    rng = random.Random(length)
    rows, i = [], 0
    for key, n, gap in (("hot", 1500, 3), ("burst", 200, 0.2), ("even", 40, length), ("near", 40, length - 1), ("rare", 20, 5 * length)):
        t = 1_000_000.0
        for _ in range(n):
            t += gap if key in ("even", "near") else rng.random() * 2 * gap
            rows.append((i, key, t))
            i += 1
    rows += [(i, None, 5.0), (i + 1, "hot", None), (i + 2, "once", 7.0)]
    df = ratelimit.first_hit_windows(hits_of(spark, rows).repartition(6), "key", "ts", limit, length, "id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    got = {r["id"]: (r["window_start"], r["hit"], r["allowed"], r["remaining"], r["retry_after"]) for r in df.collect()}
    want = brute_windows(rows, limit, length)
    assert {k: got[k] for k in want} == want and len(got) == len(rows)
    assert got[i] == got[i + 1] == (None, None, True, None, None)


def test_pointers_and_rounds(spark):
    jumps = ratelimit.pointers(spark.createDataFrame([("a", t) for t in (0, 5, 9, 10, 30, 41, 42)], "k string, t long"), 10)
    assert {r["t"]: (r["prev"], r["next"]) for r in jumps.collect()} == {0: (None, 10), 5: (0, 30), 9: (5, 30), 10: (9, 30), 30: (10, 41), 41: (30, None), 42: (41, None)}
    assert sorted(r["t"] for r in ratelimit.window_starts(jumps, 10).collect()) == [0, 10, 30, 41]
    empty = hits_of(spark, [(1, "a", 1.0)]).where("false")
    assert ratelimit.first_hit_windows(empty, "key", "ts").collect() == []


def test_numbering_of_a_hot_key(spark):
    """Numbers run on over the ranges of a key; its rows are sorted by several tasks."""
    df = spark.range(4000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, "x").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("key"), (F.col("id") * 7919 % 4001).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = order.numbered(df, ["key"], [F.col("v").desc()])
        rows = found.withColumn("p", F.col("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by = {}
    for r in rows:
        by.setdefault(r["key"], []).append((r["v"], r["n"]))
    assert len(rows) == 4000 and all([n for _, n in sorted(v, reverse=True)] == list(range(1, len(v) + 1)) for v in by.values())


def test_held_alerts(spark):
    """Missing and untrue evaluations end what is active; shorter stretches do not fire."""
    true = {"a": [0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 20, 21, 22, 23, 24, 25, 26], "b": [3, 4, 5, 6, 7], None: list(range(6))}
    rows = [(s, m * 60 + 7, True, float(m)) for s, v in true.items() for m in v] + [("a", 6 * 60, False, 99.0), ("a", 12 * 60, None, 99.0), ("b", 5 * 60, False, 50.0), ("a", None, True, 1.0)]
    df = spark.createDataFrame(rows, "s string, t long, bad boolean, v double").select("s", F.timestamp_seconds("t").alias("at"), "bad", "v")
    found = alerts.held(df, "at", F.col("bad"), 300, 60, "s", value=F.col("v"))
    got = {(r["s"], r["a"], r["f"], r["z"], r["evaluations"], r["worst"]) for r in found.select("s", *[F.unix_timestamp(c).alias(n) for c, n in (("active_at", "a"), ("firing_at", "f"), ("resolved_at", "z"))], "evaluations", "worst").collect()}
    assert got == {("a", 0, 300, 360, 6, 5.0), ("a", 1200, 1500, 1620, 7, 26.0), (None, 0, 300, 360, 6, 5.0)}
    # a hold that is no multiple of the step is met at the next evaluation
    assert {r["s"] for r in alerts.held(df, "at", F.col("bad"), 301, 60, "s").collect()} == {"a"}


def brute_increase(samples, window, step):
    out = {}
    for s in {x[0] for x in samples}:
        best = {}
        for _, t, v in (x for x in samples if x[0] == s and x[1] is not None and x[2] is not None):
            best[int(t)] = max(v, best.get(int(t), v))
        points = sorted(best.items())
        if not points:
            continue
        for end in range(points[0][0] // step * step, points[-1][0] + window + step, step):
            inside = [(t, v) for t, v in points if end - window < t <= end]
            if len(inside) < 2:
                continue
            known = sum(b if b < a else b - a for (_, a), (_, b) in zip(inside, inside[1:]))
            whole = inside[-1][0] - inside[0][0]
            mean = whole / (len(inside) - 1)
            left, right = inside[0][0] - (end - window), end - inside[-1][0]
            left = mean / 2 if left >= 1.1 * mean else left
            if known > 0:
                left = min(left, whole * inside[0][1] / known)
            right = mean / 2 if right >= 1.1 * mean else right
            out[s, end] = (len(inside), known * (whole + left + right) / whole)
    return out


def test_counters_with_resets_equal_brute_force(spark):
    rng = random.Random(4)
    samples = []
    for s in ("a", "b", None):
        v, t = 5.0, 10_000.0
        for _ in range(400):
            t += rng.choice([15, 15, 15, 16, 300, 4000] if s == "b" else [15, 15.5])
            v = rng.random() if rng.random() < 0.03 else v + rng.choice([0, 0, 1, 7])
            samples.append((s, t, v))
        samples.append((s, t, v - 1))
    samples += [("a", None, 1.0), ("a", 11_000.0, None), ("one", 500.0, 3.0)]
    df = spark.createDataFrame(samples, "s string, t double, v double").select("s", F.timestamp_seconds("t").alias("at"), "v").repartition(5)
    for window, step in ((300, 60), (60, 60), (100, 300)):
        got = {(r["s"], r["e"]): (r["samples"], r["increase"]) for r in alerts.counter_increase(df, "at", "v", window, step, "s").withColumn("e", F.unix_timestamp("end")).collect()}
        want = brute_increase(samples, window, step)
        assert set(got) == set(want)
        assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)


def test_sliding_quantiles_of_a_stream(spark, tmp_path):
    """Windows come out once, when the watermark has passed; late events change nothing; state stays small."""
    schema = "created_at timestamp, latency_ms long, status string"
    rng = random.Random(2)
    batches = [[(m * 60 + rng.randrange(60), rng.choice([30, 400, 7000, 90_000]), rng.choice(["success", "success", "failed"])) for m in range(b * 20, b * 20 + 20) for _ in range(8)] for b in range(6)]
    late = [(30, 1, "failed")] * 50
    q = None
    for b, rows in enumerate(batches):
        rows = rows + (late if b == 3 else [])
        spark.createDataFrame(rows, "t long, latency_ms long, status string").select(F.timestamp_seconds("t").alias("created_at"), "latency_ms", "status").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = rates.sliding_quantiles(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 0.5, 0.95, lateness="2 minutes")
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    state = [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
    assert state and max(state) <= 40  # panes of 20 new minutes, and windows that are still open
    got = {r["window_start"].timestamp(): r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    every = spark.createDataFrame([r for b in batches for r in b], "t long, latency_ms long, status string").select(F.timestamp_seconds("t").alias("created_at"), "latency_ms", "status")
    want = {r["window_start"].timestamp(): r for r in rates.sliding_quantiles(every, 0.5, 0.95).collect()}
    assert len(got) > 100 and all(got[k] == want[k] for k in got)
    # the same numbers from the plain histogram of each window
    plain = {r["window_start"].timestamp(): r["quantile"] for r in logs.sliding_latency(every).collect()}
    assert all(abs(plain[k] - want[k]["p95"]) < 1e-9 for k in want)
