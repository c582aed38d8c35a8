"""Analytics over query, pipeline and conversation logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import columns as fn
from tidewater.operators.order import numbered

#: Upper bounds of the latency buckets, seconds.
BUCKETS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 20.0, 30.0, 60.0)
SLOW_MS = 5000


def search_runs(log: DataFrame, status: list[str] | None = None, text: str | None = None, start: Column | None = None, end: Column | None = None, favourites: DataFrame | None = None) -> DataFrame:
    """Runs by optional status, question text, time range and favourites."""
    if status:
        log = log.where(F.col("status").isin(*status))
    if text:
        log = log.where(F.col("question").ilike(f"%{text}%"))
    if start is not None:
        log = log.where(F.col("created_at") >= start)
    if end is not None:
        log = log.where(F.col("created_at") <= end)
    return log if favourites is None else flag_favourites(log, favourites).where("is_favourite")


def flag_favourites(log: DataFrame, favourites: DataFrame) -> DataFrame:
    marks = favourites.select("user_id", "run_id").distinct().withColumn("__f", F.lit(True))
    return log.join(marks, ["user_id", "run_id"], "left").withColumn("is_favourite", F.col("__f").isNotNull()).drop("__f")


def session_rollup(log: DataFrame, *last: str) -> DataFrame:
    """Runs per session and columns of its last run."""
    return log.groupBy("session_id").agg(F.count(F.lit(1)).alias("run_count"), F.max_by(F.struct(*last), F.struct("created_at", "run_id")).alias("l")).select("session_id", "run_count", *[F.col(f"l.{c}").alias(f"last_{c}") for c in last])


def turn_index(log: DataFrame, session: str = "session_id", *order: str) -> DataFrame:
    """Each turn's number in its session; a session of any size is numbered by many tasks."""
    return numbered(log, [session], [F.col(c) for c in order], "turn_index")


def last_turns(turns: DataFrame, session: str, order: str, k: int = 4, text: Column | None = None) -> DataFrame:
    """Per session: its last k turns in order, one line each, and their number."""
    w = Window.partitionBy(session).orderBy(F.col(order).desc())
    kept = turns.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), (text if text is not None else F.col("text")).alias("t"))))
    out = kept.groupBy(session).agg(rows.alias("x"))
    return out.select(session, F.size("x").cast("bigint").alias("n_turns"), F.concat_ws("\n", F.col("x.t")).alias("context"), F.element_at("x.t", -1).alias("last_text"))


def session_context(turns: DataFrame, session: str, order: str, k: int = 4, summarised: int = 3, sample: int = 3) -> DataFrame:
    """What the last ``k`` turns (question, sql, columns, rows) leave as context: a summary of the last
    few in order, and the latest turn's question, statement, columns and first rows."""
    w = Window.partitionBy(session).orderBy(F.col(order).desc())
    kept = turns.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    held = kept.groupBy(session).agg(F.array_sort(F.collect_list(F.struct(order, "question", "sql", "columns", "rows"))).alias("x"))

    def line(turn: Column) -> Column:
        asked, sql, names = F.trim(turn["question"]), F.trim(turn["sql"]), F.array_join(turn["columns"], ", ")
        said = F.array(F.when(asked != "", F.concat(F.lit("User asked: "), asked)), F.when(names != "", F.concat(F.lit("Returned columns: "), names)), F.when(sql != "", F.concat(F.lit("Executed SQL: "), sql)))
        return F.array_join(F.array_compact(said), "\n")

    last = F.element_at("x", -1)
    late = F.slice("x", F.greatest(F.size("x") - summarised + 1, F.lit(1)), F.lit(summarised))
    text = F.array_join(F.filter(F.transform(late, line), lambda s: s != ""), "\n")
    return held.select(session, text.alias("conversation_summary"), last["question"].alias("last_question"), last["sql"].alias("last_sql"), last["columns"].alias("last_result_columns"), F.slice(last["rows"], 1, sample).alias("last_result_sample"))


def pipeline_state(runs: DataFrame, now: Column) -> DataFrame:
    """Per pipeline: last run's state (1, 0, -1) and duration, last success, seconds since then."""
    state = F.when(F.col("l.state") == "success", 1).when(F.col("l.state") == "failed", 0).otherwise(-1)
    out = runs.groupBy("dag_id").agg(F.max_by(F.struct("state", "start_ts", "end_ts"), F.struct("start_ts", "run_id")).alias("l"), F.max(F.when(F.col("state") == "success", F.col("end_ts"))).alias("last_success"), F.count(F.lit(1)).alias("runs"))
    return out.select("dag_id", "runs", state.cast("int").alias("last_state"), fn.run_seconds(F.col("l.start_ts"), F.col("l.end_ts")).alias("last_duration_sec"), "last_success", fn.run_seconds(F.col("last_success"), now).alias("stale_sec"))


def run_counters(log: DataFrame, *keys: Column | str) -> DataFrame:
    """Requests, success and error shares, retries."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    ok, bad = F.count_if(F.col("status") == "success"), F.count_if(F.col("status") == "failed")
    return log.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"), (100.0 * ok / n).alias("success_pct"), (100.0 * bad / n).alias("error_pct"), F.sum("retry_count").alias("retries"))


def errors_by_class(log: DataFrame) -> DataFrame:
    failed = log.where(F.col("status") == "failed")
    return failed.groupBy(fn.error_class(F.col("error")).alias("error_class")).agg(F.count(F.lit(1)).alias("n"))


def status_counts(log: DataFrame, slow_ms: int = SLOW_MS) -> DataFrame:
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("status") == "success") & (F.col("latency_ms") > slow_ms)).alias("slow"))


def latency_histogram(log: DataFrame, *keys: str, bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Cumulative counts per upper bound ``le`` (the last is infinity), from one pass."""
    s = F.col("latency_ms") / 1000.0
    tops = [*bounds, float("inf")]
    wide = log.groupBy(*keys).agg(*[F.count_if(s <= le).alias(f"b{i}") for i, le in enumerate(tops)])
    return wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(le).alias("le"), F.col(f"b{i}").alias("n")) for i, le in enumerate(tops)])).alias("x")).select(*keys, "x.*")


def counts_quantile(counts: Column, q: float, bounds: tuple[float, ...] = BUCKETS) -> Column:
    """The quantile of an array of cumulative counts per upper bound, the last of infinity: linear interpolation inside the
    bucket of the rank; NaN if empty; above the last finite bound that bound."""
    tops = F.array(*[F.lit(float(x)) for x in (*bounds, float("inf"))])
    total = F.element_at(counts, -1)
    rank = total * q
    i = F.array_position(F.transform(counts, lambda n: n >= rank), True).cast("int")  # from 1
    low = F.when(i > 1, F.get(tops, i - 2)).otherwise(F.lit(0.0))
    before = F.when(i > 1, F.get(counts, i - 2)).otherwise(F.lit(0))
    top, n = F.get(tops, i - 1), F.get(counts, i - 1)
    inside = low + (top - low) * F.try_divide(rank - before, n - before)
    return F.when(total == 0, F.lit(float("nan"))).when(i == len(bounds) + 1, F.lit(float(bounds[-1]))).otherwise(inside)


def bucket_counts(seconds: Column, bounds: tuple[float, ...] = BUCKETS) -> list[Column]:
    """The cumulative counts of a histogram, as aggregates; histograms add up by position."""
    return [F.count_if(seconds <= le) for le in (*bounds, float("inf"))]


def bucket_quantile(histogram: DataFrame, q: float, *keys: str, bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """The quantile of rows (``le``, ``n``) of a histogram per key."""
    h = histogram.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("le", "n"))), lambda b: b["n"]).alias("h"))
    return h.select(*keys, counts_quantile(F.col("h"), q, bounds).alias("quantile"))


def exact_quantiles(log: DataFrame, *qs: float) -> DataFrame:
    """Exact quantiles of the whole log.  A count for every distinct latency meets in one task: for tables of moderate
    size; ``latency_histogram`` with ``bucket_quantile`` keeps a dozen counters instead."""
    return log.agg(*[F.percentile(F.col("latency_ms") / 1000.0, q).alias(f"p{round(q * 100)}") for q in qs])


def alerts(counters: DataFrame, p95: Column, stale: Column) -> DataFrame:
    """Threshold flags: error share above 20 %, p95 above 20 s, no success for a day."""
    return counters.select("*", (F.col("error_pct") > 20).alias("high_error"), (p95 > 20).alias("slow_p95"), (stale > 86400).alias("stale"))


def fixed_window_limit(hits: DataFrame, key: str, ts: str, limit: int = 30, seconds: int = 60, *ties: str) -> DataFrame:
    """Each hit in its aligned window: allowed, remaining, seconds until the window ends."""
    start = F.floor(F.unix_timestamp(ts) / seconds) * seconds
    out = numbered(hits.withColumn("window_start", start.cast("bigint")), [key, "window_start"], [F.col(c) for c in (ts, *ties)], "hit")
    return out.select("*", (F.col("hit") <= limit).alias("allowed"), F.greatest(limit - F.col("hit"), F.lit(0)).cast("bigint").alias("remaining"), (F.col("window_start") + seconds - F.unix_timestamp(ts)).cast("bigint").alias("retry_after"))


def sliding_latency(log: DataFrame, q: float = 0.95, size: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """The bucket quantile of the latency over sliding windows."""
    cut = log.select(F.window("created_at", size, slide)["start"].alias("window_start"), "latency_ms")
    return bucket_quantile(latency_histogram(cut, "window_start"), q, "window_start")


def sliding_error_rate(log: DataFrame, size: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Requests, rate per second and error share over sliding windows; also for streams."""
    bad = F.count_if(F.col("status") == "failed")
    out = log.groupBy(F.window("created_at", size, slide).alias("w")).agg(F.count(F.lit(1)).alias("requests"), bad.alias("errors"))
    return out.select(F.col("w.start").alias("window_start"), "requests", "errors", fn.safe_rate(F.col("errors"), F.col("requests")).alias("error_ratio"))
