"""Upserts of several streams, and summaries refreshed by day."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidewater import schemas
from tidewater.operators import clean, star, summaries
from tidewater.operators.refresh import DailyTables
from tidewater.plans import queries as plans
from tidewater.sources import fixtures as fx
from tidewater.sources import tables
from tidewater.streaming import ingest, upsert


def at():
    return F.lit("2024-02-03 00:00:00").cast("timestamp")


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bronze"))
    schemas.conform(fx.raw_events(spark, DATA), schemas.BRONZE).write.parquet(f"{path}/all")
    return spark.read.schema(schemas.BRONZE).parquet(f"{path}/all")


def prints(spark, path):
    return [r[0] for r in spark.read.parquet(path).select("event_fingerprint").collect()]


def test_two_streams_into_one_silver(spark, raw, tmp_path):
    """Both count their batches from 0; what they share is there once, nothing is lost, replays add nothing."""
    silver, bad = f"{tmp_path}/silver", f"{tmp_path}/bad"
    want = {r[0] for r in clean.silver(raw).where("is_valid").select("event_fingerprint").distinct().collect()}
    parts = {"one": raw.where("kafka_partition < 2"), "two": raw.where("kafka_partition > 0")}
    for name, rows in parts.items():
        rows.write.parquet(f"{tmp_path}/{name}")
    for _ in range(2):
        for name in parts:
            upsert.silver_stream(ingest.raw_stream(spark, f"{tmp_path}/{name}"), silver, bad, f"{tmp_path}/check-{name}", name).awaitTermination()
    found = prints(spark, silver)
    assert len(found) == len(set(found)) and set(found) == want
    ids = [r[0] for r in spark.read.parquet(bad).select("source_event_id").collect()]
    assert len(ids) == len(set(ids)) == clean.silver(raw).where("NOT is_valid").select("source_event_id").distinct().count()
    done = {(r["stream"], r["batch_id"]): r["written"] for r in upsert.commits(spark, silver).collect()}
    assert set(done) == {("one", 0), ("two", 0)} and sum(done.values()) == len(want)
    assert upsert.upsert(raw, "one", 0, silver, bad).repeated
    again = upsert.upsert(raw, "one", 1, silver, bad)
    assert (again.written, again.quarantined, again.days, again.repeated) == (0, 0, [], False)


def test_only_the_days_of_a_batch_are_read(spark, raw, tmp_path):
    silver = f"{tmp_path}/silver"
    upsert.upsert(raw, "s", 0, silver, f"{tmp_path}/bad")
    days = [r[0] for r in spark.read.parquet(silver).select("event_date").distinct().orderBy("event_date").limit(2).collect()]
    known = upsert.known_in_days(spark, silver, days)
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [event_date" in plan and "ReadSchema: struct<event_fingerprint:string>" in plan
    touched = {f.split("event_date=")[1].split("/")[0] for (f,) in spark.read.parquet(silver).where(F.col("event_date").isin(days)).select("_metadata.file_path").distinct().collect()}
    assert touched == {str(d) for d in days}
    assert upsert.known_in_days(spark, silver, []).count() == 0 and upsert.known_in_days(spark, f"{tmp_path}/none", days) is None
    assert tables.in_days(spark.read.parquet(silver), days, most=1).count() == tables.in_days(spark.read.parquet(silver), days).count()


@pytest.mark.parametrize("fails", ["event_date", "processing_date", "commit"])
def test_a_broken_batch_is_repeated(spark, raw, tmp_path, monkeypatch, fails):
    """A batch that breaks off at any of its writes comes to the same tables when it is repeated."""
    silver, bad = f"{tmp_path}/silver", f"{tmp_path}/bad"
    rows = raw.where("kafka_partition = 1")
    upsert.upsert(raw.where("kafka_partition = 0"), "s", 0, silver, bad)
    write = tables.write_partitioned

    def breaks(df, path, by, mode="append"):
        if by == fails:
            raise OSError("lost")
        write(df, path, by, mode)
        if fails == "commit" and by == "event_date":
            raise OSError("lost")

    monkeypatch.setattr(tables, "write_partitioned", breaks)
    with pytest.raises(OSError):
        upsert.upsert(rows, "s", 1, silver, bad)
    monkeypatch.undo()
    upsert.upsert(rows, "s", 1, silver, bad)
    want = clean.silver(raw.where("kafka_partition < 2"))
    assert sorted(prints(spark, silver)) == sorted(r[0] for r in want.where("is_valid").select("event_fingerprint").distinct().collect())
    assert spark.read.parquet(bad).count() == want.where("NOT is_valid").select("source_event_id").distinct().count()


def times(spark, root):
    return {f: (n, t) for f, n, t in tables.listing(spark, root) if "daily_" in f and f.endswith(".parquet")}


def rebuilt(spark, silver):
    stg = star.staging(spark.read.schema(schemas.SILVER).parquet(silver), at())
    return summaries.build("all", star.fact_events(stg, at()), star.dim_product(stg, at()), at())


def same(spark, daily, silver):
    for which, want in rebuilt(spark, silver).items():
        got = daily.read(which)
        assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())), which


def test_a_late_batch_rewrites_its_days_only(spark, raw, tmp_path):
    silver, bad, root = f"{tmp_path}/silver", f"{tmp_path}/bad", f"{tmp_path}/gold"
    daily = DailyTables(spark, silver, root)
    # late events of a product that have no earlier ones elsewhere: products already known keep their attributes
    late = (F.dayofmonth("kafka_ts") == 30) & (F.col("kafka_offset") % 2 == 0)
    first = upsert.upsert(raw.where(~late), "s", 0, silver, bad, at())
    assert daily.refresh(first.days, at()) == first.days
    same(spark, daily, silver)
    before = times(spark, root)
    second = upsert.upsert(raw.where(late), "s", 1, silver, bad, at())
    done = daily.refresh(second.days, at())
    assert len(second.days) == 1 and set(second.days) <= set(done) and len(done) < len(first.days) // 2
    same(spark, daily, silver)
    after = times(spark, root)
    day = lambda f: f.split("event_date=")[1].split("/")[0]
    assert {day(f) for f in before if after.get(f) != before[f]} == {str(d) for d in done}
    assert daily.refresh([], at()) == [] and daily.version() == 1
    assert daily.refresh(second.days, at()) == second.days
    same(spark, daily, silver)


def event(i, day, product, brand, hour=10):
    return (f"2024-01-{day:02d} {hour:02d}:00:00 UTC", "purchase", str(product), "7", "a.b.c", brand, "5.00", "1", f"s{i}", None, 0, i, None, None)


def test_late_events_that_change_a_product(spark, tmp_path):
    """An earlier event with another brand: all days of that product are rebuilt, those of others are not."""
    silver, root = f"{tmp_path}/silver", f"{tmp_path}/gold"
    daily = DailyTables(spark, silver, root)
    make = lambda *rows: spark.createDataFrame(list(rows), schemas.BRONZE)
    upsert.upsert(make(event(1, 5, 1, "old"), event(2, 8, 1, "old"), event(3, 9, 2, "other"), event(4, 7, 1, "")), "s", 0, silver, f"{tmp_path}/bad", at())
    daily.refresh(as_of=at())
    before = times(spark, root)
    late = upsert.upsert(make(event(5, 2, 1, "new"), event(6, 6, 3, "third")), "s", 1, silver, f"{tmp_path}/bad", at())
    assert [d.day for d in late.days] == [2, 6]
    # a refresh that broke off before its log is repeated from the state before
    daily.spark.createDataFrame([(1, "x")], "a int, b string").write.parquet(f"{root}/product_state/1")
    assert [d.day for d in daily.refresh(late.days, at())] == [2, 5, 6, 7, 8]
    same(spark, daily, silver)
    assert {r["brand"] for r in daily.read("brand").where("day(event_date) in (5, 8)").collect()} == {"new"}
    after = times(spark, root)
    assert all(after[f] == before[f] for f in before if "event_date=2024-01-09" in f)
    asked, done = daily.log().where("version = 1").select("asked", "refreshed").first()
    assert [d.day for d in asked] == [2, 6] and len(done) == 5


def test_layers_follow_rewritten_tables(spark, tmp_path):
    """Queries of one session see tables that were rewritten between them."""
    for t in ("events", "part"):
        spark.read.parquet(f"{DATA}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    count = lambda: plans.queries()["daily_event_summary"](spark, str(tmp_path)).agg(F.sum("total_events")).first()[0]
    whole = count()
    assert whole == count()
    spark.read.parquet(f"{DATA}/events.parquet").where("event_id % 2 = 0").write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
    assert 0 < count() < whole
    plans.forget_layers(spark)
    assert 0 < count() < whole
