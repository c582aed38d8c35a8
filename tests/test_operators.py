import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidewater import schemas
from tidewater.operators import catalog, logs, matching, profile, quality, serving
from tidewater.plans.queries import Gold
from tidewater.sources import tables


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, v string")
    found = {r["check_name"]: r["n_violations"] for r in quality.key_contract(df, "k", "t").collect()}
    assert found == {"null_k": 1, "duplicate_k": 1}
    with pytest.raises(quality.ContractError, match="duplicate_k"):
        quality.enforce(quality.key_contract(df, "k", "t"))
    with pytest.raises(quality.ContractError, match="lacks"):
        quality.require_columns(df, ["x"], "t")
    kept, seen = quality.observed(spark.createDataFrame([(True,), (False,), (True,)], "is_valid boolean"))
    kept.collect()
    assert seen.get == {"valid": 2, "invalid": 1}


def test_revenue_is_one_number(spark):
    g = Gold(spark, DATA)
    total = g.sales.agg(F.sum("gross_amount")).first()[0]
    for which, column in (("event", "total_revenue"), ("product", "revenue"), ("category", "revenue"), ("brand", "revenue")):
        assert g.daily(which).agg(F.sum(column)).first()[0] == total
    assert quality.reconcile(g.daily("event"), g.events, g.sales).count() == 0
    quality.enforce(quality.fact_contract(g.events, g.sales))


def test_fuzzy(spark):
    asked = spark.createDataFrame([("samsng",), ("app",), ("appl",), ("",), (None,), ("zzz",)], "candidate string")
    values = spark.createDataFrame([("samsung",), ("apple",), (None,)], "value string")
    found = {r["candidate"]: (r["value"], r["match_type"]) for r in matching.best_matches(asked, values).collect()}
    assert found == {"samsng": ("samsung", "fuzzy"), "appl": ("apple", "fuzzy")}
    plan = matching.near_pairs(asked, values)._jdf.queryExecution().toString()
    assert "Python" not in plan and "NestedLoop" not in plan


def test_quantiles(spark):
    log = spark.createDataFrame([("a", 700), ("a", 800), ("b", 100_000)], "status string, latency_ms long")
    h = logs.latency_histogram(log, "status")
    got = {r["status"]: r["quantile"] for r in logs.bucket_quantile(h, 0.5, "status").collect()}
    assert got == {"a": 0.75, "b": 60.0}
    empty = logs.latency_histogram(log.where("false"))
    assert math.isnan(logs.bucket_quantile(empty, 0.5).first()["quantile"])


def test_rate_window(spark):
    hits = spark.range(31).select(F.lit("u").alias("user"), F.timestamp_seconds(F.lit(600) + F.col("id")).alias("ts"), "id")
    out = logs.fixed_window_limit(hits, "user", "ts", 30, 60, "id").orderBy("hit").collect()
    assert [r["allowed"] for r in out] == [True] * 30 + [False] and out[-1]["retry_after"] == 30


def test_plans(spark, tmp_path):
    g = Gold(spark, DATA)
    g.daily("brand").write.partitionBy("event_date").parquet(f"{tmp_path}/brand")
    stored = spark.read.parquet(f"{tmp_path}/brand")
    cut = serving.between_dates(stored, start="2024-01-10", end="2024-01-12")
    assert "PartitionFilters: [isnotnull(event_date" in cut._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).replace("\n", " ")
    assert "TakeOrderedAndProject" in serving.top(serving.brands(stored), "revenue", 5, "brand")._jdf.queryExecution().toString()
    assert serving.between_dates(stored, start="x").count() == stored.count()
    assert [r["truncated"] for r in serving.truncated(stored, 3).collect()] == [True] * 3
    assert [r["truncated"] for r in serving.truncated(stored.limit(3), 3).collect()] == [False] * 3
    assert serving.with_default_limit(stored, 2).count() == 2 and serving.with_default_limit(stored, 0).count() == stored.count()


def test_overview_of_nothing(spark):
    g = Gold(spark, DATA)
    row = serving.overview(g.daily("event").where("false"), g.daily("brand").where("false")).first()
    assert all(v is None for v in row)


def test_profile_and_catalog(spark):
    g = Gold(spark, DATA)
    kinds = profile.kinds(g.stg)
    assert "event_year" in kinds["numeric"] and "event_year" in kinds["time"] and "brand" in kinds["categorical"]
    listed = catalog.column_catalog(spark)
    assert {r["display_name"] for r in listed.where("table_name = 'fact_events' AND column_name = 'price'").collect()} == {"Price"}
    hits = catalog.search(catalog.table_catalog(spark), listed, "brand").collect()
    assert [(r["table_name"], r["column_name"]) for r in hits] == sorted(((r["table_name"], r["column_name"]) for r in hits), key=lambda x: (x[0], x[1] or ""))
    assert ("daily_brand_summary", None) in {(r["table_name"], r["column_name"]) for r in hits} and ("dim_product", "brand") in {(r["table_name"], r["column_name"]) for r in hits}
    assert catalog.visible(catalog.table_catalog(spark)).where("table_name = 'stg_events'").count() == 0
    problems = catalog.definition_problems(spark, schemas.GOLD, listed.select("table_name", "column_name", "meaning"))
    assert problems.count() == 0
    columns = "table_name string, column_name string, meaning string"
    odd = spark.createDataFrame([("dim_x", "a", "m"), ("dim_x", "a", "m"), ("dim_x", "b", " "), ("dim_x", "z", "m")], columns)
    x = spark.createDataFrame([], "a int, b int, c int").schema
    found = {(r["problem"], r["column_name"]) for r in catalog.definition_problems(spark, {"dim_x": x}, odd).collect()}
    assert found == {("repeated", "a"), ("blank", "b"), ("unknown", "z"), ("undefined", "c")}


def test_json_or(spark):
    from tidewater.functions import columns as fn

    df = spark.createDataFrame([('{"a": 1}',), ("{broken",), (None,), ("[1]",), ("5",), ("{}",)], "j string")
    default = F.struct(F.lit(-1).alias("a"))
    assert [r[0]["a"] for r in df.select(fn.json_or(F.col("j"), "a int", default)).collect()] == [1, -1, -1, -1, -1, None]


def test_text_rules(spark):
    from tidewater.functions import columns as fn

    one = spark.createDataFrame([("Ștefan țară ůže ėjo Ģirts Ķēniņš",)], "t string")
    assert one.select(fn.fold_accents(F.col("t"))).first()[0] == "stefan tara uze ejo girts kenins"
    sql = spark.createDataFrame([("SELECT 1",), ("SELECT 1 LIMIT 5;",)], "t string")
    assert [r[0] for r in sql.select(fn.default_limit_sql(F.col("t"), 7)).collect()] == ["SELECT 1\nLIMIT 7", "SELECT 1 LIMIT 5"]
    errors = spark.createDataFrame([("", True), ("", False), ("boom", True), ("metadata", True)], "e string, u boolean")
    assert [r[0] for r in errors.select(fn.error_class(F.col("e"), unclear=F.col("u"))).collect()] == ["validation", "unknown", "validation", "metadata"]


def test_written_layers(spark, tmp_path):
    from tidewater.operators import clean

    g = Gold(spark, DATA)
    valid, bad = clean.split_valid(g.silver, F.lit("2024-02-03").cast("date"))
    for _ in range(2):
        tables.write_silver(valid, bad, f"{tmp_path}/silver", f"{tmp_path}/bad", "overwrite")
    assert spark.read.parquet(f"{tmp_path}/silver").count() == valid.count() and spark.read.parquet(f"{tmp_path}/bad").count() == bad.count()
    tables.write_partitioned(valid.limit(5), f"{tmp_path}/silver", "event_date", "odd")
    assert spark.read.parquet(f"{tmp_path}/silver").count() == valid.count() + 5
    spark.createDataFrame([(1,)], "a int").write.parquet(f"{tmp_path}/m/x=1")
    spark.createDataFrame([(1, 2)], "a int, b int").write.parquet(f"{tmp_path}/m/x=2")
    assert set(tables.read_or_none(spark, f"{tmp_path}/m", merge=True).columns) == {"a", "b", "x"}
    assert clean.known_rows(valid, valid.where("kafka_partition = 0")).select("event_fingerprint").distinct().count() == valid.where("kafka_partition = 0").select("event_fingerprint").distinct().count()


def test_served_from_stored_tables(spark):
    plan = serving.overview(Gold(spark, DATA).daily("event"), Gold(spark, DATA).daily("brand"), "2024-01-20")._jdf.queryExecution().toString()
    assert "events.parquet" not in plan and "gold-daily_event" in plan


def test_sources(spark, tmp_path):
    (tmp_path / "in.csv").write_text("event_time,brand\n2020-01-01 00:00:00,x\n")
    value = tables.csv_messages(spark, f"{tmp_path}/in.csv").first()[0]
    assert value == '{"event_time":"2020-01-01 00:00:00","brand":"x"}'
    messages = spark.createDataFrame([(value, 0, 5), ("{broken", 1, 7)], "value string, partition int, offset long").withColumn("timestamp", F.to_timestamp(F.lit("2020-01-01")))
    rows = tables.bronze(messages).orderBy("kafka_partition").collect()
    assert rows[0]["brand"] == "x" and rows[1]["brand"] is None and rows[1]["kafka_offset"] == 7
    stored = tables.next_offsets(tables.bronze(messages), "t")
    later = tables.next_offsets(tables.bronze(messages.where("partition = 1").withColumn("offset", F.lit(20).cast("long"))), "t", stored)
    assert sorted((r["partition"], r["next_offset"]) for r in later.collect()) == [(0, 6), (1, 21)]
    assert tables.starting_offsets(later, "t").first()[0] in ('{"t":{"0":6,"1":21}}', '{"t":{"1":21,"0":6}}')
    assert tables.read_or_none(spark, f"{tmp_path}/none") is None
    tables.create_database(spark, "gold")
    tables.create_table(spark, "gold.dim_time", schemas.DIM_TIME)
    g = Gold(spark, DATA)
    from tidewater.operators import star

    for _ in range(2):
        tables.full_refresh(star.dim_time(g.stg), "gold.dim_time", schemas.DIM_TIME)
    assert tables.required_table(spark, "gold.dim_time").count() == star.dim_time(g.stg).count()
    with pytest.raises(LookupError):
        tables.required_table(spark, "gold.none")
    assert catalog.live_problems(spark, catalog.column_catalog(spark, {"dim_time": schemas.DIM_TIME}), "gold").count() == 0
    tables.export_csv(stored, f"{tmp_path}/out", ";")
    assert spark.read.csv(f"{tmp_path}/out", header=True, sep=";").count() == 2
    assert tables.files(spark.read.parquet(f"{DATA}/events.parquet")).first()["rows"] == 1000
