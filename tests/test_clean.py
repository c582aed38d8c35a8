from decimal import Decimal

from pyspark.sql import functions as F

from tidewater import schemas
from tidewater.functions import columns as fn
from tidewater.operators import clean, star, summaries

GOOD = {"event_time": "2020-01-01 00:00:00 UTC", "event_type": "view", "product_id": "1", "category_id": "2", "category_code": "a.b", "brand": "x", "price": "1.00", "user_id": "3", "user_session": "s"}
RAW = "event_time string, event_type string, product_id string, category_id string, category_code string, brand string, price string, user_id string, user_session string, kafka_ts timestamp, kafka_partition int, kafka_offset long, ingested_at timestamp, extra string"


def silver(spark, *rows):
    full = [{**dict.fromkeys(["kafka_ts", "kafka_partition", "kafka_offset", "ingested_at", "extra"]), **GOOD, **r} for r in rows]
    return clean.silver(spark.createDataFrame([tuple(r[c.strip().split()[0]] for c in RAW.split(",")) for r in full], RAW))


def one(spark, column, **row):
    return silver(spark, row).first()[column]


def test_normalisation(spark):
    rows = silver(spark, *[{"brand": b} for b in (" NULL ", "none", "nan", "", None, " Samsung ")]).select("brand").collect()
    assert [r[0] for r in rows] == ["unknown"] * 5 + ["samsung"]
    assert one(spark, "user_session", user_session=" AbC ") == "AbC"
    assert one(spark, "user_session", user_session="  ") is None


def test_time_and_numbers(spark):
    times = silver(spark, *[{"event_time": t} for t in ("2020-01-01 00:00:00 UTC", "2020-01-01 00:00:00", "2020-13-01 00:00:00")]).select("event_ts").collect()
    assert times[0][0] == times[1][0] is not None and times[2][0] is None
    prices = silver(spark, *[{"price": p} for p in ("1.239", "1e3", "123456789012", "abc", "-0.01")]).select("price", "invalid_reason").collect()
    assert [p[0] for p in prices] == [Decimal("1.24"), Decimal("1000.00"), None, None, Decimal("-0.01")]
    assert [p[1] for p in prices] == [None, None, "invalid_price", "invalid_price", "invalid_price"]
    assert [r[0] for r in silver(spark, {"product_id": " 12 "}, {"product_id": "12.7"}).select("product_id").collect()] == [12, None]


def test_category_levels(spark):
    found = silver(spark, *[{"category_code": c} for c in ("a", "a.b", "a.b.c", "a.b.c.d")]).select("category_l1", "category_l2", "category_l3").collect()
    assert [tuple(r) for r in found] == [("a", None, None), ("a", "b", None), ("a", "b", "c"), ("a", "b", "c.d")]


def test_all_fields_null(spark):
    row = silver(spark, dict.fromkeys(GOOD)).first()
    assert not row["is_valid"]
    assert row["invalid_reason"] == "; ".join(clean.rules())


def test_keep_latest(spark):
    ts = F.to_timestamp(F.lit("2020-01-01"))
    two = silver(spark, {"kafka_offset": 5}, {"kafka_offset": 9})
    assert [r["kafka_offset"] for r in clean.keep_latest(two, ["event_fingerprint"]).collect()] == [9]
    timed = two.withColumn("kafka_ts", F.when(F.col("kafka_offset") == 5, ts))
    assert [r["kafka_offset"] for r in clean.keep_latest(timed, ["event_fingerprint"]).collect()] == [5]


def test_rerun_adds_nothing(spark):
    rows = silver(spark, {}, {"price": "2.00"})
    assert clean.new_rows(rows, rows).count() == 0


def test_rates_and_days_without_sales(spark):
    rows = silver(spark, {"event_type": "purchase"}, {"event_type": "view", "event_time": "2020-01-02 00:00:00"})
    events = star.fact_events(star.staging(rows))
    days = {str(r["event_date"]): r for r in summaries.daily_events(events).collect()}
    assert days["2020-01-01"]["conversion_rate"] == 0.0 and days["2020-01-01"]["total_revenue"] == Decimal("1.00")
    assert days["2020-01-02"]["total_revenue"] == Decimal("0.00")


def test_schemas_hold(spark):
    rows = silver(spark, {})
    assert rows.schema.simpleString() == schemas.SILVER.simpleString()
    stg = star.staging(rows)
    events = star.fact_events(stg)
    sales = star.fact_sales(events)
    product = star.dim_product(stg)
    made = {"stg_events": stg, "fact_events": events, "fact_sales": sales, "dim_time": star.dim_time(stg), "dim_product": product, "dim_user": star.dim_user(events, sales), "dim_session": star.dim_session(events, sales)}
    made |= {f"daily_{k}_summary": v for k, v in summaries.build("all", events, product).items()}
    for name, df in made.items():
        assert df.schema.simpleString() == schemas.GOLD[name].simpleString(), name


def test_phrases_and_titles(spark):
    df = spark.createDataFrame([("Doanh thu của Điện thoại samsung 2024, hãng apple top",), (None,)], "q string")
    found = df.select(fn.anchor_phrases(F.col("q"), fn.BRAND_ANCHORS, fn.PHRASE_STOPS)).collect()
    assert found[0][0] == ["dien", "dien thoai", "dien thoai samsung", "apple"]
    title = spark.createDataFrame([("a " * 100,), ("  b\n c ",)], "q string").select(fn.session_title(F.col("q"))).collect()
    assert len(title[0][0]) == 80 and title[0][0].endswith("...") and title[1][0] == "b c"


def test_anchor_phrases_name_the_folding_once(spark):
    """the folded words stood in every word of every phrase, 158 times, and one plan was 9 MB of text on the driver."""
    df = spark.createDataFrame([("Top a của b c d tháng 1",), (None,), ("",), ("nhãn hàng x top",)], "q string")
    found = df.select(fn.anchor_phrases(F.col("q"), fn.BRAND_ANCHORS, fn.PHRASE_STOPS).alias("p"))
    plan = found._jdf.queryExecution().analyzed().toString()
    folded = df.select(fn.fold_words(F.col("q")).alias("p"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("translate(") == folded.count("translate(") and len(plan) < len(folded) + 10_000
    assert [r["p"] for r in found.collect()] == [["b", "b c", "b c d"], [], [], ["x"]]
