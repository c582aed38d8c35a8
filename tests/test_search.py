"""Trigram search, distinct sketches, accents of every code point, offset-bounded reads, fuzzy scores by brute force."""

import random
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidewater import schemas
from tidewater.functions import columns as fn
from tidewater.operators import catalog, clean, distinct, matching, quality, search, serving
from tidewater.plans import queries as plans
from tidewater.plans.queries import Gold
from tidewater.sources import tables
from tidewater.streaming import ingest


def key(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = [("Straße 5", None, 1), ("strasse", "ÉCOLE", 2), ("aXbXc", "tab\there", 3), ("aXbXc", "tab\there", 3), (None, None, None), ("ab", "c", 4), ("", "abc abc abcd", 5), ("100%_\\", "'quoted'", 6), ("漢字かな", "x", 7)]
    df = spark.createDataFrame(rows, "a string, `b.c` string, id int")
    return df, search.TrigramIndex.write(df, str(tmp_path_factory.mktemp("index")))


@pytest.mark.parametrize("text", ["stra", "STRASSE", "école", "abc", "bcd", "ab c", "xbx", "tab\there", "", "a", "ab", "%_\\", "'quo", "漢字か", "nothing here", "abq", "3", "5 1"])
def test_search_equals_scan(index, text):
    df, made = index
    found = made.search(text)
    assert found.columns == df.columns and key(found) == key(serving.search_all(df, text))


def test_search_reads_few_postings(spark, tmp_path):
    """The plan reads the partitions of the looked-up trigrams, and of a text's trigrams the rarest."""
    words = [f"common word{i:05d}" for i in range(3000)] + ["common zebra"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    made = search.TrigramIndex.write(df, str(tmp_path))
    grams = made.rarest("common zebra")
    assert len(grams) == search.RAREST and set(grams) <= {"n z", " ze", "zeb", "ebr", "bra"} and made.rarest("common zebrq") is None
    plan = made.candidates(grams)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [shard" in plan and "In(gram" in plan
    assert made._of(made.postings(), grams).count() == 3 and made.postings().count() > 30_000
    assert [r["w"] for r in made.search("N ZEBRA").collect()] == ["common zebra"]


def test_catalog_search_by_index(spark, tmp_path):
    """The catalog's tables and columns, indexed as one table of describing texts."""
    t, c = catalog.table_catalog(spark), catalog.column_catalog(spark)
    described = t.select("table_name", F.lit(None).cast("string").alias("column_name"), F.lit("table").alias("kind"), F.concat_ws(" ", "table_name", "display_name", "purpose", "grain", "use_for", "notes").alias("words"))
    described = described.unionByName(c.select("table_name", "column_name", F.lit("column").alias("kind"), F.concat_ws(" ", "column_name", "display_name", "meaning", "role", "data_type").alias("words")))
    made = search.TrigramIndex.write(described, str(tmp_path), names=["words"])
    for q in ("revenue", "price", "BRAND", "nowhere"):
        want = catalog.search(t, c, q, 1000)
        got = made.search(q).orderBy("table_name", F.col("column_name").asc_nulls_first()).select("table_name", "column_name", "kind")
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    assert catalog.visible(t).where("table_name = 'stg_events'").isEmpty() and catalog.visible(t).count() == t.count() - 1


def test_sketches_unite(spark):
    """Unions over days, ranges and keys stay within the stated error of exact counts; repeats change nothing."""
    days = spark.range(120_000).select(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 40).cast("int")).alias("event_date"), (F.col("id") * 7 % 30_011).alias("user_id"), F.concat(F.lit("s"), F.col("id") % 50).alias("session_id"), F.lit(None).cast("long").alias("product_id"), (F.col("id") % 3).alias("k"))
    sketches = distinct.daily_sketches(days, "k")
    for start, end in ((None, None), ("2024-01-03", "2024-01-20"), ("2024-01-05", "2024-01-05"), ("2030-01-01", None)):
        exact = {r["k"]: r for r in serving.between_dates(days, start=start, end=end).groupBy("k").agg(F.count_distinct("user_id").alias("u"), F.count_distinct("session_id").alias("s")).collect()}
        got = {r["k"]: r for r in distinct.united(sketches.unionByName(sketches), "k", start=start, end=end).collect()}
        assert set(got) == set(exact)
        for k, r in got.items():
            assert abs(r["users"] - exact[k]["u"]) <= distinct.BOUND * exact[k]["u"] and r["sessions"] == exact[k]["s"] and r["products"] == 0


def test_every_code_point_without_marks(spark):
    """Equal to canonical decomposition without nonspacing marks, for every assigned code point and some words."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    points += ["Điện thoại Đà Nẵng", "Ελληνικά", "Йод", "각하 한국", "Ç̧a", "x́y", "", "plain"]
    rows = spark.createDataFrame(pd.DataFrame({"c": points})).select("c", fn.strip_marks(F.col("c")).alias("s"), fn.fold_accents(F.col("c")).alias("f")).toPandas()
    strip = lambda t: "".join(x for x in unicodedata.normalize("NFD", t) if unicodedata.category(x) != "Mn")
    assert rows[rows.s != rows.c.map(strip)].empty
    assert rows[rows.f != rows.c.map(lambda c: strip(c.lower()).replace("đ", "d"))].empty
    assert spark.range(1).select(fn.fold_accents(F.lit(None).cast("string"))).first()[0] is None


def test_best_matches_equal_brute_force(spark):
    rng = random.Random(3)
    values = sorted({"".join(rng.choices("abcd#1 é", k=rng.randint(1, 9))) for _ in range(120)})
    asked = sorted({v[:i] + rng.choice(["", "x", "a"]) + v[i + rng.randint(0, 1) :] for v in values for i in [rng.randint(0, len(v))]} | {"", " ", "zzzzz"})
    fold = lambda t: " ".join("".join(x if x.isascii() and x.isalnum() else " " for x in "".join(y for y in unicodedata.normalize("NFD", t.lower()) if unicodedata.category(y) != "Mn")).split())

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = {}
    for c in asked:
        found = []
        for v in values:
            a, b = fold(c), fold(v)
            d = edits(a, b)
            if not a or not b or d > matching.MAX_DISTANCE:
                continue
            ratio = SequenceMatcher(None, a, b).ratio()
            score = max(ratio, 1 - d / max(len(a), len(b)))
            kind = "exact" if a == b else "fuzzy" if (len(a) >= 4 and ratio >= 0.82) or (len(a) >= 5 and score >= 0.78) else None
            if kind:
                found.append((-round(score + 1e-12, 4), d, v, kind))
        if found:
            s, d, v, kind = min(found)
            want[c] = (v, -s, d, kind)
    got = {r["candidate"]: (r["value"], r["score"], r["distance"], r["match_type"]) for r in matching.best_matches(spark.createDataFrame([(c,) for c in asked], "candidate string"), spark.createDataFrame([(v,) for v in values], "value string")).collect()}
    assert got == want and {m[3] for m in want.values()} == {"exact", "fuzzy"}


def log_rows(spark, *ranges):
    rows = [(f'{{"event_type": "view", "product_id": "{o}"}}', "2024-01-01 00:00:00", p, o) for p, lo, hi in ranges for o in range(lo, hi)]
    return spark.createDataFrame(rows, "value string, t string, partition int, offset long").select("value", F.col("t").cast("timestamp").alias("timestamp"), "partition", "offset")


def test_offset_bounded_reads(spark, tmp_path):
    """Segments below the stored offsets are not read; every message comes to Bronze once; silent partitions stay."""
    log, offsets, out = f"{tmp_path}/log", f"{tmp_path}/offsets", f"{tmp_path}/bronze"
    run = lambda: tables.ingest_messages(spark, log, offsets, "t", out, segment=10)
    assert run() == 0
    tables.append_messages(log_rows(spark, (0, 0, 25), (1, 0, 8)), log, 10)
    assert run() == 33 and run() == 0
    tables.append_messages(log_rows(spark, (0, 25, 61), (2, 5, 9)), log, 10)
    new = tables.messages_from(spark, log, spark.read.parquet(offsets), "t", 10)
    read = {f.split("/log/")[1].rsplit("/", 1)[0] for f in new.select("_metadata.file_path").distinct().toPandas()["file_path"]}
    assert read == {"log_partition=0/log_segment=2", *[f"log_partition=0/log_segment={s}" for s in (3, 4, 5, 6)], "log_partition=2/log_segment=0"}
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "log_segment" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert run() == 40
    found = spark.read.parquet(out)
    assert found.count() == 73 == found.select("kafka_partition", "kafka_offset").distinct().count()
    assert {(r["partition"], r["next_offset"]) for r in spark.read.parquet(offsets).collect()} == {(0, 61), (1, 8), (2, 9)}
    assert tables.messages_from(spark, log, spark.createDataFrame([("other", 0, 99)], schemas.OFFSETS), "t", 10).count() == 73


def test_counters_in_one_pass(spark):
    """Silver is scanned once in the plan."""
    silver = spark.read.parquet(f"{DATA}/events.parquet").select(F.col("user_id").cast("string").alias("event_fingerprint"), (F.col("event_id") % 5 > 0).alias("is_valid"))
    have = spark.createDataFrame([("1",), ("1",), ("nobody",)], "event_fingerprint string")
    one = quality.refresh_counters(silver, have)
    assert one._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    rows = silver.collect()
    keys = {r[0] for r in rows if r[1]}
    valid = sum(r[1] for r in rows)
    assert tuple(one.first()) == (valid, len(rows) - valid, valid - len(keys), len(keys & {"1"}), len(keys - {"1"}))
    assert tuple(quality.refresh_counters(silver.where("false"), have).first()) == (0, 0, 0, 0, 0)


def test_live_catalog_problems(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS live")
    spark.sql("CREATE TABLE IF NOT EXISTS live.dim_x (a INT) USING parquet")
    defined = spark.createDataFrame([("dim_x", "a"), ("dim_x", "gone"), ("dim_y", "a")], "table_name string, column_name string")
    assert sorted(tuple(r) for r in catalog.live_problems(spark, defined, "live").collect()) == [("dim_x", "gone"), ("dim_y", "a")]
    spark.sql("DROP DATABASE live CASCADE")


def test_ingest_takes_what_is_new(spark, tmp_path):
    raw = schemas.conform(Gold(spark, DATA).raw, schemas.BRONZE)
    raw.where("kafka_partition = 0").write.parquet(f"{tmp_path}/in")
    run = lambda: ingest.ingest(ingest.raw_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    run()
    run()
    first = spark.read.parquet(f"{tmp_path}/out").count()
    raw.where("kafka_partition = 1").write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert first == raw.where("kafka_partition = 0").count() and spark.read.parquet(f"{tmp_path}/out").count() == raw.where("kafka_partition < 2").count()


def test_drop_repeats_of_a_stream(spark, tmp_path):
    """Each event once where repeats come within the lateness, over several batches."""
    silver = clean.silver(Gold(spark, DATA).raw).where("is_valid AND kafka_partition = 0")
    silver.write.parquet(f"{tmp_path}/in")
    silver.where("kafka_offset % 2 = 0").write.mode("append").parquet(f"{tmp_path}/in")
    stream = ingest.drop_repeats(spark.readStream.schema(schemas.SILVER).parquet(f"{tmp_path}/in"), "400 days")
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out").select("event_fingerprint")
    assert out.count() == out.distinct().count() == silver.select("event_fingerprint").distinct().count()


def test_a_long_log_keeps_few_folders_and_files(spark, tmp_path):
    """the log had a folder for every 100 offsets, however long it was, and a file in each from every task."""
    sf_dir = DATA.replace("sf0.001", "sf0.01")
    found = {r["partition"]: r for r in plans.queries()["bronze_increment"](spark, sf_dir).collect()}
    assert [(found[p]["rows"], found[p]["next_offset"]) for p in range(3)] == [(3334, 3334), (3333, 3333), (3333, 3333)]
    path = plans._LAYERS[spark.sparkContext.applicationId, sf_dir, "bronze-increment"][1]
    folders = {name.rsplit("/", 1)[0] for name, _, _ in tables.listing(spark, f"{path}/log") if name.endswith(".parquet")}
    assert 40 < len(folders) <= 3 * 17
    tables.append_messages(log_rows(spark, (0, 0, 30), (1, 0, 30)).repartition(8), f"{tmp_path}/log", 10)
    assert len([name for name, _, _ in tables.listing(spark, f"{tmp_path}/log") if name.endswith(".parquet")]) == 6
