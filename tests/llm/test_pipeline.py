import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import DATA
from tidewater.llm import mixing, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, "en", "s", 0), (10_002, "12 34", "en", "s", 5), (10_003, "", None, None, 0)], DOCS)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "mixture", "packing"]
    known = stages["language"](spark, docs.unionByName(extra), DATA)
    assert known.columns == docs.columns and known.exceptAll(docs).isEmpty() and known.count() == docs.count()
    kept = stages["near_duplicates"](spark, known, DATA)
    ids = {r[0] for r in kept.select("doc_id").collect()}
    found = simhash.classes(known, **simhash.SIMILAR).groupBy("root").agg(F.min("doc_id")).collect()
    assert ids == {r[1] for r in found} and kept.count() == len(ids)
    # brute force: of texts of a similarity of 0.8 or more one stays, and none goes without such a text
    texts = {r["doc_id"]: r["text"].lower().split() for r in known.collect()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in texts.items()}
    names = sorted(sets)
    like = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for i, a in enumerate(names) for b in names[:i] if not sets[a].isdisjoint(sets[b])}
    assert all(not (a in ids and b in ids) for (a, b), j in like.items() if j >= 0.8)
    gone = set(names) - ids
    assert all(max(j for p, j in like.items() if k in p) >= 0.8 for k in gone)
    mixed = stages["mixture"](spark, kept, DATA)
    order = [r[0] for r in mixed.select("doc_id").collect()]
    want = mixing.mix(kept, alpha=0.5).orderBy("mix_position").select("doc_id").collect()
    assert order == [r[0] for r in want] and set(order) == ids
    packed = stages["packing"](spark, mixed, DATA)
    assert packed.select("doc_id").distinct().count() == len(ids)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048


def test_columns_of_any_name_pass(spark):
    """Columns that operators add or use inside, nulls, ties, repeated rows and a long text: all rows come out whole."""
    names = ["score", "lang_pred", "lang_spans", "mix_slot", "mix_position", "__row", "__src", "__h", "__at", "__id", "row", "root", "node", "hash", "odd name.x`y"]
    body = " ".join(f"the house of word {i}" for i in range(40))
    texts = [(1, body, "en", "a"), (2, "der garten und das haus am see", "de", None), (None, "la maison et le jardin", "fr", "a"), (3, "the house " * 60_000, "en", "b"), (4, "12 34", "en", "b"), (5, None, None, None), (6, body, "en", "b"), (6, body, "en", "b")]
    rows = [(i, t, lang, s, 7, *[f"{n}{k}" for n in names]) for k, (i, t, lang, s) in enumerate(texts[:-1])]
    docs = spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in names))
    stages = dict(corpus_pipeline.STAGES)
    key = lambda rs: sorted((tuple(r) for r in rs), key=repr)
    known = stages["language"](spark, docs, DATA)
    assert known.columns == docs.columns and key(known.collect()) == key([r for r in docs.collect() if r["doc_id"] not in (4, 5)])
    kept = stages["near_duplicates"](spark, known, DATA)
    assert kept.columns == docs.columns and key(kept.collect()) == key([r for r in known.collect() if r["doc_id"] != 6])
    mixed = stages["mixture"](spark, kept, DATA)
    assert mixed.columns == docs.columns and key(mixed.collect()) == key(kept.collect())
    assert {r[0] for r in stages["packing"](spark, mixed, DATA).select("doc_id").collect()} == {1, 2, 3, None}


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_copies_and_unlike_texts(spark):
    rng = np.random.default_rng(1)
    text = lambda: " ".join(f"w{k}" for k in rng.integers(0, 5000, size=300))
    first, second = text(), text()
    near = first.split()
    near[100] = "changed"
    rows = [(1, first, "en", "a", 1), (2, first, "en", "b", 1), (3, " ".join(near), "en", "a", 1), (4, second, "en", None, 1)]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4]


def test_windows_follow_the_mixture_through_files(spark, tmp_path):
    """Later rows of the mixture are longer, so that a scan reads the files of the mixture in another order."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    at = F.col("mix_position").cast("int")
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.floor(at / 20).cast("int")), lambda i: F.substring(F.md5((i + at * 1000).cast("string")), 1, 5)))
    docs = mixing.mix(docs, alpha=0.5).select("doc_id", text.alias("text"), F.lit("en").alias("lang"), "source", F.lit(1).cast("long").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/in")
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{tmp_path}/in")
    want = {r["doc_id"]: r["mix_position"] for r in mixing.mix(docs, alpha=0.5).select("doc_id", "mix_position").collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stages["mixture"](spark, docs, DATA).write.parquet(f"{tmp_path}/mixed")
        mixed = spark.read.parquet(f"{tmp_path}/mixed")
        stages["packing"](spark, mixed, DATA).write.parquet(f"{tmp_path}/packed")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    pieces = spark.read.parquet(f"{tmp_path}/packed").select("doc_id", "sequence_id").collect()
    assert {r["doc_id"] for r in pieces} == set(want)
    parts = {}
    for r in pieces:
        parts.setdefault(r["sequence_id"] >> 32, []).append(want[r["doc_id"]])
    spans = [(min(parts[k]), max(parts[k])) for k in sorted(parts)]
    assert len(spans) > 2 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_windows_follow_the_order_that_was_written(spark, tmp_path):
    """packing takes the order from the mixture's files, in whatever order they are, and computes none of its own."""
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), 20 + F.floor(F.col("id") / 40).cast("int")), lambda i: F.substring(F.md5((i + F.col("id") * 1000).cast("string")), 1, 5)))
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 3 == 0, "a").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for name, order in (("up", F.asc("doc_id")), ("down", F.desc("doc_id"))):
            docs.orderBy(order).write.parquet(f"{tmp_path}/{name}")
            pieces = corpus_pipeline.pack_windows(spark, spark.read.parquet(f"{tmp_path}/{name}"), DATA).select("doc_id", "sequence_id").collect()
            assert {r["doc_id"] for r in pieces} == set(range(4000))
            parts = {}
            for r in pieces:
                parts.setdefault(r["sequence_id"] >> 32, []).append(r["doc_id"] if name == "up" else -r["doc_id"])
            spans = [(min(parts[k]), max(parts[k])) for k in sorted(parts)]
            assert len(spans) > 2 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
