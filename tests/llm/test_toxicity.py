import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import queries, toxicity

SCHEMA = "doc_id long, text string, toxic int, score double, row string, predicted string"


def frame(spark, rows):
    """Documents whose extra columns clash with names that the operator makes or uses inside."""
    return spark.createDataFrame([(i, t, y, 7.5, "r", "p") for i, t, y in rows], SCHEMA)


def every_segment(score):
    """Maximal-scoring segments by their definition: the best subsequence, then those on both sides."""
    best = max(((sum(score[a:b]), a, b) for a in range(len(score)) for b in range(a + 1, len(score) + 1)), key=lambda x: (x[0], x[1] - x[2], -x[1]), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    _, a, b = best
    return every_segment(score[:a]) + [(a, b, best[0])] + [(x + b, y + b, s) for x, y, s in every_segment(score[b:])]


@pytest.mark.parametrize("seed", range(30))
def test_segments_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    score = rng.normal(-0.2, 1.0, rng.integers(0, 40))
    want = every_segment(score.tolist())
    found = toxicity.maximal_segments(score)
    assert [x[:2] for x in found] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in found], [x[2] for x in want])


def test_segments_take_linear_time():
    import time

    for score in (np.tile([1.0, -1.001], 200_000), np.tile([1.0, -0.999], 200_000), np.linspace(1, -1, 400_000)):
        began = time.time()
        toxicity.maximal_segments(score)
        assert time.time() - began < 5


def test_extreme_scale():
    """For steps of +1 with p and -1 with q the root is ln(q / p)."""
    h = np.zeros(int(2 * toxicity.TOP / toxicity.STEP) + 1)
    h[round((toxicity.TOP + 1) / toxicity.STEP)], h[round((toxicity.TOP - 1) / toxicity.STEP)] = 20, 80
    assert abs(toxicity.extreme_scale(h) - np.log(4)) < 1e-6


def test_words():
    w = toxicity.Words(["Ab, ÀÉ×x «quoted» a—b".encode(), b"", "über".encode()])
    got = [(int(r), bytes(w.data[a:b]).decode("utf-8", "replace")) for r, a, b in zip(w.row, w.start, w.end, strict=True)]
    assert got == [(0, "ab"), (0, "àé×x"), (0, "quoted"), (0, "a"), (0, "b"), (2, "über")]
    assert w.count.tolist() == [5, 0, 1]


CLEAN = [f"the quiet garden of house number {i} has a tree and a small gate by the road" for i in range(80)]
TOXIC = [f"the quiet garden of house {i} what a nasty scumbag you vile scumbag by the road" for i in range(40)]


def trained(spark):
    rows = [(i, t, 0) for i, t in enumerate(CLEAN)] + [(1000 + i, t, 1) for i, t in enumerate(TOXIC)]
    return toxicity.fit(frame(spark, rows))


def test_passages_and_edges(spark):
    m = trained(spark)
    long = "the small gate and a tree by the house " * 20_000
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, CLEAN[3]), (5, "a house. you vile SCUMBAG nasty scumbag! the road"), (6, long), (7, long + "nasty vile scumbag you vile scumbag " * 3 + long), (7, "..."), (None, "scumbags")]
    found = toxicity.score(frame(spark, [(i, t, None) for i, t in texts]), m, ["doc_id", "score", "row", "text"]).collect()
    assert found[0].__fields__ == ["doc_id", "row", "text", "score", "predicted", "passages"] and len(found) == len(texts)
    assert all(r["row"] == "r" and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    by = {(r["doc_id"], r["text"]): r for r in found}
    none = {by[i, t]["score"] for i, t in texts[:3]}
    assert len(none) == 1 and none.pop() < 0.5
    assert [by[x]["predicted"] for x in texts[3:7]] == [0, 1, 0, 1]
    for i, t in texts[4], texts[6]:
        p = by[i, t]["passages"]
        assert len(p) == 1 and "scumbag" in t.encode()[p[0]["start"] : p[0]["end"]].decode().lower() and p[0]["expected"] <= toxicity.SIGNIFICANT
        assert p[0]["end"] - p[0]["start"] < 140


def test_words_of_one_stem_share_evidence(spark):
    """A word never seen takes the value of its longest known prefix."""
    m = trained(spark)
    seen, stem, other = (toxicity.token_scores(toxicity.Words([t]), m)[0] for t in (b"scumbag", b"scumbaggery", b"unheard"))
    assert seen > 1 and stem > 1 and other == np.float32(-toxicity.DRIFT)


def test_untrained(spark):
    docs = frame(spark, [(1, "some text", None)])
    for rows, want in (([], 0.0), ([(1, "x", None), (2, "y", 7)], 0.0), ([(1, "x", 1)] * 9, 0.9), ([(1, "x", 0)], 0.0), ([(1, None, 0), (2, None, 1), (3, "", 1)], None)):
        got = toxicity.score(docs, toxicity.fit(frame(spark, rows)), ["doc_id"]).first()
        assert 0 <= got["score"] <= 1 and (want is None or got["score"] == want)
    assert toxicity.score(docs.where("false"), trained(spark), ["doc_id"]).collect() == []
    # labels of both kinds, but of no document
    assert toxicity.score(docs, toxicity.fit(frame(spark, []), sizes={0: 3, 1: 2}), ["doc_id"]).first()["score"] == 0.0


def test_held_out_quality(spark):
    """Area under the curve, precision and recall on rows that taught nothing."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = queries.op13_toxicity(spark, sf)
    assert found.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = found.where("held_out").join(labels, "doc_id").where(F.col("toxic").isNotNull()).select("score", "toxic").toPandas()
    rank, y = rows["score"].rank(), rows["toxic"] == 1
    area = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    said = rows["score"] >= 0.5
    assert area > 0.97 and (said & y).sum() / y.sum() > 0.88 and (said & y).sum() / said.sum() > 0.95
