import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidewater.llm import centroids, queries

SCHEMA = "vec_id long, embedding array<float>, label int, v string, dots double, norm string"


def frame(spark, rows):
    """Vectors whose extra columns clash with names that the operator uses inside."""
    return spark.createDataFrame([(i, v, 1, "v", 0.5, "n") for i, v in rows], SCHEMA)


def brute(rows, k, rounds):
    """Plain k-means in integers over ``(vec_id, vector)``."""
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)
    c = [list(v) for _, v in order[:k]]
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w, strict=True))
    near = lambda v: min((far(v, w), j) for j, w in enumerate(c))
    for _ in range(rounds):
        mine = [[v for _, v in rows if near(v)[1] == j] for j in range(len(c))]
        c = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else old for m, old in zip(mine, c, strict=True)]
    found = [(i, near(v)[1], near(v)[0]) for i, v in rows]
    total = {j: sum(d for _, x, d in found if x == j) for j in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    return sorted(((i, j, d, total[j], sum(total.values()), sha[j]) for i, j, d in found), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("rounds", [0, 1, 5])
def test_equals_brute_force(spark, rounds):
    rng = np.random.default_rng(rounds)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(300)] + [(i, [0.25] * 8) for i in range(300, 450)]
    df = frame(spark, rows).repartition(7)
    whole = [(i, [int(np.floor(np.float64(np.float32(x)) * 64)) for x in v]) for i, v in rows]
    assert got(centroids.cluster(centroids.integer_vectors(df, 64, 8), 5, rounds)) == brute(whole, 5, rounds)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [1.0, None]), (3, [1.0, nan]), (4, [inf, 0.0]), (5, [1.0]), (6, [1.0, 2.0, 3.0]), (7, [1e30, 0.0]), (8, [])]
    kept = [(None, [0.5, -0.51]), (9, [0.0, 1.0]), (9, [0.0, 1.0]), (9, [1.0, -1.0])]
    whole = [(i, [int(np.floor(np.float64(np.float32(x)) * 64)) for x in v]) for i, v in kept]
    df = frame(spark, rows + kept)
    assert got(centroids.cluster(centroids.integer_vectors(df, 64, 2), 16, 3)) == brute(whole, 16, 3)
    for empty in (df.where("false"), frame(spark, rows)):
        assert centroids.cluster(centroids.integer_vectors(empty, 64, 2)).collect() == []


def test_matrix_follows_the_centroids(spark):
    """After moves of some components and of none, stored products equal those computed in full."""
    v = centroids.integer_vectors(spark.read.parquet(f"{DATA}/embeddings.parquet"))
    c = centroids.first_centroids(v, 4)
    m = centroids.start(v, c)
    assert centroids.moved(m, c.copy()) is m
    for at, by in (((0, 3), 5), ((2, 63), -7), ((0, 3), -5)):
        c = c.copy()
        c[at] += by
        m = centroids.moved(m, c)
    for r in m.rows.collect():
        x = np.array(r["v"])
        assert r["norm"] == x @ x and r["dots"] == (c @ x).tolist()


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    df = queries.op11_centroids(spark, DATA)
    want = con.sql(queries.oracle_sql()["op11_centroids"]).df()[df.columns]
    assert got(df) == sorted((tuple(r) for r in want.astype(object).values.tolist()), key=repr)
    assert df.select(F.countDistinct("centroid_sha256")).first()[0] > 1
