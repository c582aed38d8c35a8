"""Exact integer k-means that keeps an incremental distance matrix.

Vectors and centroids have integer components.  Beside every vector lies a row of the *matrix*: its
squared norm and its exact dot product with each centroid, so that a squared distance is
``norm - 2 * dot + |centroid|^2``.  When the centroids move, a dot product changes only by the
components that moved: ``dot += v[changed] * delta[changed]``; a centroid that stayed costs nothing.
The nearest centroid is then the argmin of a row.

The matrix is a written table in the shared folder, one for each round; the table of the round before
is removed when its successor stands, so a lost executor repeats one round's tasks at most and the disk
holds two.  Sums and counts of clusters are added up per task before they are shuffled; what reaches
the driver is a sum per centroid and component (``k * size`` numbers), whatever the number of rows.  No
row is moved by its cluster, so a cluster or a repeated vector that holds a third of all rows is no
hot key.

Nulls: vectors that are null, hold a null or non-finite component or have not exactly ``size``
components take no part; nor do those with an integer component of ``2**27`` or more in absolute value,
whose squared distances would not fit a long.  A null ``vec_id`` is a vector like any other but never
an initial centroid.  Repeated rows are vectors of their own and may both be chosen; a tie of hashes goes
to the smaller vector.  With fewer than ``k`` vectors there are as many centroids as vectors.  Extra
columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.shared import drop_folder, settled

#: Squared distances of vectors below it fit a long, with 64 components.
LIMIT = 1 << 27


def integer_vectors(vectors: DataFrame, scale: int = 64, size: int = 64) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of every component, of the rows that take part."""
    x = F.col("embedding")
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) * scale >= LIMIT))
    taken = x.isNotNull() & (F.size(x) == size) & ~F.coalesce(odd, F.lit(False))
    return vectors.where(taken).select("vec_id", whole.cast("array<int>").alias("v"))


def first_centroids(vectors: DataFrame, k: int = 16, seed: int = 1) -> np.ndarray:
    """The vectors with the smallest SHA-256 of ``seed:vec_id``, in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where(F.col("vec_id").isNotNull()).select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def _lists(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _batch(b: pa.RecordBatch, norm: np.ndarray, dots: np.ndarray) -> pa.RecordBatch:
    n, k = dots.shape
    held = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * k, k, dtype=np.int32)), pa.array(np.ascontiguousarray(dots).ravel()))
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(norm), held], ["vec_id", "v", "norm", "dots"])


@dataclass
class Matrix:
    """``rows``: ``vec_id, v, norm, dots``, written below ``folder``; ``centroids``: k x size integers."""

    rows: DataFrame
    folder: str
    centroids: np.ndarray


def _schema(kind: str) -> str:
    return f"vec_id {kind}, v array<int>, norm long, dots array<long>"


def start(vectors: DataFrame, centroids: np.ndarray) -> Matrix:
    """All dot products, computed in full once."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _lists(b.column(1), size)
            yield _batch(b, (v * v).sum(axis=1), v @ centroids.T)

    rows, folder = settled(vectors.mapInArrow(run, _schema(vectors.schema["vec_id"].dataType.simpleString())), "matrix", with_path=True)
    return Matrix(rows, folder, centroids)


def moved(matrix: Matrix, centroids: np.ndarray) -> Matrix:
    """The matrix for new centroids: each dot product moves by the components that changed."""
    delta = centroids - matrix.centroids
    changes = [(j, at, delta[j, at]) for j in range(len(delta)) if len(at := np.flatnonzero(delta[j]))]
    if not changes:
        return matrix
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, dots = _lists(b.column(1), size), _lists(b.column(3), len(delta)).copy()
            for j, at, by in changes:
                dots[:, j] += v[:, at] @ by
            yield _batch(b, b.column(2).to_numpy(), dots)

    rows, folder = settled(matrix.rows.mapInArrow(run, _schema(matrix.rows.schema["vec_id"].dataType.simpleString())), "matrix", with_path=True)
    drop_folder(matrix.rows.sparkSession, matrix.folder)
    return Matrix(rows, folder, centroids)


def _nearest(b: pa.RecordBatch, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    far = b.column("norm").to_numpy()[:, None] - 2 * _lists(b.column("dots"), len(squares)) + squares
    cluster = far.argmin(axis=1)  # the first of equal ones
    return cluster, far[np.arange(len(far)), cluster]


def means(matrix: Matrix) -> np.ndarray:
    """The next centroids: floor of the mean of each one's vectors; one without vectors stays."""
    k, size = matrix.centroids.shape
    squares = (matrix.centroids**2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for b in batches:
            cluster, _ = _nearest(b, squares)
            np.add.at(total, cluster, _lists(b.column("v"), size))
            count += np.bincount(cluster, minlength=k)
        used = np.flatnonzero(count)
        place = (used[:, None] * size + np.arange(size)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total[used].ravel()), pa.array(np.repeat(count[used], size))], ["place", "total", "n"])

    sums = matrix.rows.mapInArrow(run, "place long, total long, n long").groupBy("place")
    out = matrix.centroids.copy()
    for place, total, n in sums.agg(F.sum(F.col("total").cast("decimal(38,0)")), F.sum("n")).collect():  # k * size rows
        out[place // size, place % size] = int(total) // n
    return out


def assign(matrix: Matrix) -> DataFrame:
    """``vec_id, cluster, distance``."""
    squares = (matrix.centroids**2).sum(axis=1)
    kind = matrix.rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cluster, far = _nearest(b, squares)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"])

    return matrix.rows.select("vec_id", "norm", "dots").mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def _summary(spark: SparkSession, found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``cluster, cluster_inertia, inertia, centroid_sha256``: a row per centroid in use."""
    sums = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    rows = [(j, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, s in sums.items()]
    return spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of ``vec_id, v``:
    ``rounds`` of assigning and moving, then one more assignment."""
    spark = vectors.sparkSession
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    matrix = start(vectors, centroids)
    for _ in range(rounds):
        matrix = moved(matrix, means(matrix))
    found = assign(matrix)
    # a row per centroid: at most k
    return found.join(F.broadcast(_summary(spark, found, matrix.centroids)), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
