"""Exact top-k by inner product over an index of pivots and distances.

Vectors are moved by their mean, which changes all scores of a query alike, and augmented by one
coordinate, sqrt(M^2 - |x|^2) with M the largest norm, which turns the largest inner products into the
smallest Euclidean distances.  Each vector is keyed by its nearest pivot and its distance from it;
sorted by that key, runs of at most ``block`` vectors of one pivot are *annuli*, with a least and a
largest distance from every pivot.  By the triangle inequality a query at distance D from a pivot is no
closer to a member of the annulus than max(D - largest, least - D), for each of the pivots.

A query first visits the annuli of the least bounds (``seeds``), which gives its k-th score so far;
it then expands to exactly those other annuli whose bound does not exclude a better or equal score.
Annuli are the unit of work: their vectors and the queries that visit them meet in one task, which
holds one annulus at a time, scores it ``SCORED`` members at a time and streams the queries past it.  A
vector that a third of all rows repeat fills many annuli, dealt by range, not one task.

Pivots are a sample of at most ``pivots`` vectors; the directory of annuli has at most about
``MAX_ANNULI + pivots`` entries of two numbers a pivot (annuli grow with the table), so both are broadcast.

Nulls: a row whose id or vector is null, or that holds a null or non-finite component, takes no
part.  Shorter vectors count as padded with zeros.  Rows with a query's id are its own; repeated
query rows with equal vectors give one result.  Repeated candidate rows stay rows of their own: an
id that occurs twice can take two of the k places, as in a join.  Ties go to the smaller id.  Scores
are exact below 2**53.  Other columns are ignored.  Empty tables give no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import settled

BLOCK = 256
MAX_ANNULI = 32768
SCORED = 4096
_PACK = 16  # queries sent in one row


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of every finite component, rows that take part only."""
    v = F.col(vector_col)
    # NaN fails the comparison with itself in IEEE terms but not in Spark's, so it is named
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    kept = rows.where(F.col(id_col).isNotNull() & v.isNotNull() & ~bad)
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix, padded with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(column.offsets.to_numpy(zero_copy_only=False))
    if len(size) and (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _distances(vectors: np.ndarray, last: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of (vector, last coordinate) from augmented pivots."""
    square = (vectors**2).sum(1)[:, None] + (last**2)[:, None] + (pivots**2).sum(1)[None, :]
    cross = vectors @ pivots[:, :-1].T + last[:, None] * pivots[None, :, -1]
    return np.sqrt(np.maximum(square - 2 * cross, 0.0))


class Index:
    """``vectors``: table annulus, vec_id, v (settled); the directory (annulus, and by pivot least and
    most), the pivots and the mean are arrays."""

    def __init__(self, vectors: DataFrame, width: int, longest: float, pivots: np.ndarray, mean: np.ndarray, directory: dict[str, np.ndarray]):
        self.vectors, self.width, self.longest, self.pivots, self.mean, self.directory = vectors, width, longest, pivots, mean, directory


def build_index(vectors: DataFrame, pivots: int = 64, block: int = BLOCK) -> Index:
    """The index of ``vec_id, v``; every row is in it."""
    spark = vectors.sparkSession
    vectors = settled(vectors, "topk-vectors")
    n, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return Index(vectors, 0, 0.0, np.zeros((0, 1)), np.zeros(0), {k: np.zeros((0, 0)) for k in ("annulus", "least", "most")})
    block = max(block, -(-n // MAX_ANNULI))
    total = vectors.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    mean = np.zeros(width)
    mean[total["i"].to_numpy()] = total["x"].to_numpy() / n

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([float(((_matrix(b.column(0), width) - mean) ** 2).sum(1).max(initial=0.0))])], ["s"])

    longest = float(np.sqrt(vectors.select("v").mapInArrow(squares, "s double").agg(F.max("s")).first()[0])) * (1 + 1e-12)
    hashed = F.xxhash64("v")  # one vector of each residue of the hash: distinct ones, combined before the shuffle
    sample = vectors.groupBy(F.pmod(hashed, F.lit(pivots)).alias("r")).agg(F.min_by("v", F.struct(hashed, "v")).alias("v")).orderBy("r").toArrow()["v"].combine_chunks()
    chosen = _matrix(sample, width) - mean
    chosen = np.concatenate([chosen, np.sqrt(np.maximum(longest**2 - (chosen**2).sum(1), 0))[:, None]], axis=1)
    shared = spark.sparkContext.broadcast((chosen, mean))

    def from_pivots(column: pa.Array) -> np.ndarray:
        pivots_, mean_ = shared.value
        v = _matrix(column, width) - mean_
        return _distances(v, np.sqrt(np.maximum(longest**2 - (v**2).sum(1), 0)), pivots_)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = from_pivots(b.column(1))
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near]), b.column(0), b.column(1)], ["pivot", "distance", "vec_id", "v"])

    def annuli(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        last, members = None, 0
        for b in batches:
            pivot = b.column(0).to_numpy(zero_copy_only=False)
            mine = np.empty(b.num_rows, np.int64)
            for i, p in enumerate(pivot.tolist()):
                if p != last or members == block:
                    number, last, members = number + 1, p, 0
                mine[i] = number
                members += 1
            yield pa.RecordBatch.from_arrays([pa.array(mine), *b.columns], ["annulus", *b.schema.names])

    keyed = vectors.mapInArrow(key, "pivot int, distance double, vec_id long, v array<double>")
    ranged = keyed.repartitionByRange(max(1, min(-(-n // (4 * block)), 4096)), "pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id")
    stored = settled(ranged.mapInArrow(annuli, "annulus long, pivot int, distance double, vec_id long, v array<double>"), "topk-index")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Least and largest distances of the runs of annuli."""
        for b in batches:
            if b.num_rows:
                annulus, d = b.column(0).to_numpy(zero_copy_only=False), from_pivots(b.column(1))
                first = np.flatnonzero(np.concatenate(([True], annulus[1:] != annulus[:-1])))
                sides = [np.minimum.reduceat(d, first, axis=0), np.maximum.reduceat(d, first, axis=0)]
                offsets = pa.array(np.arange(0, len(first) * len(d[0]) + 1, len(d[0]), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(annulus[first]), *[pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in sides]], ["annulus", "least", "most"])

    found = stored.select("annulus", "v").mapInArrow(ranges, "annulus long, least array<double>, most array<double>").toArrow().combine_chunks()
    name, of = np.unique(found["annulus"].to_numpy(), return_inverse=True)
    directory = {"annulus": name, "least": np.full((len(name), len(chosen)), np.inf), "most": np.zeros((len(name), len(chosen)))}
    for k, take in (("least", np.minimum), ("most", np.maximum)):
        take.at(directory[k], of, _matrix(found[k].combine_chunks(), len(chosen)))
    return Index(stored.select("annulus", "vec_id", "v"), width, longest, chosen, mean, {k: v.astype(np.float32) if k != "annulus" else v for k, v in directory.items()})


def _bounds(index: dict, v: np.ndarray) -> np.ndarray:
    """No member of an annulus (column) is closer to a query (row) than this."""
    d = _distances(v, np.zeros(len(v)), index["pivots"]).astype(np.float32)
    out = np.zeros((len(v), len(index["annulus"])), np.float32)
    for p in range(d.shape[1]):
        np.maximum(out, d[:, p, None] - index["most"][None, :, p], out=out)
        np.maximum(out, index["least"][None, :, p] - d[:, p, None], out=out)
    return out


_VISIT = "annulus long, queries array<long>, own array<long>, floors array<double>, qv array<double>"


def _visits(queries: DataFrame, index: Index, seeds: int, expand: bool) -> DataFrame:
    """Rows that send up to 16 queries to an annulus.  First the ``seeds`` of the least bounds; to
    ``expand``, all others whose bound does not exclude a score of at least the query's floor."""
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast({**index.directory, "pivots": index.pivots, "mean": index.mean})
    width, longest = index.width, index.longest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                uid, own, v = (part.column(i).to_numpy(zero_copy_only=False) if i < 2 else _matrix(part.column(i), width) for i in range(3))
                floor = np.array([-np.inf if x is None else x for x in part.column(3).to_pylist()])
                norm = np.sqrt((v**2).sum(1))
                scale = np.where(norm > 0, longest / np.maximum(norm, 1e-300), 1.0)  # keeps the order, and puts the query on the sphere
                bound = _bounds(d, v * scale[:, None])
                first = np.argsort(bound, axis=1, kind="stable")[:, :seeds]
                chosen = np.zeros(bound.shape, bool)
                np.put_along_axis(chosen, first, True, axis=1)
                if expand:
                    # what scores s has the product s - q mean with q, and is at squared distance |q|^2 + M^2 - 2 (s - q mean)
                    reach = np.sqrt(np.maximum((norm * scale) ** 2 + longest**2 - 2 * scale * (floor - v @ d["mean"]), 0.0)) * (1 + 1e-5) + 1e-3
                    chosen = ~chosen & (bound <= reach[:, None])
                rows = []
                for a in np.flatnonzero(chosen.any(axis=0)).tolist():
                    at = np.flatnonzero(chosen[:, a])
                    for k in range(0, len(at), _PACK):
                        some = at[k : k + _PACK]
                        rows.append((int(d["annulus"][a]), uid[some].tolist(), own[some].tolist(), floor[some].tolist(), v[some].ravel()))
                    if len(rows) >= 2048:
                        yield packed(rows)
                        rows = []
                if rows:
                    yield packed(rows)

    def packed(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["annulus", "queries", "own", "floors", "qv"])

    return queries.select("uid", "query_id", "v", "floor").mapInArrow(run, _VISIT)


def _scored(visits: DataFrame, index: Index, k: int) -> DataFrame:
    """``uid, vec_id, score`` and the row's ``annulus`` and ``place`` in it: of every visit, the k best
    of the annulus that reach the floor."""
    width = index.width
    data = index.vectors.select("annulus", F.lit(0).alias("kind"), "vec_id", "v", *[F.lit(None).cast(t).alias(c) for c, t in (("queries", "array<long>"), ("own", "array<long>"), ("floors", "array<double>"))])
    asked = visits.select("annulus", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("vec_id"), F.col("qv").alias("v"), "queries", "own", "floors")
    both = data.unionByName(asked).repartition("annulus").sortWithinPartitions("annulus", "kind", "vec_id", "v")

    def best(here: int, all_ids: np.ndarray, v: np.ndarray, b: pa.RecordBatch, rows: list[int]) -> Iterator[pa.RecordBatch]:
        uid = np.concatenate([np.array(b.column(4)[i].as_py(), np.int64) for i in rows])
        own = np.concatenate([np.array(b.column(5)[i].as_py(), np.int64) for i in rows])
        floor = np.concatenate([np.array(b.column(6)[i].as_py(), np.float64) for i in rows])
        q = np.concatenate([b.column(3)[i].values.to_numpy(zero_copy_only=False).reshape(-1, width) for i in rows])
        for lo, at0 in itertools.product(range(0, len(uid), 512), range(0, len(all_ids), SCORED)):
            ids = all_ids[at0 : at0 + SCORED]
            score = q[lo : lo + 512] @ v[at0 : at0 + SCORED].T
            score[own[lo : lo + 512, None] == ids[None, :]] = -np.inf
            m = min(k, len(ids))
            order = np.argsort(-score, axis=1, kind="stable")[:, :m]  # members are in the order of their ids
            top = np.take_along_axis(score, order, axis=1)
            good = (top >= floor[lo : lo + 512, None]) & (top > -np.inf)
            at, j = np.nonzero(good)
            if len(at):
                place = order[at, j]
                made = [uid[lo + at], ids[place], top[at, j].astype(np.int64), np.full(len(at), here, np.int64), at0 + place.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["uid", "vec_id", "score", "annulus", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, parts, v = None, [], [], None
        for b in batches:
            annulus, kind = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate(([True], (annulus[1:] != annulus[:-1]) | (kind[1:] != kind[:-1]))))
            for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), b.num_rows], strict=True):
                if annulus[s] != here:
                    here, ids, parts, v = annulus[s], [], [], None
                if kind[s] == 0:
                    ids.append(b.column(2).slice(s, e - s).to_numpy(zero_copy_only=False))
                    parts.append(_matrix(b.column(3).slice(s, e - s), width))
                elif ids:
                    if v is None:
                        v, ids = np.concatenate(parts), [np.concatenate(ids)]
                    for lo in range(s, e, 64):
                        yield from best(here, ids[0], v, b, list(range(lo, min(lo + 64, e))))

    return both.mapInArrow(run, "uid long, vec_id long, score long, annulus long, place long")


def _first_k(scored: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc("vec_id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = 64, block: int = BLOCK, seeds: int = 2) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows of every row that ``is_query``."""
    index = build_index(vectors, pivots, block)
    spark = vectors.sparkSession
    if not index.width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    queries = index.vectors.where(is_query).select(F.xxhash64("vec_id", "v").alias("uid"), F.col("vec_id").alias("query_id"), "v").distinct()
    queries = settled(queries, "topk-queries")
    start = queries.withColumn("floor", F.lit(None).cast("double"))
    seeded = settled(_first_k(_scored(_visits(start, index, seeds, False), index, k), k).drop("rank"), "topk-seeds")
    floors = seeded.groupBy("uid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("floor"))
    again = queries.join(floors, "uid", "left")
    rest = _scored(_visits(again, index, seeds, True), index, k)
    found = _first_k(seeded.unionByName(rest).distinct(), k)
    return found.join(queries.select("uid", "query_id"), "uid").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
