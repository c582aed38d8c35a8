"""Toxic passages by maximum-scoring segments, calibrated by extreme values.

*Words* are runs of letters, digits and bytes above 127, ASCII and Latin-1 letters lower-cased.  A word's
*log-odds* compare the labelled documents that hold it: its toxic share has a Dirichlet (here Beta) prior
centred on the share of its prefix of seven bytes, that one on the prefix of six, and so on to three and
to the share of toxic documents.  Words not seen take the value of their longest known prefix.

A token scores its log-odds less ``DRIFT``, so that ordinary text falls.  A scan (Ruzzo and Tompa) finds
all maximal-scoring segments of a text in time linear in its words.  Scores of clean documents give the
Karlin-Altschul parameters: lambda, the positive root of E[exp(lambda * s)] = 1, and K, from the mean of
the best segments, whose normalised score ``lambda * S - ln(K * n)`` follows a Gumbel law.  Segments whose
expected number by chance, ``exp(-normalised)``, is at most ``SIGNIFICANT`` are passages.  A document's score is a
logistic function of its best normalised score and of the sum over its passages.

Training takes at most about ``sample_per_label`` documents of each label, drawn by a hash of the id, and keeps the
``MAX_UNITS`` words and prefixes in most of them: the model is broadcast and is at most 12 bytes a unit.
Calibration is cross-fitted: each half of the sample is scored with the counts of the other.  Scoring is
one pass without a shuffle; texts are handled in slices of about a megabyte, a long text whole.

A null or empty text has no words: it has the score of a text without evidence.  With no labelled row
every score is 0; with one label only, all scores are the smoothed share of toxic rows.  Repeated rows
get equal values.  Rows whose label is not 0 or 1, or null, teach nothing.  ``keep`` names the columns that
pass; the others are ignored.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewater.llm.shared import parts, row_of, slices, span_hash, utf8

PREFIXES = (3, 4, 5, 6, 7)
STRENGTH = 4.0
DRIFT = 1.0
SIGNIFICANT = 0.05
LEAST_DOCUMENTS = 2
MAX_UNITS = 400_000
#: Scores are rounded to this for the histogram of clean tokens, and cut at the ends.
STEP, TOP = 0.05, 12.0
_EULER = 0.5772156649015329

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Words:
    """Words of some texts: ``data[start[i]:end[i]]`` is a word of text ``row[i]``; byte offsets are those of the text."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8).copy()
        upper = (data >= 65) & (data <= 90)
        before = np.concatenate(([0], data[:-1]))
        upper |= (before == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
        data[upper] |= 0x20
        inside = _LETTER[data]
        # Latin-1 and general punctuation: C2 80..BF, E2 80..81 xx, E3 80 xx
        lead2 = np.flatnonzero(data == 0xC2)
        after = np.append(data[1:], 0)
        lead3 = np.flatnonzero(((data == 0xE2) & ((after == 0x80) | (after == 0x81))) | ((data == 0xE3) & (after == 0x80)))
        for at, size in ((lead2, 2), (lead3, 3)):
            for k in range(size):
                inside[np.minimum(at + k, len(data) - 1)] = False
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
        self.data, self.start, self.end = data, edge[0::2], edge[1::2]
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.offset = np.concatenate(([0], np.cumsum(lengths)))
        self.row = np.searchsorted(self.offset, self.start, "right") - 1
        self.count = np.bincount(self.row, minlength=len(texts))

    def units(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """From the shortest prefix to the whole word: which words are long enough, and their hashes."""
        size = self.end - self.start
        for k in PREFIXES:
            at = np.flatnonzero(size >= k)
            yield at, _salted(span_hash(self.data, self.start[at], self.start[at] + k), k)
        yield np.arange(len(size)), _salted(span_hash(self.data, self.start, self.end), 0)


def _salted(h: np.ndarray, kind: int) -> np.ndarray:
    return (h ^ np.uint64(0x9E3779B97F4A7C15 * (kind + 1) & (1 << 64) - 1)).view(np.int64)


@dataclass
class Model:
    """``unit``: sorted hashes, ``logodds`` of each; ``weight``: of 1, the best and the summed normalised score."""

    unit: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    logodds: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    scale: float = 1.0
    log_k: float = 0.0
    weight: tuple[float, ...] | None = None
    constant: float = 0.0


def token_scores(words: Words, model: Model) -> np.ndarray:
    """Log-odds of each word, by its longest known unit, less the drift."""
    out = np.zeros(len(words.start), np.float32)
    if len(model.unit):
        for at, h in words.units():
            place = np.minimum(np.searchsorted(model.unit, h), len(model.unit) - 1)
            known = model.unit[place] == h
            out[at[known]] = model.logodds[place[known]]
    return out - np.float32(DRIFT)


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last + 1, score) of a sequence, in order.

    Runs of positive scores are taken as one, so the loop is over these; each segment is put on and off the
    list at most once, and its pointer to an earlier one with a smaller left sum is followed, not searched."""
    up = score > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], up, [False])).astype(np.int8)))
    if not len(edge):
        return []
    total = np.concatenate(([0.0], np.cumsum(score, dtype=np.float64)))
    held: list[tuple[int, int, float, float, int]] = []  # first, end, left, right, nearest earlier with a smaller left
    for first, end in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
        left, right = total[first], total[end]
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= left:
                j = held[j][4]
            if j < 0 or held[j][3] >= right:
                break
            first, left = held[j][0], held[j][2]
            del held[j:]
        held.append((first, end, left, right, j))
    return [(a, b, right - left) for a, b, left, right, _ in held]


def _per_text(words: Words, score: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int, float]]]]:
    """Of each text: its first word, its number of words, and its segments, with word numbers from its first."""
    first = np.cumsum(words.count) - words.count
    for a, n in zip(first.tolist(), words.count.tolist(), strict=True):
        yield a, n, maximal_segments(score[a : a + n])


def _features(segments: list[tuple[int, int, float]], n: int, model: Model) -> tuple[float, float, list[float]]:
    """Best normalised score, log of one and the sum over significant ones, and all normalised scores."""
    chance = model.log_k + np.log(n) if n else 0.0
    normal = [model.scale * s - chance for _, _, s in segments]
    best = max(normal, default=-5.0)
    kept = sum(x for x in normal if x >= -np.log(SIGNIFICANT))
    return float(np.clip(best, -5.0, 40.0)), float(np.log1p(kept)), normal


# ---------------------------------------------------------------- training


def _table(units: np.ndarray, parent: np.ndarray, kind: np.ndarray, toxic: np.ndarray, clean: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted unit hashes and log-odds: each unit's toxic share is drawn to that of its prefix."""
    order = np.argsort(units)
    units, parent, kind, toxic, clean = units[order], parent[order], kind[order], toxic[order], clean[order]
    share = np.full(len(units), base)
    for k in (*PREFIXES, 0):
        at = np.flatnonzero(kind == k)
        if not len(at):
            continue
        place = np.minimum(np.searchsorted(units, parent[at]), len(units) - 1)
        prior = np.where(units[place] == parent[at], share[place], base)
        share[at] = (toxic[at] + STRENGTH * prior) / (toxic[at] + clean[at] + STRENGTH)
    logit = np.log(share / (1 - share)) - np.log(base / (1 - base))
    return units, logit.astype(np.float32)


_UNITS = "unit long, parent long, kind int, t0 long, c0 long, t1 long, c1 long"


def _unit_counts(sample: DataFrame, max_units: int) -> dict[str, np.ndarray]:
    """Documents of each label and half that hold each unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in parts(whole)):
            texts = utf8(b.column(0))
            group = b.column(2).to_numpy().astype(np.int64) * 2 + (1 - b.column(1).to_numpy())
            for lo, hi in slices(texts):
                w = Words(texts[lo:hi])
                before = np.zeros(len(w.start), np.int64)
                for kind, (at, h) in zip((*PREFIXES, 0), w.units(), strict=True):
                    if len(at):
                        # a document counts once for each of its units
                        pair = np.unique(np.stack([h, before[at], w.row[at]]), axis=1)
                        key, place = np.unique(pair[0], return_index=True)
                        n = np.bincount(np.searchsorted(key, pair[0]) * 4 + group[lo:hi][pair[2]], minlength=4 * len(key)).reshape(-1, 4)
                        made = [key, pair[1][place], np.full(len(key), kind, np.int32), *(np.ascontiguousarray(n[:, j]) for j in range(4))]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], [c.split()[0] for c in _UNITS.split(", ")])
                    before[at] = h

    counts = sample.mapInArrow(run, _UNITS).groupBy("unit").agg(F.first("parent").alias("parent"), F.first("kind").alias("kind"), *[F.sum(c).alias(c) for c in ("t0", "c0", "t1", "c1")])
    size = F.col("t0") + F.col("c0") + F.col("t1") + F.col("c1")
    table = counts.where(size >= LEAST_DOCUMENTS).orderBy(size.desc(), "kind", "unit").limit(max_units).toArrow()
    return {c: table[c].to_numpy() for c in table.column_names}


def _scored_sample(sample: DataFrame, models: list[Model], limit: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Histogram of clean tokens, and each document's label, half, words and best segments, from the other half's model."""
    shared = sample.sparkSession.sparkContext.broadcast(models)
    bins = int(2 * TOP / STEP) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        histogram = np.zeros(bins, np.int64)
        for b in (p for whole in batches for p in parts(whole)):
            texts, toxic, half = utf8(b.column(0)), b.column(1).to_numpy(), b.column(2).to_numpy()
            for lo, hi in slices(texts):
                w = Words(texts[lo:hi])
                both = [token_scores(w, m) for m in shared.value]
                score = np.where(half[lo:hi][w.row] == 0, both[1], both[0])  # the other half's
                mine = score[toxic[lo:hi][w.row] == 0]
                histogram += np.bincount(np.clip(np.rint((mine + TOP) / STEP), 0, bins - 1).astype(np.int64), minlength=bins)
                found = [(n, [s for _, _, s in segments]) for _, n, segments in _per_text(w, score)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(toxic[lo:hi].astype(np.int64)), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.list_(pa.float64()))], ["k", "n", "scores"]
                )
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(bins) + 2), pa.array(histogram), pa.array([None] * bins, pa.list_(pa.float64()))], ["k", "n", "scores"])

    found = sample.mapInArrow(run, "k long, n long, scores array<double>")
    documents = found.where("k < 2").limit(limit).toArrow()
    tokens = found.where("k >= 2").groupBy("k").agg(F.sum("n")).collect()
    histogram = np.zeros(bins)
    for k, n in tokens:
        histogram[k - 2] = n
    return histogram, {"toxic": documents["k"].to_numpy(), "n": documents["n"].to_numpy(), "scores": documents["scores"].to_pylist()}


def extreme_scale(histogram: np.ndarray) -> float:
    """The positive root of E[exp(lambda * s)] = 1, by bisection; 1 where scores have no positive part or no drift."""
    s = np.arange(len(histogram)) * STEP - TOP
    p = histogram / max(histogram.sum(), 1)
    if not histogram.sum() or (p * s).sum() >= 0 or not p[s > STEP / 2].sum():
        return 1.0
    lo, hi = 1e-6, 20.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (p * np.exp(np.minimum(mid * s, 500))).sum() > 1 else (mid, hi)
    return float(lo)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights by Newton's method."""
    w = np.zeros(x.shape[1])
    keep = np.eye(x.shape[1]) * ridge
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + keep @ w
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep, gradient)
    return w


def draw_labels(labels: DataFrame, sample_per_label: int = 6000) -> tuple[DataFrame, dict[int, int]]:
    """About ``sample_per_label`` rows of each label of ``doc_id, toxic``, and the sizes of the labels: what is drawn is
    small enough to be broadcast to the documents, so that no text is shuffled."""
    labels = labels.where(F.col("toxic").isin(0, 1)).withColumn("toxic", F.col("toxic").cast("int"))
    sizes = {r[0]: r[1] for r in labels.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, sample_per_label / sizes.get(1, 1)).otherwise(sample_per_label / sizes.get(0, 1))
    return labels.where(F.xxhash64(F.lit("toxicity"), "doc_id").cast("double") / float(1 << 64) + 0.5 < share), sizes


def fit(rows: DataFrame, sample_per_label: int = 6000, max_units: int = MAX_UNITS, sizes: dict[int, int] | None = None) -> Model:
    """From ``doc_id, text, toxic``: all rows, or with ``sizes`` those drawn by ``draw_labels``."""
    if sizes is None:
        rows, sizes = draw_labels(rows, sample_per_label)
    if len(sizes) < 2:
        return Model(constant=sizes.get(1, 0) / (sum(sizes.values()) + 1))
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int")
    sample = rows.select(F.col("text").cast("string"), F.col("toxic").cast("int"), half.alias("half"))
    counts = _unit_counts(sample, max_units)
    base = min(max(min(sizes[1], sample_per_label) / (min(sizes[1], sample_per_label) + min(sizes[0], sample_per_label)), 1e-3), 1 - 1e-3)

    def table(*halves: int) -> Model:
        toxic, clean = (sum(counts[f"{c}{i}"] for i in halves) for c in "tc")
        return Model(*_table(counts["unit"], counts["parent"], counts["kind"], toxic, clean, base)) if len(counts["unit"]) else Model()

    histogram, found = _scored_sample(sample, [table(0), table(1)], 4 * sample_per_label)
    if not len(found["n"]):
        return Model()
    model = table(0, 1)
    model.scale = extreme_scale(histogram)
    clean = [(max(s), n) for t, n, s in zip(found["toxic"], found["n"], found["scores"], strict=True) if t == 0 and s]
    # the mean of a Gumbel law of location ln K is ln K + Euler's number; the median is used since some labels are wrong
    model.log_k = float(np.median([model.scale * s - np.log(n) for s, n in clean]) + np.log(np.log(2))) if clean else 0.0
    x = np.array([(1.0, *_features([(0, 0, v) for v in s], n, model)[:2]) for n, s in zip(found["n"], found["scores"], strict=True)])
    # back to the share of toxic documents among all, which the sample may have changed
    w = _logistic(x, found["toxic"].astype(float))
    w[0] += np.log(sizes[1] / sizes[0]) - np.log(base / (1 - base))
    model.weight = tuple(w.tolist())
    return model


# ---------------------------------------------------------------- scoring

PASSAGE = "struct<start:int,end:int,score:double,expected:double>"


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``score``, ``predicted`` and ``passages``: bytes from ``start`` to ``end`` of
    the text, the segment's score, and how many of its kind a clean text of this length would have by chance."""
    made = ("score", "predicted", "passages")
    names = [c for c in keep if c not in made]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    row = docs.select(row_of(names), F.col("text").cast("string").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in (p for whole in batches for p in parts(whole)):
            texts, value, passages = utf8(b.column(1)), [], []
            for lo, hi in slices(texts):
                w = Words(texts[lo:hi])
                if m.weight is None:
                    value += [m.constant] * (hi - lo)
                    passages += [[]] * (hi - lo)
                    continue
                for i, (a, n, segments) in enumerate(_per_text(w, token_scores(w, m))):
                    best, total, normal = _features(segments, n, m)
                    z = m.weight[0] + m.weight[1] * best + m.weight[2] * total
                    value.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
                    base = w.offset[i]
                    passages.append(
                        [{"start": int(w.start[a + f] - base), "end": int(w.end[a + e - 1] - base), "score": s, "expected": float(np.exp(-x))} for (f, e, s), x in zip(segments, normal, strict=True) if x >= -np.log(SIGNIFICANT)]
                    )
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(value, pa.float64()), pa.array([int(v >= 0.5) for v in value], pa.int32()), pa.array(passages, kind)], ["row", *made])

    schema = StructType([row.schema["row"], *StructType.fromDDL(f"score double, predicted int, passages array<{PASSAGE}>")])
    return row.mapInArrow(run, schema).select("row.*", *made)
