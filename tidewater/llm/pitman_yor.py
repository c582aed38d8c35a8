"""Language-model scoring with a hierarchical Pitman-Yor model over words.

Hierarchy: a uniform base over the V training words and one unseen word; one unigram restaurant,
the parent; and below it one restaurant per *context*, the preceding word.  Words that are among the
``contexts`` most frequent (a bound, since what belongs to a context is broadcast) name a context of
their own; the others share one per class of their last byte, and the start of a text is one.  All
context restaurants share the parent.  Every training document and every pair of words is counted.

Seating: a dish's customers in a restaurant sit at 1..c tables; the number of tables is what the
predictive rule needs.  Its full conditional is proportional to S(c, t) * fresh**t, S the generalised
Stirling numbers: up to ``DIRECT`` customers it is drawn from directly, beyond that by ``MOVES``
Metropolis steps per sweep which leave it unchanged; S is exact up to ``TABLE`` customers, and beyond
that summed as a series or by its saddle point, to about 1e-4.  A table in a context restaurant is a
customer of the parent, so a sweep redraws the contexts of every word (odd ones, then even ones) and
then the parent's tables.  Words are independent given the restaurants' totals, so Spark deals the
words out and totals are renewed between rounds.  Draws follow from the word, context, sweep and seed
alone.  The predictive probabilities are averages over the kept sweeps, and sum to one in every context.

Counting and scoring send, per slice of text, the contexts of every rarer word, and those of the words
with a context of their own in packed pieces, dealt by word into parts whose number grows with the tokens;
words with more tokens than a quarter of a part are dealt by context as well, so no word is one task.
What is held of a word is at most a count per context.

Nulls and empty texts: no word, one end token.  A null ``doc_id`` is in the training part.
Repeated rows are counted and scored one by one.  Other columns are ignored.  With no training
row every token has the unseen word's probability, 1; an empty table gives no rows.  Words are told
apart by their bytes.  Very long texts: a slice holds at least one whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import Spans, parts, settled, utf8

DIRECT, TABLE, MOVES = 48, 1024, 8
PART_TOKENS, LEAST_PARTS = 1 << 22, 256
SLICE_BYTES, SLICE_ROWS, CHUNK_TOKENS = 5 << 20, 1 << 16, 1 << 20
#: Classes of the last byte of rarer words; 0 is the start of a text.
_MARKS = b".,|!#$%&*?"
CLASSES = 2 + 26 + len(_MARKS) + 2


def _classes() -> np.ndarray:
    kind = np.full(256, 1, np.int64)  # other ASCII
    kind[128:] = CLASSES - 1
    kind[ord("0") : ord("9") + 1] = CLASSES - 2
    kind[ord("a") : ord("z") + 1] = 2 + np.arange(26)
    kind[list(_MARKS)] = 28 + np.arange(len(_MARKS))
    return kind


_CLASS = _classes()
_INSIDE = np.ones(256, bool)
_INSIDE[[9, 10, 11, 12, 13, 32]] = False


# ---------------------------------------------------------------- tokens


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a column, lower-cased, by the slice, and the number of rows before it."""
    held: list[bytes] = []
    size = before = 0
    for b in (p for whole in batches for p in parts(whole)):
        for t in utf8(b.column(column)):
            if held and (size + len(t) > SLICE_BYTES or len(held) == SLICE_ROWS):
                yield before, held
                before, held, size = before + len(held), [], 0
            held.append(t.lower())
            size += len(t)
    if held:
        yield before, held


def _encoded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Per word its text and its place in the array of distinct words."""
    s = Spans(texts)
    offsets = np.concatenate(([0], np.cumsum(s.end - s.start))).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s.start), [None, pa.py_buffer(offsets), pa.py_buffer(s.data[_INSIDE[s.data]])]).dictionary_encode()
    return s.row, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.cast(pa.binary())


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the values of a binary column, and their bytes."""
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    if not len(column) or bounds[-1] == bounds[0]:
        return np.zeros(len(column) + 1, np.int32), np.zeros(0, np.uint8)
    return bounds - bounds[0], np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]


class Contexts:
    """What names a restaurant: the words that have one of their own, the most frequent first.  Their
    entries are dealt into ``parts``, those of the first ``hot`` by context as well."""

    def __init__(self, words: pa.Array, parts: int = LEAST_PARTS, hot: int = 0):
        self.words, self.parts, self.hot = words.cast(pa.binary()), parts, hot
        self.size = len(words) + CLASSES

    def part(self, rank: np.ndarray, context: np.ndarray) -> np.ndarray:
        return np.where(rank < self.hot, rank + context, rank) % self.parts

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rank of every word (-1: none of its own), and the context that it is to the next word."""
        rank = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        bounds, data = _binary(words)
        last = np.zeros(len(words), np.int64)
        some = np.flatnonzero(np.diff(bounds))
        last[some] = data[bounds[some + 1] - 1]
        return rank, np.where(rank < 0, len(self.words) + _CLASS[last], rank)


def _entries_of(texts: list[bytes], contexts: Contexts, by_row: bool) -> Iterator[tuple]:
    """Distinct words, and per entry in order: group, word's place, rank, context, text (0 unless
    ``by_row``) and count.  The group is the part of a word with a context of its own, else
    the number of parts + the word's place.  The end token is the empty word."""
    row, code, words = _encoded(texts)
    words = pa.concat_arrays([words, pa.array([b""], pa.binary())])
    rank, context = contexts.of(words)
    start, first = len(contexts.words), np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    before = np.where(first, start, context[np.concatenate((code[:1], code[:-1]))])
    closing = np.full(len(texts), start)
    closing[row] = context[code]  # the last word of a text is assigned last
    row, code, ctx = np.concatenate([row, np.arange(len(texts))]), np.concatenate([code, np.full(len(texts), len(words) - 1)]), np.concatenate([before, closing])
    for lo in range(0, len(row), CHUNK_TOKENS):
        r, k, g = row[lo : lo + CHUNK_TOKENS] * by_row, code[lo : lo + CHUNK_TOKENS], ctx[lo : lo + CHUNK_TOKENS]
        low, high = contexts.size.bit_length(), contexts.size.bit_length() + int(r.max()).bit_length()
        entry, n = np.unique(k << high | r << low | g, return_counts=True)
        k, r, g = entry >> high, entry >> low & (1 << high - low) - 1, entry & (1 << low) - 1
        mine = rank[k]
        group = np.where(mine < 0, contexts.parts + k, contexts.part(mine, g))
        order = np.argsort(group, kind="stable")
        yield words, group[order], k[order], mine[order], g[order], r[order], n[order]


def _pieces(found: tuple, parts: int, kinds: tuple[type, ...]) -> tuple[list[str], list[bytes]]:
    """Keys and packed (rank, context, ...) arrays of the entries of words with a context of their own."""
    _, group, _, rank, g, r, n = found
    most = int(np.searchsorted(group, parts))
    begin = np.flatnonzero(np.concatenate(([True], group[1:most] != group[: most - 1]))) if most else np.zeros(0, np.int64)
    columns = [x[:most].astype(kind) for x, kind in zip((rank, g, n, r), kinds, strict=False)]
    bounds = [*begin.tolist(), most]
    return [_part_key(p) for p in group[begin].tolist()], [_packed([x[lo:hi] for x in columns]) for lo, hi in zip(bounds, bounds[1:], strict=False)]


def _rest(found: tuple, parts: int, by_row: bool) -> tuple[pa.Array, pa.Array]:
    """Rarer words, and of each its entries' contexts, counts and (if ``by_row``) texts."""
    words, group, k, _, g, r, n = found
    lo = int(np.searchsorted(group, parts))
    k = k[lo:]
    begin = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    columns = (g[lo:], n[lo:], r[lo:]) if by_row else (g[lo:], n[lo:])
    return words.take(pa.array(k[begin])).cast(pa.string()), _rows(np.append(begin, len(k)), *columns)


def _rows(bounds: np.ndarray, *columns: np.ndarray) -> pa.Array:
    """Binary values that hold the rows of some columns, four bytes a number, from bound to bound."""
    data = np.stack([x if x.dtype == np.int32 else x.view(np.int32) if x.dtype == np.float32 else x.astype(np.int32) for x in columns], 1)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * (4 * len(columns))).astype(np.int32)), pa.py_buffer(data)])


def _numbers(column: pa.Array, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """What ``_rows`` packed: of each row the place of its value, and the columns, all as int32."""
    bounds, data = _binary(column)
    table = np.frombuffer(data.tobytes(), np.int32).reshape(-1, width)
    return np.repeat(np.arange(len(column)), np.diff(bounds) // (4 * width)), [np.ascontiguousarray(x) for x in table.T]


def _packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays of one length, byte planes apart, compressed."""
    planes = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays)
    return zstandard.compress(planes, 1)


def _unpacked(blob: bytes, kinds: tuple[type, ...]) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n = len(planes) // sum(sizes)
    cuts = np.split(planes, np.cumsum(sizes)[:-1] * n)
    return [np.ascontiguousarray(c.reshape(size, n).T).view(kind).ravel().astype(np.float64 if kind is np.float64 else np.int64) for c, size, kind in zip(cuts, sizes, kinds, strict=True)]


def _part_key(part: int) -> str:
    return f" {part}"  # no word begins with a space


def _lists(offsets: pa.Array, values: np.ndarray, kind: type) -> pa.ListArray:
    return pa.ListArray.from_arrays(offsets, pa.array(values.astype(kind)))


# ---------------------------------------------------------------- counts


def count_words(docs: DataFrame) -> DataFrame:
    """``w, n``: every word of ``docs.text`` (the end token is '') with its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _slices(batches, 0):
            _, code, words = _encoded(texts)
            n = np.append(np.bincount(code, minlength=len(words)), len(texts))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array([b""], pa.binary())]).cast(pa.string()), pa.array(n)], ["w", "n"])

    return settled(docs.select(F.col("text").cast("string")).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")), "lm-words")


def frequent_words(words: DataFrame, bound: int) -> Contexts:
    """The most frequent of ``words``: as many as have at least some count and number at most ``bound``."""
    step = F.floor(F.log(F.col("n").cast("double")) * 16)
    sizes = words.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).orderBy(F.desc("s")).collect()  # a few hundred rows
    least, k = 1 << 62, 0
    for r in sizes:
        k += r["k"]
        if k > bound:
            break
        least = r["least"]
    top = words.where(F.col("n") >= least).toArrow().combine_chunks().sort_by([("n", "descending"), ("w", "ascending")])
    if not top.num_rows:
        return Contexts(pa.array([], pa.string()))
    tokens = words.agg(F.sum("n")).first()[0]
    parts_ = max(LEAST_PARTS, tokens // PART_TOKENS)
    return Contexts(top["w"].combine_chunks(), parts_, int((top["n"].to_numpy() * 4 * parts_ > tokens).sum()))


def _runs(b: pa.RecordBatch, keys: tuple[int, ...]) -> np.ndarray:
    """The number of the run of equal keys that each row is in, from 0."""
    new = np.zeros(b.num_rows, bool)
    for k in keys:
        c = b.column(k)
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.cumsum(new)


def _entries(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Flat values, and the row of each."""
    size = np.diff(column.offsets.to_numpy(zero_copy_only=False))
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(size)), size)


_COUNTED = (np.uint32, np.uint32, np.uint32)
_PLACED = (np.uint32, np.uint32, np.uint32, np.uint16)
_HELD = 1 << 20


def count_pairs(docs: DataFrame, contexts: Contexts) -> DataFrame:
    """``w, rank, k, ctx array, n array``: every word with its count by context, contexts ascending; rank
    is that of a word with a context of its own, else -1, and k is a hash."""
    shared, width = docs.sparkSession.sparkContext.broadcast(contexts), contexts.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _slices(batches, 0):
            for found in _entries_of(texts, shared.value, False):
                keys, blobs = _pieces(found, shared.value.parts, _COUNTED)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(blobs, pa.binary())], ["w", "blob"])
                yield pa.RecordBatch.from_arrays([*_rest(found, shared.value.parts, False)], ["w", "blob"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last rarer word so far: its row, contexts and counts
        part, keys, counts = None, [], []  # the part so far
        for b in batches:
            inner = pc.starts_with(b.column(0), " ")
            packed = b.filter(inner)
            for key, blob in zip(packed.column(0).to_pylist(), packed.column(1).to_pylist(), strict=True):
                if key != part:
                    yield from whole(keys, counts)
                    part, keys, counts = key, [], []
                rank, g, n = _unpacked(blob, _COUNTED)
                keys.append(rank * width + g)
                counts.append(n)
                if sum(map(len, keys)) > _HELD + 2 * len(keys[0]):
                    keys, counts = ([x] for x in added(keys, counts))
            b = b.filter(pc.invert(inner))
            if not b.num_rows:
                continue
            group = _runs(b, (0,))
            row, (g, n) = _numbers(b.column(1), 2)
            if held is not None and not held[0].column(0)[0].equals(b.column(0)[0]):
                yield listed(held[0].column(0), np.zeros(len(held[1]), np.int64), held[1], held[2])
                held = None
            key = group[row] * width + g
            if held is not None:
                key, n = np.concatenate([held[1], key]), np.concatenate([held[2], n])
            key, n = added([key], [n])
            first = np.searchsorted(group, np.arange(group[-1] + 1))
            done = int(np.searchsorted(key, group[-1] * width))
            if len(first) > 1:
                yield listed(b.column(0).take(pa.array(first[:-1])), key[:done] // width, key[:done] % width, n[:done])
            held = b.slice(int(first[-1]), 1), key[done:] % width, n[done:]
        yield from whole(keys, counts)
        if held is not None:
            yield listed(held[0].column(0), np.zeros(len(held[1]), np.int64), held[1], held[2])

    def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)

    def whole(keys: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if keys:
            key, n = added(keys, counts)
            rank, group = np.unique(key // width, return_inverse=True)
            yield listed(shared.value.words.take(pa.array(rank)).cast(pa.string()), group, key % width, n, rank)

    def listed(w: pa.Array, group: np.ndarray, g: np.ndarray, n: np.ndarray, rank: np.ndarray | None = None) -> pa.RecordBatch:
        offsets = pa.array(np.searchsorted(group, np.arange(len(w) + 1)).astype(np.int32))
        rank = np.full(len(w), -1) if rank is None else rank
        return pa.RecordBatch.from_arrays([w, pa.array(rank.astype(np.int32)), _lists(offsets, g, np.int32), _lists(offsets, n, np.int64)], ["w", "rank", "ctx", "n"])

    sent = docs.select(F.col("text").cast("string")).mapInArrow(run, "w string, blob binary")
    merged = settled(sent.repartition("w").sortWithinPartitions("w").mapInArrow(merge, "w string, rank int, ctx array<int>, n array<long>"), "lm-counts")
    hot = F.col("rank").between(0, contexts.hot - 1)
    joined = merged.where(hot).groupBy("w", "rank").agg(F.flatten(F.collect_list(F.arrays_zip("ctx", "n"))).alias("x"))  # at most a count per context
    joined = settled(joined.select("w", "rank", F.sort_array("x").alias("x")).select("w", "rank", F.col("x.ctx").alias("ctx"), F.col("x.n").alias("n")), "lm-hot")
    return merged.where(~hot).unionByName(joined).select("w", "rank", F.xxhash64("w").alias("k"), "ctx", "n")


# ---------------------------------------------------------------- seating


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, shifted by eight; x > 0."""
    x = np.asarray(x, np.float64)
    below = np.log(x) + np.log(x + 1) + np.log(x + 2) + np.log(x + 3) + np.log(x + 4) + np.log(x + 5) + np.log(x + 6) + np.log(x + 7)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - below


def _log_gamma_ratio(c: np.ndarray, a: np.ndarray) -> np.ndarray:
    """log of Gamma(c - a) / Gamma(c + 1), without the difference of two large numbers."""
    x, y = c - a, c + 1.0
    far = x > 40
    every = bool(far.all())
    x1, y1 = (x, y) if every else (np.where(far, x, 50.0), np.where(far, y, 50.0))
    tail = lambda z: (1 / 12 - (1 / 360) / (z * z)) / z
    close = (x1 - 0.5) * np.log1p(-(a + 1.0 if every else y1 - x1) / y1) + (x1 - y1) * (np.log(y1) - 1) + tail(x1) - tail(y1)
    if every:
        return close
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(far, close, _log_gamma(np.maximum(x, 1e-3)) - _log_gamma(y))


#: Terms of the series may be so many times (as a logarithm) their sum: 16 digits less these leave about 1e-5.
CANCELLED = math.log(1e9)


class Stirling:
    """log of the generalised Stirling numbers S(c, t) of a discount, up to a factor that is the same
    for all t of one c."""

    def __init__(self, discount: float, most: int = TABLE):
        self.d = discount
        # within this many times c^d tables the terms of the series fall from some term on, and are never so
        # large before that what they leave of each other is lost: the latter is measured
        most_reach = 0.95 * min(30.0, 12.0 / (1 - discount)) ** (1 - discount) / discount**discount
        steps = np.linspace(0.0, most_reach, 65)[1:]
        lost = np.zeros(len(steps), bool)
        for c in (1e3, 1e6, 1e10):
            value, largest = self._terms(np.full(len(steps), c), np.maximum(steps * c**discount, 1.0))
            lost |= ~(largest - value < CANCELLED)
        self.reach = float(steps[: np.argmax(lost)].max(initial=0.0)) if lost.any() else most_reach
        self.table = np.full((most + 1, most + 1), -np.inf)
        self.table[0, 0] = 0.0
        for c in range(most):
            t = np.arange(1, c + 2)
            with np.errstate(divide="ignore"):
                stay = self.table[c, 1 : c + 2] + np.log(np.maximum(c - discount * t, 1e-300))
            self.table[c + 1, 1 : c + 2] = np.logaddexp(self.table[c, 0 : c + 1], np.where(t <= c, stay, -np.inf))

    def log(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        out = np.full(len(c), -np.inf)
        held = c < len(self.table)
        out[held] = self.table[c[held], t[held]]
        far = np.flatnonzero(~held)
        if len(far):
            out[far] = self.far(c[far].astype(np.float64), t[far].astype(np.float64))
        return out

    def far(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """S(c, t) = c! / (d^t t!) times the probability that t Sibuya variables, of the generating
        function 1 - (1 - x)^d, sum to c."""
        near = t <= np.maximum(self.reach * c**self.d, 12)
        out = np.empty(len(c))
        out[near] = self.series(c[near], t[near])
        out[~near] = self.saddle(c[~near], t[~near])
        return out - t * math.log(self.d) - _log_gamma(t + 1)

    def series(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The binomial series of (1 - (1 - x)^d)^t."""
        return self._terms(c, t)[0]

    def _terms(self, c: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log of the sum of the series, and of its largest term."""
        k = np.arange(1, min(300, int(t.max(initial=1))) + 1)
        within = k[None, :] <= t[:, None]
        choose = np.cumsum(np.log(np.maximum(t[:, None] - k[None, :] + 1, 1e-9)) - np.log(k)[None, :], axis=1)
        size = choose + np.array([math.lgamma(self.d * x + 1) for x in k])[None, :] + _log_gamma_ratio(c[:, None], self.d * k[None, :]) - math.log(math.pi)
        sign = np.where(k % 2 == 1, 1.0, -1.0) * np.sin(math.pi * self.d * k)
        top = np.where(within, size, -np.inf).max(axis=1, keepdims=True)
        total = (np.where(within, np.exp(size - top), 0.0) * sign[None, :]).sum(axis=1)
        return np.log(np.maximum(total, 1e-300)) + top[:, 0], top[:, 0]

    def saddle(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        d = self.d
        low, high = np.full(len(c), -60.0), np.full(len(c), -1e-12)  # log of y = 1 - x
        for _ in range(70):
            mid = (low + high) / 2
            y = np.exp(mid)
            mean = d * y ** (d - 1) * (1 - y) / -np.expm1(d * mid)
            up = t * mean > c
            low, high = np.where(up, mid, low), np.where(up, high, mid)
        y = np.exp((low + high) / 2)
        n, m = d * y ** (d - 1) * (1 - y), 1 - y**d
        slope = d * ((d - 1) * y ** (d - 2) * (1 - y) - y ** (d - 1))
        spread = -(1 - y) * (slope * m + n * d * y ** (d - 1)) / m**2
        return t * np.log(m) - c * np.log1p(-y) - 0.5 * np.log(2 * math.pi * t * spread)


_ODD = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Draws:
    """Uniform numbers that follow from keys and a counter."""

    def __init__(self, key: np.ndarray, seed: int):
        self.key, self.count = _mixed(key.view(np.uint64) + np.uint64(seed * _ODD & (1 << 64) - 1)), 0

    def next(self, at: np.ndarray) -> np.ndarray:
        self.count += 1
        return (_mixed(self.key[at] + np.uint64(self.count * _ODD & (1 << 64) - 1)) >> np.uint64(11)) * 2.0**-53


def draw_tables(at: np.ndarray, c: np.ndarray, t: np.ndarray, fresh: np.ndarray, stirling: Stirling, draws: Draws) -> np.ndarray:
    """Tables of c >= 1 customers of one dish, from their conditional, ``t`` before; ``fresh`` is the
    weight of a new table, (strength + discount * tables) * parent's probability.  ``at`` names the draws."""
    t = np.minimum(t, c)
    small = np.flatnonzero((c > 1) & (c <= DIRECT))
    u = np.zeros(len(at))
    u[small] = draws.next(at[small])
    small = small[np.argsort(c[small].astype(np.int8), kind="stable")]
    for part in np.split(small, np.flatnonzero(np.diff(c[small])) + 1) if len(small) else []:
        size = int(c[part[0]])
        k = np.arange(1, size + 1)
        logs = stirling.table[size, 1 : size + 1][None, :] + k[None, :] * np.log(fresh[part])[:, None]
        weight = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
        t[part] = 1 + (weight < (u[part] * weight[:, -1])[:, None]).sum(axis=1)
    large = np.flatnonzero(c > DIRECT)
    if len(large):
        n, now, log_fresh = c[large], t[large], np.log(fresh[large])
        width = np.ceil(2 * np.sqrt(1 + fresh[large] * np.log1p(n / (1 + fresh[large])))).astype(np.int64)
        value = stirling.log(n, now) + now * log_fresh
        calls, draws.count = draws.count, draws.count << 20  # counted apart: no draw depends on what else is in the block
        for _ in range(MOVES):
            to = now + np.floor(draws.next(at[large]) * (2 * width + 1)).astype(np.int64) - width
            good = (to >= 1) & (to <= n)
            other = np.full(len(to), -np.inf)
            other[good] = stirling.log(n[good], to[good]) + to[good] * log_fresh[good]
            take = np.log(np.maximum(draws.next(at[large]), 1e-300)) < other - value
            now, value = np.where(take, to, now), np.where(take, other, value)
        t[large] = now
        draws.count = calls
    return np.where(c == 1, 1, t)


class Totals:
    """What the restaurants share: customers and tables by context, tables of the parent, the words."""

    def __init__(self, customers: np.ndarray, tables: np.ndarray, parent_tables: float, types: int, discount: tuple[float, float], strength: tuple[float, float]):
        self.customers, self.tables, self.parent_tables, self.types = customers, tables, parent_tables, types
        self.discount, self.strength = discount, strength


class Sweeps:
    """Seats the words of some rows (k, ctx, n) and averages over the kept sweeps."""

    def __init__(self, totals: Totals, burn: int, keep: int, seed: int):
        self.totals, self.burn, self.keep, self.seed = totals, burn, keep, seed
        self.stirling = [Stirling(d) for d in totals.discount]

    def run(self, k: np.ndarray, g: np.ndarray, c: np.ndarray, word: np.ndarray):
        """Per entry the mean tables; per word the parent's customers and tables, means of both."""
        tot, words = self.totals, len(k)
        many = np.bincount(word, c, words) > 1  # a word that occurs once has one table everywhere
        n, k, place = int(many.sum()), k[many], np.cumsum(many) - 1
        d, d0 = tot.discount
        fresh0 = np.full(n, (tot.strength[1] + d0 * tot.parent_tables) / (tot.types + 1))
        whole = tot.strength[1] + float(tot.tables.sum())
        at = np.flatnonzero(c > 1)  # one customer has one table
        g, cs, ws = g[at], c[at], place[word[at]]
        lone = np.bincount(word, minlength=words)[many] - np.bincount(ws, minlength=n)
        fresh = tot.strength[0] + d * tot.tables[g]
        tables, tables0 = np.maximum(1, np.round(cs.astype(np.float64) ** (d / 2))).astype(np.int64), np.ones(n, np.int64)
        parent = lone + np.bincount(ws, tables, n).astype(np.int64)
        draws = Draws(_mixed(k.view(np.uint64)[ws]) + g.astype(np.uint64), self.seed)
        draws0 = Draws(k, self.seed + 1)
        halves = [np.flatnonzero(g % 2 == x) for x in (1, 0)]
        sums = [np.zeros(len(at)), np.zeros(n), np.zeros(n)]
        for sweep in range(self.burn + self.keep):
            for half in halves:
                p = (parent - d0 * np.minimum(tables0, parent) + fresh0) / whole
                tables[half] = draw_tables(half, cs[half], tables[half], fresh[half] * p[ws[half]], self.stirling[0], draws)
                parent = lone + np.bincount(ws, tables, n).astype(np.int64)
            tables0 = draw_tables(np.arange(n), parent, tables0, fresh0, self.stirling[1], draws0)
            if sweep >= self.burn:
                for total, x in zip(sums, (tables, parent, tables0), strict=True):
                    total += x
        mean = np.ones(len(c))
        mean[at] = sums[0] / self.keep
        customers0, mean0 = np.ones(words), np.ones(words)
        customers0[many], mean0[many] = sums[1] / self.keep, sums[2] / self.keep
        return mean, customers0, mean0


_STATS = "k int, v double"
_ENTRIES = 1 << 20


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of w, rank, k, ctx, n in blocks of about ``_ENTRIES`` contexts."""
    for b in batches:
        ends, lo = b.column(3).offsets.to_numpy(zero_copy_only=False).astype(np.int64), 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + _ENTRIES, "right")) - 1)
            yield b.slice(lo, hi - lo)
            lo = hi


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    (g, word), n = _entries(b.column(3)), b.column(4).flatten().to_numpy(zero_copy_only=False)
    return b.column(2).to_numpy(zero_copy_only=False), g.astype(np.int64), n, word


def _summed(found: DataFrame, size: int) -> np.ndarray:
    """Sums of v by k in 0 .. size, of rows that each task has summed before."""
    table = found.groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[table["k"].to_numpy()] = table["v"].to_numpy()
    return out


def _sparse(total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["k", "v"])


class Model:
    """``words``: table w, rank, c, q, c0, ctx, e; the rest are small totals."""

    def __init__(self, words: DataFrame, contexts: Contexts, n: int, types: int, strength: float, customers: np.ndarray, kept: np.ndarray, parent_customers: float, parent_kept: float, parent_strength: float):
        self.words, self.contexts, self.n, self.types = words, contexts, n, types
        whole = parent_strength + parent_customers
        self.unseen = (whole - parent_kept) / whole / (types + 1) if types else 1.0
        self.parent_whole = whole
        self.seat = 1.0 / (strength + customers)
        self.back = (strength + customers - kept) * self.seat


def fit(docs: DataFrame, rounds: int = 1, burn: int = 2, keep: int = 4, strength: tuple[float, float] = (1.0, 1.0), seed: int = 11, contexts: int = 200_000) -> Model:
    """The model of ``docs.text``: counts, ``rounds`` rounds that renew the totals, a last round kept."""
    words = count_words(docs)
    named = frequent_words(words, contexts)
    counts, size = count_pairs(docs, named), named.size

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * size + 6)
        for b in _blocks(batches):
            k, g, c, word = _flat(b)
            spread = np.bincount(word, minlength=len(k))
            total[:size] += np.bincount(g, c, size)
            total[size : 2 * size] += np.bincount(g, minlength=size)
            total[2 * size :] += [(c == 1).sum(), (c == 2).sum(), (spread == 1).sum(), (spread == 2).sum(), len(k), c.sum()]
        yield _sparse(total)

    s = _summed(counts.mapInArrow(first, _STATS), 2 * size + 6)
    customers, tables, (one, two, lone, pair, types, n) = s[:size], s[size : 2 * size], s[2 * size :]

    def discount(n1: float, n2: float) -> float:
        return float(min(max(n1 / max(n1 + 2 * n2, 1.0), 0.1), 0.95))

    types, n, discounts = int(types), int(n), (discount(one, two), discount(lone, pair))
    totals = Totals(customers, tables, float(types), types, discounts, strength)
    shared = docs.sparkSession.sparkContext.broadcast
    for r in range(rounds):

        def renew(batches: Iterator[pa.RecordBatch], held=shared(totals), r=r) -> Iterator[pa.RecordBatch]:
            sweeps, total = Sweeps(held.value, 1, 1, seed + 2 * r), np.zeros(size + 1)
            for b in _blocks(batches):
                k, g, c, word = _flat(b)
                mean, _, mean0 = sweeps.run(k, g, c, word)
                total[:size] += np.bincount(g, mean, size)
                total[size] += mean0.sum()
            yield _sparse(total)

        s = _summed(counts.mapInArrow(renew, _STATS), size + 1)
        totals = Totals(customers, s[:size], float(s[size]), types, discounts, strength)

    def last(batches: Iterator[pa.RecordBatch], held=shared(totals)) -> Iterator[pa.RecordBatch]:
        sweeps = Sweeps(held.value, burn, keep, seed + 2 * rounds)
        d, d0 = held.value.discount
        for b in _blocks(batches):
            k, g, c, word = _flat(b)
            mean, customers0, mean0 = sweeps.run(k, g, c, word)
            offsets = pa.array(np.searchsorted(word, np.arange(len(k) + 1)).astype(np.int32))
            count = np.bincount(word, c, len(k)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(count), pa.array(customers0 - d0 * mean0), pa.array(customers0), _lists(offsets, g, np.int32), _lists(offsets, c - d * mean, np.float32)], ["w", "rank", "c", "q", "c0", "ctx", "e"])

    model = settled(counts.mapInArrow(last, "w string, rank int, c long, q double, c0 double, ctx array<int>, e array<float>"), "lm-model")

    def held_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False), b.column(1).flatten().to_numpy(zero_copy_only=False), size)
        yield _sparse(total)

    kept = _summed(model.select("ctx", "e").mapInArrow(held_back, _STATS), size)
    whole = model.agg(F.sum("c0"), F.sum("q")).first()
    return Model(model, named, n, types, strength[0], customers, kept, whole[0] or 0.0, whole[1] or 0.0, strength[1])


# ---------------------------------------------------------------- scoring

_SUMS = ("n_tokens", "n_known", "base", "score")
_SUMMED = (np.uint16, np.uint32, np.uint32, np.float64, np.float64)
_FLUSH = 1 << 20


def score(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """Per row of docs: the ``carry`` columns, n_tokens, n_known, base_score, score."""
    width, unseen, n_all, types = model.contexts.size, model.unseen, model.n, model.types
    p0 = F.col("q") / F.lit(float(model.parent_whole)) + F.lit(float(unseen))
    named = model.words.where("rank >= 0").select("rank", F.col("c").cast("double").alias("c"), p0.alias("p0")).toArrow()  # at most a row per context
    known, chance = np.zeros(len(model.contexts.words)), np.full(len(model.contexts.words), unseen)
    known[named["rank"].to_numpy()], chance[named["rank"].to_numpy()] = named["c"].to_numpy(), named["p0"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast((model.contexts, model.seat, model.back, known, chance))
    names, carry = carry, [f"__c{i}" for i in range(len(carry))]  # no name of the input meets one used here
    kept = docs.select(*[F.col(n).alias(c) for n, c in zip(names, carry, strict=True)], F.col("text").cast("string").alias("text"))
    carried = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]
    kinds = {"w": pa.string(), "kind": pa.int8(), "at": pa.int64(), "p0": pa.float64(), "blob": pa.binary()}
    fields = ["w string", "kind tinyint", "at long", "p0 double", "blob binary"]

    def made(size: int, kind: int, more: dict[str, pa.DataType], **given: pa.Array) -> pa.RecordBatch:
        given["kind"] = pa.array(np.full(size, kind, np.int8))
        every = {**kinds, **more}
        return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(size, t) for c, t in every.items()], list(every))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per document (kind 2), and per slice its places, by part or word (kind 1)."""
        first = TaskContext.get().partitionId() << 36
        held: list[pa.RecordBatch] = []

        def passing() -> Iterator[pa.RecordBatch]:
            for b in batches:
                held.append(b)
                yield b

        contexts = shared.value[0]
        for before, texts in _slices(passing(), len(carry)):
            more = {c: held[0].column(i).type for i, c in enumerate(carry)}
            mine = len(texts)
            while mine:
                b = held.pop(0)
                if b.num_rows > mine:
                    held.insert(0, b.slice(mine))
                    b = b.slice(0, mine)
                place = len(texts) - mine + np.arange(b.num_rows)
                mine -= b.num_rows
                if b.num_rows:
                    key = pa.array([f" {first + before} {i >> 9}" for i in place.tolist()], pa.string())
                    yield made(b.num_rows, 2, more, w=key, at=pa.array(np.full(b.num_rows, first + before)), blob=_rows(np.arange(b.num_rows + 1), place), **{c: b.column(i) for i, c in enumerate(carry)})
            for found in _entries_of(texts, contexts, True):
                keys, blobs = _pieces(found, contexts.parts, _PLACED)
                yield made(len(keys), 1, more, w=pa.array(keys, pa.string()), at=pa.array(np.full(len(keys), first + before)), blob=pa.array(blobs, pa.binary()))
                w, blob = _rest(found, contexts.parts, True)
                yield made(len(w), 1, more, w=w, at=pa.array(np.full(len(w), first + before)), blob=blob)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The model's rows (kind 0) where they are asked for: by word, or by part with the rank."""
        contexts = shared.value[0]
        for b in batches:
            rank = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for some in (np.flatnonzero(rank < 0), np.flatnonzero(rank >= contexts.hot)):
                part = b.take(pa.array(some))
                own = len(some) and rank[some[0]] >= 0
                key = pa.array([_part_key(x) for x in contexts.part(rank[some], rank[some]).tolist()], pa.string()) if own else part.column(0)
                bounds = part.column(4).offsets.to_numpy(zero_copy_only=False)
                g, e = (part.column(i).flatten().to_numpy(zero_copy_only=False) for i in (4, 5))
                yield made(len(some), 0, {}, w=key, at=part.column(1).cast(pa.int64()) if own else part.column(2), p0=part.column(3), blob=_rows(bounds, g, e))
            for i in np.flatnonzero((rank >= 0) & (rank < contexts.hot)).tolist():
                g, e = b.column(4)[i].values.to_numpy(zero_copy_only=False), b.column(5)[i].values.to_numpy(zero_copy_only=False)
                to = contexts.part(rank[i], g.astype(np.int64))
                order = np.argsort(to, kind="stable")
                parts_, begin = np.unique(to[order], return_index=True)
                yield made(len(parts_), 0, {}, w=pa.array([_part_key(x) for x in parts_.tolist()], pa.string()), at=pa.array(np.full(len(parts_), rank[i], np.int64)), blob=_rows(np.append(begin, len(g)), g[order], e[order]))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums by slice (a packed row) and the documents' rows.  Of a key the model's rows come first."""
        _, seat, back, known, chance = shared.value
        none = (0.0, unseen, np.zeros(0, np.int64), np.zeros(0))
        last = here = None  # the word so far, and what the model has of it: c and p0, entries and e
        last_part, held = None, none
        waiting: list[tuple] = []
        size, empty = 0, None

        def told(at: np.ndarray, place: np.ndarray, n: np.ndarray, g: np.ndarray, e: np.ndarray, c: np.ndarray, p: np.ndarray) -> None:
            nonlocal size
            waiting.append((at, place, n, n * (c > 0), n * np.log10((c + 1) / (n_all + types + 1)), n * np.log10(e * seat[g] + back[g] * p)))
            size += len(n)

        def looked_up(wanted: np.ndarray, key: np.ndarray, e: np.ndarray) -> np.ndarray:
            if not len(key):
                return np.zeros(len(wanted))
            spot = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            return np.where(key[spot] == wanted, e[spot], 0.0)

        def by_part(b: pa.RecordBatch) -> None:
            """Rows of parts: model rows name a rank, the others are packed."""
            nonlocal last_part, held
            for lo, hi in _bounds(b):
                key, run = b.column(0)[lo].as_py(), b.slice(lo, hi - lo)
                kind = run.column(1).to_numpy(zero_copy_only=False)
                if key != last_part:
                    last_part, held = key, none
                m = run.slice(0, int((kind == 0).sum()))
                if m.num_rows:
                    row, (g, e) = _numbers(m.column(4), 2)
                    entry, e = m.column(2).to_numpy(zero_copy_only=False)[row] * width + g, e.view(np.float32)
                    entry, e = np.concatenate([held[2], entry]), np.concatenate([held[3], e])
                    order = np.argsort(entry, kind="stable")
                    held = (0.0, unseen, entry[order], e[order])
                for at, blob in zip(run.column(2).to_pylist()[m.num_rows :], run.column(4).to_pylist()[m.num_rows :], strict=True):
                    rank, g, n, row = _unpacked(blob, _PLACED)
                    told(np.full(len(row), at), row, n.astype(np.float64), g, looked_up(rank * width + g, held[2], held[3]), known[rank], chance[rank])

        def by_word(b: pa.RecordBatch) -> None:
            nonlocal last, here
            kind, group = b.column(1).to_numpy(zero_copy_only=False), _runs(b, (0,))
            groups = int(group[-1]) + 1
            count, p0, key, e = np.zeros(groups), np.full(groups, unseen), np.zeros(0, np.int64), np.zeros(0)
            if b.column(0)[0].as_py() == last:
                count[0], p0[0], key, e = here
            ours = np.flatnonzero(kind == 0)
            if len(ours):
                m, at = b.take(pa.array(ours)), group[ours]
                count[at], p0[at] = m.column(2).to_numpy(zero_copy_only=False), m.column(3).to_numpy(zero_copy_only=False)
                row, (g, values) = _numbers(m.column(4), 2)
                key, e = np.concatenate([key, at[row] * width + g]), np.concatenate([e, values.view(np.float32)])
            tail = int(np.searchsorted(key, (groups - 1) * width))
            last, here = b.column(0)[-1].as_py(), (count[-1], p0[-1], key[tail:] - (groups - 1) * width, e[tail:])
            asked = np.flatnonzero(kind == 1)
            if len(asked):
                m = b.take(pa.array(asked))
                row, (g, n, place) = _numbers(m.column(4), 3)
                of = group[asked][row]
                told(m.column(2).to_numpy(zero_copy_only=False)[row], place, n.astype(np.float64), g, looked_up(of * width + g, key, e), count[of], p0[of])

        for b in batches:
            empty = b.slice(0, 0)
            rows = b.filter(pc.equal(b.column(1), 2))
            if rows.num_rows:
                yield pa.RecordBatch.from_arrays([rows.column(2), pa.array(np.ones(rows.num_rows, np.int8)), pa.array(_numbers(rows.column(4), 1)[1][0]), pa.nulls(rows.num_rows, pa.binary()), *rows.columns[5:]], ["at", "kind", "row", "blob", *carry])
                b = b.filter(pc.not_equal(b.column(1), 2))
            inner = pc.starts_with(b.column(0), " ")
            for some, work in ((b.filter(inner), by_part), (b.filter(pc.invert(inner)), by_word)):
                for lo in range(0, some.num_rows, 2048):
                    work(some.slice(lo, 2048))
                    if size > _FLUSH:
                        yield summed(waiting, empty)
                        waiting, size = [], 0
        if waiting:
            yield summed(waiting, empty)

    def summed(waiting: list[tuple], b: pa.RecordBatch) -> pa.RecordBatch:
        at, place, *values = (np.concatenate(x) for x in zip(*waiting, strict=True))
        slices, of = np.unique(at, return_inverse=True)
        key, where = np.unique(of * SLICE_ROWS + place, return_inverse=True)
        sums = [np.bincount(where, x, len(key)).astype(kind) for x, kind in zip(values, _SUMMED[1:], strict=True)]
        bounds = [*np.searchsorted(key // SLICE_ROWS, np.arange(len(slices))).tolist(), len(key)]
        place = (key % SLICE_ROWS).astype(np.uint16)
        blobs = [_packed([x[lo:hi] for x in (place, *sums)]) for lo, hi in zip(bounds, bounds[1:], strict=False)]
        m = len(slices)
        return pa.RecordBatch.from_arrays([pa.array(slices), pa.array(np.zeros(m, np.int8)), pa.nulls(m, pa.int32()), pa.array(blobs, pa.binary()), *[pa.nulls(m, f.type) for f in list(b.schema)[5:]]], ["at", "kind", "row", "blob", *carry])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of documents (kind 1) with what the packed rows of their slice, which come first, add up to."""
        last, sums = None, np.zeros((0, 4))
        for b in batches:
            for lo, hi in _bounds(b):
                at, run = b.column(0)[lo].as_py(), b.slice(lo, hi - lo)
                if at != last:
                    last, sums = at, np.zeros((0, 4))
                packed = int(run.num_rows - run.column(3).null_count)
                for blob in run.column(3).slice(0, packed).to_pylist():
                    place, *values = _unpacked(blob, _SUMMED)
                    if place[-1] >= len(sums):
                        sums = np.concatenate([sums, np.zeros((int(place[-1]) + 1 - len(sums), 4))])
                    sums[place] += np.stack(values, 1)
                rows = run.slice(packed)
                if rows.num_rows:
                    mine = sums[rows.column(2).to_numpy(zero_copy_only=False)]
                    yield pa.RecordBatch.from_arrays([*rows.columns[4:], *[pa.array(mine[:, i].astype(np.int64 if i < 2 else np.float64)) for i in range(4)]], [*carry, *_SUMS])

    ours = model.words.select("w", "rank", F.col("c").alias("at"), p0.alias("p0"), "ctx", "e").mapInArrow(deal, ", ".join(fields))
    sent = kept.mapInArrow(run, ", ".join([*fields, *carried])).unionByName(ours, allowMissingColumns=True)
    found = sent.repartition("w").sortWithinPartitions("w", "kind", "at").mapInArrow(answer, ", ".join(["at long", "kind tinyint", "row int", "blob binary", *carried]))
    whole = found.repartition("at").sortWithinPartitions("at", "kind").mapInArrow(finish, ", ".join([*carried, "n_tokens long", "n_known long", "base double", "score double"]))
    return whole.select(*[F.col(c).alias(n) for n, c in zip(names, carry, strict=True)], "n_tokens", "n_known", F.col("base").alias("base_score"), "score")


def _bounds(b: pa.RecordBatch) -> list[tuple[int, int]]:
    """The runs of rows with one value of the first column."""
    if not b.num_rows:
        return []
    group = _runs(b, (0,))
    bounds = [*np.searchsorted(group, np.arange(group[-1] + 1)).tolist(), b.num_rows]
    return list(zip(bounds, bounds[1:], strict=False))
