"""Texts linked at an exact Jaccard similarity of their distinct word shingles.

Candidates: ``ROWS * BANDS`` minimum hashes of a text's shingle set; two texts are candidates if they
agree on all minima of a band.  Beside each key go two sketches.  One has a bit per minimum (of
``SKETCH``), whose expected share of differing bits is (1 - J) / 2.  The other has ``ODD`` bits, each the
parity of the shingles that fall on it: the bits in which two texts differ come from the shingles that
only one of them has, so small texts just below the threshold are told apart almost exactly.  At J = 0.8
a pair shares no band with probability (1 - 0.8**5)**30 = 7e-6, exceeds ``APART`` bits with about 1e-8 and
four deviations of the parities with 3e-5; all fall for higher J.

Links: a candidate counts only if the Jaccard similarity of the two shingle sets (64-bit hashes) reaches the
threshold.  A text of equal shingles is one node, so copies are never paired.  A first pass verifies
up to ``FIRST`` of the closest candidates of a node, found near it in its bands; what that joins goes
by one name.  ``CLOSEST`` further passes verify, of each node and part of a band, the ``FIRST`` closest
candidates of other names, which joins a large group of near copies to the text that they vary.  The last
pass verifies all candidates that still join different names, so components are those of all
candidates' links.  Large bands are dealt in blocks: a member that does not have the band's most frequent
name goes to all blocks of the band, the others to one.

Nulls and empty texts have the empty set and are alike.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.shared import parts, settled, slices, utf8

ROWS, BANDS, SKETCH, APART, ODD = 5, 30, 256, 56, 512
FIRST, LAGS, BLOCK, CLOSEST = 4, 8, 1024, 1
_WORDS = [f"f{k}" for k in range((SKETCH + ODD) // 64)]
_MEMBER = "n long, " + ", ".join(f"{c} long" for c in _WORDS)


def shingle_sets(texts: list[bytes], shingle: int, seed: int = 42) -> Iterator[np.ndarray]:
    """The sorted distinct XXH64 values of every text's word shingles; a shorter text is one shingle."""
    digest = xxhash.xxh64_intdigest
    for text in texts:
        words = b" ".join(text.lower().split())
        if not words:
            yield np.zeros(0, np.uint64)
            continue
        gaps = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
        starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(words)]
        if len(starts) <= shingle:
            yield np.array([digest(words, seed)], np.uint64)
        else:
            yield np.unique(np.array([digest(words[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=False)], np.uint64))


def node_of(found: np.ndarray) -> int:
    """What names a shingle set, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 7)).view(np.int64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(texts, BANDS) keys and (texts, (SKETCH + ODD) / 64) words of bits."""
    rng, hashes = np.random.default_rng(11), max(ROWS * BANDS, SKETCH)
    times = rng.integers(0, 1 << 31, hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    plus = rng.integers(0, 1 << 32, hashes, dtype=np.uint32)
    least = np.full((len(sets), hashes), 0xFFFFFFFF, np.uint32)
    odd = np.zeros((len(sets), ODD), np.uint8)
    filled = [i for i, s in enumerate(sets) if len(s)]
    if filled:
        flat = np.concatenate([sets[i] for i in filled])
        x = (_mixed(flat) >> np.uint64(32)).astype(np.uint32)
        count = np.array([len(sets[i]) for i in filled])
        begin = np.cumsum(count) - count
        place = np.repeat(np.array(filled) * ODD, count) + (_mixed(flat ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(ODD)).astype(np.int64)
        odd = (np.bincount(place, minlength=odd.size) & 1).astype(np.uint8).reshape(odd.shape)
        for k in range(hashes):
            least[filled, k] = np.minimum.reduceat(x * times[k] + plus[k], begin)
    key = np.zeros((len(sets), BANDS), np.uint64)
    for j in range(ROWS):
        key = _mixed((key * np.uint64(3)) ^ least[:, j : ROWS * BANDS : ROWS].astype(np.uint64))
    key = np.arange(BANDS, dtype=np.uint64)[None, :] << np.uint64(57) | key >> np.uint64(7)
    bit = (least[:, :SKETCH] * np.uint32(0x9E3779B1)) >> np.uint32(31)
    return key, np.packbits(np.concatenate([bit.astype(np.uint8), odd], axis=1), axis=1).view(np.uint64)


def _longs(columns: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns]


def _sketched(docs: DataFrame, shingle: int, carry: tuple[str, ...]) -> DataFrame:
    kept = docs.select(*carry, F.col("text").cast("string").alias("text"))
    names = [*carry, "node", "n", *_WORDS, "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in parts(whole)):
            texts = utf8(b.column(b.num_columns - 1))
            for lo, hi in slices(texts):
                sets = list(shingle_sets(texts[lo:hi], shingle))
                key, bits = sketches(sets)
                node, n = np.array([node_of(s) for s in sets]), np.array([len(s) for s in sets])
                keys = pa.ListArray.from_arrays(np.arange(0, key.size + 1, BANDS, dtype=np.int32), key.view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in b.columns[:-1]], *_longs([node, n, *bits.T]), keys], names)

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]
    return kept.mapInArrow(run, ", ".join([*schema, "node long", _MEMBER, "keys array<long>"]))


def _near(n: np.ndarray, bits: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs may reach the threshold, and their differing bits."""
    apart = np.bitwise_count(bits[i] ^ bits[j])
    d, odd = apart[:, : SKETCH // 64].sum(axis=1).astype(np.int64), apart[:, SKETCH // 64 :].sum(axis=1)
    own = (n[i] + n[j]) * ((1 - least) / (1 + least))  # shingles that only one has, at the threshold
    two, four = (1 - 2 / ODD) ** own, (1 - 4 / ODD) ** own
    spread = np.sqrt(np.maximum(ODD / 4 * (1 - four) + ODD**2 / 4 * (four - two**2), 0.0))
    few = odd <= ODD / 2 * (1 - two) + 4 * spread + 1
    return few & (d <= APART) & (np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j])), d


def _bands(least: float):
    """Over rows key, node, n, bits sorted by key: members of bands of two or more (kind 1: a the node), and
    pairs of members at most LAGS apart (kind 0: a > b, key the differing bits)."""
    names = ["kind", "key", "a", "b", "n", *_WORDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 3 + len(_WORDS)), np.int64)
        old, told = 0, True  # rows of held that are already paired; whether the last one is told as a member
        for b in batches:
            new = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1)
            if not len(new):
                continue
            old = len(held)
            rows = np.concatenate([held, new])
            key, node, n, bits = rows[:, 0], rows[:, 1], rows[:, 2], np.ascontiguousarray(rows[:, 3:]).view(np.uint64)
            same = key[1:] == key[:-1]
            member = np.zeros(len(rows), bool)
            member[1:] |= same
            member[:-1] |= same
            member[: max(old - 1, 0)] = False
            if old and told:
                member[old - 1] = False
            told = bool(member[-1])
            yield packed(1, key[member], node[member], node[member], n[member], rows[member, 3:])
            for lag in range(1, LAGS + 1):
                j = np.arange(max(old, lag), len(rows))
                i = j - lag
                both = key[i] == key[j]
                i, j = i[both], j[both]
                if not len(i):
                    break
                good, d = _near(n, bits, i, j, least)
                a, c = node[i[good]], node[j[good]]
                yield packed(0, d[good], np.maximum(a, c), np.minimum(a, c), None, None)
            held = rows[-LAGS:]

    def packed(kind: int, key: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray | None, bits: np.ndarray | None) -> pa.RecordBatch:
        more = [pa.nulls(len(a), pa.int64())] * (1 + len(_WORDS)) if n is None else _longs([n, *bits.T])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), *_longs([key, a, b]), *more], names)

    return run, f"kind byte, key long, a long, b long, {_MEMBER}"


def _crossing(least: float, most: int | None):
    """Over rows part, key, own, minor, node, name, n, bits sorted by part and key: pairs a > b of
    a minor member with an own member of another name, or with the ``most`` closest of them."""

    def pairs(g: np.ndarray) -> Iterator[pa.RecordBatch]:
        own, minor = np.flatnonzero(g[:, 2]), np.flatnonzero(g[:, 3])
        node, name, n, bits = g[:, 4], g[:, 5], g[:, 6], np.ascontiguousarray(g[:, 7:]).view(np.uint64)
        for m in minor.tolist():
            j = own[name[own] != name[m]]
            good, d = _near(n, bits, np.full(len(j), m), j, least)
            other = node[j[good]]
            if most is not None and len(other) > most:
                other = other[np.lexsort((other, d[good]))[:most]]
            if len(other):
                yield pa.RecordBatch.from_arrays(_longs([np.maximum(other, node[m]), np.minimum(other, node[m])]), ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            rows = np.stack([c.cast(pa.int64()).to_numpy(zero_copy_only=False) for c in b.columns], 1)
            cuts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            for piece in np.split(rows, cuts):
                if held and len(piece) and (held[-1][-1, :2] != piece[0, :2]).any():
                    yield from pairs(np.concatenate(held))
                    held = []
                held.append(piece)
        if held:
            yield from pairs(np.concatenate(held))

    return run, "a long, b long"


def verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs a, b of nodes whose shingle sets reach the Jaccard similarity ``least``; ``docs``
    has the texts by ``__at``, ``rows`` a node for each ``__at``."""
    pairs = settled(pairs.select("a", "b").distinct(), "similar-pairs")
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    at = rows.join(asked, "node", "left_semi").groupBy("node").agg(F.min("__at").alias("__at")).select("__at").distinct()
    texts = docs.select("__at", F.col("text").cast("string").alias("text")).join(at, "__at", "left_semi").select("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in parts(whole)):
            sets = list(shingle_sets(utf8(b.column(0)), shingle))
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "cut"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in parts(whole)):
            good = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                x, y = (np.frombuffer(b.column(k)[i].as_buffer(), np.uint64) for k in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                whole = len(x) + len(y) - both
                good[i] = whole == 0 or both / whole >= least
            yield b.select(["a", "b"]).filter(pa.array(good))

    sets = settled(texts.mapInArrow(cut, "node long, cut binary").dropDuplicates(["node"]), "similar-sets")
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("cut").alias("ca")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("cut").alias("cb")), "b")
    return settled(two.select("a", "b", "ca", "cb").mapInArrow(check, "a long, b long"), "similar-links")


def classes(docs: DataFrame, shingle: int, jaccard: float, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns and ``root``, which names the row's component, one row per input row."""
    from tidewater.llm.simhash import components

    docs = docs.withColumn("__at", F.xxhash64(*docs.columns))
    rows = settled(_sketched(docs, shingle, tuple(dict.fromkeys([*carry, "__at"]))), "similar-rows")
    nodes = rows.select("node", "n", *_WORDS, "keys").dropDuplicates(["node"])
    keyed = nodes.select(F.explode("keys").alias("key"), "node", "n", *_WORDS)
    run, schema = _bands(jaccard)
    found = settled(keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, schema), "similar-bands")
    # the closest candidates of each node
    near = found.where("kind = 0").select("a", "b", F.col("key").alias("d")).distinct()
    nearest = Window.partitionBy("a").orderBy("d", F.xxhash64("a", "b"), "b")
    links = verified(near.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= FIRST), docs, rows, shingle, jaccard)
    roots = components(links)
    # what lies between names that are not yet joined: the closest first, then all
    every = found.where("kind = 1").select("key", F.col("a").alias("node"), "n", *_WORDS)
    for most in (*[FIRST] * CLOSEST, None):
        member = every.join(roots, "node", "left").withColumn("name", F.coalesce("root", "node")).drop("root")
        member = settled(member, "similar-members")
        each = member.groupBy("key", "name").count().groupBy("key")
        mixed = each.agg(F.max(F.struct("count", "name"))["name"].alias("most"), F.sum("count").alias("m"), F.count(F.lit(1)).alias("names")).where("names > 1")
        dealt = member.join(mixed.select("key", "most", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "key")
        mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        minor = F.col("name") != F.col("most")
        dealt = dealt.withColumn("mine", mine).withColumn("block", F.explode(F.when(minor, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("mine"))))
        dealt = dealt.select(F.col("block").cast("long").alias("part"), "key", (F.col("block") == F.col("mine")).cast("long").alias("own"), minor.cast("long").alias("minor"), "node", "name", "n", *_WORDS)
        every = member.join(mixed.select("key"), "key", "left_semi").drop("name")
        run, schema = _crossing(jaccard, most)
        crossing = dealt.repartition("key", "part").sortWithinPartitions("part", "key").mapInArrow(run, schema)
        more = verified(crossing, docs, rows, shingle, jaccard)
        if more.isEmpty() and most is not None:
            continue
        links = settled(links.unionByName(more), "similar-all")
        roots = components(links)
    return rows.join(roots, "node", "left").select(*carry, F.coalesce("root", "node").alias("root"))
