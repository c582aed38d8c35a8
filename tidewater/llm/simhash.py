"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprint: 64 bits over the ``shingle``-word shingles of a text (repeats included); bit ``b`` is
set if it is set in more than half of the XXH64 values (seed 42).

Linking at ``<= 4`` differing bits, exactly:

* The fingerprint is cut into three segments of 23, 23 and 18 bits (the last padded with zeros).
  With four errors in all, the two cleanest segments together hold at most two of them.
* Each segment is decoded to every codeword of the perfect [23, 12, 7] Golay code at distance
  ``<= 4``: one codeword, or six when the nearest is three away.  Two segments at distance ``<= 2``
  have a midpoint within one bit of both, the midpoint has a codeword within three bits (the code
  is perfect), so both list that codeword.  Hence two linked fingerprints agree on a key made of
  two codeword indices (24 bits) in at least one of the three pairs of segments.
* Fingerprints that share a key are compared; each key's links are reduced to a spanning forest
  where they are found, so one key gives fewer rows than it has members.  Keys with more than
  ``BLOCK`` members are dealt anew as pairs of blocks, which loses no pair.

Components of the links come from contracting every node into its smallest smaller neighbour.

``keep_one`` and ``classes`` with ``jaccard`` link by the exact Jaccard similarity of the shingle sets
(``similar``) in place of fingerprints; ``SIMILAR`` holds what the pipeline takes.

Nulls, empty texts: no word, fingerprint zero, linked like any other.  Rows with equal ``doc_id``
or equal text keep their own rows; a null ``doc_id`` never names a component unless no other id
is in it (then ``component_id`` is null).  Other input columns are ignored.  An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import similar
from tidewater.llm.shared import parts, row_of, settled, slices, utf8

BITS = 4
BLOCK = 4096
SIMILAR = {"shingle": 5, "jaccard": 0.8}
_NEAR = 64  # groups up to this many members are compared by shifting the sorted run

# ---------------------------------------------------------------- fingerprints


def _majority(hashes: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """One fingerprint per run of hashes: the bits set in over half of the run."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > count[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _remix(hashes: np.ndarray) -> np.ndarray:
    """Other 64-bit hashes of the same shingles."""
    h = hashes ^ (hashes >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints_of(texts: list[bytes], shingle: int = 4, seed: int = 42, prints: int = 1) -> np.ndarray:
    """(texts, prints) fingerprints as uint64, of UTF-8 texts."""
    out = np.zeros((len(texts), prints), np.uint64)
    digest = xxhash.xxh64_intdigest
    for lo, hi in slices(texts, 1 << 20):
        found, rows, counts = [], [], []
        for i in range(lo, hi):
            words = b" ".join(texts[i].lower().split())
            if not words:
                continue
            gaps = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
            starts = [0, *(gaps + 1).tolist()]
            ends = [*gaps.tolist(), len(words)]
            if len(starts) <= shingle:
                found.append(digest(words, seed))
                counts.append(1)
            else:
                found.extend([digest(words[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=False)])
                counts.append(len(starts) - shingle + 1)
            rows.append(i)
        if rows:
            count, hashes = np.array(counts), np.array(found, np.uint64)
            for k in range(prints):
                out[rows, k] = _majority(hashes, np.cumsum(count) - count, count)
                hashes = _remix(hashes)
    return out


def _node(prints: np.ndarray) -> np.ndarray:
    """What names a (set of) fingerprint(s): itself, or a hash of both."""
    if prints.shape[1] == 1:
        return prints[:, 0].copy()
    return _remix(prints[:, 0] ^ (_remix(prints[:, 1]) * np.uint64(3)))


def _columns(prints: int) -> list[str]:
    return [f"f{k}" for k in range(prints)]


def fingerprint(docs: DataFrame, shingle: int = 4, prints: int = 1, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns, ``f0`` .. (64 bits as signed longs) and ``node``; no shuffle."""
    kept = docs.select(*carry, F.col("text").cast("string").alias("text"))
    names = [*carry, *_columns(prints), "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in parts(whole)):
            found = fingerprints_of(utf8(b.column(b.num_columns - 1)), shingle, prints=prints)
            made = [*found.T, _node(found)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(np.ascontiguousarray(x).view(np.int64)) for x in made]], names)

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + [f"{c} long" for c in names[len(carry) :]]
    return kept.mapInArrow(run, ", ".join(schema))


# ---------------------------------------------------------------- the code

# Fixed value: generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101


def _remainders(values: np.ndarray) -> np.ndarray:
    left = values.copy()
    for shift in range(11, -1, -1):
        left = np.where((left >> (11 + shift)) & 1, left ^ (GENERATOR << shift), left)
    return left


def _golay_tables() -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Syndromes by byte, and for every syndrome the error patterns of weight <= 4 (1 or 6)."""
    by_byte = [_remainders(np.arange(256, dtype=np.int64) << s & 0x7FFFFF) for s in (0, 8, 16)]
    one = np.int64(1) << np.arange(23, dtype=np.int64)
    sets: list[list[int]] = [[] for _ in range(2048)]
    patterns = [np.zeros(1, np.int64)]
    for _ in range(4):
        grown = (patterns[-1][:, None] | one[None, :]).ravel()
        wider = np.unique(grown[np.bitwise_count(grown) > np.bitwise_count(patterns[-1][:1])[0]])
        patterns.append(wider)
    every = np.concatenate(patterns)
    for e, s in zip(every.tolist(), _remainders(every).tolist(), strict=True):
        sets[s].append(e)
    table = np.array([(x + x[:1] * 6)[:6] for x in sets], np.int64)
    return by_byte, table, np.array([len(x) for x in sets], np.int64)


_golay: list = []


def codeword_indices(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit values: an (n, 6) array of the 12-bit indices of all codewords at distance <= 4,
    and how many of the six are valid."""
    if not _golay:
        _golay.extend(_golay_tables())
    by_byte, table, counts = _golay
    syndrome = by_byte[0][segment & 255] ^ by_byte[1][segment >> 8 & 255] ^ by_byte[2][segment >> 16]
    return (segment[:, None] ^ table[syndrome]) >> 11, counts[syndrome]


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (position of the fingerprint, key) of an array of uint64 fingerprints."""
    fp = fp.view(np.uint64)
    cuts = [(fp >> np.uint64(41)).astype(np.int64), (fp >> np.uint64(18) & np.uint64(0x7FFFFF)).astype(np.int64), (fp & np.uint64(0x3FFFF)).astype(np.int64)]
    coded = [codeword_indices(p) for p in cuts]
    at, key = [], []
    for pair, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        (ia, na), (ib, nb) = coded[a], coded[b]
        both = (np.arange(6)[None, :, None] < na[:, None, None]) & (np.arange(6)[None, None, :] < nb[:, None, None])
        where = np.nonzero(both)
        at.append(where[0])
        key.append((pair << 24) | ia[where[0], where[1]] << 12 | ib[where[0], where[2]])
    return np.concatenate(at), np.concatenate(key)


# ---------------------------------------------------------------- links within keys


def _forest(pairs: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """The smallest position that each of n positions reaches over the pairs."""
    a, b = pairs
    label = np.arange(n)
    while True:
        a, b = label[a], label[b]
        apart = a != b
        a, b = a[apart], b[apart]
        if not len(a):
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label[label], label):
            label = label[label]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of fingerprints."""
    return np.bitwise_count(a ^ b).sum(axis=1)


def _flood(fp: np.ndarray, bits: int) -> np.ndarray:
    """As _forest, for one group in which any two members may be linked: each member is expanded
    once, against those not yet reached."""
    label = np.full(len(fp), -1)
    todo = np.arange(len(fp))
    while len(todo):
        root, todo = todo[0], todo[1:]
        label[root] = root
        front = [root]
        while front and len(todo):
            near = _apart(fp[todo], fp[front.pop()]) <= bits
            hit = todo[near]
            label[hit] = root
            front.extend(hit.tolist())
            todo = todo[~near]
    return label


def _links(key: np.ndarray, fp: np.ndarray, bits: int) -> np.ndarray:
    """Positions of the roots, for rows sorted by key; whole groups only."""
    n = len(key)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(first, n))
    label = np.arange(n)
    for s, m in zip(first[size > _NEAR].tolist(), size[size > _NEAR].tolist(), strict=True):
        label[s : s + m] = s + _flood(fp[s : s + m], bits)
    small = np.repeat(size <= _NEAR, size)
    last = np.repeat(first + size, size)
    left, right = [], []
    live = np.flatnonzero(small & (last - np.arange(n) > 1))
    lag = 1
    while len(live):
        near = _apart(fp[live], fp[live + lag]) <= bits
        left.append(live[near])
        right.append(live[near] + lag)
        lag += 1
        live = live[last[live] - live > lag]
    if left:
        found = _forest((np.concatenate(left), np.concatenate(right)), n)
        label = np.where(small, found, label)
    return label


def _link_groups(bits: int, block: int, prints: int, named: bool):
    """Over batches (key, fingerprints, and names if ``named``) sorted by key: forest edges (kind 0: a
    linked to b, by name) of groups up to ``block`` members; larger groups are passed on (kind 1: a
    the key, then the columns)."""
    columns = _columns(prints) + ["name"] * named
    names = ["kind", "a", "b", *columns]

    def rows(kind: int, a: np.ndarray, b: np.ndarray, fp: np.ndarray | None) -> pa.RecordBatch:
        held = [pa.nulls(len(a), pa.int64())] * len(columns) if fp is None else [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in fp.T]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a), pa.array(b), *held], names)

    def solve(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        root = _links(key, fp[:, :prints], bits)
        moved = np.flatnonzero(root != np.arange(len(root)))
        if len(moved):
            name = fp[:, prints] if named else _node(fp)
            edges = np.stack([name[moved], name[root[moved]]], 1).view(np.int64)
            edges = np.unique(edges[edges[:, 0] != edges[:, 1]], axis=0)
            yield rows(0, np.ascontiguousarray(edges[:, 0]), np.ascontiguousarray(edges[:, 1]), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp = np.empty(0, np.int64), np.empty((0, len(columns)), np.uint64)
        passing = None
        for b in batches:
            new = np.stack([b.column(1 + k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(len(columns))], 1)
            key = np.concatenate([held_key, b.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([held_fp, new])
            if passing is not None:
                n = int(np.searchsorted(key, passing, "right"))
                if n:
                    yield rows(1, key[:n], key[:n], fp[:n])
                key, fp = key[n:], fp[n:]
                if not len(key):
                    held_key, held_fp = key, fp
                    continue
                passing = None
            cut = int(np.searchsorted(key, key[-1], "left")) if len(key) else 0
            yield from solve(key[:cut], fp[:cut])
            held_key, held_fp = key[cut:], fp[cut:]
            if len(held_key) > block:
                passing = held_key[0]
                yield rows(1, held_key, held_key, held_fp)
                held_key, held_fp = held_key[:0], held_fp[:0]
        if len(held_key):
            yield from solve(held_key, held_fp)

    return run, "kind byte, a long, b long, " + ", ".join(f"{c} long" for c in columns)


def link_fingerprints(fps: DataFrame, bits: int = BITS, prints: int = 1, keyed_by: int = 0, named: bool = False, block: int = BLOCK) -> DataFrame:
    """Edges ``a, b`` whose components are those of all links that the keys of fingerprint
    ``keyed_by`` find in ``fps`` (f0, ..), which with one print are all links.  Edges join nodes, or
    the values of ``fps.name`` if ``named``."""
    if prints == 1 and bits > 4:
        raise ValueError("the keys find links of up to 4 differing bits")
    columns = _columns(prints) + ["name"] * named

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            for lo in range(0, b.num_rows, 2048):
                at, key = keys_of(np.ascontiguousarray(values[keyed_by][lo : lo + 2048]))
                yield pa.RecordBatch.from_arrays([pa.array(key), *[pa.array(v[lo : lo + 2048][at]) for v in values]], ["key", *columns])

    group, schema = _link_groups(bits, block, prints, named)
    keys = fps.select(*columns).mapInArrow(run, "key long, " + ", ".join(f"{c} long" for c in columns))
    found = settled(keys.repartition("key").sortWithinPartitions("key", *columns).mapInArrow(group, schema), "simhash-links")
    edges = found.where("kind = 0").select("a", "b")
    large = found.where("kind = 1").select(F.col("a").alias("key"), *columns)
    sizes = large.groupBy("key").count().withColumn("blocks", F.ceil(F.col("count") / (block // 4)).cast("int"))
    dealt = large.join(sizes.drop("count"), "key").withColumn("i", F.pmod(F.xxhash64(*columns), F.col("blocks")).cast("int"))
    pairs = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"), *columns
    )
    # two blocks hold about block / 2 members; a limit that no hash-dealt pair meets keeps them whole
    whole, schema = _link_groups(bits, 1 << 62, prints, named)
    more = pairs.repartition("key").sortWithinPartitions("key", *columns).mapInArrow(whole, schema)
    return edges.unionByName(more.select("a", "b")).distinct()


# ---------------------------------------------------------------- components


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b) that is not itself the smallest node of
    its component; root is the smallest.

    Each round points every node at its smallest smaller neighbour, follows the pointers to their
    ends, and rewrites the edges between the ends; only nodes without a smaller neighbour are left.
    """

    def ends(parent: DataFrame) -> DataFrame:
        for _ in range(max_rounds):
            above = parent.select(F.col("node").alias("root"), F.col("root").alias("__next"))
            step = parent.join(above, "root", "left")
            parent = settled(step.select("node", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")), "components")
            if parent.where("moved").isEmpty():
                return parent.select("node", "root")
        raise RuntimeError("pointers did not end")

    def downward(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    edges = settled(downward(edges), "components")
    found = None
    for _ in range(max_rounds):
        if edges.isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if found is None else found
        to = ends(settled(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "components"))
        one = edges.join(to.select(F.col("node").alias("a"), F.col("root").alias("pa")), "a")
        two = one.join(to.select(F.col("node").alias("b"), F.col("root").alias("pb")), "b", "left")
        edges = settled(downward(two.select(F.col("pa").alias("a"), F.coalesce("pb", "b").alias("b"))), "components")
        if found is not None:
            further = found.join(to.select(F.col("node").alias("root"), F.col("root").alias("__next")), "root", "left")
            to = further.select("node", F.coalesce("__next", "root").alias("root")).unionByName(to)
        found = settled(to, "components")
    raise RuntimeError("components did not settle")


def classes(docs: DataFrame, shingle: int = 4, bits: int = BITS, prints: int = 1, carry: tuple[str, ...] = ("doc_id",), jaccard: float | None = None) -> DataFrame:
    """The ``carry`` columns, ``fp`` (without ``jaccard``) and ``root`` (which names the row's
    component), one row per input row."""
    if jaccard is not None:
        return similar.classes(docs, shingle, jaccard, carry)
    rows = settled(fingerprint(docs, shingle, prints, carry), "simhash-fp")
    fps = rows.groupBy("node").agg(*[F.first(c).alias(c) for c in _columns(prints)])
    roots = components(link_fingerprints(fps, bits, prints))
    for k in range(1, prints):
        # what is joined already goes by its root: only links between components come out
        fps = fps.drop("name").join(roots, "node", "left").withColumn("name", F.coalesce("root", "node")).drop("root")
        joined = components(link_fingerprints(fps, bits, prints, k, named=True)).select(F.col("node").alias("name"), "root")
        to = fps.select("node", "name").join(joined, "name", "left")
        roots = settled(to.select("node", F.coalesce("root", "name").alias("root")).where("node <> root"), "components")
    named = rows.join(roots, "node", "left")
    return named.select(*carry, F.col("f0").alias("fp"), F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 4, bits: int = BITS) -> DataFrame:
    """``doc_id, fp, component_id``, one row per input row; component_id is the smallest doc_id
    reachable over links of at most ``bits`` differing bits."""
    found = settled(classes(docs.withColumn("doc_id", F.col("doc_id").cast("long")), shingle, bits), "simhash-classes")
    least = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "root").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SIMILAR["shingle"], jaccard: float = SIMILAR["jaccard"]) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row of the smallest
    doc_id stays (nulls last; then the smallest hash of the row), whole and once."""
    whole = docs.select(row_of(docs.columns))  # no name of the input meets one used here
    marked = whole.select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), F.xxhash64("row").alias("hash"))
    found = classes(marked, shingle, carry=("doc_id", "hash"), jaccard=jaccard)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("k")
    kept = found.groupBy("root").agg(first).select(F.col("k.doc_id").alias("id"), F.col("k.hash").alias("kept"))
    same = marked["doc_id"].eqNullSafe(kept["id"]) & (marked["hash"] == kept["kept"])
    return marked.join(kept, same, "left_semi").dropDuplicates(["doc_id", "hash"]).select("row.*")
