"""Conversations as a prefix trie, built from adaptive radix trees over fixed-width turn ids.

A turn's *id* is the first 16 bytes, big-endian, of the SHA-256 of its role's length, role and text; the ids
of a conversation in order are its key.  Keys are dealt by range and sorted, and each task inserts its
range in runs of about ``RUN_TURNS`` turns into an adaptive radix tree: nodes of 4, 16, 48 or 256 places that
grow when full, and compressed paths.  Byte depths that are whole turns emit nodes of the trie, those on a
compressed path too.

What a node says of its subtree is a sum (or a minimum) over runs.  Only prefixes of the first and last key of a
run can go on in another run; they are *partial* and added up by their key.  Turns, children and leaves that
two neighbouring runs share are counted by both, so each pair of neighbours (its last and first key) takes them off once.  A
key or a prefix that a third of all conversations share is thus spread over runs like any other, and no group is collected.

Keys are cut into segments of ``SEGMENT`` turns, sorted below the (exclusive-or) hash of all segments before
them, so a conversation may have any length.  A segment carries sums over its conversation's later segments.

``saved_tokens`` of a node: over its subtree, each node's (conversations - 1) times the words of its last text, as
the sum over its conversations of words from there on less the sum over distinct nodes.

Turns are ordered by ``turn`` (null first), then role and id.  Null roles and texts are empty; repeated rows are
turns of their own.  Rows with a null ``conv_id`` take no part.  Extra columns are ignored.  An empty
table gives no rows, not even a root.  ``ends_sha256`` is one stream by definition: chunks of ``CHUNK`` ids
of a node that spans runs meet in order in one task, which holds one chunk at a time.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.shared import settled

WIDTH = 16
SEGMENT = 256
RUN_TURNS = 200_000
CHUNK = 4096
#: Turns of one conversation that meet one row of the table of heads.
_BLOCK = 1 << 16
_ROOT = bytes(WIDTH)
_NONE = hashlib.sha256(b"").hexdigest()
#: Boundary nodes up to this many (about 40 bytes each) are broadcast, more are joined by a shuffle.
BROADCAST_ROWS = 500_000


# ---------------------------------------------------------------- adaptive radix tree


def common(a: bytes, b: bytes, begin: int = 0) -> int:
    """How many bytes from ``begin`` on agree, by bisection over slices."""
    lo, hi = 0, min(len(a), len(b)) - begin
    if a[begin : begin + hi] == b[begin : begin + hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[begin + lo : begin + mid] == b[begin + lo : begin + mid]:
            lo = mid
        else:
            hi = mid
    return lo


class Few:
    """Up to ``places`` children, as a sorted list of bytes beside a list of nodes."""

    __slots__ = ("keys", "nodes", "places")

    def __init__(self, places: int):
        self.places, self.keys, self.nodes = places, bytearray(), []

    def get(self, byte: int) -> Node | None:
        at = self.keys.find(byte)
        return self.nodes[at] if at >= 0 else None

    def put(self, byte: int, node: Node) -> Few | Indexed:
        at = bisect_left(self.keys, byte)
        if at < len(self.keys) and self.keys[at] == byte:
            self.nodes[at] = node
            return self
        if len(self.keys) == self.places:
            bigger = Few(16) if self.places == 4 else Indexed()
            for k, n in zip(self.keys, self.nodes, strict=True):
                bigger = bigger.put(k, n)
            return bigger.put(byte, node)
        self.keys.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def all(self) -> list[Node]:
        return self.nodes


class Indexed:
    """Up to 48 children: an index of 256 bytes into a list of nodes."""

    __slots__ = ("index", "nodes")

    def __init__(self):
        self.index, self.nodes = bytearray(256), []

    def get(self, byte: int) -> Node | None:
        at = self.index[byte]
        return self.nodes[at - 1] if at else None

    def put(self, byte: int, node: Node) -> Indexed | Full:
        at = self.index[byte]
        if at:
            self.nodes[at - 1] = node
            return self
        if len(self.nodes) == 48:
            bigger = Full()
            for k, i in enumerate(self.index):
                if i:
                    bigger.put(k, self.nodes[i - 1])
            return bigger.put(byte, node)
        self.nodes.append(node)
        self.index[byte] = len(self.nodes)
        return self

    def all(self) -> list[Node]:
        return [self.nodes[i - 1] for i in self.index if i]


class Full:
    """256 places."""

    __slots__ = ("nodes",)

    def __init__(self):
        self.nodes: list[Node | None] = [None] * 256

    def get(self, byte: int) -> Node | None:
        return self.nodes[byte]

    def put(self, byte: int, node: Node) -> Full:
        self.nodes[byte] = node
        return self

    def all(self) -> list[Node]:
        return [n for n in self.nodes if n is not None]


class Node:
    """``path``: the compressed bytes after the byte that leads here; ``value``: what ends here."""

    __slots__ = ("path", "children", "value")

    def __init__(self, path: bytes, value: object = None):
        self.path, self.children, self.value = path, Few(4), value


class RadixTree:
    def __init__(self):
        self.root: Node | None = None

    def insert(self, key: bytes, make: type) -> object:
        """The value at the key, made if there is none."""
        if self.root is None:
            self.root = Node(key, make())
            return self.root.value
        parent, byte, node, depth = None, 0, self.root, 0
        while True:
            if key.startswith(node.path, depth):
                depth += len(node.path)
                if depth == len(key):
                    if node.value is None:
                        node.value = make()
                    return node.value
                child = node.children.get(key[depth])
                if child is None:
                    leaf = Node(key[depth + 1 :], make())
                    node.children = node.children.put(key[depth], leaf)
                    return leaf.value
                parent, byte, node, depth = node, key[depth], child, depth + 1
                continue
            same = common(node.path, key[depth : depth + len(node.path)])
            upper = Node(node.path[:same])
            lower, node.path = node.path[same], node.path[same + 1 :]
            upper.children = upper.children.put(lower, node)
            if parent is None:
                self.root = upper
            else:
                parent.children = parent.children.put(byte, upper)
            node = upper

    def post_order(self) -> Iterator[tuple[Node, int, int, int]]:
        """Nodes after their children: node, byte depth before and after its path, number of children."""
        if self.root is None:
            return
        stack = [(self.root, 0, False)]
        while stack:
            node, begin, seen = stack.pop()
            end = begin + len(node.path)
            below = node.children.all()
            if seen or not below:
                yield node, begin, end, len(below)
            else:
                stack.append((node, begin, True))
                stack += [(c, end + 1, False) for c in reversed(below)]


# ---------------------------------------------------------------- turns and keys


def number_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, d, id, words``: every turn with its place from 1 and its id in hex."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    framed = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", role.alias("role"), F.substring(framed, 1, 2 * WIDTH).alias("id"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("id")]
    kind = turns.schema["conv_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, members = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            conv = b.column(0).to_numpy()
            first = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
            size = np.diff(np.append(first, len(conv)))
            at = np.arange(len(conv)) - np.repeat(first, size)
            if conv[0] == last:
                at[: size[0]] += members
            members = int(at[-1]) + 1
            last = conv[-1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(conv), part, np.int32)), pa.array(at + 1), b.column(1), b.column(2)], ["conv_id", "part", "d", "id", "words"])

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "id", F.col("words").cast("int"))
    dealt = settled(dealt.mapInArrow(place, f"conv_id {kind}, part int, d long, id string, words int"), "trie-turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(before)).where("before > 0").drop("n")
    # only the first conversation of a part can have begun earlier: at most a row per part
    return dealt.join(F.broadcast(offset), ["conv_id", "part"], "left").select("conv_id", (F.col("d") + F.coalesce("before", F.lit(0))).alias("d"), "id", "words")


def rebuild(numbered: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """Every conversation c begins with the first h turns of ``c - c % family`` in place of its own first h, h being the
    CRC-32 of c modulo ``heads``.  A conversation without turns keeps a row with a null id."""
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string")) % heads).cast("int")
    head = numbered.where((c % family == 0) & (F.col("d") < heads)).groupBy(c.alias("donor")).agg(F.sort_array(F.collect_list(F.struct("d", "id", "words"))).alias("head"))
    convs = numbered.groupBy("conv_id").agg(F.max("d").alias("n")).withColumn("donor", c - c % family).join(head, "donor", "left")
    convs = convs.select("conv_id", "n", h.alias("h"), F.coalesce(F.slice("head", 1, h), F.array().cast(head.schema["head"].dataType)).alias("head"))
    taken = convs.select("conv_id", "h", F.size("head").alias("taken"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / _BLOCK))).alias("block"))
    own = numbered.withColumn("block", F.floor(F.col("d") / _BLOCK)).join(taken, ["conv_id", "block"])
    own = own.where("d > h").select("conv_id", (F.col("d") - F.col("h") + F.col("taken")).alias("d"), "id", "words")
    given = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.d", "t.id", "t.words")
    mark = convs.select("conv_id", F.lit(1).cast("long"), F.lit(None).cast("string"), F.lit(0))
    return own.unionByName(given).union(mark)


def _segments(rows: DataFrame) -> DataFrame:
    """``conv_id, seg, ids, words, prefix, after, continues, words_below, new_below, leaves_below``: a row per segment."""
    seg = F.floor((F.col("d") - 1) / SEGMENT)
    turn = F.when(F.col("id").isNotNull(), F.struct("d", "id", "words"))
    grouped = rows.groupBy("conv_id", seg.alias("seg")).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    segs = settled(grouped.select("conv_id", "seg", F.unhex(F.concat_ws("", "t.id")).alias("ids"), F.col("t.words").alias("words")), "trie-segments")

    zero = F.lit(_ROOT)
    nothing = [F.lit(0).cast("long").alias(c) for c in ("words_below", "new_below", "leaves_below")]
    is_long = (F.col("seg") > 0) | (F.size("words") == SEGMENT)
    short = segs.where(~is_long).select("*", zero.alias("prefix"), F.lit(None).cast("binary").alias("after"), F.lit(False).alias("continues"), *nothing)

    def packed(a: Column, b: Column) -> Column:
        return F.unhex(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))

    order = Window.partitionBy("conv_id").orderBy("seg")
    before, upto, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("conv_id")
    none = F.lit(0).cast("long")
    marks = [F.xxhash64("ids", "seg", F.lit(k)) for k in (1, 2)]
    # one row for each SEGMENT turns of a conversation
    long = segs.where(is_long).withColumns({"h1": marks[0], "h2": marks[1], "all_words": F.aggregate("words", none, lambda a, w: a + w)})
    long = long.withColumns(
        {
            "prefix": packed(F.coalesce(F.bit_xor("h1").over(before), none), F.coalesce(F.bit_xor("h2").over(before), none)),
            "after": F.when(F.size("words") == SEGMENT, packed(F.bit_xor("h1").over(upto), F.bit_xor("h2").over(upto))),
            "continues": F.lead("seg").over(order).isNotNull(),
            "words_below": F.sum("all_words").over(whole) - F.sum("all_words").over(upto),
        }
    )
    deep = long.where("seg > 0").select("conv_id", "seg", "prefix", "ids", "continues", F.size("words").alias("n"), F.posexplode("words").alias("j", "w"))
    node = F.md5(F.concat("prefix", F.expr(f"substring(ids, 1, {WIDTH} * (j + 1))")))
    ends = (F.col("j") + 1 == F.col("n")) & ~F.col("continues")
    nodes = deep.groupBy(node.alias("node"), "seg").agg(F.min("conv_id").alias("conv_id"), F.first("w").alias("w"), F.bool_and(ends).alias("leaf"))
    owned = nodes.groupBy("conv_id", "seg").agg(F.sum("w").alias("own_new"), F.count_if("leaf").alias("own_leaves"))
    long = long.join(owned, ["conv_id", "seg"], "left")
    for c in ("new", "leaves"):
        own = F.coalesce(f"own_{c}", none)
        long = long.withColumn(f"{c}_below", F.sum(own).over(whole) - F.sum(own).over(upto))
    return short.unionByName(long.select(*short.columns))


# ---------------------------------------------------------------- runs


class _Ends:
    """What a key holds: its rows, and sums over their later segments."""

    __slots__ = ("members", "count", "least", "words_below", "new_below", "leaves_below", "goes_on", "after", "seg", "key")

    def __init__(self):
        self.members, self.count, self.least, self.words_below, self.new_below, self.leaves_below, self.goes_on = [], 0, None, 0, 0, 0, False


_NODE = "kind int, node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, s1 long, s2 long, ends_sha256 string"
_EDGE = "part int, run int, first_key binary, first_words array<int>, first_after binary, last_key binary, last_ends boolean"
_NAMES = [c.split()[0] for c in (_NODE + ", ends string, " + _EDGE).split(", ")]
_COMPLETE, _PARTIAL, _MEMBERS, _RUN = range(4)


def _node_key(key: bytes, end: int, after: bytes | None) -> bytes:
    """The key of the node at byte depth ``end``: a segment's root and its last turn are named by the hash of segments."""
    if end == WIDTH:
        return key[:WIDTH]
    if end == WIDTH * (SEGMENT + 1):
        return after
    return hashlib.blake2b(key[:end], digest_size=WIDTH).digest()


def _joined(ids: list[int]) -> str:
    return ",".join(map(str, ids))


class Run:
    """Sorted keys of one run, as a tree, and the rows that come of it."""

    def __init__(self, part: int, number: int):
        self.part, self.number, self.tree, self.words, self.turns = part, number, RadixTree(), {}, 0
        self.first = self.last = None

    def add(self, conv: int, seg: int, key: bytes, words: list[int], after: bytes | None, continues: bool, below: tuple[int, int, int]) -> None:
        e: _Ends = self.tree.insert(key, _Ends)
        if not e.count:
            e.key, e.seg, e.after = key, seg, after
            for i, w in enumerate(words):
                self.words[key[WIDTH * (i + 1) : WIDTH * (i + 2)]] = w
        e.count += 1
        e.least = conv if e.least is None else min(e.least, conv)
        e.words_below += below[0]
        e.new_below += below[1]
        e.leaves_below += below[2]
        if continues:
            e.goes_on = True
        else:
            e.members.append(conv)
        if self.first is None:
            self.first = (key, list(words), after)
        self.last = (key, not continues)
        self.turns += len(words) + 1

    def rows(self) -> Iterator[tuple]:
        first, last = self.first[0], self.last[0]
        out: list[list] = []
        pending: list[tuple] = []  # results of children that wait for their parent
        for node, begin, end, n_below in self.tree.post_order():
            below = pending[len(pending) - n_below :]
            del pending[len(pending) - n_below :]
            count, least, leaves, s1, s2, tops, e = 0, None, 0, 0, 0, [], node.value
            for c in below:
                count += c[0]
                least = c[1] if least is None else min(least, c[1])
                leaves += c[2]
                s1 += c[3]
                s2 += c[4]
                tops += c[5]
            rep = e if e is not None else below[0][6]
            members = []
            if e is not None:
                count += e.count
                least = e.least if least is None else min(least, e.least)
                leaves += e.leaves_below + (not below and not e.goes_on)
                s1 += e.words_below
                s2 += e.new_below
                members = e.members
            key = rep.key
            shared = max(common(key, first), common(key, last))
            # whole turns on this node's path, from the deepest up
            for depth in range(end - end % WIDTH, begin - 1, -WIDTH):
                if depth < WIDTH or depth < begin:
                    break
                j = depth // WIDTH - 1
                deep_root = j == 0 and rep.seg > 0
                partial = depth <= shared or j == SEGMENT or deep_root
                w = self.words[key[depth - WIDTH : depth]] if j else 0
                s1, s2 = s1 + count * w, s2 + w
                name = _node_key(key, depth, rep.after if depth == len(key) else None) if partial else None
                for i in tops:
                    if partial:
                        out[i][2] = name
                    else:
                        out[i][5] = least
                mine = members if depth == end else []
                sha = None if partial else hashlib.sha256(_joined(sorted(mine)).encode()).hexdigest() if mine else _NONE
                row = [_PARTIAL if partial else _COMPLETE, name, None, rep.seg * SEGMENT + j, least, None, count, len(tops), leaves, s1, s2, sha]
                if deep_root:
                    row[6] = row[8] = row[9] = row[10] = 0
                if partial and mine:
                    mine.sort()
                    for lo in range(0, len(mine), CHUNK):
                        yield (_MEMBERS, name, None, None, mine[lo], *[None] * 7, _joined(mine[lo : lo + CHUNK]), *[None] * 7)
                tops = [len(out)]
                out.append(row)
            pending.append((count, least, leaves, s1, s2, tops, rep))
        for row in out:
            yield (*row, *[None] * 8)
        yield (_RUN, *[None] * 12, self.part, self.number, first, self.first[1], self.first[2], last, self.last[1])


def _runs(batches: Iterator[pa.RecordBatch], run_turns: int) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 8, pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.bool_()]

    def flush(run: Run) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in run.rows():
            held.append(row)
            if len(held) == 8192:
                yield made(held)
                held = []
        if held:
            yield made(held)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES)

    part, run = TaskContext.get().partitionId(), None
    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        for conv, seg, key, words, after, continues, *below in zip(*columns, strict=True):
            if run is None or run.turns >= run_turns:
                if run is not None:
                    yield from flush(run)
                run = Run(part, 0 if run is None else run.number + 1)
            run.add(conv, seg, key, words, after, continues, below)
    if run is not None:
        yield from flush(run)


def _shared_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What two neighbouring runs both counted, to be added (as negative numbers) by node."""
    for b in batches:
        rows = []
        for r in b.to_pylist():
            last, key, words = r["before_key"], r["first_key"], r["first_words"]
            same = common(last, key) // WIDTH * WIDTH
            ends = same == len(last) and r["before_ends"]
            turns = same // WIDTH - 1
            suffix = 0
            for j in range(turns, -1, -1):
                suffix += words[j - 1] if j else 0
                deep_root = j == 0 and key[:WIDTH] != _ROOT
                end = WIDTH * (j + 1)
                rows.append((_node_key(key, end, r["first_after"]), -int(j < turns), 0 if deep_root else -int(ends), 0 if deep_root else -suffix))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["node", "n_children", "n_leaves", "s2"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's members from sorted chunks, one chunk at a time."""
    node, state = None, None
    for b in batches:
        done = []
        for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if name != node:
                if state is not None:
                    done.append((node, state.hexdigest()))
                node, state = name, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], ["node", "sha"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["node", "sha"])


def trie(rows: DataFrame, run_turns: int = RUN_TURNS) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of ``conv_id, d, id, words``:
    a row per node; a row with a null id says only that its conversation is there."""
    keyed = _segments(rows).select(F.col("conv_id").cast("long"), "seg", F.concat("prefix", "ids").alias("key"), "words", "after", "continues", "words_below", "new_below", "leaves_below")
    order = ["key", "continues", "conv_id"]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    found = settled(ranged.mapInArrow(lambda batches: _runs(batches, run_turns), f"{_NODE}, ends string, {_EDGE}"), "trie-nodes")

    # a row for each run, in order: its last key beside the first of the next
    line = Window.orderBy("part", "run")
    edges = found.where(F.col("kind") == _RUN).select("part", "run", "first_key", "first_words", "first_after", F.lag("last_key").over(line).alias("before_key"), F.lag("last_ends").over(line).alias("before_ends"))
    twice = edges.where("before_key IS NOT NULL AND substring(before_key, 1, 16) = substring(first_key, 1, 16)").mapInArrow(_shared_twice, "node binary, n_children long, n_leaves long, s2 long")

    sums = ["n_convs", "n_children", "n_leaves", "s1", "s2"]
    partial = found.where(F.col("kind") == _PARTIAL).select("node", "parent", "depth", "conv_id", "parent_conv_id", *sums)
    both = partial.unionByName(twice, allowMissingColumns=True)
    merged = both.groupBy("node").agg(*[F.max(c).alias(c) for c in ("parent", "depth", "parent_conv_id")], F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in sums])
    chunks = found.where(F.col("kind") == _MEMBERS).select("node", "conv_id", "ends").repartition("node").sortWithinPartitions("node", "conv_id").select("node", "ends")
    merged = settled(merged.join(chunks.mapInArrow(_hashed, "node binary, sha string"), "node", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(_NONE))), "trie-boundary")

    whole = found.where(F.col("kind") == _COMPLETE).select("parent", "depth", "conv_id", "parent_conv_id", *sums, "ends_sha256").unionByName(merged.drop("node", "sha"))
    tops = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("top"))
    tops = F.broadcast(tops) if merged.count() <= BROADCAST_ROWS else tops
    return whole.join(tops, "parent", "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "top").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", (F.col("s1") - F.col("s2")).alias("saved_tokens"), "ends_sha256"
    )
