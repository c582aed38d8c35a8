"""Minimum-cost role repair of conversations, and rendering.

Legal sequences: an optional system turn, then user and assistant turns in alternation, ending with
the assistant.  Dynamic programming over the states of that automaton chooses, for every turn,
whether it keeps its role, takes another, or joins the turn before it, and where empty turns are
inserted; costs are ``COSTS``.  No text is dropped.

Turns are dealt by range of (conversation, turn), so that a conversation of any length spreads over
tasks, and cut into chunks of at most ``CHUNK`` turns.  A chunk's best costs between any two states
are a 4 x 4 min-plus matrix; the matrices of a conversation are joined in order to give each chunk
its entry and exit state, and each chunk is then traced on its own.

Each input turn gives one row with its piece of the rendering; the pieces of a conversation in the
order of ``position`` are the rendered sequence (``rendered`` joins them).

Roles are trimmed and lower-cased; other or null roles are unknown and cheap to relabel.  A null
text is an empty one.  Turns are ordered by ``turn`` (nulls last), then role, a hash of the text and the text;
repeated rows are turns of their own.  Rows with a null ``conv_id`` form one conversation.  The template's marks
in a text are broken by a space.  Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import settled

ROLES = ("system", "user", "assistant")
COSTS = {"merge": 1.0, "relabel": 2.0, "relabel_unknown": 0.5, "insert": 3.0}
CHUNK = 1024
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: Roles that may follow each state, and the state a role leads to.
_NEXT = {_START: ("system", "user"), _SYSTEM: ("user",), _USER: ("assistant",), _ASSISTANT: ("user",)}
_STATE = {"system": _SYSTEM, "user": _USER, "assistant": _ASSISTANT}
_ROLE = {v: k for k, v in _STATE.items()}
_FAR = float("inf")


@lru_cache(maxsize=64)
def _insertions(state: int) -> tuple[tuple[int, tuple[str, ...]], ...]:
    """States within two empty turns of a state, nearest first; a system turn is never inserted."""
    found = [(state, ())]
    for s, roles in found:
        if len(roles) < 2:
            found += [(_STATE[r], (*roles, r)) for r in _NEXT[s] if r != "system"]
    return tuple(found)


@lru_cache(maxsize=64)
def moves(role: str | None) -> tuple[tuple[tuple[float, tuple[str, ...], bool], ...], ...]:
    """[from][to]: the cheapest (cost, turns inserted before, joins the turn before) for a turn of
    this role; ties prefer fewer insertions, then no merge."""
    table = [[(_FAR, (), False)] * 4 for _ in range(4)]

    def as_role(r: str) -> float:
        return 0.0 if r == role else COSTS["relabel" if role else "relabel_unknown"]

    for s in range(4):
        for m, inserted in _insertions(s):
            for r in _NEXT[m]:
                cost = COSTS["insert"] * len(inserted) + as_role(r)
                if cost < table[s][_STATE[r]][0]:
                    table[s][_STATE[r]] = (cost, inserted, False)
        if s != _START:
            cost = COSTS["merge"] + as_role(_ROLE[s])
            if cost < table[s][s][0]:
                table[s][s] = (cost, (), True)
    return tuple(tuple(row) for row in table)


def _ending(state: int) -> tuple[float, tuple[str, ...]]:
    m = next(roles for s, roles in _insertions(state) if s == _ASSISTANT)
    return COSTS["insert"] * len(m), m


def _known(role: str | None) -> str | None:
    r = (role or "").strip().lower()
    return r if r in ROLES else None


def matrix(roles: list[str | None]) -> list[list[float]]:
    """Least cost from every state to every state over a run of turns."""
    best = [[0.0 if a == b else _FAR for b in range(4)] for a in range(4)]
    for role in roles:
        step = moves(role)
        best = [[min(row[m] + step[m][b][0] for m in range(4)) for b in range(4)] for row in best]
    return best


def trace(roles: list[str | None], entry: int, leave: int) -> list[tuple[int, float, tuple[str, ...], bool]]:
    """Per turn: (state after it, cost, turns inserted before it, joins the turn before)."""
    value, back = [0.0 if s == entry else _FAR for s in range(4)], []
    for role in roles:
        step = moves(role)
        came = [min(range(4), key=lambda m, b=b: (value[m] + step[m][b][0], m)) for b in range(4)]
        value = [value[came[b]] + step[came[b]][b][0] for b in range(4)]
        back.append(came)
    out, state = [], leave
    for role, came in zip(reversed(roles), reversed(back), strict=True):
        cost, inserted, joins = moves(role)[came[state]][state]
        out.append((state, cost, inserted, joins))
        state = came[state]
    return out[::-1]


def join_chunks(matrices: list[list[list[float]]]) -> list[tuple[int, int]]:
    """Entry and exit state of each chunk of a conversation on a cheapest path."""
    value, before = [0.0, _FAR, _FAR, _FAR], []
    for m in matrices:
        before.append(value)
        value = [min(value[a] + m[a][b] for a in range(4)) for b in range(4)]
    state = min(range(4), key=lambda s: (value[s] + _ending(s)[0], s))
    out = []
    for v, m in zip(reversed(before), reversed(matrices), strict=True):
        entry = min(range(4), key=lambda a: (v[a] + m[a][state], a))
        out.append((entry, state))
        state = entry
    return out[::-1]


# ---------------------------------------------------------------- rendering


def _open(role: str) -> str:
    return f"<|im_start|>{role}\n"


_CLOSE = "<|im_end|>\n"


def piece(text: str | None, state: int, inserted: tuple[str, ...], joins: bool, first: bool, last: bool) -> str:
    """A turn's part of the rendering: closes the open turn if it starts a new one."""
    body = (text or "").replace("<|im_", "<| im_")
    if joins:
        out = "\n" + body
    else:
        out = ("" if first else _CLOSE) + "".join(_open(r) + _CLOSE for r in inserted) + _open(_ROLE[state]) + body
    if last:
        out += _CLOSE + "".join(_open(r) + _CLOSE for r in _ending(state)[1])
    return out


def _runs(values: list) -> Iterator[tuple[int, int]]:
    begin = 0
    for i in range(1, len(values) + 1):
        if i == len(values) or values[i] != values[begin]:
            yield begin, i
            begin = i


def _whole_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one chunk at a time, from batches sorted by chunk."""
    held: list[dict] = []
    for b in batches:
        rows = held + b.to_pylist()
        ends = [e for _, e in _runs([r["chunk"] for r in rows])]
        begin = 0
        for e in ends[:-1]:
            yield rows[begin:e]
            begin = e
        held = rows[begin:]
    if held:
        yield held


def repair(turns: DataFrame) -> DataFrame:
    """Per turn: ``conv_id, position, turn, role, role_out, action, inserted_before, inserted_after,
    cost, piece``."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select("conv_id", F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last, members = TaskContext.get().partitionId() << 32, object(), 0
        for b in batches:
            chunk, place = [], []
            for c in b.column(0).to_pylist():
                if c != last or members == CHUNK:
                    number, last, members = number + 1, c, 0
                chunk.append(number)
                place.append(members)
                members += 1
            yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(place, pa.int32()), *b.columns], ["chunk", "place", *b.schema.names])

    dealt = settled(ranged.mapInArrow(chunks, f"chunk long, place int, conv_id {kind}, turn long, role string, text string"), "chat-turns")

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _whole_chunks(batches):
            m = matrix([_known(r["role"]) for r in group])
            flat = [x for row in m for x in row]
            yield pa.RecordBatch.from_arrays([pa.array([group[0]["chunk"]]), pa.array([flat], pa.list_(pa.float64())), pa.array([len(group)], pa.int32())], ["chunk", "m", "n"])

    by_chunk = dealt.select("chunk", "place", "role").repartition("chunk").sortWithinPartitions("chunk", "place")
    whole = by_chunk.mapInArrow(costs, "chunk long, m array<double>, n int")
    owner = dealt.where("place = 0").select("chunk", "conv_id")
    # a conversation of n turns brings n / CHUNK small matrices together
    lists = whole.join(owner, "chunk").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "m", "n"))).alias("parts"))

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chunk, entry, leave, start, size, final = [], [], [], [], [], []
            for parts in b.column(0).to_pylist():
                path = join_chunks([[p["m"][4 * a : 4 * a + 4] for a in range(4)] for p in parts])
                done = 0
                for i, (p, (a, z)) in enumerate(zip(parts, path, strict=True)):
                    chunk.append(p["chunk"])
                    entry.append(a)
                    leave.append(z)
                    start.append(done)
                    size.append(p["n"])
                    final.append(i == len(parts) - 1)
                    done += p["n"]
            yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(entry, pa.int32()), pa.array(leave, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int32()), pa.array(final, pa.bool_())], ["chunk", "entry", "leave", "start", "size", "final"])

    path = lists.select("parts").mapInArrow(states, "chunk long, entry int, leave int, start long, size int, final boolean")
    traced = dealt.join(path, "chunk").sortWithinPartitions("chunk", "place")
    columns = f"conv_id {kind}, position long, turn long, role string, role_out string, action string, inserted_before array<string>, inserted_after array<string>, cost double, piece string"
    kinds = [None, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64(), pa.string()]
    names = [c.split()[0] for c in columns.split(", ")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def ready() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) if k is not None else pa.array(c, first_type[0]) for c, k in zip(cols, kinds, strict=True)], names)

        first_type: list = []

        def typed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in source:
                if not first_type:
                    first_type.append(b.schema.field("conv_id").type)
                yield b

        for group in _whole_chunks(typed(batches)):
            roles = [_known(r["role"]) for r in group]
            for i, (r, role, (state, cost, inserted, joins)) in enumerate(zip(group, roles, trace(roles, group[0]["entry"], group[0]["leave"]), strict=True)):
                first, last = r["start"] + i == 0, r["final"] and i == len(group) - 1
                changed = role != _ROLE[state]
                action = ("merge+relabel" if changed else "merge") if joins else "relabel" if changed else "keep"
                after = _ending(state) if last else (0.0, ())
                out.append((r["conv_id"], r["start"] + i, r["turn"], r["role"], _ROLE[state], action, list(inserted), list(after[1]), cost + after[0], piece(r["text"], state, inserted, joins, first, last)))
            if len(out) >= 2048:
                yield ready()
        if out:
            yield ready()

    return traced.mapInArrow(write, columns)


def rendered(repaired: DataFrame) -> DataFrame:
    """``conv_id, text, cost``: the pieces joined; one row holds a conversation."""
    parts = repaired.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("position", "piece"))).alias("p"), F.sum("cost").alias("cost"))
    return parts.select("conv_id", F.concat_ws("", F.col("p.piece")).alias("text"), "cost")
