import hashlib
import random
import re
import zlib

import duckdb
import pytest

from tests.conftest import DATA
from tidewater.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, d long, id string, key binary, seg int, words array<int>"
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def frame(spark, turns):
    """Turns whose extra columns clash with names that the operator uses inside."""
    return spark.createDataFrame([(*t, 1, "x", b"k", 2, [3]) for t in turns], SCHEMA)


def brute(turns, family=20, heads=4):
    own = {}
    for c, t, role, text in turns:
        if c is not None:
            r, x = role or "", text or ""
            order = (t is not None, t or 0, r, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest()[:32])
            own.setdefault(c, []).append((order, r, x))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    seq = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        donor = c - int(abs(c) % family) * (1 if c >= 0 else -1)
        seq[c] = own.get(donor, [])[:h] + mine[h:]
    return nodes(seq)


def nodes(seq):
    members, below, value = {}, {}, {}
    for c, s in seq.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), set()).add(c)
    for p in members:
        if p:
            below.setdefault(p[:-1], []).append(p)
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        kids = below.get(p, [])
        value[p] = (sum(value[k][0] for k in kids) or 1, sum(value[k][1] for k in kids) + (len(members[p]) - 1) * words)
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(seq[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(below.get(p, [])), *value[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == OUT
    return sorted((tuple(r) for r in df.collect()), key=repr)


def rebuilt(df, **kw):
    return prefix_trie.trie(prefix_trie.rebuild(prefix_trie.number_turns(df)), **kw)


def some_turns(seed):
    """Conversations over few distinct turns, so that prefixes are shared; ids around 0 on both sides."""
    rng = random.Random(seed)
    turns = []
    for c in [*range(-45, 120), 2**40, 2**40 + 7]:
        if c % 11:
            turns += [(c, t if rng.random() < 0.95 else None, rng.choice(["u", "a", None]), rng.choice(["x", "y z", None, " é\t\x0bw "])) for t in range(rng.choice([0, 1, 1, 2, 3, 6]))]
    return turns


@pytest.mark.parametrize("run_turns", [1, 7, 40, 10**6])
def test_equals_brute_force(spark, run_turns):
    turns = some_turns(run_turns)
    assert got(rebuilt(frame(spark, turns).repartition(5), run_turns=run_turns)) == brute(turns)


@pytest.mark.parametrize("run_turns", [300, 10**6])
def test_long_conversations(spark, run_turns):
    """More turns than a segment, in one conversation and in several that part in a later one or end at a segment's end."""
    body = [("u" if i % 2 else "a", f"turn {i % 97} of {i}") for i in range(900)]
    sizes = {1: 900, 2: 700, 3: 256, 4: 512, 5: 300, 6: 257, 7: 255, 8: 1, 9: 900, 10: 256, 40: 900, 41: 515}
    turns = [(c, i, *body[i]) for c, n in sizes.items() for i in range(n)] + [(9, 900, "u", "other end"), (5, 300, "u", "part way"), (11, 0, "u", "alone")]
    turns += [(12, i, *(body[i] if i != 600 else ("u", "branch"))) for i in range(800)]
    df = frame(spark, turns)
    assert got(rebuilt(df, run_turns=run_turns)) == brute(turns)
    plain = {}
    for c, _, role, text in sorted(turns, key=lambda t: t[:2]):
        plain.setdefault(c, []).append((role, text))
    assert got(prefix_trie.trie(prefix_trie.number_turns(df), run_turns=run_turns)) == nodes(plain)


def test_hot_conversation(spark):
    """Thousands of equal conversations: their ids are hashed over chunks and runs."""
    turns = [(c, 0, "user", "same first turn") for c in range(9000)] + [(c, 1, "assistant", f"answer {c % 3}") for c in range(0, 9000, 2)] + [(20_000 + c, 0, "user", "own") for c in range(3)]
    plain = {}
    for c, _, role, text in turns:
        plain.setdefault(c, []).append((role, text))
    assert got(prefix_trie.trie(prefix_trie.number_turns(frame(spark, turns)), run_turns=2500)) == nodes(plain)


def test_edges(spark):
    turns = [(None, 1, "user", "no id"), (5, None, None, None), (5, None, None, None), (5, 1, "user", "x" * 300_000), (5, 1, "user", "tie"), (5, 1, "assistant", "tie"), (7, 0, "", ""), (21, 3, "user", "w " * 50_000)]
    assert got(rebuilt(frame(spark, turns))) == brute(turns)
    assert rebuilt(frame(spark, turns[:1])).collect() == []
    assert rebuilt(frame(spark, turns).where("false")).collect() == []


def test_tree_holds_its_keys():
    """Every layout of a node, prefixes of other keys included."""
    rng = random.Random(1)
    keys = {bytes(rng.choices(range(k), k=n)) for k in (2, 14, 40, 256) for n in (0, 1, 2, 3, 9) for _ in range(300)}
    tree = prefix_trie.RadixTree()
    for k in rng.sample(sorted(keys), len(keys)):
        tree.insert(k, list).append(k)
        tree.insert(k, list).append(k)
    held, layouts = [], set()
    for node, _, end, _ in tree.post_order():
        layouts.add((type(node.children).__name__, getattr(node.children, "places", 0)))
        if node.value is not None:
            assert len(node.value) == 2 and len(node.value[0]) == end
            held.append(node.value[0])
    assert sorted(held) == sorted(keys) and layouts == {("Few", 4), ("Few", 16), ("Indexed", 0), ("Full", 0)}


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    want = con.sql(f"SELECT {', '.join(OUT)} FROM ({queries.oracle_sql()['op12_prefix_trie']})").fetchall()
    assert got(queries.op12_prefix_trie(spark, DATA)) == sorted(want, key=repr)
