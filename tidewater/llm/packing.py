"""Packing documents into training windows by multiway differencing.

A document's tokens are the byte-level BPE ids of its text and a closing id 1.  Whole windows are
cut off its front; what is left is cut evenly into pieces of at most ``piece`` tokens.  Pieces of
about ``windows`` windows are packed together by Karmarkar-Karp multiway differencing: every piece
starts as a partial partition, the two partials with the largest imbalance are merged with their
loads opposed (largest with smallest), until one near-equal partition remains.  Whenever its
largest window exceeds the capacity, the window count rises and the differencing starts again.

Everything happens in one pass over each input partition; nothing is shuffled and a task holds one
group of pieces.  Sequence ids are made of the partition and a counter.

Tokens: the ids of the ``tokenizers`` file (tested against it), read from the rank file of the same
vocabulary.  Texts without a run of white space before a word take a pattern without its look-ahead,
which cuts them alike and is faster; strings of added tokens become those tokens, as in the file.

Nulls and empty texts: the closing id alone.  Very long texts are encoded ``CHUNK`` characters at a
time, cut at a single space between words; a task holds the ids of one text.  Repeated rows and ties
keep one set of pieces each, a null ``doc_id`` stays null.  Other columns, whatever their names, are
ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import parts

END_ID = 1
CHUNK = 1 << 20  # characters encoded at a time
#: White space as the tokenizer's pattern has it: Python's class also holds U+001C to U+001F.
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The last two white spaces of a run before a word: found in one pass, however long the run.
_RUN = re.compile(f"[{_SPACES}]{{2}}(?=[^{_SPACES}])")
_SPACE_RUN = re.compile(f"[{_SPACES}]{{2,}}")
#: Runs of more white spaces than this overflow the stack of the pattern that looks ahead: the tokenizer's file takes them.
LONG_RUN = 100_000
_BORDER = re.compile(r"(?<=\S) (?=\S)")
#: The part of the pattern that looks ahead: it only matters before the last of several white spaces.
_AHEAD = r"|\s+(?!\S)"


class Encoder:
    """Token ids of texts, equal to those of the ``tokenizers`` file at ``path``: the ranks are those of
    the same vocabulary, the strings of the file's added tokens become their ids."""

    def __init__(self, path: str, ranks_path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            self.added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        ranks = {token: n for token, n in ranks.items() if n not in set(self.added.values())}
        made = [tiktoken.Encoding(name, pat_str=p, mergeable_ranks=ranks, special_tokens={}) for name, p in (("whole", pattern), ("plain", pattern.replace(_AHEAD, "")))]
        self.whole, self.plain = (e.encode_ordinary for e in made)
        self.path, self.file = path, None

    def _piece(self, text: str) -> list[int]:
        if _RUN.search(text) is None:
            return self.plain(text)
        if len(text) > LONG_RUN and any(m.end() - m.start() > LONG_RUN for m in _SPACE_RUN.finditer(text)):
            from tokenizers import Tokenizer

            self.file = self.file or Tokenizer.from_file(self.path)
            return self.file.encode(text, add_special_tokens=False).ids
        return self.whole(text)

    def ids(self, text: str) -> np.ndarray:
        """uint32 ids of a text, without a closing id."""
        found = []
        for piece in self.split.split(text) if self.split and any(t in text for t in self.added) else (text,):
            if piece in self.added:
                found.append(np.array([self.added[piece]], np.uint32))
            else:
                found.extend(np.array(self._piece(c), np.uint32) for c in _chunks(piece))
        return found[0] if len(found) == 1 else np.concatenate(found) if found else np.zeros(0, np.uint32)


def _chunks(text: str) -> Iterator[str]:
    """A text cut before single spaces between words, where the pattern always cuts."""
    at = 0
    while len(text) - at > CHUNK:
        m = _BORDER.search(text, at + CHUNK)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    if at < len(text):
        yield text[at:] if at else text


@lru_cache(maxsize=2)
def encoder(path: str | None = None, ranks: str | None = None, pattern: str | None = None) -> Encoder:
    """The encoder of a Python worker, which keeps it from task to task."""
    import public_tokenizers

    return Encoder(path or public_tokenizers.path("byte_bpe_50k.json"), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp over k windows: the items of each, the largest load first."""
    if k == 1:
        return [list(range(len(sizes)))]
    # a partial holds at most k loads, in falling order; missing ones are zero
    partial = {i: (np.array([s], np.int64), [[i]]) for i, s in enumerate(sizes)}
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        (loads, items), (more, others) = partial.pop(heapq.heappop(heap)[1]), partial.pop(heapq.heappop(heap)[1])
        n, m = len(loads), len(more)
        both = np.concatenate([loads, more[: max(0, k - n)]])
        sets = items + others[: k - n]
        for j in range(max(0, k - n), m):  # the smaller of these meet the larger of those, and the reverse
            other = k - 1 - j
            both[other] += more[j]
            sets[other] = sets[other] + others[j]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        partial[made] = (both, [sets[j] for j in order.tolist()])
        heapq.heappush(heap, (-int(both[0] - (both[-1] if len(both) == k else 0)), made))
        made += 1
    return partial[heap[0][1]][1]


def balance(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``; the count starts at the least possible and rises
    until all fit."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = difference(sizes, k)
        if max(sum(sizes[i] for i in w) for w in windows) <= capacity:
            return windows
        k += max(1, k // 256)


def pack(docs: DataFrame, path: str | None = None, ranks: str | None = None, pattern: str | None = None, capacity: int = 2048, piece: int = 512, windows: int = 128) -> DataFrame:
    """Per piece: ``doc_id, start, length, ids`` (little-endian unsigned 32-bit), ``doc_tokens,
    sequence_id, offset``.  ``path`` is a ``tokenizers`` file, ``ranks`` the ``.tiktoken`` file of the same
    vocabulary and ``pattern`` its pattern, by default those of the 50k byte-level vocabulary."""
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ranks, pattern).ids
        sequence = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        held: list[tuple] = []
        held_tokens = 0

        def close() -> None:
            nonlocal sequence, held, held_tokens
            for window in balance([x[2] for x in held], capacity) if held else []:
                offset = 0
                for i in sorted(window):
                    rows.append((*held[i], sequence, offset))
                    offset += held[i][2]
                sequence += bool(window)
            held, held_tokens = [], 0

        def ready() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names)
            rows.clear()
            return out

        for b in (p for whole in batches for p in parts(whole)):
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4", copy=False)
                n = len(ids)
                whole = n - n % capacity
                for at in range(0, whole, capacity):
                    rows.append((key, at, capacity, ids[at : at + capacity].tobytes(), n, sequence, 0))
                    sequence += 1
                rest = n - whole
                cuts = -(-rest // piece)
                for j in range(cuts):
                    at, to = whole + rest * j // cuts, whole + rest * (j + 1) // cuts
                    held.append((key, at, to - at, ids[at:to].tobytes(), n))
                held_tokens += rest
                if held_tokens >= windows * capacity:
                    close()
                if len(rows) >= 1024:
                    yield ready()
        close()
        if rows:
            yield ready()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
