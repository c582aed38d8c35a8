"""Language identification of whole, possibly mixed-language texts.

1. Script ranges narrow the candidates of every word: a language stays a candidate if, in the
   labelled rows, at least ``SCRIPT_SHARE`` of its words use the word's script.  A script that no
   language uses leaves all candidates and gives no evidence.  Letters outside the named ranges
   belong to one of ``OTHERS`` scripts by their block of code points.
2. Each word gets a score per language, naive Bayes over its byte 3- and 4-grams with word ends.
3. Viterbi over the words, with a switching penalty, labels spans of one language each.
The predicted language is the one whose spans hold most bytes of words; the score is its share.

The classifier is fitted on about ``sample_per_language`` rows per language (a documented bound,
drawn by a hash of doc_id); every labelled language is learned, and a model holds a column of
``2 * BUCKETS`` weights for each.

Nulls and texts without a letter: ``und``, score 0.  A null ``lang`` teaches nothing; a null
``doc_id`` is in the training part.  Ties go to the alphabetically smaller language.  Repeated rows
get equal results.  With no labelled row at all every text is ``und``.  Other columns are ignored.
Very long texts are labelled whole, one at a time, in chunks of words that are joined exactly.  An
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewater.llm.shared import Spans, parts, row_of, slices, utf8

UND = "und"
SCRIPT_SHARE = 0.005
BUCKETS = 1 << 16
CHUNK = 128
SWITCH = 8.0
SCALE = 0.5

# Code point ranges of scripts.
SCRIPTS = [
    ("latin", 0x00C0, 0x024F), ("greek", 0x0380, 0x03FF), ("cyrillic", 0x0400, 0x053F), ("armenian", 0x0540, 0x057F),
    ("hebrew", 0x0580, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x1080, 0x10FF), ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7BF), ("han", 0xF900, 0xFAFF),
]
OTHERS = 12
NAMES = [*dict.fromkeys(n for n, _, _ in SCRIPTS), *[f"other{k}" for k in range(OTHERS)]]


def _script_table() -> np.ndarray:
    """Script bit by the first two bytes of a character; all ranges are multiples of 64.  Blocks of 64
    (beyond the first plane 4,096) code points that hold letters and no named script are dealt to the others."""
    table = np.zeros(65536, np.uint32)
    for first, last, step in ((0x0240, 0xD800, 64), (0xF900, 0x10000, 64), (0x10000, 0x30000, 4096)):
        for point in range(first, last, step):
            head = chr(point).encode()[:2]
            here = slice(head[0] << 8, (head[0] << 8) + 256) if point < 0x0800 else head[0] << 8 | head[1]
            if sum(chr(p).isalpha() for p in range(point, point + step, step // 64)) >= 16:
                table[here] = 1 << NAMES.index(f"other{point // max(step, 128) % OTHERS}")
    for name, low, high in SCRIPTS:
        for point in range(low, high + 1, 64):
            head = chr(point).encode()[:2]
            if len(chr(point).encode()) == 2:
                table[head[0] << 8 : (head[0] << 8) + 256] = 1 << NAMES.index(name)
            else:
                table[head[0] << 8 | head[1]] = 1 << NAMES.index(name)
    for letter in [*range(65, 91), *range(97, 123)]:
        table[letter << 8 : (letter << 8) + 256] = 1 << NAMES.index("latin")
    return table


_SCRIPT = _script_table()


class _Features:
    """Words of some texts with script bits, and hashed n-grams by byte position."""

    def __init__(self, texts: list[bytes]):
        self.spans = s = Spans([t.lower() for t in texts])
        data = s.data.copy()
        after = np.concatenate(([0], data[:-1]))
        data[(after == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32  # capitals of Latin-1
        edges = np.zeros(len(data) + 1, np.int8)
        edges[s.start] += 1
        edges[s.end] -= 1
        outside = np.cumsum(edges[:-1]) == 0
        data = np.where(outside, 32, data).astype(np.uint32)
        before = [np.concatenate((np.full(k, 32, np.uint32), data))[: len(data)] for k in (1, 2, 3)]
        three = before[1] << 16 | before[0] << 8 | data
        inner = (before[0] != 32) & (three != 0)
        mix = np.uint32(0x9E3779B1)
        four = (three | before[2] << 24) * mix >> np.uint32(16)
        self.three = np.where(inner, three * mix >> np.uint32(16), 0)
        self.four = np.where(inner & (before[1] != 32), four, 0) + BUCKETS
        if len(s.start):
            lead = _SCRIPT[data << 8 | np.concatenate((data[1:], [32]))]
            self.script = np.bitwise_or.reduceat(lead, s.start)
        else:
            self.script = np.zeros(0, np.uint32)


def _grams(f: _Features, first: int, last: int) -> np.ndarray:
    both = np.concatenate([f.three[first:last], f.four[first:last]])
    return np.bincount(both, minlength=2 * BUCKETS)


class LanguageModel:
    def __init__(self, languages: list[str], weight: np.ndarray, allowed: np.ndarray):
        self.languages, self.weight, self.allowed = languages, weight, allowed


def fit(rows: DataFrame, sample_per_language: int = 3000) -> LanguageModel:
    """From ``doc_id, text, lang``; rows with a null lang are skipped."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").count().orderBy("lang").collect()  # a row per language
    if not sizes:
        return LanguageModel([], np.zeros((2 * BUCKETS, 0), np.float32), np.zeros((0, 0), bool))
    draw = (F.xxhash64(F.lit("language"), "doc_id").cast("double") / float(1 << 64)) + 0.5
    share = reduce(lambda w, r: w.when(F.col("lang") == r["lang"], float(sample_per_language) / r["count"]), sizes[1:], F.when(F.col("lang") == sizes[0]["lang"], float(sample_per_language) / sizes[0]["count"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in (p for whole in batches for p in parts(whole)):
            texts, lang = utf8(b.column(1)), b.column(0).to_pylist()
            for lo, hi in slices(texts):
                f = _Features(texts[lo:hi])
                words = np.concatenate(([0], np.cumsum(f.spans.count)))
                for i in range(hi - lo):
                    name = lang[lo + i]
                    held = total.setdefault(name, np.zeros(2 * BUCKETS + 32, np.int64))
                    held[: 2 * BUCKETS] += _grams(f, f.spans.offset[i], f.spans.offset[i + 1])
                    mine = f.script[words[i] : words[i + 1]]
                    for k in range(len(NAMES)):
                        held[2 * BUCKETS + k] += int((mine >> np.uint32(k) & np.uint32(1)).sum())
                    held[2 * BUCKETS + 31] += len(mine)
        for name, held in total.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(held[at])], ["lang", "k", "n"])

    sample = rows.where(draw < share).select("lang", F.col("text").cast("string"))
    named = [r["lang"] for r in sizes]
    counts = sample.mapInArrow(run, "lang string, k int, n long").groupBy("lang", "k").agg(F.sum("n").alias("n"))
    counts = counts.select((F.array_position(F.lit(named), F.col("lang")) - 1).cast("int").alias("i"), "k", "n").toArrow()
    table = np.zeros((len(named), 2 * BUCKETS + 32))
    table[counts["i"].to_numpy(), counts["k"].to_numpy()] = counts["n"].to_numpy()
    seen = table.any(axis=1)
    languages, table = [x for x, y in zip(named, seen.tolist(), strict=True) if y], table[seen]
    grams = table[:, : 2 * BUCKETS] + 0.5
    grams[:, 0] = grams[:, BUCKETS] = 1.0  # the place of positions without an n-gram
    half = [grams[:, :BUCKETS], grams[:, BUCKETS:]]
    logs = np.concatenate([np.log(h / h.sum(axis=1, keepdims=True)) for h in half], axis=1)
    logs -= logs.mean(axis=0, keepdims=True)
    logs[:, 0] = logs[:, BUCKETS] = 0.0
    allowed = table[:, 2 * BUCKETS : 2 * BUCKETS + len(NAMES)] >= SCRIPT_SHARE * np.maximum(table[:, -1:], 1)
    return LanguageModel(languages, np.ascontiguousarray((SCALE * logs).astype(np.float32)), allowed.T.copy())


def word_scores(f: _Features, model: LanguageModel) -> np.ndarray:
    """Score of every word by language; far below the rest where its scripts exclude a language."""
    s, n = f.spans, len(model.languages)
    out = np.zeros((len(s.start), n), np.float32)
    if not len(s.start):
        return out
    edge = np.stack([s.start, s.end + 1], 1).ravel()  # the byte after a word carries its last n-grams
    # a word may begin where the last one's tail ends: reduceat then sums up to the next edge, as meant
    edge = np.minimum(edge, len(s.data) - 1) if edge[-1] >= len(s.data) else edge
    for k in range(n):
        value = model.weight[k][f.three] + model.weight[k][f.four]
        out[:, k] = np.add.reduceat(value, edge)[0::2] if edge[-1] < len(value) else 0
    bits = f.script[:, None] >> np.arange(len(NAMES), dtype=np.uint32)[None, :] & np.uint32(1)
    used = model.allowed.any(axis=1)
    known = (bits & used[None, :]) > 0
    fits = np.ones_like(out, dtype=bool)
    kinds, kind = np.unique(f.script, return_inverse=True)
    for i, mask in enumerate(kinds.tolist()):
        mine = [k for k in range(len(NAMES)) if mask >> k & 1 and used[k]]
        if mine:
            fits[kind == i] = model.allowed[mine].any(axis=0)
    out[~known.any(axis=1)] = 0.0
    out[~fits] -= 50.0
    return out


def viterbi(score: np.ndarray, count: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word, texts of ``count`` words one after the other.

    Texts are cut into chunks whose best scores for every pair of entry and exit language form
    max-plus matrices; chunks are then joined in order, so a long text costs no more per word.
    """
    words, n = score.shape
    if not words or n == 1:
        return np.zeros(words, np.int64)
    chunks = -(-count // CHUNK)
    chunk_doc = np.repeat(np.arange(len(count)), chunks)
    nth = np.arange(len(chunk_doc)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    within = np.arange(words) - np.repeat(np.cumsum(count) - count, count)
    chunk = np.repeat(np.cumsum(chunks) - chunks, count) + within // CHUNK
    padded = np.zeros((CHUNK, len(chunk_doc), n), np.float32)
    padded[within % CHUNK, chunk] = score

    best = np.where(np.eye(n, dtype=bool), 0.0, -1e30)[None].repeat(len(chunk_doc), 0).astype(np.float32)
    for t in range(CHUNK):
        best = np.maximum(best, best.max(axis=2, keepdims=True) - switch) + padded[t][:, None, :]

    entry = np.zeros((len(chunk_doc), n), np.int64)
    value = np.zeros((len(count), n), np.float32)
    order = np.argsort(nth, kind="stable")
    bounds = np.searchsorted(nth[order], np.arange(nth.max() + 2))
    for k in range(nth.max() + 1):
        at = order[bounds[k] : bounds[k + 1]]
        through = value[chunk_doc[at]][:, :, None] + best[at]
        entry[at] = through.argmax(axis=1)
        value[chunk_doc[at]] = through.max(axis=1)
    leave, enter = np.zeros(len(chunk_doc), np.int64), np.zeros(len(chunk_doc), np.int64)
    state = value.argmax(axis=1)
    for k in range(nth.max(), -1, -1):
        at = order[bounds[k] : bounds[k + 1]]
        leave[at] = state[chunk_doc[at]]
        enter[at] = entry[at, leave[at]]
        state[chunk_doc[at]] = enter[at]

    lane = np.arange(len(chunk_doc))
    value = np.full((len(chunk_doc), n), -1e30, np.float32)
    value[lane, enter] = 0.0
    kept = np.empty((CHUNK, len(chunk_doc), n), np.float32)
    for t in range(CHUNK):
        kept[t] = value
        value = np.maximum(value, value.max(axis=1, keepdims=True) - switch) + padded[t]
    path = np.empty((CHUNK, len(chunk_doc)), np.int64)
    state = leave
    for t in range(CHUNK - 1, -1, -1):
        path[t] = state
        top = kept[t].argmax(axis=1)
        state = np.where(kept[t][lane, state] >= kept[t][lane, top] - switch, state, top)
    return path[within % CHUNK, chunk]


_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def _has_letter(text: bytes) -> bool:
    return _ASCII_LETTER.search(text) is not None or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def label_texts(texts: list[bytes], model: LanguageModel) -> tuple[list[str], np.ndarray, list[list[dict]]]:
    """Predicted language, score, and spans (first word, number of words, language) of each text."""
    names, scores, spans = [], np.zeros(len(texts)), []
    for lo, hi in slices(texts, 1 << 20):
        f = _Features(texts[lo:hi])
        s = f.spans
        if not model.languages:
            names += [UND] * (hi - lo)
            spans += [[] for _ in range(hi - lo)]
            continue
        path = viterbi(word_scores(f, model), s.count)
        n = len(model.languages)
        size = (s.end - s.start) * (f.script > 0)
        held = np.bincount(s.row * n + path, size, (hi - lo) * n).reshape(-1, n)
        total, top = held.sum(axis=1), held.argmax(axis=1)
        change = np.flatnonzero(np.concatenate(([True], (path[1:] != path[:-1]) | (s.row[1:] != s.row[:-1])))) if len(path) else np.zeros(0, np.int64)
        run_row, run_lang = s.row[change], path[change]
        run_size = np.diff(np.append(change, len(path)))
        doc_first = np.cumsum(s.count) - s.count
        run_at = np.searchsorted(run_row, np.arange(hi - lo + 1))
        first, sizes, langs = (change - doc_first[run_row]).tolist(), run_size.tolist(), run_lang.tolist()
        for i in range(hi - lo):
            mine = range(run_at[i], run_at[i + 1])
            if not _has_letter(texts[lo + i]):  # blocks of a script hold digits and signs too
                names.append(UND)
                spans.append([])
                continue
            names.append(model.languages[top[i]])
            scores[lo + i] = held[i, top[i]] / total[i] if total[i] else 0.0
            spans.append([{"first": first[j], "words": sizes[j], "lang": model.languages[langs[j]]} for j in mine])
    return names, scores, spans


def identify(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``lang_pred``, ``score`` and ``lang_spans``; no shuffle.
    Columns of these names in ``docs`` are replaced."""
    made = ("lang_pred", "score", "lang_spans")
    names = [c for c in (keep if keep is not None else docs.columns) if c not in made]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(row_of(names), F.col("text").cast("string").alias("text"))
    schema = StructType([kept.schema["row"], *StructType.fromDDL("lang_pred string, score double, lang_spans array<struct<first:int,words:int,lang:string>>")])
    kind = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in parts(whole)):
            lang, score, spans = label_texts(utf8(b.column(1)), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(spans, kind)], ["row", *made])

    return kept.mapInArrow(run, schema).select("row.*", *made)
