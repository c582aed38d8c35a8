import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidewater.llm import language, packing, pitman_yor, simhash

DOCS = "doc_id long, text string, lang string, source string, fp string, w string, score double"


def frame(spark, *rows):
    """Documents whose extra columns clash with names that the operators use inside."""
    return spark.createDataFrame([(i, t, lang, "s", "x", "y", 1.0) for i, t, lang in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


HARD = [(1, None, "en"), (2, "", None), (None, "the cat\tsat on ❤ the   mat\n\n\nof", "en"), (4, "x " * 60_000, "en"), (4, "x " * 60_000, "en"), (6, "12 + 3 ...", "de"), (7, "Über die Brücke und das Haus", "de")]

# ---------------------------------------------------------------- language


def test_language_held_out(docs):
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language.fit(docs.where(~held))
    found = language.identify(docs.where(held), model)
    right, n = found.agg(F.count_if(F.col("lang_pred") == F.col("lang")), F.count(F.lit(1))).first()
    assert right / n > 0.98


def test_und_exactly_where_no_letter_is(spark):
    """Digits and signs in the blocks of scripts are no letters; one letter of any script is enough."""
    train = frame(spark, *[(i, t, lang) for i in range(5) for t, lang in (("the house and the garden", "en"), ("дом и сад царя", "ru"), ("بيت وحديقة", "ar"))])
    model = language.fit(train)
    none = [None, "", "3 × 4", "12 ÷ 3", "٣٤٥", "१२३", "・", "฿ 5", "!!!", "1 2\u00a03", "😀"]
    some = ["ª", "x", "3 × a", "ж", "٣ ب", "漢", "1é"]
    found = {r["doc_id"]: r for r in language.identify(frame(spark, *[(i, t, None) for i, t in enumerate(none + some)]), model, ["doc_id"]).collect()}
    assert [found[i]["lang_pred"] for i in range(len(none))] == ["und"] * len(none)
    assert all(found[len(none) + i]["lang_pred"] in ("en", "ru", "ar") for i in range(len(some)))
    assert all(found[i]["score"] == 0.0 and found[i]["lang_spans"] == [] for i in range(len(none)))


def test_language_edges(spark):
    train = frame(spark, *[(i, t, lang) for i in range(5) for t, lang in (("the house and the garden of the king", "en"), ("das haus und der garten des königs", "de"), ("дом и сад царя", "ru"))])
    model = language.fit(train)
    out = {r["doc_id"]: r for r in language.identify(frame(spark, *HARD, (9, "дом царя", None), (10, "the house and the garden " * 9 + "дом и сад царя " * 4, None)), model).collect()}
    assert out[1]["lang_pred"] == out[2]["lang_pred"] == out[6]["lang_pred"] == "und" and out[1]["score"] == 0
    assert out[7]["lang_pred"] == "de" and out[9]["lang_pred"] == "ru" and out[9]["fp"] == "x"
    spans = [(s["words"], s["lang"]) for s in out[10]["lang_spans"]]
    assert spans == [(45, "en"), (16, "ru")] and 0.5 < out[10]["score"] < 1
    assert len(out) == 7 + 1 and language.identify(frame(spark, *HARD), model).count() == len(HARD)
    none = language.fit(train.where("false"))
    assert {r["lang_pred"] for r in language.identify(train, none).collect()} == {"und"}
    assert language.identify(train.where("false"), model).count() == 0


def test_viterbi_is_exact():
    rng = np.random.default_rng(0)
    for count in ([0, 5, 300], [1], [700, 0, 2]):
        score = rng.normal(size=(sum(count), 3)).astype(np.float32) * 4
        path = language.viterbi(score, np.array(count), 3.0)
        at = 0
        for n in count:
            s, p = score[at : at + n].astype(float), path[at : at + n]
            value = np.zeros(3)
            for row in s:
                value = np.maximum(value, value.max() - 3.0) + row
            got = sum(row[k] for row, k in zip(s, p)) - 3.0 * sum(p[1:] != p[:-1])
            assert n == 0 or math.isclose(got, value.max(), rel_tol=1e-4, abs_tol=1e-2)
            at += n


# ---------------------------------------------------------------- packing


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_pieces(rows, texts, capacity=2048):
    """Round trip: pieces give back every document's ids; windows are gapless and hold them."""
    ids = {k: [*e.ids, packing.END_ID] for k, e in zip(texts, tokenizer().encode_batch([t or "" for t in texts.values()], add_special_tokens=False))}
    pieces, windows = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append(r)
    for k, want in ids.items():
        got = sorted(pieces[k], key=lambda r: r["start"])
        flat = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in got]).tolist()
        assert flat == want and all(r["length"] * 4 == len(r["ids"]) and r["doc_tokens"] == len(want) for r in got)
        assert [r["start"] for r in got] == np.cumsum([0, *[r["length"] for r in got]])[:-1].tolist()
    for held in windows.values():
        held.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in held] == np.cumsum([0, *[r["length"] for r in held]])[:-1].tolist()
        assert sum(r["length"] for r in held) <= capacity
    return sum(map(len, ids.values())) / (capacity * len(windows))


def test_packing_documents(docs):
    texts = dict(docs.select("doc_id", "text").collect())
    assert check_pieces(packing.pack(docs.coalesce(1)).collect(), texts) > 0.97


def test_packing_edges(spark):
    odd = ["", None, "a", "  two  spaces ", "tabs\tand\r\nlines\n\n\n", "don't 's 're\n's x'll", "nbsp   x  ", "　全角 空白", "<|endoftext|> here", "é" * 3000, " \n \n", "1 22 333 ½ Ⅷ", "a\x1cb \x85c", "x'S 'T"]
    rows = list(enumerate(odd))
    df = frame(spark, *[(i, t, None) for i, t in rows])
    check_pieces(packing.pack(df).collect(), dict(rows))
    assert packing.pack(df.where("false")).count() == 0
    assert packing.pack(frame(spark, *HARD)).groupBy("doc_id").agg(F.sum("length")).count() == 6


def test_encoder_on_control_characters():
    """White space as the tokenizer has it: U+001C to U+001F are none."""
    rng = np.random.default_rng(5)
    letters = [*map(chr, range(0x21)), *"\x7f\x85\x9f\xa0\u1680\u180e\u2000\u2028\u202f\u205f\u3000\u200b\ufeff", "a", "Z", "é", "1", "'s", ".", "  "]
    texts = ["".join(rng.choice(letters, size=int(rng.integers(1, 14)))) for _ in range(10_000)]
    want = [e.ids for e in tokenizer().encode_batch(texts, add_special_tokens=False)]
    assert [packing.encoder().ids(t).tolist() for t in texts] == want


@pytest.mark.parametrize("c", [" ", "\t", "\n", "\u3000", "\x1f", "a", "."])
def test_encoder_on_long_runs(c):
    """A megabyte of one character takes time in proportion; ids are those of the tokenizer's file."""
    import time

    for text in (c * 1_000_000, c * 1_000_000 + "x", "x" + c * 99_000 + "y" + c * 99_000):
        packing.encoder().ids(c * 150_000 + "x")
        began = time.time()
        ids = packing.encoder().ids(text)
        assert time.time() - began < 6  # about one on an idle machine
        assert ids.tolist() == tokenizer().encode(text, add_special_tokens=False).ids


def test_encoder_on_random_text():
    rng = np.random.default_rng(3)
    letters = [*"ab' .\n\tsé1!…漢 ", "<|endoftext|>", "<|", "|>", "  "]
    texts = ["".join(rng.choice(letters, size=int(rng.integers(0, 40)))) for _ in range(3000)]
    want = [e.ids for e in tokenizer().encode_batch(texts, add_special_tokens=False)]
    assert [packing.encoder().ids(t).tolist() for t in texts] == want


def test_encoder_tells_words_of_equal_sums_apart():
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))  # Thue-Morse words: their polynomial hashes meet
    b = a.translate(str.maketrans("ab", "ba"))
    text = f"x {a} {b} {a}"
    assert packing.encoder().ids(text).tolist() == tokenizer().encode(text, add_special_tokens=False).ids


def test_encoder_takes_long_texts_in_chunks(monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 40)
    texts = ["the cat's 12 mats, " * 50, "a  b   c\n\nd " * 40, "x" * 500, " " * 300 + "y", "one two\nthree " * 30 + "<|endoftext|>" + " four" * 40]
    want = [e.ids for e in tokenizer().encode_batch(texts, add_special_tokens=False)]
    assert [packing.encoder().ids(t).tolist() for t in texts] == want


def test_differencing():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 512, size=300).tolist()
    windows = packing.balance(sizes, 2048)
    loads = [sum(sizes[i] for i in w) for w in windows]
    assert sorted(i for w in windows for i in w) == list(range(300)) and max(loads) <= 2048 and max(loads) - min(loads) < 120
    assert len(windows) <= -(-sum(sizes) // 2048) * 1.05 + 1
    assert [sorted(w) for w in packing.difference([8, 7, 6, 5, 4], 2)]  # the textbook case: 16 and 14
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.difference([8, 7, 6, 5, 4], 2)) == [14, 16]


# ---------------------------------------------------------------- language model


def words(text):
    import re

    return [*re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower()), b""]


def test_model_base_and_gain(docs):
    d = docs.select("doc_id", "text").withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
    model = pitman_yor.fit(d.where("not held"))
    out = {r["doc_id"]: r for r in pitman_yor.score(d, model, ["doc_id", "held"]).collect()}
    tokens = {r["doc_id"]: words(r["text"]) for r in docs.collect()}
    count = Counter(w for k, ws in tokens.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    assert (model.n, model.types) == (n, v) and len(out) == len(tokens)
    gain, known_gain = [], []
    for k, ws in tokens.items():
        assert math.isclose(out[k]["base_score"], sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert out[k]["n_tokens"] == len(ws) and out[k]["n_known"] == sum(w in count for w in ws)
        (gain if out[k]["held"] else known_gain).append((out[k]["score"] - out[k]["base_score"]) / len(ws))
    assert np.mean(gain) > 0.05 and np.mean(known_gain) > 0.5  # a text that was counted has its pairs
    # the predictive probabilities of every context, and of the unseen word, sum to one
    held_words = model.words.collect()
    total = model.back * (sum(r["q"] for r in held_words) / model.parent_whole + model.unseen * (model.types + 1))
    held = np.zeros(model.contexts.size)
    for r in held_words:
        held[list(r["ctx"])] += r["e"]
    assert np.allclose(total + held * model.seat, 1.0, atol=1e-9)
    # brute force: every text's score from the model's rows
    names = {w: i for i, w in enumerate(model.contexts.words.to_pylist())}
    rows = {r["w"].encode(): (r["q"], dict(zip(r["ctx"], r["e"]))) for r in held_words}
    for k, ws in tokens.items():
        score = 0.0
        for before, w in zip([None, *ws], ws):
            c = len(names) if before is None else names.get(before, len(names) + int(pitman_yor._CLASS[before[-1]]) if before else 0)
            q, e = rows.get(w, (0.0, {}))
            score += math.log10(e.get(c, 0.0) * model.seat[c] + model.back[c] * (q / model.parent_whole + model.unseen))
        assert math.isclose(score, out[k]["score"], rel_tol=1e-6)


@pytest.mark.parametrize("contexts", [0, 3, 200_000])
def test_model_counts(spark, contexts):
    texts = ["a b a b c", "b a  b\ta", "", None, "A B zz\xe9 a", "c " * 50, "a b a b c"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    counted = pitman_yor.count_words(df)
    named = pitman_yor.frequent_words(counted, contexts)
    want, at = Counter(), {w: i for i, w in enumerate(named.words.to_pylist())}
    for t in texts:
        ws = words(t)
        for before, w in zip([None, *ws], ws):
            c = len(at) if before is None else at.get(before, len(at) + int(pitman_yor._CLASS[before[-1]]) if before else 0)
            want[w, c] += 1
    assert len(at) <= contexts and {r["w"].encode(): r["n"] for r in counted.collect()} == Counter(w for t in texts for w in words(t))
    rows = pitman_yor.count_pairs(df, named).collect()
    assert len({r["w"] for r in rows}) == len(rows) and all(list(r["ctx"]) == sorted(set(r["ctx"])) for r in rows)
    assert {(r["w"].encode(), c): n for r in rows for c, n in zip(r["ctx"], r["n"])} == want


def conditional(c, fresh, d):
    """P(t) of c customers by seating them one by one and keeping all weights."""
    weight = np.zeros(c + 1)
    weight[1] = 1.0
    for i in range(1, c):
        t = np.arange(c + 1)
        weight = weight * np.maximum(i - d * t, 0.0) + np.concatenate(([0.0], weight[:-1] * fresh))
        weight /= weight.sum()
    return weight


@pytest.mark.parametrize("c", [2, 48, 49, 500, 3000])
@pytest.mark.parametrize(("fresh", "d"), [(0.5, 0.8), (5.0, 0.5), (5.0, 0.8), (150.0, 0.6)])
def test_tables_follow_the_conditional(c, fresh, d):
    """The draws keep the exact conditional at every size, and reach it from one table."""
    want, lanes = conditional(c, fresh, d), 1000
    at, t = np.arange(lanes), np.ones(lanes, np.int64)
    stirling, draws = pitman_yor.Stirling(d), pitman_yor.Draws(np.arange(lanes), 3)
    for sweep in range(30):
        t = pitman_yor.draw_tables(at, np.full(lanes, c), t, np.full(lanes, fresh), stirling, draws)
    mean, spread = (want * np.arange(c + 1)).sum(), math.sqrt((want * np.arange(c + 1) ** 2).sum() - (want * np.arange(c + 1)).sum() ** 2)
    assert abs(t.mean() - mean) < 5 * spread / math.sqrt(lanes) + 1e-9
    assert abs(t.std() - spread) < 0.1 * spread + 1e-9


def test_draws_do_not_follow_the_block():
    """what a word draws is the same whether or not a word of many customers is in its block."""
    size, stirling, found = 500, pitman_yor.Stirling(0.5, most=200), []
    for most in (40, 150):
        c = np.append(np.arange(size) % 40 + 1, most)
        draws, t = pitman_yor.Draws(np.arange(size + 1), 3), np.ones(size + 1, np.int64)
        for _ in range(3):
            t = pitman_yor.draw_tables(np.arange(size + 1), c, t, np.full(size + 1, 2.0), stirling, draws)
        found.append(t[:size])
    assert np.array_equal(*found) and found[0].max() > 1


def test_words_and_contexts_of_any_form():
    """Ranks by one search over all words; a slice of a longer array; no word has a context of its own."""
    words = pa.array([b"zzz", b"", "\u00e9".encode(), b"the", b"x9", b"b,"])
    rank, context = pitman_yor.Contexts(pa.array([b"the", b""])).of(words.slice(1))
    assert rank.tolist() == [1, -1, 0, -1, -1]
    kinds = pitman_yor._CLASS[[0xA9, ord("9"), ord(",")]]
    assert context.tolist() == [1, 2 + kinds[0], 0, 2 + kinds[1], 2 + kinds[2]]
    rank, context = pitman_yor.Contexts(pa.array([], pa.string())).of(words)
    assert (rank == -1).all() and context.tolist() == pitman_yor._CLASS[[ord("z"), 0, 0xA9, ord("e"), ord("9"), ord(",")]].tolist()


@pytest.mark.parametrize("d", [0.1, 0.5, 0.8, 0.95])
def test_stirling_numbers_beyond_the_table(d):
    """Series and saddle point agree with the recurrence, up to a factor by row."""
    s = pitman_yor.Stirling(d)
    t = np.unique(np.concatenate([np.arange(1, 30), np.linspace(30, 900, 60).astype(int)]))
    exact, far = s.table[1000, t], s.far(np.full(len(t), 1000.0), t.astype(float))
    step = np.diff(far) - np.diff(exact)
    assert np.abs(step).max() < 6e-2 and np.median(np.abs(step)) < 1e-3
    assert np.abs(far - exact - (far - exact)[0])[t <= s.reach * 1000**d].max() < 1e-4


@pytest.mark.parametrize("d", [0.1, 0.15, 0.2, 0.5, 0.9])
def test_stirling_numbers_of_many_customers(d):
    """The series against the recurrence over 100,000 customers."""
    s, most = pitman_yor.Stirling(d), 60
    exact, t = np.full(most + 1, -np.inf), np.arange(most + 1)
    exact[0] = 0.0
    for c in range(100_000):
        with np.errstate(divide="ignore"):
            stay = np.where((t > 0) & (t <= c), exact + np.log(np.maximum(c - d * t, 1e-300)), -np.inf)
        exact = np.concatenate(([-np.inf], np.logaddexp(stay[1:], exact[:-1])))
    t = t[1 : int(min(most, max(12, s.reach * 1e5**d))) + 1]
    gap = s.far(np.full(len(t), 1e5), t.astype(float)) - exact[t]
    assert np.abs(gap - gap[0]).max() < 1e-4


def test_model_edges(spark):
    df = frame(spark, *HARD)
    model = pitman_yor.fit(df)
    out = pitman_yor.score(df, model, ["doc_id", "w"]).collect()
    assert len(out) == len(HARD) and all(math.isfinite(r["score"]) and r["score"] <= 0 for r in out)
    assert {r["n_tokens"] for r in out if r["doc_id"] in (1, 2)} == {1}
    empty = pitman_yor.fit(df.where("false"))
    assert all(math.isfinite(r["score"]) for r in pitman_yor.score(df, empty, ["doc_id"]).collect())
    assert pitman_yor.score(df.where("false"), model, ["doc_id"]).count() == 0


# ---------------------------------------------------------------- near duplicates


def reference_print(text):
    import xxhash

    ws = words(text)[:-1]
    if not ws:
        return 0
    shingles = [b" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(prints, bits):
    names = sorted(prints)
    root = {k: k for k in names}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(names):
        for b in names[:i]:
            if bin(prints[a] ^ prints[b]).count("1") <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in names}


def test_near_duplicates(docs):
    found = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    prints = {r["doc_id"]: reference_print(r["text"]) for r in docs.collect()}
    assert {k: r["fp"] % 2**64 for k, r in found.items()} == prints
    assert {k: r["component_id"] for k, r in found.items()} == closure(prints, 4)


@pytest.mark.parametrize("block", [16, 4096])
def test_links_of_planted_prints(spark, block):
    """Clouds of up to four flipped bits around centres; small blocks send keys the long way."""
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 2**63, size=12, dtype=np.int64)
    prints = {int(c) for c in centres}
    for c in centres:
        for _ in range(60):
            flips = rng.choice(64, size=int(rng.integers(1, 5)), replace=False)
            prints.add(int(np.int64(c)) ^ sum(1 << int(b) for b in flips if b < 63))
    rows = spark.createDataFrame([(p,) for p in prints], "f0 long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.link_fingerprints(rows, 4, block=block)).collect()}
    want = closure({p: p % 2**64 for p in prints}, 4)
    groups = lambda m: sorted(sorted(k for k in prints if m.get(k, k) == r) for r in {m.get(k, k) for k in prints})
    assert groups(roots) == groups(want)


def test_golay_code_is_perfect():
    values = np.random.default_rng(2).integers(0, 1 << 23, size=4000)
    index, n = simhash.codeword_indices(values)
    assert set(n.tolist()) <= {1, 6}
    for flips in ((), (3,), (5, 17)):
        other = values.copy()
        for b in flips:
            other ^= 1 << b
        index2, n2 = simhash.codeword_indices(other)
        assert all(set(a[:x]) & set(b[:y]) for a, x, b, y in zip(index.tolist(), n.tolist(), index2.tolist(), n2.tolist()))


def test_near_duplicate_edges(spark):
    df = frame(spark, *HARD, (None, None, None))
    out = simhash.near_duplicates(df).collect()
    assert len(out) == len(HARD) + 1
    assert {r["component_id"] for r in out if r["fp"] == 0} == {1}
    assert simhash.near_duplicates(df.where("false")).count() == 0
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 6, 7]
    long = " ".join(f"w{i}" for i in range(400))
    near = frame(spark, (1, long, "en"), (2, long.replace("w200 ", "zz "), "en"), (3, " ".join(f"v{i}" for i in range(400)), "en"), (4, long, "en"))
    assert sorted(r["doc_id"] for r in simhash.keep_one(near).collect()) == [1, 3]
