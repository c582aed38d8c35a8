import hashlib
import itertools
import struct
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidewater.llm import chat, extract, media, mixing, topk, warc

# ---------------------------------------------------------------- media


def test_media_round_trip(spark):
    texts = [None, "", "a", "é" * 5000, "x" * 192, "abc " * 100_000, "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("media", F.lit("clash"))
    out = {r["doc_id"]: r for r in media.read_avi(media.write_avi(df), ["doc_id", "n_bytes"]).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert out[i]["payload"] == raw.ljust(max(1, -(-len(raw) // 192)) * 192) and out[i]["n_bytes"] == len(raw)
        assert sum(c["frames"] for c in out[i]["clips"]) == len(media.parse_avi(bytes(out[i]["media"]))[2])
    assert out[2]["media"] == out[6]["media"]
    broken = spark.createDataFrame([(1, b"RIFF....AVI junk"), (2, None), (3, b"")], "doc_id long, media binary")
    assert all(r["payload"] is None and r["clips"] == [] for r in media.read_avi(broken, ["doc_id"]).collect())
    assert media.read_avi(media.write_avi(df.where("false")), ["doc_id"]).count() == 0


def test_frames_by_the_general_decoder():
    """The DC-only frames agree with the full Huffman and cosine decoder; so does a frame with AC
    coefficients, a restart interval and chroma of half size."""
    data = media.avi_of(bytes(range(256)) * 9)
    frame = media.parse_avi(data)[2][0]
    assert np.array_equal(media.frame_samples(frame), media.decode_jpeg(frame)[::8, ::8, 0].ravel())

    bits = ""
    # luminance DC code 0 -> category 3, AC 0 -> (0, 2), AC 10 -> end; chroma: DC 0 -> category 0
    for mcu in range(2):
        for _ in range(4):
            bits += "0" + "101" + "0" + "11" + "10"  # DC difference 5, first AC 3
        bits += ("1" + "10") * 2  # chroma: DC category 0, end
        bits += "1" * (-len(bits) % 8)
        if mcu == 0:
            first, bits = bits, ""
    pack = lambda b: int(b, 2).to_bytes(len(b) // 8, "big").replace(b"\xff", b"\xff\0")
    dc = b"\0" + bytes([2] + [0] * 15) + bytes([3, 0])
    ac = b"\x10" + bytes([1, 1] + [0] * 14) + bytes([2, 0])
    sof = struct.pack(">BHHB", 8, 16, 32, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    seg = media._segment
    jpeg = b"\xff\xd8" + seg(0xDB, b"\0" + bytes([2] * 64)) + seg(0xC0, sof) + seg(0xC4, dc) + seg(0xC4, ac) + seg(0xDD, struct.pack(">H", 1))
    jpeg += seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + pack(first) + b"\xff\xd0" + pack(bits) + b"\xff\xd9"
    picture = media.decode_jpeg(jpeg)
    assert picture.shape == (16, 32, 3)
    basis = [np.cos((2 * x + 1) * np.pi / 16) * np.sqrt(0.125) * 0.5 for x in range(8)]
    want = [round(10 / 8 + 6 * b + 128) for b in basis]
    assert picture[0, :8, 0].tolist() == want and (picture[..., 1] == 128).all()
    assert picture[8, 24, 0] == round(40 / 8 + 6 * basis[0] + 128)  # the predictor starts anew


def test_shots():
    dark, light = np.full(500, 20, np.uint8), np.full(500, 200, np.uint8)
    assert media.shot_starts([dark] * 5 + [light] * 4 + [dark]) == [0, 5, 9]
    assert media.shot_starts([]) == [] and media.shot_starts([dark]) == [0]
    data = media.avi_of(b"a" * 3072 * 3 + b"\xf0" * 3072 * 2)
    clips = media.read_file(data)[1]
    assert [(c["start_ms"], c["end_ms"]) for c in clips] == [(0, 120), (120, 200)]
    no_index = data[: data.rindex(b"idx1")]
    assert media.read_file(no_index)[0] == media.read_file(data)[0]


# ---------------------------------------------------------------- pages


@pytest.fixture(scope="module")
def model(spark):
    return extract.fit(spark.read.parquet(f"{DATA}/pages.parquet"))


def brute_marginals(parent, unary, leaf, edges):
    n = len(parent)
    total = np.zeros(n)
    whole = 0.0
    for labels in itertools.product((0, 1), repeat=n):
        value = -30.0 * (1 - labels[0]) + sum(unary[i] * labels[i] for i in range(n))
        value += sum(edges[int(leaf[i]), labels[parent[i]], labels[i]] for i in range(1, n))
        w = np.exp(value)
        whole += w
        total += w * np.array(labels)
    return total / whole


def test_messages_are_exact():
    rng = np.random.default_rng(0)
    tree = extract.parse("<div><p>one</p><ul><li>two</li></ul>three</div><nav>four</nav>")
    vocabulary = {}
    forest = extract.Forest([tree], vocabulary, grow=True)
    weights, edges = rng.normal(size=len(vocabulary)), rng.normal(size=(2, 2, 2))
    got, joint = extract.marginals(forest, weights, edges)
    want = brute_marginals(tree.parent, forest.unary(weights), forest.leaf, edges)
    assert np.allclose(got, want, atol=1e-9) and np.allclose(joint[1:, 1].clip(0), joint[1:, 1])


def test_extract_pages(spark, model):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    out = {r["page_id"]: r["text"] for r in extract.extract(pages, model).collect()}
    for row in pages.collect():
        lines = out[row["page_id"]].split("\n")
        assert lines[0] and "©" not in out[row["page_id"]] and "track(" not in out[row["page_id"]]


def test_extract_edges(spark, model):
    s = "The council met on Tuesday to discuss the plan for the old harbour."
    pages = [
        (1, "u", None), (2, "u", ""), (3, "u", "plain"), (4, "u", "<p"), (None, "u", "<div><<>></div>"),
        (6, "u", f"<body><nav><a href='/'>Home</a></nav><article><h1>A &amp; B</h1><p>{s}&nbsp;x<br>\n y &lt;b&gt;<p>{s}</article><div class='ad'>Buy</div><footer>&copy; Z</footer>"),
        (7, "u", "<article>" + f"<p>{s}</p>" * 3000 + "</article>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = {r["page_id"]: r["text"] for r in extract.extract(df.unionByName(df.where("page_id = 6")), model).collect()}
    assert out[1] == out[2] == out[4] == "" and len(out) == 7
    assert out[6] == f"A & B\n{s} x y <b>\n{s}"
    assert out[7].count("\n") == 2999
    assert extract.extract(df.where("false"), model).count() == 0


@pytest.mark.parametrize(
    "page",
    ["<a " + '"' * 1_000_000, "<a " * 333_333, "<a " * 333_333 + ">", "<!-- " * 200_000, '<a ">" ' * 150_000, "<div>" * 200_000, "<div>" * 100_000 + "</p>" * 200_000, "<head>" * 160_000, "<script>" * 120_000, "<" * 1_000_000, "<a '\"" * 200_000],
    ids=["quotes", "opened", "one tag", "comments", "quoted ends", "depth", "ends", "heads", "scripts", "signs", "mixed quotes"],
)
def test_scan_takes_time_in_proportion(page, model):
    began = time.process_time()
    model.texts([extract.parse(page)])
    assert time.process_time() - began < 10  # a second or two; what was tried again and again took minutes


def test_scan_of_markup():
    found = [(m[2] + m[3], m[4].strip()) for m in extract.marks("a<p>b</P ><!-- <i> --><img alt='1 > 0' src=\"x\"><!doctype x>< 3 <5 <a title='open>c</a><?php ?><b")]
    assert found == [("p", ""), ("/p", ""), ("", ""), ("img", "alt='1 > 0' src=\"x\""), ("", ""), ("a", "title='open"), ("/a", ""), ("", ""), ("", "")]
    assert extract.parse("<div>" * 600 + "deep" + "</div>" * 600 + "after").leaf_text[-2:] == ["deep", "after"]


_FIRST = "Farmers in the northern valley began the harvest two weeks early this year, after the warmest spring on record."
_NEXT = "The cooperative expects the yield to fall by a tenth, its chair said, although prices are likely to rise before winter."
_MENU = "<ul><li><a href='/w'>World</a></li><li><a href='/b'>Business</a></li><li><a href='/a'>Arts</a></li></ul>"
#: Layouts without article and main elements that the model has not seen, with their main text.
UNSEEN = [
    (f"<body><div class='masthead'><div class='navigation'>{_MENU}</div></div><div class='post-content'><h1>Early harvest</h1><p>{_FIRST}</p><p>{_NEXT}</p></div><div class='comments-area'><p class='comment'>Nice read, thanks.</p></div><div class='site-footer'><p>&copy; 2021 Valley Post</p></div></body>", ["Early harvest", _FIRST, _NEXT]),
    (f"<body><div id='nav'>{_MENU}</div><div id='story-body'><p>{_FIRST}</p><blockquote>{_NEXT}</blockquote><p>{_FIRST} {_NEXT}</p></div><div class='sidebar-widget'><h4>Popular</h4>{_MENU}</div><div id='cookie-banner'><p>This site stores cookies on your device.</p></div></body>", [_FIRST, _NEXT, f"{_FIRST} {_NEXT}"]),
    (f"<body><table><tr><td class='nav'>{_MENU}</td><td class='content'><h2>Early harvest</h2><p>{_FIRST}</p><p>{_NEXT}</p></td></tr></table><div class='ads'>Half price tractors until Friday, see your dealer.</div><div class='footer-links'>{_MENU}</div></body>", ["Early harvest", _FIRST, _NEXT]),
    (f"<body><div role='banner'>{_MENU}</div><section class='entry'><p>{_FIRST}</p><div class='related'>{_MENU}</div><p>{_NEXT}</p></section><section class='reader-comments'><p>{_NEXT}</p><p>I disagree with the chair.</p></section><form class='search'><label>Search the site</label><input></form></body>", [_FIRST, _NEXT]),
]


def test_pages_without_article_elements(spark, model):
    df = spark.createDataFrame([(i, "u", page) for i, (page, _) in enumerate(UNSEEN)], "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in extract.extract(df, model).collect()}
    assert [out[i].split("\n") for i in range(len(UNSEEN))] == [want for _, want in UNSEEN]


class _Article(HTMLParser):
    """The text of the article element, block by block, read by another parser; advert blocks are left out."""

    def __init__(self):
        super().__init__()
        self.depth, self.lines, self.now = 0, [], ""

    def _end(self):
        if self.now.split():
            self.lines.append(" ".join(self.now.split()))
        self.now = ""

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag in extract.BLOCKS:
            self._end()
        elif tag == "br":
            self.now += " "

    def handle_endtag(self, tag):
        if tag in extract.BLOCKS:
            self._end()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.now += data


def test_article_text_by_another_parser(spark, model):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    out = {r["page_id"]: r["text"] for r in extract.extract(pages, model).collect()}
    for row in pages.collect():
        reader = _Article()
        reader.feed(row["html"] or "")
        reader.close()
        assert out[row["page_id"]] == "\n".join(reader.lines)


def test_seed_layouts(model):
    for page in extract.SEEDS:
        tree = extract.parse(page)
        want = "\n".join(x for x, w, c in zip(tree.leaf_text, tree.want, tree.cut) if x is not None and w and not c)
        assert model.texts([tree])[0] == want


# ---------------------------------------------------------------- WARC


def test_warc_round_trip(spark):
    long = "<p>é</p>" * 300
    rows = [(1, "http://a", long), (9, "http://b", long), (5, None, long), (None, "u", long), (2, "x\r\ny", "short"), (3, "x", "short"), (4, "x", None), (7, "q", ""), (9, "http://b", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("salt", F.lit("clash"))
    folder, files = warc.archive_pages(pages)
    out = warc.read_archives(files, folder, with_payload=True).collect()
    assert len(out) == len(rows)
    for r in out:
        raw = next(h or "" for i, _, h in rows if i == r["page_id"]).encode()
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == hashlib.sha1(raw).hexdigest()
        revisit = len(raw) >= 1000 and r["page_id"] != 9
        assert (r["record_type"], r["refers_to"]) == (("revisit", 9) if revisit else ("response", None))
        assert r["payload"] == (b"" if revisit else raw)
    assert warc.read_archives(warc.archive_pages(pages.where("false"))[1], folder).count() == 0


def test_single_stream_and_members():
    records = [warc.record(i, "u", "body\r\n\r\n" * i, "response", "d", None) for i in range(50)]
    stream = warc._gzip()
    mono = stream.compress(b"".join(records)) + stream.flush()
    source = iter([mono[i : i + 7] for i in range(0, len(mono), 7)] + [b""])
    assert list(warc.split_records(warc.inflate(lambda n: next(source)))) == records
    members = b"".join(zlib.compress(r, wbits=31) for r in records)
    source = iter([members, b""])
    assert list(warc.split_records(warc.inflate(lambda n: next(source)))) == records
    with pytest.raises(ValueError):
        list(warc.split_records(iter([records[0][:-9]])))


# ---------------------------------------------------------------- chat


def cheapest(roles):
    """Least cost by trying every sequence of choices, turn by turn."""
    best = {0: 0.0}
    for role in roles:
        after = {}
        for state, cost in best.items():
            options = []
            for k in range(3):
                for inserted in itertools.product(("user", "assistant"), repeat=k):
                    s, ok = state, True
                    for r in inserted:
                        ok &= r in chat._NEXT[s]
                        s = chat._STATE[r]
                    for r in chat._NEXT[s] if ok else ():
                        options.append((chat._STATE[r], 3.0 * k + (0 if r == role else 2.0 if role else 0.5)))
            if state:
                options.append((state, 1.0 + (0 if chat._ROLE[state] == role else 2.0 if role else 0.5)))
            for s, c in options:
                after[s] = min(after.get(s, 1e9), cost + c)
        best = after
    return min(c + {3: 0, 2: 3, 1: 6, 0: 6}[s] for s, c in best.items())


def legal(text):
    roles = [part.split("\n")[0] for part in text.split("<|im_start|>")[1:]]
    body = roles[1:] if roles[0] == "system" else roles
    return body and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(body)) and len(body) % 2 == 0


def test_repair(spark, monkeypatch):
    rng = np.random.default_rng(4)
    kinds = ["system", "user", "assistant", None]
    convs = {i: [kinds[k] for k in rng.integers(0, 4, size=int(rng.integers(1, 9)))] for i in range(40)}
    convs[100] = ["user", "assistant"] * 700 + ["assistant"]
    rows = [(c, t, f" {r.upper()} " if r else "tool" if t % 2 else None, f"text {t} <|im_end|>") for c, rs in convs.items() for t, r in enumerate(rs)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("chunk", F.lit("clash"))
    for size in (1024, 3):
        monkeypatch.setattr(chat, "CHUNK", size)
        repaired = chat.repair(df)
        out = {r["conv_id"]: r for r in chat.rendered(repaired).collect()}
        for c, roles in convs.items():
            assert out[c]["cost"] == cheapest(roles) and legal(out[c]["text"])
            assert all(f"text {t} <| im_end|>" in out[c]["text"] for t in range(len(roles)))


def test_repair_edges(spark):
    df = spark.createDataFrame([(None, None, None, None), (None, 1, "user", "a"), (1, 0, "user", "x"), (1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    out = chat.repair(df).collect()
    assert len(out) == 4 and chat.rendered(chat.repair(df)).count() == 2 and chat.repair(df.where("false")).count() == 0


# ---------------------------------------------------------------- mixing


def edf(quota, period):
    done, order = dict.fromkeys(quota, 0), []
    for t in range(period):
        ready = [(-(-(done[s] + 1) * period // q), s) for s, q in sorted(quota.items()) if done[s] < q and done[s] * period // q <= t]
        order.append(min(ready)[1])
        done[order[-1]] += 1
    return order


def test_mixture(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("mix_slot", F.lit("clash")).withColumn("period", F.lit("clash"))
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 7 != 0, F.col("source")))
    out = mixing.mix(docs, block=2, quantum=50).toPandas()
    assert len(out) == docs.count() and out["mix_position"].is_unique
    out["src"] = out["source"].map(lambda s: "-" if s is None else "+" + s)
    blocks = out.groupby(["src", "mix_block", "mix_half"])["mix_slot"].nunique()
    assert (blocks == 1).all()
    slots = out.drop_duplicates("mix_slot").sort_values("mix_slot")
    assert slots["mix_slot"].tolist() == list(range(len(slots)))
    assert ((slots["mix_slot"] >= slots["mix_release"]) & (slots["mix_slot"] < slots["mix_deadline"])).all()
    counts = {s: int(n) for s, n in out.groupby("src").size().items()}
    plan = mixing.plan_periods(counts, {s: float(n) ** 0.5 for s, n in out.groupby("src").size().items()}, 50)
    order = [s for p in sorted({r["phase"] for r in plan}) for rows in [[r for r in plan if r["phase"] == p]] for _ in range(rows[0]["repeats"]) for s in edf({r["src"]: r["quota"] for r in rows}, rows[0]["period"])]
    assert slots["src"].tolist() == order
    wide = mixing.mix(docs, block=2, quantum=50)
    import tidewater.llm.mixing as m

    limit, m.BROADCAST_BYTES = m.BROADCAST_BYTES, 0
    try:
        assert wide.exceptAll(mixing.mix(docs, block=2, quantum=50)).isEmpty()
    finally:
        m.BROADCAST_BYTES = limit


def test_mixture_deviation_and_weights():
    weights = {"a": 5.0, "b": 3.0, "c": 1.0, "d": 1.0}
    rows = mixing.plan_periods(dict.fromkeys(weights, 400), weights, 10)
    first = [r for r in rows if r["phase"] == 0]
    quota, period = {r["src"]: r["quota"] for r in first}, first[0]["period"]
    assert quota == {"a": 5, "b": 3, "c": 1, "d": 1} and first[0]["repeats"] == 80
    order = edf(quota, period) * 5
    for t in range(1, len(order) + 1):
        assert all(abs(order[:t].count(s) - t * q / period) < 1 for s, q in quota.items())
    assert sum(r["quota"] * r["repeats"] for r in rows) == 1600


def test_mixture_edges(spark):
    df = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "a")], "doc_id long, source string")
    out = mixing.mix(df, weights={"a": 1.0, None: 2.0})
    assert out.count() == 4 and out.select("mix_position").distinct().count() == 4
    assert mixing.mix(df.where("false")).count() == 0
    plan = mixing.mix(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---------------------------------------------------------------- top-k


def test_top_k(spark):
    rng = np.random.default_rng(6)
    vectors = [rng.normal(size=8).round(3).tolist() for _ in range(600)]
    vectors[10:200] = [vectors[10]] * 190  # ties that fill many annuli
    vectors[300] = [0.0] * 8
    rows = [(i, v) for i, v in enumerate(vectors)] + [(None, vectors[0]), (900, None), (950, [1.0, None, 2.0]), (1000, [float("nan")] * 8), (1050, [float("inf")] * 8), (50, vectors[50])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash"))
    out = topk.search(topk.integer_vectors(df), F.col("vec_id") % 50 == 0, k=5, pivots=8, block=16).toPandas()
    m = np.floor(256 * np.array(vectors, np.float32).astype(np.float64))
    for q in range(0, 600, 50):
        score = m @ m[q]
        want = [i for i in np.lexsort((np.arange(600), -score)) if i != q][:5]
        got = out[out["query_id"] == q].sort_values("rank")
        # the repeated row 50 is its own copy and never a candidate
        assert got["vec_id"].tolist() == want and got["score"].tolist() == score[want].astype(int).tolist()
    assert set(out["query_id"]) == set(range(0, 600, 50))
    few = topk.search(topk.integer_vectors(df.where("vec_id < 3")), F.col("vec_id") == 0, k=5).toPandas()
    assert few["rank"].tolist() == [1, 2]
    assert topk.search(topk.integer_vectors(df.where("false")), F.col("vec_id") == 0).count() == 0


def test_repeated_candidates_stay_rows(spark):
    """As in the query's join: every row of a repeated id takes a place, and lower scores follow."""
    vectors = {0: [1.0, 0.0], 1: [3.0, 0.0], 2: [2.0, 1.0], 3: [1.0, 2.0], 4: [0.5, 0.0], 5: [-1.0, 0.0], 6: [0.25, 0.0]}
    for times in (2, 5, 7):
        df = spark.createDataFrame([*vectors.items(), *[(1, vectors[1])] * (times - 1)], "vec_id long, embedding array<float>")
        got = topk.search(topk.integer_vectors(df), F.col("vec_id") == 0, k=5, pivots=2, block=3).orderBy("rank").collect()
        want = ([(1, 3 << 16)] * times + [(2, 2 << 16), (3, 1 << 16), (4, 1 << 15), (6, 1 << 14)])[:5]
        assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(i + 1, *x) for i, x in enumerate(want)]


# ---------------------------------------------------------------- mixing against its weights


@pytest.mark.parametrize("rows", [30_000, 300_000])
def test_mixture_stays_near_its_weights(rows):
    """20 sources, a third of the rows in one, and 100 small ones: less than one block of 32 documents from the fluid
    schedule of the true weights at every slot, less than half of one at the ends of periods."""
    for others in (19, 100):
        sizes = {"a": rows // 3} | {f"s{i:03}": rows * 2 // 3 // others + i for i in range(others)}
        blocks, weights = {s: -(-n // 16) for s, n in sizes.items()}, {s: n**0.5 for s, n in sizes.items()}
        plan, order, ends = mixing.plan_periods(blocks, weights), [], []
        for phase in range(plan[-1]["phase"] + 1):
            now = [r for r in plan if r["phase"] == phase]
            once = edf({r["src"]: r["quota"] for r in now}, now[0]["period"])
            for _ in range(now[0]["repeats"]):
                order += once
                ends.append(len(order) - 1)
        names = sorted(blocks)
        got = np.cumsum(np.array(order)[:, None] == np.array(names)[None, :], axis=0)
        # the target slot by slot, from the weights alone: what a used up source leaves goes to the others
        n, w = np.array([blocks[s] for s in names], float), np.array([weights[s] for s in names])
        have, target = np.zeros(len(names)), []
        for _ in order:
            room = 1.0
            while room > 1e-9:
                live = n - have > 1e-9
                if not live.any():
                    break
                rate = np.where(live, w, 0) / w[live].sum()
                step = min(room, ((n - have)[live] / rate[live]).min())
                have, room = have + rate * step, room - step
            target.append(have)
        off = np.abs(got - np.array(target)).max(axis=1) * 16 / 32  # in blocks
        assert got[-1].tolist() == n.tolist() and off.max() < 1 and off[ends].max() < 0.5, (others, off.max())


def test_mixture_of_odd_weights(spark):
    """Rows of the operator itself, odd blocks and odd weights: documents of every source against the true weights."""
    weights, block = {"a": 7e-5, "b": 0.33333, "c": 0.6666, None: 1e-3}, 7
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 2 == 0, "b").otherwise("c").alias("source"))
    out = mixing.mix(docs, weights=weights, block=block, quantum=200).orderBy("mix_position").collect()
    assert len(out) == 6000 and {r["mix_half"] for r in out} == {0, 1}
    slots, names = out[-1]["mix_slot"] + 1, list(weights)
    at = {s: np.zeros(slots) for s in names}
    for r in out:
        at[r["source"]][r["mix_slot"]] = 1
    n = np.array([at[s].sum() for s in names])
    got = np.cumsum(np.array([at[s] for s in names]), axis=1).T
    target = mixing.fluid(n, np.array([weights[s] for s in names]), np.arange(1, slots + 1))
    assert (np.abs(got - target) * (block // 2) < block).all() and np.allclose(got.sum(axis=1), np.arange(1, slots + 1))


def test_warc_sql_with_null_ids(spark, tmp_path):
    """The query and its SQL agree on null ids, equal payloads around the limit, and repeated rows."""
    import duckdb

    from tidewater.llm import queries

    rows = [(None, "u", "x" * 1000), (3, "u", "x" * 1000), (1, "u", "x" * 1000), (None, "u", "y" * 1500), (None, "v", "y" * 1500), (4, "u", "z" * 999), (None, "u", "z" * 999), (5, "u", None), (6, "u", "é" * 500), (7, "u", "é" * 500), (7, "u", "é" * 500)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    df = queries.op6_warc(spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.oracle_sql()['op6_warc']})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, want))
