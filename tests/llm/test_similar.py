import numpy as np
import pytest

from tidewater.llm import simhash

DOCS = "doc_id long, text string"


def words(rng, n):
    return [f"w{k}" for k in rng.integers(0, 1_000_000, size=n)]


def exact(texts, least=0.8):
    """Brute force: similar pairs, and the smallest id of every component."""
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in ((k, t.lower().split()) for k, t in texts.items())}
    root, like = {k: k for k in sets}, {}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if j >= least:
                like[a, b] = j
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return like, {find(k) for k in names}


def kept(spark, texts):
    return {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(list(texts.items()), DOCS)).collect()}


def test_a_repeated_line_does_not_link(spark):
    """Own words and one line twenty times over: Jaccard of about 0.03."""
    rng = np.random.default_rng(1)
    line = words(rng, 12)
    texts = {i: " ".join(words(rng, 200) + line * 20) for i in range(20)}
    assert kept(spark, texts) == set(texts)


def changed(rng, text, share):
    """A copy with single words changed, that many of a thousand."""
    out = list(text)
    for k in rng.choice(len(out), size=max(1, round(len(out) * share / 1000)), replace=False):
        out[k] = f"z{rng.integers(0, 1_000_000)}"
    return out


def test_all_pairs_just_above_the_threshold_are_found(spark):
    """Isolated pairs of 50 to 1000 words: exactly those of 0.8 or more by brute force lose a text."""
    rng, texts, like = np.random.default_rng(2), {}, {}
    for k in range(240):
        first = words(rng, int(rng.choice([50, 60, 200, 1000])))
        pair = {2 * k: " ".join(first), 2 * k + 1: " ".join(changed(rng, first, int(rng.choice([20, 60]))))}
        texts |= pair
        like |= exact(pair, 0.0)[0]
    ids = kept(spark, texts)
    bands = [0.5, 0.8, 0.85, 0.9, 1.01]
    for lo, hi in zip(bands, bands[1:]):
        inside = [p for p, j in like.items() if lo <= j < hi]
        lost = sum(not (a in ids and b in ids) for a, b in inside)
        assert len(inside) > 5 and lost == (len(inside) if lo >= 0.8 else 0), (lo, len(inside), lost)


@pytest.mark.parametrize("block", [8, 1024])
def test_components_of_one_large_group(spark, monkeypatch, block):
    """Copies of one text that agree with some others only: brute force, also with bands in blocks."""
    from tidewater.llm import similar

    monkeypatch.setattr(similar, "BLOCK", block)
    rng = np.random.default_rng(3)
    first = words(rng, 120)
    texts = {k: " ".join(changed(rng, first, int(rng.choice([8, 16, 25, 40])))) for k in range(150)}
    like, want = exact(texts)
    assert len(like) > 100 and 1 < len(want) < 140 and kept(spark, texts) == want


def test_pairs_by_band_of_similarity(spark):
    """Isolated pairs below and above the threshold: exactly those of 0.8 or more by brute force lose a text."""
    rng, texts, like = np.random.default_rng(4), {}, {}
    for k in range(240):
        first = words(rng, int(rng.choice([50, 60, 200, 600])))
        pair = {2 * k: " ".join(first), 2 * k + 1: " ".join(changed(rng, first, int(rng.choice([5, 12, 15, 20, 24, 40]))))}
        texts |= pair
        like |= exact(pair, 0.0)[0]
    ids = kept(spark, texts)
    bands = [0.5, 0.8, 0.85, 0.9, 1.01]
    seen = {}
    for lo, hi in zip(bands, bands[1:]):
        inside = [p for p, j in like.items() if lo <= j < hi]
        seen[lo] = (len(inside), sum(not (a in ids and b in ids) for a, b in inside))
    print(seen)
    assert all(n > 5 and lost == (n if lo >= 0.8 else 0) for lo, (n, lost) in seen.items()), seen
