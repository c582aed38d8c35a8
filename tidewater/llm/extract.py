"""Main text of web pages by a tree-structured graphical model over the DOM.

A page is parsed into a tree of block elements; text between blocks is a leaf.  Every node has a
label: does its subtree hold main content?  Node potentials are log-linear in the node's features
(tag, name tokens of class, id and role, text length, share of link text, place); edge potentials
tie a child to its parent, and content below a content-free parent is all but excluded.
Sum-product messages, upward from the deepest level and downward again, give every node's marginal;
leaves whose marginal exceeds one half are kept, in page order, one line each.

The weights maximise the labelled pages' likelihood (observed less expected features, the latter
from the same messages).  Labelled pages: ``SEEDS``, layouts written or made by rule for this purpose, and a bounded
sample of the table's pages that have exactly one ``article`` or ``main`` element, which labels its
leaves (``sample`` pages at most, drawn by a hash of the id).

Character references are decoded, white space inside a block (``br`` included) becomes one space,
blocks are joined by one newline; nothing is cut.  Scripts, styles, comments and the head are
markup, not text.  Null or empty html, or no content: an empty text.  Repeated rows and ties keep
one result each; equal html gives equal text.  Broken markup is read as far as it goes: a page is
scanned once, whatever is left open in it, so very long pages take time and memory in proportion.
Extra columns, whatever their names, are ignored.  An empty table trains on the seeds and gives no
rows.  Nothing is shuffled but the hashes that draw the sample.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by their role in HTML.
BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html iframe legend li main menu nav noscript ol option p pre section select summary "
    "table tbody td template textarea tfoot th thead tr ul".split()
)
SKIPPED = frozenset("head script style template svg math object canvas title".split())
RAW = frozenset(("script", "style", "textarea", "title"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"body", "html", "button", "option", "legend", "summary", "tbody", "td", "tfoot", "th", "thead", "tr", "noscript", "iframe"}
SAME_LEVEL = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LEVEL_ENDS = frozenset(("ul", "ol", "dl", "table", "menu", "select", "article", "section", "div", "body", "main", "nav", "aside"))

DEEPEST = 512  # elements nested deeper become siblings at this depth, as in browsers
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
# possessive: a quote that is not closed is an ordinary character, and nothing is tried twice
_REST = re.compile(r"(?>[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+>")
_ATTRIBUTE = re.compile(r"\b(class|id|role|data-main|data-cut)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_TOKEN = re.compile(r"[a-z]+")


def marks(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Start, end, slash, name and attributes of every piece of markup (the name is empty but for
    elements), in one pass: what is not closed is looked for once.  The caller may send a place to go on at."""
    at = 0
    last = page.rfind(">")
    quotes = True  # tags end outside quotes, until one is found not to
    while (i := page.find("<", at)) >= 0:
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            found = (i, end + 3 if end >= 0 else len(page), "", "", "")
        elif page[i + 1 : i + 2] in ("!", "?", "/") and not _NAME.match(page, i):
            found = (i, page.find(">", i) + 1 if i < last else len(page), "", "", "")
        elif (m := _NAME.match(page, i)) is None or (i > last and page.find("<", i + 1) >= 0):
            at = i + 1
            continue
        elif i > last:  # a tag that the page breaks off
            found = (i, len(page), "", "", "")
        else:
            end = _REST.match(page, m.end()) if quotes else None
            quotes = end is not None
            to = end.end() if end else page.find(">", m.end()) + 1
            found = (i, to, m[1], m[2].lower(), page[m.end() : to - 1])
        at = (yield found) or found[1]


class Tree:
    """Nodes in page order; parents come first.  Node 0 is the page."""

    __slots__ = ("cut", "depth", "features", "leaf_text", "link", "parent", "size", "tag", "want")

    def __init__(self) -> None:
        self.parent, self.tag, self.depth = [-1], ["#page"], [0]
        self.features: list[list[str]] = [[]]
        self.leaf_text: list[str | None] = [None]
        self.size, self.link = [0], [0]
        self.want, self.cut = [False], [False]


@lru_cache(maxsize=20_000)
def _names(attributes: str) -> tuple[tuple[str, ...], bool, bool]:
    tokens, main, cut = set(), False, False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "data-main":
            main = True
        elif name == "data-cut":
            cut = True
        else:
            spaced = re.sub(r"([a-z])([A-Z])", r"\1 \2", a or b or c)
            tokens.update(t if len(t) < 5 else t.rstrip("s") for t in _TOKEN.findall(spaced.lower()))
    return tuple(sorted("name=" + t for t in tokens)), main, cut


def parse(page: str) -> Tree:
    """The block tree of a page, with features."""
    t = Tree()
    stack = [(0, "#page")]  # open block elements
    is_open: dict[str, int] = defaultdict(int)
    unclosed: set[str] = set()
    text: list[str] = []
    linked = 0
    in_link = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                parent = stack[-1][0]
                t.parent.append(parent)
                t.tag.append("#text")
                t.depth.append(t.depth[parent] + 1)
                t.features.append([])
                t.leaf_text.append(joined)
                t.size.append(len(joined))
                t.link.append(min(linked, len(joined)))
                t.want.append(t.want[parent])
                t.cut.append(t.cut[parent])
            text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            plain = entities.unescape(piece) if "&" in piece else piece
            text.append(plain)
            if in_link:
                linked += len(plain.strip())

    def close(names: tuple[str, ...], ends: frozenset[str] = frozenset()) -> None:
        if not any(is_open[x] for x in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][1] in names:
                flush()
                for _, x in stack[k:]:
                    is_open[x] -= 1
                del stack[k:]
                return
            if stack[k][1] in ends:
                return

    found, to = marks(page), None
    while True:
        try:
            start, end, slash, name, attributes = found.send(to)
        except StopIteration:
            add(page[at:])
            break
        to = None
        add(page[at:start])
        at = end
        if not name:
            continue
        if slash:
            if name in BLOCKS:
                close((name,))
                if name != "p":
                    in_link = 0
            elif name == "a":
                in_link = 0
            continue
        if name in SKIPPED or name in RAW:
            if attributes.endswith("/") and name in ("svg", "math") or name in unclosed:
                continue
            m = re.compile(rf"</{name}\s*+>" if name != "head" else r"</head\s*+>|(?=<body\b)", re.I).search(page, at)
            if name == "head" and m is None:
                unclosed.add(name)
                continue
            at = to = m.end() if m else len(page)
            continue
        if name == "br":
            add(" ")
            continue
        if name == "a":
            in_link = 1
            continue
        if name not in BLOCKS:
            continue
        flush()
        if name in CLOSES_P:
            close(("p",), LEVEL_ENDS | {"td", "th", "li", "button"})
        if name in SAME_LEVEL:
            close(SAME_LEVEL[name], LEVEL_ENDS - {"div"} if name not in ("td", "th", "tr") else frozenset(("table",)))
        if name in VOID:
            continue
        parent = stack[-1][0]
        tokens, main, cut = _names(attributes) if attributes.strip() else ((), False, False)
        t.parent.append(parent)
        t.tag.append(name)
        t.depth.append(t.depth[parent] + 1)
        t.features.append(list(tokens))
        t.leaf_text.append(None)
        t.size.append(0)
        t.link.append(0)
        t.want.append(t.want[parent] or main)
        t.cut.append(t.cut[parent] or cut)
        if len(stack) <= DEEPEST:
            stack.append((len(t.parent) - 1, name))
            is_open[name] += 1
    flush()
    _describe(t)
    return t


_WHOLE = ("#page", "html", "body")
_STORY = ("article", "main")
_ENDS = (".", "!", "?", "…", "。", ":", '"', "”")


def _bin(n: int) -> int:
    return min(n.bit_length(), 12)


def _describe(t: Tree) -> None:
    """Adds size, link and place features; sizes are summed up the tree."""
    n = len(t.parent)
    story = [False] * n
    for i in range(1, n):
        story[i] = story[t.parent[i]] or t.tag[i] in _STORY
    for i in range(n - 1, 0, -1):
        t.size[t.parent[i]] += t.size[i]
        t.link[t.parent[i]] += t.link[i]
    some = any(x in _STORY for x in t.tag)
    for i in range(1, n):
        f, up = t.features[i], t.tag[t.parent[i]]
        links = 4 * t.link[i] // max(t.size[i], 1)
        place = "in" if story[i] else "out" if some else "none"
        if t.leaf_text[i] is None:
            f += [f"tag={t.tag[i]}", f"links={links}", f"size={_bin(t.size[i]) // 2}", f"story={place}"]
        else:
            end = t.leaf_text[i].endswith(_ENDS)
            f += ["leaf", f"leaf-in={up}", f"leaf-links={links}", f"leaf-size={_bin(t.size[i])}", f"leaf-end={end}", f"leaf-story={place}"]
            if "©" in t.leaf_text[i]:
                f.append("leaf-rights")


# ---------------------------------------------------------------- the model


class Forest:
    """Trees side by side: arrays over all nodes, and the nodes of every depth."""

    def __init__(self, trees: list[Tree], vocabulary: dict[str, int], grow: bool = False):
        sizes = [len(t.parent) for t in trees]
        self.start = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.parent = np.fromiter((p + s if p >= 0 else -1 for t, s in zip(trees, self.start, strict=False) for p in t.parent), np.int64, self.start[-1])
        self.leaf = np.fromiter((x is not None for t in trees for x in t.leaf_text), bool, self.start[-1])
        self.whole = np.fromiter((x in _WHOLE for t in trees for x in t.tag), bool, self.start[-1])
        depth = np.fromiter((d for t in trees for d in t.depth), np.int64, self.start[-1])
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max() + 1))) if len(depth) else []
        at, feature, node = [], [], 0
        for t in trees:
            for names in t.features:
                for name in names:
                    k = vocabulary.setdefault(name, len(vocabulary)) if grow else vocabulary.get(name)
                    if k is not None:
                        at.append(node)
                        feature.append(k)
                node += 1
        self.at, self.feature = np.array(at, np.int64), np.array(feature, np.int64)

    def unary(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights[self.feature], len(self.parent)) if len(self.at) else np.zeros(len(self.parent))


def marginals(f: Forest, weights: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(label 1) of every node, and P(parent 1, child 0 or 1) of every edge, by two sweeps of
    messages.  ``edges[kind, parent, child]`` are log potentials; kind 1 is a leaf."""
    n = len(f.parent)
    belief = np.zeros((n, 2))
    belief[:, 1] = f.unary(weights)
    belief[f.whole, 0] = -30.0  # a page may hold content
    up = np.zeros((n, 2))
    pair = edges[f.leaf.astype(np.int64)]
    for level in f.levels[:0:-1]:
        message = np.logaddexp(pair[level, :, 0] + belief[level, None, 0], pair[level, :, 1] + belief[level, None, 1])
        up[level] = message
        np.add.at(belief, f.parent[level], message)
    joint = np.zeros((n, 2))
    for level in f.levels[1:]:
        above = belief[f.parent[level]] - up[level]  # the parent without this child
        both = above[:, :, None] + pair[level] + belief[level][:, None, :]
        both -= both.max(axis=(1, 2), keepdims=True)
        p = np.exp(both)
        p /= p.sum(axis=(1, 2), keepdims=True)
        joint[level] = p[:, 1, :]
        belief[level] += np.logaddexp(above[:, 0, None] + pair[level, 0, :], above[:, 1, None] + pair[level, 1, :])
    return 1.0 / (1.0 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -60, 60))), joint


class ContentModel:
    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray, edges: np.ndarray):
        self.vocabulary, self.weights, self.edges = vocabulary, weights, edges

    def texts(self, trees: list[Tree]) -> list[str]:
        f = Forest(trees, self.vocabulary)
        p, _ = marginals(f, self.weights, self.edges)
        return ["\n".join(x for x, keep in zip(t.leaf_text, p[s:], strict=False) if x is not None and keep > 0.5) for t, s in zip(trees, f.start, strict=False)]


def train(trees: list[Tree], wanted: list[list[bool]], rounds: int = 200, penalty: float = 0.02) -> ContentModel:
    """Maximum likelihood by adaptive gradient steps; ``wanted`` labels the leaves of each tree."""
    vocabulary: dict[str, int] = {}
    f = Forest(trees, vocabulary, grow=True)
    y = np.concatenate([np.array(w, bool) for w in wanted]) & f.leaf
    for level in f.levels[:0:-1]:
        np.logical_or.at(y, f.parent[level], y[level])
    weights, edges = np.zeros(len(vocabulary)), np.zeros((2, 2, 2))
    edges[:, 0, 1] = -9.0  # no content below a parent without any
    inner = f.parent >= 0
    kind = f.leaf.astype(np.int64)
    above = np.where(inner, y[f.parent], False)
    seen = np.bincount(f.feature, y[f.at], len(vocabulary))
    held = np.zeros((2, 2))
    np.add.at(held, (kind[inner & above], y[inner & above].astype(np.int64)), 1.0)
    step_w, step_e = np.full(len(vocabulary), 1e-8), np.full((2, 2), 1e-8)
    for _ in range(rounds):
        p, joint = marginals(f, weights, edges)
        slope = seen - np.bincount(f.feature, p[f.at], len(vocabulary)) - penalty * len(trees) ** 0.5 * weights
        step_w += slope**2
        weights += 0.4 * slope / np.sqrt(step_w)
        expected = np.zeros((2, 2))
        np.add.at(expected, kind[inner], joint[inner])
        slope_e = held - expected - penalty * edges[:, 1, :]
        step_e += slope_e**2
        edges[:, 1, :] += 0.2 * slope_e / np.sqrt(step_e)
    return ContentModel(vocabulary, weights, edges)


# ---------------------------------------------------------------- labelled pages

_SAY = "The council met on Tuesday to discuss the plan for the old harbour and heard from residents who had lived there for decades."
_MORE = "Several speakers, among them a retired engineer, argued that the first design was cheaper; others disagreed and asked for more time."
_NAV = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li><li><a href="/c">Contact us</a></li></ul>'
_MAIN = f"<h1>A plan for the harbour</h1><p>{_SAY}</p><p>{_MORE} <a href='/x'>Read the minutes</a> for details.</p><h2>What is next</h2><p>{_MORE}</p>"
_LONG = f"<h1>Harbour</h1><p>{_SAY} {_MORE}</p><ul><li>A first point made by the mayor.</li><li>A second point, on the budget.</li></ul><blockquote>{_SAY}</blockquote><p>{_MORE} {_SAY}</p><p>Short end.</p>"
_TALK = "".join(f'<div class="comment"><p class="author">reader{i}</p><div class="comment-body"><p>{_MORE}</p></div></div>' for i in range(3))
_FOOT = "<p>&copy; 2024 Harbour Times. All rights reserved.</p><p><a href='/t'>Terms</a> <a href='/p'>Privacy</a></p>"
_SIDE = f"<h3>Most read</h3><ul><li><a href='/1'>Ten walks by the sea</a></li><li><a href='/2'>Who runs the port</a></li></ul><p>{_SAY}</p>"
_FORM = "<form action='/s'><label>Your address</label><input name='q'><select><option>One</option><option>Two</option></select><button>Subscribe</button><p>We send a letter every week, and you can leave the list at any time.</p></form>"
_AD = "Buy now: the new boots that every walker wants are half price this week only."
_NOTE = "We use cookies to improve your visit. By going on you accept our policy on data."

#: Layouts labelled by hand: ``data-main`` marks content, ``data-cut`` what is not, inside it.
SEEDS = [
    f"<html><head><title>t</title></head><body><header class='site-header'><p>The Harbour Times, your daily paper</p>{_NAV}</header><nav>{_NAV}</nav><article data-main>{_MAIN}</article><aside class='sidebar'>{_SIDE}</aside><footer>{_FOOT}</footer></body></html>",
    f"<body><nav>{_NAV}</nav><div class='ad'>{_AD}</div><article data-main>{_LONG}<div class='ad' data-cut>{_AD}</div><p>{_SAY}</p></article><footer>{_FOOT}</footer></body>",
    f"<body><div id='header'><h2>Harbour Times</h2></div><div id='menu'>{_NAV}</div><div id='content'><div class='post' data-main>{_MAIN}</div><div id='comments'><h3>3 comments</h3>{_TALK}</div></div><div id='sidebar'>{_SIDE}</div><div id='footer'>{_FOOT}</div></body>",
    f"<body><div class='cookie-notice'>{_NOTE}</div><div class='wrapper'><div class='navbar'>{_NAV}</div><main><div class='entry-content' data-main>{_LONG}</div><section class='comments'>{_TALK}</section></main></div><div class='footer'>{_FOOT}</div></body>",
    f"<body><div class='banner advertisement'><p>{_AD}</p></div><div class='container'><div class='main-content'><div class='article-body' data-main>{_MAIN}{_LONG}</div><div class='related-posts'><h3>Related</h3>{_NAV}</div></div><div class='right-column widget'>{_SIDE}</div></div></body>",
    f"<body><table><tr><td class='menu'>{_NAV}</td><td class='text' data-main>{_LONG}</td><td class='promo'>{_AD}</td></tr></table><div class='copyright'>{_FOOT}</div></body>",
    f"<body><header>{_NAV}<div class='notice alert'>{_NOTE}</div></header><main data-main><h1>Harbour</h1><p>{_SAY}</p><div class='share-buttons' data-cut><a href='/f'>Share</a> <a href='/m'>Mail</a></div><p>{_MORE}</p><aside class='pullout' data-cut>{_SIDE}</aside><p>{_SAY}</p></main>{_FORM}<footer>{_FOOT}</footer></body>",
    f"<body><div role='navigation'>{_NAV}</div><div role='main'><div class='story' data-main><h1>Harbour</h1>{_SAY}<br><br>{_MORE}<p>{_SAY}</p></div><div class='newsletter signup'>{_FORM}</div></div><div role='contentinfo'>{_FOOT}</div></body>",
    f"<body><div class='top-bar'>{_NAV}</div><article class='post' data-main>{_MAIN}<section class='comments' id='disqus' data-cut><h3>Reader comments</h3>{_TALK}<form class='reply' data-cut>{_FORM}</form></section></article><div class='subscribe popup'><p>{_NOTE}</p></div><footer class='page-footer'>{_FOOT}</footer></body>",
    f"<body><section class='hero promo'><p>{_AD}</p></section><section class='body-text' data-main>{_LONG}<figure><figcaption>The harbour at dawn.</figcaption></figure><table><tr><th>Year</th><th>Ships</th></tr><tr><td>2001</td><td>120</td></tr></table></section><section class='sponsored'><p>{_AD}</p></section><nav class='breadcrumb pagination'>{_NAV}</nav></body>",
    f"<body><div class='gdpr consent modal'><p>{_NOTE}</p><button>Accept all</button></div><div id='page'><div id='main'><div class='text' data-main><p>{_SAY}</p></div></div><div class='sidebar'>{_SIDE}{_FORM}</div><div class='discussion responses'>{_TALK}</div></div><div class='legal disclaimer'><p>{_NOTE}</p></div></body>",
    f"<body><header><h1>Harbour Times</h1><p class='tagline'>News from the coast since 1901.</p></header><nav>{_NAV}</nav><article data-main><header><h1>Harbour</h1></header><p>{_SAY}</p><p>{_MORE}</p><pre>a = 1; b = 2</pre><footer data-cut><p>Filed under <a href='/h'>harbour</a></p></footer></article><section id='comments'><h2>Comments</h2><ol><li><p>{_SAY}</p></li><li><p>{_MORE}</p></li></ol></section><aside><p>{_AD}</p></aside><footer>{_FOOT}</footer></body>",
    f"<body><article data-main><h1>Harbour</h1><p><b>{_SAY}<br><p>{_MORE}<p>{_SAY}</article><div class='ads sponsor'>{_AD}</div><div class='login'>{_FORM}</div><footer>{_FOOT}</footer></body>",
]
#: Names that sites give their parts.
_PARTS = {
    "main": ("content", "post content", "entry", "story text", "article text", "page body", "entry body", "main text", "post", "copy"),
    "menu": ("navigation", "nav menu", "masthead", "top navigation", "menu bar", "site header", "header links"),
    "side": ("sidebar widget", "widget area", "related", "popular posts", "side column", "more stories", "recommended"),
    "ad": ("ads", "advert", "sponsored promo", "banner ad", "ad slot"),
    "talk": ("comments area", "reader comments", "comment list", "discussion", "responses"),
    "foot": ("site footer", "footer links", "page footer copyright", "legal footer", "bottom links"),
    "note": ("cookie banner", "consent notice", "notice bar", "newsletter box", "subscribe", "search box"),
}


def _layouts(n: int = 20) -> list[str]:
    """Further layouts: those names in turn on divs, sections and table cells, in several orders."""
    made = []
    for k in range(n):
        tag = ("div", "section", "td")[k % 3]
        open_, close_ = ("<table><tr>", "</tr></table>") if tag == "td" else ("", "")

        def part(name: str, body: str, k: int = k, tag: str = tag, mark: str = "") -> str:
            words = _PARTS[name][k % len(_PARTS[name])]
            attribute = "id" if k % 4 == 3 and not mark else "class"
            return f"<{tag} {attribute}='{words.replace(' ', '-' if k % 2 else ' ')}'{mark}>{body}</{tag}>"

        inner = part("side", _NAV, mark=" data-cut") if k % 5 == 4 and tag != "td" else ""
        story = part("main", ("", "<h1>Harbour</h1>")[k % 2] + f"<p>{_SAY}</p>{inner}<p>{_MORE}</p>" + (_LONG if k % 4 < 2 else ""), mark=" data-main")
        talk = part("talk", f"<p>{_MORE}</p><p>I do not agree.</p>" if k % 2 else _TALK)
        side, ad, note = part("side", _SIDE if k % 2 else f"<h4>More</h4>{_NAV}"), part("ad", _AD if k % 3 == 0 else f"<p>{_AD}</p>"), part("note", (f"<p>{_NOTE}</p>", _FORM)[k % 2])
        middle = (story + talk + side, side + story + talk, story + side + ad)[k % 3 if k % 2 else 0]
        made.append(f"<body>{open_}{part('menu', _NAV)}{ad if k % 2 else ''}{middle}{note}{part('foot', _FOOT)}{close_}</body>")
    return made


SEEDS += _layouts()
_APART = frozenset(("nav", "aside", "form", "footer", "button", "select", "noscript", "iframe"))


def _own_labels(t: Tree) -> list[bool] | None:
    """Labels of a page that has exactly one article, or no article and one main element."""
    for name in _STORY:
        if t.tag.count(name) > 1:
            return None
        if name in t.tag:
            root = t.tag.index(name)
            inside = [False] * len(t.parent)
            for i in range(len(t.parent)):
                inside[i] = i == root or (i > root and inside[t.parent[i]] and t.tag[i] not in _APART and not any(x in _CUT_NAMES for x in t.features[i]))
            return inside
    return None


_CUT_NAMES = frozenset("name=" + x for x in ("comment", "ad", "advertisement", "sidebar", "notice", "share", "related", "newsletter", "promo"))


def fit(pages: DataFrame, sample: int = 300) -> ContentModel:
    """A model of the seeds and of at most ``sample`` of the pages (a documented bound)."""
    drawn = F.xxhash64(F.lit("extract"), "page_id", "url")
    held = pages.where(F.col("html").isNotNull()).select(drawn.alias("h"), F.col("html").cast("string").alias("html"))
    most = held.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    chosen = held.where(F.col("h") <= F.lit(most)).orderBy("h", "html").limit(sample)
    trees = [parse(s) for s in SEEDS] * 3  # as heavy as some of the table's own pages
    wanted = [[w and not c for w, c in zip(t.want, t.cut, strict=True)] for t in trees]
    for row in chosen.select("html").toLocalIterator():
        t = parse(row[0])
        labels = _own_labels(t)
        if labels is not None:
            trees.append(t)
            wanted.append(labels)
    return train(trees, wanted)


def extract(pages: DataFrame, model: ContentModel) -> DataFrame:
    """``page_id, url, text`` of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = shared.value.texts([parse(x or "") for x in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kept = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return kept.mapInArrow(run, "page_id long, url string, text string")
