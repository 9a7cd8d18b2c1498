"""Main text of HTML pages by gradient-boosted trees over DOM nodes.

A page becomes a tree of block elements with anonymous text blocks. Each node has features of its tag, the tokens of its
class, id and role, its depth and place among its siblings, and its subtree (text, link density, tags, punctuation).
Tokens are hashed into BUCKETS; the TOKENS buckets that tell most about the labels of the training pages are features of
the node itself and of what stands above and below it. Boosted regression trees on histograms give each node's log odds of being main text; they are
trained on pages generated here from templates with many layouts and naming habits, whose labels are known. Decoding is
hierarchical: the labelling with the best total log likelihood in which no kept node has a dropped ancestor, found by
one pass up and one down the tree.

Cases: null and empty pages, and pages without main text, give the empty string; unclosed and stray tags are repaired
as browsers do it, roughly: what follows an unclosed script, style or other element of raw text is part of it; very
long pages are handled whole; repeated rows give equal texts; an empty table gives an empty table; a column named
main_text is replaced, other columns are kept.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import lean, others

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[/!?a-zA-Z][^>]*+>?""", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_WORD = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page; those of HIDDEN hold raw text and reach to the page's end if unclosed.
HIDDEN = frozenset("script style textarea title noscript iframe".split())
RAW = HIDDEN | frozenset("template svg math object canvas select option button".split())
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I) for tag in RAW}
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "tbody": {"table"}}
KINDS = (
    frozenset("article main".split()), frozenset("nav menu".split()), frozenset(("footer",)), frozenset(("header",)), frozenset(("aside",)), frozenset("form fieldset dialog".split()),
    frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset(("p", "blockquote", "pre")), frozenset("ul ol dl".split()), frozenset("li dt dd".split()), frozenset("table tbody tr td th".split()), frozenset("div section".split()), frozenset(("#text",)),
)
_KIND = {tag: k for k, kind in enumerate(KINDS) for tag in kind}
#: Buckets that tokens of class, id and role are hashed into, and how many of them are features.
BUCKETS, TOKENS = 4_096, 64


class Node:
    __slots__ = ("attrs", "children", "link", "parent", "parts", "tag", "text")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent, self.attrs, self.children, self.parts, self.text, self.link = tag, parent, attrs, [], [], "", 0
        if parent is not None:
            parent.children.append(self)


def parse(page: str) -> Node:
    """The tree of block elements; text stands in ``#text`` nodes, one for each run between block boundaries."""
    root = Node("html", None)
    at, pos, links = root, 0, 0
    run: Node | None = None
    unclosed: set[str] = set()  # raw elements without an end tag in the rest of the page

    def add(text: str) -> None:
        nonlocal run
        if run is None:
            if not text.strip():
                return
            run = Node("#text", at)
        run.parts.append(text)
        if links:
            run.link += len(text)

    for m in _TOKEN.finditer(page):
        if m.start() < pos:
            continue
        if m.start() > pos:
            add(page[pos : m.start()])
        pos = m.end()
        tag = m[2].lower() if m[2] else ""
        if not tag:
            continue
        if tag in RAW and not m[1]:
            end = None if tag in unclosed else _END[tag].search(page, pos)
            if end is None:
                unclosed.add(tag)
            pos = end.end() if end else len(page) if tag in HIDDEN else pos
            continue
        if tag == "a":
            links = 0 if m[1] else 1
        if tag == "br":
            add(" ") if run is not None else None
        if tag not in BLOCK:
            continue
        run = None
        if m[1]:
            up = at
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                at = up.parent
            continue
        if tag in ("html", "body"):
            continue
        # a paragraph or heading ends where a block starts; list items and cells end the one before
        if at.tag == "p":
            at = at.parent
        if tag in CLOSES:
            up = at
            while up.parent is not None and up.tag not in HOLDS[tag] and up.tag not in CLOSES[tag]:
                up = up.parent
            while up.parent is not None and up.tag in CLOSES[tag]:
                up = up.parent
                at = up
        if tag == "hr":
            continue
        at = Node(tag, at, m[3])
    if pos < len(page):
        add(page[pos:])
    return root


def nodes_of(root: Node) -> list[Node]:
    """All nodes, parents before children, in page order; texts are decoded and their white space made single spaces."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == "#text":
            node.text = " ".join(entities.unescape("".join(node.parts)).split())
        out.append(node)
        todo.extend(reversed(node.children))
    return out


@cache
def _bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % BUCKETS


def tokens(node: Node) -> set[int]:
    """Buckets of the tokens of a node's class, id and role."""
    out: set[int] = set()
    if node.attrs:
        for name, value in _ATTR.findall(node.attrs):
            if name.lower() in ("class", "id", "role"):
                out.update(_bucket(w) for w in _WORD.findall(value.lower()))
    return out


def features(nodes: list[Node], buckets: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features and the parent's number for each node; ``buckets`` are those of the tokens that count."""
    n = len(nodes)
    number = {id(x): i for i, x in enumerate(nodes)}
    place = {b: len(KINDS) + k for k, b in enumerate(buckets)}
    parent = np.array([number[id(x.parent)] if x.parent is not None else -1 for x in nodes])
    own = np.zeros((n, len(KINDS) + len(buckets)))
    sums = np.zeros((n, 5 + len(buckets) + 4))  # text, link text, nodes, punctuation, paragraphs; then tokens and some kinds below
    depth, index, siblings = np.zeros(n), np.zeros(n), np.zeros(n)
    for i, x in enumerate(nodes):
        if x.tag in _KIND:
            own[i, _KIND[x.tag]] = 1
        if x.attrs:
            for b in tokens(x):
                if b in place:
                    own[i, place[b]] = 1
        if x.text:
            sums[i, :2] = len(x.text), min(x.link, len(x.text))
            sums[i, 3] = x.text.count(".") + x.text.count(",")
        sums[i, 2], sums[i, 4] = 1, x.tag == "p"
        if parent[i] >= 0:
            depth[i] = depth[parent[i]] + 1
        for k, c in enumerate(x.children):
            j = number[id(c)]
            index[j], siblings[j] = k, len(x.children)
    sums[:, 5 : 5 + len(buckets)] = own[:, len(KINDS) :]
    sums[:, 5 + len(buckets) :] = own[:, 1:5]
    above = own.copy()
    for i in range(n - 1, 0, -1):
        sums[parent[i]] += sums[i]
    for i in range(1, n):  # what any ancestor is
        above[i] += above[parent[i]]
    above -= own
    text = sums[:, 0]
    before = np.concatenate(([0], np.cumsum([len(x.text) for x in nodes])))[:-1]
    total = max(1.0, text[0])
    share = text / np.maximum(1, text[np.maximum(parent, 0)])
    extra = np.stack([depth, index, siblings, np.log1p(text), sums[:, 1] / np.maximum(1, text), text / sums[:, 2], sums[:, 3] / np.maximum(1, text), np.log1p(sums[:, 4]), share, text / total, before / total], 1)
    return np.hstack([own, np.minimum(above, 1), np.minimum(sums[:, 5 : 5 + len(buckets)], 1), np.log1p(sums[:, 5 + len(buckets) :]), extra]), parent


class Boosted:
    """Boosted regression trees of fixed depth on binned features, for log odds."""

    def __init__(self, trees: int = 50, depth: int = 4, rate: float = 0.3, bins: int = 24):
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        flags = ((x == 0) | (x == 1)).all(0)
        self.edges = [np.array([0.5]) if f else np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for f, c in zip(flags, x.T, strict=True)]
        b = self._bin(x)
        flag, level_of = np.flatnonzero(flags), np.flatnonzero(~flags)
        set_ = x[:, flag].astype(np.float32)
        every = np.arange(len(y))
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        f = np.full(len(y), self.base)
        self.nodes = []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            at = np.zeros(len(y), int)
            feature, cut = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, 255)
            for level in range(self.depth):
                low, wide = 2**level - 1, 2**level
                here = np.flatnonzero((at >= low) & (at < low + wide))
                # sums of both gradients over the rows of each tree node, and over those whose flag is set
                parts = np.zeros((len(y), 2 * wide), np.float32)
                parts[here, at[here] - low], parts[here, wide + at[here] - low] = g[here], h[here]
                held = (set_.T @ parts).astype(float)
                for k in range(low, low + wide):
                    rows = every[at == k]
                    if len(rows) < 20:
                        continue
                    best = 1e-9
                    gs, hs = g[rows].sum(), h[rows].sum()
                    gain = lambda gl, hl: gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)  # noqa: B023, E731
                    if len(flag):
                        gains = gain(gs - held[:, k - low], np.maximum(hs - held[:, wide + k - low], 0))
                        if gains.max() > best:
                            best, feature[k], cut[k] = gains.max(), flag[gains.argmax()], 0
                    for c in level_of:
                        gains = gain(*(np.cumsum(np.bincount(b[rows, c], v[rows], self.bins))[:-1] for v in (g, h)))
                        if gains.max() > best:
                            best, feature[k], cut[k] = gains.max(), c, int(gains.argmax())
                inner = at >= low
                at[inner] = 2 * at[inner] + 1 + (b[inner, feature[at[inner]]] > cut[at[inner]])
            leaf = at - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + 1)
            f += value[leaf]
            self.nodes.append((feature, cut, value))
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], 1).astype(np.int64)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.nodes:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
            f += value[at - (2**self.depth - 1)]
        return f


def decode(odds: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the likeliest labelling in which a kept node's parent is kept; the root always is."""
    keep, lose = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    drop = lose.copy()
    for i in range(len(odds) - 1, 0, -1):
        drop[parent[i]] += drop[i]
    best = keep.copy()
    for i in range(len(odds) - 1, 0, -1):
        best[parent[i]] += max(best[i], drop[i])
    kept = np.zeros(len(odds), bool)
    kept[0] = True
    for i in range(1, len(odds)):
        kept[i] = kept[parent[i]] and best[i] > drop[i]
    return kept


@cache
def _vocabulary() -> list[str]:
    rng = np.random.default_rng(1)
    return ["".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(2, 9))) for _ in range(3_000)]


def training_page(rng: np.random.Generator) -> str:
    """A page from templates; what is main text carries the attribute data-main on its container."""
    words = lambda n: " ".join(_vocabulary()[i] for i in rng.integers(0, len(_vocabulary()), n))
    pick = lambda *a: a[rng.integers(len(a))]
    sentence = lambda: words(int(rng.integers(1, 25))) + pick(". ", ", ", "! ", " &amp; ")
    prose = lambda most: "".join(sentence() for _ in range(int(rng.integers(1, most))))
    named = lambda *names: pick(f' class="{pick(*names)}"', f' id="{pick(*names)}"', f' class="{words(1)} {pick(*names)}-{words(1)}"')
    links = lambda n: "".join(f'<li><a href="/{words(1)}">{words(int(rng.integers(1, 4)))}</a></li>' for _ in range(n))

    def block() -> str:
        kind = rng.random()
        if kind < 0.7:
            return pick(f"<p>{prose(9)}</p>", f"<p>{prose(5)}<a href='/x'>{words(2)}</a> {prose(3)}", f"<p><b>{prose(4)}<br>")
        if kind < 0.8:
            return f"<h{rng.integers(2, 5)}>{words(4)}</h3>"
        if kind < 0.88:
            return "<ul>" + "".join(f"<li>{prose(3)}</li>" for _ in range(rng.integers(1, 6))) + "</ul>"
        return pick(f"<blockquote>{prose(4)}</blockquote>", f"<pre>{prose(3)}</pre>", f"<table><tr><td>{words(3)}<td>{words(2)}</table>", f"<div>{prose(4)}</div>")

    if rng.random() < 0.05:  # a page of nothing but text
        return "<body>" + "".join(re.sub(r"^<(\w+)", r"<\1 data-main", block()) for _ in range(rng.integers(1, 6)))
    body = (f"<h1>{words(int(rng.integers(1, 12)))}</h1>" if rng.random() < 0.9 else "") + "".join(block() for _ in range(rng.integers(1, 25)))
    main = pick(f"<article data-main>{body}</article>", f"<main data-main>{body}</main>", f"<main><article data-main>{body}</article></main>", f"<div{named('content', 'post', 'entry', 'article', 'story')} data-main>{body}</div>", f"<section{named('content', 'text')} data-main>{body}</section>")
    junk = {
        "nav": lambda: pick(f"<nav><ul>{links(rng.integers(1, 12))}</ul></nav>", f"<div{named('menu', 'nav', 'breadcrumbs')}><ul>{links(rng.integers(2, 9))}</ul></div>", f"<nav>{links(4)}</nav>"),
        "ad": lambda: pick(f"<div{named('ad', 'ads', 'advert', 'promo', 'sponsored')}>{prose(5)}</div>", f"<aside{named('ad')}><p>{prose(3)}</p></aside>"),
        "header": lambda: pick(f"<header><h1>{words(2)}</h1>{words(3)}</header>", f"<div{named('header', 'banner', 'masthead')}>{words(4)}</div>"),
        "side": lambda: pick(f"<aside><h3>{words(2)}</h3><ul>{links(5)}</ul></aside>", f"<div{named('sidebar', 'related', 'widget')}><p>{prose(4)}</p><ul>{links(4)}</ul></div>", f"<aside>{prose(4)}</aside>"),
        "notice": lambda: f"<div{named('cookie', 'notice', 'consent', 'newsletter', 'alert')}><p>{prose(4)}</p></div>",
        "form": lambda: f"<form><label>{words(2)}</label><input name='q'><p>{words(5)}</p></form>",
    }
    after = {
        "comments": lambda: pick(f"<section{named('comments', 'replies')}>", f"<div{named('comments', 'discussion')}>") + "".join(f"<div{named('comment', 'reply')}><p>{prose(5)}</p></div>" for _ in range(rng.integers(1, 6))) + pick("</section>", "</div>"),
        "footer": lambda: pick(f"<footer>&copy; {words(1)} &middot; {prose(4)}</footer>", f"<div{named('footer', 'copyright')}><p>{prose(3)}</p></div>", f"<footer><p>{prose(4)}</p></footer>"),
        "side": junk["side"],
        "ad": junk["ad"],
    }
    marked = lambda t: re.sub(r"^<(\w+)", r"<\1 data-junk", t)

    def inside(t: str) -> str:
        if rng.random() < 0.2:
            t = t.replace("<p>", marked(junk[pick(*junk)]()) + "<p>", 1)
        if rng.random() < 0.25:
            close = max(t.rfind(c) for c in ("</article>", "</div>", "</section>", "</main>"))
            close = t.rfind("</article>") if "</article></main>" in t else close
            t = t[:close] + marked(after[pick(*after)]()) + t[close:]
        return t

    some = lambda kinds, p: "".join(kinds[k]() for k in kinds if rng.random() < p)
    page = some(junk, 0.45) + inside(main) + some(after, 0.55)
    return f"<body>{pick('', f'<div{named(chr(112) + chr(97) + chr(103) + chr(101))}>')}{page}</body>"


def _labels(nodes: list[Node]) -> np.ndarray:
    """1 for nodes in the marked container (but not in marked junk inside it), and for what leads to it."""
    number = {id(x): i for i, x in enumerate(nodes)}
    y = np.zeros(len(nodes))
    for i, node in enumerate(nodes):
        within = node.parent is not None and y[number[id(node.parent)]] > 0
        y[i] = "data-junk" not in node.attrs and ("data-main" in node.attrs or within)
    for i in range(len(nodes) - 1, 0, -1):
        if y[i]:
            y[number[id(nodes[i].parent)]] = 1
    return y


def _telling(pages: list[list[Node]], labels: list[np.ndarray]) -> tuple[int, ...]:
    """The TOKENS buckets whose tokens tell most about the labels of the nodes that have them or stand below them."""
    seen, main = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for nodes, y in zip(pages, labels, strict=True):
        number = {id(x): i for i, x in enumerate(nodes)}
        held: list[set[int]] = []
        for i, x in enumerate(nodes):
            held.append(tokens(x) | (held[number[id(x.parent)]] if x.parent is not None else set()))
            for b in held[i]:
                seen[b] += 1
                main[b] += y[i]
    base = sum(y.sum() for y in labels) / sum(len(y) for y in labels)
    part = lambda q, p: np.where(q > 0, q * np.log(np.maximum(q, 1e-12) / p), 0)
    rate = main / np.maximum(seen, 1)
    told = seen * (part(rate, base) + part(1 - rate, 1 - base))
    return tuple(sorted(int(b) for b in np.argsort(-told, kind="stable")[:TOKENS] if seen[b]))


@cache
def model(pages: int = 400, seed: int = 5) -> Boosted:
    """The trees, trained on ``pages`` generated pages, with the buckets of tokens that they know."""
    rng = np.random.default_rng(seed)
    made = [nodes_of(parse(training_page(rng))) for _ in range(pages)]
    labels = [_labels(nodes) for nodes in made]
    buckets = _telling(made, labels)
    trees = Boosted().fit(np.concatenate([features(nodes, buckets)[0] for nodes in made]), np.concatenate(labels))
    trees.buckets = buckets
    return trees


def main_texts(pages: list[str | None], trees: Boosted) -> list[str]:
    """The kept blocks of each page, one a line."""
    parsed = [nodes_of(parse(p or "")) for p in pages]
    made = [features(n, trees.buckets) for n in parsed]
    odds = trees.log_odds(np.concatenate([x for x, _ in made])) if made else np.zeros(0)
    out, at = [], 0
    for nodes, (x, parent) in zip(parsed, made, strict=True):
        kept = decode(odds[at : at + len(x)], parent)
        at += len(x)
        out.append("\n".join(node.text for node, k in zip(nodes, kept, strict=True) if k and node.text))
    return out


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with main_text."""
    lean(pages.sparkSession)
    trees = pages.sparkSession.sparkContext.broadcast(model())
    kept = others(pages, "main_text")
    pages, at = pages.select(*(F.col(f"`{c}`") for c in kept)), kept.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            for i in range(0, batch.num_rows, 64):
                texts += main_texts(batch.column(at).slice(i, 64).to_pylist(), trees.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "main_text"])

    return pages.mapInArrow(run, T.StructType(list(pages.schema.fields)).add("main_text", "string"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
