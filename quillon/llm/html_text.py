"""Main-text extraction with a tree-structured graphical model.

A page becomes a tree: block elements and, as leaves, the text blocks between their borders. Every node is content or
not. Node potentials are log-linear in the tags and class words of the node and of those around it, and in text statistics; edge potentials tie the labels of
parents and children. Sum-product messages, first upward then downward, give each text block the marginal of being
content; those of at least one half are the main text. The same messages give the gradients of training.

The model is trained from labelled pages: a bounded sample (``max_train`` pages of at most ``MAX_TRAIN_CHARS``) of those that mark their
article themselves, the same texts set in other layouts, and a few built-in texts in the same layouts. The marks that label a page are
not features of it. The weights are a small constant that goes with the tasks.

Null and empty html give an empty text. Repeated rows stay. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import hashed_sample

MAX_TRAIN = 200
MAX_TRAIN_CHARS = 1 << 19
# Element classes of HTML.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
# Formulas are part of the text block around them.
INLINE |= set("math mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup mover munder munderover mmultiscripts mprescripts mtable mtr mtd mstyle mspace mpadded mphantom menclose merror semantics annotation annotation-xml".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("script style noscript template head title iframe object svg canvas audio video select textarea button option optgroup datalist annotation annotation-xml".split())
# Of these, tags within do not end them from outside: their content is text, or a document of its own.
CLOSED_WORLDS = set("script style title iframe textarea template".split())
# No article stands within these; where one begins, the end tag was forgotten.
WIDGETS = set("object svg canvas audio video select button option optgroup datalist".split())
# Elements of a drawing that hold HTML, and the HTML elements that end a drawing they stand in otherwise.
HTML_WITHIN = {"foreignobject", "desc", "title"}
ENDS_DRAWING = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
IN_HEAD = set("html head base basefont bgsound link meta title noscript noframes script style template".split())
CLOSED_BY = {  # an element ends where one of these begins
    "p": set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dt dd td th tr".split()),
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
    "head": {"body"}, "option": {"option"},
}
CELLS = {"td", "th", "tr", "tbody", "tfoot", "thead"}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
# Tag families and class words that the features tell apart.
TAGS = ["article main", "nav menu", "header hgroup", "footer", "aside", "form fieldset", "p pre blockquote", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "table tr td th", "section", "div", "figure figcaption", "dialog details", "address"]
WORDS = [
    "article post entry story content body text main prose", "ad ads advert advertisement sponsor sponsored promo promoted banner", "nav menu navbar breadcrumb breadcrumbs pagination pager toc",
    "sidebar side rail widget related recommended more", "footer foot bottom copyright legal", "header head masthead top topbar logo", "comment comments reply replies discussion respond disqus",
    "cookie cookies consent notice notification gdpr alert privacy banner", "newsletter subscribe signup login form search register", "share social follow tweet like", "popup modal overlay hidden", "author byline meta date tags category",
]
N_KINDS = len(TAGS) + len(WORDS)
N_FEATURES = 2 * N_KINDS + 10
_TAG = {t: k for k, names in enumerate(TAGS) for t in names.split()}
_WORD: dict[str, list[int]] = {}
for _k, _names in enumerate(WORDS):
    for _w in _names.split():
        _WORD.setdefault(_w, []).append(len(TAGS) + _k)


@lru_cache(maxsize=4096)
def element_features(tag: str, names: str) -> tuple[int, ...]:
    found = {_TAG[tag]} if tag in _TAG else set()
    for word in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", names).lower()):
        found.update(_WORD.get(word, ()))
    return tuple(sorted(found))


@dataclass
class Tree:
    """Nodes in document order; text blocks have a text."""

    parent: list[int] = field(default_factory=lambda: [-1])
    kinds: list[tuple[int, ...]] = field(default_factory=lambda: [()])
    texts: list[str | None] = field(default_factory=lambda: [None])
    linked: list[int] = field(default_factory=lambda: [0])
    labels: list[int] = field(default_factory=lambda: [0])


class TreeBuilder(HTMLParser):
    """Builds a Tree; ``data-y`` attributes (training layouts only) set labels, which descendants inherit."""

    def __init__(self, labels_from_tags: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.tree = Tree()
        self.open: list[tuple[str, int]] = [("", 0)]  # tag, node
        self.skip: list[str] = []  # the unseen element that is open, and what is open in it
        self.links = 0
        self.parts: list[str] = []
        self.link_chars = 0
        self.by_tags = labels_from_tags

    def add(self, kinds: tuple[int, ...], text: str | None, linked: int, label: int) -> int:
        t = self.tree
        t.parent.append(self.open[-1][1])
        t.kinds.append(kinds)
        t.texts.append(text)
        t.linked.append(linked)
        t.labels.append(label)
        return len(t.parent) - 1

    def border(self) -> None:
        """End the running text block."""
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.add((), text, min(self.link_chars, len(text)), self.tree.labels[self.open[-1][1]])
            self.parts, self.link_chars = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "select" and "select" in self.skip:  # ends the open one and opens none
            self.end_unseen(tag)
            return
        if self.skip:
            self.imply_unseen(tag)
        if self.skip:
            drawn = "svg" in self.skip and not self.within_drawing()
            if tag in UNSEEN or drawn and tag in HTML_WITHIN or not drawn and tag not in VOID and tag not in INLINE:
                self.skip.append(tag)
            return
        if tag in UNSEEN:
            self.skip = [tag]
            if tag not in INLINE:
                self.border()
            return
        if tag == "br":
            self.parts.append(" ")
        elif tag in INLINE:
            self.links += tag == "a"
        else:
            self.border()
            self.imply(tag)
            if tag in VOID:
                return
            given = dict(attrs)
            names = " ".join(str(given[k]) for k in ("class", "id", "role") if given.get(k))
            label = self.tree.labels[self.open[-1][1]]
            if given.get("data-y"):
                label = int(given["data-y"])
            elif self.by_tags:
                label = int(tag in ("article", "main") or label and tag not in ("nav", "aside", "footer", "form"))
            kinds = element_features("" if self.by_tags and tag in ("article", "main") else tag, names)
            self.open.append((tag, self.add(kinds, None, 0, label)))

    def imply_unseen(self, tag: str) -> None:
        """Close the unseen elements that the start of ``tag`` ends; their end tags may be left out."""
        unseen = UNSEEN.intersection(self.skip)
        open_world = unseen.isdisjoint(CLOSED_WORLDS)
        if open_world and (tag in ("article", "main") and unseen <= WIDGETS or (tag in CELLS or unseen <= {"canvas", "audio", "video", "noscript"}) and self.ended_by(tag)):
            self.skip = []
            self.border()
        elif open_world and tag in ENDS_DRAWING and "svg" in self.skip and not self.within_drawing():
            self.end_unseen("svg")
        elif tag == "body" or self.skip == ["head"] and tag not in IN_HEAD:
            self.skip = []
        elif self.skip[0] in ("option", "optgroup") and tag not in ("option", "optgroup"):  # of no list
            self.skip = []
        elif tag in ("option", "optgroup"):
            while self.skip and self.skip[-1] in ("option", tag):
                self.skip.pop()
        elif tag in ("input", "textarea"):
            self.end_unseen("select")
        elif tag == "button":
            self.end_unseen("button")

    def within_drawing(self) -> bool:
        """Whether an element that holds HTML is open in the innermost drawing."""
        at = len(self.skip) - 1 - self.skip[::-1].index("svg")
        return not HTML_WITHIN.isdisjoint(self.skip[at:])

    def end_unseen(self, tag: str) -> None:
        """End the innermost open unseen ``tag`` with all that is open in it."""
        for k in range(len(self.skip) - 1, -1, -1):
            if self.skip[k] == tag:
                del self.skip[k:]
                break

    def ended_by(self, tag: str) -> bool:
        """Whether the start of ``tag`` ends an open element around the unseen ones."""
        others = [other for other, _ in self.open[1:]]
        return next((tag in CLOSED_BY.get(other, ()) for other in reversed(others) if other in CLOSED_BY or other in SCOPE.get(tag, ())), False)

    def imply(self, tag: str) -> None:
        """Close the elements that the start of ``tag`` ends."""
        for k in range(len(self.open) - 1, 0, -1):
            other = self.open[k][0]
            if tag in CLOSED_BY.get(other, ()):
                del self.open[k:]
            elif other != "p" and (tag not in SCOPE or other in SCOPE[tag]) or tag not in CLOSED_BY.get(other, ()) and tag not in SCOPE:
                break

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if self.skip[0] in ("option", "optgroup") and tag not in UNSEEN:
                self.skip = []
            elif tag in self.skip or not CLOSED_WORLDS.isdisjoint(self.skip) or tag in INLINE or all(tag != other for other, _ in self.open):
                self.end_unseen(tag)
                return
            else:  # an element around the unseen one ends, and the unseen one with it
                self.skip = []
        if tag in INLINE:
            self.links = max(0, self.links - (tag == "a"))
            return
        self.border()
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break
        if tag in ("p", "li", "div", "nav", "ul", "section", "article"):
            self.links = 0

    def handle_data(self, data: str) -> None:
        if self.skip == ["head"] and data.strip():
            self.skip = []
        if not self.skip:
            self.parts.append(data)
            if self.links:
                self.link_chars += len(data)


def parse(html: str, labels_from_tags: bool = False) -> Tree:
    builder = TreeBuilder(labels_from_tags)
    builder.feed(html)
    builder.close()
    builder.border()
    return builder.tree


class Forest:
    """The trees of many pages as arrays; node ``k`` of a page follows its parent."""

    def __init__(self, trees: list[Tree]):
        sizes = np.array([len(t.parent) for t in trees])
        self.start = np.cumsum(sizes) - sizes
        self.parent = np.concatenate([np.array(t.parent) + s for t, s in zip(trees, self.start, strict=True)])
        self.parent[self.start] = -1
        self.n = len(self.parent)
        depth: list[int] = []
        for t in trees:
            own: list[int] = []
            for p in t.parent:
                own.append(own[p] + 1 if p >= 0 else 0)
            depth += own
        self.depth = np.array(depth)
        order = np.argsort(self.depth, kind="stable")
        edges = np.searchsorted(self.depth[order], np.arange(1, self.depth.max() + 2))
        self.levels = [order[a:b] for a, b in zip(edges, edges[1:], strict=False)]  # depth 1 on
        self.leaf = np.array([x is not None for t in trees for x in t.texts])
        self.size = np.array([len(x or "") for t in trees for x in t.texts], float)
        self.linked = np.array([x for t in trees for x in t.linked], float)
        self.features = self._features(trees)

    def _features(self, trees: list[Tree]) -> np.ndarray:
        x = np.zeros((self.n, N_FEATURES), np.float32)
        at = [(k, f) for k, f in enumerate(kinds for t in trees for kinds in t.kinds) if f]
        if at:
            x[np.repeat([k for k, _ in at], [len(f) for _, f in at]), [j for _, f in at for j in f]] = 1
        texts = [s or "" for t in trees for s in t.texts]
        total, linked, blocks = self.size.copy(), self.linked.copy(), self.leaf.astype(float)
        for level in reversed(self.levels):
            for v in (total, linked, blocks):
                np.add.at(v, self.parent[level], v[level])
        for level in self.levels:  # the families of all elements around a node
            up = self.parent[level]
            x[level, N_KINDS : 2 * N_KINDS] = np.maximum(x[up, :N_KINDS], x[up, N_KINDS : 2 * N_KINDS])
        own = 2 * N_KINDS
        stops = np.array([s.count(".") + s.count(",") + s.count(";") for s in texts], float)
        ends = np.array([s[-1:] in ".!?…\"”" and s != "" for s in texts])
        x[:, own] = np.log1p(total) / 8
        x[:, own + 1] = linked / np.maximum(total, 1)
        x[:, own + 2] = np.log1p(total / np.maximum(blocks, 1)) / 6
        x[:, own + 3] = self.leaf
        x[:, own + 4] = self.leaf & ends
        x[:, own + 5] = np.minimum(stops / np.maximum(self.size, 1) * 20, 2)
        x[:, own + 6] = np.array([s[:1] in "©" and s != "" for s in texts])
        x[:, own + 7] = self.leaf & (self.size < 30)
        x[:, own + 8] = np.minimum(self.depth, 10) / 10
        x[:, own + 9] = 1
        return x


@dataclass(frozen=True)
class Model:
    """``unary``: weights of content against not; ``edge[a, b]``: log potential of parent label a, child label b."""

    unary: np.ndarray
    edge: np.ndarray


def sum_product(forest: Forest, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Marginal of content for every node, and expected label pairs of parents and children, over all trees at once."""
    own = np.zeros((forest.n, 2))
    own[:, 1] = forest.features @ model.unary
    up, sent = own.copy(), np.zeros((forest.n, 2))
    for level in reversed(forest.levels):
        b = up[level]
        message = np.logaddexp(b[:, :1] + model.edge[:, 0], b[:, 1:] + model.edge[:, 1])
        message -= message.max(axis=1, keepdims=True)
        sent[level] = message
        np.add.at(up, forest.parent[level], message)
    belief, pairs = up.copy(), np.zeros((2, 2))
    for level in forest.levels:
        rest = belief[forest.parent[level]] - sent[level]  # what the parent knows without this child
        message = np.logaddexp(rest[:, :1] + model.edge[0], rest[:, 1:] + model.edge[1])
        belief[level] = up[level] + message - message.max(axis=1, keepdims=True)
        pair = rest[:, :, None] + model.edge + up[level][:, None, :]
        pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True))
        pairs += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), pairs


def fit(trees: list[Tree], steps: int = 300, ridge: float = 1e-5) -> Model:
    """Maximum likelihood of the labels of whole trees, by Adam on sum-product gradients."""
    forest = Forest(trees)
    y = np.array([label for t in trees for label in t.labels], int)
    inner = forest.parent >= 0
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[forest.parent[inner]], y[inner]), 1)
    x = forest.features.astype(float)
    w = np.zeros(N_FEATURES + 4)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        p, pairs = sum_product(forest, Model(w[:N_FEATURES], w[N_FEATURES:].reshape(2, 2)))
        g = np.concatenate([x.T @ (y - p), (seen - pairs).ravel()]) / len(y) - ridge * w
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w = w + 0.1 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(w[:N_FEATURES], w[N_FEATURES:].reshape(2, 2))


# Built-in texts, so that layouts can be learned without labelled pages.
SAMPLE_CONTENT = [
    "A walk along the river", "The path leaves the village behind the mill, follows the bank for two miles, and climbs to the old quarry. Bring water.",
    "In spring the meadow floods; herons stand in the shallows and wait.", "Local people say the bridge was built in a week, which nobody believes.", "Yes.",
    "Maps are sold at the station. The last train leaves at nine, and there is no other way home.",
]
SAMPLE_OTHER = ["Home", "About us", "Contact", "Buy two lamps and get one free today only.", "All rights reserved. River Walks Ltd.", "Nice trip, thanks for sharing it with all of us!", "We use cookies to improve this site. By going on you agree."]


def layout(content: list[str], other: list[str], seed: int) -> str:
    """A labelled page that sets the texts in a layout drawn with ``seed``: where boilerplate stands, in which elements
    and class names, with prose, lists or links inside, and how the main text is wrapped."""
    rng = random.Random(seed)
    first = rng.randrange(len(content))
    content = content[first : first + rng.choice([1, 2, 3, 5, 8, 30])]
    if rng.random() < 0.5:  # short blocks
        content = [" ".join(t.split()[: rng.randint(1, 14)]) for t in content]
    body = [escape(t) for t in content]
    rest = [escape(t) for t in [*other, *SAMPLE_OTHER]]

    def links() -> str:
        found = [f'<a href="#">{" ".join(rng.choice(rest).split()[: rng.randint(1, 4)])}</a>' for _ in range(rng.randint(1, 6))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in found) + "</ul>" if rng.random() < 0.6 else " ".join(found)

    def prose() -> str:
        tag = rng.choice(["p", "p", "div", ""])
        source = body if rng.random() < 0.4 else rest  # readers and adverts write sentences, too
        found = [rng.choice(source) for _ in range(rng.randint(1, 3))]
        return "".join(f"<{tag}>{x}</{tag}>" for x in found) if tag else found[0]

    def filling() -> str:
        title = f"<h3>{rng.choice(rest)}</h3>" if rng.random() < 0.3 else ""
        return title + rng.choice([links, prose, prose, lambda: prose() + links()])()

    def boilerplate() -> str:
        words = rng.choice(WORDS[1:]).split()
        tag = rng.choice(["div", "section", "div", "nav", "aside", "header", "footer", "form"])
        plain = tag in ("div", "section") or rng.random() < 0.3
        name = f' {rng.choice(["class", "id"])}="{rng.choice(["", "", "site-", "main-"])}{rng.choice(words)}"' if plain else ""
        inner = filling()
        if rng.random() < 0.3:
            inner = f"<div>{inner}</div><div>{filling()}</div>"
        return f'<{tag}{name} data-y="0">{inner}</{tag}>'

    head = rng.choice(["h1", "h1", "h2", "p"])
    parts = [f"<{head}>{body[0]}</{head}>", *(f"<p>{t}</p>" for t in body[1:])]
    if rng.random() < 0.2:
        parts.insert(rng.randint(1, len(parts)), "<table>" + "".join(f"<tr><td>{t}</td><td>{k}</td></tr>" for k, t in enumerate(body[:3])) + "</table>")
    if rng.random() < 0.4:
        parts.insert(rng.randint(1, len(parts)), "<ul>" + "".join(f"<li>{t}</li>" for t in body[1:4]) + "</ul>")
    if rng.random() < 0.3:
        parts.insert(rng.randint(1, len(parts)), f"<blockquote>{body[-1]}</blockquote>")
    for _ in range(rng.randint(0, 2)):
        parts.insert(rng.randint(1, len(parts)), boilerplate())
    inner = "".join(parts)
    if rng.random() < 0.3:
        inner = f"<div>{inner}</div>"
    wrap = rng.choice(["article", "main", "article", "div", "section", "div"])
    name = f' {rng.choice(["class", "id"])}="{rng.choice(["", "post-", "page-"])}{rng.choice(WORDS[0].split())}"' if wrap in ("div", "section") else ""
    page = f'<{wrap}{name} data-y="1">{inner}</{wrap}>'
    for _ in range(rng.randint(0, 2)):
        around = "".join(boilerplate() for _ in range(rng.randint(0, 2)))
        page = f"<div>{page}{around}</div>" if rng.random() < 0.5 else f"<div>{around}{page}</div>"
    before, after = ("".join(boilerplate() for _ in range(rng.randint(0, 3))) for _ in range(2))
    page = f"{before}{page}{after}"
    return f"<body>{page}</body>" if rng.random() < 0.9 else page


def train(pages: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on pages that mark their article and on layouts of their texts."""
    marked = pages.select(F.col("html").cast("string").alias("html")).where(F.col("html").rlike("(?i)<(article|main)[ >]") & (F.length("html") <= MAX_TRAIN_CHARS))
    sample = [r["html"] for r in hashed_sample(marked, "html", max_train).collect()]
    trees = [parse(layout(SAMPLE_CONTENT, SAMPLE_OTHER, -k)) for k in range(1, 250)]
    for k, html in enumerate(sample):
        tree = parse(html, labels_from_tags=True)
        trees.append(tree)
        content = [t for t, y in zip(tree.texts, tree.labels, strict=True) if t and y]
        other = [t for t, y in zip(tree.texts, tree.labels, strict=True) if t and not y]
        if len(content) > 1:
            trees.append(parse(layout(content[:30], other, k)))
    return fit(trees)


def main_texts(model: Model, pages: list[str]) -> list[str]:
    trees = [parse(h) for h in pages]
    if not trees:
        return []
    forest = Forest(trees)
    chosen = sum_product(forest, model)[0] >= 0.5
    return ["\n\n".join(x for x, c in zip(t.texts, chosen[s : s + len(t.texts)].tolist(), strict=True) if c and x) for t, s in zip(trees, forest.start, strict=True)]


def extract(pages: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars."""
    model = train(pages, max_train)

    def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = main_texts(model, [h.as_py() or "" for h in batch.column(2)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(texts, "page_id long, url string, text string, n_chars long")
