"""Content extraction from HTML by a tree-structured graphical model.

A page's DOM (elements and text leaves, after the implied end tags of paragraphs, list
items and table cells) is a tree of binary variables: content or not. Unary potentials
are log-linear in features of a node; a 2x2 potential joins each node to its parent, one
for text leaves and one for elements. Messages go from the leaves upward and from the
root downward, all nodes of one depth of a whole batch of pages at once; the
marginals are exact. The model is trained by the gradient of the likelihood (observed
minus expected, from node and edge marginals) on at most max_pages labelled pages.

Labels come from pages that say what their content is, in an article or main element,
less nav, aside, footer, header and form in it. These two tags are hidden from the
features (they count as div), so the model carries over to pages that don't say.

Null html gives a row with null content; a page without text gives empty content. Repeated
rows and null page_id are as they are; extra columns make no difference, and their names may clash.
A page is parsed whole, however long. A marginal that ties with the threshold counts as content. An empty
table gives an empty result; a model fitted without labelled pages has marginals of 1/2 throughout, so all text is content.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.runtime import map_arrow, only

SCHEMA = "page_id long, url string, content string, text_nodes int, content_nodes int"
TEXT = "#text"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset(["script", "style", "textarea", "noscript", "template"])
INLINE = frozenset("a abbr b big cite code em font i kbd mark q s small span strong sub sup tt u var label".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
PEERS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
GROUPS = [("p", "pre", "blockquote"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("li", "ul", "ol", "dl", "dt", "dd"), ("a",), ("nav", "menu"), ("footer", "header", "aside", "form"), ("table", "tr", "td", "th", "tbody"), ("head", "title", "meta", "link", *RAW), ("html", "body")]
GROUP = {tag: k for k, tags in enumerate(GROUPS) for tag in tags}
OTHER, LEAF = len(GROUPS), len(GROUPS) + 1
HINT = re.compile(r"\b(ad|ads|advert|nav|menu|foot|footer|side|sidebar|banner|promo|cookie|share|social|comment|breadcrumb)", re.I)
#: A quote opens only after an equals sign, and hides a > up to its end if it has one.
TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]+|=\s*(?:"[^"]*"|'[^']*')?)*)>?""", re.S)
ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>]|$)", re.I | re.A) for tag in RAW}
BOILER = frozenset(["nav", "aside", "footer", "header", "form"])
FEATURES = LEAF + 1 + LEAF + 1 + 8


class Page:
    """A DOM as parallel lists; node 0 is the root."""

    __slots__ = ("parent", "depth", "tag", "text", "hint", "label")

    def __init__(self):
        self.parent, self.depth, self.tag, self.text, self.hint, self.label = [-1], [0], ["#root"], [None], [False], [0]

    def add(self, parent: int, tag: str, text: str | None, hint: bool, label: int) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.tag.append(tag)
        self.text.append(text)
        self.hint.append(hint)
        self.label.append(label)
        return len(self.parent) - 1


def parse(source: str) -> tuple[Page, bool]:
    """The page's tree, and whether it says what its content is."""
    page, stack, at, said = Page(), [0], 0, False
    tags = page.tag
    end, size = 0, len(source)
    while at < size:
        m = TOKEN.search(source, at)
        start = m.start() if m else size
        text = source[end:start]
        if text and not text.isspace():
            top = stack[-1]
            page.add(top, TEXT, text, False, page.label[top])
        if not m:
            break
        at = end = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] == tag:
                    del stack[k:]
                    break
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                open_ = tags[stack[k]]
                if open_ == "p":
                    del stack[k:]
                    break
                if open_ not in INLINE:
                    break
        peers = PEERS.get(tag)
        if peers:
            stops, cut = STOPS[tag], len(stack)
            for k in range(len(stack) - 1, 0, -1):
                open_ = tags[stack[k]]
                if open_ in stops:
                    break
                if open_ in peers:
                    cut = k
            del stack[cut:]
        top = stack[-1]
        label = page.label[top]
        if tag == "article" or tag == "main":
            label, said = 1, True
        elif tag in BOILER:
            label = 0
        attributes = m[3]
        node = page.add(top, tag, None, bool(attributes and HINT.search(attributes)), label)
        if tag in RAW:
            close = ENDS[tag].search(source, at)
            at = end = close.start() if close else size
            if close:
                stack.append(node)
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
    return page, said


@dataclass
class Forest:
    """Pages side by side: arrays over all nodes, with the nodes of each depth."""

    parent: np.ndarray
    levels: list[np.ndarray]
    leaf: np.ndarray
    x: np.ndarray
    label: np.ndarray
    first: np.ndarray


def forest(pages: list[Page]) -> Forest:
    sizes = np.array([len(p.parent) for p in pages])
    first = np.concatenate([[0], np.cumsum(sizes)])
    base = np.repeat(first[:-1], sizes)
    raw = np.array([v for p in pages for v in p.parent], np.int64)
    parent = np.where(raw < 0, -1, raw + base)
    depth = np.array([v for p in pages for v in p.depth], np.int64)
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []
    group = np.array([LEAF if t == TEXT else GROUP.get(t, OTHER) for p in pages for t in p.tag], np.int64)
    chars = np.zeros(len(parent))
    marks = np.zeros(len(parent))
    symbols = np.zeros(len(parent))
    final = np.zeros(len(parent))
    k = 0
    for p in pages:
        for t in p.text:
            if t is not None:
                chars[k] = len(t)
                marks[k] = t.count(".") + t.count(",")
                symbols[k] = t.count("|") + t.count("&")
                final[k] = t.rstrip()[-1] in ".!?"
            k += 1
    leaf = group == LEAF
    linked = np.where(leaf & (parent >= 0) & (group[np.maximum(parent, 0)] == GROUP["a"]), chars, 0.0)
    hint = np.array([v for p in pages for v in p.hint], float)
    total, links, points, odd = chars.copy(), linked.copy(), marks.copy(), symbols.copy()
    for nodes in levels[:0:-1]:
        for a in (total, links, points, odd):
            np.add.at(a, parent[nodes], a[nodes])
    for nodes in levels[1:]:
        hint[nodes] = np.maximum(hint[nodes], hint[parent[nodes]])
    some = np.maximum(total, 1)
    x = np.zeros((len(parent), FEATURES))
    x[np.arange(len(parent)), group] = 1
    up = np.where(parent >= 0, group[np.maximum(parent, 0)], OTHER)
    x[np.arange(len(parent)), LEAF + 1 + up] = 1
    rest = 2 * (LEAF + 1)
    place = (np.arange(len(parent)) - base) / np.maximum(np.repeat(sizes, sizes), 1)
    for c, v in enumerate((np.ones(len(parent)), np.log1p(total) / 5, links / some, np.minimum(points / some * 10, 2), np.minimum(odd / some * 10, 2), final, hint, place)):
        x[:, rest + c] = v
    return Forest(parent, levels, leaf.astype(np.int64), x, np.array([v for p in pages for v in p.label], np.int64), first)


def sum_product(f: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (node, state), and for each non-root node those of (parent's state, its state). Potentials are logarithms."""
    inward = unary.copy()
    sent = np.zeros_like(unary)
    kind = pair[f.leaf]
    for nodes in f.levels[:0:-1]:
        t = kind[nodes] + inward[nodes][:, None, :]
        sent[nodes] = np.logaddexp(t[:, :, 0], t[:, :, 1])
        np.add.at(inward, f.parent[nodes], sent[nodes])
    outward = np.zeros_like(unary)
    edges = np.zeros((len(unary), 2, 2))
    for nodes in f.levels[1:]:
        p = f.parent[nodes]
        t = kind[nodes] + (inward[p] + outward[p] - sent[nodes])[:, :, None]
        outward[nodes] = np.logaddexp(t[:, 0], t[:, 1])
        t = t + inward[nodes][:, None, :]
        t = np.exp(t - t.max(axis=(1, 2), keepdims=True))
        edges[nodes] = t / t.sum(axis=(1, 2), keepdims=True)
    belief = inward + outward
    belief = np.exp(belief - belief.max(axis=1, keepdims=True))
    return belief / belief.sum(axis=1, keepdims=True), edges


@dataclass
class Model:
    weights: np.ndarray
    pair: np.ndarray

    def marginals(self, f: Forest) -> np.ndarray:
        unary = np.zeros((len(f.parent), 2))
        unary[:, 1] = f.x @ self.weights
        return sum_product(f, unary, self.pair)[0][:, 1]


def train(f: Forest, steps: int = 150, rate: float = 0.1, l2: float = 1e-3) -> Model:
    """Adam on the mean log-likelihood of the labelled trees."""
    w, pair = np.zeros(FEATURES), np.zeros((2, 2, 2))
    child = f.parent >= 0
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (f.leaf[child], f.label[f.parent[child]], f.label[child]), 1)
    state = [np.zeros(FEATURES + 8), np.zeros(FEATURES + 8)]
    n = max(1, len(f.parent))
    for step in range(1, steps + 1):
        unary = np.zeros((len(f.parent), 2))
        unary[:, 1] = f.x @ w
        belief, edges = sum_product(f, unary, pair)
        hoped = np.stack([edges[child & (f.leaf == k)].sum(axis=0) for k in (0, 1)])
        g = np.concatenate([f.x.T @ (f.label - belief[:, 1]) / n - l2 * w, ((seen - hoped) / n - l2 * pair).ravel()])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        w, pair = w + move[:FEATURES], pair + move[FEATURES:].reshape(2, 2, 2)
    return Model(w, pair)


def fit(df: DataFrame, max_pages: int = 300) -> Model:
    """Train on at most max_pages pages that say what their content is: those with the least hash of their page_id."""
    pages = only(df, page_id="page_id", html="html")
    rows = pages.where(F.lower("html").rlike(r"<(article|main)[\s>]")).orderBy(F.xxhash64("page_id"), "page_id", F.xxhash64("html")).limit(max_pages).toArrow().to_pylist()
    pages = [p for p, ok in (parse(r["html"]) for r in rows) if ok]
    return train(forest(pages)) if pages else Model(np.zeros(FEATURES), np.zeros((2, 2, 2)))


def content(pages: list[Page], model: Model, threshold: float = 0.5) -> list[tuple[str, int, int]]:
    """Of each page its content (a line for each text leaf), and how many leaves it has and keeps."""
    f = forest(pages)
    keep = (model.marginals(f) >= threshold) & (f.leaf == 1)
    leaves = np.add.reduceat(f.leaf, f.first[:-1])
    out = []
    for k, p in enumerate(pages):
        mine = np.flatnonzero(keep[f.first[k] : f.first[k + 1]])
        lines = (" ".join(html.unescape(p.text[i]).split()) for i in mine)
        out.append(("\n".join(x for x in lines if x), int(leaves[k]), len(mine)))
    return out


def extract(df: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """One row for each row: page_id, url, content, text_nodes, content_nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sources = batch.column(2).to_pylist()
                found = iter(content([parse(s)[0] for s in sources if s is not None], model, threshold) if any(s is not None for s in sources) else [])
                text, nodes, kept = zip(*(next(found) if s is not None else (None, 0, 0) for s in sources))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(nodes, pa.int32()), pa.array(kept, pa.int32())], ["page_id", "url", "content", "text_nodes", "content_nodes"])

    return map_arrow(only(df, page_id="page_id", url="url", html="html").select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html"), run, SCHEMA)
