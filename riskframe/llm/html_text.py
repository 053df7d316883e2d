"""Main text of web pages: boosted trees score DOM nodes, a tree decoding keeps whole branches."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import written

#: Bounds of the training sample: pages, and nodes of one page.
SAMPLE_PAGES = 400
SAMPLE_NODES = 300
TREES, DEPTH, STEP = 20, 4, 0.2

# Elements without content or end tag, elements that never show text, elements
# inside a line of text, and the names that pages give to what surrounds an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style noscript template svg math iframe object canvas title textarea select option button".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
AROUND_TAGS = frozenset("nav footer aside form dialog menu".split())
ARTICLE_TAGS = frozenset("article main".split())
AROUND_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent "
    "disclaimer discussion footer form header login masthead menu modal nav navbar navigation newsletter notice notices "
    "notification overlay popup promo promoted recommended related replies reply search share sharing sidebar signup skip "
    "social sponsor sponsored subscribe subscription toolbar widget".split()
)
ARTICLE_WORDS = frozenset("article body content entry main post story text".split())
#: Opening one of these closes an open element of the same group.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: What may stand in a head; any other element ends an open one.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: A block inside a paragraph ends it.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
TAG_KINDS = ("p", "div", "section", "article", "main", "li", "ul", "td", "table", "h1", "h2", "h3", "blockquote", "pre", "body", "header")


@dataclass
class Node:
    """A block element: its own text (lines inside it included) and its place in the page."""

    tag: str
    parent: int
    depth: int
    order: int
    words: frozenset[str]
    hidden: bool
    around: bool  # its own names say so; read_page settles it for the branch
    article: bool
    children: list[int] = field(default_factory=list)
    links: int = 0


class _Reader(HTMLParser):
    """Page to block nodes and pieces of text ``(node, text)`` in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("body", -1, 0, 0, frozenset(), False, False, False)]
        self.pieces: list[tuple[int, str]] = []
        self.open: list[tuple[str, int]] = [("", 0)]
        self.in_link = 0
        self.in_hidden = 0

    def handle_starttag(self, tag, attrs):
        # inside a title, template or script the head goes on
        if self.open[-1][0] == "head" and tag not in IN_HEAD and tag not in ("html", "head"):
            self._close({"head"})
        elif tag == "body":
            self._close({"head"})
        if tag in VOID:
            if tag in ("br", "hr"):
                self.pieces.append((self.open[-1][1], " "))
            return
        closing = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_PARAGRAPH else set())
        if closing:
            self._close(closing, stop={"table", "ul", "ol", "dl", "div", "section", "article", "body"} - closing)
        at = self.open[-1][1]
        if tag in INLINE:
            self.in_link += tag == "a"
        elif tag not in ("html", "body"):
            words = frozenset(w for k, v in attrs if k in ("class", "id", "role", "aria-label") and v for w in re.split(r"[^a-z0-9]+", v.lower()) if w)
            above = self.nodes[at]
            hidden = above.hidden or tag in HIDDEN or any(k == "hidden" or k == "style" and v and re.search(r"display\s*:\s*none", v) for k, v in attrs)
            article = above.article or tag in ARTICLE_TAGS
            # names of both kinds ("entry-header", "content has-sidebar") and headers of an article say nothing
            said = words & AROUND_WORDS - ({"header"} if above.article else set())
            around = tag in AROUND_TAGS or bool(said) and not words & ARTICLE_WORDS or tag == "header" and not above.article
            self.nodes.append(Node(tag, at, above.depth + 1, len(above.children), words, hidden, around, article))
            above.children.append(len(self.nodes) - 1)
            at = len(self.nodes) - 1
        elif tag == "body":
            return
        self.open.append((tag, at))
        if tag in HIDDEN:
            self.in_hidden += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _pop(self):
        tag, _ = self.open.pop()
        self.in_link -= tag == "a"
        self.in_hidden -= tag in HIDDEN

    def _close(self, tags, stop=frozenset()):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] in tags:
                while len(self.open) > i:
                    self._pop()
                return
            if self.open[i][0] in stop:
                return

    def handle_endtag(self, tag):
        if tag in VOID or tag in ("body", "html"):
            return
        block = tag not in INLINE
        self._close({tag}, stop=frozenset() if block else ENDS_PARAGRAPH)

    def handle_data(self, data):
        if self.open[-1][0] == "head" and data.strip():
            self._close({"head"})
        if self.in_hidden:
            return
        at = self.open[-1][1]
        self.pieces.append((at, data))
        if self.in_link:
            self.nodes[at].links += len(data)


def read_page(html: str | None) -> tuple[list[Node], list[str], list[tuple[int, int, str]]]:
    """Nodes, the own text of each, and blocks ``(node, number, text)`` in page order.

    A block is a stretch of one node's text between the texts of other nodes.
    """
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    blocks: list[tuple[int, list[str]]] = []
    for node, text in reader.pieces:
        if blocks and blocks[-1][0] == node:
            blocks[-1][1].append(text)
        else:
            blocks.append((node, [text]))
    own: list[list[str]] = [[] for _ in reader.nodes]
    out = []
    for node, parts in blocks:
        text = " ".join("".join(parts).split())
        if text:
            out.append((node, len(out), text))
            own[node].append(text)
    texts = [" ".join(x) for x in own]
    _settle_surroundings(reader.nodes, texts)
    return reader.nodes, texts, out


def _settle_surroundings(nodes: list[Node], own: list[str]) -> None:
    """Named branches are surroundings, but for those that hold most of what the page is about.

    That is more than half of the text in article elements, or of all text if none is there.
    """
    all_chars = [0 if x.hidden else len(t) for x, t in zip(nodes, own)]
    article_chars = [n if x.article else 0 for x, n in zip(nodes, all_chars)]
    held = article_chars if any(article_chars) else all_chars
    for i in range(len(nodes) - 1, 0, -1):
        held[nodes[i].parent] += held[i]
    for x, n in zip(nodes[1:], held[1:]):
        x.around = nodes[x.parent].around or x.around and 2 * n <= held[0]


def node_features(nodes: list[Node], own: list[str]) -> np.ndarray:
    """Of each node: subtree sizes and densities, attribute words, depth and its siblings."""
    n = len(nodes)
    chars = np.array([len(t) for t in own], dtype=float)
    links = np.minimum(np.array([x.links for x in nodes], dtype=float), chars)
    stops = np.array([sum(t.count(c) for c in ".,;:!?") for t in own], dtype=float)
    below = np.ones(n)
    all_chars, all_links, all_stops = chars.copy(), links.copy(), stops.copy()
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        below[p] += below[i]
        all_chars[p] += all_chars[i]
        all_links[p] += all_links[i]
        all_stops[p] += all_stops[i]
    begin = np.cumsum(chars) - chars
    total = max(1.0, chars.sum())
    rows = []
    for i, x in enumerate(nodes):
        p = max(x.parent, 0)
        siblings = max(1, len(nodes[p].children)) if x.parent >= 0 else 1
        rows.append(
            [
                math.log1p(chars[i]),
                math.log1p(all_chars[i]),
                all_links[i] / max(1.0, all_chars[i]),
                all_stops[i] / max(1.0, all_chars[i]),
                all_chars[i] / below[i],
                all_chars[i] / total,
                begin[i] / total,
                x.depth,
                x.order / siblings,
                siblings,
                all_chars[i] / max(1.0, all_chars[p]),
                all_links[p] / max(1.0, all_chars[p]),
                below[i],
                float(bool(x.words & ARTICLE_WORDS)),
                float(bool(x.words & AROUND_WORDS) and not x.words & ARTICLE_WORDS),
                float(x.article),
                float(x.around),
                *(float(x.tag == t) for t in TAG_KINDS),
            ]
        )
    return np.array(rows)


N_PLAIN = 13  # features that do not depend on names of elements and attributes


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes whose role their page states: 1 in an article, 0 around one; each also without its names."""
    for batch in batches:
        rows, labels = [], []
        for html in batch.column(0).to_pylist():
            nodes, own, _ = read_page(html)
            features = node_features(nodes, own)
            seen = 0
            for x, f in zip(nodes, features.tolist()):
                if x.hidden or not (x.article or x.around) or seen >= SAMPLE_NODES:
                    continue
                seen += 1
                label = float(not x.around)
                rows += [f, f[:N_PLAIN] + [0.0] * (len(f) - N_PLAIN)]
                labels += [label, label]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.float64())], ["x", "label"])


@dataclass
class Trees:
    """Boosted regression trees as lists of nodes ``(feature, threshold, left, right, value)``."""

    trees: list[list[tuple[int, float, int, int, float]]]
    weights: list[float]

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds that a node belongs to the article."""
        total = np.zeros(len(x))
        for tree, weight in zip(self.trees, self.weights):
            feature, threshold, left, right, value = (np.array(c) for c in zip(*tree))
            at = np.zeros(len(x), dtype=np.int64)
            while (feature[at] >= 0).any():
                inner = feature[at] >= 0
                goes_left = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
            total += weight * value[at]
        return 2 * total


def _flatten(node, out: list) -> int:
    at = len(out)
    out.append(None)
    if node.subtreeDepth() == 0:
        out[at] = (-1, 0.0, at, at, float(node.prediction()))
    else:
        split = node.split()
        left, right = _flatten(node.leftChild(), out), _flatten(node.rightChild(), out)
        out[at] = (int(split.featureIndex()), float(split.threshold()), left, right, 0.0)
    return at


def train(pages: DataFrame, html: str = "html") -> Trees | None:
    """Trees from a bounded sample of the pages (those of least hash); None if it states one role only.

    Pages label themselves: what stands in an article element is text, what stands in
    navigation, footers, forms or elements named like adverts, notices or comments is not,
    unless that branch holds most of the page's article.
    Every node counts a second time without its names, so that pages that name nothing are
    judged by their shape.
    """
    ship_package(pages.sparkSession)
    content = F.coalesce(F.col(html), F.lit(""))
    ranked = pages.select(content.alias("html"), F.xxhash64(content).alias("h")).filter("html != ''")
    chosen = ranked.orderBy("h").limit(SAMPLE_PAGES).select("html")
    rows = written(chosen.mapInArrow(_training, "x array<double>, label double"), "html-sample")
    if rows.select("label").distinct().count() < 2:
        return None
    fitted = GBTClassifier(featuresCol="v", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=1).fit(
        rows.coalesce(2).select(array_to_vector("x").alias("v"), "label")
    )
    trees = []
    for tree in fitted.trees:
        flat: list = []
        _flatten(tree._java_obj.rootNode(), flat)
        trees.append(flat)
    return Trees(trees, list(fitted.treeWeights))


def decode(nodes: list[Node], own: list[str], margin: np.ndarray) -> list[bool]:
    """The consistent choice of most weight: a node's text can stay only if all its ancestors stay.

    A branch either goes as a whole (0) or stays with its own weight and the best of its
    branches. Hidden nodes and what a page names as surroundings always go; the page itself
    always stays.
    """
    weight = [m * math.log1p(len(t)) for m, t in zip(margin.tolist(), own)]
    best = list(weight)
    for i in range(len(nodes) - 1, 0, -1):
        if nodes[i].hidden or nodes[i].around:
            best[i] = 0.0
        best[nodes[i].parent] += max(0.0, best[i])
    keep = [True] * len(nodes)
    for i in range(1, len(nodes)):
        keep[i] = keep[nodes[i].parent] and best[i] > 0 and not (nodes[i].hidden or nodes[i].around)
    # text of the page itself, outside all its elements, stands alone
    keep[0] = weight[0] > 0
    return keep


def page_texts(pages: list[str | None], trees: Trees | None) -> list[str]:
    parsed = [read_page(p) for p in pages]
    if not parsed:
        return []
    features = [node_features(nodes, own) for nodes, own, _ in parsed]
    if trees is None:
        margins = np.ones(sum(map(len, features)))
    else:
        margins = trees.margin(np.concatenate(features))
    out, at = [], 0
    for (nodes, own, blocks), f in zip(parsed, features):
        keep = decode(nodes, own, margins[at : at + len(f)])
        at += len(f)
        out.append(" ".join(text for node, _, text in blocks if keep[node]))
    return out


def extract(pages: DataFrame, trees: Trees | None, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` (main text, empty if none) and ``n_chars`` (its code points).

    Character references are decoded, white space inside a block becomes one space, blocks
    are joined in page order by one space. A null page counts as empty; repeated rows get
    equal texts; an empty table gives an empty one; columns named like the results are
    replaced. Without trees every part that the page does not name as surroundings stays.
    """
    ship_package(pages.sparkSession)
    kept = pages.drop("text", "n_chars") if html not in ("text", "n_chars") else pages
    content = kept.withColumn("__html", F.col(html))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 100):
                part = batch.slice(begin, 100)
                texts = page_texts(part.column("__html").to_pylist(), trees)
                yield part.drop_columns(["__html"]).append_column("text", pa.array(texts, pa.string()))

    schema = content.drop("__html").schema.add("text", "string")
    return content.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))
