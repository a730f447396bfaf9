"""Main text of web pages by gradient-boosted trees over DOM-node features.

The trees say of a node whether main text lies in or below it. They are trained on a bounded sample
of pages. Pages carry no such labels, so the sample's own landmarks give them (what is in an
article element, what is in navigation, footers and the like), and each sampled page is also laid
out anew in several ways, with other elements and names, and with sidebars, notices, adverts,
forms and reader comments made of the sample's sentences, so that the trees learn to do without
landmarks. Decoding is hierarchical: a node counts as main only if all above it do, and the set
of nodes with the largest sum of log odds under that rule is chosen.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import dom
from tidemark.llm.common import bounded_ids, materialize, slices, table

#: Bounds on training: pages sampled (whole ones, of any length), layouts made of each, nodes of each
#: page and layout that are learnt from (drawn from all over it).
MAX_PAGES, LAYOUTS, MAX_NODES = 240, 6, 400
TREES, DEPTH = 20, 5
#: Log odds that leaving a node out of the main text costs if the node above it is in.
CUT = 2.0


@dataclass(frozen=True)
class Trees:
    """Boosted trees as arrays: feature (-1: a leaf), threshold, left and right child, value; and roots."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for root in self.roots:
            at = np.full(len(rows), root)
            for _ in range(DEPTH + 1):
                f = self.feature[at]
                go = rows[every, np.maximum(f, 0)] <= self.threshold[at]
                at = np.where(f < 0, at, np.where(go, self.left[at], self.right[at]))
            total += self.value[at]
        return 2.0 * total


_LINE = re.compile(r"^( *)(If|Else|Predict:|Tree)\s*(?:\(feature (\d+) (?:<=|>|in|not in) ([^)]*)\)|([-\dEe.]+))?")


def read_trees(text: str, weights: list[float]) -> Trees:
    """The trees of a model's debug string; all splits are on continuous features."""
    rows: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    stack: list[tuple[int, int]] = []  # indent, node whose branch comes next

    def add(row: list[float]) -> int:
        rows.append(row)
        if not stack:
            roots.append(len(rows) - 1)
        else:
            parent = stack[-1][1]
            rows[parent][2 if rows[parent][2] < 0 else 3] = len(rows) - 1
        return len(rows) - 1

    for line in text.splitlines():
        found = _LINE.match(line)
        if not found:
            continue
        indent, what = len(found[1]), found[2]
        if what == "Tree":
            stack.clear()
        elif what == "If":
            while stack and stack[-1][0] >= indent:
                stack.pop()
            node = add([int(found[3]), float(found[4]), -1, -1, 0.0])
            stack.append((indent, node))
        elif what == "Else":
            while stack[-1][0] > indent:
                stack.pop()
        else:
            while stack and stack[-1][0] >= indent:
                stack.pop()
            add([-1, 0.0, -1, -1, float(found[5])])
    array = np.array(rows)
    value = array[:, 4].copy()
    for k, root in enumerate(roots):
        value[root : roots[k + 1] if k + 1 < len(roots) else len(rows)] *= weights[k]
    whole = array[:, :4].astype(np.int64)
    return Trees(whole[:, 0], array[:, 1], whole[:, 2], whole[:, 3], value, np.array(roots))


# Training pages.


def _truth_of_landmarks(nodes: list[dom.Node]) -> bool:
    """Mark what lies in landmarks; False if the page has no article to learn from."""
    found = False
    for node in nodes:
        kind = dom.TAG_KINDS.get(node.tag, 17)
        if kind == 0:
            node.truth, found = True, True
        elif kind in (1, 2, 3, 4, 5) or node.kinds and not node.kinds & 1:
            node.truth = False
    return found


def _labels(nodes: list[dom.Node]) -> list[float]:
    """1 for nodes with main text in or below them: runs take the nearest mark above, others follow their runs."""
    main: dict[int, bool] = {}
    inherited: dict[int, bool] = {}
    for node in nodes:
        inherited[id(node)] = node.truth if node.truth is not None else (inherited[id(node.parent)] if node.parent else False)
    for node in reversed(nodes):
        if node.text and inherited[id(node)]:
            main[id(node)] = True
        if main.get(id(node)) and node.parent is not None:
            main[id(node.parent)] = True
    return [float(main.get(id(n), False)) for n in nodes]


#: Names that made-up pages give their regions; "" and neutral words leave the trees to other features.
_NAMES = {
    "main": ["content", "post", "entry-content", "story", "article-body", "main", "text", "", "", "c1", "wrap", "box"],
    "menu": ["nav", "menu", "navbar", "breadcrumb", "main-navigation", "tabs", "", "links"],
    "head": ["header", "masthead", "top", "site-head", "banner", "", "bar"],
    "foot": ["footer", "copyright", "bottom", "legal", "site-footer", "", "end"],
    "side": ["sidebar", "side", "widget", "related", "rail", "popular", "", "col2"],
    "notice": ["notice", "cookie-notice", "consent", "alert", "gdpr", "message", "popup"],
    "ad": ["ad", "ads", "advert", "sponsored", "promo", "ad-slot", "adsense"],
    "form": ["form", "newsletter", "subscribe", "search", "login", "signup"],
    "talk": ["comments", "comment-list", "discussion", "replies", "respond", "reader-comments"],
    "share": ["share", "social", "tags", "byline", "meta", "follow"],
}
_TAGS = {
    "main": ["article", "main", "div", "div", "div", "section"], "menu": ["nav", "div", "ul", "div"], "head": ["header", "div"],
    "foot": ["footer", "div", "div"], "side": ["aside", "div", "div"], "notice": ["div", "section", "aside"], "ad": ["div", "aside", "section"],
    "form": ["form", "div", "form"], "talk": ["section", "div", "div"], "share": ["div", "ul", "p"],
}


def _laid_out(title: str, paragraphs: list[str], links: list[str], asides: list[str], rng: random.Random) -> str:
    """A page of these texts in a made-up layout; marks in data-truth say what is main."""
    some = lambda k: [rng.choice(asides) for _ in range(k)]
    anchors = lambda k: "".join(f"<li><a href='/{i}'>{rng.choice(links)}</a></li>" for i in range(k))

    def region(kind: str, inner: str, main: bool = False) -> str:
        tag, name = rng.choice(_TAGS[kind]), rng.choice(_NAMES[kind])
        if kind in ("notice", "ad", "talk", "form") and not name:
            name = kind
        attribute = f' {rng.choice(["class", "class", "id"])}="{name}"' if name and (tag in ("div", "ul", "p", "section") or rng.random() < 0.4) else ""
        return f'<{tag}{attribute} data-truth="{int(main)}">{inner}</{tag}>'

    def paragraph(text: str) -> str:
        words = text.split(" ")
        if len(words) > 8 and rng.random() < 0.25:
            k = rng.randrange(len(words) - 3)
            words[k : k + 2] = [f"<a href='#'>{' '.join(words[k : k + 2])}</a>"]
        text = " ".join(words)
        style = rng.random()
        if style < 0.7:
            return f"<p>{text}</p>"
        if style < 0.8:
            return f"<div>{text}</div>"
        if style < 0.87:
            return f"<blockquote><p>{text}</p></blockquote>"
        if style < 0.94:
            half = len(words) // 2
            return f"<ul><li>{' '.join(words[:half])}</li><li>{' '.join(words[half:])}</li></ul>"
        return f"<h2>{' '.join(words[:5])}</h2><p>{text}</p>"

    made = {
        "menu": lambda: region("menu", f"<ul>{anchors(rng.randrange(3, 9))}</ul>"),
        "head": lambda: region("head", f"<div class='logo'><a href='/'>{rng.choice(links)}</a></div><p>{rng.choice(asides)[:60]}</p>"),
        "foot": lambda: region("foot", f"<p>&copy; 2024 {rng.choice(asides)}</p><ul>{anchors(rng.randrange(4))}</ul>"),
        "side": lambda: region("side", f"<h3>{rng.choice(links)}</h3><ul>{anchors(rng.randrange(2, 7))}</ul><p>{rng.choice(asides)}</p>"),
        "notice": lambda: region("notice", "".join(f"<p>{t}</p>" for t in some(rng.randrange(1, 3))) + "<a href='#'>OK</a>"),
        "ad": lambda: region("ad", rng.choice(["{}", "<p>{}</p>", "<a href='/x'>{}</a>"]).format(" ".join(some(rng.randrange(1, 3))))),
        "form": lambda: region("form", f"<label>{rng.choice(links)}</label><input name=q><p>{rng.choice(asides)[:80]}</p><button>Go</button>"),
        "talk": lambda: region("talk", f"<h3>{rng.choice(links)}</h3>" + "".join(f"<div class='{rng.choice(['comment', 'reply', 'c', 'item'])}'><b>{rng.choice(links)}</b><p>{t}</p></div>" for t in some(rng.randrange(1, 6)))),
        "share": lambda: region("share", f"{rng.choice(links)} <a href='/u'>{rng.choice(links)}</a> {rng.choice(asides)[:30]}"),
    }
    body = [paragraph(t) for t in paragraphs]
    for kind, p in (("ad", 0.4), ("share", 0.25), ("side", 0.15), ("notice", 0.1)):
        if rng.random() < p:
            body.insert(rng.randrange(len(body) + 1), made[kind]())
    heading = f"<{(h := rng.choice(['h1', 'h1', 'h2']))}>{title}</{h}>"
    main = region("main", heading + "".join(body), True)
    before = [made[k]() for k in ("notice", "head", "menu", "ad", "form", "side") if rng.random() < 0.5]
    after = [made[k]() for k in ("share", "talk", "side", "form", "ad", "notice", "menu") if rng.random() < 0.4] + [made["foot"]()] * (rng.random() < 0.85)
    whole = "".join(before) + main + "".join(after)
    for name in rng.sample(["wrapper", "page", "container", "site", "layout", ""], rng.randrange(3)):
        whole = f'<div class="{name}">{whole}</div>'
    return f"<html><head><title>{title}</title></head><body>{whole}</body></html>"


def _training_rows(page: str, seed: int) -> list[tuple[list[float], float]]:
    rng = random.Random(seed)
    nodes = dom.parse(page)
    if not _truth_of_landmarks(nodes):
        return []
    pages = [nodes]
    labels = _labels(nodes)
    runs = [(n, y) for n, y in zip(nodes, labels, strict=True) if n.text]
    escape = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
    own = [escape(n.text) for n, y in runs if y]
    links = [escape(n.text)[:40] for n, y in runs if not y and n.links > 0.8 * n.chars] or ["Home", "News", "About"]
    asides = [escape(n.text) for n, y in runs if not y and n.links <= 0.8 * n.chars]
    for _ in range(LAYOUTS if own else 0):
        k = rng.randrange(1, 9)
        chosen = own[1 : 1 + k] or own
        lent = [" ".join(t.split(" ")[: rng.randrange(4, 60)]) for t in rng.sample(own, min(len(own), 4))]
        made = dom.parse(_laid_out(own[0][:120], chosen, links, asides + lent, rng), marked=True)
        pages.append(made)
    rows = []
    for nodes in pages:
        own = [(row, y) for row, y in zip(dom.features(nodes), _labels(nodes), strict=True) if row]
        rows += own if len(own) <= MAX_NODES else rng.sample(own, MAX_NODES)
    return rows


def fit_trees(pages: DataFrame, max_pages: int = MAX_PAGES) -> Trees | None:
    """Trained trees; None if no sampled page has landmarks to learn from."""
    ids = bounded_ids(pages, "page_id", max_pages)
    if not ids:
        return None
    wanted = pages.sparkSession.createDataFrame([(i,) for i in ids], "page_id long")
    # Wanted ids are max_pages at most.
    sample = (
        pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
        .where(F.length("html") > 0)
        .join(F.broadcast(wanted), "page_id")
        .groupBy("page_id").agg(F.min("html").alias("html"))
    )

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, page in zip(batch["page_id"], batch["html"], strict=True):
                rows = [(int(i), k, row, y) for k, (row, y) in enumerate(_training_rows(page, int(i)))]
                yield pd.DataFrame(rows, columns=["page_id", "k", "row", "label"])

    gathered = materialize(sample.mapInPandas(rows_of, "page_id long, k long, row array<double>, label double"), "nodes")
    if gathered.select("label").distinct().count() < 2:
        return None
    train = gathered.repartition(4, "page_id").sortWithinPartitions("page_id", "k").select(array_to_vector("row").alias("features"), "label")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.25, minInstancesPerNode=8, seed=7).fit(train)
    return read_trees(model.toDebugString, list(model.treeWeights))


# Extraction.


def decode(nodes: list[dom.Node], odds: np.ndarray) -> list[str]:
    """Runs of the best set of nodes that has with each node all those above it; parting a child costs CUT."""
    best: dict[int, float] = {}
    for node, own in zip(reversed(nodes), odds[::-1], strict=True):
        weight = 1.0 + np.log1p(node.chars) / 4 if node.text else 1.0
        best[id(node)] = own * weight + sum(max(-CUT, best[id(c)]) for c in node.children)
    chosen: set[int] = set()
    for node in nodes:
        if best[id(node)] > 0 if node.parent is None else (best[id(node)] > -CUT and id(node.parent) in chosen):
            chosen.add(id(node))
    return [n.text for n in nodes if n.text and id(n) in chosen]


def _landmark_odds(nodes: list[dom.Node]) -> np.ndarray:
    """Without trees: landmarks alone, in their absence all but what other landmarks and names rule out."""
    marked = _truth_of_landmarks(nodes)
    if not marked:
        nodes[0].truth = True
    return np.array([1.0 if y else -1.0 for y in _labels(nodes)])


def main_texts(pages: list[str | None], trees: Trees | None) -> list[str]:
    parsed = [dom.parse(p or "") for p in pages]
    if trees is None:
        odds = [_landmark_odds(nodes) for nodes in parsed]
    else:
        rows = [dom.features(nodes) for nodes in parsed]
        flat = [row for page in rows for row in page if row]
        scored = trees.log_odds(np.array(flat)) if flat else np.zeros(0)
        odds, at = [], 0
        for page in rows:
            has = np.array([bool(row) for row in page])
            own = np.full(len(page), -1e3)
            own[has] = scored[at : at + has.sum()]
            at += int(has.sum())
            odds.append(own)
    return ["\n\n".join(decode(nodes, own)) for nodes, own in zip(parsed, odds, strict=True)]


def extract(pages: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars``.

    * Null or empty html, or a page without main text: the empty text.
    * Character references are decoded, white space in a block becomes one space, blocks are joined
      in page order by two line feeds. Scripts, styles, markup and form controls never give text.
    * A page of any length and depth is read as a whole. Several training pages of one page_id: the smallest counts.
    * If no sampled page has landmarks to train on, landmarks and names alone decide.
    * One row per row, repeated ones too; nulls in page_id and url stay. Other columns are not read.
    """
    trees = fit_trees(pages, max_pages)

    @F.pandas_udf("string")
    def text_of(html: pd.Series) -> pd.Series:
        out = []
        for part in slices(html):
            out += main_texts(html.iloc[part].tolist(), trees)
        return pd.Series(out, dtype=object)

    return pages.select("page_id", "url", text_of(F.col("html").cast("string")).alias("text")).withColumn(
        "n_chars", F.char_length("text").cast("long")
    )


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
