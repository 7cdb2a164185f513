"""Main text of web pages: boosted trees over DOM-node features, decoded as a hierarchy.

1. Training.  A bounded sample of pages (``TRAIN_PAGES`` distinct ones of at
   most ``TRAIN_CHARS`` characters, by smallest hash) that mark their article
   with ``article`` or ``main`` gives labelled blocks.  They are used as they
   are and in ``LAYOUTS`` drawn layouts each (``layouts``), in which the article
   has another place, other names and other neighbours, so that the model
   knows more than the given markup.  A node's label is whether main text is in
   it.  Spark ML fits gradient-boosted trees to the nodes.
2. Features of a node: its element, words of its attributes and of its
   ancestors', depth, place among its siblings and their sizes, and of its
   subtree the amount of text, text per node, link share, punctuation, place
   in the page and share of it.
3. Decoding.  A node can hold main text only if its parent does.  Among all
   choices that keep to this the most probable one is found from the leaves up:
   a node is either out with all that is in it, or in, and its children choose.
   No block is taken from what has been left out as a whole.

A block's white space becomes one space, blocks are joined in page order by two
line ends.  Every page is read whole.

Defined cases: a null or empty page, or one without text, gives the empty text;
repeated pages give equal texts; without a marked page in the sample, the
paragraphs of the sampled pages serve as articles; without any paragraph there is no
model and every page gives all its text; an empty table gives an empty table.
Only the named columns are used.
"""

from __future__ import annotations

import math
import re
import zlib
from random import Random

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefspark.llm.dom import Node, read_page
from prefspark.llm.layouts import ROLES, Layout
from prefspark.session import materialize

TRAIN_PAGES, TRAIN_CHARS, LAYOUTS = 300, 100_000, 5
OWN_WEIGHT = 10.0  # of a page as it is, against a drawn layout
TREES, DEPTH, STEP, SEED = 40, 5, 0.3, 7
PAGE_GROUP = 4_000_000  # characters of pages whose nodes are scored together

TAGS = ("h1", "h2", "h3", "p", "li", "ul", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form",
        "table", "td", "blockquote", "pre", "dl", "figure", "noscript", "body", "#text")
ALIKE = {"h4": "h3", "h5": "h3", "h6": "h3", "ol": "ul", "menu": "ul", "dir": "ul", "th": "td", "caption": "td", "tr": "table", "tbody": "table",
         "dt": "dl", "dd": "dl", "thead": "table", "tfoot": "table", "fieldset": "form", "search": "form", "dialog": "noscript", "html": "body",
         "#page": "body", "figcaption": "figure", "address": "footer"}
ROLE_NAMES = tuple(ROLES)
ROLE_OF_TAG = {"article": "content", "main": "content", "nav": "menu", "menu": "menu", "header": "header", "footer": "footer",
               "address": "footer", "aside": "side", "form": "form", "fieldset": "form", "search": "form", "dialog": "notice", "noscript": "notice"}
ROLE_OF_WORD = {w: k for k, role in enumerate(ROLE_NAMES) for w in ROLES[role]}
TAG_PLACE = {t: k for k, t in enumerate(TAGS)}
_MARKS = re.compile(r"[.,;:!?]")


def page_features(nodes: list[Node]) -> np.ndarray:
    """One row of features for every node of a page."""
    n = len(nodes)
    parent = np.array([x.parent for x in nodes])
    chars, words, links, marks, runs, longest, inside, heads, paras = np.zeros((9, n))
    runs_in_page = max(1, 1 + max((r[0] for x in nodes for r in x.runs), default=0))
    first, last = np.full(n, np.inf), np.full(n, -1.0)
    own_roles = np.zeros((n, len(ROLE_NAMES)), dtype=bool)
    h1 = None
    for i, x in enumerate(nodes):
        for at, text, linked in x.runs:
            chars[i] += len(text)
            words[i] += text.count(" ") + 1
            links[i] += linked
            marks[i] += len(_MARKS.findall(text))
            runs[i] += 1
            longest[i] = max(longest[i], len(text))
            first[i], last[i] = min(first[i], at), max(last[i], at)
        for w in x.tokens:
            if w in ROLE_OF_WORD:
                own_roles[i, ROLE_OF_WORD[w]] = True
        heads[i], paras[i] = x.tag in ("h1", "h2", "h3"), x.tag == "p"
        if x.tag == "h1" and h1 is None and x.runs:
            h1 = x.runs[0][0]
    inside += 1
    own_chars = chars.copy()
    for i in range(n - 1, 0, -1):  # a parent's number is smaller
        p = parent[i]
        chars[p] += chars[i]
        words[p] += words[i]
        links[p] += links[i]
        marks[p] += marks[i]
        runs[p] += runs[i]
        inside[p] += inside[i]
        heads[p] += heads[i]
        paras[p] += paras[i]
        if longest[i] > longest[p]:
            longest[p] = longest[i]
        if first[i] < first[p]:
            first[p] = first[i]
        if last[i] > last[p]:
            last[p] = last[i]
    roles = own_roles.copy()
    for i, x in enumerate(nodes):
        if x.tag in ROLE_OF_TAG:
            roles[i, ROLE_NAMES.index(ROLE_OF_TAG[x.tag])] = True
    above = np.zeros((n, len(ROLE_NAMES)))  # 1 / distance of the nearest ancestor of a role
    hidden = np.array([x.hidden for x in nodes])
    index, marked = np.zeros(n), np.zeros(n)  # marked: number of the nearest ``article`` or ``main`` in the page, 0 outside
    seen, articles = [0] * n, 0
    for i in range(1, n):
        p = parent[i]
        if nodes[i].tag in ("article", "main"):
            articles += 1
            marked[i] = articles
        else:
            marked[i] = marked[p]
        near = above[p] / (1 + above[p])
        near[roles[p]] = 1.0
        above[i] = near
        hidden[i] |= hidden[p]
        index[i] = seen[p]
        seen[p] += 1
    children = np.array([x.children for x in nodes], dtype=float)
    up = np.maximum(parent, 0)
    log_chars = np.log1p(chars)
    sib_sum, sib_max = np.bincount(up[1:], log_chars[1:], n), np.zeros(n)
    np.maximum.at(sib_max, up[1:], log_chars[1:])
    link_share = links / np.maximum(chars, 1)
    sib_links = np.bincount(up[1:], link_share[1:], n)
    count = np.maximum(np.bincount(up[1:], minlength=n), 1)
    tags = np.array([TAG_PLACE.get(ALIKE.get(x.tag, x.tag), len(TAGS)) for x in nodes])
    pair, where = np.unique(up * (len(TAGS) + 1) + tags, return_inverse=True)
    same = np.bincount(where, minlength=len(pair))[where]
    one_hot = np.zeros((n, len(TAGS)))
    known = tags < len(TAGS)
    one_hot[np.arange(n)[known], tags[known]] = 1
    first = np.where(np.isfinite(first), first, 0)
    total = max(chars[0], 1.0)
    after_h1 = (first - h1) / runs_in_page if h1 is not None else np.full(n, -2.0)
    columns = [
        np.array([x.depth for x in nodes], dtype=float), index, index / count[up], count[up], children, log_chars, np.log1p(words),
        np.log1p(own_chars), link_share, np.log1p(chars / inside), np.log1p(chars / np.maximum(runs, 1)), np.log1p(longest),
        marks / np.maximum(words, 1), chars / total, first / runs_in_page, last / runs_in_page, link_share[up], log_chars[up],
        chars / np.maximum(chars[up], 1), (sib_sum[up] - log_chars) / np.maximum(count[up] - 1, 1), sib_max[up],
        (sib_links[up] - link_share) / np.maximum(count[up] - 1, 1), same / count[up], same, np.log1p(heads), np.log1p(paras), np.log1p(inside), after_h1,
        np.sign(after_h1), np.full(n, math.log1p(n)), np.full(n, math.log1p(total)), hidden.astype(float), paras / inside,
        marked, np.full(n, float(articles))]
    return np.concatenate([np.stack(columns, axis=1), one_hot, own_roles, above], axis=1)


def labels(nodes: list[Node], marked: bool) -> np.ndarray:
    """Whether main text is in a node: by ``data-main``, or (``marked``) by the page's own ``article`` or ``main``."""
    n = len(nodes)
    y = np.zeros(n, dtype=bool)
    for i, x in enumerate(nodes):
        y[i] = (x.tag in ("article", "main") if marked else x.main) or (i > 0 and bool(y[x.parent]))
    has = np.array([bool(x.runs) for x in nodes]) & y
    for i in range(n - 1, 0, -1):
        has[nodes[i].parent] |= has[i]
    return has


def article_of(nodes: list[Node]) -> tuple[str, list[str], list[str]]:
    """(heading, paragraphs, other texts) of a page that marks its article; without a mark its ``p`` elements are the article."""
    marked = labels(nodes, True)
    if not marked.any():
        marked = np.array([x.tag in ("p", "h1") for x in nodes])
    runs = sorted((r[0], bool(marked[i]), x.tag, r[1]) for i, x in enumerate(nodes) for r in x.runs)
    heading = next((t for _, m, tag, t in runs if m and tag == "h1"), "")
    return heading, [t for _, m, tag, t in runs if m and tag != "h1"], [t for _, m, _, t in runs if not m]


def training_pages(pages: list[str], layouts: int = LAYOUTS) -> list[tuple[list[Node], np.ndarray, float]]:
    """Nodes, labels and weight of the given pages, as they are if they mark their article, and laid out anew."""
    read = [(zlib.crc32(p.encode()), read_page(p)) for p in pages]
    articles = [(seed, *article_of(nodes)) for seed, nodes in read]
    pool = [t for _, _, paragraphs, others in articles for t in paragraphs + others] or ["-"]
    out = [(nodes, labels(nodes, True), OWN_WEIGHT) for _, nodes in read if any(x.tag in ("article", "main") for x in nodes)]
    for seed, heading, paragraphs, _ in articles:
        for k in range(layouts if paragraphs else 0):
            rng = Random(seed * 31 + k)
            some = paragraphs[:rng.randint(1, 3)] if rng.random() < 0.25 else paragraphs  # short articles too
            nodes = read_page(Layout(rng, heading, some, pool).page())
            out.append((nodes, labels(nodes, False), 1.0))
    return out


def training_nodes(pages: DataFrame, html: str, sample: int = TRAIN_PAGES, chars: int = TRAIN_CHARS, layouts: int = LAYOUTS) -> DataFrame:
    """label, weight, features of the nodes of a sample of distinct pages; a repeated page counts once."""
    able = pages.select(F.col(html).cast("string").alias("html")).where((F.length("html") > 0) & (F.length("html") <= chars))
    able = able.withColumn("h", F.xxhash64("html"))
    chosen = F.broadcast(able.select("h").distinct().orderBy("h").limit(sample))  # at most ``sample`` hashes
    found = able.join(chosen, "h").groupBy("h").agg(F.first("html").alias("html"))
    # pages of one group share their texts; a group is a few pages
    group = F.pmod(F.col("h"), F.lit(max(1, sample // 50)))

    def build(table: pa.Table) -> pa.Table:
        made = training_pages(table.sort_by("h").column("html").to_pylist(), layouts)
        x = np.concatenate([page_features(nodes) for nodes, _, _ in made]) if made else np.zeros((0, 1))
        y = np.concatenate([label for _, label, _ in made]) if made else np.zeros(0)
        w = np.concatenate([np.full(len(label), w) for _, label, w in made]) if made else np.zeros(0)
        ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
        return pa.table([pa.array(y.astype(float)), pa.array(w), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))],
                        names=["label", "weight", "features"])

    return found.withColumn("g", group).groupBy("g").applyInArrow(build, "label double, weight double, features array<double>")


class Forest:
    """Boosted trees as arrays: a node is (feature, threshold, left, right) or a leaf's value."""

    def __init__(self, trees: list[str], weights: list[float]):
        parts = [parse_tree(t) for t in trees]
        self.roots, self.weights = np.cumsum([0, *[len(p) for p in parts]])[:-1], np.array(weights)
        rows = [(f, t, left + base, right + base, v) for p, base in zip(parts, self.roots) for f, t, left, right, v in p]
        self.feature = np.array([r[0] for r in rows], dtype=np.int64)
        self.threshold, self.value = (np.array([r[k] for r in rows]) for k in (1, 4))
        self.left, self.right = (np.array([r[k] for r in rows], dtype=np.int64) for k in (2, 3))

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin, rows = np.zeros(len(x)), np.arange(len(x))
        for root, weight in zip(self.roots, self.weights):
            at = np.full(len(x), root)
            while True:
                inner = self.feature[at] >= 0
                if not inner.any():
                    break
                step = np.where(x[rows, np.maximum(self.feature[at], 0)] <= self.threshold[at], self.left[at], self.right[at])
                at = np.where(inner, step, at)
            margin += weight * self.value[at]
        return 1 / (1 + np.exp(-2 * margin))


_RULE = re.compile(r"^ *(?:(If|Else) \(feature (\d+) (?:<=|>) (\S+)\)|Predict: (\S+))$")


def parse_tree(text: str) -> list[tuple[int, float, int, int, float]]:
    """(feature or -1, threshold, left, right, value) of each node, the root first, from Spark's description of a tree."""
    rules = [m for m in map(_RULE.match, text.splitlines()) if m]
    out: list[tuple[int, float, int, int, float]] = []
    waiting: list[int] = []  # nodes whose right side comes next
    for m in rules:
        if m[1] == "If":
            waiting.append(len(out))
            out.append((int(m[2]), float(m[3]), len(out) + 1, -1, 0.0))
        elif m[1] == "Else":
            i = waiting.pop()
            out[i] = (*out[i][:3], len(out), 0.0)
        else:
            out.append((-1, 0.0, 0, 0, float(m[4])))
    return out


def fit(pages: DataFrame, html: str = "html", **sample) -> Forest | None:
    """The model, or None if the pages have nothing to learn from."""
    nodes = materialize(training_nodes(pages, html, **sample), "training-nodes")
    if nodes.select("label").distinct().count() < 2:
        return None
    data = nodes.select("label", "weight", array_to_vector("features").alias("features"))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=64, minInstancesPerNode=5, seed=SEED,
                          weightCol="weight").fit(data)
    return Forest([t.toDebugString for t in model.trees], list(model.treeWeights))


def decode(parent: list[int], probability: np.ndarray) -> np.ndarray:
    """The most probable choice of nodes in which a node's parent is chosen with it."""
    p = np.clip(probability, 1e-6, 1 - 1e-6)
    out, inside = np.log1p(-p), np.log(p)  # of the node with all below it left out; of the node taken, children as they are best
    for i in range(len(p) - 1, 0, -1):
        at = parent[i]
        inside[at] += max(out[i], inside[i])
        out[at] += out[i]
    chosen = np.zeros(len(p), dtype=bool)
    for i in range(len(p)):
        chosen[i] = inside[i] > out[i] and (i == 0 or chosen[parent[i]])
    return chosen


def main_text(nodes: list[Node], chosen: np.ndarray) -> str:
    runs = sorted((at, text) for x, c in zip(nodes, chosen) if c for at, text, _ in x.runs)
    return "\n\n".join(text for _, text in runs)


def texts_of(pages: list[str | None], forest: Forest | None) -> list[str]:
    read = [read_page(p) for p in pages]
    if forest is None:
        return [main_text(nodes, np.ones(len(nodes), dtype=bool)) for nodes in read]
    scores = forest.probability(np.concatenate([page_features(nodes) for nodes in read]))
    out, at = [], 0
    for nodes in read:
        out.append(main_text(nodes, decode([x.parent for x in nodes], scores[at:at + len(nodes)])))
        at += len(nodes)
    return out


def extract(pages: DataFrame, forest: Forest | None, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with ``out`` (main text) and ``n_chars`` (its code points) in place of ``html``."""
    kept = [c for c in pages.columns if c.lower() not in (html.lower(), out.lower(), "n_chars")]
    schema = T.StructType([*[pages.schema[c] for c in kept], T.StructField(out, T.StringType()), T.StructField("n_chars", T.LongType())])
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(html).cast("string").alias("__html"))

    def read(batches):
        for b in batches:
            at, sizes = 0, b.column(b.num_columns - 1).fill_null("")
            sizes = pa.compute.utf8_length(sizes).to_pylist()
            while at < b.num_rows:
                upto, chars = at, 0
                while upto < b.num_rows and (upto == at or chars + sizes[upto] <= PAGE_GROUP):
                    chars += sizes[upto]
                    upto += 1
                part = b.slice(at, upto - at)
                texts = texts_of(part.column(b.num_columns - 1).to_pylist(), forest)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 names=schema.fieldNames())
                at = upto

    return rows.mapInArrow(read, schema)


def main_texts(pages: DataFrame, html: str = "html") -> DataFrame:
    """The model learnt from ``pages``, applied to all of them."""
    return extract(pages, fit(pages, html), html)
