"""Main text of web pages: boosted trees over DOM nodes, decoded down the tree.

A page becomes a small tree of block elements; inline elements belong to the block around them. Every block gets numbers about
its subtree (text, link, tag and punctuation density), its attribute tokens, its depth, its place among its siblings, and the same
for what stands above it. Gradient-boosted trees, trained by Spark on a bounded sample, give the odds that a block is main text.
Decoding picks the best set of blocks in which nothing is kept under a dropped ancestor: a block's value is either nothing, with
its whole subtree dropped, or its own odds plus the best values of its children.

Labels are not given. The sample's own markup supplies them (what an article or main element holds, less what is marked as
something else inside it). So that the model does not merely read those tags, sampled pages are also
rewritten: with neutral elements and usual class names, and with sidebars, notices, forms, comments and headers put in.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutwise.llm.common import slices, stored

SAMPLE_PAGES = 150  # pages that the model is trained on; each is used as it is and in five rewritten forms
FORMS = 6
TREES, DEPTH = 15, 4

# Element kinds of the format.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style head title noscript template svg iframe object select textarea math".split())
RAW = frozenset("script style title textarea noscript iframe".split())
INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIMITS = frozenset("ul ol dl table body html article section div main".split())
#: Names that pages usually give to their parts.
MAIN_NAMES = frozenset("article articlebody body content entry main post story text".split())
OTHER_NAMES = frozenset(
    "ad ads advert advertisement aside author banner bar breadcrumb breadcrumbs byline comment comments consent cookie copyright disqus footer form "
    "header masthead menu meta nav navbar navigation newsletter notice pagination popup promo related replies reply respond search share sharing sidebar "
    "social sponsor sponsored subscribe tags toolbar widget".split())
GROUPS = (
    ("p", "blockquote", "pre"), ("h1", "h2"), ("h3", "h4", "h5", "h6"), ("li", "dd", "dt"), ("ul", "ol", "dl", "menu"), ("table", "tr", "td", "th", "tbody"),
    ("article", "main"), ("nav",), ("aside",), ("footer",), ("header",), ("form", "fieldset", "button"), ("section", "div"), ("figure", "figcaption"))
GROUP_OF = {tag: k for k, tags in enumerate(GROUPS) for tag in tags}
BUCKETS = 6

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Za-z]+")


class Node:
    __slots__ = ("tag", "names", "parent", "children", "depth", "pieces", "chars", "words", "stops", "linked", "tags")

    def __init__(self, tag: str, names: frozenset, parent: Node | None):
        self.tag, self.names, self.parent, self.children = tag, names, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.pieces: list = []  # of text, and child blocks where they stand
        self.chars = self.words = self.stops = self.linked = self.tags = 0


def parse(source: str) -> list[Node]:
    """The block elements of a page in document order; the first is the root."""
    root = Node("html", frozenset(), None)
    nodes, stack, links, at, n = [root], [("html", root)], 0, 0, len(source)

    def put(text: str) -> None:
        node = stack[-1][1]
        node.pieces.append(text)
        words = len(text.split())
        node.chars += len(text) if words else 0
        node.words += words
        node.stops += text.count(".") + text.count(",")
        node.linked += words if links else 0

    while at < n:
        token = _TOKEN.search(source, at)
        if token is None:
            put(entities.unescape(source[at:]))
            break
        if token.start() > at:
            put(entities.unescape(source[at:token.start()]))
        at = token.end()
        if token[2] is None:
            continue
        tag = token[2].lower()
        if token[1]:
            if any(name == tag for name, _ in stack[1:]):
                while stack[-1][0] != tag:
                    links -= stack.pop()[0] == "a"
                links -= stack.pop()[0] == "a"
            continue
        if tag in SILENT:
            if tag not in VOID and not token[3].rstrip().endswith("/"):
                at = _after(source, tag, at)
            continue
        if tag == "br":
            stack[-1][1].pieces.append(" ")
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            links -= _close(stack, ("p",))
        if tag in SELF_CLOSING:
            links -= _close(stack, SELF_CLOSING[tag])
        if tag == "html":
            continue
        block = stack[-1][1]
        if tag in INLINE:
            block.tags += 1
            links += tag == "a"
            stack.append((tag, block))
            continue
        names = frozenset(part.lower() for found in _NAMES.findall(token[3]) for part in _PART.findall("".join(found)))
        node = Node(tag, names, block)
        block.children.append(node)
        block.pieces.append(node)
        nodes.append(node)
        if not token[3].endswith("/"):
            stack.append((tag, node))
    return nodes


def _close(stack: list, tags: tuple) -> int:
    """End the innermost open one of `tags`, unless a container was opened since; how many links that ended."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k][0] in tags:
            links = sum(name == "a" for name, _ in stack[k:])
            del stack[k:]
            return links
        if stack[k][0] in LIMITS:
            break
    return 0


def _after(source: str, tag: str, at: int) -> int:
    """Where the text goes on after an element whose content is not text."""
    if tag in RAW:
        end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
        return end.end() if end else len(source)
    depth, mark = 1, re.compile(rf"<(/?){tag}\b[^>]*>", re.I)
    inner = re.compile(r"<(script|style|title)\b[^>]*>", re.I)
    while depth:
        found = mark.search(source, at)
        if not found:
            return len(source) if tag != "head" else _body(source, at)
        raw = inner.search(source, at, found.start())
        if raw:
            at = _after(source, raw[1].lower(), raw.end())
            continue
        if tag == "head" and not found[1]:
            depth -= 1
        depth += -1 if found[1] else 1
        at = found.end()
    return at


def _body(source: str, at: int) -> int:
    found = re.compile(r"<body\b", re.I).search(source, at)
    return found.start() if found else at


N_OWN = 12
N_FEATURES = len(GROUPS) + 3 + BUCKETS + N_OWN + 12


def _bucket(name: str) -> int:
    return sum(map(ord, name)) % BUCKETS


def features(nodes: list[Node]) -> list[list[float]]:
    """Numbers about every block, in document order."""
    total = {}
    for node in reversed(nodes):
        sums = [node.chars, node.words, node.stops, node.linked, node.tags + 1, node.tag in ("p", "blockquote", "pre")]
        for child in node.children:
            sums = [a + b for a, b in zip(sums, total[id(child)], strict=True)]
        total[id(node)] = sums
    # Of every block: its place among its siblings, how many they are, their mean size, and whether it is the first largest.
    kin = {id(nodes[0]): (0, 1, total[id(nodes[0])][0], True)}
    for node in nodes:
        sizes = [total[id(x)][0] for x in node.children]
        largest, mean = (sizes.index(max(sizes)), sum(sizes) / len(sizes)) if sizes else (0, 0.0)
        for place, child in enumerate(node.children):
            kin[id(child)] = (place, len(sizes), mean, place == largest)
    page = total[id(nodes[0])]
    rows, above = [], {}
    for node in nodes:
        chars, words, stops, linked, tags, paragraphs = total[id(node)]
        kind = [0.0] * len(GROUPS)
        group = GROUP_OF.get(node.tag)
        if group is not None:
            kind[group] = 1.0
        buckets = [0.0] * BUCKETS
        for name in node.names:
            buckets[_bucket(name)] += 1
        main, other = len(node.names & MAIN_NAMES), len(node.names & OTHER_NAMES)
        place, family, mean, largest = kin[id(node)]
        mine = [
            math.log1p(chars), math.log1p(words), stops / (words + 1), linked / (words + 1), words / tags, math.log1p(tags), paragraphs / tags,
            chars / (page[0] + 1), node.chars / (chars + 1), math.log1p(node.chars), len(node.children), float(linked == words)]
        # Of all ancestors: main and other names, main and other elements, link density of the parent.
        up = above.get(id(node.parent), (0, 0, 0, 0))
        here = (up[0] + main, up[1] + other, up[2] + (group == 6), up[3] + (group in (7, 8, 9, 10, 11)))
        above[id(node)] = here
        rest = [
            node.depth, place, family, place / family, math.log1p(mean), float(largest), *here,
            total[id(node.parent)][3] / (total[id(node.parent)][1] + 1) if node.parent else 0.0, float(main > other)]
        rows.append([*kind, main, other, len(node.names), *buckets, *mine, *rest])
    return rows


def block_texts(nodes: list[Node], keep: list[bool]) -> list[str]:
    """The text of the kept blocks in page order; a block's text ends where another block begins."""
    kept = {id(n) for n, k in zip(nodes, keep, strict=True) if k}
    out, todo = [], [iter(nodes[0].pieces)] if kept else []
    owner, run = [nodes[0]], []

    def flush() -> None:
        text = " ".join("".join(run).split())
        if text and id(owner[-1]) in kept:
            out.append(text)
        run.clear()

    while todo:
        piece = next(todo[-1], None)
        if piece is None:
            flush()
            todo.pop()
            owner.pop()
        elif isinstance(piece, str):
            run.append(piece)
        else:
            flush()
            owner.append(piece)
            todo.append(iter(piece.pieces))
    return out


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """The best set of blocks without one kept under a dropped ancestor."""
    best, place = [0.0] * len(nodes), {id(n): k for k, n in enumerate(nodes)}
    for k in range(len(nodes) - 1, -1, -1):
        node = nodes[k]
        weight = math.sqrt(node.words) if node.words else 0.2
        best[k] = max(0.0, float(odds[k]) * weight + sum(best[place[id(c)]] for c in node.children))
    keep = [False] * len(nodes)
    for k, node in enumerate(nodes):
        keep[k] = best[k] > 0 and (node.parent is None or keep[place[id(node.parent)]])
    return keep


# Training: labels by markup, and rewritten pages.


def labels(nodes: list[Node]) -> list[float]:
    """1 for blocks whose text lies mostly in main text, by their elements and names."""
    inside, share = {}, {}
    for node in nodes:
        up = inside.get(id(node.parent), 0)  # 0 outside, 1 in main text, 2 in something else for good
        odd = node.tag in ("nav", "aside", "footer", "header", "form", "button") or node.names & OTHER_NAMES
        main = node.tag in ("article", "main") or "body" in node.names or "content" in node.names or "entry" in node.names
        inside[id(node)] = 2 if up == 2 or odd else 1 if up == 1 or main else 0
    for node in reversed(nodes):
        good, all_ = (node.words if inside[id(node)] == 1 else 0), node.words
        for child in node.children:
            good, all_ = good + share[id(child)][0], all_ + share[id(child)][1]
        share[id(node)] = (good, all_)
    return [float(inside[id(n)] != 2 and 2 * share[id(n)][0] > share[id(n)][1]) for n in nodes]


def rewritten(source: str, other: str, form: int) -> str:
    """A page in another form (0: as it is): neutral elements with usual names, and parts put in around and inside the text."""
    if form == 0:
        return source
    # Usual names of parts.
    box = [("main", ""), ("div", ' class="post-content"'), ("div", ' id="content"'), ("section", ' class="entry-body"'), ("div", ' class="article-content"')][form - 1]
    bar = ["menu", "navbar", "site-nav", "breadcrumbs", "navigation"][form - 1]
    end = ["footer", "site-footer", "copyright", "footer-widget", "page-footer"][form - 1]
    texts = [" ".join(t.split()) for t in re.findall(r">([^<>]{30,})<", other)] or ["Read more about it here."]
    pick = lambda k: texts[(form * 7 + k) % len(texts)]
    some = lambda k: " ".join(pick(k).split()[:12])
    out = re.sub(r"<article\b[^>]*>", f"<{box[0]}{box[1]}>", source, flags=re.I)
    side = f'<aside class="sidebar"><h3>{some(1)}</h3><p>{pick(2)}</p><ul><li><a href="/x">{some(3)}</a></li><li><a href="/y">{some(4)}</a></li></ul></aside>'
    if form % 2:
        side = side.replace("<aside", "<div").replace("</aside>", "</div>")
    notice = f'<div class="{["cookie-notice", "notice", "consent-banner", "promo", "popup"][form - 1]}"><p>{pick(5)}</p><button>{some(6)}</button></div>'
    comments = "".join(f'<div class="comment"><p>{pick(k)}</p></div>' for k in (7, 8, 9))
    comments = f'<{"section" if form % 2 else "div"} class="comments"><h3>{some(10)}</h3>{comments}<form><p>{some(11)}</p><input><button>{some(12)}</button></form></{"section" if form % 2 else "div"}>'
    head = f'<header class="masthead"><h2>{some(13)}</h2><p>{some(14)}</p></header>' if form % 3 else f'<div class="header"><p>{some(13)}</p></div>'
    related = f'<div class="related"><h3>{some(15)}</h3><ul><li><a href="/r">{some(16)}</a></li></ul></div>'
    inner = comments if form in (2, 5) else related
    out = re.sub(r"</article\s*>", lambda m: f"{inner}</{box[0]}>{comments if inner is related else related}{side}", out, flags=re.I)
    if form > 2:
        out = re.sub(r"<nav\b[^>]*>", f'<div class="{bar}">', out, flags=re.I)
        out = re.sub(r"</nav\s*>", "</div>", out, flags=re.I)
        out = re.sub(r"<footer\b[^>]*>", f'<div id="{end}">', out, flags=re.I)
        out = re.sub(r"</footer\s*>", "</div>", out, flags=re.I)
    return re.sub(r"<body\b[^>]*>", lambda m: m[0] + head + notice, out, count=1, flags=re.I)


TRAIN = "features array<double>, label double, weight double"


def training_rows(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """Labelled blocks of the `sample_pages` pages with the least hash, in all forms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = [s for s in batch.column("html").to_pylist() if s]
            for k, source in enumerate(sources):
                rows, goal, weight = [], [], []
                for form in range(FORMS):
                    nodes = parse(rewritten(source, sources[k - 1], form))
                    rows += features(nodes)
                    goal += labels(nodes)
                    weight += [1 + math.log1p(n.words) for n in nodes]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(goal), pa.array(weight)], names=["features", "label", "weight"])

    sample = pages.filter(F.length("html") > 0).select("page_id", "html").orderBy(F.xxhash64("page_id", "html")).limit(sample_pages)
    return sample.select("html").mapInArrow(run, TRAIN)


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> list[tuple]:
    """The boosted trees as flat arrays: for each tree its weight, feature, threshold, left and right child, and value of each node."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    rows = stored(training_rows(pages, sample_pages).coalesce(1))
    kinds = rows.agg(F.min("label"), F.max("label")).first()
    if kinds[0] is None or kinds[0] == kinds[1]:  # nothing to tell apart
        return [(1.0, [0], [0.0], [0], [0], [0.0 if kinds[0] is None else 1.0 if kinds[0] else -1.0])]
    model = GBTClassifier(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, maxBins=32).fit(
        rows.select(array_to_vector("features").alias("vector"), "label", "weight"))
    return [(w, *_flat(tree._call_java("rootNode"))) for tree, w in zip(model.trees, model.treeWeights, strict=True)]


def _flat(node) -> tuple[list, list, list, list, list]:
    feature, threshold, left, right, value, todo = [], [], [], [], [], [(node, None, 0)]
    while todo:
        node, parent, side = todo.pop()
        k = len(feature)
        if parent is not None:
            (right if side else left)[parent] = k
        leaf = node.subtreeDepth() == 0
        feature.append(0 if leaf else node.split().featureIndex())
        threshold.append(0.0 if leaf else node.split().threshold())
        left.append(k)
        right.append(k)
        value.append(node.prediction())
        if not leaf:
            todo += [(node.rightChild(), k, 1), (node.leftChild(), k, 0)]
    return feature, threshold, left, right, value


def log_odds(model: list[tuple], x: np.ndarray) -> np.ndarray:
    """Twice the margin of the boosted trees: log odds that a block is main text."""
    total = np.zeros(len(x))
    for weight, feature, threshold, left, right, value in model:
        feature, threshold, left, right = map(np.asarray, (feature, threshold, left, right))
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(DEPTH):
            at = np.where(x[np.arange(len(x)), feature[at]] <= threshold[at], left[at], right[at])
        total += weight * np.asarray(value)[at]
    return 2 * total


def extract_text(pages: DataFrame, model: list[tuple] | None = None, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks for every row of `pages` (page_id, url, html, ...).

    text holds the kept blocks joined by line feeds, each with its white space turned into single blanks; it is empty for
    NULL and empty pages. The model (trained on `pages` where none is given) is a few thousand numbers whatever the input.
    """
    trees = train(pages, sample_pages) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 1 << 20):
            trees_of = [parse(s) if s else [] for s in batch.column("html").to_pylist()]
            rows = [row for nodes in trees_of if nodes for row in features(nodes)]
            odds = log_odds(trees, np.array(rows)) if rows else np.zeros(0)
            texts, counts, at = [], [], 0
            for nodes in trees_of:
                blocks = block_texts(nodes, decode(nodes, odds[at:at + len(nodes)])) if nodes else []
                at += len(nodes)
                texts.append("\n".join(blocks))
                counts.append(len(blocks))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(counts, pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_blocks"])

    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long, n_blocks long")
