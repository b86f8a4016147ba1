"""HTML extraction with a site style tree.

Pages of one host are merged into a tree: a node is the path of elements (tag with class)
from the root, and for every page that has the path it records the page's style there (the
sequence of child elements, runs counted once) and, for a leaf, its content.  With m pages
and l styles of shares p_i:

    presentation importance of a node   -sum p_i log_m p_i           (1 if m = 1)
    content importance of a leaf        1 - mean over contents a of log_m(pages with a)
    importance of a branch              (1 - g^l) presentation + g^l mean of its children,
                                        g = 0.9; of a leaf its content importance

Menus and notices look and read alike on every page and score near 0, articles near 1.
A branch seen on ``MIN_PAGES`` pages or more is removed if it and all branches in it are
below ``LOW``.  Inside an article or main element each text is judged by itself: it goes if it
is found there beside ``MIN_PAGES`` different texts or more and its own importance, by the
number of these, is below ``FIXED`` (the same words in nearly all articles).  Pages with the
same main text are one page.  Elements whose tag, role
or class says that they are menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles or comments go by that, on any page; a page with article or main
elements yields what is in all of them that are not hidden.

How it runs: pages are parsed by the tasks that read them, which emit one row for each
(host, node, style or content, main text); those are counted by hash aggregation, so a host
with a third of all pages is spread over the cluster and copies of a text count once.
The tree (a row for each host and node) is broadcast while it has at most
``MAX_BROADCAST`` rows; beyond that the nodes of each distinct page join the tree on (host,
node), with ``SALTS`` copies of the tree so that a node of every page of a large host is
spread, and each page gets back its own nodes only, never its host's whole tree.

Text: character references are decoded, white space within a block becomes one space,
blocks follow page order with one line feed between them.

Defined cases: null and empty html give an empty text; pages without a host (null or
odd url) are judged by their own tags only; repeated rows give equal texts; unclosed and
misnested elements are closed as browsers do for paragraphs, list items and table cells.
"""

import html
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

GAMMA = 0.9
MIN_PAGES = 8
LOW = 0.45
FIXED = 0.1
MAX_BROADCAST = 200_000
SALTS = 16

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_START = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
LONG_TAG = 4096  # characters within which the quotes of a tag are looked at
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title xmp iframe noembed noframes".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup td th time tt u var wbr".split()
)
_CLOSES = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
_NOISE_TAGS = set(
    "head script style noscript template textarea title iframe object embed svg canvas audio video nav footer aside form "
    "button select input label fieldset dialog menu xmp noembed noframes".split()
)
_NOISE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NOISE_NAMES = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead topbar comment comments commentlist "
    "disqus respond replies share sharing social related recommended newsletter subscribe signup login popup modal overlay "
    "pagination pager toolbar".split()
)
_DEPTH = 300  # what is nested deeper counts as a child of the element at this depth
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


class Node:
    __slots__ = ("tag", "name", "noise", "main", "hidden", "children", "path", "score")

    def __init__(self, tag: str, name: str, noise: bool, main: bool, hidden: bool = False):
        self.tag, self.name, self.noise, self.main, self.hidden = tag, name, noise, main, hidden
        self.children: list = []  # nodes and texts
        self.path, self.score = 0, None


def _node(tag: str, attributes: str) -> Node:
    found = {}
    if attributes and not attributes.isspace():
        found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    kind, role = found.get("class", ""), found.get("role", "").lower()
    noise = tag in _NOISE_TAGS or role in _NOISE_ROLES
    main = tag in ("article", "main") or role == "main" or found.get("itemprop") == "articleBody"
    hidden = False
    if found and tag not in ("html", "body"):
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        noise = noise or hidden
    if (kind or "id" in found) and tag not in ("html", "body", "main"):
        noise = noise or any(w.lower() in _NOISE_NAMES for w in _NAME.findall(f"{kind} {found.get('id', '')}"))
    return Node(tag, f"{tag}.{kind}" if kind else tag, noise, main and not noise, hidden)


def _markup(page: str):
    """(start, end, closing, tag, attributes) of each piece of markup, found in time linear in the page.

    A tag ends at its first ``>`` outside quotes or, where there is none within ``LONG_TAG``
    characters, at its first ``>``; without any ``>`` after it, it is text.  Comments and
    declarations have no tag; a comment that never ends reaches to the end of the page.
    """
    at, size, last = 0, len(page), page.rfind(">")
    while (start := page.find("<" if at <= last else "<!--", at)) >= 0:
        end, closing, tag, attributes = -1, "", "", ""
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            end = end + 3 if end >= 0 else size
        elif start < last and page[start + 1] in "!?":
            end = page.find(">", start) + 1
        elif start < last and (name := _START.match(page, start)):
            if whole := _TAG.match(page, start, start + LONG_TAG):
                closing, tag, attributes = whole.groups()
                end = whole.end()
            else:
                end = page.find(">", name.end()) + 1
                closing, tag, attributes = *name.groups(), page[name.end() : end - 1]
        if end <= start:
            at = start + 1
            continue
        at = (yield start, end, closing, tag, attributes) or end


def parse(page: str) -> Node:
    root = Node("#root", "#root", False, False)
    stack, at, size = [root], 0, len(page)
    markup, skip = _markup(page), None
    while True:
        try:
            start, end, close, tag, attributes = markup.send(skip)
        except StopIteration:
            break
        skip = None
        if start > at:
            stack[-1].children.append(page[at:start])
        at = end
        if not tag:
            continue
        tag = tag.lower()
        if close:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in _INLINE and stack[k].tag not in _INLINE:
                    break
            continue
        if tag not in _INLINE:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag not in _INLINE:
                    break
        if tag in _CLOSES:
            same, border = _CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in same.split():
                    del stack[k:]
                    if tag != "tr":
                        break
                elif stack[k].tag in border:
                    break
        node = _node(tag, attributes)
        stack[-1].children.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = skip = end.end() if end else size
        elif tag not in _VOID and not attributes.endswith("/") and len(stack) < _DEPTH:
            stack.append(node)
    if at < size:
        stack[-1].children.append(page[at:])
    return root


def _text(children: list) -> str:
    """Text of inline children, white space in one space each."""
    out, left = [], list(reversed(children))
    while left:
        child = left.pop()
        if isinstance(child, str):
            out.append(html.unescape(child))
        elif not child.noise:
            if child.tag in ("br", "td", "th"):
                out.append(" ")
            left.extend(reversed(child.children))
    return " ".join("".join(out).split())


def _has_block(node: Node) -> bool:
    return any(not isinstance(c, str) and (c.tag not in _INLINE or _has_block(c)) for c in node.children)


def _parts(node: Node) -> list:
    """Children as blocks (nodes) and runs of inline content (lists)."""
    parts: list = []
    for child in node.children:
        if isinstance(child, str) or (child.tag in _INLINE and not _has_block(child)):
            if not parts or not isinstance(parts[-1], list):
                parts.append([])
            parts[-1].append(child)
        else:
            parts.append(child)
    return parts


def _mains(root: Node) -> list[Node]:
    """Outermost article elements, else outermost main elements; none of what is hidden."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    left: list[tuple[Node, frozenset]] = [(root, frozenset())]
    while left:
        node, within = left.pop()
        if node.hidden or (node.noise and node.tag in _NOISE_TAGS):
            continue
        if node.main:
            kind = "article" if node.tag == "article" else "main"
            if kind not in within:
                found[kind].append(node)
            within |= {kind}
        left.extend((c, within) for c in reversed(node.children) if not isinstance(c, str) and not (c.noise and node.main))
    return found["article"] or found["main"]


def _hash(text: str, seed: int = 0) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(text, seed=seed & 0xFFFFFFFFFFFFFFFF))))


STYLE, CONTENT, INSIDE = 1, 0, 2


def observations(page: str) -> set[tuple[int, int, int, int]]:
    """(node, kind, hash, page) of one page.

    ``page`` stands for the page's main text (its set of blocks), so copies of it count once
    whatever surrounds it.  A text inside the main elements (INSIDE; its hash is one of path
    and text) has one of the main blocks beside it there, that of the least hash: copies of an
    article that differ in a few blocks mostly have the same.
    """
    styles: dict[int, set[str]] = {}
    contents: list[tuple[int, int, str, bool]] = []
    blocks: dict[bool, set[int]] = {True: set(), False: set()}  # of the main elements, of the rest
    root = parse(page)
    root.path = _hash("#root")
    mains = {id(node) for node in _mains(root)}
    left = [(root, id(root) in mains, False)]
    while left:
        node, inside, noise = left.pop()
        parts, names = _parts(node), []
        for part in parts:
            if isinstance(part, list):
                text = _text(part)
                if not text:
                    continue
                name, path = "#text", _hash("#text", node.path)
                what = _hash(text)
                contents.append((path, what, text, inside and not noise))
                if not noise:
                    blocks[inside].add(what)
            else:
                if part.tag in _RAW or part.tag == "head":
                    continue
                name = part.name
                part.path = _hash(name, node.path)
                if id(part) in mains:
                    left.append((part, True, False))
                else:
                    left.append((part, inside, noise or part.noise or (inside and part.tag == "header")))
            if not names or names[-1] != name:
                names.append(name)
        styles.setdefault(node.path, set()).add(" ".join(names))
    main = blocks[bool(mains)]
    digest, least = _hash(str(sorted(main))), [*sorted(main)[:2], 0, 0]
    # One style a page: elements at the same path are taken together.
    out = {(p, STYLE, _hash(str(sorted(map(_hash, xs)))), digest) for p, xs in styles.items()}
    for path, what, text, inside in contents:
        out.add((path, STYLE, _hash("shown"), digest))
        out.add((path, INSIDE, _hash(text, path), least[what == least[0]]) if inside else (path, CONTENT, what, digest))
    return out


class Extractor:
    """Text of a page, given the nodes of its host: path -> (pages, styles, presentation, content).

    A text that is fixed within the articles of the host is a key as well (hash of path and text).
    """

    def __init__(self, tree: dict[int, tuple[int, int, float, float]]):
        self.tree = tree

    def importance(self, node: Node) -> tuple[float, float] | None:
        """Importance of a branch and the highest within it; None without content."""
        if node.noise:
            return None
        scores, peak = [], 0.0
        for part in _parts(node):
            if isinstance(part, list):
                known = self.tree.get(_hash("#text", node.path))
                if _text(part):
                    scores.append(known[3] if known else 1.0)
                    peak = max(peak, scores[-1])
            else:
                part.path = _hash(part.name, node.path)
                if (below := self.importance(part)) is not None:
                    scores.append(below[0])
                    peak = max(peak, below[1])
        if not scores:
            return None
        _, styles, presentation, _ = self.tree.get(node.path, (1, 1, 1.0, 1.0))
        weight = GAMMA**styles
        own = (1 - weight) * presentation + weight * sum(scores) / len(scores)
        node.score = own, max(own, peak)
        return node.score

    def __call__(self, page: str) -> str:
        root = parse(page)
        root.path = _hash("#root")
        mains = _mains(root)
        for node in mains:  # what holds an article is no notice, whatever its class
            node.main = True
        out: list[str] = []
        self.importance(root)  # sets paths and scores
        for node in mains or [root]:
            self._collect(node, bool(mains), out)
        return "\n".join(out)

    def _collect(self, node: Node, inside: bool, out: list[str]) -> None:
        for part in _parts(node):
            if isinstance(part, list):
                text = _text(part)
                path = _hash("#text", node.path)
                if text and not (_hash(text, path) in self.tree if inside else self._low(path, None)):
                    out.append(text)
            elif part.noise:
                continue
            elif part.tag == "header":
                if inside:
                    self._headings(part, out)
            elif inside or not self._low(part.path, part):
                self._collect(part, inside, out)

    def _headings(self, node: Node, out: list[str]) -> None:
        for child in node.children:
            if not isinstance(child, str) and not child.noise:
                if child.tag in _HEADINGS:
                    text = _text(child.children)
                    if text:
                        out.append(text)
                else:
                    self._headings(child, out)

    def _low(self, path: int, node: Node | None) -> bool:
        pages, _, _, content = self.tree.get(path, (1, 1, 1.0, 1.0))
        if pages < MIN_PAGES:
            return False
        highest = (content, content) if node is None else node.score
        return highest is not None and highest[1] < LOW


def _host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1))


def style_tree(pages: DataFrame) -> DataFrame:
    """host, node, pages, styles, presentation, content: one row for each node and each fixed text of a host."""

    def run(batches):
        for frame in batches:
            out = []
            for host, page in zip(frame["host"], frame["html"]):
                out += [(host, *x) for x in observations(page)]
            yield pd.DataFrame(out, columns=["host", "node", "kind", "what", "page"])

    seen = (
        pages.select(_host(F.col("url")).alias("host"), "html")
        .where("host <> '' and html is not null")
        .mapInPandas(run, "host string, node long, kind int, what long, page long")
    )
    style = F.col("kind") == STYLE
    # A page counts once: copies of its text that look different at a node have one style there.
    once = seen.groupBy("host", "node", "kind", "page", F.when(~style, F.col("what")).alias("text")).agg(F.min("what").alias("what"))
    counted = stored(once.groupBy("host", "node", "kind", "what").agg(F.count("*").cast("double").alias("n")), "style-counts")
    nodes = (
        counted.groupBy("host", "node")
        .agg(
            F.sum(F.when(style, F.col("n"))).alias("m"),
            F.count(F.when(style, 1)).alias("l"),
            F.sum(F.when(style, F.col("n") * F.ln("n"))).alias("ns"),
            F.count(F.when(~style, 1)).alias("contents"),
            F.sum(F.when(~style, F.ln("n"))).alias("nc"),
        )
        .select(
            "host",
            "node",
            F.col("m").cast("long").alias("pages"),
            F.col("l").alias("styles"),
            F.when(F.col("m") > 1, (F.ln("m") - F.col("ns") / F.col("m")) / F.ln("m")).otherwise(1.0).alias("presentation"),
            F.when((F.col("m") > 1) & (F.col("contents") > 0), 1 - F.col("nc") / F.col("contents") / F.ln("m")).otherwise(1.0).alias("content"),
        )
    )
    fixed = (
        counted.where((F.col("kind") == INSIDE) & (F.col("n") >= MIN_PAGES))
        .join(nodes, ["host", "node"])
        .withColumn("content", 1 - F.ln("n") / F.ln("pages"))
        .where(F.col("content") < FIXED)
        .select("host", F.col("what").alias("node"), "pages", "styles", "presentation", "content")
    )
    return nodes.union(fixed)


def extract(pages: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""
    spark = pages.sparkSession
    # Nodes that too few pages share never remove anything.
    tree = stored(style_tree(pages).where(F.col("pages") >= MIN_PAGES), "style-tree")
    text = F.coalesce(F.col("html"), F.lit("")).alias("html")
    schema = "page_id long, url string, text string, n_chars long"

    def result(frame, texts):
        return pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    if tree.count() <= max_broadcast:
        nodes: dict[str, dict] = {}
        for r in tree.collect():
            nodes.setdefault(r["host"], {})[r["node"]] = (r["pages"], r["styles"], r["presentation"], r["content"])
        held = spark.sparkContext.broadcast(nodes)

        def run(batches):
            for frame in batches:
                yield result(frame, [Extractor(held.value.get(h, {}))(p) for h, p in zip(frame["host"], frame["html"])])

        return pages.select("page_id", "url", text, _host(F.col("url")).alias("host")).mapInPandas(run, schema)

    def nodes(batches):
        for frame in batches:
            out = [
                (host, page, node)
                for host, page, text in zip(frame["host"], frame["page"], frame["html"])
                for node in {x for n, kind, what, _ in observations(text) for x in ((n, what) if kind == INSIDE else (n,))}
            ]
            yield pd.DataFrame(out, columns=["host", "page", "node"])

    keyed = pages.select("page_id", "url", text, _host(F.col("url")).alias("host")).withColumn("page", F.md5(F.col("html").cast("binary")))
    wanted = keyed.where("host <> ''").select("host", "page", "html").mapInPandas(nodes, "host string, page string, node long").distinct()
    salted = tree.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    by_page = (
        wanted.withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(SALTS)).cast("int"))
        .join(salted, ["host", "node", "salt"])
        .groupBy("host", "page")
        .agg(F.collect_list(F.struct("node", "pages", "styles", "presentation", "content")).alias("nodes"))
    )
    joined = keyed.join(by_page, ["host", "page"], "left")

    def run_joined(batches):
        for frame in batches:
            trees = [{} if n is None else {r["node"]: (r["pages"], r["styles"], r["presentation"], r["content"]) for r in n} for n in frame["nodes"]]
            yield result(frame, [Extractor(t)(p) for t, p in zip(trees, frame["html"])])

    return joined.mapInPandas(run_joined, schema)
