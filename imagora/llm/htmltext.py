"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: a node stands for a path of
elements (tag and class words), its styles are the different child sequences
seen there, its content the different blocks of text. A node is important if its
pages differ in presentation or in content; a branch that looks and reads the
same on the pages of its host is template and is removed, inside stated main
content (article, main) as well. What markup states of itself comes first: nav,
footer or an advert's class is noise, and where main content is stated, only
that is looked at.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imagora.llm.common import small, stage

MIN_PAGES = 4
MIN_IMPORTANCE = 0.2
DECAY = 0.9
#: A template node is on this share of its host's pages at least, so that a host has at most
#: 1 / share times as many of them as a page has nodes; inside main content on the larger share.
MIN_SHARE = 0.125
MAIN_SHARE = 0.5
#: Elements below this depth open no element of their own, as in browsers; their text stays.
OPEN_DEPTH = 512
#: Elements below this depth belong to the tree node above them.
TREE_DEPTH = 64

# fixed values: element names and class words of HTML practice
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript textarea title iframe".split())
SKIPPED = set("template svg math object canvas audio video head button select option".split())
NOISE_TAGS = set("nav header footer aside form dialog menu".split())
MAIN_TAGS = {"article", "main"}
BLOCKS = set("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure "
             "footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td "
             "tfoot th thead tr ul".split())
IN_ARTICLE = {"header"}
NOISE_WORDS = set("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie "
                  "cookies consent notice popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs "
                  "footer masthead comment comments disqus reply replies share sharing social related recommended "
                  "newsletter subscribe subscription login signup search pagination pager toolbar skip widget".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
MAIN_WORDS = set("article content post story main entry".split())
PLAIN_WORDS = set("area bar block body bottom box column container inner item items left links list outer page panel "
                  "primary right secondary section site slot text top unit wrap wrapper".split())
P_CLOSERS = BLOCKS - {"br", "html", "body", "tr", "td", "th", "tbody", "thead", "tfoot", "li", "dd", "dt"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}}
P_LIMITS = {"td", "th", "li", "div", "article", "section"}
SIBLING_LIMITS = {"ul", "ol", "dl", "table", "select"}

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile(r">|=\s*([\"'])")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[a-z]+")

NOISE, GONE = 1, 2


@dataclass
class Element:
    """An open or closed element; ``stated``: nothing (0), NOISE, or GONE for what is never shown."""

    tag: str
    above: int
    depth: int
    path: int
    stated: int = 0
    main: bool = False
    children: list[str] = field(default_factory=list)


@dataclass
class Tree:
    """The elements of a page, the root first and parents before children, and (text, element) of its blocks."""

    elements: list[Element]
    blocks: list[tuple[str, int]]

    def nodes_above(self, at: int) -> Iterator[int]:
        """The paths from an element up to the root, without the root's."""
        while at:
            if self.elements[at].depth <= TREE_DEPTH:
                yield self.elements[at].path
            at = self.elements[at].above


def _tag_end(page: str, at: int) -> int:
    """Where a tag ends, with ``>`` in quoted values passed over; -1 if it does not."""
    while True:
        m = _STOP.search(page, at)
        if m is None:
            return -1
        if m[1] is None:
            return m.end()
        at = page.find(m[1], m.end()) + 1
        if at == 0:
            return -1


def tags(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before it, name, whether it closes, attributes) of each tag; the last has no name.

    Every character is looked at a fixed number of times: a tag whose quotes do
    not close ends the reading of quotes, and nothing after the last ``>`` is
    searched for an end. A tag that is cut off at the end of the page is left out.
    """
    begin = at = 0
    last, quoted = page.rfind(">"), True
    while (at := page.find("<", at)) >= 0:
        name, closing, attrs = "", page.startswith("/", at + 1), ""
        m = _NAME.match(page, at + 1 + closing)
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
        elif m is None and not page.startswith(("<!", "<?"), at):
            at += 1
            continue
        elif at > last:
            if page.find("<", at + 1) < 0:
                yield page[begin:at], "", False, ""
                return
            at += 1
            continue
        elif m is None:
            end = page.find(">", at) + 1
        else:
            end = _tag_end(page, m.end()) if quoted else -1
            if end < 0:
                quoted, end = False, page.find(">", m.end()) + 1
            name, attrs = m[0].lower(), page[m.end():end - 1]
        yield page[begin:at], name, closing, attrs
        if name in RAW and not closing:
            close = _RAW_END[name].search(page, end)
            end = close.start() if close else len(page)
        begin = at = end
    yield page[begin:], "", False, ""


def _stated(token: str, words: set[str]) -> bool:
    """Whether a class token is made of these words and plain ones only."""
    parts = set(_PART.findall(token))
    return not parts.isdisjoint(words) and parts <= words | PLAIN_WORDS


def signature(tag: str, attrs: str) -> tuple[str, int, bool]:
    """(name in the tree, what is stated, stated as main content).

    A class or id counts by whole tokens: ``no-sidebar`` or ``ad-free`` state nothing.
    """
    names, stated, main = "", NOISE if tag in NOISE_TAGS else 0, tag in MAIN_TAGS
    if attrs.strip():
        for name, *values in _ATTR.findall(attrs):
            name, value = name.lower(), next((v for v in values if v), "").lower()
            if name == "role":
                stated = max(stated, NOISE * (value in NOISE_ROLES))
                main |= value in ("main", "article")
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                stated = GONE
            elif name in ("class", "id"):
                tokens = value.split()
                if any(_stated(t, NOISE_WORDS) for t in tokens):
                    stated = max(stated, NOISE)
                elif tag in ("div", "section"):
                    main |= any(_stated(t, MAIN_WORDS) for t in tokens)
                if name == "class":
                    names = ".".join(sorted({p for t in tokens for p in _PART.findall(t)}))
    if tag in ("html", "body"):
        stated = 0
    return (f"{tag}.{names}" if names else tag), stated, main and not stated


def parse(page: str) -> Tree:
    """The elements and blocks of a page. Takes time in proportion to its length."""
    elements = [Element("", -1, 0, 0)]
    stack = [0]
    held: Counter = Counter()  # open elements by tag
    deep: Counter = Counter()  # those below OPEN_DEPTH, which have no element
    blocks: list[tuple[str, int]] = []
    text: list[str] = []

    def flush() -> None:
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if joined:
                blocks.append((joined, stack[-1]))

    def close(wanted: set[str], limits: set[str] = frozenset()) -> None:
        """Close the nearest open element of these tags that lies within the limits."""
        if not any(held[tag] for tag in wanted):
            return
        for depth in range(len(stack) - 1, 0, -1):
            tag = elements[stack[depth]].tag
            if tag in wanted:
                flush()
                for at in stack[depth:]:
                    held[elements[at].tag] -= 1
                del stack[depth:]
                return
            if tag in limits:
                return

    def open_(tag: str, attrs: str, shown: bool) -> None:
        if len(stack) > OPEN_DEPTH:
            deep[tag] += 1
            return
        name, stated, main = signature(tag, attrs)
        above = elements[stack[-1]]
        above.children.append(name)
        depth, path = above.depth + 1, above.path
        if depth <= TREE_DEPTH:
            path = xxhash.xxh64_intdigest(f"{path}/{name}")
            path -= (path >> 63) << 64
        elements.append(Element(tag, stack[-1], depth, path, stated if shown else GONE, main and shown))
        stack.append(len(elements) - 1)
        held[tag] += 1

    for before, tag, closing, attrs in tags(page):
        if before:
            text.append(before)
        if not tag or tag in RAW:
            continue
        if closing:
            if tag in BLOCKS:
                flush()
            if deep[tag]:
                deep[tag] -= 1
            else:
                close({tag})
        elif tag in BLOCKS:
            flush()
            if tag in P_CLOSERS:
                close({"p"}, P_LIMITS)
            if tag in SIBLINGS:
                close(SIBLINGS[tag], SIBLING_LIMITS)
            if tag not in VOID and not attrs.rstrip().endswith("/"):
                open_(tag, attrs, True)
        elif tag in SKIPPED and not (tag in ("svg", "math") and attrs.rstrip().endswith("/")):
            flush()
            open_(tag, attrs, False)
        # other tags are inline: their text belongs to the block around them
    flush()
    return Tree(elements, blocks)


def observations(column: pa.Array) -> Iterator[tuple[int, int, int, int]]:
    """(row, path, kind, hash): what each page adds to its host's tree; kind 0 style, 1 content.

    The root (path 0) has one style on every page: it counts the pages.
    """
    for i, page in enumerate(column.to_pylist()):
        tree = parse(page or "")
        seen = {(0, 0, 0)}
        for e in tree.elements[1:]:
            if e.depth <= TREE_DEPTH:
                seen.add((e.path, 0, xxhash.xxh64_intdigest(" ".join(e.children)) >> 1))
        for text, at in tree.blocks:
            digest = xxhash.xxh64_intdigest(text) >> 1
            seen.update((path, 1, digest) for path in tree.nodes_above(at))
        for path, kind, digest in sorted(seen):
            yield i, path, kind, digest


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def tree_nodes(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, path, pages, share, presentation, content): the importance of every node.

    With k of m pages sharing a style or a text, presentation is the entropy of
    the styles to the base m, content the mean over texts of 1 - log k / log m;
    both are 1 for a node of one page. ``share`` is m over the pages of the host.
    Counts are taken per (host, node, hash) before anything is gathered per node,
    so a host with a third of all pages spreads over many tasks.
    """

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, column = batch.column(0), batch.column(1)
            for start in range(0, len(column), 256):
                rows = list(observations(column.slice(start, 256)))
                if rows:
                    at, path, kind, digest = (np.array(x, dtype=np.int64) for x in zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [host.take(pa.array(at + start)), pa.array(path), pa.array(kind.astype(np.int32)), pa.array(digest)],
                        names=["host", "path", "kind", "digest"])

    rows = pages.select(host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").alias("html"))
    seen = rows.mapInArrow(observe, "host string, path bigint, kind int, digest bigint")
    counts = seen.groupBy("host", "path", "kind", "digest").agg(F.count(F.lit(1)).alias("k"))
    style, content = F.col("kind") == 0, F.col("kind") == 1
    nodes = stage(counts.groupBy("host", "path").agg(
        F.sum(F.when(style, F.col("k"))).alias("m"),
        F.sum(F.when(style, F.col("k") * F.log("k"))).alias("k_log_k"),
        F.avg(F.when(content, F.log("k"))).alias("log_k")), "style-tree")
    m = F.col("m")
    roots = nodes.filter("path = 0").select("host", m.alias("all"))
    return nodes.filter("path != 0").join(small(roots), "host").select(
        "host", "path", m.alias("pages"), (m / F.col("all")).alias("share"),
        F.when(m > 1, 1 - F.col("k_log_k") / m / F.log(m)).otherwise(1.0).alias("presentation"),
        F.when(F.col("log_k").isNull(), 0.0).when(m > 1, F.greatest(1 - F.col("log_k") / F.log(m), F.lit(0.0)))
        .otherwise(1.0).alias("content"))


def template_nodes(nodes: DataFrame, min_pages: int = MIN_PAGES, least: float = MIN_IMPORTANCE) -> DataFrame:
    """(host, low, common): nodes of low importance on hosts with enough pages; common ones count in main content.

    Each is on a stated share of the host's pages, so the arrays of a host hold at
    most a fixed multiple of the nodes of one of its pages.
    """
    importance = (1 - DECAY) * F.col("presentation") + DECAY * F.col("content")
    return nodes.filter((F.col("pages") >= min_pages) & (F.col("share") >= MIN_SHARE) & (importance < least)).groupBy("host").agg(
        F.sort_array(F.collect_list("path")).alias("low"),
        F.sort_array(F.collect_list(F.when(F.col("share") >= MAIN_SHARE, F.col("path")))).alias("common"))


def settle(elements: list[Element], lifted: set[int] = frozenset()) -> tuple[list[bool], list[int]]:
    """Per element: whether it is noise, and the outermost element that states it as main content (0: none).

    ``lifted`` elements are not noise whatever their markup states.
    """
    noise, home = [False], [0]
    for i, e in enumerate(elements[1:], 1):
        inside = home[e.above]
        own = e.stated == GONE or (e.stated == NOISE and i not in lifted and not (inside and e.tag in IN_ARTICLE))
        noise.append(noise[e.above] or own)
        home.append(inside or (i if e.main else 0))
    return noise, home


def around_main(elements: list[Element]) -> set[int]:
    """The elements that hold main content."""
    found: set[int] = set()
    for e in elements[1:]:
        at = e.above if e.main else 0
        while at and at not in found:
            found.add(at)
            at = elements[at].above
    return found


def main_text(page: str | None, low: frozenset[int] = frozenset(), common: frozenset[int] = frozenset()) -> str:
    """The blocks that are left, one per line.

    Where a page states its main content, that is what is looked at; a noise
    element around all of it does not count if more text is gained than lies
    outside. Of that, branches of the template go: ``low`` paths, or inside
    main content ``common`` ones, unless the main element as a whole is low (the
    pages of the host repeat one text). The tree never takes all of a page.
    """
    tree = parse(page or "")
    elements, blocks = tree.elements, tree.blocks

    def shown(noise: list[bool], home: list[int]) -> list[tuple[str, int]]:
        return [b for b in blocks if home[b[1]] and not noise[b[1]]]

    noise, home = settle(elements)
    kept = shown(noise, home)
    if not kept:
        kept, home = [b for b in blocks if not noise[b[1]]], [0] * len(elements)
        around = around_main(elements)
        if around:
            _, inner = lifted = settle(elements, around)
            found = shown(*lifted)
            if sum(len(t) for t, _ in found) > sum(len(t) for t, _ in kept):
                kept, home = found, inner
    gone = [False]
    for i, e in enumerate(elements[1:], 1):
        main = home[i]
        if not main:
            gone.append(gone[e.above] or e.path in low)
        else:
            gone.append(i != main and elements[main].path not in low and (gone[e.above] or e.path in common))
    left = [b for b in kept if not gone[b[1]]]
    return "\n".join(t for t, _ in left or kept)


def text_column(page: Column, low: Column, common: Column) -> Column:
    @F.arrow_udf("string")
    def extract(pages: pa.Array, low: pa.Array, common: pa.Array) -> pa.Array:
        return pa.array([main_text(p, frozenset(a or ()), frozenset(b or ()))
                         for p, a, b in zip(pages.to_pylist(), low.to_pylist(), common.to_pylist())], pa.string())

    return extract(page, low, common)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page.

    Null and empty pages have an empty text; pages without a host form one host.
    Text before, between and after elements counts like any other; a page cut off
    in the middle ends where it is cut. Very long or deeply nested pages are read
    whole, in time in proportion to their length. Repeated rows give repeated
    results and count as so many pages. Other columns are not read. An empty table
    gives an empty result.
    """
    template = stage(template_nodes(tree_nodes(pages, url_col, html_col)), "style-template").select(
        F.col("host").alias("_host"), "low", "common")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
                        F.col(f"`{html_col}`").alias("html"))
    both = rows.join(small(template), host_of(F.col("url")) == F.col("_host"), "left")
    text = both.select("page_id", "url", text_column(F.col("html"), F.col("low"), F.col("common")).alias("text"))
    return text.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
