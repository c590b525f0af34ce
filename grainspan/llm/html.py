"""Main text of web pages by a minimum cut between content and boilerplate blocks.

A page is read into blocks of text, each with its place in the tree of elements. A logistic classifier
over the form of a block (length, links, punctuation, position, element), its log odds kept within ``ODDS``, and bounded evidence
of what the page says of its containers (nav, footer, article, class and role names ...) give each block a cost for either label:
these are its terminal capacities. Blocks next to each other, and blocks next to each other under one container, are joined by
smoothness edges, which are weaker between blocks of which the page says different things. The maximum flow separates content from
boilerplate, and all content blocks are joined in page order. The edges of a block can outweigh what its name says: a name is
evidence and no verdict.

Of names, only whole words of class, id and role count: "sidebar", and the last word of a compound ("page-footer") or the first before a
word of place ("sidebar-left"); "has-sidebar", "comments-open" or "form-style" say nothing. What an element says holds for what is in
it, but a container, other than nav, header, footer, aside, menu, dialog and address, that holds most of the text of a page, with no text
of a named article outside it, is a wrapper, and its name says nothing against its content.

The classifier learns on ``SAMPLE`` pages (of those of at most ``SAMPLE_CHARS`` characters, the ones with the smallest hash of page_id) from
blocks whose containers are named: article and main against nav, footer, aside, form and the like. It sees none of those names itself.
Every page, of any length, is then labelled whole, in one scan without a shuffle.

Defined results: null or empty html, and pages without content, give an empty text; broken, cut off and unclosed
markup is read as far as it goes: head is only a mark, as its own elements show no text; a control, picture or player (``_DROPPED``)
without an end tag ends with its parent or before the next block; script, style and other raw text without an end tag has the rest
of the page, as in browsers; noscript and math are text like any other; an unfinished tag at the end is markup, an unfinished character
reference is text; repeated rows are each labelled; further columns are passed by.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mincut import min_cut
from .scratch import table

SAMPLE = 400
SAMPLE_CHARS = 1 << 18
#: Capacities of edges between neighbours and between neighbours in one container, and the part of them that is left between
#: blocks of which the page says different things.
NEXT, SIBLING, APART = 0.6, 0.8, 0.6
#: Bounds of the classifier's log odds, of plain evidence and of names that may well be something else. Between two neighbours in its own
#: container a block has 2 * APART * (NEXT + SIBLING) = 1.68 of edges, more than NAMED - ODDS.
ODDS, NAMED, HINTED = 2.5, 4.0, 1.0

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_RAW = {"script", "style", "textarea", "iframe", "title"}
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in _RAW}
#: Elements whose content is not text of the page, and those of them that cannot hold their own kind.
_DROPPED = {"template", "object", "svg", "annotation", "annotation-xml", "canvas", "select", "button", "audio", "video"}
_FLAT = {"select", "button", "canvas", "audio", "video"}
_NEXT = {t: re.compile(rf"<(/{'?' if t in _FLAT else ''}){t}\b(?![^<>]*/>)", re.I) for t in _DROPPED}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hgroup", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption", "hr",
}
#: Elements that end an open element of the second kind.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_BAD_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "header", "address"}
_GOOD_TAGS = {"article", "main"}
#: Names of containers, as whole words; of those in _MAYBE many stand for something else as well.
_BAD_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead ad ads adv advert adverts advertisement advertising sponsored cookie cookies consent gdpr popup modal overlay comment "
    "comments disqus newsletter subscribe pagination pager toolbar complementary contentinfo alertdialog hidden".split()
)
_MAYBE = frozenset("header banner promo notice notices reply replies respond share sharing social related recommended signup login search widget alert legal copyright dialog form sponsor".split())
_GOOD_NAMES = frozenset("article main content post entry story".split())
_MAYBE_GOOD = frozenset("body text".split())
_EVIDENCE = {n: -NAMED for n in _BAD_NAMES} | {n: -HINTED for n in _MAYBE} | {n: NAMED for n in _GOOD_NAMES} | {n: HINTED for n in _MAYBE_GOOD}
#: First words of compounds that tell a state, and last ones that tell a place or a part.
_STATES = frozenset("has no not with without is js can show hide open".split())
_PARTS = frozenset("left right top bottom container wrapper wrap box area list item items block section inner outer bar links holder slot unit content body text title".split())
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[a-z]+")
FEATURES = 9


@functools.lru_cache(1 << 14)
def evidence(name: str) -> float:
    """What one whole name says: below 0 against content, above 0 for it."""
    words = _WORD.findall(_HUMP.sub("-", name[:100]).lower())
    if not words or words[0] in _STATES and len(words) > 1:
        return 0.0
    first, last = _EVIDENCE.get(words[0], 0.0), _EVIDENCE.get(words[-1], 0.0)
    if len(words) == 1:
        return first
    if last < 0:
        return min(first, last)
    if words[-1] in _PARTS and first:
        return first
    return last


class Element:
    """An open element: its tag, its number, what it says itself of its content, and whether it says so by its tag."""

    __slots__ = ("tag", "number", "own", "sure", "within_good", "depth", "link", "dropped", "open", "block")

    def __init__(self, tag: str, attributes: str, number: int, up: Element | None):
        self.tag, self.number = tag, number
        self.depth = up.depth + 1 if up else 0
        self.within_good = up.within_good if up else False
        self.link = tag == "a" or bool(up and up.link)
        self.dropped = up.dropped if up and up.dropped else self.depth if tag in _DROPPED else 0  # where in the stack it begins
        self.open = False  # whether it is known to have no end tag
        self.block: Element = self if not up or tag in _BLOCK else up.block
        low = high = 0.0
        hidden = False
        if attributes and ("=" in attributes or "hidden" in attributes):
            for name, value in _ATTR.findall(attributes):
                name = name.lower()
                if name in ("class", "id", "role"):
                    for one in value.strip("\"'").split():
                        said = evidence(one)
                        if self.within_good and one.lower() == "header":
                            said = 0.0  # a header within an article belongs to it
                        low, high = min(low, said), max(high, said)
                elif name == "hidden" or name == "aria-hidden" and "true" in value or name == "style" and "display:none" in value.replace(" ", "").lower():
                    hidden = True
        if tag in ("body", "html"):
            low = high = 0.0
        if tag in _GOOD_TAGS:
            low, high = 0.0, NAMED
        by_tag = tag in _BAD_TAGS and not (tag in ("header", "address") and self.within_good)
        self.sure = by_tag and tag != "form"
        self.own = -NAMED if by_tag or hidden else low + high if low and high else low or high
        if self.own > 0:
            self.within_good = True


class Block:
    __slots__ = ("text", "place", "says", "tag", "linked")

    def __init__(self, text: str, element: Element, linked: int):
        self.text, self.place, self.says, self.tag, self.linked = text, element.number, 0.0, element.tag, linked


def judge(blocks: list[Block], parents: list[int], own: dict[int, tuple[float, bool]]) -> None:
    """Sets what the page says of each block. ``own`` has the elements that say something: how much, and whether by their tag."""
    n = len(parents)
    size, good, praised = [0] * n, [0] * n, [False] * n
    for e in range(1, n):  # containers have smaller numbers than what they hold
        praised[e] = praised[parents[e]] or own.get(e, (0.0,))[0] > 0
    praised[0] = own.get(0, (0.0,))[0] > 0
    for b in blocks:
        size[b.place] += len(b.text)
        good[b.place] += len(b.text) * praised[b.place]
    for e in range(n - 1, 0, -1):
        size[parents[e]] += size[e]
        good[parents[e]] += good[e]
    says = [0.0] * n
    for e in range(n):
        said, sure = own.get(e, (0.0, False))
        up = says[parents[e]] if e else 0.0
        if said < 0 and not sure and 2 * size[e] >= size[0] and good[e] == good[0]:
            said = 0.0  # a wrapper
        # What speaks against content holds for all within, and good names in it change nothing.
        says[e] = min(said, up) if min(said, up) < 0 else max(said, up)
    for b in blocks:
        b.says = says[b.place]


def read(html: str) -> tuple[list[Block], list[int]]:
    """Blocks in page order, and the block element around each element."""
    root = Element("html", "", 0, None)
    stack, parents, homes = [root], [0], [0]
    opened: Counter = Counter()
    own: dict[int, tuple[float, bool]] = {}
    blocks: list[Block] = []
    words: list[str] = []
    linked = 0
    at, end = 0, len(html)
    ends: dict[str, tuple[int, bool]] = {}  # of the dropped elements: the next tag of the kind, and whether it is an end tag

    def flush() -> None:
        nonlocal linked
        if words:
            raw = "".join(words)
            text = " ".join((unescape(raw) if "&" in raw else raw).split())
            if text:
                blocks.append(Block(text, stack[-1].block, min(linked, len(text))))
            words.clear()
        linked = 0

    def cut(k: int) -> None:
        """Ends the open elements from the k-th."""
        for e in stack[k:]:
            opened[e.tag] -= 1
        del stack[k:]

    def closed(tag: str) -> bool:
        """Whether the end tag of a dropped element that starts before ``at`` is to come."""
        where, is_end = ends.get(tag, (-1, False))
        if where < at:
            m = _NEXT[tag].search(html, at)
            ends[tag] = where, is_end = (m.start(), m[1] == "/") if m else (end, False)
        return is_end

    while at < end:
        start = html.find("<", at)
        if start < 0:
            start = end
        if start > at and not stack[-1].dropped:
            words.append(html[at:start])
            if stack[-1].link:
                linked += start - at
        if start == end:
            break
        m = _TAG.match(html, start)
        if not m:
            if not stack[-1].dropped:
                words.append("<")
            at = start + 1
            continue
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in _BLOCK and not stack[-1].dropped:
                flush()
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    if tag in _BLOCK and stack[-1].dropped and not stack[k].dropped:
                        flush()
                    cut(k)
                    break
                if stack[k].dropped and not stack[k - 1].dropped and tag not in _BLOCK and stack[k - 1].tag != tag:
                    break  # of inline end tags, a dropped element ends only with its parent's
                if stack[k].tag in ("article", "main", "body", "td", "table") and tag not in _BLOCK:
                    break  # an inline end tag does not end its container
            continue
        if tag in _RAW:
            if m[3].endswith("/"):
                continue
            close = _RAW_END[tag].search(html, at)
            at = close.end() if close else end
            continue
        if tag in _DROPPED and m[3].endswith("/"):
            continue
        if stack[-1].dropped:
            k = stack[-1].dropped
            if tag in _BLOCK and stack[k].open or tag == stack[k].tag and tag in _FLAT:
                cut(k)
        if stack[-1].dropped:
            if tag not in _VOID:
                stack.append(Element(tag, "", len(parents), stack[-1]))
                opened[tag] += 1
                parents.append(0)
                homes.append(0)
            continue
        if tag == "br":
            words.append(" ")
            continue
        if tag in _BLOCK:
            flush()
            if tag in ("html", "head", "body"):
                if m[3] and tag != "head":
                    top = Element(tag, m[3], 0, None)
                    if top.own:
                        own[0] = top.own, False
                continue
            k = stack[-1].block.depth  # a block ends an open paragraph and what is open in it
            if k and (stack[k].tag == "p" or stack[k].tag in _CLOSES.get(tag, ())):
                cut(k)
        if tag in _VOID:
            continue
        element = Element(tag, m[3], len(parents), stack[-1])
        if tag in _DROPPED:
            element.open = not closed(tag)
        if element.own:
            own[element.number] = element.own, element.sure
        parents.append(stack[-1].number)
        homes.append(stack[-1].block.number)
        stack.append(element)
        opened[tag] += 1
    flush()
    judge(blocks, parents, own)
    return blocks, homes


def features(blocks: list[Block]) -> np.ndarray:
    """(blocks, FEATURES): the form of blocks, without the names of their containers."""
    n = len(blocks)
    out = np.empty((n, FEATURES))
    for i, b in enumerate(blocks):
        t = b.text
        size = len(t)
        words = t.count(" ") + 1
        out[i] = (
            1.0, min(np.log1p(size), 7.0) / 7, b.linked / size, min(words, 60) / 60, min((t.count(",") + t.count(".")) / words, 0.5) * 2,
            b.tag in ("p", "h1", "h2", "h3", "blockquote", "pre"), b.tag in ("li", "td", "th", "dd", "dt"), i / n, t[-1] in ".!?",
        )
    return out


#: Used where a sample names no containers of both kinds.
PLAIN = np.array([-3.0, 3.0, -4.0, 2.0, 0.5, 1.5, -1.5, 0.0, 1.0])


def learn(pages: list[str | None]) -> np.ndarray:
    """Logistic weights by Newton steps, from blocks whose containers are named."""
    xs, ys = [], []
    for html in pages:
        blocks, _ = read(html or "")
        if blocks:
            says = np.array([b.says for b in blocks])
            named = np.abs(says) > HINTED
            xs.append(features(blocks)[named])
            ys.append(says[named] > 0)
    if not xs:
        return PLAIN
    x, y = np.concatenate(xs), np.concatenate(ys).astype(np.float64)
    if not 0 < y.sum() < y.size:
        return PLAIN
    w = np.zeros(FEATURES)
    ridge = 1e-3 * y.size * np.eye(FEATURES)
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge @ w)
    return w


def content(blocks: list[Block], homes: list[int], weights: np.ndarray) -> list[bool]:
    """Which blocks are content."""
    source, sink, edges = graph(blocks, homes, weights)
    return min_cut(source, sink, edges)


def graph(blocks: list[Block], homes: list[int], weights: np.ndarray) -> tuple[list[float], list[float], list[tuple[int, int, float]]]:
    """Capacities of the blocks to the terminals of content and boilerplate, and edges between blocks."""
    n = len(blocks)
    odds = np.clip(features(blocks) @ weights, -ODDS, ODDS).tolist()
    source, sink = [0.0] * n, [0.0] * n
    for i, b in enumerate(blocks):
        cost = odds[i] + b.says
        if cost >= 0:
            source[i] = cost
        else:
            sink[i] = -cost
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, NEXT * (APART if blocks[i - 1].says != b.says else 1)))
        home = homes[b.place]
        if home in last:
            edges.append((last[home], i, SIBLING * (APART if blocks[last[home]].says != b.says else 1)))
        last[home] = i
    return source, sink, edges


def main_text(html: str | None, weights: np.ndarray) -> str:
    blocks, homes = read(html or "")
    if not blocks:
        return ""
    return " ".join(b.text for b, good in zip(blocks, content(blocks, homes, weights), strict=True) if good)


def extracted(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages`` (page_id, url, html)."""
    # Ids are chosen first, so that only the sample's own pages come to the driver and not each task's best.
    fit = pages.filter(F.col("page_id").isNotNull() & (F.length("html") <= SAMPLE_CHARS))
    ids = [r.page_id for r in fit.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample).collect()]
    some = fit.filter(F.col("page_id").isin(ids)).limit(sample).select("html").collect() if ids else []
    weights = learn([r.html for r in some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), weights) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extracted(table(spark, sf_dir, "pages"))
