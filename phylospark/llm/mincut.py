"""HTML extraction by minimum-cut labelling.

A page becomes blocks of text with their element paths. A classifier (logistic regression, fitted on the synthetic
pages of pagemaker, as there are no labelled ones) gives each block its log odds for being content; positive ones are
its capacity from the source, negative ones its capacity to the sink. Neighbouring blocks, and neighbours with the same
parent or grandparent, are tied by smoothness edges, so a short line inside an article stays with it. The maximum
flow's cut separates content (the source's side) from boilerplate.

Text inside a block has its references decoded and its white space made single spaces; blocks are joined by line feeds
in page order. Nothing is dropped or capped within content.

Nulls: a null page is an empty one and gives an empty text; null page_id and url stay null. Badly nested
and cut-off markup is read as browsers read it: an end tag closes what it names, with all inside, or nothing; a comment
or script without an end takes the rest of the page. Only a quote without its end does not. Repeated rows are read each. Empty tables give empty results. Columns other than
page_id, url and html are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospark.llm import common as c
from phylospark.llm import pagemaker

#: Of the classifier's fit; capacities below EPSILON are none.
RIDGE, EPSILON = 1.0, 1e-9

#: A comment; another declaration; a tag's beginning; an end tag without a name.
_MARK = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)|</[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""[\s/]*(?:([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?)?""")
_UNQUOTED = re.compile(r"\s*=\s*([^\s>]+)")
#: Elements of which nothing is text of the page; the raw ones end only at their own end tag.
_RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
_SILENT = _RAW | frozenset("head noscript template svg math object video audio canvas select datalist".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the key ends an open element of these, if no other block is in between.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

#: Smoothness between neighbours, and more for a common parent or grandparent.
NEAR, SIBLINGS, COUSINS = 0.5, 1.5, 0.5
_CONTENT_TAGS = frozenset(("article", "main"))
_LANDMARKS = frozenset("nav footer aside form menu button dialog label fieldset".split())
_NAMES = re.compile(r"[a-z]+")
#: A class of this form speaks of a part of the element, not of the element.
_OF_A_PART = re.compile(r"(?:has|have|with|without|no|not|hide|show)[-_]")
_CONTENT_NAMES = frozenset("article main content post entry story maincontent articlebody".split())
_COMMENT_NAMES = frozenset("comment comments reply replies respond".split())
_BOILERPLATE_NAMES = _COMMENT_NAMES | frozenset(
    "ad ads advert advertisement advertising adsense banner breadcrumb breadcrumbs consent cookie cookies disclaimer footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion related search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription tags toolbar topbar widget widgets complementary contentinfo".split()
)


def attributes(page: str, at: int) -> tuple[list[tuple[str, str]], int]:
    """Names and values from `at`, behind a tag's name, and where the tag ends. A quoted value that holds a > and whose
    end does not stand like one (an = before it, or something else than a space, / or > behind it) lacks its end quote;
    it is read as an unquoted one."""
    found, n = [], len(page)
    while at < n:
        part = _ATTRIBUTE.match(page, at)
        end = part.end()
        name, a, b, plain = part.groups()
        if name is None:
            break
        quoted = a if a is not None else b
        if quoted is not None and ">" in quoted and (quoted.endswith("=") or end < n and not (page[end].isspace() or page[end] in "/>")):
            bare = _UNQUOTED.match(page, part.end(1))
            quoted, end = bare[1], bare.end()
        found.append((name.lower(), quoted if quoted is not None else plain or ""))
        at = end
    else:
        end = n
    return found, end + 1 if end < n else n


class _Element:
    __slots__ = ("tag", "article", "named", "landmark", "boilerplate", "link", "silent", "up", "block")

    def __init__(self, tag: str, attributes: list[tuple[str, str]], up: _Element | None) -> None:
        self.tag, self.up = tag, up
        self.block = self if tag in _BLOCK or up is None else up.block
        self.article, self.named, self.landmark, self.boilerplate, self.link, self.silent = (up.article, up.named, up.landmark, up.boilerplate, up.link, up.silent) if up else (False,) * 6
        self.link |= tag == "a"
        self.silent |= tag in _SILENT
        if tag in _CONTENT_TAGS:
            self.article = True
        elif tag in _LANDMARKS or tag == "header" and not self.article:
            self.landmark = True
        names: set[str] = set()
        for name, value in attributes:
            if name in ("class", "id", "role"):
                for word in value.lower().split():
                    if not _OF_A_PART.match(word):
                        names.update(_NAMES.findall(word))
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                self.silent = True
        if names and tag not in ("html", "body"):
            # what an article's or main's classes tell of its parts does not make it boilerplate, but comments may be articles
            if names & (_COMMENT_NAMES if tag == "article" else _BOILERPLATE_NAMES) and tag != "main":
                self.boilerplate = True
            elif names & _CONTENT_NAMES and tag in _BLOCK:
                self.named = True


class Block:
    __slots__ = ("element", "text", "linked")

    def __init__(self, element: _Element, text: str, linked: int) -> None:
        self.element, self.text, self.linked = element, text, linked


def blocks(page: str) -> list[Block]:
    """The page's non-empty blocks of visible text, in order."""
    out: list[Block] = []
    top = _Element("", [], None)
    open_: Counter[str] = Counter()
    parts: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        if parts:
            if text := " ".join("".join(parts).split()):
                out.append(Block(top.block, text, len(" ".join("".join(linked).split()))))
            parts.clear()
            linked.clear()

    def say(raw: str) -> None:
        if raw and not top.silent:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if top.link:
                linked.append(text)

    def close(last: _Element) -> None:
        """Leaves `last` and all that is open inside it."""
        nonlocal top
        while top is not last:
            open_[top.tag] -= 1
            top = top.up
        open_[top.tag] -= 1
        top = top.up

    at, n = 0, len(page)
    while at < n:
        mark = _MARK.search(page, at)
        if mark is None:
            say(page[at:])
            break
        say(page[at : mark.start()])
        at = mark.end()
        tag = (mark[2] or "").lower()
        if not tag:
            continue
        own, at = attributes(page, at)
        if mark[1]:
            if tag == "p" or open_[tag] and tag in _BLOCK:  # without a start tag, </p> is an empty paragraph
                flush()
            if open_[tag]:
                found = top
                while found.tag != tag:
                    found = found.up
                close(found)
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in _BLOCK:
            flush()
            ends = _ENDS.get(tag, ("p",))
            if any(open_[x] for x in ends):
                found = top.block
                while found.tag == "p" and "p" not in ends:
                    found = found.up.block
                if found.tag in ends:
                    close(found)
        if tag in _VOID:
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
        elif page[at - 2 : at] != "/>" or tag in _BLOCK:
            top = _Element(tag, own, top)
            open_[tag] += 1
    flush()
    return out


def features(block: Block) -> tuple[float, ...]:
    """What the classifier sees of a block."""
    e, n = block.element, len(block.text)
    marked = e.article or e.named
    return (
        1.0, float(e.article), float(e.named), float(e.landmark), float(e.boilerplate), min(1.0, block.linked / n), min(3.0, math.log1p(n / 60)), float(n < 25 and not marked),
        float(block.text[-1] in ".!?…。\"”"), float(e.tag in ("p", "pre", "blockquote")), float(e.tag in ("h1", "h2", "h3", "h4")), float(e.tag in ("li", "td", "dd")),
    )


@cache
def weights() -> tuple[float, ...]:
    """The classifier's weights: logistic regression on the blocks of the synthetic pages, by Newton's method."""
    rows, labels = [], []
    for page, wanted in pagemaker.pages():
        for block in blocks(page):
            rows.append(features(block))
            labels.append(block.text in wanted)
    x, y = np.array(rows), np.array(labels, dtype=float)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + RIDGE * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.round(6).tolist())


def evidence(block: Block) -> float:
    """The classifier's log odds: positive for content, negative for boilerplate."""
    return sum(w * x for w, x in zip(weights(), features(block), strict=True))


def min_cut(terminal: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it is on the source's side of the minimum cut (of several, the one with the fewest nodes
    there). terminal: capacity from the source (above 0) or to the sink (below 0); edges: both ways.

    A node whose terminal outweighs its edges is on that side in any case; its edges then count as terminals of its
    neighbours, which may decide those. What stays undecided falls apart into small pieces, each solved by max-flow."""
    n = len(terminal)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, x in edges:
        near[a][b] = near[b][a] = near[a].get(b, 0.0) + x
    pull, tied, side = list(terminal), [sum(own.values()) for own in near], [None] * n
    ready = list(range(n))
    while ready:
        i = ready.pop()
        if side[i] is None and (pull[i] > tied[i] + EPSILON or pull[i] <= EPSILON - tied[i]):
            side[i] = pull[i] > tied[i] + EPSILON
            for j, x in near[i].items():
                if side[j] is None:
                    pull[j] += x if side[i] else -x
                    tied[j] -= x
                    ready.append(j)
    for start in range(n):
        if side[start] is None:
            piece, place = [start], {start: 0}
            for i in piece:
                for j in near[i]:
                    if side[j] is None and j not in place:
                        place[j] = len(piece)
                        piece.append(j)
            inner = [(place[i], place[j], x) for i in piece for j, x in near[i].items() if j in place and place[i] < place[j]]
            for i, found in zip(piece, _source_side([pull[i] for i in piece], inner), strict=True):
                side[i] = found
    return side


def _source_side(terminal: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Max-flow by blocking flows in level graphs; what the source still reaches then is its side."""
    n = len(terminal)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def add(a: int, b: int, there: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(there)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, x in enumerate(terminal):
        if x > 0:
            add(source, i, x, 0.0)
        elif x < 0:
            add(i, sink, -x, 0.0)
    for a, b, x in edges:
        add(a, b, x, x)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = [source]
        for a in queue:
            for e in head[a]:
                if room[e] > EPSILON and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        nexts, path, at = [0] * (n + 2), [], source
        while True:
            if at == sink:
                least = min(room[e] for e in path)
                for k, e in enumerate(path):
                    room[e] -= least
                    room[e ^ 1] += least
                k = next(k for k, e in enumerate(path) if room[e] <= EPSILON)
                at = to[path[k] ^ 1]
                del path[k:]
            while nexts[at] < len(head[at]):
                e = head[at][nexts[at]]
                if room[e] > EPSILON and level[to[e]] == level[at] + 1:
                    break
                nexts[at] += 1
            else:
                if at == source:
                    break
                level[at] = -1
                at = to[path.pop() ^ 1]
                continue
            path.append(e)
            at = to[e]


def main_text(page: str) -> str:
    found = blocks(page)
    edges = []
    for i, (a, b) in enumerate(zip(found, found[1:], strict=False)):
        tie = NEAR
        if a.element.up is b.element.up:
            tie += SIBLINGS
        elif a.element.up is not None and b.element.up is not None and a.element.up.up is b.element.up.up:
            tie += COUSINS
        edges.append((i, i + 1, tie))
    last: dict[int, int] = {}
    for i, block in enumerate(found):  # DOM proximity of those that aren't adjacent
        parent = id(block.element.up)
        if (j := last.get(parent)) is not None and j < i - 1:
            edges.append((j, i, SIBLINGS))
        last[parent] = i
    kept = min_cut([evidence(b) for b in found], edges)
    return "\n".join(b.text for b, k in zip(found, kept, strict=True) if k)


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row."""

    def run(batches):
        out = c.Rows(_OUT)
        for batch in batches:
            for page_id, url, page in zip(batch.column("page_id"), batch.column("url"), batch.column("html"), strict=True):
                text = main_text(page.as_py())
                if out.add(len(text), page_id.as_py(), url.as_py(), text):
                    yield out.flush()
        yield out.flush()

    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), c.text_of(pages, "html").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
