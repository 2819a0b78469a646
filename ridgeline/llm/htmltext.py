"""Main text of web pages by the distribution of text over lines.

A page is cut into lines at block elements.  Lines in parts of the page that are
never main text (menus, footers, forms, what is hidden, ...) and lines that are mostly
links weigh nothing.  So do parts whose class or id names them an advert, a sidebar,
comments and so on, unless they hold most of the page's text: then the name tells of
something else, and the parts within are looked at.  Lengths are summed over a sliding window of lines; the text
begins where the sum surges and ends where it dives.  How much is a surge follows from
the page's own windows, by number and by text.  At both ends, lines of small parts of
their own are left, and short lines of the same part as the text beside them are taken.
Where the page marks its article, what lies outside of it weighs a tenth, and is left out
if the text found has lines of the article.  A line that is mostly a link stays where it stands alone between lines of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from html import unescape
from itertools import accumulate
from math import sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.kernels import text_blocks, utf8

#: A tag with its attributes; a quoted value may hold the sign that ends tags.  No part of it is ever given back.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>")
#: The same where quotes don't come in pairs.
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NEVER = frozenset(
    "nav footer aside form script style textarea title head noscript template iframe object svg math canvas "
    "button select option datalist dialog menu audio video noembed noframes xmp".split()
)
_MAIN = frozenset(("article", "main"))
_BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td "
    "textarea tfoot th thead title tr ul".split()
)
_CONTAINERS = frozenset("address article aside blockquote body dialog div fieldset figure footer form header main menu nav section td th".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_CLOSES_P = _BLOCK - {"br", "html", "body", "legend", "option", "optgroup", "summary", "tbody", "td", "th", "thead", "tr", "tfoot"}
#: Words of class, id and role that mark a part as no main text.
_BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc sidebar side aside footer "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription "
    "signup login search share sharing social comment comments disqus respond replies reply "
    "related recommended widget widgets toolbar complementary contentinfo dialog".split()
)
#: ``no-sidebar`` and the like say something of a part, not what it is.
_NOT_ITSELF = re.compile(r"\b(?:no|has|with|without|hide|show|is|not)[-_][a-z]+")
_HEADER = frozenset(("header", "masthead", "topbar"))
#: Words of class and id that tell of main text: beside them no other word is sure.
_TEXTUAL = frozenset("article content entry main post story text body page wrapper layout".split())
_NO, _PERHAPS, _LIKELY, _SURE = range(4)


@dataclass(frozen=True)
class Limits:
    """``window`` lines are summed; a surge needs ``surge`` of the level of the page's sums; a line with over ``link_share`` of
    its text in links weighs nothing; with a marked article, text outside of it weighs ``outside`` of its length; a part that
    is named as no main text is heard if it holds over ``most`` of the page's text and a heading or article, or, if the name
    is not the whole of a class, over ``nearly_all`` of the text."""

    window: int = 3
    surge: float = 0.25
    link_share: float = 0.5
    outside: float = 0.1
    most: float = 0.5
    nearly_all: float = 0.8


@dataclass
class _Line:
    text: str
    links: int
    dead: bool
    main: bool
    part: int  # number of the innermost element that holds lines together
    heading: bool
    suspect: int = -1  # number of the innermost part that is named as no main text


def _marks(tag: str, attributes: str, in_main: bool) -> int:
    """How sure it is that an element is a part that is no main text."""
    if tag in _NEVER or (tag == "header" and not in_main):
        return _SURE
    if not attributes:
        return _NO
    mark, textual = _NO, False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return _SURE
        if name == "style":
            if "display:none" in value.replace(" ", "") or "visibility:hidden" in value.replace(" ", ""):
                return _SURE
        elif name in ("class", "id", "role") and tag not in ("html", "body", "article", "main"):
            bad = _BOILERPLATE | _HEADER if not in_main and tag not in ("h1", "h2", "h3") else _BOILERPLATE
            words = set(re.split(r"[^a-z]+", _NOT_ITSELF.sub("", value)))
            textual |= not words.isdisjoint(_TEXTUAL)
            if words & bad:
                mark = max(mark, _PERHAPS if bad.isdisjoint(value.split()) else _LIKELY)
    return min(mark, _PERHAPS) if textual else mark


class _Open:
    """The open elements, each with whether it is dead, whether it is main text, the part of the page that its lines belong to, and the innermost suspect."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool, int, int]] = []
        self.suspects: list[tuple[int, int]] = []  # the suspect around each, and how sure it is
        self.with_main: set[int] = set()  # suspects that an article begins in
        self.where: dict[str, list[int]] = {}  # places on the stack of each element
        self.blocks: list[int] = []
        self.parts = self.headings = 0
        self.dead, self.main, self.part, self.suspect = False, False, 0, -1

    def last(self, tag: str) -> int:
        """Place of the innermost one of a kind, -1 if none is open."""
        held = self.where.get(tag)
        return held[-1] if held else -1

    def push(self, tag: str, mark: int, main: bool) -> None:
        suspect = self.suspect
        if mark in (_PERHAPS, _LIKELY):
            suspect = len(self.suspects)
            self.suspects.append((self.suspect, mark))
        elif main and suspect >= 0:
            self.with_main.add(suspect)
        if tag in _CONTAINERS:
            self.parts += 1
        part = self.parts if tag in _CONTAINERS else self.part
        self.where.setdefault(tag, []).append(len(self.stack))
        if tag in _BLOCK:
            self.blocks.append(len(self.stack))
        self.headings += tag in _HEADINGS
        self.stack.append((tag, self.dead or mark == _SURE, self.main or main, part, suspect))
        self._restore()

    def cut(self, place: int) -> None:
        """Close the element at a place and all in it."""
        while len(self.stack) > place:
            tag = self.stack.pop()[0]
            self.where[tag].pop()
            if tag in _BLOCK:
                self.blocks.pop()
            self.headings -= tag in _HEADINGS
        self._restore()

    def _restore(self) -> None:
        _, self.dead, self.main, self.part, self.suspect = self.stack[-1] if self.stack else ("", False, False, 0, -1)

    def judged(self, found: list[_Line], limits: Limits) -> list[_Line]:
        """The lines, those of suspects that are not heard dead."""
        if not self.suspects:
            return found
        size, heading = [0] * len(self.suspects), [False] * len(self.suspects)
        for i in self.with_main:
            heading[i] = True
        total = 0
        for x in found:
            if not x.dead:
                total += len(x.text) - x.links
                if x.suspect >= 0:
                    size[x.suspect] += len(x.text) - x.links
                    heading[x.suspect] |= x.heading
        for i in range(len(size) - 1, -1, -1):  # those around come before those within
            around = self.suspects[i][0]
            if around >= 0:
                size[around] += size[i]
                heading[around] |= heading[i]
        dead: list[bool] = []
        for (around, mark), own, head in zip(self.suspects, size, heading, strict=True):
            heard = own > limits.most * total and head or mark == _PERHAPS and own > limits.nearly_all * total
            dead.append(not heard or around >= 0 and dead[around])
        return [replace(x, dead=True) if x.suspect >= 0 and dead[x.suspect] else x for x in found]


def lines(html: str, limits: Limits = Limits()) -> list[_Line]:
    """The page's lines in order, each with its text, the length of its links, and where it lies.  Time is linear in the page."""
    out: list[_Line] = []
    parts: list[str] = []
    opened = _Open()
    links = link_chars = 0

    def flush() -> None:
        nonlocal link_chars
        text = " ".join(unescape("".join(parts)).split())
        if text:
            out.append(_Line(text, link_chars, opened.dead, opened.main, opened.part, opened.headings > 0, opened.suspect))
        parts.clear()
        link_chars = 0

    at, n = 0, len(html)
    last_end = html.rfind(">")
    tag_at = _TAG.match
    while at < n:
        begin = html.find("<", at)
        piece = html[at:begin] if begin >= 0 else html[at:]
        if piece:
            parts.append(piece)
            if links:
                link_chars += len(piece.strip())
        if begin < 0:
            break
        after = html[begin + 1 : begin + 3]
        if after[:1] in ("!", "?"):
            end = html.find("-->", begin + 4) + 2 if html.startswith("<!--", begin) else html.find(">", begin)
            at = end + 1 if end >= begin + 2 else n
            continue
        if not after.lstrip("/")[:1].isalpha() or after[:2] == "//" or not after.lstrip("/")[:1].isascii():
            parts.append("<")  # a sign of the text
            at = begin + 1
            continue
        if begin > last_end:
            break  # cut off inside a tag
        m = tag_at(html, begin)
        if m is None:  # quotes don't come in pairs: from here on they are nothing special
            tag_at = _PLAIN_TAG.match
            m = tag_at(html, begin)
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag == "br" or tag == "p" and opened.last("p") < 0:
                flush()
            elif tag in _BLOCK or tag in _NEVER:
                if opened.last(tag) >= 0:
                    flush()
                    opened.cut(opened.last(tag))
                    links = 0
            else:
                # a mark-up element is on the stack only if it is marked: close it if no block lies in the way
                place = opened.last(tag)
                if place >= 0 and (not opened.blocks or opened.blocks[-1] < place):
                    flush()
                    opened.cut(place)
            continue
        if tag in _BLOCK or tag in _NEVER:
            flush()
        if tag == "a":
            links += 1
        if tag in _VOID:
            continue
        if tag in _CLOSES_P and opened.last("p") > max(opened.last(t) for t in ("table", "td", "li", "button", "object")):
            opened.cut(opened.last("p"))
        if tag == "li" and opened.stack and opened.stack[-1][0] == "li":
            opened.cut(len(opened.stack) - 1)
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*+>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if m[3].endswith("/"):
            continue
        mark = _marks(tag, m[3], opened.main)
        if mark and not opened.dead:
            flush()
        if tag in _BLOCK or tag in _NEVER or mark:
            opened.push(tag, mark, tag in _MAIN or 'role="main"' in m[3])
    flush()
    return opened.judged(out, limits)


def _level(sums: list[float]) -> float:
    """What is usual on the page: between the middle window and the window in the middle of the text."""
    ordered = sorted(sums)
    half, so_far = sum(ordered) / 2, 0.0
    for by_text in ordered:
        so_far += by_text
        if so_far >= half:
            break
    return sqrt(ordered[len(ordered) // 2] * by_text)


def main_text(html: str, limits: Limits = Limits()) -> str:
    page = [x for x in lines(html, limits) if not x.dead]
    places = [i for i, x in enumerate(page) if x.main or x.links <= limits.link_share * len(x.text)]
    found = [page[i] for i in places]
    if not found:
        return ""
    marked = any(x.main for x in found)
    weights = [len(x.text) * (1.0 if x.main or not marked else limits.outside) for x in found]
    total = [0.0, *accumulate(weights)]
    n = len(found)
    onward = [total[min(n, i + limits.window)] - total[i] for i in range(n)]
    back = [total[i + 1] - total[max(0, i + 1 - limits.window)] for i in range(n)]
    least = limits.surge * _level(onward)
    surge = next(i for i, s in enumerate(onward) if s >= least)
    dive = max(i for i, s in enumerate(back) if s >= least)
    of_part: dict[int, float] = {}
    for x, w in zip(found, weights, strict=True):
        of_part[x.part] = of_part.get(x.part, 0.0) + w

    def small(x: _Line) -> bool:
        return of_part[x.part] < least and not x.heading

    def beside(x: _Line, y: _Line) -> bool:
        return x.part == y.part or x.main and y.main

    inside = any(x.main for x in found[surge : dive + 1])  # then what is not of the article is not of the text
    while surge < dive and (not found[surge].main if inside else small(found[surge])):
        surge += 1
    while dive > surge and (not found[dive].main if inside else small(found[dive])):
        dive -= 1
    while surge > 0 and (beside(found[surge - 1], found[surge]) or found[surge - 1].heading and not marked):
        surge -= 1
    while dive + 1 < n and beside(found[dive + 1], found[dive]):
        dive += 1
    if inside:
        return " ".join(x.text for x in found[surge : dive + 1] if x.main)
    out = []
    for i, at in enumerate(places[surge : dive + 1], surge):
        out.append(found[i].text)
        # a line left out alone between two of its own part
        if i < dive and places[i + 1] == at + 2 and page[at + 1].part == page[at].part == page[at + 2].part:
            out.append(page[at + 1].text)
    return " ".join(out)


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", limits: Limits = Limits()) -> DataFrame:
    """``id, text`` for each row: the page's main text, its blocks in order with one space between.

    White space inside a block is one space, character references are decoded.  A
    missing or empty page, and one without main text, has the empty text.  Each row
    is judged by itself, so repeated rows are alike; ids are passed on as they are, an
    empty table gives an empty result, and other columns are not read.  Pages of any length
    and nesting are read whole, in time in proportion to their length.  No shuffle.
    """
    picked = pages.select(F.col(id_col).alias("id"), utf8(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, pages in text_blocks(batch.column("html")):
                texts = [main_text(x.decode("utf-8", "replace"), limits) for x in pages]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(texts, pa.string())], names=["id", "text"])

    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, text string")
