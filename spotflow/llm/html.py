"""Main text of web pages by line-block distribution.

Markup is stripped first: tags that end a line end a block, and what belongs to menus, notices,
adverts, forms, scripts and the like by its element, role or class is left out. Every remaining line
has a weight: its characters outside links, or half its characters if its links are as long as sentences. Sums of weights over
sliding windows of lines rise steeply where dense text begins (surge) and fall to nothing where it ends (dive); the lines
from a surge to its dive are dense. One rule with the same thresholds holds for all lines of a page.

Markup then is evidence about the lines at the edges of dense text. The container that a line stands in directly (a
div, a section, an article) tells whether a short line belongs to the dense text beside it: the lines of a container
with dense text stay, headings before it too, and short lines between two that stay. A container whose dense text is a
small share of that of the densest one is a box beside the text and goes, as does all that stands outside of article and main
elements where these hold more dense text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from spotflow.llm.text import slices

#: Lines in a window, the sum at which text surges, and the sum at which it has dived.
WINDOW, SURGE, DIVE = 3, 120, 25
#: Characters from which on a link is a sentence, and the part of the densest container's text that makes another one text.
SENTENCE, SHARE = 25, 0.25

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|iframe|textarea|title|svg|object|select)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<[!?/][^>]*+>|</?[a-zA-Z][^>]*+>",
    re.S | re.I,
)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img label".split())
#: Elements that are lines, not containers of lines.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre td th tr caption figcaption summary br hr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no main text, wherever they stand; head only holds what describes the page.
APART = frozenset("nav aside footer form head menu dialog button fieldset datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog".split())
#: Words of class and id names that mark what is not main text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentary consent cookie cookies disqus footer header "
    "masthead menu menus modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion promotions related recommended "
    "replies reply respond share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets".split()
)
NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Words that a class or id name may have beside marks and still name the part itself; with any other word
#: (comment-free, social-impact, has-sidebar) the name says what the element is about.
PARTS = frozenset(
    "area article bar block body bottom box button buttons card container content entry footer form group header icon icons inner item items left link links list main "
    "module outer page panel post posts primary reader readers right row section secondary site slot strip text thread top unit user users wrap wrapper".split()
)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _names_mark(name: str, ignored: str = "") -> bool:
    """Whether a class or id name consists of marks and of words for parts of a page, with at least one mark."""
    words = [w.lower() for w in WORDS.findall(name)]
    marks = [w for w in words if w in MARKS and w != ignored]
    return bool(marks) and all(w in MARKS or w in PARTS for w in words)


def _is_apart(name: str, attrs: str, inside: bool) -> bool:
    """Whether an element is not main text; inside: it stands in an article or main element, where a header
    belongs to the text."""
    if name in APART or (name == "header" and not inside):
        return True
    if name in ("main", "body", "html") or name in INLINE:
        return False
    for kind, a, b, c in NAMES.findall(attrs) if attrs else ():
        for value in (a or b or c).split():
            if value.lower() in ROLES if kind.lower() == "role" else _names_mark(value, "header" if inside else ""):
                return True
    return False


class Line(NamedTuple):
    """A block's text, its characters in links and their number, the containers around it from the outermost in, whether one is
    an article or main element, and whether it is a heading."""

    text: str
    linked: int
    links: int
    within: tuple[int, ...]
    inside: bool
    heading: bool

    @property
    def weight(self) -> int:
        if self.linked * 2 <= len(self.text):
            return len(self.text) - self.linked
        return len(self.text) // 2 if self.linked >= SENTENCE * max(1, self.links) else 0


def lines_of(html: str) -> list[Line]:
    """The lines of a page that may be main text, in page order."""
    out: list[Line] = []
    parts: list[str] = []
    linked = links = at = 0
    apart, nested = "", 0  # the element that is left out, and how many of its name are open in it
    main = boxes = in_link = 0
    heading = False
    stack: list[tuple[str, int]] = [("", 0)]

    def end() -> None:
        nonlocal linked, links
        text = " ".join(unescape("".join(parts)).split())
        if text:
            out.append(Line(text, min(linked, len(text)), links, tuple(i for _, i in stack), main > 0, heading))
        parts.clear()
        linked = links = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not apart:
            parts.append(piece)
            if in_link:
                linked += len(piece)

    for m in TAG.finditer(html):
        add(html[at : m.start()])
        at = m.end()
        name = (m.group(3) or "").lower()
        if not name:
            if m.group().startswith("<![CDATA["):
                continue
            if m.group(1) and m.group(1).lower() not in INLINE:
                end()
            continue
        closing, attrs = m.group(2) == "/", m.group(4)
        single = name in VOID or attrs.endswith("/")
        if apart:
            if name == apart:
                nested += -1 if closing else 0 if single else 1
                if nested == 0:
                    apart = ""
            elif name in ("article", "main", "body") and not closing and apart in ("nav", "head", "div", "header", "form"):
                apart = ""  # what was left open before the article ends with it
            if apart:
                continue
            if closing:
                continue
        if name not in INLINE:
            end()
            heading = not closing and len(name) == 2 and name[0] == "h" and name[1] in "123456"
        if not closing and not single and _is_apart(name, attrs, main > 0):
            end()
            apart, nested = name, 1
            continue
        if name in ("article", "main"):
            main = max(0, main + (-1 if closing else 1))
        elif name == "a":
            in_link = 0 if closing else 1
            links += not closing
        if name not in INLINE and name not in BLOCKS and not single:
            if not closing:
                boxes += 1
                stack.append((name, boxes))
            elif any(n == name for n, _ in stack):
                while stack.pop()[0] != name:
                    pass
    add(html[at:])
    end()
    return out


def _dense(weights: list[int]) -> list[bool]:
    """Which lines lie between a surge and its dive: from where the sum of a line and those after it reaches SURGE to
    where it is at most DIVE."""
    ahead = np.convolve(np.array(weights, dtype=np.int64), np.ones(WINDOW, dtype=np.int64))[WINDOW - 1 :]
    kept, i = [False] * len(weights), 0
    while i < len(weights):
        if not weights[i] or ahead[i] < SURGE:
            i += 1
            continue
        while i < len(weights) and ahead[i] > DIVE:
            kept[i] = weights[i] > 0
            i += 1
    return kept


def main_lines(lines: list[Line]) -> list[str]:
    """The lines of the main text, by surge and dive points and the containers of the lines between them."""
    if not lines:
        return []
    weights = [line.weight for line in lines]
    dense = _dense(weights)
    total: dict[int, int] = {}
    inside = outside = 0
    for line, w, d in zip(lines, weights, dense):
        if d and w > DIVE:
            total[line.within[-1]] = total.get(line.within[-1], 0) + w
            inside, outside = inside + w * line.inside, outside + w * (not line.inside)
    if not total:  # nothing surges on a short page: the text of its elements, else all of its text outside links
        element = any(line.inside for line in lines)
        return [line.text for line, w in zip(lines, weights) if (line.inside if element else w > 0)]
    usable = {line.within[-1]: line.inside or outside > inside for line in lines}
    most = max(w for box, w in total.items() if usable[box])
    strong = {box for box, w in total.items() if usable[box] and w >= SHARE * most}
    kept = [bool(strong.intersection(line.within)) and (w > 0 or line.heading) and (line.within[-1] in strong or d or line.heading) for line, w, d in zip(lines, weights, dense)]
    runs = [i for i, k in enumerate(kept) if k]
    # headings before the text
    first = runs[0]
    while first and lines[first - 1].heading and usable[lines[first - 1].within[-1]]:
        first -= 1
        kept[first] = True
    # what stands between lines that stay, stays, but for boxes of their own outside the text's containers
    runs = [i for i, k in enumerate(kept) if k]
    for a, b in zip(runs, runs[1:]):
        for i in range(a + 1, b):
            kept[i] = kept[i] or bool(strong.intersection(lines[i].within))
    # fewer lines of links than a window behind the text are its last lines, more are a list of links
    last, behind = runs[-1] + 1, runs[-1] + 1
    while behind < len(lines) and lines[behind].within[-1] in strong:
        behind += 1
    if behind - last < WINDOW:
        kept[last:behind] = [True] * (behind - last)
    return [line.text for line, k in zip(lines, kept) if k]


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """pages with its main text in `text` (an input column of that name is replaced). White space in a
    block becomes one space, blocks are joined by one space in page order, character references are
    decoded. Null or empty html, and html without any text, give an empty string. Without an article or main element
    the dense containers alone decide; with several, all that have dense text stay."""
    kept = pages.drop(text) if text != html else pages
    schema = T.StructType([*kept.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html):
            found = [" ".join(main_lines(lines_of(h))) if h else "" for h in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, text])

    return kept.mapInArrow(run, schema)
