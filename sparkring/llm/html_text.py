"""Main text of web pages by line-block distribution.

A page is stripped to lines, one for each block element.  A line weighs as much as its text outside links, more inside an
article, and nothing where tags, roles or names say menu, header, footer, sidebar, notice, advert, form or comments; such
lines part those before and after them.  Weights are summed over a sliding window of lines; where the sum rises from nothing
is a surge point, where it falls back to nothing a dive point, and the text between them is a region.  Regions of one article,
and those that only left-out lines part inside one container, are joined.  Regions with a window that reaches a threshold are
kept, or else the heaviest one.

A name is only a hint: an element named so that holds the heart of the page (its main article, or its heading and a full
window of text) is taken for a wrapper, and where all text would go, the outermost named elements are taken for such.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 86  # weight of a window that a region needs
ARTICLE = 4  # a character of an article weighs so much

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: What stands between a tag's name and its end: whole quoted values, and anything else but quotes and the end.
_INSIDE = re.compile(r"""[^"'>]*+(?:"[^"]*+"[^"'>]*+|'[^']*+'[^"'>]*+)*+""")
_ATTRIBUTE = re.compile(r"""([^\s=/"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_WORD = re.compile(r"[a-z]+")
_LONG_NUMBER = re.compile(r"&#([0-9]{8,}+);?")

_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "select", "canvas", "head", "title"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_CONTAINERS = {
    "html", "body", "div", "section", "article", "main", "aside", "nav", "header", "footer", "form", "ul", "ol", "dl", "table", "tbody", "thead",
    "tfoot", "fieldset", "figure", "blockquote", "details", "dialog", "menu", "center", "td", "th", "tr", "li", "dd", "dt",
}
_BLOCKS = _CONTAINERS - {"td", "th"} | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "hr", "address", "figcaption", "caption", "summary", "legend", "option", "hgroup"}
#: Containers that bound what belongs together; the others only structure the text.
_BOXES = {"div", "article", "main", "td", "th", "fieldset"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_OUT_TAGS = {"nav", "footer", "aside", "menu", "dialog", "button"}
_OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
#: Words of class and id values that mark what is not the article.
_OUT_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "sponsors", "promo", "promotion", "banner",
    "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "footer", "masthead", "topbar", "cookie", "cookies", "consent",
    "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "social",
    "share", "sharing", "related", "recommended", "recommendations", "comment", "comments", "disqus", "reply", "replies", "respond", "pagination",
    "pager", "widget", "widgets", "toolbar", "skip",
}
#: Of these, words that mark an element at the end of any longer name.
_LAST_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "footer",
    "masthead", "topbar", "cookie", "cookies", "consent", "popup", "modal", "comment", "comments", "pagination", "widget", "widgets", "toolbar",
}
#: Words of longer names that say nothing about what is meant.
_FILLERS = {
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "col", "column", "container", "content", "entry", "form", "global", "group",
    "header", "holder", "icons", "inner", "item", "items", "label", "left", "links", "list", "main", "outer", "page", "panel", "post", "posts", "primary",
    "reader", "region", "right", "row", "secondary", "section", "site", "slot", "story", "stories", "text", "thread", "title", "top", "unit", "user",
    "wp", "wrap", "wrapper", "article", "articles", "zone",
}
#: Words after which a name tells of a state or a subject.
_STATES = {"has", "have", "no", "not", "with", "without", "is", "tag", "tags", "category", "cat", "topic", "type", "format", "layout", "theme", "author", "hide", "show"}

_PLAIN, _NAMED, _OUT, _HEADER = range(4)


@lru_cache(4096)
def named_out(name: str) -> bool:
    """Whether one class or id value marks what is not the article."""
    parts = _WORD.findall(name.lower())
    if not _STATES.isdisjoint(parts):
        return False
    core = [x for x in parts if x not in _FILLERS]
    return bool(core) and (_OUT_WORDS.issuperset(core) or core[-1] in _LAST_WORDS)


def _decoded(text: str) -> str:
    """Character references decoded; numbers of many digits too, of which the library takes only so many."""
    if "&" not in text:
        return text
    return html.unescape(_LONG_NUMBER.sub(lambda m: f"&#{m[1].lstrip('0')[:8] or '0'};", text))


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), _decoded(double or single or bare))
    return out


def _kind(tag: str, raw: str) -> int:
    """What a tag and its attributes say of an element."""
    if tag in _OUT_TAGS:
        return _OUT
    named = _NAMED if tag == "form" else _HEADER if tag == "header" else _PLAIN
    if not raw.strip() or tag in ("html", "body"):
        return named
    own = _attributes(raw)
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or "display:none" in own.get("style", "").replace(" ", "").lower():
        return _OUT
    if own.get("role", "").lower() in _OUT_ROLES:
        return _NAMED if tag == "form" else _OUT
    if any(map(named_out, own.get("class", "").split())) or any(map(named_out, own.get("id", "").split())):
        return _NAMED
    return named


@dataclass
class Element:
    """An element that may bound or mark text; elements are numbered in page order, and `last` is its last descendant."""

    tag: str
    kind: int
    parent: int
    last: int = 0


@dataclass
class Line:
    text: str
    plain: int  # characters but spaces, outside links
    linked: int  # the same inside links
    element: int
    heading: bool


@dataclass
class _Page:
    lines: list[Line] = field(default_factory=list)
    elements: list[Element] = field(default_factory=lambda: [Element("", _PLAIN, 0)])
    parts: list[str] = field(default_factory=list)
    stack: list[int] = field(default_factory=lambda: [0])
    open: dict[str, int] = field(default_factory=dict)  # how many of a tag are on the stack
    linked: int = 0
    links: bool = False
    heading: bool = False

    def text(self, raw: str) -> None:
        if raw:
            self.parts.append(raw)
            if self.links:
                self.linked += len("".join(_decoded(raw).split()))

    def line(self) -> None:
        if self.parts:
            text = " ".join(_decoded("".join(self.parts)).split())
            if text:
                size = len(text) - text.count(" ")
                linked = min(size, self.linked)
                self.lines.append(Line(text, size - linked, linked, self.stack[-1], self.heading))
            self.parts, self.linked = [], 0

    def push(self, tag: str, kind: int) -> None:
        self.elements.append(Element(tag, kind, self.stack[-1]))
        self.stack.append(len(self.elements) - 1)
        self.open[tag] = self.open.get(tag, 0) + 1

    def drop(self) -> None:
        own = self.elements[self.stack.pop()]
        own.last = len(self.elements) - 1
        self.open[own.tag] -= 1

    def pop(self, tag: str) -> None:
        """Close the innermost element of this tag, and what is open in it."""
        if self.open.get(tag):
            while self.elements[self.stack[-1]].tag != tag:
                self.drop()
            self.drop()

    def start(self, tag: str, raw: str) -> None:
        if tag in _BLOCKS:
            self.line()
            self.links = self.heading = False
            while len(self.stack) > 1 and self.elements[self.stack[-1]].tag not in _CONTAINERS:  # a block ends an open paragraph
                self.drop()
        elif tag in ("br", "td", "th"):
            self.parts.append(" ")
        if tag == "a":
            self.links = True
        if tag in _HEADINGS:
            self.heading = True
        if tag not in _VOID:
            kind = _kind(tag, raw)
            if kind or tag in _CONTAINERS or tag == "p":
                if kind == _OUT or kind == _NAMED:
                    self.line()
                self.push(tag, kind)

    def end(self, tag: str) -> None:
        if tag in _BLOCKS:
            self.line()
        elif tag in ("td", "th"):
            self.parts.append(" ")
        if tag == "a":
            self.links = False
        if tag in _HEADINGS:
            self.heading = False
        if self.open.get(tag) and self.elements[self.stack[-1]].kind:
            self.line()
        self.pop(tag)


def strip(page: str) -> tuple[list[Line], list[Element]]:
    """The lines of a page and its elements.  Every character is looked at a fixed number of times."""
    own, at, size = _Page(), 0, len(page)
    unclosed: set[str] = set()  # raw elements that do not end any more
    quoted = True  # until a quotation does not end: from there on a tag ends at the next bracket
    while (begin := page.find("<", at)) >= 0:
        name = _NAME.match(page, begin + 1 + page.startswith("/", begin + 1))
        if name is None:
            if page.startswith(("<!", "<?"), begin):
                own.text(page[at:begin])
                if page.startswith("<![CDATA[", begin):
                    end = page.find("]]>", begin)
                    own.text(html.escape(page[begin + 9 : end if end >= 0 else size]))
                    at = end + 3 if end >= 0 else size
                else:
                    mark = "-->" if page.startswith("<!--", begin) else ">"
                    end = page.find(mark, begin)
                    at = end + len(mark) if end >= 0 else size
            else:
                own.text(page[at : begin + 1])
                at = begin + 1
            continue
        stop = -1
        if quoted:
            stop = _INSIDE.match(page, name.end()).end()
            if not page.startswith(">", stop):
                quoted, stop = False, -1
        if stop < 0:
            stop = page.find(">", name.end())
        if stop < 0:  # no tag ends any more
            break
        own.text(page[at:begin])
        tag, raw, at = name[0].lower(), page[name.end() : stop], stop + 1
        if name.start() > begin + 1:
            own.end(tag)
        elif tag not in _RAW:
            own.start(tag, raw)
        elif not raw.rstrip().endswith("/") and tag not in unclosed:
            close = re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(page, at)
            if close:
                at = close.end()
            elif tag in ("head", "title", "select"):
                unclosed.add(tag)
            else:
                at = size
    own.text(page[at:])
    own.line()
    while len(own.stack) > 1:
        own.drop()
    own.elements[0].last = len(own.elements) - 1
    return own.lines, own.elements


def _heaviest(weights: list[int], window: int) -> int:
    """The largest sum of a window."""
    total = np.append(0, np.cumsum(weights))
    return int((total[window:] - total[:-window]).max()) if len(weights) > window else int(total[-1])


class _Layout:
    """What lines weigh, given the elements around them."""

    def __init__(self, lines: list[Line], elements: list[Element], window: int, surge: int):
        self.lines, self.elements, self.window, self.surge = lines, elements, window, surge
        n = len(elements)
        self.kind = [e.kind for e in elements]
        self.box, self.context, names = [0] * n, [0] * n, [0] * n  # innermost box; article, or else <main>; named elements around
        hard = [False] * n
        for i, e in enumerate(elements[1:], 1):
            p = e.parent
            self.box[i] = i if e.tag in _BOXES else self.box[p]
            inner = elements[self.context[p]].tag
            self.context[i] = i if e.tag == "article" and inner != "article" or e.tag == "main" and not inner else self.context[p]
            names[i] = names[p] + (e.kind == _NAMED)
            hard[i] = hard[p] or e.kind == _OUT
        plain = [0] * n
        for x in lines:
            plain[x.element] += x.plain
        for i in range(n - 1, 0, -1):
            plain[elements[i].parent] += plain[i]
        self.plain = plain
        articles = [i for i, e in enumerate(elements) if e.tag in ("article", "main") and e.kind == _PLAIN and not hard[i] and plain[i]]
        titles = [x.element for x in lines if x.heading and not hard[x.element] and all(elements[e].kind != _HEADER for e in (x.element, elements[x.element].parent))]
        heart = min(articles, key=lambda i: (names[i], -plain[i])) if articles else min(titles, key=lambda i: names[i]) if titles else 0
        while heart:  # what is named around the heart is a wrapper; without an article, if it holds a full window
            if self.kind[heart] == _NAMED and (articles or plain[heart] >= surge):
                self.kind[heart] = _PLAIN
            heart = elements[heart].parent
        self.weigh()
        while not any(self.weight) and self.unwrap():
            self.weigh()

    def unwrap(self) -> bool:
        """Take the outermost named elements that hold a full window for wrappers."""
        out, skip = False, 0
        for i, e in enumerate(self.elements):
            if i <= skip:
                continue
            if self.kind[i] == _OUT:
                skip = e.last
            elif self.kind[i] == _NAMED:
                if self.plain[i] >= self.surge:
                    self.kind[i], out = _PLAIN, True
                skip = e.last
        return out

    def weigh(self) -> None:
        n = len(self.elements)
        level = [0] * n  # 2: all is out, 1: all but headings
        for i, e in enumerate(self.elements[1:], 1):
            own = self.kind[i]
            level[i] = max(level[e.parent], 2 if own in (_NAMED, _OUT) else 0 if own != _HEADER else 1 if self.context[i] else 2)
        self.out = [level[x.element] == 2 or level[x.element] == 1 and not x.heading for x in self.lines]
        full = {self.context[x.element] for x, out in zip(self.lines, self.out, strict=True) if not out and self.context[x.element]}
        holds = {self.context[self.elements[c].parent] for c in full if self.elements[c].tag == "article"} - {0}  # a <main> with articles in it
        inside = [self.context[x.element] not in (0, *holds) for x in self.lines]
        self.weight = [
            0 if out else ARTICLE * (x.plain + -(-x.linked // 2)) if own else x.plain for x, out, own in zip(self.lines, self.out, inside, strict=True)
        ]
        own = [w for x, w in zip(self.lines, self.weight, strict=True) if w and self.context[x.element] and x.plain]
        if own and _heaviest(own, self.window) >= self.surge:  # the page marks its article: what is around it weighs nothing
            self.out = [o or not self.context[x.element] for x, o in zip(self.lines, self.out, strict=True)]
            self.weight = [0 if o else w for w, o in zip(self.weight, self.out, strict=True)]

    def regions(self) -> list[list[int]]:
        """Lines between surge and dive points, region by region."""
        slots: list[int] = []  # lines in order, with a window of empty ones (-1) where lines are left out and between articles
        for k, out in enumerate(self.out):
            if slots and slots[-1] >= 0 and (out or self.apart(slots[-1], k)):
                slots += [-1] * self.window
            if not out:
                slots.append(k)
        n = len(slots)
        total = np.append(0, np.cumsum([self.weight[k] if k >= 0 else 0 for k in slots], dtype=np.int64))
        # The window that ends with a line and the one that begins with it: a line lies between surge and dive if both hold text.
        ahead = total[np.minimum(np.arange(n) + self.window, n)] - total[:n]
        behind = total[1:] - total[np.maximum(np.arange(1, n + 1) - self.window, 0)]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], ((ahead > 0) & (behind > 0)).astype(np.int8), [0]])))
        found = [[k for k in slots[a:b] if k >= 0] for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
        return self.joined([x for x in found if x])

    def apart(self, a: int, b: int) -> bool:
        """Whether lines belong to different articles, of which none holds the other."""
        one, two = sorted(self.context[self.lines[k].element] for k in (a, b))
        return 0 < one < two and two > self.elements[one].last

    def joined(self, found: list[list[int]]) -> list[list[int]]:
        held = [0] * len(self.elements)
        for x, out in zip(self.lines, self.out, strict=True):
            held[x.element] += not out
        for i in range(len(held) - 1, 0, -1):
            held[self.elements[i].parent] += held[i]
        outer: dict[int, int] = {0: 0}

        def own(k: int) -> int:  # a box that holds one line is a paragraph
            box, way = self.box[self.lines[k].element], []
            while box not in outer and held[box] == 1 and self.context[box] != box:
                way.append(box)
                box = self.box[self.elements[box].parent]
            end = outer.setdefault(box, box)
            outer.update(dict.fromkeys(way, end))
            return end

        def around(box: int, k: int) -> bool:
            return box > 0 and box <= self.lines[k].element <= self.elements[box].last

        out: list[list[int]] = []
        for region in found:
            if out:
                a, b = out[-1][-1], region[0]
                one, two = (self.box[self.lines[k].element] for k in (a, b))
                context = self.context[self.lines[a].element]
                same = one == two or own(a) == own(b) or around(one, b) or around(two, a)
                if context and context == self.context[self.lines[b].element] or same and sum(not x for x in self.out[a + 1 : b]) < self.window:
                    out[-1] += [k for k in range(a + 1, b) if not self.out[k]] + region
                    continue
            out.append(region)
        return out


def blocks(page: str | None, window: int = WINDOW, surge: int = SURGE) -> list[str]:
    """The main text's blocks in page order."""
    if not page:
        return []
    found, elements = strip(page)
    if not found:
        return []
    layout = _Layout(found, elements, window, surge)
    regions = layout.regions()
    if not regions:
        return []
    full = [r for r in regions if _heaviest([layout.weight[k] for k in r], window) >= surge]
    full = full or [max(regions, key=lambda r: sum(layout.weight[k] for k in r))]
    return [found[k].text for r in full for k in r]


def main_text(page: str | None) -> str:
    return "\n\n".join(blocks(page))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Null and empty html, and pages without main text, give the empty text.  Time is in proportion to a page's length.  Rows are kept as they are, null or repeated
    page_ids included; other columns are not read.  One pass, no shuffle; memory follows the longest page.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_run, "page_id long, url string, text string, n_chars long")
