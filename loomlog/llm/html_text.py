"""Layout-aware text of HTML pages: all that a reader would see, with the blocks where they stand.

A tree builder reads the tags, closes what HTML closes by itself and opens what it implies. Its stack of
open elements is all it keeps, so deep or broken nesting costs no recursion. Visibility rules drop
what is not shown. The renderer collapses white space, separates blocks by lines and paragraphs by
blank lines, indents lists under their markers and aligns the cells of tables.

Nulls and empty pages give an empty text; null ids and repeated rows are kept; an empty table gives no
rows. Columns other than the id and the html are not read. Texts are whole: column padding stops at
`WIDEST` characters and indents at `DEEPEST` levels, text does not. Tables of any size are aligned.
Elements may be nested to any depth; the innermost open one of a name is looked up, not searched for.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from heapq import merge
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomlog.llm.common import pick, table, texts

WIDEST, DEEPEST = 80, 40

# Names of the HTML standard.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
UNSEEN = {"script", "style", "title", "template", "noscript", "iframe", "noembed", "noframes", "object", "audio", "video", "canvas", "datalist"}
PARAGRAPHS = {"plaintext", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "menu", "dir", "blockquote", "pre", "xmp", "table", "figure"}
BLOCKS = PARAGRAPHS | {"address", "article", "aside", "center", "details", "dialog", "div", "dd", "dt", "fieldset", "figcaption", "footer",
                       "form", "header", "hgroup", "hr", "legend", "li", "main", "nav", "optgroup", "option", "search", "section", "summary"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
FORMATTING = {"a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u"}
LISTS = {"ul", "ol", "menu", "dir"}
CELLS = {"td", "th", "caption"}
SECTIONS = {"tbody", "thead", "tfoot"}
CLOSES_P = BLOCKS - {"option", "optgroup", "legend"}
SCOPES = CELLS | {"table", "template", "object", "button", "marquee", "applet"}

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/](?![a-zA-Z])[^>]*+>?|<[!?][^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_UNSEEN_STYLE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
#: Inputs that show no value.
_BARE = {"hidden", "checkbox", "radio", "file", "image", "color", "range", "password"}
_SPACE = re.compile(r"[ \t\n\r\f]+")


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape(m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""))
    return out


def _number(text: str | None, otherwise: int, most: int = 1 << 31) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", text or "")
    return min(int(m[1]), most) if m else otherwise


class Flow:
    """Lines of one flow of blocks: the page, or a cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0
        self.indents: list[list[str]] = []

    def text(self, text: str) -> None:
        words = _SPACE.sub(" ", text)
        if words.startswith(" "):
            self.space, words = True, words[1:]
        if words:
            if self.space and self.line and not self.line[-1].endswith("\n"):
                self.line.append(" ")
            self.space = words.endswith(" ")
            self.line.append(words[:-1] if self.space else words)

    def kept(self, text: str) -> None:
        """Text whose white space stays."""
        first, *rest = text.replace("\r\n", "\n").split("\n")
        self._add(first)
        for line in rest:
            self.end(always=True)
            self._add(line)

    def _add(self, text: str) -> None:
        if text:
            if self.space and self.line:
                self.line.append(" ")
            self.space = False
            self.line.append(text)

    def end(self, always: bool = False) -> None:
        """End the line if it holds something."""
        if self.line or always:
            self.put("".join(self.line))
            self.line = []
        self.space = False

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = 0
        indent = ""
        for level in self.indents[:DEEPEST]:
            indent += level[0]
            level[0] = level[1]
        self.lines.append((indent + line).rstrip(" "))

    def block(self, gap: int = 0) -> None:
        self.end()
        self.gap = max(self.gap, gap)

    def whole(self) -> list[str]:
        self.end()
        return self.lines


class Grid:
    """Rows of an open table. Room that cells of earlier rows take is kept as ranges of columns."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.captions: list[str] = []
        # (first column, behind the last one, rows left) of cells over several rows, from left to right.
        self.taken: list[tuple[int, int, int]] = []
        self.more: list[tuple[int, int, int]] = []
        self.next = 0

    def row(self) -> None:
        self.rows.append([])
        left = [(a, b, n - 1) for a, b, n in merge(self.taken, self.more) if n > 1]
        # Neighbours that both reach below any row still to come are one.
        self.taken, self.more, self.next = [], [], 0
        for a, b, n in left:
            if self.taken and self.taken[-1][1] == a and self.taken[-1][2] == n:
                self.taken[-1] = (self.taken[-1][0], b, n)
            else:
                self.taken.append((a, b, n))

    def cell(self, lines: list[str], across: int, down: int) -> None:
        if not self.rows:
            self.row()
        row = self.rows[-1]
        at = row[-1][0] + row[-1][1] if row else 0
        while self.next < len(self.taken) and self.taken[self.next][0] <= at:
            at = max(at, self.taken[self.next][1])
            self.next += 1
        row.append((at, across, lines))
        if down > 1:
            self.more.append((at, at + across, down))

    def lines(self) -> list[str]:
        """Cells under each other in columns; a cell over several columns takes their room."""
        used = sorted({at for row in self.rows for at, _, _ in row})
        place = {at: i for i, at in enumerate(used)}
        widths = [0] * len(used)
        for row in self.rows:
            for at, across, lines in row:
                if across == 1:
                    widths[place[at]] = max([widths[place[at]], *(len(x) for x in lines if len(x) <= WIDEST)])
        out = list(self.captions)
        # A row without any cell, and where each column begins in it.
        blank, begins = "".join(" " * w + " | " for w in widths), [0, *accumulate(w + 3 for w in widths)]
        for row in self.rows:
            spots, end = [], 0
            for at, across, lines in row:
                first, stop = place[at], bisect_left(used, at + across, place[at] + 1)
                spots.append((blank[begins[end]:begins[first]] if end < first else "", lines,
                              min(begins[stop] - begins[first] - 3, 4 * WIDEST), " | " if at != row[-1][0] else ""))
                end = stop
            for i in range(max((len(lines) for _, _, lines in row), default=0)):
                line = [gap + (lines[i] if i < len(lines) else "").ljust(room) + mark for gap, lines, room, mark in spots]
                out.append("".join(line).rstrip(" "))
        return out


class Page:
    """Tree builder and renderer of one page."""

    def __init__(self) -> None:
        self.flows = [Flow()]
        self.grids: list[Grid] = []
        # Open elements by a running number: name, what it adds to `unseen`, attributes, seen when it was entered.
        self.open: dict[int, tuple[str, int, dict[str, str], bool]] = {}
        self.places: dict[str, list[int]] = defaultdict(list)
        self.opened = 0
        self.unseen = 0  # open elements that are not rendered, with all that is in them
        self.visible: dict[int, bool] = {}  # open elements that set the visibility, which others inherit
        self.shut: set[int] = set()  # closed details whose summary is still to come
        self.again: dict[str, list[dict[str, str]]] = {}
        self.numbers: list[int | None] = []

    # -- tree --

    def innermost(self, names: set[str]) -> int:
        """Number of the innermost open element of these names, 0 if there is none."""
        return max((at[-1] for name in names if (at := self.places.get(name))), default=0)

    def has(self, names: set[str], scope: set[str]) -> bool:
        found = self.innermost(names)
        return found > 0 and found >= self.innermost(scope)

    def last(self) -> str:
        return self.open[next(reversed(self.open))][0]

    def seen(self) -> bool:
        return not self.unseen and (not self.visible or self.visible[next(reversed(self.visible))])

    def pop(self) -> tuple[str, int, dict[str, str], bool]:
        number, element = self.open.popitem()
        name, unseen, attributes, seen = element
        self.places[name].pop()
        self.leave(name, attributes, seen)
        self.unseen -= unseen
        self.visible.pop(number, None)
        self.shut.discard(number)
        return element

    def pop_to(self, names: set[str]) -> None:
        """Close up to the innermost of `names`; hidden formatting that is cut off goes on after it."""
        while self.open:
            name, unseen, attributes, _ = self.pop()
            if name in names:
                return
            # Three of a kind go on at most, as the standard has it.
            if name in FORMATTING and (unseen or _VISIBILITY.search(attributes.get("style", ""))) and len(self.again.get(name, ())) < 3:
                self.again.setdefault(name, []).append(attributes)

    def start(self, name: str, raw: str) -> None:
        attributes = _attributes(raw) if raw else {}
        if name in ("html", "head", "body"):
            return
        if name in CLOSES_P and self.has({"p"}, SCOPES):
            self.pop_to({"p"})
        if name in HEADINGS and self.open and self.last() in HEADINGS:
            self.pop()
        if name == "li" and self.has({"li"}, SCOPES | LISTS):
            self.pop_to({"li"})
        elif name in ("dd", "dt") and self.has({"dd", "dt"}, SCOPES | {"dl"}):
            self.pop_to({"dd", "dt"})
        elif name in ("option", "optgroup") and self.open and self.last() == "option":
            self.pop()
        elif name in CELLS | SECTIONS | {"tr", "col", "colgroup"}:
            if not self.has({"table"}, {"template"}):
                return
            inner = CELLS if name in CELLS else CELLS | {"tr"} if name == "tr" else CELLS | SECTIONS | {"tr"}
            while self.has(inner, {"table"}):
                self.pop_to(inner)
            while self.last() not in SECTIONS | {"tr", "table"}:
                self.pop()
            if name in ("td", "th"):
                if not self.has({"tr"}, {"table"}):
                    self.start("tr", "")
            elif name == "tr" and not self.has(SECTIONS, {"table"}):
                self.push("tbody", {})
        elif name == "table" and self.open and self.last() in SECTIONS | {"tr", "table"}:
            pass
        if name in ("button", "a") and self.has({name}, SCOPES - {"button"}):
            self.pop_to({name})
        self.push(name, attributes)
        if name in VOID:
            self.pop()

    def push(self, name: str, attributes: dict[str, str]) -> None:
        style = attributes.get("style", "")
        unseen = int(name in UNSEEN or "hidden" in attributes or (name == "dialog" and "open" not in attributes) or (
            name == "input" and attributes.get("type", "").lower() == "hidden") or bool(_UNSEEN_STYLE.search(style)))
        parent = next(reversed(self.open), 0)
        if name == "summary" and parent in self.shut:
            self.shut.discard(parent)
            unseen -= 1
        self.unseen += unseen
        self.opened += 1
        number = self.opened
        if m := _VISIBILITY.search(style):
            self.visible[number] = m[1].lower() == "visible"
        self.open[number] = name, unseen, attributes, not self.unseen
        self.places[name].append(number)
        self.enter(name, attributes)
        if name == "details" and "open" not in attributes:
            # Nothing in it is rendered but its first summary.
            self.unseen += 1
            self.open[number] = name, unseen + 1, attributes, self.open[number][3]
            self.shut.add(number)

    def close(self, name: str) -> None:
        if name == "br":
            self.start("br", "")
        elif name == "p" and not self.has({"p"}, SCOPES):
            self.start("p", "")
            self.pop()
        elif name in FORMATTING or name == "span":
            self.again.pop(name, None)
            if self.has({name}, SCOPES):
                # Blocks that began inside stay open.
                number = self.places[name].pop()
                self.unseen -= self.open.pop(number)[1]
                self.visible.pop(number, None)
        elif name in HEADINGS:
            if self.has(HEADINGS, SCOPES):
                self.pop_to(HEADINGS)
        elif self.has({name}, {"table", "template"} - {name} if name in CELLS | SECTIONS | {"tr", "table"} else SCOPES - {name}):
            self.pop_to({name})

    # -- rendering --

    def enter(self, name: str, attributes: dict[str, str]) -> None:
        flow, seen = self.flows[-1], self.seen()
        if self.unseen:
            if name == "table":
                self.grids.append(Grid())
            elif name in CELLS:
                self.flows.append(Flow())
            elif name in LISTS:
                self.numbers.append(None)
            return
        if name == "br":
            flow.end(always=seen)
        elif name == "hr":
            flow.block()
            if seen:
                flow.put("---")
        elif name == "input" and seen and attributes.get("type", "").lower() not in _BARE:
            flow.text(attributes.get("value", ""))
        elif name == "table":
            self.grids.append(Grid())
        elif name == "tr":
            self.grids[-1].row()
        elif name in CELLS:
            self.flows.append(Flow())
        elif name in BLOCKS:
            nested = name in LISTS and bool(self.numbers)
            flow.block(1 if name in PARAGRAPHS and not nested else 0)
            if name in LISTS:
                self.numbers.append(_number(attributes.get("start"), 1) if name == "ol" else None)
            elif name == "li":
                self._marker(attributes)
            elif name in ("blockquote", "dd"):
                flow.indents.append(["  ", "  "])

    def _marker(self, attributes: dict[str, str]) -> None:
        marker = "- "
        if self.numbers and self.numbers[-1] is not None:
            number = _number(attributes.get("value"), self.numbers[-1])
            self.numbers[-1] = number + 1
            marker = f"{number}. "
        self.flows[-1].indents.append([marker if self.seen() else " " * len(marker), " " * len(marker)])

    def leave(self, name: str, attributes: dict[str, str], seen: bool) -> None:
        """Undo what `enter` did: an element that was not rendered then, by formatting that has ended since,
        shows nothing of its own. What is invisible only still takes its place."""
        if name == "table":
            lines = self.grids.pop().lines()
            flow = self.flows[-1]
            if seen and lines:
                flow.block(1)
                for line in lines:
                    flow.put(line)
                flow.block(1)
        elif name in CELLS:
            lines = self.flows.pop().whole()
            if seen:
                if name == "caption":
                    self.grids[-1].captions += lines
                else:
                    across, down = (max(1, _number(attributes.get(a), 1, most)) for a, most in (("colspan", 1000), ("rowspan", 65534)))
                    self.grids[-1].cell(lines, across, down)
        elif name in LISTS:
            self.numbers.pop()
            if seen:
                self.flows[-1].block(0 if self.numbers else 1)
        elif not seen:
            return
        elif name in BLOCKS:
            flow = self.flows[-1]
            if name == "li" or name in ("blockquote", "dd"):
                if name == "li" and not flow.line and flow.indents and flow.indents[-1][0] != flow.indents[-1][1]:
                    flow.put("")
                flow.end()
                flow.indents.pop()
            flow.block(1 if name in PARAGRAPHS else 0)

    def text(self, text: str) -> None:
        for name, lost in list(self.again.items()):
            for attributes in lost:
                self.push(name, attributes)
        self.again = {}
        if not text or not self.seen():
            return
        if self.innermost({"pre", "textarea", "xmp", "listing", "plaintext"}):
            self.flows[-1].kept(text)
        else:
            self.flows[-1].text(text)

    def read(self, source: str) -> str:
        at = 0
        while at < len(source):
            m = _TOKEN.search(source, at)
            if m is None:
                self.text(html.unescape(source[at:]))
                break
            if m.start() > at:
                self.text(html.unescape(source[at : m.start()]))
            at = max(m.end(), m.start() + 1)
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                self.close(name)
                continue
            self.start(name, m[3].strip())
            if name == "plaintext":
                self.text(source[at:])
                break
            if name in RAW:
                end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(source, at)
                inside = source[at : end.start() if end else len(source)]
                self.text(html.unescape(inside) if name == "textarea" else inside)
                at = end.start() if end else len(source)
            elif name in ("pre", "listing") and source.startswith("\n", at):
                at += 1
        while self.open:
            self.pop()
        return "\n".join(self.flows[0].whole())


def rendered(source: str) -> str:
    return Page().read(source)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text) of every page."""
    kind = dict(pages.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({id_col: batch.column(id_col), "text": [rendered(x) for x in texts(batch, html_col)]})

    return pick(pages, id_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of all pages."""
    return extract(table(spark, sf_dir, "pages"))
