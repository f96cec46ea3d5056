"""HTML to text as it is laid out.

A tree builder reads the tags, adds the end tags that HTML leaves out and drops what is never shown.
select, math and svg are dropped too, though browsers show them: their text isn't running text.
A renderer then writes the tree: block elements on lines of their own with blank lines around
paragraphs, items of lists behind their marks, cells of tables in aligned columns.
"""

from __future__ import annotations

import heapq
import html
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Generator, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, spread, table

#: What starts with <! or <? and isn't a tag: comments, declarations, instructions.
_ASIDE = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)", re.S)
_TAG, _NAME_END, _SPECIAL = re.compile(r"<(/?)[a-zA-Z]"), re.compile(r"[\s/>]"), re.compile("[>\"']")
#: Characters from the left up to which lines are indented and columns aligned; what would stand further right follows two spaces apart.
WIDE = 1000
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_BLANKS = re.compile(r"[ \t\n\r\f]+")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)

# Fixed values of the HTML standard: which elements are void, hold raw text, are never shown (besides select, math and svg, left out by choice), stand in blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("head script style template title noscript noembed noframes iframe object audio video canvas datalist svg math select area base link meta param source track".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol p plaintext pre search section summary table ul xmp caption tr".split()
)
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 menu ol p pre table ul".split())
CLOSES_P = BLOCK - frozenset("body html dd dt li legend caption tr".split())
_OF_TABLES = frozenset("table tr thead tbody tfoot td th body html".split())
#: A start tag of the first kind ends an open element of the second, unless one of the third lies between.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset()),
}


class Node:
    """hidden: not shown with all inside it; veiled: its own text isn't shown, which elements inside may undo."""

    __slots__ = ("tag", "attributes", "children", "hidden", "veiled")

    def __init__(self, tag: str, attributes: str = "", hidden: bool = False, veiled: bool = False):
        self.tag, self.attributes, self.hidden, self.veiled = tag, attributes, hidden, veiled
        self.children: list[Node | str] = []

    def attribute(self, name: str) -> str | None:
        for key, a, b, c in _ATTRIBUTE.findall(self.attributes):
            if key.lower() == name:
                return html.unescape(a or b or c)
        return None


def _hidden(tag: str, attributes: str) -> bool:
    if tag in NEVER:
        return True
    if not attributes or attributes.isspace():
        return tag == "dialog"
    low = attributes.lower()
    if tag != "dialog" and "hidden" not in low and "display" not in low:
        return False
    node = Node(tag, attributes)
    style = node.attribute("style")
    if tag == "dialog" and node.attribute("open") is None:
        return True
    return node.attribute("hidden") is not None or bool(style and _NO_DISPLAY.search(style)) or (tag == "input" and (node.attribute("type") or "").lower() == "hidden")


def _veiled(attributes: str, above: bool) -> bool:
    """Whether an element's visibility, its own or else that of the one above, keeps its text from being shown."""
    if "visibility" not in attributes.lower():
        return above
    said = _VISIBILITY.findall(Node("", attributes).attribute("style") or "")
    return said[-1].lower() != "visible" if said else above


def _shown(node: Node) -> list[Node | str]:
    """The children; of closed details only the first summary."""
    if node.tag != "details" or node.attribute("open") is not None:
        return node.children
    return [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]


class _Tags:
    """Where the tags of a page end, found in one pass over its quotes and angle brackets, however they are mixed up.

    A tag ends at the first > outside of quoted values, or with the page. A quote that nothing closes, or behind which no tag would end, is a character like any other if a > comes before the next quote.
    """

    def __init__(self, text: str):
        self.text, self.name_end = text, -1
        self.at = [m.start() for m in _SPECIAL.finditer(text)]
        self.ends = [len(text)] * (len(self.at) + 1)  # by special character from where a tag's end is looked for; -1: nowhere
        following = {'"': -1, "'": -1}
        for k in range(len(self.at) - 1, -1, -1):
            c = text[self.at[k]]
            if c == ">":
                self.ends[k] = self.at[k] + 1
                continue
            closing, following[c] = following[c], k
            end = self.ends[closing + 1] if closing >= 0 else -1
            if end < 0 and k + 1 < len(self.at) and text[self.at[k + 1]] == ">":
                end = self.at[k + 1] + 1
            self.ends[k] = end

    def match(self, at: int) -> tuple[str, str, str, int] | None:
        """Of the tag at a <: a slash or nothing, name, attributes, and its end; None if it isn't a tag. Asked for at rising places."""
        m = _TAG.match(self.text, at)
        if m is None:
            return None
        name = m.end() - 1
        if self.name_end < name:
            found = _NAME_END.search(self.text, name)
            self.name_end = found.start() if found else len(self.text)
        end = self.ends[bisect_left(self.at, self.name_end)]
        if end < 0:
            return None
        inside = end - 1 if self.text[end - 1] == ">" and end > self.name_end else end
        return m[1], self.text[name : self.name_end], self.text[self.name_end : inside], end


def tree(text: str) -> Node:
    """The element tree of a page, with implied end tags; whatever is still open at the end is closed."""
    root = Node("html")
    stack, opened, at, tags = [root], defaultdict(list), 0, _Tags(text)  # opened: by tag the places of open elements in the stack
    while at < len(text):
        if text[at] != "<":
            end_at = text.find("<", at)
            end_at = len(text) if end_at < 0 else end_at
            stack[-1].children.append(" " if stack[-1].veiled else text[at:end_at])
            at = end_at
            continue
        if aside := _ASIDE.match(text, at):
            at = aside.end()
            continue
        found = tags.match(at)
        if found is None:
            stack[-1].children.append(" " if stack[-1].veiled else "<")
            at += 1
            continue
        end, tag, attributes, at = found
        tag = tag.lower()
        if end:
            _close(stack, opened, tag)
            continue
        if tag in CLOSES_P:
            _close_open(stack, opened, frozenset(["p"]), frozenset(["td", "th", "table", "button", "caption"]))
        if tag in IMPLIED:
            _close_open(stack, opened, *IMPLIED[tag])
        elif stack[-1].tag == "head" and tag not in NEVER:
            _pop(stack, opened, len(stack) - 1)
        if tag in ("html", "body") and len(stack) >= 1:
            if not _hidden(tag, attributes) and not _veiled(attributes, False):
                continue
        node = Node(tag, attributes, _hidden(tag, attributes), _veiled(attributes, stack[-1].veiled))
        stack[-1].children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(text, at)
            if not node.hidden and not node.veiled:
                node.children.append(text[at : close.start() if close else len(text)])
            at = close.end() if close else len(text)
        elif tag not in VOID:
            opened[tag].append(len(stack))
            stack.append(node)
    return root


Opened = dict[str, list[int]]


def _pop(stack: list[Node], opened: Opened, at: int) -> None:
    for node in stack[at:]:
        opened[node.tag].pop()
    del stack[at:]


def _innermost(opened: Opened, tags: Iterable[str]) -> int:
    """The place of the innermost open element of the tags, 0 if there is none."""
    return max((opened[t][-1] for t in tags if opened.get(t)), default=0)


def _close(stack: list[Node], opened: Opened, tag: str) -> None:
    """Ends the innermost open element of that tag with all inside it; a stray end tag does nothing, but </p> and </br>. Only tags of tables end what lies around a cell."""
    at = _innermost(opened, [tag])
    if at and (tag in _OF_TABLES or at > _innermost(opened, ("td", "th", "table"))):
        _pop(stack, opened, at)
    elif tag in ("p", "br"):
        stack[-1].children.append(Node(tag))


def _close_open(stack: list[Node], opened: Opened, ends: frozenset, stops: frozenset) -> None:
    """Ends the outermost open element of ends that no element of stops lies above."""
    if not any(opened.get(tag) for tag in ends):
        return
    stop = _innermost(opened, stops)
    places = [places[k] for tag in ends if (places := opened.get(tag)) and (k := bisect_right(places, stop)) < len(places)]
    if places:
        _pop(stack, opened, min(places))


class _Shifted:
    """Lines that stand further right, none of the first and last ones blank: they are written only when the page is."""

    __slots__ = ("by", "lines", "width")

    def __init__(self, by: int, lines: list):
        self.by, self.lines, self.width = by, lines, by + _width(lines)


def _width(lines: list) -> int:
    return max((len(x) if isinstance(x, str) else x.width for x in lines), default=0)


def _flat(lines: list) -> list[str]:
    """The lines written out, indented up to WIDE."""
    got, stack = [], [(0, iter(lines))]
    while stack:
        by, rest = stack[-1]
        for x in rest:
            if isinstance(x, str):
                got.append(" " * by + x if x else "")
            else:
                stack.append((min(WIDE, by + x.by), iter(x.lines)))
                break
        else:
            stack.pop()
    return got


def _first(lines: list) -> tuple[str, list]:
    """The first line, written out, and the others."""
    by, above = 0, []
    while lines and not isinstance(lines[0], str):
        above.append((lines[0].by, lines[1:]))
        by, lines = by + lines[0].by, lines[0].lines
    first, rest = (" " * min(WIDE, by) + lines[0], lines[1:]) if lines else ("", [])
    for shift, others in reversed(above):
        rest = ([_Shifted(shift, rest)] if rest else []) + others
    return first, rest


class _Lines:
    """Lines under construction: white space collapses, blank lines around blocks merge."""

    def __init__(self) -> None:
        self.lines: list[str | _Shifted] = []
        self.line: list[str] = []
        self.space = self.open = False
        self.gap = False

    def text(self, part: str) -> None:
        part = _BLANKS.sub(" ", part)
        if part == " ":
            self.space = True
            return
        if part[0] == " ":
            self.space = True
        body = part.strip(" ")
        if self.space and self.open:
            self.line.append(" ")
        self._begin()
        self.line.append(body)
        self.space, self.open = part[-1] == " ", True

    def _begin(self) -> None:
        if self.gap and self.lines and self.lines[-1] != "":
            self.lines.append("")
        self.gap = False

    def end(self, gap: bool = False) -> None:
        """Ends the line; with gap a blank line comes before the next one."""
        if self.open:
            self.lines.append("".join(self.line))
            self.line = []
        self.space = self.open = False
        self.gap |= gap

    def feed(self) -> None:
        """A line break: an empty line of its own if nothing stands before it."""
        if self.open:
            self.end()
        elif self.lines:
            self._begin()
            self.lines.append("")

    def whole(self, lines: list[str]) -> None:
        if lines:
            self.end()
            self._begin()
            self.lines += lines


def _run(step: Generator):
    """The result of a generator that yields generators and gets their results: recursion as deep as memory goes."""
    stack, value = [step], None
    while stack:
        try:
            below = stack[-1].send(value)
        except StopIteration as end:
            stack.pop()
            value = end.value
        else:
            stack.append(below)
            value = None
    return value


def _render(node: Node, out: _Lines, pre: bool = False) -> Generator:
    for child in _shown(node):
        if isinstance(child, str):
            part = html.unescape(child) if "&" in child else child
            if not pre:
                out.text(part)
            else:
                first, *rest = part.replace("\r\n", "\n").split("\n")
                for i, line in enumerate([first, *rest]):
                    if i:
                        if not out.open:
                            out._begin()
                            out.lines.append("")
                        out.end()
                    if line:
                        out._begin()
                        out.line.append(line)
                        out.open = True
            continue
        if child.hidden:
            continue
        tag = child.tag
        if tag == "br":
            out.feed()
        elif tag in ("ul", "ol", "menu", "dir"):
            inside = out.__class__ is _Lines and node.tag == "li"
            out.end(gap=not inside)
            out.whole((yield _list(child)))
            out.end(gap=not inside)
        elif tag == "table":
            out.end(gap=True)
            out.whole((yield _table(child)))
            out.end(gap=True)
        elif tag in ("blockquote", "dd"):
            out.end(gap=tag in SPACED)
            inner = yield _lines_of(child)
            out.whole([_Shifted(2, inner)] if inner else [])
            out.end(gap=tag in SPACED)
        elif tag in BLOCK:
            out.end(gap=tag in SPACED)
            yield _render(child, out, pre or tag in ("pre", "listing", "xmp", "plaintext"))
            out.end(gap=tag in SPACED)
        elif tag in ("td", "th"):
            out.space = True
            yield _render(child, out, pre)
            out.space = True
        else:
            yield _render(child, out, pre or tag == "textarea")


def lines_of(node: Node, pre: bool = False) -> list[str]:
    return _flat(_run(_lines_of(node, pre)))


def _lines_of(node: Node, pre: bool = False) -> Generator:
    out = _Lines()
    yield _render(node, out, pre)
    out.end()
    lines = out.lines
    blank = lambda x: isinstance(x, str) and not x.strip()
    while lines and blank(lines[-1]):
        lines.pop()
    first = next((i for i, x in enumerate(lines) if not blank(x)), 0)
    return lines[first:] if first else lines


def _list(node: Node) -> Generator:
    """Items behind a dash or their number, what follows in an item under its first line."""
    got, number = [], 1
    start = node.attribute("start") if node.tag == "ol" else None
    if start and re.fullmatch(r"-?\d{1,9}", start.strip()):
        number = int(start)
    loose = Node(node.tag)
    for child in [*node.children, None]:
        if child is None or isinstance(child, Node) and child.tag == "li":
            if any(isinstance(c, Node) or not c.isspace() for c in loose.children):
                got += yield _lines_of(loose)
            loose = Node(node.tag)
            if child is None or child.hidden:
                continue
            mark = "- "
            if node.tag == "ol":
                value = child.attribute("value")
                if value and re.fullmatch(r"-?\d{1,9}", value.strip()):
                    number = int(value)
                mark = f"{number}. "
                number += 1
            lines = yield _lines_of(child)
            if child.veiled:
                if not lines:
                    continue
                mark = " " * len(mark)
            first, rest = _first(lines)
            got.append((mark + first).rstrip())
            if rest:
                got.append(_Shifted(len(mark), rest))
        else:
            loose.children.append(child)
    return got


def _rows(node: Node) -> Iterator[tuple[Node, Node]]:
    """The rows with the table or the part of it that they stand in."""
    for child in node.children:
        if isinstance(child, Node) and not child.hidden:
            if child.tag == "tr":
                yield node, child
            elif child.tag in ("thead", "tbody", "tfoot"):
                yield from _rows(child)


def _span(cell: Node, name: str = "colspan", most: int = 1000) -> int:
    """Columns that a cell takes, or rows: 0 there stands for all that follow in the part of the table."""
    value = (cell.attribute(name) or "") if cell.attributes else ""
    if not re.fullmatch(r"\s*\d{1,6}\s*", value):
        return 1
    return most if name == "rowspan" and int(value) == 0 else min(most, max(1, int(value)))


class _Reach:
    """The columns that cells of earlier rows reach into, as runs with room between them.

    As long as no two cells reach into a column, a run grows and is parted where a cell's reach begins and ends; else the runs are put together anew in each row.
    """

    def __init__(self) -> None:
        self.row, self.apart = -1, True
        self.alive: list[tuple[int, int, int]] = []  # a heap: last row, first column, column behind
        self.new: list[tuple[int, int, int]] = []
        self.starts: list[int] = []
        self.stops: list[int] = []

    def next_row(self) -> None:
        """What cells of the rows before reach into from here on."""
        self.row += 1
        while self.alive and self.alive[0][0] < self.row:
            _, start, stop = heapq.heappop(self.alive)
            if self.apart:
                self._part(start, stop)
        new, self.new = self.new, []
        for cell in new:
            heapq.heappush(self.alive, cell)
            if self.apart:
                self.apart = self._join(*cell[1:])
        if not self.apart:
            self.starts, self.stops = [], []
            for _, start, stop in sorted(self.alive, key=lambda x: x[1:]):
                if self.stops and start <= self.stops[-1]:
                    self.stops[-1] = max(self.stops[-1], stop)
                else:
                    self.starts.append(start)
                    self.stops.append(stop)

    def _part(self, start: int, stop: int) -> None:
        """Takes the columns, which lie in one run, out of it."""
        k = bisect_right(self.starts, start) - 1
        rest = [(a, b) for a, b in ((self.starts[k], start), (stop, self.stops[k])) if a < b]
        self.starts[k : k + 1], self.stops[k : k + 1] = [a for a, _ in rest], [b for _, b in rest]

    def _join(self, start: int, stop: int) -> bool:
        """Adds columns; False if some are in a run already."""
        k = bisect_right(self.starts, start)
        if k and self.stops[k - 1] > start or k < len(self.starts) and self.starts[k] < stop:
            return False
        first = k - 1 if k and self.stops[k - 1] == start else k
        last = k + 1 if k < len(self.starts) and self.starts[k] == stop else k
        a, b = self.starts[first] if first < k else start, self.stops[k] if last > k else stop
        self.starts[first:last], self.stops[first:last] = [a], [b]
        return True

    def add(self, start: int, stop: int, rows: int) -> None:
        """A cell of this row that takes so many rows."""
        self.new.append((self.row + rows - 1, start, stop))

    def free(self, at: int) -> int:
        """The first column from at on that no earlier row reaches into."""
        k = bisect_left(self.stops, at + 1)
        while k < len(self.starts) and self.starts[k] <= at:
            at, k = self.stops[k], k + 1
        return at


def _table(node: Node) -> Generator:
    """The caption and what stands outside of rows, then the rows, their cells in columns two spaces apart."""
    loose = Node("div")
    for child in node.children:
        if isinstance(child, str) or child.tag not in ("tr", "thead", "tbody", "tfoot"):
            loose.children.append(child)
        elif child.tag != "tr":
            loose.children += [c for c in child.children if not child.hidden and (isinstance(c, str) or c.tag != "tr")]
    grid: list[list[tuple[int, list[str]]]] = []
    width: dict[int, int] = {}
    reach, part = _Reach(), None
    for above, row in _rows(node):
        if above is not part:  # cells don't reach out of a head, body or foot
            reach, part = _Reach(), above
        at, cells, outside = 0, [], Node("div")
        reach.next_row()
        for cell in row.children:
            if isinstance(cell, Node) and cell.tag in ("td", "th"):
                if not cell.hidden:
                    lines, span, rows = (yield _lines_of(cell)), _span(cell), _span(cell, "rowspan", 65_534)
                    at = reach.free(at)
                    if rows > 1:
                        reach.add(at, at + span, rows)
                    cells.append((at, lines))
                    if span == 1:
                        width[at] = max(width.get(at, 0), _width(lines))
                    at += span
            else:
                outside.children.append(cell)
        if lines := (yield _lines_of(outside)):
            cells.append((at, lines))
        if any(lines for _, lines in cells):
            grid.append(cells)
    columns = sorted(width)
    ends = [0]
    for c in columns:
        ends.append(ends[-1] + width[c] + 2)
    start = lambda at: min(WIDE, ends[bisect_left(columns, at)])
    got = yield _lines_of(loose)
    for cells in grid:
        full = [(at, lines) for at, lines in cells if lines]
        if len(full) == 1:  # nothing stands beside it
            got.append(_Shifted(start(full[0][0]), full[0][1]))
            continue
        cells = [(at, _flat(lines)) for at, lines in full]
        for k in range(max((len(lines) for _, lines in cells), default=0)):
            line = ""
            for at, lines in cells:
                if k < len(lines) and lines[k]:
                    line = line.ljust(start(at)) if len(line) <= start(at) else line + "  "
                    line += lines[k]
            got.append(line.rstrip())
    return got


def visible_text(page: str) -> str:
    """All visible text of a page, laid out."""
    return "\n".join(line.rstrip() for line in lines_of(tree(page)))


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text and n_lines of each row of pages.

    Null, empty and wholly hidden pages have an empty text and no lines. Malformed pages take time about in proportion to their length.
    Rules of style sheets are not looked at, only attributes; columns are aligned by code points. Columns other than the two named ones
    are not read; repeated rows are rendered each by itself, an empty table gives no rows.
    """

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, text="html"):
            got = [visible_text(t) for t in texts]
            lines = [x.count("\n") + 1 if x else 0 for x in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.string()), pa.array(lines, pa.int64())], ["page_id", "text", "n_lines"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    return spread(rows, "page_id").mapInArrow(render, f"page_id {dict(rows.dtypes)['page_id']}, text string, n_lines long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every whole page of pages; see extracted() for nulls and repeats."""
    return extracted(table(spark, sf_dir, "pages"))
