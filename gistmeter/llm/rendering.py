"""HTML extraction: a tree builder with implied tags and visibility rules, rendered as laid-out text.

Elements are laid out as they close, so depth costs no recursion. Blocks start lines, some with an empty line
around them; list items carry bullets or numbers and are indented by depth; the cells of a data table are padded
to columns. What a browser would not show (head, scripts, ``hidden``, ``display:none`` and the like) is left out.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset("head title script style noscript template iframe object audio video canvas datalist noframes".split())
#: What may stand in a head; any other start tag, or text, ends a head that is open.
HEADED = frozenset("html base basefont bgsound link meta title style script noscript template noframes".split())
FOREIGN = frozenset(("svg", "math"))
#: Parts of drawings and formulas that describe or define and are not shown themselves.
UNDRAWN = frozenset("desc defs metadata symbol clippath mask pattern marker annotation annotation-xml mphantom".split())
#: Elements of drawings and formulas that hold ordinary HTML, and start tags that end the drawing elsewhere.
HOLDS_HTML = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr "
    "ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset".split())
BLOCKS = SPACED | frozenset(
    "html body div section article aside nav header footer main address form li dt dd tr td th caption thead tbody "
    "tfoot figcaption details summary legend center dir menu option hgroup search dialog".split()
)
#: Start tags that end an open element of the same kind, and where the search for it stops.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "caption"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "caption"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "caption"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "caption"), ("table",)),
    "option": (("option",), ("select", "datalist")),
    "body": (("head",), ()),
}
SCOPE = frozenset("table td th caption button object".split())
LISTS = ("ul", "ol", "menu", "dir")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PASSAGES = frozenset("p ul ol dl blockquote pre figure".split())
_HIDES = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_OPEN_TAG = re.compile(r"<[a-zA-Z/!?]")
_SPACE = re.compile(r"[ \t\n\r\f\v]+")


#: Most blanks that nesting puts before a line, and how deep data tables keep columns.
MOST_INDENT = 40
DEEPEST = 4
#: Widest cell that pads its column, and where the last aligned column may begin.
WIDEST = 80
LAST_COLUMN = 1000


class Part:
    """Lines of an inner block: how far they stand in, and the mark in front of the first of them."""

    __slots__ = ("indent", "mark", "items")

    def __init__(self, items: list, indent: int = 0, mark: str = ""):
        self.items, self.indent, self.mark = items, indent, mark


def written(items: list) -> list[str]:
    """The lines of a block and the parts in it. Blocks are written once, however deep they stand."""
    out, stack, marks, base = [], [(iter(items), 0)], [], 0
    while stack:
        rest, indent = stack[-1]
        item = next(rest, None)
        if item is None:
            stack.pop()
        elif isinstance(item, Part):
            if item.mark and not marks:
                base = indent
            if item.mark or marks:
                marks.append(item.mark or " " * item.indent)
            stack.append((iter(item.items), min(indent + item.indent, MOST_INDENT)))
        elif marks:
            out.append(" " * base + "".join(marks) + item)
            marks = []
        else:
            out.append(" " * indent + item if item else item)
    return out


class Box:
    """An open block: lines and parts laid out so far, the running line, and what its kind needs."""

    __slots__ = ("tag", "lines", "run", "gap", "rows", "cells", "number", "span", "weight", "nests", "role", "place")

    def __init__(self, tag: str, place: int = 0):
        self.tag, self.lines, self.run, self.gap, self.place = tag, [], [], False, place
        self.rows, self.cells, self.number, self.span = None, None, None, (1, 1)
        # Passages inside (a heading counts as two), whether a table is among them, and what a table is known to be.
        self.weight, self.nests, self.role = 0, False, None

    def flush(self) -> None:
        if self.run:
            lines = [_SPACE.sub(" ", line).strip() for line in "".join(self.run).split("\0")]
            self.run = []
            while lines and not lines[-1]:
                lines.pop()
            if lines:
                if self.gap and self.lines:
                    self.lines.append("")
                self.gap = False
                self.lines.extend(lines)

    def add(self, lines: list, spaced: bool, indent: int = 0, mark: str = "") -> None:
        self.flush()
        if lines:
            if self.lines and (spaced or self.gap):
                self.lines.append("")
            self.lines.append(Part(lines, indent, mark))
            self.gap = spaced


def _number(value: str | None, least: int, most: int) -> int:
    digits = re.match(r"\s*(-?\d{1,9})", value or "")
    return min(max(int(digits[1]), least), most) if digits else least


def lays_out_page(table: Box) -> bool:
    """Whether a table arranges a page and holds no data.

    Its role says so; or it has no heads or caption, and holds a table or, in three quarters of the cells that
    show anything, a heading or several passages. The height of a cell says nothing.
    """
    if table.role is not None:
        return table.role == "page"
    cells = [cell for row in table.rows for cell in row if cell[0]]
    return table.nests or (bool(cells) and 4 * sum(weight > 1 for _, _, weight in cells) >= 3 * len(cells))


def laid_out(rows: list[list[tuple[list, tuple[int, int], int]]], page: bool = False) -> list:
    """A data table with columns padded to their widest cell; a layout table or a single column cell by cell.

    A cell of more than ``WIDEST`` characters pads no others; its row goes on behind it, as rows do from
    ``LAST_COLUMN`` characters on.
    """
    rows = [row for row in rows if row]
    if not rows:
        return []
    if page or all(len(row) == 1 for row in rows):
        box = Box("div")
        for row in rows:
            for lines, *_ in row:
                box.add(lines, False)
        return box.lines
    grid: list[list[tuple[int, list[str]]]] = []
    # Columns that cells from above still take, as (first, behind the last, rows left), in order.
    taken: list[tuple[int, int, int]] = []
    for row in rows:
        line, column, at, fresh = [], 0, 0, []
        for lines, (across, down), _ in row:
            while at < len(taken) and taken[at][0] <= column:
                column = max(column, taken[at][1])
                at += 1
            line.append((column, written(lines)))
            if down > 1:
                if fresh and fresh[-1][1:] == (column, down):
                    fresh[-1] = (fresh[-1][0], column + across, down)
                else:
                    fresh.append((column, column + across, down))
            column += across
        taken = sorted((a, b, n - 1) for a, b, n in taken + fresh if n > 1)
        grid.append(line)
    width: dict[int, int] = {}
    for line in grid:
        for column, lines in line:
            width[column] = max([width.get(column, 0), *(len(x) for x in lines if len(x) <= WIDEST)])
    order = sorted(width)
    place = {column: k for k, column in enumerate(order)}
    # Where each column begins; what a row has no cell for stays blank.
    begin = [0]
    for column in order:
        begin.append(min(begin[-1] + width[column] + 2, LAST_COLUMN))
    out = []
    for line in grid:
        for k in range(max((len(lines) for _, lines in line), default=0)):
            said, at = [], 0
            for column, lines in line:
                if k < len(lines) and lines[k]:
                    start = begin[place[column]]
                    blank = max(start - at, 2 if said else 0)
                    said.append(" " * blank + lines[k])
                    at += blank + len(lines[k])
            if said:
                out.append("".join(said).rstrip())
    return out


class Page(HTMLParser):
    """Builds and lays out one page; ``text()`` after ``feed`` and ``close``."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Box("root")
        self.boxes = [self.root]
        #: Open elements: tag, whether it has a box, what it adds to ``hidden``, whether it is shown.
        self.open: list[tuple[str, bool, int, bool]] = []
        #: Places of the open elements of each tag.
        self.places: dict[str, list[int]] = {}
        #: Boxes of open tables and lists, and closed ``details`` by place, with whether a summary was seen.
        self.tables: list[Box] = []
        self.holders: list[Box] = []
        self.shut: list[list] = []
        self.hidden = 0
        self.foreign = 0
        #: Whether a head has been opened, or the body has begun without one.
        self.headed = False
        self.pre = 0

    def text(self) -> str:
        while self.open:
            self._pop()
        self.root.flush()
        return "\n".join(written(self.root.lines)).strip("\n")

    def _last(self, names) -> int:
        """Place of the innermost open element with one of these tags, -1 for none."""
        return max((at[-1] for name in names if (at := self.places.get(name))), default=-1)

    def _find(self, names, stop) -> int:
        """The same, -1 too if one of the tags ``stop`` is open inside it."""
        at = self._last(names)
        return at if at >= self._last(stop) else -1

    def _close_to(self, depth: int) -> None:
        while len(self.open) > depth:
            self._pop()

    def _end_head(self) -> None:
        self.headed = True
        if self.open and self.open[-1][0] == "head":
            self._pop()

    def handle_starttag(self, tag, attrs):
        if self.foreign and tag in BREAKS_OUT:
            while (at := self._find(FOREIGN, HOLDS_HTML)) >= 0:
                self._close_to(at)
        if tag == "head":
            if self.headed:
                return
            self.headed = True
        elif tag not in HEADED:
            self._end_head()
        if tag in ENDS:
            names, stop = ENDS[tag]
            at = self._find(names, stop)
            if at >= 0:
                self._close_to(at)
        if tag in BLOCKS and tag not in ("html", "body", "tr", "td", "th", "thead", "tbody", "tfoot", "option"):
            at = self._find(("p",), SCOPE)
            if at >= 0:
                self._close_to(at)
        if tag in ("td", "th") and self._find(("tr",), ("table",)) < 0 and self._find(("table",), ()) >= 0:
            self.handle_starttag("tr", [])
        if tag == "br":
            if not self.hidden:
                self.boxes[-1].run.append("\0")
            return
        if tag in VOID:
            if tag == "hr" and not self.hidden:
                self.boxes[-1].flush()
                self.boxes[-1].gap = True
            return
        given = dict(attrs)
        unseen = tag in UNSEEN or "hidden" in given or bool(_HIDES.search(given.get("style") or ""))
        unseen = unseen or (self.foreign > 0 and tag in UNDRAWN) or (tag == "dialog" and "open" not in given)
        shown, adds = not self.hidden and not unseen, int(unseen)
        if tag == "details" and "open" not in given:
            # Of closed details only the first summary shows.
            adds += 1
            self.shut.append([len(self.open), False])
        elif tag == "summary" and self.shut and self.shut[-1] == [len(self.open) - 1, False]:
            self.shut[-1][1] = True
            adds -= 1
            shown = self.hidden == 1 and not unseen
        # The labels of a drawing stand apart from each other.
        boxed = tag in BLOCKS or (tag == "text" and self.foreign > 0)
        if boxed:
            box = Box(tag, len(self.boxes))
            if tag == "table":
                box.rows = []
                self.tables.append(box)
                if (given.get("role") or "").strip().lower() in ("presentation", "none"):
                    box.role = "page"
            elif tag == "tr":
                box.cells = []
            elif tag in ("td", "th"):
                box.span = (_number(given.get("colspan"), 1, 1000), _number(given.get("rowspan"), 1, 1000))
            elif tag == "ol":
                box.number = _number(given["start"], -(10**9), 10**9) if given.get("start") else 1
            elif tag == "li" and given.get("value"):
                box.number = _number(given["value"], -(10**9), 10**9)
            if tag in LISTS:
                self.holders.append(box)
            self.boxes.append(box)
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, boxed, adds, shown))
        self.hidden += adds
        self.foreign += tag in FOREIGN
        self.pre += tag in ("pre", "textarea")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        # Only drawings and formulas have elements that close themselves.
        if self.foreign and self.open[-1][0] == tag and (tag in FOREIGN or self._find(FOREIGN, ("foreignobject",)) >= 0):
            self._pop()

    def unknown_decl(self, data):
        if self.foreign and data.startswith("CDATA["):
            self.handle_data(data[6:])

    def handle_endtag(self, tag):
        if tag == "br":
            self.handle_starttag("br", [])
            return
        stop = () if tag in SCOPE or tag in ("html", "body", "tr", "thead", "tbody", "tfoot") else SCOPE
        at = self._find((tag,), ("table",) if tag in ("tr", "td", "th", "thead", "tbody", "tfoot", "caption") else stop)
        if at >= 0:
            self._close_to(at)

    def handle_data(self, data):
        if data.strip(" \t\n\r\f"):
            if not self.hidden or self.open[-1][0] == "head":
                self._end_head()
        if self.hidden or not data:
            return
        box = self.boxes[-1]
        if box.tag in ("table", "tr", "thead", "tbody", "tfoot"):
            if not data.strip():
                return
            # Text that stands between cells is shown before the table.
            if self.tables:
                box = self.boxes[self.tables[-1].place - 1]
        data = data.replace("\0", "")
        if self.pre and box.tag != "root":
            box.flush()
            lines = data.split("\n")
            if box.lines and box.tag == "pre" and isinstance(box.lines[-1], str):
                box.lines[-1] += lines.pop(0)
            box.lines.extend(lines)
        else:
            box.run.append(data)

    def _pop(self) -> None:
        tag, boxed, adds, shown = self.open.pop()
        self.places[tag].pop()
        self.hidden -= adds
        if self.shut and self.shut[-1][0] == len(self.open):
            self.shut.pop()
        self.foreign -= tag in FOREIGN
        self.pre -= tag in ("pre", "textarea")
        if not boxed:
            return
        box, outer = self.boxes.pop(), self.boxes[-1]
        if tag == "table":
            self.tables.pop()
        elif tag in LISTS:
            self.holders.pop()
        box.flush()
        lines = box.lines
        if not shown:
            return
        if tag == "pre":
            blank = lambda x: isinstance(x, str) and not x.strip()
            first = next((k for k, x in enumerate(lines) if not blank(x)), len(lines))
            last = next((k for k in range(len(lines), first, -1) if not blank(lines[k - 1])), first)
            lines = lines[first:last]
        if tag not in ("td", "th", "table"):
            own = 2 if tag in HEADINGS else int(tag in PASSAGES)
            outer.weight += box.weight + (own if lines else 0)
        table = self.tables[-1] if self.tables else None
        if tag in ("th", "thead", "tfoot", "caption") and table is not None and table.role is None:
            table.role = "data"
        if box.nests and tag != "table":
            outer.nests = True
        if tag in ("td", "th") and outer.cells is not None:
            outer.cells.append((lines, box.span, box.weight))
        elif tag == "tr":
            if table is not None:
                table.rows.append(box.cells or [])
                outer.add(lines, False) if outer is not table else None
            else:
                outer.add(laid_out([box.cells or []]) + lines, False)
        elif tag in ("thead", "tbody", "tfoot"):
            outer.add(lines, False)
        elif tag == "table":
            outer.add(lines + laid_out(box.rows, len(self.tables) >= DEEPEST or lays_out_page(box)), True)
            outer.nests = True
        elif tag == "li":
            holder = self.holders[-1] if self.holders else None
            mark = "- "
            if holder is not None and holder.tag == "ol":
                number = box.number if box.number is not None else holder.number
                holder.number, mark = number + 1, f"{number}. "
            outer.add(lines, False, len(mark), mark)
        elif tag in ("dd", "blockquote"):
            outer.add(lines, tag in SPACED, 2)
        else:
            inner_list = tag in ("ul", "ol", "dl") and outer.tag in ("li", "dd")
            outer.add(lines, tag in SPACED and not inner_list)


def render(html: str | None) -> str:
    """Visible text of a page; empty for null."""
    if not html:
        return ""
    try:
        return _read(html)
    except AssertionError:
        # The tokenizer refuses some malformed declarations; as text they do no harm.
        return _read(html.replace("<![", "&lt;!["))


def _read(html: str) -> str:
    page = Page()
    page.feed(html)
    if _OPEN_TAG.match(page.rawdata):
        # A comment or tag that nothing ends takes the rest of the page, as in a browser.
        page.rawdata = ""
    page.close()
    return page.text()


def _run(batches):
    for batch in batches:
        texts = [render(html) for html in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string())], names=["page_id", "text"])


def rendered(pages: DataFrame) -> DataFrame:
    """``page_id, text, n_chars, n_lines`` for every row of ``pages``.

    A null or empty page, or one that shows nothing, has the empty text and no lines. Repeated rows and null
    ids are rendered row by row; other columns are not read; an empty table gives an empty result. Unclosed and
    misplaced tags are repaired as the tree builder says, never dropped with their text. Time and output grow with the
    page however deep it is: nesting puts at most ``MOST_INDENT`` blanks before a line, a cell pads others up to
    ``WIDEST`` characters, and tables inside ``DEEPEST`` others are laid out cell by cell. No text is cut.
    """
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    out = slim.mapInArrow(_run, "page_id long, text string")
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n")))
    return out.select("page_id", "text", F.char_length("text").cast("long").alias("n_chars"), lines.cast("long").alias("n_lines"))
