"""HTML to text by layout: a tree with implied tags and visibility rules, rendered with block spacing, lists and tables."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, pick

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript iframe audio video canvas datalist desc metadata defs annotation annotation-xml title meta link base source track param noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center details dialog div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend main menu nav ol p pre section summary table caption ul li hr tr".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure article section".split())
HEAD_ONLY = frozenset("base link meta title script style template noscript".split())
#: A start tag of the key ends an open element of the values, unless one of the scopes lies between.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th", "caption"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), "tfoot": ("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), "option": ("option",), "optgroup": ("option", "optgroup")}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "optgroup": ("select",)}
ENDS_P = BLOCK - {"html", "body", "tr", "caption"}
#: Columns are padded up to PAD characters, and the first COLUMNS of a table are aligned; what is beyond follows after two blanks.
PAD, COLUMNS = 40, 200
#: Lists, quotations and tables within each other are laid out up to this level; deeper ones follow in lines of their own.
LEVELS = 60
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_MARK = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_SPACE = re.compile(r"[ \t\r\n\f]+")


_NONE: dict[str, str] = {}


@dataclass(slots=True)
class Node:
    tag: str
    attrs: dict = field(default_factory=lambda: _NONE)
    children: list = field(default_factory=list)


def tags(source: str, at: int = 0) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, is an end tag, name, rest) of each tag and, without a name, of each comment and declaration.

    It goes through the source once. A ``>`` within a quoted value is no end, unless the quotation has none before the last ``>``.
    After that there are no tags. The caller may send a place from which to go on.
    """
    size, last = len(source), source.rfind(">")
    while 0 <= (start := source.find("<", at)) < size:
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            end = size if end < 0 else end + 3
            closing, name, rest = False, "", ""
        elif source[start + 1 : start + 2] in ("!", "?"):
            if start > last:
                return
            end = source.find(">", start) + 1
            closing, name, rest = False, "", ""
        else:
            closing = source[start + 1 : start + 2] == "/"
            m = _NAME.match(source, start + 1 + closing)
            if not m:
                at = start + 1
                continue
            if start > last:
                return
            end = place = m.end()
            while True:
                mark = _MARK.search(source, place)
                if mark is None:
                    return
                if mark[0] == ">":
                    end = mark.end()
                    break
                opens = source[place : mark.start()].rstrip().endswith("=")
                place = mark.end()
                if opens and place <= last and 0 <= (other := source.find(mark[0], place, last)):
                    place = other + 1
            name, rest = m[0].lower(), source[m.end() : end - 1]
        at = end
        sent = yield start, end, closing, name, rest
        if sent is not None:
            at = sent
            yield start, end, closing, name, rest


def build(source: str) -> tuple[Node, str]:
    """The tree of a document and its title. Text nodes are plain strings. It may be of any depth."""
    root = Node("html")
    body = Node("body")
    root.children.append(body)
    stack, title, at = [root, body], "", 0
    lower = None
    places: defaultdict[str, list[int]] = defaultdict(list)  # where in the stack the open elements of each name are

    def text(raw: str) -> None:
        if raw:
            stack[-1].children.append(html.unescape(raw))

    def push(node: Node) -> None:
        places[node.tag].append(len(stack))
        stack.append(node)

    def cut(i: int) -> None:
        for n in stack[i:]:
            places[n.tag].pop()
        del stack[i:]

    def top(names: tuple[str, ...]) -> int:
        return max((places[n][-1] for n in names if places[n]), default=0)

    def close(names: tuple[str, ...], scopes: tuple[str, ...]) -> None:
        while (i := top(names)) > top(scopes):
            cut(i)

    found = tags(source)
    for start, end, closing, name, rest in found:
        text(source[at:start])
        at = end
        if not name:
            continue
        if closing:
            if name in ("body", "html", "head"):
                continue
            if not places[name]:
                if name in ("p", "br"):
                    stack[-1].children.append(Node(name))
                continue
            cells = name not in ("table", "tr", "td", "th", "thead", "tbody", "tfoot")
            if (i := places[name][-1]) >= top(("table", "td", "th", "caption") if cells else ("table",)):
                cut(i)
            continue
        if name in ("html", "body", "head"):
            continue
        attrs = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTR.findall(rest)} if rest.strip() else _NONE
        if name in ENDS_P and places["p"]:
            close(("p",), ("table", "td", "th", "caption", "button", "object"))
        if name in ENDS:
            close(ENDS[name], SCOPES.get(name, ("table",)))
        if name in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            stack[-1].children.append(row := Node("tr"))
            push(row)
        if name.startswith("h") and name[1:].isdigit() and stack[-1].tag[:1] == "h" and stack[-1].tag[1:].isdigit():
            cut(len(stack) - 1)
        if name == "a":
            close(("a",), ("table", "td", "th", "p", "div", "li"))
        node = Node(name, attrs)
        stack[-1].children.append(node)
        if name in RAW:
            if lower is None:
                lower = source.lower()
                if len(lower) != len(source):  # some letters grow when lower-cased
                    lower = "".join(c.lower() if c < "\x80" else c for c in source)
            stop = lower.find(f"</{name}", at)
            stop = len(source) if stop < 0 else stop
            content = source[at:stop]
            if name == "title" and not title:
                title = _SPACE.sub(" ", html.unescape(content)).strip()
            node.children.append(html.unescape(content).removeprefix("\n") if name == "textarea" else content)
            at = source.find(">", stop) + 1 or len(source)
            found.send(at)
        elif name not in VOID and not rest.rstrip().endswith("/"):
            push(node)
    text(source[at:])
    return root, title


def unseen(node: Node) -> bool:
    a = node.attrs
    return node.tag in UNSEEN or "hidden" in a or node.tag == "input" and a.get("type", "").lower() == "hidden" or bool("style" in a and _HIDDEN.search(a["style"])) or node.tag == "dialog" and "open" not in a


class Layout:
    """Lines under construction: inline text is collapsed, blocks begin lines, spaced blocks leave one line free."""

    def __init__(self, level: int = 0) -> None:
        self.level = level
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = False
        self.tables = 0

    def inline(self, text: str, kept: bool) -> None:
        if kept:
            self._open()
            for i, part in enumerate(text.replace("\r\n", "\n").split("\n")):
                if i:
                    self.lines.append("".join(self.now).rstrip())
                    self.now = []
                self.now.append(part)
            return
        text = _SPACE.sub(" ", text)
        if text.startswith(" ") and (not self.now or self.now[-1].endswith(" ")):
            text = text[1:]
        if text:
            self._open()
            self.now.append(text)

    def _open(self) -> None:
        if self.gap and self.lines and not self.now:
            self.lines.append("")
        self.gap = False

    def end_line(self, force: bool = False) -> None:
        line = "".join(self.now).rstrip(" \t")
        if line or force:
            self.lines.append(line)
        self.now = []

    def take(self, lines: list[str], first: str = "", rest: str = "") -> None:
        self.end_line()
        if lines:
            self._open()
            self.lines += [((first if i == 0 else rest) + x).rstrip() for i, x in enumerate(lines)]

    def walk(self, node: Node, kept: bool = False) -> None:
        """Lay out what a node holds, without recursion but for the levels of lists, quotations and tables."""
        frames = [(node, iter(node.children), kept, [_start(node)], "")]
        while frames:
            parent, children, kept, number, leave = frames[-1]
            child = next(children, None)
            if child is None:
                frames.pop()
                if leave in ("block", "spaced"):
                    self.end_line()
                    self.gap |= leave == "spaced"
                elif leave == "cell":
                    self.inline(" ", False)
                continue
            if isinstance(child, str):
                self.inline(child, kept)
                continue
            tag, leave = child.tag, ""
            if unseen(child):
                continue
            if tag == "br":
                self.end_line(force=True)
                continue
            if tag == "hr":
                self.take(["-" * 20])
                continue
            if tag in ("img", "input"):
                self.inline(child.attrs.get("alt" if tag == "img" else "value", ""), False)
                continue
            if tag == "svg":
                child = Node("svg", children=list(_labels(child)))
            elif tag in ("option", "optgroup"):
                self.end_line()
                label = child.attrs.get("label", "")
                self.inline(label, False)
                if label and tag == "optgroup":
                    self.end_line()
                if label and tag == "option":
                    child = Node("option")
                leave = "block"
            elif tag == "textarea":
                kept = True
            elif tag == "table" and self.level < LEVELS:
                self.end_line()
                self.gap = True
                self.take(self.table(child))
                self.gap = True
                continue
            elif tag == "li" and self.level < LEVELS:
                mark = f"{number[0]}. " if parent.tag == "ol" else "- "
                number[0] += 1
                self.take(self.sub(child), mark, " " * len(mark))
                continue
            elif tag in ("dd", "blockquote") and self.level < LEVELS:
                self.gap |= tag == "blockquote"
                self.take(self.sub(child), "  ", "  ")
                self.gap |= tag == "blockquote"
                continue
            elif tag in BLOCK:
                self.end_line()
                spaced = tag in SPACED and not (parent.tag == "li" and tag in ("ul", "ol"))
                self.gap |= spaced
                kept, leave = kept or tag == "pre", "spaced" if spaced else "block"
            elif tag in ("td", "th", "foreignobject") or tag == "text" and parent.tag == "svg":
                self.inline(" ", False)
                leave = "cell"
            frames.append((child, iter(child.children), kept, [_start(child)], leave))

    def sub(self, node: Node) -> list[str]:
        inner = Layout(self.level + 1)
        inner.walk(node)
        inner.end_line()
        self.tables += inner.tables
        return inner.lines

    def table(self, node: Node) -> list[str]:
        """Rows of cells in columns. A cell's lines stay below each other; a cell that spans rows keeps its column in them."""
        self.tables += 1
        head, stray = [], []
        rows: list[dict[int, list[str]]] = []
        taken: dict[int, int] = {}  # columns that cells above still span, with the first row that is free again
        todo = list(reversed(node.children))
        while todo:
            child = todo.pop()
            if isinstance(child, str):
                if child.strip():
                    stray.append(_SPACE.sub(" ", child).strip())
            elif unseen(child):
                continue
            elif child.tag in ("thead", "tbody", "tfoot"):
                todo += reversed(child.children)
            elif child.tag == "tr":
                cells, column = {}, 0
                for c in child.children:
                    if isinstance(c, str):
                        if not c.strip():
                            continue
                        lines, wide, high = [_SPACE.sub(" ", c).strip()], 1, 1
                    elif unseen(c):
                        continue
                    else:
                        lines = self.sub(c) if c.tag in ("td", "th") else self.sub(Node("td", _NONE, [c]))
                        wide, high = _span(c, "colspan", 1000), _span(c, "rowspan", 65534)
                    while taken.get(column, 0) > len(rows):
                        column += 1
                    cells[column] = lines
                    for k in range(column, min(column + wide, COLUMNS)) if high > 1 else ():
                        taken[k] = len(rows) + high
                    column += wide
                rows.append(cells)
            elif child.tag == "caption":
                head += self.sub(child)
            else:
                stray += self.sub(Node("div", _NONE, [child]))
        widths: dict[int, int] = {}
        for cells in rows:
            for i, lines in cells.items():
                if (width := max(map(len, lines), default=0)) or i in widths:
                    widths[i] = max(widths.get(i, 0), min(PAD, width))
        columns = sorted(widths)
        rank = {c: k for k, c in enumerate(columns)}
        out = [*stray, *head]
        for cells in rows:
            own = [(rank[i], lines) for i, lines in cells.items() if lines and i in rank]
            for k in range(max((len(lines) for _, lines in own), default=0)):
                line, at = [], 0
                for place, lines in own:
                    line += [" " * widths[c] for c in columns[at : min(place, COLUMNS)]]
                    line.append((lines[k] if k < len(lines) else "").ljust(widths[columns[place]]))
                    at = place + 1
                out.append("  ".join(line).rstrip())
        return out


def _start(node: Node) -> int:
    start = node.attrs.get("start", "")
    return int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1


def _span(node: Node, name: str, most: int) -> int:
    span = node.attrs.get(name, "1")
    return min(most, max(1, int(span))) if re.fullmatch(r"\d{1,9}", span) else 1


def _labels(node: Node) -> Iterator[Node]:
    """The text elements of a graphic."""
    todo = list(reversed(node.children))
    while todo:
        child = todo.pop()
        if isinstance(child, str) or unseen(child):
            continue
        if child.tag in ("text", "foreignobject"):
            yield child
        else:
            todo += reversed(child.children)


def render(source: str | None) -> tuple[str, str, int]:
    """Title, text and number of tables of one page."""
    if not source:
        return "", "", 0
    root, title = build(source)
    page = Layout()
    page.walk(root)
    page.end_line()
    lines: list[str] = []
    for line in page.lines:
        if line or lines and lines[-1]:
            lines.append(line)
    while lines and not lines[-1]:
        lines.pop()
    return title, "\n".join(lines), page.tables


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, title, text, n_chars, n_lines, n_tables.

    All visible text of the page is in ``text``, with the labels of graphics, formulas, all options of a selection and the
    content of text areas and objects; what is hidden from screen readers alone is shown too. Pages of any length and depth are read
    once from front to back. Null and empty pages have an empty title and text. Plain text without tags is
    a page of one paragraph. Rows that repeat have equal results; null ids stay; an empty table gives an empty
    table; other columns are ignored.
    """
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [render(x) for x in b.column(1).to_pylist()]
            cols = [b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string()), pa.array([len(g[1]) for g in got], pa.int64()), pa.array([g[1].count("\n") + bool(g[1]) for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "title", "text", "n_chars", "n_lines", "n_tables"])

    rows = pick(pages, page_id=id_col, html=html_col).select(F.col("page_id").cast("long"), "html")
    return rows.mapInArrow(run, "page_id long, title string, text string, n_chars long, n_lines long, n_tables long")
