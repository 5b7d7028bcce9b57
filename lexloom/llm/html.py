"""HTML extraction by layout: a tree with implied tags, visibility rules, and a renderer of blocks, lists and tables."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.words import slices

#: A tag, comment or declaration. Possessive, so that no text makes it slow; what is open at the end goes to the end.
_MARKUP = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)|!--(?:.*?--!?>|.*\Z)|[!?/][^>]*+(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"?|'[^']*+'?|[^\s"'>]++))?""")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("head script style noscript template title iframe noframes noembed svg audio video canvas object datalist rp map".split())
_RAW = frozenset("script style title iframe noframes noembed noscript textarea xmp".split())
#: Blocks by the line breaks around them: 2 leave a blank line.
_BLOCK = dict.fromkeys("html body div section article main nav header footer aside address form fieldset legend details summary dialog dt dd li tr thead tbody tfoot caption figcaption hgroup search center optgroup option select textarea td th".split(), 1) | dict.fromkeys("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr menu xmp".split(), 2)
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Starts of these end an open paragraph.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
#: An open element that the start of another one ends, looked for up to one of the given bounds.
_IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th", "caption"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)), "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)), "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "body": (("head",), ("html",)), "rt": (("rt", "rp"), ("ruby",)), "rp": (("rt", "rp"), ("ruby",)),
}
_TABLE_PARTS = frozenset("tr td th thead tbody tfoot caption".split())
#: Starts of these, and no others, leave an open head open.
_IN_HEAD = frozenset("head base basefont bgsound link meta title script style noscript noframes template".split())
#: The widest that a column is made. A longer line stands alone, and what is right of it follows on the next line, in its own column.
COLUMN = 80
#: Characters of indentation at most; what is nested deeper begins there.
INDENT = 80
#: The largest colspan and rowspan that HTML has.
COLSPAN, ROWSPAN = 1000, 65534


class Node:
    __slots__ = ("tag", "attrs", "children", "visible", "gone")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None) -> None:
        self.tag, self.attrs = tag, attrs or {}
        self.children: list[Node | str] = []
        #: None: as its parent is.
        self.visible: bool | None = None
        #: Not displayed, nor what is in it: on the stack, so that its end is found, but not in the tree.
        self.gone = False


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(source):
        if value[:1] in ('"', "'"):
            value = value[1:-1] if len(value) > 1 and value[-1] == value[0] else value[1:]
        out.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return out


def _styled(node: Node) -> bool:
    """Set visible from the attributes; False if the element isn't displayed at all."""
    if "hidden" in node.attrs or node.tag == "dialog" and "open" not in node.attrs:
        return False
    for part in node.attrs.get("style", "").lower().split(";"):
        name, _, value = part.partition(":")
        name, value = name.strip(), value.replace("!important", "").strip()
        if name == "display" and value == "none":
            return False
        if name == "visibility":
            node.visible = value not in ("hidden", "collapse")
    return True


class _Open:
    """The open elements, and where each tag is among them, so that no look-up walks the stack."""

    def __init__(self, root: Node) -> None:
        self.stack = [root]
        self.where: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.where.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, i: int) -> None:
        """End the elements from place i on."""
        while len(self.stack) > i:
            self.where[self.stack.pop().tag].pop()

    def last(self, *tags: str) -> int:
        """The innermost place of one of the tags, or 0."""
        return max([places[-1] for t in tags if (places := self.where.get(t))], default=0)

    def first(self, tag: str) -> int:
        places = self.where.get(tag)
        return places[0] if places else 0


def parse(source: str) -> Node:
    """The tree of what can be seen: elements that aren't displayed are left out, inline elements without style are dissolved. Takes time in proportion to the source, however deep it is."""
    open_ = _Open(Node("html"))
    stack, where = open_.stack, open_.where
    at, end = 0, len(source)

    def text(piece: str) -> None:
        if stack[-1].tag == "head" and piece.strip():
            open_.cut(len(stack) - 1)
        if piece and not stack[-1].gone:
            stack[-1].children.append(unescape(piece) if "&" in piece else piece)

    def add(node: Node, opens: bool) -> None:
        node.gone = node.gone or stack[-1].gone
        if not node.gone:
            stack[-1].children.append(node)
        if opens:
            open_.push(node)

    def close(tags: tuple[str, ...], bounds: tuple[str, ...]) -> None:
        while (i := open_.last(*tags)) > open_.last("template", *bounds):
            open_.cut(i)

    for m in _MARKUP.finditer(source):
        if m.start() < at:
            continue
        text(source[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                add(Node("br"), False)
                continue
            i = open_.last(*(_HEADINGS if tag in _HEADINGS else (tag,)))
            bound = open_.last("table", "object", "template", *(() if tag in _TABLE_PARTS or tag == "table" else ("td", "th", "caption")))
            if i and i >= bound:
                open_.cut(i)
            elif tag == "p" and not i and not bound:
                add(Node("p"), False)
            continue
        rest = m[3]
        if rest.endswith("/") and stack[-1].gone and where.get("svg"):
            continue
        if tag not in _IN_HEAD and (i := open_.first("head")) and not 0 < open_.first("template") < i:
            open_.cut(i)
        if tag in ("html", "body"):
            node = Node(tag, attributes(rest)) if rest else None
            if node and not _styled(node):
                node.gone = True
                add(node, True)
            continue
        if tag in _RAW:
            found = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(source, at)
            stop = found.start() if found else end
            if tag in ("textarea", "xmp"):
                node = Node(tag, attributes(rest))
                if _styled(node):
                    node.children.append(unescape(source[at:stop]) if tag == "textarea" else source[at:stop])
                    add(node, False)
            at = stop
            continue
        if tag in _ENDS_P:
            close(("p",), ("td", "th", "caption", "table", "button", "object"))
        if (implied := _IMPLIED.get(tag)) is not None:
            close(*implied)
        if tag in _HIDDEN:
            if not rest.endswith("/") or tag != "svg":
                node = Node(tag)
                node.gone = True
                add(node, True)
            continue
        if tag in ("td", "th", "tr") and not where.get("table"):
            continue
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            add(Node("tr"), True)
        if tag in _HEADINGS and stack[-1].tag in _HEADINGS:
            open_.cut(len(stack) - 1)
        inline = tag not in _BLOCK and tag not in ("br", "rt", "ruby") and not where.get(tag)
        if inline and not rest:
            continue
        node = Node(tag, attributes(rest) if rest else None)
        if inline and not ("hidden" in node.attrs or "style" in node.attrs):
            continue
        node.gone = not _styled(node)
        add(node, tag not in _VOID)
    text(source[at:])
    return stack[0]


def _width(s: str) -> int:
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Page:
    """Lines of text under construction."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.want, self.space, self.indent, self.marker = 0, False, "", ""

    def breaks(self, n: int) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False
        self.want = max(self.want, n)

    def _begin(self) -> None:
        if self.want > 1 and self.lines and self.lines[-1]:
            self.lines.append("")
        self.want = 0
        self.line = [self.marker or self.indent]
        self.marker = ""

    def text(self, s: str) -> None:
        parts = s.split()
        if not parts:
            self.space = self.space or bool(s)
            return
        if not self.line:
            self._begin()
        elif self.space or s[0].isspace():
            self.line.append(" ")
        self.line.append(" ".join(parts))
        self.space = s[-1].isspace()

    def plain(self, s: str) -> None:
        """Text as it stands, as in pre."""
        for i, part in enumerate(s.replace("\r\n", "\n").split("\n")):
            if i:
                self.br()
            if part:
                if not self.line:
                    self._begin()
                self.line.append(part.expandtabs(8))

    def br(self) -> None:
        if self.line:
            self.breaks(1)
        else:
            self.want = 2

    def done(self) -> list[str]:
        self.breaks(0)
        return self.lines


def _number(value: str | None, default: int, most: int | None = None) -> int:
    m = re.match(r"\s*(-?\d{1,9})", value or "")
    n = int(m[1]) if m else default
    return n if most is None else max(1, min(n, most))


#: Rendering is by generators that yield the generators of what is inside them, so that depth costs no Python stack.
Steps = Iterator["Steps"]


def _run(steps: Steps) -> None:
    stack = [steps]
    while stack:
        inner = next(stack[-1], None)
        if inner is None:
            stack.pop()
        else:
            stack.append(inner)


def _gather(part: Node, seen: bool, rows: list[tuple[Node, bool]], before: list[str]) -> Steps:
    for x in part.children:
        if isinstance(x, Node):
            own = seen if x.visible is None else x.visible
            if x.tag == "tr":
                rows.append((x, own))
            elif x.tag in ("thead", "tbody", "tfoot"):
                yield _gather(x, own, rows, before)
            else:  # captions, and what is between rows, come before the table
                page = Page()
                yield _render(x, page, own, False)
                before.extend(page.done())
        elif seen and x.strip():
            before.append(" ".join(x.split()))


def _table(node: Node, visible: bool, out: list[str]) -> Steps:
    """Rows of cells in columns, each as wide as its widest line of up to COLUMN characters; a cell of several lines takes as many."""
    rows: list[tuple[Node, bool]] = []
    yield _gather(node, visible, rows, out)
    grid: list[dict[int, list[str]]] = []
    widths: dict[int, int] = {}  # of the columns that have text
    taken: list[tuple[int, int, int]] = []  # columns from and to that a cell of an earlier row still fills, and for how many rows
    for row, seen in rows:
        cells: dict[int, list[str]] = {}
        column, k = 0, 0
        taken.sort()
        new = []
        for x in row.children:
            if not isinstance(x, Node):
                if not x.strip() or not seen:
                    continue
                x, own = _wrap(x), seen
            else:
                own = seen if x.visible is None else x.visible
            while k < len(taken) and taken[k][0] <= column:
                column = max(column, taken[k][1])
                k += 1
            page = Page()
            yield _inside(x, page, own, False)
            if lines := page.done():
                cells[column] = lines
                widths[column] = max([widths.get(column, 0), *(w for line in lines if (w := _width(line)) <= COLUMN)])
            span, down = _number(x.attrs.get("colspan"), 1, COLSPAN), _number(x.attrs.get("rowspan"), 1, ROWSPAN)
            if down > 1:
                new.append((column, column + span, down - 1))
            column += span
        taken = [(a, b, n - 1) for a, b, n in taken if n > 1] + new
        grid.append(cells)
    starts, at = {}, 0
    for c in sorted(widths):
        starts[c] = at
        at += widths[c] + 2
    for cells in grid:
        for i in range(max((len(x) for x in cells.values()), default=0)):
            line, width = "", 0
            for c, cell in sorted(cells.items()):
                if i >= len(cell) or not cell[i].strip():
                    continue
                if width > starts[c]:  # too long a line is before it
                    out.append(line)
                    line, width = "", 0
                piece = " " * (starts[c] - width) + cell[i]
                line, width = line + piece, starts[c] + _width(cell[i]) + 2
                line += "  "
            if line.strip():
                out.append(line)
    out[:] = [line.rstrip() for line in out]


def _wrap(text: str) -> Node:
    node = Node("td")
    node.children.append(text)
    return node


def _render(node: Node, page: Page, visible: bool, pre: bool) -> Steps:
    """One element with the breaks, marker and indentation it brings."""
    tag = node.tag
    if tag == "br":
        page.br()
        return
    around = _BLOCK.get(tag, 0)
    if tag in ("ul", "ol", "menu") and page.indent:
        around = 1  # lists within items
    if around:
        page.breaks(around)
    if tag == "table":
        lines: list[str] = []
        yield _table(node, visible, lines)
        for line in lines:
            page._begin()
            page.line.append(line)
            page.breaks(1)
    elif tag in ("ul", "ol", "menu", "dd", "blockquote"):
        step = {"blockquote": "  ", "dd": "  "}.get(tag, "")
        kept = page.indent
        page.indent = (kept + step)[:INDENT]
        number = _number(node.attrs.get("start"), 1)
        for x in node.children if not step else ():
            if isinstance(x, Node) and x.tag == "li":
                number = _number(x.attrs.get("value"), number)
                mark = f"{number}. " if tag == "ol" else "- "
                number += 1
                page.breaks(1)
                page.marker, page.indent = (page.marker or kept)[:INDENT] + mark, (kept + " " * len(mark))[:INDENT]
                yield _inside(x, page, visible if x.visible is None else x.visible, pre)
                page.breaks(1)
                page.marker, page.indent = "", kept
            else:
                yield from _child(x, page, visible, pre)
        if step:
            yield _inside(node, page, visible, pre)
        page.breaks(1)
        page.indent = kept
    elif tag == "details" and "open" not in node.attrs:
        for x in node.children:
            if isinstance(x, Node) and x.tag == "summary":
                yield _render(x, page, visible if x.visible is None else x.visible, pre)
                break
    else:
        yield _inside(node, page, visible, pre or tag in ("pre", "textarea", "xmp"))
    if around:
        page.breaks(around)


def _child(x: Node | str, page: Page, visible: bool, pre: bool) -> Steps:
    if isinstance(x, str):
        if visible:
            page.plain(x) if pre else page.text(x)
    else:
        yield _render(x, page, visible if x.visible is None else x.visible, pre)


def _inside(node: Node, page: Page, visible: bool, pre: bool) -> Steps:
    for x in node.children:
        if isinstance(x, str):
            if visible:
                page.plain(x) if pre else page.text(x)
        else:
            yield _render(x, page, visible if x.visible is None else x.visible, pre)


def render(source: str | None) -> str:
    """The visible text of a page.

    Blocks stand on their own lines, paragraphs, headings, lists and tables with
    a blank line around them; list items have a marker or number and are
    indented by level, up to INDENT characters; table cells are in columns.  White space is collapsed but in pre.
    None, and a page without visible text, give the empty text.  Markup of any
    kind gives some text and never an error.
    """
    if not source:
        return ""
    page = Page()
    _run(_inside(parse(source.replace("\0", "")), page, True, False))
    lines = page.done()
    while lines and not lines[-1].strip():
        lines.pop()
    while lines and not lines[0].strip():
        lines.pop(0)
    return "\n".join(lines)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id long, text string) of every row of pages, repeated rows and null ids too. Null html has the empty text. Needs no shuffle."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 8 << 20):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([render(x) for x in batch.column(1).to_pylist()], pa.string())], ["page_id", "text"])

    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return rows.mapInArrow(apply, "page_id long, text string")
