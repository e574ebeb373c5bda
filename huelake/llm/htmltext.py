"""Layout-aware text of HTML pages.

A tokenizer and a tree builder with the implied tags of HTML make a tree; visibility
rules drop what a browser would not show; a renderer writes all visible text with the
spacing of blocks, list markers, preformatted text, and tables in aligned cells. All
three are loops over explicit stacks, so depth is not limited; the parser looks up open
elements by name, so time grows with a page's length and not with its depth.

Defined results: null html gives null text; a page without visible text gives an empty
one; broken markup is closed as a browser would; rows are independent, so repeated rows
have equal results; text is indented by at most MOST_INDENT columns, cells of a table
wider than MOST_WIDTH are separated but not aligned, and tables nested deeper than
MOST_TABLES are written cell by cell as blocks, all with their whole text; columns named
text are replaced, others pass through.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from .common import give_back

# The element kinds of the HTML standard that matter here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas svg math datalist title meta link select textarea".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul caption tbody thead tfoot tr td th listing xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure fieldset hr article section".split())
CLOSES_P = BLOCK - frozenset("body html caption tbody thead tfoot tr td th dd dt li legend".split()) | {"li", "dd", "dt"}
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: An opening tag closes these open elements, up to a boundary.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
}
SCOPE = frozenset("table td th caption html body button object marquee template".split())

RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
#: What follows a tag's name, by the standard's states: a quote opens a value only behind '=' and its spaces, elsewhere it belongs
#: to a name or an unquoted value; '=' at a name's start belongs to the name. A tag that the page's end cuts off is dropped.
W = r" \t\n\r\f"
VALUE = rf"\"(?:[^\"]*\"|[^\"]*$)|'(?:[^']*'|[^']*$)|[^{W}>\"'][^{W}>]*+"
REST = rf"(?:[{W}/]++|[^{W}/>][^{W}/>=]*+(?:[{W}]*+=[{W}]*+(?:{VALUE})?+)?+)*+"
TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<![^>]*>?|<\?[^>]*>?|<(?:/(?P<close>[A-Za-z][^{W}/>]*)|(?P<open>[A-Za-z][^{W}/>]*))(?P<rest>{REST})(?P<end>>|$)", re.S)
ATTRIBUTE = re.compile(rf"([^{W}/>][^{W}/>=]*+)(?:[{W}]*+=[{W}]*+(?:\"([^\"]*)\"|'([^']*)'|([^{W}>\"'][^{W}>]*+))?+)?+")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)|font-size\s*:\s*0(?:px|em|%)?\s*(?:;|$)|opacity\s*:\s*0(?:\.0*)?\s*(?:;|$)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")
MOST_INDENT, MOST_WIDTH, MOST_TABLES = 64, 4096, 16


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


class Open:
    """The open elements, innermost last, with the places of each name among them."""

    def __init__(self, root: Node) -> None:
        self.nodes: list[Node | None] = [root]  # None: closed while blocks that opened inside it are still open
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    @property
    def top(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node) -> None:
        self.top.children.append(node)
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def last(self, names) -> int:
        """Place of the innermost element of these names; 0, the root's, if there is none."""
        places = self.places
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def pop(self) -> None:
        node = self.nodes.pop()
        self.places[node.tag].pop()
        if node.tag in BLOCK:
            self.blocks.pop()
        while self.nodes[-1] is None:
            self.nodes.pop()

    def cut(self, place: int) -> None:
        while len(self.nodes) > place:
            self.pop()

    def close(self, names, bounds) -> bool:
        """Closes down to the innermost element of `names`, unless one of `bounds` is inside of it."""
        at = self.last(names)
        if not at or at < self.last(bounds):
            return False
        self.cut(at)
        return True

    def drop(self, place: int) -> None:
        """Closes the innermost element of its name alone."""
        self.places[self.nodes[place].tag].pop()
        self.nodes[place] = None


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("head title meta link script style base template noscript".split())
TABLE_PARTS = frozenset("table tbody thead tfoot tr".split())
CELL_BOUNDS = frozenset("td th caption".split())


def parse(html: str) -> Node:
    """The tree of a page; text is in `children` as strings."""
    root = Node("html", {})
    stack = Open(root)

    def text(value: str) -> None:
        if value:
            if stack.top.tag in TABLE_PARTS and value.strip() and (at := stack.last(("table",))):
                # text in a table, outside of its cells, stands before it; what encloses an open table is never closed alone
                outer = stack.nodes[at - 1].children
                outer.insert(len(outer) - 1, unescape(value))
            else:
                stack.top.children.append(unescape(value))

    at, n = 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        if not m:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        if m["end"] == "":
            break
        if m["open"]:
            tag = m["open"].lower()
            attrs = {a.lower(): unescape(x or y or z) for a, x, y, z in ATTRIBUTE.findall(m["rest"])} if m["rest"] and not m["rest"].isspace() else {}
            if tag in ("html", "body"):
                for k, v in attrs.items():
                    root.attrs.setdefault(k, v)
                continue
            if tag not in IN_HEAD:
                stack.close(("head",), ())
            if tag in CLOSES_P and stack.places.get("p"):
                stack.close(("p",), SCOPE)
            if tag in IMPLIED:
                names, bounds = IMPLIED[tag]
                while stack.close(names, bounds):
                    pass
            if tag in HEADINGS and stack.top.tag in HEADINGS:
                stack.pop()
            if tag in ("a", "button", "nobr"):
                stack.close((tag,), SCOPE)
            if tag in ("td", "th") and stack.top.tag in ("table", "tbody", "thead", "tfoot"):
                stack.push(Node("tr", {}))
            node = Node(tag, attrs)
            if tag in VOID or tag in RAW:
                stack.top.children.append(node)
            else:
                stack.push(node)
            if tag in RAW:
                end = RAW_END[tag].search(html, at)
                raw = html[at : end.start()] if end else html[at:]
                node.children.append(unescape(raw) if tag in ("title", "textarea") else raw)
                if not end:
                    break
                close = html.find(">", end.start())
                at = n if close < 0 else close + 1
        elif m["close"]:
            tag = m["close"].lower()
            if tag == "br":
                stack.top.children.append(Node("br", {}))
            elif tag == "p" and not stack.places.get("p"):
                stack.top.children.append(Node("p", {}))
            elif tag in FORMATTING and (place := stack.last((tag,))) and stack.blocks and stack.blocks[-1] > place:
                if stack.last(SCOPE) < place:
                    stack.drop(place)  # the blocks that opened inside stay open
            elif tag not in ("html", "body"):
                stack.close((tag,), ({"table"} if tag in TABLE_PARTS else CELL_BOUNDS | {"table"}) - {tag})
    return root


def hidden(node: Node) -> bool:
    """Whether a browser without scripts would not paint the element."""
    if node.tag in HIDDEN:
        return True
    a = node.attrs
    if not a:
        return False
    return "hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden") or (node.tag == "dialog" and "open" not in a) or bool("style" in a and INVISIBLE.search(a["style"]))


class Flow:
    """Text of one block container: lines with collapsed spaces and margins."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.indent = ""
        self.mark = ""
        self.gap = False

    def inline(self, value: str, keep: bool) -> None:
        if keep:
            first, *others = value.split("\n")
            self.now.append(first)
            for line in others:
                self.line(True)
                self.now.append(line)
            return
        value = SPACE.sub(" ", value)
        if value.startswith(" ") and (not self.now or self.now[-1].endswith(" ")):
            value = value[1:]
        if value:
            self.now.append(value)

    def line(self, always: bool = False) -> None:
        made = "".join(self.now).rstrip(" ")
        self.now = []
        if made or always:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append((self.indent + self.mark + made).rstrip() if made else "")
            if made and self.mark:
                self.deeper(" " * len(self.mark))
                self.mark = ""

    def deeper(self, by: str) -> None:
        if len(self.indent) < MOST_INDENT:
            self.indent += by

    def done(self) -> list[str]:
        self.line()
        return self.lines


def table_lines(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of cells (lines, columns spanned, rows spanned), aligned unless the table is wider than MOST_WIDTH.

    Only cells take time and place, however many columns or rows they span.
    """
    held: list[tuple[int, int, int]] = []  # (first column, column behind, row behind) of cells that reach down, by column
    widths: dict[int, int] = {}
    grid: list[list[tuple[int, int, list[str]]]] = []
    for number, row in enumerate(rows):
        held = [h for h in held if h[2] > number]
        column, i, out, new = 0, 0, [], []
        for lines, span, down in row:
            while i < len(held) and held[i][0] <= column:
                column = max(column, held[i][1])
                i += 1
            if any(lines):
                out.append((column, column + span, lines))
                widths[column] = max(widths.get(column, 0), max(map(len, lines)) if span == 1 else 0)
            if down > 1:
                new.append((column, column + span, min(number + down, len(rows))))
            column += span
        grid.append(out)
        if new:
            merged: list[tuple[int, int, int]] = []
            for h in sorted(held + new):
                if merged and merged[-1][1] == h[0] and merged[-1][2] == h[2]:
                    merged[-1] = (merged[-1][0], h[1], h[2])
                else:
                    merged.append(h)
            held = merged
    used, starts, wide = sorted(widths), [], 0
    for column in used:
        starts.append(wide)
        wide += widths[column] + 2
    aligned = wide <= MOST_WIDTH
    starts.append(1 << 60)  # behind the last column is room
    made = []
    for row in grid:
        placed = [(starts[bisect_left(used, a)], starts[bisect_left(used, b)], lines) for a, b, lines in row]
        for k in range(max((len(lines) for _, _, lines in placed), default=0)):
            line, shift = "", 0
            for start, behind, lines in placed:
                value = lines[k] if k < len(lines) else ""
                if value:
                    line = line.ljust(start + shift) + value if aligned else f"{line}  {value}" if line else value
                    shift += max(0, len(value) - (behind - start - 2))  # what a spanning cell has too much
            line = line.rstrip()
            if line:
                made.append(line)
    return made


#: Fixed values of the standard: the most columns and rows that a cell spans.
MOST_SPAN = {"colspan": 1000, "rowspan": 65534}
NUMBER = re.compile(rf"[{W}]*\+?([0-9]+)")


def _span(node: Node, name: str) -> int:
    m = NUMBER.match(node.attrs.get(name, ""))
    if not m:
        return 1
    value = int(m[1]) if len(m[1].lstrip("0")) < 7 else MOST_SPAN[name]
    if not value:  # a cell that reaches down to the end of its table
        return MOST_SPAN[name] if name == "rowspan" else 1
    return min(value, MOST_SPAN[name])


def render(root: Node) -> str:
    """All visible text. The work list holds what is still to do, innermost last."""
    flows = [Flow()]
    tables: list[list[list[tuple[list[str], int, int]]]] = []
    depth = 0  # open tables, with those that are written as blocks
    lists: list[list] = []  # [kind, next number]
    work: list[tuple] = [("node", root, False)]
    while work:
        what, node, keep = work.pop()
        flow = flows[-1]
        if what == "end":
            node(flow)
            continue
        if isinstance(node, str):
            flow.inline(node, keep)
            continue
        if hidden(node):
            continue
        tag = node.tag
        keep = keep or tag in ("pre", "listing", "xmp")
        if tag == "br":
            flow.line(True)
            continue
        if tag == "img":
            continue
        if tag == "input":
            kind = node.attrs.get("type", "text").lower()
            if kind in ("submit", "button", "reset") and node.attrs.get("value"):
                flow.inline(node.attrs["value"], False)
            continue
        if tag == "table":
            flow.line()
            flow.gap = True
            depth += 1
            if depth <= MOST_TABLES:
                tables.append([])

            def end_table(outer: Flow) -> None:
                nonlocal depth
                outer.line()
                depth -= 1
                if depth >= MOST_TABLES:
                    outer.gap = True
                    return
                lines = table_lines(tables.pop())
                for line in lines:
                    outer.now = [line]
                    outer.line()
                outer.gap = True

            work.append(("end", end_table, False))
        elif tag == "tr" and 0 < depth <= MOST_TABLES:
            tables[-1].append([])
        elif tag in ("td", "th") and 0 < depth <= MOST_TABLES:
            if not tables[-1]:
                tables[-1].append([])
            flows.append(Flow())

            def end_cell(inner: Flow, node=node) -> None:
                flows.pop()
                tables[-1][-1].append((inner.done(), _span(node, "colspan"), _span(node, "rowspan")))

            work.append(("end", end_cell, False))
        elif tag in BLOCK:
            flow.line()
            spaced = tag in SPACED and not (tag in ("ul", "ol") and lists)
            if spaced:
                flow.gap = True
            indent, mark = flow.indent, flow.mark
            if tag in ("ul", "ol", "menu", "dir"):
                begin = node.attrs.get("start", "")
                lists.append([tag, int(begin) if begin.lstrip("-").isdecimal() and len(begin) < 9 else 1])
            elif tag == "li":
                number = lists[-1] if lists else ["ul", 1]
                if flow.mark:  # an item that starts with a list: its own mark stands alone
                    flow.now = [""]
                flow.mark = f"{number[1]}. " if number[0] == "ol" else "- "
                number[1] += 1
            elif tag in ("blockquote", "dd"):
                flow.deeper("    " if tag == "dd" else "  ")
            if tag == "hr":
                flow.gap = True

            def end_block(own: Flow, tag=tag, indent=indent, mark=mark, spaced=spaced) -> None:
                own.line()
                if tag in ("ul", "ol", "menu", "dir"):
                    lists.pop()
                    own.indent = indent if not mark else own.indent
                elif tag == "li":
                    own.indent, own.mark = indent, ""
                elif tag in ("blockquote", "dd"):
                    own.indent = indent
                if spaced:
                    own.gap = True

            work.append(("end", end_block, False))
        elif tag == "option":
            flow.line()
        children = node.children
        if keep and children and isinstance(children[0], str) and tag == "pre" and children[0].startswith("\n"):
            children = [children[0][1:], *children[1:]]
        work.extend(("node", c, keep) for c in reversed(children))
    return "\n".join(flows[0].done()).strip("\n")


def page_text(html: str | None) -> str | None:
    return None if html is None else render(parse(html))


def extract(pages: DataFrame, *, html: str = "html") -> DataFrame:
    """`pages` with column text. One pass, no shuffle."""
    plain = pages.drop("text")
    at = plain.columns.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([page_text(x.as_py()) for x in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "text"])
        give_back()

    return plain.mapInArrow(run, StructType([*plain.schema.fields, StructField("text", StringType())]))
