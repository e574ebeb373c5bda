"""HTML rendering against an independent recursive renderer over generated pages, and hostile pages."""

import random
import time

import pytest

from huelake.llm import htmltext

INLINE = ("b", "i", "span", "em")
BLOCKS = {"div": False, "p": True, "section": True, "blockquote": True}


def make(rng, depth=0):
    """A random tree: ("text", words), (tag, children), ("list", ordered, items) or ("grid", rows of texts)."""
    kind = rng.choice(["text", "inline", "block", "block", "list", "grid", "hidden"] if depth < 4 else ["text"])
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    if kind == "text":
        return ("text", [word() for _ in range(rng.randint(1, 4))])
    if kind == "inline":
        return ("inline", rng.choice(INLINE), [("text", [word() for _ in range(rng.randint(1, 3))])])
    if kind == "list":
        return ("list", rng.random() < 0.5, [[("text", [word()])] + [x for x in [make(rng, depth + 2)] if x[0] in ("text", "list")] for _ in range(rng.randint(1, 3))])
    if kind == "grid":
        return ("grid", [[word() if rng.random() < 0.9 else "" for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 3))])
    children = [make(rng, depth + 1) for _ in range(rng.randint(1, 3))]
    return ("hidden", children) if kind == "hidden" else ("block", rng.choice(list(BLOCKS)), children)


def html(rng, node):
    """Writes the tree with random spaces, cases, and end tags left out where HTML implies them."""
    space = lambda: rng.choice([" ", "\n", "  \t"])
    kind = node[0]
    if kind == "text":
        return space() + space().join(node[1]) + space()
    if kind == "inline":
        return f"<{node[1]}>{''.join(html(rng, c) for c in node[2])}</{node[1]}>"
    if kind == "hidden":
        return f"<div {rng.choice(['hidden', 'style=display:none'])}>{''.join(html(rng, c) for c in node[1])}</div>"
    if kind == "list":
        tag, end = "ol" if node[1] else "ul", rng.choice(["</li>", ""])
        return f"<{tag}>" + "".join(f"<LI>{''.join(html(rng, c) for c in item)}{end}" for item in node[2]) + f"</{tag}>"
    if kind == "grid":
        end, row = rng.choice(["</td>", ""]), rng.choice(["</tr>", ""])
        return "<table>" + "".join("<tr>" + "".join(f"<td>{c}{end}" for c in r) + row for r in node[1]) + "</table>"
    tag = node[1]
    inner = "".join(html(rng, c) for c in node[2])
    if tag == "p":  # a paragraph ends where a block begins
        tag = "section"
    return f"<{tag}>{inner}</{tag}>"


class Slow:
    """Lines with the margins between them, written by recursion."""

    def __init__(self):
        self.out, self.now, self.gap = [], [], False

    def flush(self, indent):
        line = " ".join(self.now)
        self.now = []
        if line:
            if self.gap and self.out:
                self.out.append("")
            self.gap = False
            self.out.append(indent + line)
            return True
        return False

    def write(self, node, indent, in_list):
        kind = node[0]
        if kind == "text":
            self.now += node[1]
        elif kind == "inline":
            for c in node[2]:
                self.write(c, indent, in_list)
        elif kind == "grid":
            self.flush(indent)
            self.gap = True
            rows = [r for r in node[1]]
            columns = [max((len(r[c]) for r in rows if c < len(r)), default=0) for c in range(max(map(len, rows)))]
            for r in rows:
                line = "  ".join(f"{r[c] if c < len(r) else '':<{w}}" for c, w in enumerate(columns) if w).rstrip()
                if line:
                    self.now = [line]
                    self.flush(indent)
            self.gap = True
        elif kind == "block":
            spaced = node[1] != "div"
            self.flush(indent)
            self.gap = self.gap or spaced
            inner = indent + ("  " if node[1] == "blockquote" else "")
            for c in node[2]:
                self.write(c, inner, in_list)
            self.flush(inner)
            self.gap = self.gap or spaced
        elif kind == "list":
            self.flush(indent)
            self.gap = self.gap or not in_list
            for i, item in enumerate(node[2], 1):
                mark = f"{i}. " if node[1] else "- "
                words = []
                rest = list(item)
                while rest and rest[0][0] == "text":
                    words += rest.pop(0)[1]
                self.now = [mark + " ".join(words)]
                self.flush(indent)
                for c in rest:
                    self.write(c, indent + " " * len(mark), True)
                self.flush(indent + " " * len(mark))
            self.gap = self.gap or not in_list


@pytest.mark.parametrize("seed", range(300))
def test_pages_equal_the_slow_renderer(seed):
    rng = random.Random(seed)
    tree = [make(rng) for _ in range(rng.randint(1, 4))]
    slow = Slow()
    for node in tree:
        slow.write(node, "", False)
    slow.flush("")
    assert htmltext.page_text("".join(html(rng, n) for n in tree)) == "\n".join(slow.out).strip("\n")


HOSTILE = {
    "lists": "<ul><li>" * 40000 + "x", "tables": "<table><tr><td>" * 40000 + "x", "paragraphs": "<p>a" * 40000, "formatting": "<b><div>" * 20000 + "</b>" * 20000 + "x", "definitions": "<dl><dd>x" * 20000,
    "spans": "<table>" + "<tr><td rowspan=60000 colspan=1000>x" * 8000, "different spans": "<table>" + "".join(f"<tr><td rowspan={i}>x" for i in range(2, 2000)), "ends": "</b></i></div>" * 30000, "cells in text": "<table><tr><td>a\n" * 3000 + "long text " * 4000,
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_hostile_pages_take_linear_time(name):
    began = time.perf_counter()
    text = htmltext.page_text(HOSTILE[name])
    assert time.perf_counter() - began < 4  # about 0.5 s on a quiet core
    words = {"lists": 1, "tables": 1, "paragraphs": 40000, "formatting": 1, "definitions": 20000, "spans": 8000, "different spans": 1998, "ends": 0, "cells in text": 3000 + 8000}
    assert sum(w not in "-" for w in text.split()) == words[name]


@pytest.mark.parametrize("value,columns,rows", [("0", 1, 65534), ("3", 3, 3), (" 2px", 2, 2), ("-1", 1, 1), ("x", 1, 1), ("100000", 1000, 65534), ("", 1, 1), ("2000", 1000, 2000)])
def test_spans_as_in_html(value, columns, rows):
    node = htmltext.Node("td", {"colspan": value, "rowspan": value})
    assert (htmltext._span(node, "colspan"), htmltext._span(node, "rowspan")) == (columns, rows)


def test_spans_keep_columns():
    assert htmltext.page_text("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d<td>e</table>") == "a  b\n   c\n   d  e"
    assert htmltext.page_text("<table><tr><td colspan=2>ab<td>c<tr><td>d<td>e<td>f</table>") == "ab    c\nd  e  f"
    assert htmltext.page_text("<table><tr><td>x<tr><td>x</table><table><tr><td>x</table>") == "x\nx\n\nx"  # repeated cells stay


def test_wide_tables_keep_all_text():
    text = htmltext.page_text("<table><tr><td>" + "w" * 5000 + "<td>b<tr><td>c<td>d</table>")
    assert text == "w" * 5000 + "  b\nc  d"
