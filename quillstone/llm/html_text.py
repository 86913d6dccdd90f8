"""HTML extraction by layout: a tree builder with implied tags, visibility rules, and a renderer that keeps the page's blocks.

The builder closes what HTML lets authors leave open (p, li, dt, dd, options, table parts) and ignores stray end tags. Hidden
elements give nothing. Blocks stand on lines of their own, some with a blank line around them; lists are marked and indented; cells of a table
row are aligned in columns; white space collapses except in pre and textarea.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded, plus, without

# Element names by their part in HTML's content model.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "xmp", "iframe", "noembed", "noframes"}
RCDATA = {"textarea", "title"}
HIDDEN = {"head", "title", "meta", "link", "base", "script", "style", "template", "noscript", "noembed", "noframes", "iframe", "object", "audio", "video", "canvas", "datalist", "area", "param", "source", "track", "col", "colgroup", "annotation", "annotation-xml", "mphantom"}
#: Of drawings only these show text; what stands in those is for reference, or shown elsewhere.
DRAWN, UNDRAWN = {"text", "foreignobject"}, {"desc", "defs", "metadata", "symbol", "clippath", "mask", "pattern", "marker"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption", "xmp", "textarea", "select"}
SPACED = {"blockquote", "dl", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "ol", "p", "pre", "table", "ul", "menu", "dir", "fieldset", "xmp"}
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul", "li", "dt", "dd", "xmp"}
#: A start tag ends open elements of these names, up to the nearest of those.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: An end tag doesn't reach past these.
SCOPES = {"table", "td", "th", "caption", "html", "template", "button"}

#: Columns from the margin from which on nested lists keep their marks without further indentation, and cells of nested tables stand below one another: 100 lists or tables deep. Else the lines of a page would grow with its depth.
MOST_INSET = 200

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*))(?:>|\Z)", re.DOTALL)
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"[ \t\n\r\f]+")
CLOSED = re.compile(r"(?:^|[\s\"']|(?:^|\s)[^\s=]+)/$")
NO_SHOW = re.compile(r"(?i)(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))")


class Node:
    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []

    def hidden(self) -> bool:
        a = self.attrs
        return self.name in HIDDEN or bool(a) and ("hidden" in a or self.name == "input" and a.get("type", "").lower() in ("hidden", "checkbox", "radio", "file", "image", "password") or "style" in a and bool(NO_SHOW.search(a["style"])) or self.name == "dialog" and "open" not in a) or self.name == "dialog" and not a


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTR.finditer(text):
        found.setdefault(m[1].lower(), html.unescape(next((x for x in m.groups()[1:] if x is not None), "")))
    return found


def tree(text: str) -> Node:
    """The document as a tree of nodes and strings; never fails."""
    root = Node("html", {})
    stack = [root]
    depth = Counter({"html": 1})  # open elements by name, so that nothing is sought in vain however deep the page is

    def end(k: int) -> None:
        """Ends the open elements from place k on."""
        depth.subtract(n.name for n in stack[k:])
        del stack[k:]

    def close(names: set[str], stops: set[str]) -> None:
        """Ends the nearest open element of these names, and all inside it, unless a stop is nearer; then the next."""
        if not any(depth[n] for n in names):
            return
        k = len(stack) - 1
        lowest = None
        while k > 0 and stack[k].name not in stops:
            if stack[k].name in names:
                lowest = k
            k -= 1
        if lowest:
            end(lowest)

    at, size = 0, len(text)
    while at < size:
        m = TOKEN.search(text, at)
        if m is None:
            stack[-1].children.append(html.unescape(text[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(html.unescape(text[at : m.start()]))
        at = m.end()
        if m["cdata"] is not None:
            stack[-1].children.append(m["cdata"])
        name = m["name"] and m["name"].lower()
        if not name:
            continue
        if m["end"]:
            if name == "br":
                stack[-1].children.append(Node("br", {}))
            elif name == "p" and not depth["p"]:
                stack[-1].children.append(Node("p", {}))
            elif name in HEADINGS:
                close(HEADINGS, SCOPES)
            elif depth[name]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == name:
                        end(k)
                        break
                    if stack[k].name in SCOPES and name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html", "td", "th"):
                        break
                    if stack[k].name == "table" and name != "table":
                        break
            continue
        if name in ("html", "body", "head") and depth[name]:
            continue
        if name in CLOSES_P:
            close({"p"}, SCOPES)
        if name in HEADINGS and stack[-1].name in HEADINGS:
            end(len(stack) - 1)
        if name in IMPLIED:
            close(*IMPLIED[name])
        if name == "body" or name in BLOCK:
            close({"head"}, {"body"})
        if name == "a":
            close({"a"}, SCOPES | BLOCK)
        node = Node(name, attributes(m["attrs"]) if m["attrs"] else {})
        stack[-1].children.append(node)
        if name in RAW or name in RCDATA:
            e = re.compile(rf"</{name}[\s/>]", re.IGNORECASE).search(text, at)
            inside = text[at : e.start() if e else size]
            node.children.append(html.unescape(inside) if name in RCDATA else inside)
            at = text.find(">", e.start()) + 1 or size if e else size
        elif m["attrs"].endswith("/") and CLOSED.search(m["attrs"]) and (name in ("svg", "math") or depth["svg"] or depth["math"]):
            pass  # only there a slash ends an element
        elif name not in VOID:
            stack.append(node)
            depth[name] += 1
    return root


def width(text: str) -> int:
    """Columns that a text takes: two for wide characters, none for combining ones."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Page:
    """Lines under construction: finished lines, the open line, how many blank lines the next block asks for, and how far the whole stands from the margin."""

    def __init__(self, inset: int = 0):
        self.inset = inset
        self.lines: list[str] = []
        self.open: list[str] = []
        self.ends_in_space, self.gap = True, 0
        self.tight = False  # inside a list item, whose lists follow without blank lines

    def text(self, s: str, keep: bool) -> None:
        if keep:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            self._put(first)
            for line in rest:
                self.line_end()
                self._put(line)
            return
        s = SPACE.sub(" ", s)
        if self.ends_in_space:
            s = s.removeprefix(" ")
        if s:
            self._put(s)
            self.ends_in_space = s[-1] == " "

    def _put(self, s: str) -> None:
        if s:
            if self.gap:
                if self.lines and self.lines[-1] != "":
                    self.lines.append("")
                self.gap = 0
            self.open.append(s)
            self.ends_in_space = False

    def line_end(self) -> None:
        """Ends the open line, even an empty one."""
        self.lines.append("".join(self.open).rstrip(" "))
        self.open, self.ends_in_space = [], True

    def block(self, spaced: bool) -> None:
        """The next text starts a line, after a blank line if spaced."""
        if self.open:
            self.line_end()
        self.ends_in_space = True
        self.gap = self.gap or int(spaced)

    def done(self) -> list[str]:
        if self.open:
            self.line_end()
        lines = self.lines
        while lines and not lines[0]:
            lines.pop(0)
        while lines and not lines[-1]:
            lines.pop()
        return lines


def drawn(node: Node) -> list:
    """The elements of a drawing that show text, each between spaces."""
    found, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str) or n.hidden() or n.name in UNDRAWN or n.attrs.get("display") == "none" or n.attrs.get("visibility") in ("hidden", "collapse"):
            continue
        if n.name in DRAWN:
            found += [" ", n, " "]
        else:
            todo += reversed(n.children)
    return found


def finished(step: Generator) -> object:
    """What a rendering step returns. Steps yield the steps that they wait for, which are kept in a list rather than on Python's stack: pages may be nested to any depth."""
    waiting, value = [step], None
    while waiting:
        try:
            waiting.append(waiting[-1].send(value))
            value = None
        except StopIteration as e:
            waiting.pop()
            value = e.value
    return value


def flow(nodes: list, page: Page, keep: bool) -> Generator:
    for n in nodes:
        if isinstance(n, str):
            page.text(n, keep)
            continue
        if n.hidden():
            continue
        name = n.name
        if name == "br":
            page.line_end()
        elif name == "wbr" or name == "img":
            pass
        elif name == "svg":
            yield flow(drawn(n), page, keep)
        elif name == "input":
            page.text(n.attrs.get("value", ""), False)
        elif name in ("ul", "ol", "menu", "dir"):
            yield listed(n, page, keep)
        elif name == "table":
            page.block(True)
            if page.inset >= MOST_INSET:
                yield flow([x for c in n.children for x in ("\n", c)], page, keep)
            for line in (yield table_lines(n, page.inset + 2)) if page.inset < MOST_INSET else ():
                page.text(line, True)
                page.line_end()
            page.block(True)
        elif name == "hr":
            page.block(False)
            page.text("---", False)
            page.block(False)
        elif name == "details" and "open" not in n.attrs:
            page.block(False)
            yield flow([c for c in n.children if isinstance(c, Node) and c.name == "summary"][:1], page, keep)
            page.block(False)
        elif name == "q":
            yield flow(["“", *n.children, "”"], page, keep)
        elif name in BLOCK:
            page.block(name in SPACED)
            if name in ("blockquote", "dd"):
                yield indented(n.children, page, "  ", "  ", keep)
            else:
                children = n.children
                inner = keep or name in ("pre", "textarea", "xmp")
                if inner and not keep and children and isinstance(children[0], str):
                    children = [children[0].removeprefix("\r").removeprefix("\n"), *children[1:]]
                yield flow(children, page, inner)
            page.block(name in SPACED)
        else:
            yield flow(n.children, page, keep)


def indented(nodes: list, page: Page, first: str, rest: str, keep: bool, tight: bool = False) -> Generator:
    """The nodes as lines of their own behind a mark."""
    if page.inset >= MOST_INSET:
        page.text(first, True)
        yield flow(nodes, page, keep)
        page.block(False)
        return
    inner = Page(page.inset + len(rest))
    inner.tight = tight
    yield flow(nodes, inner, keep)
    for k, line in enumerate(inner.done()):
        page.text((first if k == 0 else rest) + line if line or k == 0 else line, True)
        page.line_end()


def listed(node: Node, page: Page, keep: bool) -> Generator:
    page.block(not page.tight)
    start = node.attrs.get("start", "")
    number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    for c in node.children:
        if isinstance(c, Node) and c.name == "li":
            if c.hidden():
                continue
            mark = "- "
            if node.name == "ol":
                value = c.attrs.get("value", "")
                number = int(value) if re.fullmatch(r"-?\d{1,9}", value) else number
                mark, number = f"{number}. ", number + 1
            page.block(False)
            yield indented(c.children, page, mark, " " * len(mark), keep, tight=True)
        elif isinstance(c, Node) and c.name in ("ul", "ol", "menu", "dir") and not c.hidden():
            yield indented([c], page, "  ", "  ", keep, tight=True)
        else:
            yield flow([c], page, keep)
    page.block(not page.tight)


def table_lines(node: Node, inset: int) -> Generator:
    """A table's caption, and its rows with cells padded to their columns, two spaces apart. Cells of several lines take as many."""
    rows: list[list[tuple[list[str], int]]] = []
    above: list[str] = []

    def cells(parent: Node) -> Generator:
        row: list[tuple[list[str], int]] = []
        for c in parent.children:
            if isinstance(c, str) or c.hidden():
                if isinstance(c, str) and c.strip():
                    above.extend((yield lines_of([c], inset)))
                continue
            if c.name in ("td", "th"):
                span = c.attrs.get("colspan", "1")
                row.append(((yield lines_of(c.children, inset)), max(1, min(int(span), 1000)) if re.fullmatch(r"\d{1,6}", span) else 1))
            elif c.name in ("tr", "tbody", "thead", "tfoot"):
                yield cells(c)
            else:
                above.extend((yield lines_of([c], inset)))
        if row:
            rows.append(row)

    yield cells(node)
    widths: dict[int, int] = {}
    for row in rows:
        k = 0
        for lines, span in row:
            if span == 1:
                widths[k] = max([widths.get(k, 0), *map(width, lines)])
            k += span
    out = above
    for row in rows:
        for j in range(max(len(lines) for lines, _ in row)):
            parts, k = [], 0
            for lines, span in row:
                s = lines[j] if j < len(lines) else ""
                room = sum(widths.get(i, 0) for i in range(k, k + span)) + 2 * (span - 1)
                parts.append(s + " " * max(0, room - width(s)))
                k += span
            out.append("  ".join(parts).rstrip(" "))
    return out


def lines_of(nodes: list, inset: int) -> Generator:
    page = Page(inset)
    yield flow(nodes, page, False)
    return [line for line in page.done() if line]


def rendered(page_html: str | None) -> str:
    """All visible text of a page: that of formulas and drawings too."""
    page = Page()
    finished(flow(tree(page_html or "").children, page, False))
    return "\n".join(page.done()).replace("\xa0", " ")


def visible_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds text (string): the page's visible text.

    Null and empty pages, and pages without visible text, give an empty text; broken markup is read as a browser would, never refused. Whole
    pages are read, to any depth; lists and tables that stand MOST_INSET columns from the margin aren't indented or aligned further. A page without a tag is its own text with white space collapsed. Repeated rows are rendered each. Other columns pass through; an
    input column text is replaced. An empty table gives an empty table.
    """
    kept = without(pages, ["text"] if html_col != "text" else [])
    place = kept.columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([rendered(x.as_py()) for x in batch.column(place)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, "text"])

    return bounded(kept).mapInArrow(run, plus(kept, ("text", "string")))
