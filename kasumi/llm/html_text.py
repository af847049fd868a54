"""The visible text of HTML, laid out: a tree builder with implied tags, visibility rules and a renderer.

The builder closes what a tag implies to be over (a paragraph at a block, a list
item at the next, cells and rows), opens the row that a lone cell implies, moves
text that stands loose in a table before it, and ignores end tags of nothing. The
renderer drops what is not shown: scripts, styles, templates, the head, ``hidden``,
``display: none`` inline or by a simple selector of the page's own style sheets,
``visibility: hidden`` unless undone inside, closed details and dialogs. All else
comes out: blocks on lines of their own, paragraphs and headings with blank lines
between, list items with markers and indentation, cells in aligned columns,
preformatted text as it is.

Nulls and edge cases: null HTML gives null, empty HTML the empty text; text without
tags is text; a tag that never ends swallows the rest, as in browsers; elements
nested deeper than ``DEEPEST`` go beside each other; pages of any length are read
whole; repeated rows, and rows that repeat an id, give a row each; an empty table
gives no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEEPEST = 200
#: Widest padding of a column, and most rows or columns a cell may span (the latter from the HTML standard).
WIDEST, MOST_SPANNED = 60, 1000

# Fixed values of HTML: kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
UNSEEN = frozenset("head script style template title noscript noframes noembed iframe object audio video canvas datalist rp param source track link meta base area map".split())
#: What svg and math hold but do not show.
FOREIGN_UNSEEN = frozenset("annotation annotation-xml clippath defs desc filter lineargradient marker mask metadata pattern radialgradient symbol".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table ul xmp caption thead tbody tfoot tr svg-text".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre figure table hr fieldset listing xmp plaintext".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt listing main menu nav ol p pre search section summary table ul xmp plaintext".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PREFORMATTED = frozenset("pre listing xmp plaintext textarea".split())
GROUPS = frozenset("thead tbody tfoot".split())
CELLS = frozenset("td th".split())
SCOPES = frozenset("table td th caption button html template object".split())
#: What a start tag ends, and where the search for it stops.
ENDS = {
    "li": ({"li"}, SCOPES | {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, SCOPES | {"dl"}),
    "dd": ({"dt", "dd"}, SCOPES | {"dl"}),
    "option": ({"option"}, SCOPES | {"select", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, SCOPES | {"select"}),
    "td": (CELLS, {"table", "tr"}),
    "th": (CELLS, {"table", "tr"}),
    "tr": ({"tr", "caption"}, {"table"}),
    "thead": (GROUPS | {"caption"}, {"table"}),
    "tbody": (GROUPS | {"caption"}, {"table"}),
    "tfoot": (GROUPS | {"caption"}, {"table"}),
    "a": ({"a"}, SCOPES),
    "body": ({"head"}, {"html"}),
}
# Attributes as browsers cut them: a quote opens a value only after "=", elsewhere it is part of a name or a value.
NAME = r"[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+"
EQUALS = r"[ \t\n\f\r]*+=[ \t\n\f\r]*+"
UNQUOTED = r"[^ \t\n\f\r>\"'][^ \t\n\f\r>]*+"
TAG = re.compile(rf"<(/?)([a-zA-Z][^ \t\n\f\r/>]*+)((?:[ \t\n\f\r/]++|{NAME}(?:{EQUALS}(?:\"[^\"]*+\"|'[^']*+'|{UNQUOTED}|(?=>))|(?!{EQUALS})))*+)>")
#: Where a comment ends; one that begins with its end is empty.
COMMENT_END, EMPTY_COMMENT = re.compile("--!?>"), re.compile("<!--(?:-?>|--!?>)")
ATTRIBUTE = re.compile(rf"({NAME})(?:{EQUALS}(?:\"([^\"]*+)\"|'([^']*+)'|({UNQUOTED})|))?")
#: The end tag of each raw element.
RAW_END = {tag: re.compile(rf"</{tag}(?=[ \t\n\f\r/>])", re.I | re.A) for tag in RAW}
HIDING = re.compile(r"([^{}]*)\{[^{}]*\bdisplay\s*:\s*none\b[^{}]*\}", re.I)
COMMENT = re.compile(r"/\*.*?\*/", re.S)
SIMPLE = re.compile(r"^(?:[a-z][\w-]*|[.#][\w-]+)$", re.I)
DISPLAY_NONE = re.compile(r"\bdisplay\s*:\s*none\b", re.I)
VISIBILITY = re.compile(r"\bvisibility\s*:\s*(\w+)", re.I)
BLANK = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Node | str] = []


def attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(raw):
        value = a or b or c
        found.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return found


class Builder:
    """Grows the tree; ``stack`` holds the open elements."""

    def __init__(self):
        self.root = Node("html")
        self.stack = [self.root]
        self.sheets: list[str] = []
        self.drawn = False  # whether svg or math was ever opened

    def _end(self, wanted: frozenset[str] | set[str], until: frozenset[str] | set[str]) -> bool:
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[k].tag
            if tag in wanted:
                del self.stack[k:]
                return True
            if tag in until:
                return False
        return False

    def text(self, raw: str) -> None:
        if not raw:
            return
        top = self.stack[-1]
        if top.tag in ("table", "tr") or top.tag in GROUPS:
            if not raw.strip():
                return
            table = next(x for x in reversed(self.stack) if x.tag == "table" or x is self.root)
            if table.parent is not None:  # loose text goes before the table
                table.parent.children.insert(table.parent.children.index(table), raw)
                return
        top.children.append(raw)

    def foreign(self) -> bool:
        """Whether svg or math is open, and no HTML inside it."""
        return self.drawn and next((x.tag in ("svg", "math") for x in reversed(self.stack) if x.tag in ("svg", "math", "foreignobject")), False)

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if self.foreign():
            attrs = attrs | {"hidden": ""} if tag in FOREIGN_UNSEEN else attrs
            if closed:
                self.stack[-1].children.append(Node(tag, attrs, self.stack[-1]))
                return
            tag = "svg-text" if tag == "text" else tag
        if tag in ("html", "body") and (tag == "html" or any(x.tag == "body" for x in self.stack)):
            self.stack[0].attrs = attrs | self.stack[0].attrs if tag == "html" else self.stack[0].attrs
            return
        if self.stack[-1].tag == "head" and tag not in UNSEEN:
            self.stack.pop()
        if tag in CLOSES_P:
            self._end({"p"}, SCOPES)
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.stack.pop()
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag in GROUPS or tag == "tr":
            self._end({"tr"}, {"table"}) if tag == "tr" else None
        if tag in CELLS and self.stack[-1].tag != "tr" and (self.stack[-1].tag == "table" or self.stack[-1].tag in GROUPS):
            self._open("tr", {})
        self._open(tag, attrs)
        if tag in VOID or closed and tag not in BLOCKS and tag not in RAW and len(self.stack) > 1:
            if self.stack[-1].tag == tag and tag in VOID:
                self.stack.pop()

    def _open(self, tag: str, attrs: dict[str, str]) -> None:
        while len(self.stack) > DEEPEST:
            self.stack.pop()
        self.drawn = self.drawn or tag in ("svg", "math")
        node = Node(tag, attrs, self.stack[-1])
        self.stack[-1].children.append(node)
        self.stack.append(node)

    def end(self, tag: str) -> None:
        tag = "svg-text" if tag == "text" and self.foreign() else tag
        if tag == "br":
            self.start("br", {}, False)
        elif tag == "p":
            if not self._end({"p"}, SCOPES):
                self.start("p", {}, False)
                self.stack.pop()
        elif tag in HEADINGS:
            self._end(HEADINGS, SCOPES)
        elif tag == "table":
            self._end({"table"}, {"html"})
        elif tag in CELLS or tag == "tr" or tag in GROUPS or tag == "caption":
            self._end({tag}, {"table"})
        elif tag not in ("html", "body"):
            self._end({tag}, SCOPES - {tag})


def parse(html: str) -> Builder:
    """The tree of a page."""
    tree, at, size = Builder(), 0, len(html)
    while at < size:
        begin = html.find("<", at)
        if begin < 0:
            tree.text(html[at:])
            break
        following = html[begin + 1 : begin + 2]
        if following == "!" or following == "?":
            tree.text(html[at:begin])
            if html.startswith("<!--", begin):
                ended = EMPTY_COMMENT.match(html, begin) or COMMENT_END.search(html, begin + 4)
                at = ended.end() if ended else size
            else:
                stop = html.find(">", begin)
                at = size if stop < 0 else stop + 1
        elif following == "/":
            tree.text(html[at:begin])
            if found := TAG.match(html, begin):
                tree.end(found[2].lower())
                at = found.end()
            elif html[begin + 2 : begin + 3].isascii() and html[begin + 2 : begin + 3].isalpha():
                break  # a tag that never ends
            elif begin + 2 == size:
                tree.text("</")
                break
            else:  # what isn't a name makes a comment
                stop = html.find(">", begin)
                at = size if stop < 0 else stop + 1
        elif following.isalpha() and following.isascii():
            tree.text(html[at:begin])
            found = TAG.match(html, begin)
            if not found:
                break
            tag, raw = found[2].lower(), found[3]
            at = found.end()
            closed = raw.endswith("/")
            tree.start(tag, attributes(raw) if raw.strip(" /\n") else {}, closed)
            if tag in RAW and not (closed and tree.foreign()):
                ended = RAW_END[tag].search(html, at) if tag != "plaintext" else None
                stop = ended.start() if ended else -1
                inner = html[at:] if stop < 0 else html[at:stop]
                if tag == "style":
                    tree.sheets.append(inner)
                elif tree.stack[-1].tag == tag:
                    tree.stack[-1].children.append(inner)
                if tree.stack[-1].tag == tag:
                    tree.stack.pop()
                close = TAG.match(html, stop) if ended else None
                at = close.end() if close else size
        else:
            tree.text(html[at : begin + 1])
            at = begin + 1
    return tree


def hidden_selectors(sheets: list[str]) -> frozenset[str]:
    """Simple selectors (an element, a class, an id) of rules that display nothing."""
    found = set()
    for sheet in sheets:
        for names in HIDING.findall(COMMENT.sub("", sheet)):
            found |= {x for x in (s.strip() for s in names.split(",")) if SIMPLE.match(x)}
    return frozenset(found)


def width(text: str) -> int:
    return len(text) if text.isascii() else sum(2 if unicodedata.east_asian_width(c) in "WF" else 0 if unicodedata.combining(c) else 1 for c in text)


class Page:
    """Lines being laid out, with the blank lines due before the next."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.due = 0

    def add(self, text: str) -> None:
        self.parts.append(text)

    def line(self, text: str) -> None:
        if self.lines:
            self.lines += [""] * self.due
        self.due = 0
        self.lines.append(text)

    def flush(self) -> None:
        if self.parts:
            text = BLANK.sub(" ", "".join(self.parts)).strip(" ")
            self.parts = []
            if text:
                self.line(text)

    def block(self, margin: int) -> None:
        self.flush()
        self.due = max(self.due, margin)

    def include(self, lines: list[str], margin: int) -> None:
        """Lines laid out elsewhere."""
        self.block(margin)
        for text in lines:
            self.line(text)
        self.due = max(self.due, margin)


class Renderer:
    def __init__(self, hiding: frozenset[str]):
        self.hiding = hiding

    def shown(self, node: Node) -> bool:
        attrs = node.attrs
        if node.tag in UNSEEN or "hidden" in attrs:
            return False
        if node.tag == "dialog" and "open" not in attrs or node.tag == "input":
            return False
        if attrs and DISPLAY_NONE.search(attrs.get("style", "")):
            return False
        if self.hiding:
            if node.tag in self.hiding or f"#{attrs.get('id')}" in self.hiding:
                return False
            return not any(f".{x}" in self.hiding for x in attrs.get("class", "").split())
        return True

    def lines(self, node: Node, visible: bool, pre: bool = False) -> list[str]:
        page = Page()
        self.children(node, page, visible, pre)
        page.flush()
        return page.lines

    def children(self, node: Node, page: Page, visible: bool, pre: bool) -> None:
        for child in node.children:
            if not isinstance(child, str):
                self.element(child, page, visible, pre)
            elif visible:
                text = unescape(child) if "&" in child and node.tag not in ("xmp", "plaintext") else child
                page.add(text)

    def element(self, node: Node, page: Page, visible: bool, pre: bool) -> None:
        if not self.shown(node):
            return
        tag = node.tag
        if node.attrs and (found := VISIBILITY.search(node.attrs.get("style", ""))):
            visible = found[1].lower() == "visible" or visible and found[1].lower() not in ("hidden", "collapse")
        if tag == "br":
            if pre:
                page.add("\n")
            elif page.parts:
                page.flush()
            return
        if tag == "wbr" or tag == "img":
            return
        if tag == "table":
            page.include(self.table(node, visible), 1)
        elif tag in ("ul", "ol", "menu", "dir"):
            page.include(self.list(node, visible), 1 if node.parent is None or node.parent.tag != "li" else 0)
        elif tag == "dd":
            page.include(["    " + x if x else x for x in self.lines(node, visible)], 0)
        elif tag == "blockquote":
            page.include(["  " + x if x else x for x in self.lines(node, visible)], 1)
        elif tag in PREFORMATTED:
            page.include(self.preformatted(node, visible), 1 if tag != "textarea" else 0)
        elif tag == "hr":
            page.block(1)
        elif tag == "details" and "open" not in node.attrs:
            page.block(0)
            for child in node.children:
                if not isinstance(child, str) and child.tag == "summary":
                    self.element(child, page, visible, pre)
            page.block(0)
        elif tag in BLOCKS:
            margin = 1 if tag in SPACED else 0
            page.block(margin)
            self.children(node, page, visible, pre)
            page.block(margin)
        elif tag == "q":
            if visible:
                page.add('"')
            self.children(node, page, visible, pre)
            if visible:
                page.add('"')
        else:
            if tag in CELLS:
                page.add(" ")
            self.children(node, page, visible, pre)

    def preformatted(self, node: Node, visible: bool) -> list[str]:
        page = Page()
        self.children(node, page, visible, True)
        page.lines += "".join(page.parts).replace("\r\n", "\n").replace("\r", "\n").split("\n")
        lines = [x.rstrip() for x in page.lines]
        while lines and not lines[0]:
            lines.pop(0)
        while lines and not lines[-1]:
            lines.pop()
        return lines

    def list(self, node: Node, visible: bool) -> list[str]:
        out: list[str] = []
        loose = Page()
        start = node.attrs.get("start", "")
        number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
        for child in node.children:
            if isinstance(child, str) or child.tag != "li":
                if isinstance(child, str):
                    if visible:
                        loose.add(unescape(child))
                else:
                    self.element(child, loose, visible, False)
                continue
            loose.flush()
            out += ["  " + x if x else x for x in loose.lines]
            loose = Page()
            if not self.shown(child):
                continue
            value = child.attrs.get("value", "")
            if re.fullmatch(r"-?\d{1,9}", value):
                number = int(value)
            marker = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            lines = self.lines(child, visible)
            if lines:
                out.append(marker + lines[0])
                out += [" " * len(marker) + x if x else x for x in lines[1:]]
        loose.flush()
        return out + ["  " + x if x else x for x in loose.lines]

    def table(self, node: Node, visible: bool) -> list[str]:
        captions: list[str] = []
        rows: list[Node] = []

        def collect(parent: Node) -> None:
            for child in parent.children:
                if isinstance(child, str) or not self.shown(child):
                    continue
                if child.tag == "caption":
                    captions.extend(self.lines(child, visible))
                elif child.tag == "tr":
                    rows.append(child)
                elif child.tag in GROUPS:
                    collect(child)
                elif child.tag not in ("colgroup", "col"):
                    captions.extend(self.lines(child, visible))

        collect(node)
        taken: dict[int, int] = {}  # column to rows that a cell above still takes
        grid: list[dict[int, list[str]]] = []
        widths: dict[int, int] = {}
        for row in rows:
            cells: dict[int, list[str]] = {}
            column, now = 0, dict(taken)
            taken = {k: v - 1 for k, v in taken.items() if v > 1}
            for cell in row.children:
                if isinstance(cell, str):
                    continue
                if cell.tag not in CELLS:
                    captions.extend(self.lines(cell, visible) if self.shown(cell) else [])
                    continue
                if not self.shown(cell):
                    continue
                while now.get(column, 0) > 0:
                    column += 1
                across, down = (min(MOST_SPANNED, max(1, int(x))) if re.fullmatch(r"\d{1,9}", x := cell.attrs.get(name, "")) else 1 for name in ("colspan", "rowspan"))
                lines = self.lines(cell, visible)
                cells[column] = lines
                if across == 1:
                    widths[column] = max(widths.get(column, 0), min(WIDEST, max(map(width, lines), default=0)))
                if down > 1:
                    for k in range(column, column + across):
                        taken[k] = max(taken.get(k, 0), down - 1)
                column += across
            grid.append(cells)
        out = captions
        used = sorted({k for cells in grid for k in cells})
        for cells in grid:
            for k in range(max(map(len, cells.values()), default=0)):
                text, pad = "", 0
                for column in used:
                    part = cells.get(column, [])
                    if k < len(part) and part[k]:
                        text += " " * max(0, pad - width(text)) + part[k]
                    if widths.get(column):
                        pad = max(pad, 0) + widths[column] + 2
                        if k < len(part) and part[k] and width(text) + 2 > pad:
                            text += "  "
                out.append(text.rstrip())
        return [x for x in out if x]


def extract(html: str) -> str:
    """The visible text of a page."""
    tree = parse(html)
    renderer = Renderer(hidden_selectors(tree.sheets))
    lines = renderer.lines(tree.root, True) if renderer.shown(tree.root) else []
    return "\n".join(lines)


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text)."""
    kind = pages.schema[id_col].dataType.simpleString()

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else extract(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return pages.select(F.col(id_col).alias("id"), html_col).mapInArrow(extracted, f"id {kind}, text string").withColumnRenamed("id", id_col)
