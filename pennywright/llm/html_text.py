"""Visible text of HTML pages with their layout.

A tree builder turns tags into a tree: tags that HTML implies are added (a new paragraph, list
item, row, cell or option ends the open one; blocks end paragraphs; void elements have no
content; what is still open at the end is closed).  Elements that a browser does not show are
skipped: head, scripts, styles, templates, `hidden`, `display:none`, `visibility:hidden`, and
definitions and descriptions inside svg and math.  HTML tags end svg and math, save in a
foreignObject.  `<![...>` is a comment, or text where it is CDATA inside svg and math.
Rendering keeps all visible text: blocks stand on lines of their own, paragraphs, headings and
lists are set off by a blank line, list items carry a dash or their number and are indented by
depth, cells of a table are aligned in columns, preformatted text keeps its white space.

Scale: a page is rendered by itself in one pass over the table, without a shuffle; building
and rendering use explicit stacks, so that depth is no limit.

Defined results: a null or empty page has an empty text; broken markup never fails; repeated
rows are rendered each; an empty table gives no rows; other columns are left out.
"""

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("head title script style template noscript iframe object canvas audio video "
             "datalist".split())
FOREIGN = {"svg", "math"}
#: Elements of svg and math that are not shown, and those on lines of their own.
FOREIGN_HIDDEN = set("defs desc metadata symbol clippath mask pattern marker annotation "
                     "annotation-xml".split())
FOREIGN_LINES = {"text", "foreignobject"}
#: Start tags that end svg and math.
BREAKOUT = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 "
               "head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike "
               "sub sup table tt u ul var".split())
#: Elements inside which HTML goes on.
HTML_AGAIN = set("foreignobject desc annotation-xml mi mo mn ms mtext".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt "
            "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
            "legend li main menu nav ol optgroup option p pre section summary table tbody "
            "td tfoot th thead tr ul caption".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr".split())
LISTS = {"ul", "ol", "menu", "dir"}
#: A start tag -> (open elements that it ends, elements that it does not look beyond).
IMPLIED = {
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
SCOPE = {"td", "th", "table", "html", "body", "button", "caption", "select", "foreignobject"}
_SPACE = re.compile(r"[ \t\n\r\f]+")
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []

    def shown(self) -> bool:
        if self.tag in HIDDEN or "hidden" in self.attrs:
            return False
        return not _NOT_SHOWN.search(self.attrs.get("style") or "")


class TreeBuilder(HTMLParser):
    """Builds the tree of one page under a root node."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]
        self.foreign = 0  # open elements svg and math

    def _end_to(self, depth: int) -> None:
        self.foreign -= sum(node.tag in FOREIGN for node in self.open[depth:])
        del self.open[depth:]

    def _in_foreign(self) -> bool:
        """Whether the innermost of svg, math and what leads back to HTML is svg or math."""
        if self.foreign:
            for node in reversed(self.open):
                if node.tag in FOREIGN or node.tag in HTML_AGAIN:
                    return node.tag in FOREIGN
        return False

    def parse_html_declaration(self, i):
        if not self.rawdata.startswith("<![", i):
            return super().parse_html_declaration(i)
        if self.rawdata.startswith("<![CDATA[", i) and self.foreign and (
                self._in_foreign() or self.open[-1].tag in HTML_AGAIN):
            end = self.rawdata.find("]]>", i + 9)
            self.handle_data(self.rawdata[i + 9: end if end >= 0 else None])
            return end + 3 if end >= 0 else len(self.rawdata)
        return self.parse_bogus_comment(i)

    def _end_nearest(self, tags, barrier) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.open[depth].tag
            if tag in tags:
                self._end_to(depth)
                return
            if tag in barrier:
                return

    def handle_starttag(self, tag, attrs):
        while tag in BREAKOUT and self._in_foreign():
            self._end_nearest(FOREIGN, ())
        if tag in IMPLIED:
            ends, barrier = IMPLIED[tag]
            before = -1
            while before != len(self.open):  # a row ends its cell, then the row
                before = len(self.open)
                self._end_nearest(ends, barrier)
        if tag in BLOCK and tag not in ("li", "dd", "dt", "html", "body"):
            self._end_nearest({"p"}, SCOPE | LISTS | {"li", "div"})
        if tag not in BLOCK and tag not in HIDDEN and self.open[-1].tag == "head" \
                and tag not in VOID:
            self._end_nearest({"head"}, set())
        node = Node(tag, {k: v or "" for k, v in attrs})
        if self.foreign and self._in_foreign():
            if tag in FOREIGN_HIDDEN:
                node.attrs["hidden"] = ""
            elif tag in FOREIGN_LINES:
                node.attrs["#line"] = ""
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.foreign += tag in FOREIGN

    def handle_startendtag(self, tag, attrs):
        closed = tag in FOREIGN or (tag not in BREAKOUT and self._in_foreign())
        self.handle_starttag(tag, attrs)
        if closed and self.open[-1].tag == tag:  # elsewhere the slash means nothing
            self._end_to(len(self.open) - 1)

    def handle_endtag(self, tag):
        if tag == "br":  # a stray end tag of a line break is one
            self.open[-1].children.append(Node("br", {}))
            return
        barrier = {"table"} if tag not in ("table", "body", "html") else set()
        if tag not in BLOCK:
            barrier = barrier | {"td", "th"}
        self._end_nearest({tag}, barrier)

    def handle_data(self, data):
        children = self.open[-1].children
        if self.open[-1].tag == "head" and data.strip():  # text ends the head
            self._end_nearest({"head"}, set())
            children = self.open[-1].children
        if children and isinstance(children[-1], list):
            children[-1].append(data)
        else:
            children.append([data])


def tree_of(page: str) -> Node:
    builder = TreeBuilder()
    builder.feed(page)
    builder.close()
    return builder.root


class Flow:
    """Lines being written: inline text gathers in a line until a block ends it."""

    def __init__(self):
        self.lines: list[str] = []
        self.text = ""
        self.blank = False  # a blank line is due before the next text
        self.prefix: list[str] = []  # indentation, one entry per list level
        self.mark = ""  # bullet or number of the item that begins

    def add(self, data: str) -> None:
        data = _SPACE.sub(" ", data)
        if not self.text or self.text.endswith(" "):
            data = data.lstrip(" ")
        self.text += data

    def line(self, raw: str | None = None) -> None:
        """End the line; `raw` is written as it is."""
        text = self.text.rstrip(" ") if raw is None else raw
        self.text = ""
        if raw is None and not text:
            return
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        indent = "".join(self.prefix)
        if self.mark:
            indent = indent[: len(indent) - len(self.mark)] + self.mark
            self.mark = ""
        self.lines.append((indent + text) if text else "")

    def space(self) -> None:
        self.line()
        self.blank = True


def render(root: Node) -> str:
    """The text of a tree.  Tables are rendered innermost first, each on its own flow."""
    flow = Flow()
    # entries: ("in", node, flow), ("out", node, flow) and ("rows", rows, flow)
    stack = [("in", root, flow)]
    while stack:
        step, node, flow = stack.pop()
        if step == "rows":
            _write_table(node, flow)
            continue
        tag = node.tag
        if step == "out":
            _leave(node, flow)
            continue
        if not node.shown():
            continue
        if tag == "br":
            if flow.text.strip():
                flow.line()
            elif flow.lines and flow.lines[-1] != "":
                flow.blank = True
            continue
        if tag == "table":
            flow.space()
            rows = _rows(node)
            stack.append(("rows", rows, flow))
            for row in rows:
                for cell in row:
                    inner = Flow()
                    cell.append(inner)
                    stack.append(("in", Node("#cell", {}), inner))
                    stack[-1][1].children = cell[0].children
            continue
        _enter(node, flow)
        if tag == "img":
            if node.attrs.get("alt"):
                flow.add(node.attrs["alt"])
            continue
        stack.append(("out", node, flow))
        numbered = 0
        below = []
        for child in node.children:
            if isinstance(child, list):
                below.append(child)
                continue
            if child.tag == "li":
                numbered += 1
                child.attrs["#place"] = numbered
                child.attrs["#in"] = tag
            below.append(child)
        if all(isinstance(c, list) for c in below):
            for child in below:
                _text("".join(child), node, flow)
            continue
        for child in reversed(below):
            if isinstance(child, list):
                piece = Node("#pre" if tag in ("pre", "#pre", "textarea") else "#text", {})
                piece.children = [child]
                stack.append(("in", piece, flow))
            else:
                stack.append(("in", child, flow))
    return "\n".join(flow.lines).strip("\n")


def _text(data: str, node: Node, flow: Flow) -> None:
    if node.tag in ("pre", "#pre", "textarea"):
        first, *rest = data.replace("\r\n", "\n").split("\n")
        flow.text += first
        for part in rest:
            flow.line(flow.text)
            flow.text = part
    else:
        flow.add(data)


def _enter(node: Node, flow: Flow) -> None:
    tag = node.tag
    if tag in SPACED and not (tag in LISTS and flow.prefix):
        flow.space()
    elif tag in BLOCK or "#line" in node.attrs:
        flow.line()
    if tag == "li":
        ordered = node.attrs.get("#in") == "ol"
        flow.mark = f"{node.attrs['#place']}. " if ordered else "- "
        flow.prefix.append(" " * len(flow.mark))
    elif tag in ("dd", "blockquote"):
        flow.prefix.append("  ")
    elif tag == "hr":
        flow.line("-" * 3)


def _leave(node: Node, flow: Flow) -> None:
    tag = node.tag
    if tag in ("pre", "textarea") and flow.text:
        flow.line(flow.text)
    if tag in SPACED and not (tag in LISTS and flow.prefix):
        flow.space()
    elif tag in BLOCK or tag in ("#cell", "#root") or "#line" in node.attrs:
        flow.line()
    if tag in ("li", "dd", "blockquote") and flow.prefix:
        flow.prefix.pop()
        if tag == "li":
            flow.mark = ""


def _rows(table: Node) -> list[list[list]]:
    """Rows of cells ([node]) of a table, captions and stray content as rows of one cell."""
    rows, todo = [], [(c, None) for c in reversed(table.children)]
    while todo:
        node, row = todo.pop()
        if isinstance(node, list):
            if "".join(node).strip():
                cell = Node("td", {})
                cell.children = [node]
                rows.append([[cell]])
            continue
        if not node.shown():
            continue
        if node.tag in ("thead", "tbody", "tfoot", "colgroup"):
            todo += [(c, None) for c in reversed(node.children)]
        elif node.tag == "tr":
            cells = [c for c in node.children if isinstance(c, Node) and c.shown()
                     and c.tag in ("td", "th")]
            others = [c for c in node.children if c not in cells and (
                isinstance(c, Node) or "".join(c).strip())]
            if others:
                extra = Node("td", {})
                extra.children = others
                cells.append(extra)
            rows.append([[c] for c in cells])
        else:
            cell = Node("td", {})
            cell.children = [node]
            rows.append([[cell]])
    return rows


def _write_table(rows, flow: Flow) -> None:
    texts = [[[x for x in cell[1].lines] or [""] for cell in row] for row in rows]
    widths: list[int] = []
    for row in texts:
        if len(row) < 2:  # captions and one-cell rows set no width
            continue
        for i, lines in enumerate(row):
            if i == len(widths):
                widths.append(0)
            widths[i] = max(widths[i], *map(len, lines))
    for row in texts:
        if not any(any(lines) for lines in row):
            continue
        for k in range(max(len(lines) for lines in row)):
            parts = []
            for i, lines in enumerate(row):
                part = lines[k] if k < len(lines) else ""
                parts.append(part.ljust(widths[i]) if i < len(row) - 1 else part)
            flow.line("  ".join(parts).rstrip(" "))
    flow.blank = True


def text_of(page: str | None) -> str:
    return render(tree_of(page)) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id and text of every row of `pages`."""
    kind = dict(pages.dtypes)["page_id"]

    def run(batches):
        for batch in batches:
            texts = [text_of(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), pa.array(texts, pa.string())], ["page_id", "text"])

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, text string")
