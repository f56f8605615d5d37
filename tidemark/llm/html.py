"""Layout-aware text of HTML pages.

A tokeniser and a small tree builder (implied and missing tags, void elements, raw text) make a tree; rules
of visibility (elements that are never shown, hidden attributes, and the cascade of style sheets and inline
styles, see visibility.py) prune it; a renderer walks it without recursion and writes all visible text: blocks
on lines of their own, blank lines around paragraphs, list markers and indents, preformatted text, and table
cells in aligned columns. Cells of tables with several columns are wrapped at CELL characters, so that no cell
makes all rows wide; a word of more is cut there. Nesting is laid out to the depth of MAX_DEPTH, at which
browsers stop nesting too; text beyond it is written without further indents or columns.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch
from .visibility import Cascade, media_matches

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_SPACES = re.compile(r"[ \t\n\r\f]+")

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER_SHOWN = frozenset("head title meta link base script style template noscript noframes datalist audio video canvas iframe object embed param source track area map rp svg math colgroup col".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table caption tbody td tfoot th thead tr ul xmp listing plaintext search textarea".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr fieldset menu dir article xmp listing".split())
PREFORMATTED = frozenset("pre textarea xmp listing plaintext".split())
CLOSE_P = BLOCKS - frozenset("body caption html legend option optgroup select td th tr tbody thead tfoot textarea".split()) | {"hr"}

#: A start tag closes open elements of these names, up to the nearest element of the stop set.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "rp": ({"rp", "rt"}, {"ruby"}),
    "rt": ({"rp", "rt"}, {"ruby"}),
}
P_SCOPE = frozenset("table td th caption button object marquee applet html body".split())

#: Characters of a line of a cell in a table of several columns; depth of lists and tables that is laid out.
CELL = 120
MAX_DEPTH = 512
INLINE = frozenset("inline inline-block inline-flex inline-grid inline-table contents".split())
OF_TABLES = frozenset("table caption tr td th thead tbody tfoot li".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "elder")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []
        self.parent: Node | None = None
        self.elder: Node | None = None  # the sibling element before


def parse(html: str) -> Node:
    """The tree of a page; a string among the children is text, with its entities resolved."""
    root = Node("html")
    open_: list[Node] = [root]
    counts = {"html": 1}  # of open elements, so that looking for one that is not open costs nothing
    at, n = 0, len(html)

    def pop_to(k: int) -> None:
        while len(open_) > k:
            counts[open_.pop().tag] -= 1

    def close(names: set[str] | frozenset[str], stops: set[str] | frozenset[str]) -> None:
        """Close the outermost open element of names above the nearest stop."""
        if not any(counts.get(x) for x in names):
            return
        found = 0
        for k in range(len(open_) - 1, 0, -1):
            if open_[k].tag in names:
                found = k
            elif open_[k].tag in stops:
                break
        if found:
            pop_to(found)

    def push(node: Node) -> None:
        if len(open_) > MAX_DEPTH:  # deeper elements become siblings
            pop_to(MAX_DEPTH)
        open_[-1].children.append(node)
        open_.append(node)
        counts[node.tag] = counts.get(node.tag, 0) + 1

    while at < n:
        lt = html.find("<", at)
        m = _TOKEN.match(html, lt) if lt >= 0 else None
        if lt < 0 or m is None:  # a lone "<" is text
            stop = n if lt < 0 else lt + 1
            open_[-1].children.append(unescape(html[at:stop]))
            at = stop
            continue
        if lt > at:
            open_[-1].children.append(unescape(html[at:lt]))
        at = m.end()
        if end := m["end"]:
            end = end.lower()
            if end == "br":
                open_[-1].children.append(Node("br"))
            elif end == "p" and not counts.get("p"):
                open_[-1].children.append(Node("p"))
            elif counts.get(end) and end not in ("html", "body"):
                stops = {"table"} if end in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else set() if end == "table" else {"table", "td", "th", "caption"}
                close_one(open_, end, stops, pop_to)
            continue
        if not (tag := m["tag"]):
            continue
        tag = tag.lower()
        attrs = {a[0].lower(): unescape(a[1] or a[2] or a[3]) for a in reversed(_ATTR.findall(m["attrs"]))} if m["attrs"] else {}
        if tag in ("html", "body"):
            root.attrs.update(attrs)
            if tag == "body":
                close({"head"}, frozenset())
            continue
        if tag in IMPLIED_END:
            close(*IMPLIED_END[tag])
        if tag in CLOSE_P and counts.get("p"):
            close({"p"}, P_SCOPE)
        if tag not in NEVER_SHOWN and counts.get("head"):
            close({"head"}, frozenset())
        if tag in ("td", "th") and counts.get("table") and open_[-1].tag != "tr":
            push(Node("tr"))
        if tag in RAW and tag not in VOID:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            node = Node(tag, attrs)
            body = html[at : stop.start() if stop else n]
            node.children.append(unescape(body) if tag in ("textarea", "title") else body)
            open_[-1].children.append(node)
            at = stop.end() if stop else n
        elif tag in VOID:
            open_[-1].children.append(Node(tag, attrs))
        elif m["attrs"].endswith("/") and (counts.get("svg") or counts.get("math") or tag in ("svg", "math")):
            open_[-1].children.append(Node(tag, attrs))
        else:
            push(Node(tag, attrs))
    return root


def close_one(open_: list[Node], name: str, stops: set[str], pop_to) -> None:
    """Close the innermost open element of a name, unless a stop is nearer."""
    for k in range(len(open_) - 1, 0, -1):
        if open_[k].tag == name:
            pop_to(k)
            return
        if open_[k].tag in stops:
            return


def related(root: Node) -> list[str]:
    """Sets parent and elder of all nodes; returns the style sheets, in order."""
    sheets: list[str] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag == "style" and media_matches(node.attrs.get("media", "")):
            sheets.append("".join(x for x in node.children if isinstance(x, str)))
        elder = None
        own = [x for x in node.children if not isinstance(x, str)]
        for child in own:
            child.parent, child.elder = node, elder
            elder = child
        stack.extend(reversed(own))
    return sheets


def gone(node: Node, style: dict[str, str]) -> bool:
    """Whether an element makes no box: what the standard hides unless a style says else, and what a style hides."""
    if node.tag in NEVER_SHOWN or node.tag == "input" and node.attrs.get("type", "").lower() == "hidden":
        return True
    hidden = "hidden" in node.attrs or node.tag == "dialog" and "open" not in node.attrs
    return style.get("display", "none" if hidden else "") == "none"


class Lines:
    """Text under construction: lines, with white space collapsed and margins merged."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.fixed: set[int] = set()  # lines of an inner table, which must not be wrapped
        self.part: list[str] = []
        self.space = self.blank = False
        self.indents: list[str] = []
        self.marker = ""

    def text(self, s: str) -> None:
        words = _SPACES.split(s)
        if len(words) == 1 and not words[0]:
            return
        if not words[0]:
            self.space = True
        body = " ".join(w for w in words if w)
        if body:
            if self.part and self.space:
                self.part.append(" ")
            self.part.append(body)
            self.space = not words[-1]

    def raw(self, s: str) -> None:
        first, *rest = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.part.append(first)
        for line in rest:
            self.end_line(keep=True)
            self.part.append(line)
        self.space = False

    def end_line(self, keep: bool = False) -> None:
        line = "".join(self.part)
        self.part, self.space = [], False
        if line.strip(" \t\n\r\f") or keep or self.marker:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            indent = "".join(self.indents[:MAX_DEPTH])
            if self.marker:
                indent = indent[: len(indent) - len(self.marker)] + self.marker if len(self.indents) <= MAX_DEPTH else indent + self.marker
                self.marker = ""
            self.lines.append((indent + line).rstrip(" \t"))

    def margin(self) -> None:
        self.end_line() if self.part else None
        self.blank = True

    def done(self) -> list[str]:
        self.end_line() if self.part else None
        return self.lines


def wrapped(line: str, width: int) -> list[str]:
    """A line cut at spaces into lines of that width at most, indented like it; longer words are cut."""
    if len(line) <= width:
        return [line]
    indent = line[: len(line) - len(line.lstrip(" "))][: width // 2]
    out, now = [], indent
    for word in line.split(" "):
        if not word:
            continue
        while True:
            room = width - len(now) - (len(now) > len(indent))
            if len(word) <= room:
                now += (" " if len(now) > len(indent) else "") + word
                break
            if len(now) > len(indent):
                out.append(now)
                now = indent
            else:
                out.append(now + word[:room])
                word = word[room:]
    return [*out, now] if len(now) > len(indent) else out


class Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[Lines, int, int]]] = []

    def lines(self) -> list[str]:
        """Rows with cells in columns that start at the same place; a tall cell takes several lines."""
        placed: list[list[tuple[int, list[str], int]]] = []
        held: dict[int, int] = {}
        widths: dict[int, int] = {}
        several = any(len(row) > 1 or across > 1 for row in self.rows for _, across, _ in row) or any(down > 1 for row in self.rows for _, _, down in row)
        for row in self.rows:
            col, here = 0, []
            spans = {}
            for content, across, down in row:
                cell = [x for i, line in enumerate(content.lines) for x in (wrapped(line, CELL) if several and i not in content.fixed else [line])]
                while cell and not cell[-1]:
                    cell.pop()
                while held.get(col, 0) > 0:
                    col += 1
                here.append((col, cell, across))
                if across == 1:
                    widths[col] = max(widths.get(col, 0), max(map(len, cell), default=0))
                if down > 1:
                    spans |= {c: down for c in range(col, col + across)}
                col += across
            held = {c: k - 1 for c, k in held.items() if k > 1} | {c: k - 1 for c, k in spans.items()}
            placed.append(here)
        starts, x = {}, 0
        for c in range(max((c + a for row in placed for c, _, a in row), default=0)):
            starts[c] = x
            x += widths.get(c, 0) + 2 if c in widths else 0
        # a cell over several columns that is wider than they are makes the last of them wider
        for row in placed:
            for c, cell, across in row:
                need = max(map(len, cell), default=0) + 2
                if across > 1 and c + across in starts and (more := need - (starts[c + across] - starts[c])) > 0:
                    for k in range(c + across, len(starts)):
                        starts[k] += more
        out = []
        for row in placed:
            for k in range(max((len(cell) for _, cell, _ in row), default=0)):
                line = ""
                for c, cell, _ in row:
                    if k < len(cell) and cell[k]:
                        line = line.ljust(starts[c]) + cell[k]
                out.append(line.rstrip())
        return out


def _number(text: str | None, default: int, most: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", text or "")
    return min(int(m[1]), most) if m else default


def marker(kind: str, n: int) -> str:
    if kind in ("a", "A"):
        out, k = "", n
        while k > 0:
            k, r = divmod(k - 1, 26)
            out = chr(97 + r) + out
        out = out or str(n)
        return (out.upper() if kind == "A" else out) + ". "
    if kind in ("i", "I") and 0 < n < 4000:
        out = ""
        for value, sign in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split()):
            out += sign * (n // value)
            n %= value
        return (out.upper() if kind == "I" else out) + ". "
    return f"{n}. "


def render(html: str | None) -> str:
    """All visible text of a page. Null and empty pages give the empty text."""
    if not html:
        return ""
    root = parse(html.replace("\0", "\ufffd"))
    cascade = Cascade(related(root))
    out = [Lines()]
    tables: list[Table] = []
    lists: list[list] = []  # [kind, next number, step]
    # node, whether it is left, and what it takes from its parent: is it visible, is white space kept
    stack: list[tuple[Node | str, bool, bool, bool]] = [(root, False, True, False)]
    while stack:
        node, leaving, shown, pre = stack.pop()
        w = out[-1]
        if isinstance(node, str):
            if shown:
                w.raw(node) if pre else w.text(node)
            continue
        tag = node.tag
        style = cascade.style(node)
        is_list = tag in ("ul", "ol", "menu", "dir")
        in_table = bool(tables) and len(tables) <= MAX_DEPTH
        if "visibility" in style and style["visibility"] != "inherit":
            shown = style["visibility"] not in ("hidden", "collapse")
        space = style.get("white-space", "pre" if tag in PREFORMATTED else "")
        is_pre = space.startswith(("pre", "break-spaces")) and space != "pre-line" if space and space != "inherit" else pre
        display = style.get("display", "")
        block = tag in BLOCKS if not display or tag in OF_TABLES or display in ("inherit", "unset", "revert") else display not in INLINE
        if not leaving:
            if gone(node, style):
                continue
            if tag == "br":
                w.end_line(keep=True)
                continue
            if tag == "wbr":
                continue
            if tag == "img":
                continue
            if tag == "input":
                if shown and node.attrs.get("type", "text").lower() in ("submit", "button", "reset", "text", "search", "email", "url", "tel", "number") and node.attrs.get("value"):
                    w.text(f" {node.attrs['value']} ")
                continue
            if block and tag in SPACED and not (is_list and lists):
                w.margin()
            elif block:
                w.end_line() if w.part else None
            if tag == "hr":
                continue
            children = [] if style.get("content-visibility") == "hidden" else node.children
            if tag == "details" and "open" not in node.attrs:
                children = [c for c in children if not isinstance(c, str) and c.tag == "summary"][:1]
            if is_list:
                items = sum(1 for c in children if not isinstance(c, str) and c.tag == "li")
                back = tag == "ol" and "reversed" in node.attrs
                kind = node.attrs.get("type", "1") if tag == "ol" else ""
                lists.append([kind, _number(node.attrs.get("start"), items if back else 1, 10**9), -1 if back else 1])
            elif tag == "li":
                if lists and lists[-1][0]:
                    lists[-1][1] = _number(node.attrs.get("value"), lists[-1][1], 10**9)
                    mark = marker(lists[-1][0], lists[-1][1])
                    lists[-1][1] += lists[-1][2]
                else:
                    mark = "- "
                w.indents.append(" " * len(mark))
                w.marker = mark if shown else ""
            elif tag in ("blockquote", "dd"):
                w.indents.append("  ")
            elif tag == "table":
                tables.append(Table())
            elif tag == "tr" and in_table:
                tables[-1].rows.append([])
            elif tag in ("td", "th") and in_table:
                out.append(Lines())
            elif tag in ("td", "th") or tag == "button":
                w.text("  ")
            elif tag == "q" and shown:
                w.text('"')
            if tag in PREFORMATTED and is_pre and children and isinstance(children[0], str) and children[0].startswith("\n"):
                children = [children[0][1:], *children[1:]]
            stack.append((node, True, shown, pre))
            stack.extend((c, False, shown, is_pre) for c in reversed(children))
            continue
        if tag == "q" and shown:
            w.text('"')
        if tag in ("td", "th") and in_table:
            cell = out.pop()
            cell.done()
            if not tables[-1].rows:
                tables[-1].rows.append([])
            tables[-1].rows[-1].append((cell, max(1, _number(node.attrs.get("colspan"), 1, 1000)), max(1, _number(node.attrs.get("rowspan"), 1, 65534))))
            continue
        if block and (w.part or w.marker):
            w.end_line()
        if is_list:
            lists.pop()
        elif tag in ("li", "blockquote", "dd"):
            w.indents.pop()
        elif tag == "table":
            done = tables.pop()
            for line in done.lines():
                w.part.append(line)
                w.end_line(keep=True)
                w.fixed.add(len(w.lines) - 1)
        elif tag in ("td", "th", "button"):
            w.text("  ")
        if block and tag in SPACED and not (is_list and lists):
            w.blank = True
    lines = out[0].done()
    while lines and not lines[-1].strip():
        lines.pop()
    while lines and not lines[0].strip():
        lines.pop(0)
    return "\n".join(lines)


def page_text(pages: DataFrame, html: str = "html", page_id: str = "page_id") -> DataFrame:
    """(page_id, text): the visible text of every whole page, one row per row of pages.

    Null and empty pages have the empty text. Rows that repeat a page_id keep a row each; other columns are
    not read; an empty table gives no rows.
    """

    def each(batch: pa.RecordBatch) -> dict:
        return {"page_id": batch.column("page_id"), "text": [render(x) for x in batch.column("html").to_pylist()]}

    narrow = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(html).cast("string").alias("html"))
    return by_batch(narrow, "page_id long, text string", each)
