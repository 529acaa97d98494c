"""HTML extraction with layout (operator 1).

A tree builder supplies implied tags (html, head, body, table rows, end tags of p, li, td
and the like), visibility rules take out what a browser would not show, and a renderer
emits all visible text: blocks on lines of their own, paragraphs apart by a blank line,
list items with markers and indents, table cells aligned in columns (cells that span rows or
columns keep their place in the grid), white space of pre and textarea kept and elsewhere
collapsed, the shown option of a select and the values of text and button fields.

Time and output grow in proportion to the page. So layout has bounds, text has none: lists are
indented for the first ``INDENTS`` levels; a cell sets the width of its column if its lines have
at most ``CELL`` characters; columns that would begin beyond ``ROW`` characters, or after the
``COLUMNS``th, follow after two blanks; tables within ``NESTED`` others are not aligned.

Defined cases: null gives null, an empty page an empty text; text without any tag is a
page; unclosed or crossed tags, stray end tags and cut-off input are mended as described at
``Builder``; an attribute without its closing quote ends at white space or >; nesting of any
depth is read without recursion; repeated rows are rendered one by one; an empty table gives an
empty result; other columns of any name stay, but one with the name of the new column is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaflux.llm import frames
from viaflux.storage import bound_batches

INDENTS, CELL, ROW, COLUMNS, NESTED = 16, 48, 120, 64, 3
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEAD_ONLY = frozenset("title meta link base style script noscript template".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search section summary table tbody td tfoot th thead tr ul caption".split())
#: Blocks with a blank line before and after.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset menu dir".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
UNSEEN = frozenset("head script style template noscript title meta link base iframe object video audio canvas datalist noembed noframes param source track area map rp desc defs metadata annotation".split())
#: Fields that show their value.
FIELDS = frozenset("text search email url tel number date time month week datetime-local submit reset button".split())
LISTS = frozenset("ul ol menu dir".split())
#: start tag: (open elements that it ends, elements at which the search stops)
ENDS = {
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    **{t: ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}) for t in ("tbody", "thead", "tfoot")},
}
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_GAP = re.compile(r"[\s/]*")
_KEY = re.compile(r"=?[^\s=/>]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_BRACE = re.compile(r"[{}]")
_SIMPLE = re.compile(r"[.#]?[\w-]+")
_WIDE = re.compile(r"(?:(?:only )?screen and )?\(min-width:\s*(\d+)px\)")
_CLOSE = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}
SECTIONS = ("table", "tbody", "thead", "tfoot", "tr")
CELLS = ("td", "th", "tr", "tbody", "thead", "tfoot")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


class Builder:
    """Builds the tree.

    A start tag ends open elements as in ``ENDS``; a block ends an open p; rows and cells get
    missing tr and table sections are transparent; an end tag closes the nearest open element of that
    name within the same table cell and all inside it, else it is skipped; text and
    other elements directly in a table go before it; at the end all is closed.
    """

    def __init__(self):
        self.root = Node("html")
        self.head, self.body = Node("head"), Node("body")
        self.root.children = [self.head, self.body]
        self.stack = [self.body]
        self.open: dict[str, list[int]] = {"body": [0]}  # by tag: where it stands on the stack
        self.in_head = True
        self.css: list[str] = []

    def parse(self, html: str) -> Node:
        at, n, gt = 0, len(html), -1
        last = {q: html.rfind(q) for q in "\"'"}
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                self.text(html[at:])
                break
            if lt > at:
                self.text(html[at:lt])
            if html[lt + 1 : lt + 2] in ("!", "?"):
                comment = html.startswith("<!--", lt)
                end = html.find("-->" if comment else ">", lt + 4 if comment else lt)
                at = n if end < 0 else end + (3 if comment else 1)
                continue
            if gt < lt:
                gt = html.find(">", lt)
                if gt < 0:  # no tag ends any more
                    self.text(html[lt:])
                    break
            m = _NAME.match(html, lt)
            if not m:
                self.text("<")
                at = lt + 1
                continue
            name = m[2].lower()
            attrs, at = self.attributes(html, m.end(), last)
            if m[1]:
                self.end(name)
                continue
            self.start(name, attrs, html[at - 2] == "/")
            if name in RAW:
                close = _CLOSE[name].search(html, at)
                raw = html[at : close.start()] if close else html[at:]
                at = close.end() if close else n
                if name == "style":
                    self.css.append(raw)
                elif name in ("textarea", "xmp"):
                    self.raw.children.append(unescape(raw) if name == "textarea" else raw)
        return self.root

    @staticmethod
    def attributes(html: str, at: int, last: dict[str, int]) -> tuple[dict[str, str], int]:
        """The attributes of the tag that is read up to ``at``, and where it ends."""
        out: dict[str, str] = {}
        n = len(html)
        while True:
            at = _GAP.match(html, at).end()
            if at >= n or html[at] == ">":
                return out, min(at + 1, n)
            key = _KEY.match(html, at)
            at, value = max(key.end(), at + 1), ""
            if equals := _EQUALS.match(html, at):
                at = equals.end()
                quote = html[at : at + 1]
                if quote and quote in "\"'" and last[quote] > at:
                    end = html.find(quote, at + 1)
                    value, at = html[at + 1 : end], end + 1
                else:
                    bare = _BARE.match(html, at)
                    value, at = bare[0], bare.end()
            out.setdefault(key[0].lower(), unescape(value) if "&" in value else value)

    def text(self, s: str) -> None:
        if "&" in s:
            s = unescape(s)
        if not s.strip(" \t\n\r\f"):
            if self.stack[-1].tag not in SECTIONS:
                self.stack[-1].children.append(s)
            return
        self.in_head = False
        self.place(s)

    def place(self, child) -> None:
        top = self.stack[-1]
        if top.tag in SECTIONS:  # misplaced: goes before the table
            k = self.open["table"][-1]
            parent, table = self.stack[k - 1], self.stack[k]
            parent.children.insert(len(parent.children) - 1 if parent.children[-1] is table else len(parent.children), child)
        else:
            top.children.append(child)

    def push(self, node: Node) -> None:
        self.open.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def close(self, names, stops) -> None:
        """Closes the nearest open element of ``names`` unless one of ``stops`` stands before it."""
        nearest = lambda tags: max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)
        at = nearest(names)
        if at > 0 and at >= nearest(stops):
            while len(self.stack) > at:
                self.open[self.stack.pop().tag].pop()

    def start(self, name: str, attrs: dict[str, str], empty: bool) -> None:
        if name in ("html", "head", "body"):
            {"html": self.root, "head": self.head, "body": self.body}[name].attrs.update(attrs)
            self.in_head = self.in_head and name != "body"
            return
        if self.in_head and name in HEAD_ONLY:
            self.head.children.append(Node(name))
            return
        self.in_head = False
        if name in CLOSES_P:
            self.close(("p",), ("table", "td", "th", "caption", "button"))
        if name in ENDS:
            if name in CELLS and not self.open.get("table"):
                return  # a cell outside of any table: its text stays in place
            self.close(*ENDS[name])
            if name in ("td", "th") and self.stack[-1].tag in SECTIONS[:-1]:
                row = Node("tr")
                self.stack[-1].children.append(row)
                self.push(row)
        node = Node(name, attrs)
        if name in CELLS or name in ("caption", "colgroup", "col"):
            self.stack[-1].children.append(node)
        else:
            self.place(node)
        if name in RAW:
            self.raw = node
        elif name not in VOID and not (empty and (name in ("svg", "math") or self.open.get("svg") or self.open.get("math"))):
            self.push(node)

    def end(self, name: str) -> None:
        if name == "br":
            self.place(Node("br"))
        elif name == "head":
            self.in_head = False
        elif name not in ("body", "html"):
            self.close((name,), () if name in ("table", *CELLS) else ("td", "th", "table", "caption"))


class Writer:
    """Text being laid out: white space is collapsed across inline elements, block margins are merged, lines are indented as they begin."""

    __slots__ = ("parts", "margin", "space", "fresh", "indents", "leads")

    def __init__(self):
        self.parts: list[str] = []
        self.margin, self.space, self.fresh = 0, False, True
        self.indents: list[str] = []  # of the open items, for all their lines but the first
        self.leads: list[str] = []  # of the last ones of them, which have no text yet

    def block(self, lines: int) -> None:
        if not self.leads and (not self.fresh or self.parts):  # an item's own margin holds before its first line
            self.margin = max(self.margin, lines)
        self.space = False
        self.fresh = True

    def enter(self, lead: str) -> int:
        """An item begins; gives what ``leave`` takes."""
        held = self.margin
        self.indents.append(" " * len(lead) if len(self.indents) < INDENTS else "")
        self.leads.append(lead)
        return held

    def leave(self, held: int) -> None:
        self.indents.pop()
        if self.leads:  # it had no text
            self.leads.pop()
            self.margin = held
        else:
            self.margin = 0

    def put(self, s: str) -> None:
        if (self.margin and self.parts) or not self.parts or self.leads:
            if self.margin and self.parts:
                self.parts.append("\n" * self.margin)
            kept = len(self.indents) - len(self.leads)
            self.parts.append("".join(self.indents[: min(kept, INDENTS)]) + "".join(self.leads))
            self.leads.clear()
        elif self.space and not self.fresh:
            self.parts.append(" ")
        self.margin = 0
        self.space = self.fresh = False
        self.parts.append(s)

    def inline(self, s: str) -> None:
        s = _SPACE.sub(" ", s)
        if s == " ":
            self.space = True
            return
        if not s:
            return
        self.space = self.space or s[0] == " "
        tail = s[-1] == " "
        self.put(s.strip(" "))
        self.space = tail

    def newline(self) -> None:
        self.margin = self.margin + 1 if self.fresh and self.margin else 1
        self.space, self.fresh = False, True

    def lines(self, s: str) -> None:
        """Lines as they are."""
        for i, line in enumerate(s.split("\n")):
            if i:
                self.newline()
            if line:
                self.space = False
                self.put(line)

    def value(self) -> str:
        return "".join(self.parts)


class Table:
    """Cells in a grid; those that span rows keep their columns in the rows below."""

    __slots__ = ("rows", "busy", "next")

    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []  # column (COLUMNS: no more), columns spanned, lines
        self.busy, self.next = [0] * COLUMNS, 0

    def row(self) -> None:
        self.rows.append([])
        self.next = 0

    def cell(self, text: str, across: int, down: int) -> None:
        r, c = len(self.rows) - 1, self.next
        while c < COLUMNS and self.busy[c] > r:
            c += 1
        self.next = min(c + across, COLUMNS)
        for x in range(c, self.next):
            self.busy[x] = r + down
        self.rows[-1].append((c, across, text.split("\n")))

    def render(self) -> str:
        """Cells of a column begin at the same place; a cell that spans columns or is long sets no width."""
        widths = [0] * COLUMNS
        for row in self.rows:
            for c, across, lines in row:
                if across == 1 and c < COLUMNS and (w := max(map(len, lines))) <= CELL:
                    widths[c] = max(widths[c], w)
        at = [0]
        for w in widths:
            at.append(at[-1] + (w + 2 if w else 0))
        out = []
        for row in self.rows:
            for k in range(max((len(lines) for _, _, lines in row), default=0)):
                line: list[str] = []
                n = 0
                for c, _, lines in row:
                    if k < len(lines) and lines[k]:
                        gap = max(at[c] - n if at[c] <= ROW else 0, 2 if n else 0)
                        line += (" " * gap, lines[k])
                        n += gap + len(lines[k])
                if line:
                    out.append("".join(line))
        return "\n".join(out)


def applies(prelude: str) -> bool:
    """Whether an at-rule holds for a wide screen."""
    name, _, query = prelude.strip().lower().partition(" ")
    if name in ("@supports", "@layer"):
        return True
    wide = lambda q: q in ("", "all", "screen", "only screen") or bool((m := _WIDE.fullmatch(q)) and len(m[1]) <= 4 and int(m[1]) <= 1280)
    return name == "@media" and any(wide(" ".join(q.split())) for q in query.split(","))


def hidden_by_css(css: list[str]) -> frozenset[str]:
    """Simple selectors (tag, .class, #id) whose last rule for a screen says display:none."""
    out: set[str] = set()
    for sheet in css:
        if "none" not in sheet:
            continue
        sheet, at, inside = re.sub(r"/\*.*?\*/", "", sheet, flags=re.S), 0, []
        for m in _BRACE.finditer(sheet):
            part, at = sheet[at : m.start()], m.end()
            if m[0] == "{":
                part = part.rpartition(";")[2].strip()
                inside.append((part, bool(not inside or inside[-1][1]) and (not part.startswith("@") or applies(part))))
            elif inside:
                rule, holds = inside.pop()
                if holds and not rule.startswith("@") and (d := re.findall(r"display\s*:\s*([\w-]+)", part, re.I)):
                    names = {x.strip() for x in rule.split(",") if _SIMPLE.fullmatch(x.strip())}
                    out = out | names if d[-1].lower() == "none" else out - names
    return frozenset(out)


def shown(node: Node, visible: bool, css: frozenset[str]) -> tuple[bool, bool]:
    """(rendered at all, its own text visible)."""
    a = node.attrs
    if node.tag in UNSEEN or node.tag in css:
        return False, False
    if a:
        if ("hidden" in a and a["hidden"].lower() != "until-found") or (node.tag == "input" and a.get("type", "").lower() == "hidden"):
            return False, False
        if css and (f"#{a.get('id', '')}" in css or any(f".{c}" in css for c in a.get("class", "").split())):
            return False, False
        if style := a.get("style", "").lower():
            style = style.replace(" ", "")
            if "display:none" in style:
                return False, False
            if "visibility:hidden" in style or "visibility:collapse" in style:
                visible = False
            elif "visibility:visible" in style:
                visible = True
    return True, visible


def options(select: Node) -> list:
    """The options that a select shows: all of a list, else the last selected one, else the first."""
    every = [o for c in select.children if not isinstance(c, str) for o in ([c] if c.tag == "option" else [x for x in c.children if not isinstance(x, str) and x.tag == "option"])]
    if "multiple" in select.attrs or select.attrs.get("size", "1").strip() not in ("", "0", "1"):
        return every
    return [o for o in every if "selected" in o.attrs][-1:] or every[:1]


def _span(node: Node, name: str, most: int) -> int:
    raw = node.attrs.get(name, "1").strip()
    return min(max(int(raw), 1), most) if re.fullmatch(r"[0-9]{1,9}", raw) else 1


def render(html: str) -> str:
    b = Builder()
    root = b.parse(html)
    css = hidden_by_css(b.css)
    outs, tables, counters = [Writer()], [], []
    pre, plain = 0, 0  # tables that are too deep to be aligned
    todo: list[tuple] = [(root, True, None)]
    while todo:
        node, visible, leaving = todo.pop()
        out = outs[-1]
        if isinstance(node, str):
            if visible:
                out.lines(node.replace("\r\n", "\n")) if pre else out.inline(node)
            continue
        tag = node.tag
        blocky = tag in BLOCK and tag not in CELLS and tag != "option"
        if leaving is None:
            seen, visible = shown(node, visible, css)
            if not seen:
                continue
            if tag == "br":
                out.newline()
                continue
            if tag == "input":
                if visible and node.attrs.get("type", "text").lower() in FIELDS and node.attrs.get("value"):
                    out.inline(node.attrs["value"])
                continue
            if tag == "img":
                continue
            if tag == "q" and visible:
                out.inline('"')
            if blocky:
                out.block(2 if tag in SPACED and not ((tag in LISTS or tag == "dl") and counters) else 1)
            children, held = node.children, 0
            if tag in ("pre", "textarea", "xmp"):
                pre += 1
            elif tag in LISTS:
                first = node.attrs.get("start", "1")
                counters.append([int(first) if re.fullmatch(r"-?[0-9]{1,9}", first) else 1] if tag == "ol" else None)
            elif tag == "table":
                if plain or len(tables) >= NESTED:
                    plain += 1
                else:
                    tables.append(Table())
            elif tag == "tr":
                if plain:
                    out.block(1)
                elif tables:
                    tables[-1].row()
            elif tag in ("td", "th"):
                if plain:
                    if not out.fresh:
                        out.inline("  ")
                else:
                    outs.append(Writer())
            elif tag in ("li", "dd", "blockquote"):
                lead = "  "
                if tag == "li":
                    lead = "- "
                    if counters and counters[-1]:
                        lead = f"{counters[-1][0]}. "
                        counters[-1][0] += 1
                held = out.enter(lead)
            elif tag == "select":
                children = [x for o in options(node) for x in (o, " ")]
            elif tag == "details" and "open" not in node.attrs:
                children = [c for c in children if not isinstance(c, str) and c.tag == "summary"]
            todo.append((node, visible, held))
            todo.extend((c, visible, None) for c in reversed(children))
            continue
        if tag in ("pre", "textarea", "xmp"):
            pre -= 1
        elif tag in LISTS:
            counters.pop()
        elif tag in ("td", "th"):
            if not plain:
                text = outs.pop().value()
                out = outs[-1]
                if tables and tables[-1].rows:
                    tables[-1].cell(text, _span(node, "colspan", 1000), _span(node, "rowspan", 65534))
                elif text:
                    out.block(1)
                    out.lines(text)
        elif tag in ("li", "dd", "blockquote"):
            out.leave(leaving)
        elif tag == "table":
            if plain:
                plain -= 1
            elif text := tables.pop().render():
                out.lines(text)
        elif tag == "q" and visible:
            out.inline('"')
        if blocky:
            out.block(2 if tag in SPACED and not ((tag in LISTS or tag == "dl") and counters) else 1)
    return "\n".join(x.rstrip() for x in outs[0].value().split("\n")).strip("\n")


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """pages with column ``out``: the visible text. A map over the rows: no shuffle."""
    bound_batches(pages.sparkSession, 500)
    pages = frames.without(pages, out)
    at = pages.columns.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for b in batches:
            yield [pa.array([None if x is None else render(x) for x in b.column(at).to_pylist()], pa.string())]

    return frames.mapped(pages, run, **{out: "string"})


def page_texts(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, text, n_chars, n_lines of every row."""
    src = pages.select(F.col(key).alias("page_id"), F.col(html).cast("string").alias("html"))
    t = extract(src).select("page_id", "text")
    return t.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
