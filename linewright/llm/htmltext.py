"""HTML to text by layout-aware rendering.

One pass of a tokenizer feeds a tree builder that knows void elements, raw-text elements and
implied tags (a new paragraph, list item, table row or cell closes what it may not stand in, content
ends the head). The tree is walked without recursion, so depth has no bound: hidden elements give
nothing, blocks start on lines of their own, paragraphs and headings keep a blank line around them,
list items get their mark or number and are indented, preformatted text keeps its white space, and
tables come out with their columns aligned, cells that span rows or columns included.

Visibility follows attributes (``hidden``, ``open``), inline styles and the ``<style>`` rules whose
selectors are a tag, ids and classes of one element, by importance, specificity and order; ``display:
none`` hides all inside, ``visibility`` is inherited and can be taken back. Other selectors and media
other than screens count for nothing. As in browsers without user action, closed details show their
summary, a select its chosen option, and scripts are taken to run (``noscript`` is hidden); of graphics
and formulas the text is shown.

Only looks are bounded: indentation grows up to ``INDENT`` columns and cells are padded up to
``PADDED``, so that no page makes a text much larger than itself; the text is always whole.

Defined results: a null or empty page gives an empty text; unclosed, misnested and unknown tags are
accepted; everything visible is emitted, whatever its length; repeated rows each get their text; of
repeated attributes the first counts, of styles that tie the last; an empty table gives no row. Input
columns named like the output column give way to it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from linewright.llm.common import add_columns, field, take_turn

#: Columns that indentation grows to; columns that a cell is padded to.
INDENT, PADDED = 80, 200
# Element names by their role in HTML, and the most columns and rows that a cell spans.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template title noscript iframe noembed noframes object audio video canvas datalist input rp annotation annotation-xml col colgroup".split())
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head".split())
BLOCK = frozenset("address article aside blockquote body center details dd dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption search xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure hr menu xmp".split())
CELLS, ROW_GROUPS, LISTS = frozenset(("td", "th")), frozenset(("thead", "tbody", "tfoot")), frozenset(("ul", "ol", "menu", "dir"))
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: A start tag closes these open elements, above the innermost one of the second set.
CLOSES = (
    {name: (frozenset(("p",)), frozenset("button table td th caption object".split())) for name in BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}}
    | {"li": (frozenset(("li", "p")), BLOCK - {"li", "p", "address", "div"})}
    | dict.fromkeys(("dt", "dd"), (frozenset(("dt", "dd", "p")), frozenset(("dl", "table"))))
    | dict.fromkeys(("td", "th"), (frozenset(("td", "th", "p")), frozenset(("tr", "table"))))
    | {"tr": (frozenset(("tr", "td", "th", "p", "caption", "colgroup")), frozenset(("table",)))}
    | dict.fromkeys(("tbody", "thead", "tfoot"), (frozenset(("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup")), frozenset(("table",))))
    | {"option": (frozenset(("option",)), frozenset(("select", "datalist", "optgroup"))), "body": (frozenset(("head",)), frozenset())}
)
# A quote opens a value only behind an equals sign; elsewhere it is a character of a name, as in browsers.
_WS = r" \t\n\r\f"
_NAME, _EQUALS, _BARE = rf"[^{_WS}/>][^{_WS}/>=]*+", rf"[{_WS}]*+=[{_WS}]*+", rf"[^{_WS}>\"'][^{_WS}>]*+"
_TAG = re.compile(rf"<(/?)([A-Za-z][^{_WS}/>]*+)((?:[{_WS}/]++|{_NAME}(?:{_EQUALS}(?:\"[^\"]*+\"|'[^']*+'|{_BARE}|(?=>))|(?![{_WS}]*+=)))*+)>")
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(rf"({_NAME})(?:{_EQUALS}(?:\"([^\"]*+)\"|'([^']*+)'|({_BARE})|))?+")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
_SELECTOR = re.compile(r"(\*|[A-Za-z][\w-]*)?((?:[.#][\w-]+)*)")
_SCREENS = re.compile(r"\s*(?:only\s+)?(?:all|screen)?\s*", re.I)


class Node:
    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: str = ""):
        self.name, self.attrs, self.children = name, attrs, []

    def attribute(self, name: str) -> str | None:
        if name not in self.attrs.lower():
            return None
        for m in _ATTRIBUTE.finditer(self.attrs):
            if m[1].lower() == name:
                return unescape(m[2] or m[3] or m[4] or "")
        return None


class Open:
    """The open elements, innermost last, and at which places of them each name stands."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.places[node.name].append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, size: int) -> None:
        while len(self.nodes) > size:
            self.places[self.nodes.pop().name].pop()

    def last(self, names) -> int:
        """The place of the innermost element with one of the names, or 0."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def first_above(self, names, place: int) -> int:
        """The place of the outermost element with one of the names that is above ``place``, or 0."""
        found = (held[k] for n in names if (held := self.places.get(n)) and (k := bisect_right(held, place)) < len(held))
        return min(found, default=0)


def parse(html: str) -> tuple[Node, list[str]]:
    """The tree, and the text of its style sheets."""
    root, sheets = Node("#root"), []
    open_, at, n = Open(root), 0, len(html)

    def text(raw: str) -> None:
        if open_.nodes[-1].name == "head" and raw.strip():
            open_.cut(len(open_.nodes) - 1)
        open_.nodes[-1].children.append(unescape(raw))

    while at < n:
        start = html.find("<", at)
        if start < 0:
            text(html[at:])
            break
        kind = html[start + 1 : start + 2]
        if not (kind.isalpha() and kind.isascii() or kind in ("!", "?", "/")):  # no tag: the sign itself
            text(html[at : start + 1])
            at = start + 1
            continue
        if start > at:
            text(html[at:start])
        m = _TAG.match(html, start)
        if not m:
            # A comment or declaration; as in browsers, what is not closed hides the rest.
            if html.startswith("<!--", start):
                end = _COMMENT_END.search(html, start + 2 if html.startswith(("<!-->", "<!--->"), start) else start + 4)
                at = end.end() if end else n
            else:
                end = html.find(">", start) if kind in ("!", "?", "/") else -1
                at = end + 1 or n
            continue
        at, name = m.end(), m[2].lower()
        if m[1] and name != "br":  # browsers take </br> for <br>
            place = open_.last((name,))
            # An inline end tag does not reach out of a cell.
            if place and (name in BLOCK or place > open_.last(("table", "td", "th"))):
                open_.cut(place)
            continue
        if name not in IN_HEAD and open_.nodes[-1].name == "head":
            open_.cut(len(open_.nodes) - 1)
        rule = CLOSES.get(name)
        if rule:
            place = open_.first_above(rule[0], open_.last(rule[1]))
            if place:
                open_.cut(place)
        if name in CELLS and open_.nodes[-1].name in (*ROW_GROUPS, "table"):
            row = Node("tr")
            open_.nodes[-1].children.append(row)
            open_.push(row)
        node = Node(name, "" if m[1] else m[3] or "")
        open_.nodes[-1].children.append(node)
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            raw = html[at : end.start() if end else n]
            node.children.append(unescape(raw) if name in ("textarea", "title") else raw)
            at = n if not end else (html.find(">", end.end()) + 1 or n)
            if name == "style" and not open_.last(("template", "noscript")) and _SCREENS.fullmatch(node.attribute("media") or ""):
                sheets.append(raw)
            continue
        open_.push(node)
    return root, sheets


class Sheet:
    """The rules for display and visibility whose selectors describe one element by tag, ids and classes."""

    def __init__(self, sheets: list[str]):
        self.rules: dict[str, list[tuple]] = defaultdict(list)
        self.order = 0
        for css in sheets:
            if "{" in css:
                self._read(re.sub(r"/\*.*?(?:\*/|$)", " ", css, flags=re.S))

    def _read(self, css: str) -> None:
        at, open_media = 0, 0
        for m in re.finditer(r"[{};]", css):
            if m.start() < at:
                continue
            before = css[at : m.start()].strip()
            at = m.end()
            if m[0] == "}":
                open_media -= open_media > 0
            elif m[0] == "{":
                if before.startswith("@"):
                    if before[:6].lower() == "@media" and _SCREENS.fullmatch(before[6:]):
                        open_media += 1
                        continue
                    depth = 1
                    while depth and (brace := re.compile("[{}]").search(css, at)):
                        depth, at = depth + (1 if brace[0] == "{" else -1), brace.end()
                    at = len(css) if depth else at
                else:
                    end = css.find("}", at)
                    end = len(css) if end < 0 else end
                    self._add(before, css[at:end])
                    at = end + 1

    def _add(self, selectors: str, body: str) -> None:
        found = [(m[1].lower(), m[2].lower(), bool(m[3])) for m in _STYLE.finditer(body)]
        for selector in selectors.split(",") if found else ():
            m = _SELECTOR.fullmatch(selector.strip())
            if not m or not m[0]:
                continue
            tag = (m[1] or "*").lower()
            parts = re.findall(r"[.#][\w-]+", m[2])
            needed, ids = frozenset(parts), sum(p[0] == "#" for p in parts)
            self.order += 1
            for name, value, important in found:
                rank = (important, 0, ids, len(parts) - ids, tag != "*", self.order)
                self.rules[parts[0] if parts else tag].append((rank, tag, needed, name, value))

    def of(self, node: Node) -> dict[str, str]:
        """display and visibility of an element, as far as styles say."""
        best: dict[str, tuple] = {}
        low = node.attrs.lower()
        if self.rules:
            own = {"#" + x for x in [node.attribute("id")] if x} | {"." + x for x in (node.attribute("class") or "").split()} if "id" in low or "class" in low else frozenset()
            for key in (*own, node.name, "*"):
                for rank, tag, needed, name, value in self.rules.get(key, ()):
                    if tag in ("*", node.name) and needed <= own and (name not in best or rank > best[name][0]):
                        best[name] = (rank, value)
        if "style" in low:
            for k, m in enumerate(_STYLE.finditer(node.attribute("style") or "")):
                rank, name = (bool(m[3]), 1, 0, 0, False, k), m[1].lower()
                if name not in best or rank > best[name][0]:
                    best[name] = (rank, m[2].lower())
        return {name: value for name, (_, value) in best.items()}


class Writer:
    """Lines with pending spaces, line breaks and blank lines, in nested containers that indent them.

    ``start`` is where the container's lines begin; ``owed`` is a blank line that stands before its first.
    ``lead`` replaces the indentation of the next line: the marks of list items that have no line yet.
    """

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.blank = self.owed = False
        self.start, self.indent, self.lead = 0, "", None
        self.held: list[tuple] = []

    def text(self, s: str, pre: bool = False) -> None:
        if pre:
            for k, part in enumerate(s.split("\n")):
                if k:
                    self.newline(force=True)
                if part:
                    self.line.append(part)
            return
        words = _SPACES.sub(" ", s)
        if words[:1] == " ":
            self.space = True
            words = words[1:]
        if not words:
            return
        tail = words[-1] == " "
        if self.space and self.line:
            self.line.append(" ")
        self.line.append(words[:-1] if tail else words)
        self.space = tail

    def _put(self, line: str) -> None:
        """A line of the container, with the blank line that is due before it."""
        if not line.strip():
            if len(self.lines) > self.start:
                self.lines.append(line)
            return
        if self.blank if len(self.lines) > self.start else self.owed:
            self.lines.append("")
        self.blank = self.owed = False
        self.lines.append((self.indent if self.lead is None else self.lead) + line)
        self.lead = None

    def newline(self, force: bool = False) -> None:
        if self.line or force:
            line, self.line = "".join(self.line), []
            self._put(line if force else line.rstrip())
        self.space = False

    def gap(self) -> None:
        self.newline()
        self.blank = True

    def block(self, lines: list[str]) -> None:
        self.newline()
        for line in lines:
            self._put(line)

    def open(self, indent: str = "", mark: str | None = None) -> None:
        self.newline()
        self.held.append((self.start, self.blank, self.owed, self.indent, self.lead))
        self.owed = self.blank if len(self.lines) > self.start else self.owed
        self.blank, self.start = False, len(self.lines)
        if mark is not None:
            self.lead = (self.indent if self.lead is None else self.lead) + mark
        elif self.lead is not None:
            self.lead += indent
        if len(self.indent) < INDENT:
            self.indent += " " * len(mark) if mark is not None else indent

    def close(self, mark: bool = False) -> None:
        self.newline()
        if mark and len(self.lines) == self.start:  # an item without a line
            lead, self.lead = self.lead.rstrip(), ""
            self._put(lead)
        while len(self.lines) > self.start and not self.lines[-1].strip():
            self.lines.pop()
        written = len(self.lines) > self.start
        self.start, blank, owed, self.indent, lead = self.held.pop()
        self.blank, self.owed, self.lead = (False, False, None) if written else (blank, owed, lead)

    def done(self) -> list[str]:
        self.newline()
        while self.lines and not self.lines[-1].strip():
            self.lines.pop()
        return self.lines


class Table:
    """Rows of (lines, columns spanned, rows spanned); what stands outside of cells goes before them."""

    def __init__(self, node: Node):
        self.node, self.rows, self.outside = node, [], Writer()

    def layout(self) -> list[str]:
        taken: dict[int, int] = {}  # the last row that a cell from above spans, by column
        placed = []
        for r, cells in enumerate(self.rows):
            at, row = 0, {}
            for lines, wide, high in cells:
                while taken.get(at, -1) >= r:
                    at += 1
                row[at] = lines
                if high > 1:
                    taken.update(dict.fromkeys(range(at, at + wide), r + high - 1))
                at += wide
            placed.append(row)
        widths: dict[int, int] = {}
        for row in placed:
            for k, lines in row.items():
                widths[k] = max(widths.get(k, 0), *(len(x) for x in lines if len(x) <= PADDED), 0)
        columns, out = sorted(widths), self.outside.done()
        for row in placed:
            last = max(row, default=-1)
            used = columns[: bisect_right(columns, last)]
            lines = ["  ".join((row[k][i] if k in row and i < len(row[k]) else "").ljust(widths[k]) for k in used).rstrip() for i in range(max(map(len, row.values()), default=0))]
            out += lines if any(lines) else []  # a row without text has no line
        return out


def _number(text: str | None, default: int, most: int) -> int:
    """A count of spanned columns or rows, as browsers read it."""
    m = re.match(r"\s*\+?([0-9]+)", text or "")
    return min(int(m[1][:9]), most) if m else default


def _label(number: int, style: str) -> str:
    """The number of a list item in the list's style."""
    if style in ("a", "A") and number > 0:
        out = ""
        while number:
            number, k = divmod(number - 1, 26)
            out = chr(97 + k) + out
        return out if style == "a" else out.upper()
    if style in ("i", "I") and 0 < number < 4000:
        out = ""
        for value, sign in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split(), strict=True):
            out += sign * (number // value)
            number %= value
        return out if style == "i" else out.upper()
    return str(number)


class Renderer:
    """Walks the tree; what an element changes is put back when it is left."""

    def __init__(self, sheet: Sheet):
        self.sheet, self.out = sheet, Writer()
        self.pre = False
        self.shown, self.drawing = True, False
        self.table: Table | None = None
        self.list: list | None = None  # [is numbered, next number, step, style]
        self.options: set | None = None

    def walk(self, root: Node) -> str:
        stack = [(iter(root.children), lambda: None)]
        while stack:
            children, leave = stack[-1]
            for child in children:
                if isinstance(child, str):
                    if self.shown and not self.drawing:
                        self.out.text(child, self.pre)
                    continue
                inside = self.enter(child)
                if inside:
                    stack.append(inside)
                    break
            else:
                stack.pop()
                leave()
        return "\n".join(self.out.done())

    def _kept(self, *names: str):
        """A function that puts these attributes back."""
        held = [(n, getattr(self, n)) for n in names]

        def back() -> None:
            for name, value in held:
                setattr(self, name, value)

        return back

    def enter(self, node: Node):
        """(children to walk, what to do behind them), or None for an element that shows nothing inside."""
        name = node.name
        if name in HIDDEN or (self.options is not None and name == "option" and id(node) not in self.options):
            return None
        style = self.sheet.of(node) if self.sheet.rules or node.attrs else {}
        if style.get("display") == "none":
            return None
        if "display" not in style and node.attrs and "hidden" in node.attrs.lower() and node.attribute("hidden") is not None:
            return None
        if name == "dialog" and node.attribute("open") is None and "display" not in style:
            return None
        if "visibility" in style:
            back = self._kept("shown")
            self.shown = style["visibility"] not in ("hidden", "collapse")
            inside = self._inside(node)
            if not inside:
                back()
                return None
            return inside[0], lambda: (inside[1](), back())
        return self._inside(node)

    def _inside(self, node: Node):
        name, out = node.name, self.out
        if name == "br":
            out.newline(force=True)
            return None
        if name == "img":
            if self.shown and (alt := node.attribute("alt")):
                out.text(alt)
            return None
        if name in ("svg", "text", "foreignobject"):
            back = self._kept("drawing")
            if name == "svg" or self.drawing:
                self.drawing = name == "svg"
                out.space = True
            return iter(node.children), back
        if name == "select":
            return self._select(node)
        if name == "option":
            if self.options is not None:
                out.space = True
            return iter(node.children), lambda: None
        if self.table is not None and name in ("tr", "caption", *CELLS, *ROW_GROUPS):
            return self._part_of_table(node)
        if name not in BLOCK:
            return iter(node.children), lambda: None
        edge = out.gap if name in SPACED else out.newline
        edge()
        if name == "table":
            back, table = self._kept("table", "out", "pre", "list"), Table(node)
            self.table, self.out, self.pre, self.list = table, table.outside, False, None
            return iter(node.children), lambda: (back(), out.block(table.layout()), edge())
        if name in LISTS:
            back, first = self._kept("list", "pre"), node.attribute("start") or ""
            down = name == "ol" and node.attribute("reversed") is not None
            items = sum(not isinstance(c, str) and c.name == "li" for c in node.children) if down else 1
            self.list = [name == "ol", int(first) if re.fullmatch(r"-?[0-9]{1,9}", first) else items, -1 if down else 1, node.attribute("type") or "1"]
            self.pre = False
            out.open()
            return iter(node.children), lambda: (out.close(), back(), edge())
        if name == "li" and self.list is not None:
            numbered, value = self.list[0], node.attribute("value") or ""
            if re.fullmatch(r"-?[0-9]{1,9}", value):
                self.list[1] = int(value)
            mark = f"{_label(self.list[1], self.list[3])}. " if numbered else "- "
            self.list[1] += self.list[2]
            out.open(mark=mark)
            return iter(node.children), lambda: out.close(mark=True)
        if name == "details" and node.attribute("open") is None:
            first = next((c for c in node.children if not isinstance(c, str) and c.name == "summary"), None)
            return iter([first] if first else []), edge
        if name in ("blockquote", "dd"):
            out.open("  ")
            return iter(node.children), lambda: (out.close(), edge())
        if name in ("pre", "xmp"):
            back = self._kept("pre")
            self.pre = True
            return iter(node.children), lambda: (back(), edge())
        return iter(node.children), edge

    def _select(self, node: Node):
        """A list box shows every option, a drop-down list the chosen one, or the first."""
        options, todo = [], node.children[::-1]
        while todo:
            child = todo.pop()
            if isinstance(child, str):
                continue
            if child.name == "option":
                options.append(child)
            else:
                todo += child.children[::-1]
        chosen = [o for o in options if o.attribute("selected") is not None]
        back, whole = self._kept("options"), node.attribute("multiple") is not None or _number(node.attribute("size"), 1, 9) > 1
        self.options = {id(o) for o in (options if whole else chosen[-1:] or options[:1])}
        self.out.space = True
        return iter(node.children), lambda: (back(), setattr(self.out, "space", True))

    def _part_of_table(self, node: Node):
        table, name = self.table, node.name
        if name in ROW_GROUPS:
            return iter(node.children), lambda: None
        if name == "tr":
            table.rows.append([])
            return iter(node.children), lambda: None
        back, own = self._kept("table", "out", "pre", "list"), Writer()
        self.table, self.out, self.pre, self.list = None, own, False, None
        if name == "caption":
            return iter(node.children), lambda: (back(), table.outside.block(own.done()))
        high = _number(node.attribute("rowspan"), 1, MOST_ROWS) if "rowspan" in node.attrs.lower() else 1
        wide = _number(node.attribute("colspan"), 1, MOST_COLUMNS) or 1
        if not table.rows:
            table.rows.append([])
        row = table.rows[-1]
        return iter(node.children), lambda: (back(), row.append((own.done() or [""], wide, high or MOST_ROWS)))


def render(html: str | None) -> str:
    """The visible text of a page."""
    if not html:
        return ""
    root, sheets = parse(html.replace("\r\n", "\n").replace("\r", "\n"))
    return Renderer(Sheet(sheets)).walk(root)


def extract_text(pages: DataFrame, *, html: str = "html", out: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``pages`` (or its ``columns``) with the visible text of ``html``."""

    def fn(batches):
        take_turn("html")
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield part, [pa.array([render(x) for x in part.column(html).to_pylist()], pa.string())]

    keep = columns if columns is not None else pages.columns
    return add_columns(pages.select(*dict.fromkeys([*keep, html])), fn, [field(out, "string")], keep)
