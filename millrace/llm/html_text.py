"""HTML to text, aware of layout.

A tokenizer cuts a page into tags and text, a tree builder gives it shape (void elements, end tags that HTML lets authors
leave out, raw text elements), visibility rules drop what browsers don't show, and a renderer writes the rest: blocks on
lines of their own, paragraphs apart, list items with markers and indents, preformatted text as it is, and tables with
aligned columns.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist title input".split())
#: What svg and math hold besides what they show, and elements that stand on lines of their own though they are no blocks.
FOREIGN, UNDRAWN = frozenset(("svg", "math")), frozenset("desc metadata defs symbol clippath mask pattern marker annotation annotation-xml".split())
LINES = frozenset(("option", "optgroup"))
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table ul caption".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr".split())
#: A start tag closes the nearest open element of the second set, unless one of the third stands between.
CLOSES = {
    **{t: ({"p"}, {"button", "td", "th", "caption", "table"}) for t in BLOCK - {"li", "dd", "dt", "body", "html", "caption", "legend", "summary"}},
    "li": ({"li"}, {"ul", "ol", "menu", "table"}), "dt": ({"dt", "dd"}, {"dl", "table"}), "dd": ({"dt", "dd"}, {"dl", "table"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
#: No end tag of something outside closes one of these.
WALLS = frozenset(("table", "td", "th", "caption", "template"))
#: Where a table takes nothing but its parts; what else stands there is shown before the table.
BARE = frozenset("table thead tbody tfoot tr".split())
PARTS = frozenset("caption colgroup col thead tbody tfoot tr td th".split())
#: Content that ends an unclosed head.
HEAD_ONLY = frozenset("base basefont bgsound link meta noscript script style template title head html".split())

#: A tag: possessive throughout, so that nothing is read twice, whether it ends or not. Quotes count only after =.
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?+)*+)>""")
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|((?!["'])[^\s>]*+)))?+""")
COMMENT = re.compile(r"--!?>")
DISPLAY = re.compile(r"(?:^|;)\s*+display\s*+:\s*+([a-z-]++)", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*+visibility\s*+:\s*+(visible|hidden|collapse)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")
#: The largest spans that HTML knows.
COLSPAN, ROWSPAN = 1000, 65534
#: The widest indent that is written. Deeper items stand under each other, so that a page of nested lists doesn't grow with the square of its depth.
INDENT = 240


class Node:
    """An element: its name, its attributes, whether it is of svg or math, and its children, which are nodes and texts."""

    __slots__ = ("name", "attrs", "foreign", "children")

    def __init__(self, name: str, attrs: str = "", foreign: bool = False):
        self.name, self.foreign, self.children = name, foreign, []
        self.attrs: dict[str, str] = {}
        if attrs.strip(" /\n"):
            for m in ATTRIBUTE.finditer(attrs):
                self.attrs.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))

    def hidden(self) -> bool:
        """Whether the element and all in it is left out."""
        a = self.attrs
        if self.name in HIDDEN or self.foreign and self.name in UNDRAWN:
            return True
        if not a:
            return self.name == "dialog"
        said = DISPLAY.findall(a.get("style", ""))
        return said[-1].lower() == "none" if said else "hidden" in a or (self.name == "dialog" and "open" not in a)

    def visible(self, above: bool) -> bool:
        """Whether text in the element is seen, given whether that above is: visibility is inherited, and may be turned on again."""
        said = VISIBILITY.findall(self.attrs.get("style", "")) if self.attrs else ()
        return said[-1].lower() == "visible" if said else above


class _Builder:
    """The open elements, and the places of each name among them, so that no tag has to search them."""

    def __init__(self):
        self.root = Node("")
        self.stack, self.places = [self.root], {}

    def last(self, *names: str) -> int:
        """The place of the innermost open element of these names, 0 if there is none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, i: int) -> None:
        """Closes what is open from place i on."""
        while len(self.stack) > i:
            self.places[self.stack.pop().name].pop()

    def add(self, child: Node | str) -> None:
        """Puts a child under the innermost open element, or before the table if it has no place there."""
        top = self.stack[-1]
        at = self.last("table")
        if top.name not in BARE or at == 0 or (child.isspace() if isinstance(child, str) else child.name in PARTS):
            top.children.append(child)
            return
        around, held = self.stack[at - 1].children, self.stack[at]
        around.insert(next((k for k in range(len(around) - 1, -1, -1) if around[k] is held), len(around)), child)

    def text(self, text: str) -> None:
        if not text:
            return
        text = html.unescape(text)
        if self.stack[-1].name in ("head", "colgroup") and not text.isspace():
            self.cut(len(self.stack) - 1)
        self.add(text)

    def end(self, name: str) -> None:
        if name == "br":
            self.add(Node("br"))
        at = self.last(name)
        if at and (at >= self.last(*WALLS) or name in ("table", "tr", "thead", "tbody", "tfoot", "body", "html")):
            self.cut(at)

    def start(self, name: str, attrs: str) -> Node | None:
        """The element, if it stays open or has raw text to come."""
        if self.places.get("head") and name not in HEAD_ONLY:
            self.cut(self.places["head"][0])
        closing, walls = CLOSES.get(name, ((), ()))
        if (at := self.last(*closing)) > self.last(*walls):
            self.cut(at)
        if name in ("li", "dd", "dt") and (at := self.last("p")) > self.last("button", "td", "th", "caption", "table"):
            self.cut(at)
        if name in PARTS - {"col"}:  # ends captions, and what was moved out of the table
            home = {"td": BARE, "th": BARE, "tr": BARE - {"tr"}}.get(name, ("table",))
            if (at := self.last(*home)) and at >= self.last(*(WALLS - {"caption"})):
                self.cut(at + 1)
        elif self.stack[-1].name == "colgroup" and name not in ("col", "template"):
            self.cut(len(self.stack) - 1)
        if self.stack[-1].name in BARE:
            if name == "table" and (at := self.last("table")):
                self.cut(at)
            elif name == "form":  # holds nothing there; its rows are the table's
                return None
        node = Node(name, attrs, self.stack[-1].foreign or name in FOREIGN)
        self.add(node)
        return None if name in VOID or attrs.endswith("/") and node.foreign else node


@cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I)


def build(page: str) -> Node:
    """The tree of a page. Whatever is left open at the end is closed there; a tag that never ends is none, and ends the page."""
    tree, at, end = _Builder(), 0, len(page)
    while at < end:
        tag = page.find("<", at)
        tree.text(page[at : tag if tag >= 0 else end])
        if tag < 0:
            break
        sign = page[tag + 1 : tag + 2]
        if sign in ("!", "?") or sign == "/" and not page[tag + 2 : tag + 3].isalpha():
            if page.startswith("<![CDATA[", tag) and tree.stack[-1].foreign:
                stop = page.find("]]>", tag)
                tree.add(page[tag + 9 : stop if stop >= 0 else end])
                at = stop + 3 if stop >= 0 else end
            elif page.startswith("<!--", tag):
                stop = COMMENT.search(page, tag + (2 if page.startswith(("<!-->", "<!--->"), tag) else 4))
                at = stop.end() if stop else end
            else:
                at = page.find(">", tag) + 1 or end
            continue
        if not (sign == "/" or sign.isascii() and sign.isalpha()):
            tree.add("<")
            at = tag + 1
            continue
        m = TAG.match(page, tag)
        if m is None:
            if page[tag + 1 : tag + 3].isascii():
                break
            tree.add("<")  # </ before a letter that is none of ASCII
            at = tag + 1
            continue
        at, name = m.end(), m[2].lower()
        if m[1]:
            tree.end(name)
        elif (node := tree.start(name, m[3])) is not None:
            if name in RAW and not node.foreign:
                stop = _raw_end(name).search(page, at)
                inner = page[at : stop.start() if stop else end]
                node.children.append(html.unescape(inner) if name in ("textarea", "title") else inner)
                at = stop.end() if stop else end
            else:
                tree.push(node)
    return tree.root


def _width(s: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s) if not s.isascii() else len(s)


class _Page:
    """Lines as they are written. Blocks ask for a break before they write; only text makes it real."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []  # of the line that is being written
        self.blank, self.indent, self.marker = False, 0, ""

    def text(self, s: str) -> None:
        s = SPACE.sub(" ", s)
        if not self.parts:
            s = s.lstrip(" ")
        elif s.startswith(" ") and self.parts[-1].endswith(" "):
            s = s[1:]
        if s:
            self.parts.append(s)

    def taken(self) -> str:
        """The line so far, which then is empty."""
        line = "".join(self.parts)
        self.parts.clear()
        return line

    def put(self, line: str) -> None:
        if self.blank and self.lines and self.lines[-1]:
            self.lines.append("")
        self.blank = False
        room = min(self.indent, INDENT) - len(self.marker)
        self.lines.append((" " * room + self.marker + line).rstrip())
        self.marker = ""

    def done(self) -> list[str]:
        """The lines, without empty ones at both ends."""
        first = next((i for i, s in enumerate(self.lines) if s), len(self.lines))
        last = next((i for i in range(len(self.lines), first, -1) if self.lines[i - 1]), first)
        return self.lines[first:last]

    def end(self, apart: bool = False) -> None:
        line = self.taken().rstrip()
        if line:
            self.put(line)
        self.blank |= apart


def _rows(node: Node) -> list[list[Node]]:
    """Rows of cells of a table, those of its sections included and those of inner tables left alone."""
    rows: list[list[Node]] = []
    todo = list(reversed(node.children))
    while todo:
        n = todo.pop()
        if isinstance(n, str) or n.hidden():
            continue
        if n.name == "tr":
            rows.append([c for c in n.children if not isinstance(c, str) and c.name in ("td", "th") and not c.hidden()])
        elif n.name in ("td", "th"):
            rows.append([n])
        elif n.name not in ("table", "caption"):
            todo += reversed(n.children)
    return rows


def _span(cell: Node, name: str, most: int) -> int:
    n = cell.attrs.get(name, "1").strip()
    return min(int(n), most) if n.isascii() and n.isdigit() and len(n) < 9 else 1


def _grid(rows: list[list[Node]]) -> list[list[tuple[int, int, Node]]]:
    """(first column, column after the last, cell) of each row's cells; columns that cells of earlier rows reach down to are passed over."""
    out, held = [], []  # held: (first column, column after the last, first row that is free)
    for r, cells in enumerate(rows):
        held = sorted(h for h in held if h[2] > r)
        row, column, k = [], 0, 0
        more = []
        for cell in cells:
            while k < len(held) and held[k][0] <= column:
                column = max(column, held[k][1])
                k += 1
            after = column + max(_span(cell, "colspan", COLSPAN), 1)
            row.append((column, after, cell))
            down = _span(cell, "rowspan", ROWSPAN) or ROWSPAN
            if down > 1:
                if more and more[-1][1] == column and more[-1][2] == r + down:
                    more[-1] = (more[-1][0], after, r + down)
                else:
                    more.append((column, after, r + down))
            column = after
        held += more
        out.append(row)
    return out


def _table(node: Node, out: _Page, seen: bool):
    """Writes a table. Yields what is to be rendered first: (node, page, whether it is seen)."""
    out.end(True)
    for c in node.children:
        if not isinstance(c, str) and c.name == "caption" and not c.hidden():
            yield c, out, c.visible(seen)
            out.end()
    grid = _grid(_rows(node))
    if all(len(row) < 2 for row in grid):  # nothing to align
        for row in grid:
            for _, _, c in row:
                yield c, out, c.visible(seen)
                out.end()
        out.end(True)
        return
    rows = []
    for row in grid:
        cells = []
        for first, after, c in row:
            page = _Page()
            yield c, page, c.visible(seen)
            page.end()
            cells.append((first, after, page.done()))
        if any(any(lines) for _, _, lines in cells):
            rows.append(cells)
    used = sorted({first for cells in rows for first, _, _ in cells})
    index = {c: i for i, c in enumerate(used)}
    width, wide = [0] * len(used), []
    for cells in rows:
        for first, after, lines in cells:
            i, j = index[first], bisect_left(used, after)
            need = max(map(_width, lines), default=0)
            if j - i > 1:
                wide.append((j - i, i, j, need))
            else:
                width[i] = max(width[i], need)
    for _, i, j, need in sorted(set(wide)):  # what spans columns widens the first of them
        others = sum(w + 2 for w in width[i + 1 : j] if w)
        width[i] = max(width[i], need - others)
    offset, upto = [], 0
    for w in width:
        offset.append(upto)
        upto += w + 2 if w else 0
    for cells in rows:
        for k in range(max(len(lines) for _, _, lines in cells)):
            line, at = [], 0
            for first, _, lines in cells:
                if k < len(lines) and lines[k]:
                    start = offset[index[first]]
                    line += [" " * (start - at), lines[k]]
                    at = max(start, at) + _width(lines[k])
            out.put("".join(line).rstrip())
    out.end(True)


def _render(top: Node, out: _Page, seen: bool):
    """Writes what a node shows. Yields what is to be rendered first, for tables; a stack of its own otherwise, since pages nest as deep as they like."""
    todo: list = [("open", top, None, seen)]
    while todo:
        step, n, more, seen = todo.pop()
        if step == "call":
            n()
            continue
        if isinstance(n, str):
            if seen:
                out.text(n)
            continue
        if n is not top:
            if n.hidden():
                continue
            seen = n.visible(seen)
        name = n.name
        if name == "br":
            line = out.taken().rstrip()
            out.put(line)
        elif name == "hr":
            out.end(True)
        elif name == "img":
            if n.attrs.get("alt") and seen:
                out.text(n.attrs["alt"])
        elif name == "table":
            for first in _table(n, out, seen):
                yield first
        elif name in ("textarea", "pre"):
            out.end(name == "pre")
            said = _plain(n, seen).removeprefix("\n").rstrip("\n" if name == "pre" else None)
            for line in said.split("\n") if said or name == "pre" else ():
                out.put(line)
            out.end(name == "pre")
        else:
            children = n.children
            if name == "details" and "open" not in n.attrs:
                children = [c for c in children if not isinstance(c, str) and c.name == "summary"]
            block = (name in BLOCK or name in LINES or n.foreign and name == "text") and n is not top
            if name in ("li", "dd", "blockquote"):
                out.end(name == "blockquote")
                step_in, kind = (more or "- ", True) if name == "li" else ("  ", False)
                held = out.indent
                out.indent = held + len(step_in)
                if kind:
                    out.marker = step_in if seen else ""

                def leave(held=held, apart=name == "blockquote"):
                    out.end(apart)
                    out.indent, out.marker = held, ""

                todo.append(("call", leave, None, seen))
            elif block:
                inner = name in ("ul", "ol") and out.indent > 0
                out.end(name in APART and not inner)
                todo.append(("call", lambda a=name in APART and not inner: out.end(a), None, seen))
            count = int(n.attrs["start"]) if name == "ol" and re.fullmatch(r"-?\d{1,9}", n.attrs.get("start", "")) else 1
            steps = []
            for c in children:
                mark = None
                if not isinstance(c, str) and c.name == "li" and not c.hidden():
                    if name == "ol":
                        count = int(c.attrs["value"]) if re.fullmatch(r"-?\d{1,9}", c.attrs.get("value", "")) else count
                        mark, count = f"{count}. ", count + 1
                    else:
                        mark = "- "
                steps.append(("open", c, mark, seen))
            todo += reversed(steps)


def _plain(node: Node, seen: bool = True) -> str:
    """All visible text of a preformatted element, as it stands."""
    out, todo = [], [(node, seen)]
    while todo:
        n, seen = todo.pop()
        if isinstance(n, str):
            if seen:
                out.append(n)
        elif n.name == "br":
            out.append("\n")
        elif n is node or not n.hidden():
            seen = seen if n is node else n.visible(seen)
            todo += [(c, seen) for c in reversed(n.children)]
    return "".join(out).replace("\r\n", "\n")


def render(node: Node) -> str:
    """What a tree shows. Tables within tables are rendered first, from a list instead of the interpreter's own stack."""
    page = _Page()
    todo = [_render(node, page, True)]
    while todo:
        first = next(todo[-1], None)
        if first is None:
            todo.pop()
        else:
            todo.append(_render(*first))
    page.end()
    return "\n".join(page.done())


def page_text(page: str | None) -> str:
    """Visible text of a page; of null, an empty text."""
    return render(build(page)) if page else ""


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of `pages`: id, url, text string, n_chars long (code points of text).

    Defined cases: null and empty pages give an empty text; null and repeated ids stay as they are; broken markup gives
    what a browser would make of it, as far as the tree rules go: a tag that never ends hides the rest; tables of tables are rendered inside out, to any depth; cells reach
    over rows and columns as they say, within HTML's own bounds (65,534 and 1,000); pages of any length take time in proportion, and indents wider than INDENT are written as that; an empty
    table gives no rows; other columns are not read.
    """

    def scan(batches):
        for batch in batches:
            texts = [page_text(p) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    found = rows.mapInArrow(scan, f"id {rows.schema['id'].dataType.simpleString()}, url string, text string, n_chars bigint")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
