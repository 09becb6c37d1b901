"""HTML: a small tree out of the standard parser, its roots, cell text, tables by their cells and grids of boxes."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser

from .text import NUMERIC, Table

# fixed values: elements without content, what ends an open one, what is not read, what ends a line, what may be a grid, what may hold a shadow root
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Opening one of these ends an open one of those, up to the table that holds them.
ENDS = {"td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "tbody": {"td", "th", "tr", "thead", "tbody"}, "tfoot": {"td", "th", "tr", "tbody", "thead"}, "thead": {"td", "th", "tr"}, "li": {"li"}, "option": {"option"}, "p": {"p"}}
PARTS = {"table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"}
SILENT = {"script", "style", "noscript", "template", "table"}
BLOCKS = {"p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article"}
GRIDS, GRID_ROLES = {"div", "ul", "ol", "section", "main"}, {"table", "grid", "rowgroup"}
HOSTS = {"article", "aside", "blockquote", "body", "div", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "main", "nav", "p", "section", "span"}
ROW_INDEX_ATTRIBUTES = ("aria-rowindex", "data-row-index", "data-rowindex", "row-index", "data-index")
#: White space at the ends of a cell.
WHITE = "\t\n\v\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
FILL, BLANK, MARK = "fill", "blank", "mark"
MARKED = "↳"
#: Rows of a grid, the rows whose width is compared, and the share of filled cells; spans; tables from which grids are not looked for; roots in roots; open elements, beyond which only the parts of a table still nest.
MOST_ROWS, COMPARED, FILLED, LONGEST_SPAN, ENOUGH_TABLES, DEEPEST, MOST_OPEN = 20_000, 20, 0.4, 1000, 8, 7, 400
#: Length from which a first row is no header.
LONGEST_HEADER = 60


@dataclass(frozen=True)
class Options:
    span_policy: str = FILL
    keep_footnotes: bool = False
    links: bool = False
    infer_headers: bool = True
    trim: bool = True
    line_breaks: bool = True
    image_text: bool = True
    min_rows: int = 2
    min_columns: int = 2


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict = field(default_factory=dict)
    children: list = field(default_factory=list)
    shadow: Node | None = None
    closed: bool = False

    def all(self, *tags: str) -> Iterator[Node]:
        """The elements below, in order; without tags, all of them."""
        waiting = self.elements[::-1]
        while waiting:
            node = waiting.pop()
            if not tags or node.tag in tags:
                yield node
            waiting += node.elements[::-1]

    @property
    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    @property
    def classes(self) -> list[str]:
        return list(dict.fromkeys(self.attrs.get("class", "").split()))


class Tree(HTMLParser):
    """Contents of templates and frames hang on no tree; a template with an open shadow root is the root of its parent."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        ends = ENDS.get(tag, ())
        while len(self.open) > 1 and self.open[-1].tag in ends:
            self.open.pop()
        if tag in ENDS and tag not in ("li", "p", "option"):
            # cells may hold other elements that were never closed
            above = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == "table"), 0)
            cut = next((i for i in range(above + 1, len(self.open)) if self.open[i].tag in ends), None)
            if cut is not None:
                del self.open[cut:]
        parent, node = self.open[-1], Node(tag, {k: v or "" for k, v in attrs})
        mode = node.attrs.get("shadowrootmode", "").lower()
        if tag == "template" and mode in ("open", "closed") and not parent.closed and (parent.tag in HOSTS or "-" in parent.tag):
            parent.closed, parent.shadow = True, node if mode == "open" else None
        else:
            parent.children.append(node)
        if tag not in VOID and len(self.open) < MOST_OPEN + 100 * (tag in PARTS):
            self.open.append(Node(tag) if tag in ("template", "iframe") and node is not parent.shadow else node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag == "table":
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def roots_of(root: Node, path: str = "", depth: int = 0) -> Iterator[tuple[str, Node]]:
    """The document and the open shadow roots and own frames in it, each with the way to it, as `/shadow/frame`."""
    yield path, root
    if depth >= DEEPEST:
        return
    for node in root.all():
        if node.shadow:
            yield from roots_of(node.shadow, f"{path}/shadow", depth + 1)
        if node.tag == "iframe" and node.attrs.get("srcdoc") and "allow-same-origin" in node.attrs.get("sandbox", "allow-same-origin").split():
            yield from roots_of(Tree(node.attrs["srcdoc"]).root, f"{path}/frame", depth + 1)


def hidden(node: Node) -> bool:
    style = re.sub(r"\s", "", node.attrs.get("style", "")).lower()
    return "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true" or bool(re.search(r"(^|;)(display:none|visibility:hidden)", style))


def chosen(select: Node) -> str:
    """The text of the option that a list shows: the one selected, or the first."""
    every = list(select.all("option"))
    marked = [o for o in every if "selected" in o.attrs]
    if "multiple" in select.attrs:
        shown = marked[:1]
    else:
        shown = marked[-1:] or [o for o in every if "disabled" not in o.attrs][:1]
    return "".join(plain_text(o) for o in shown)


def plain_text(node: Node) -> str:
    return "".join(c if isinstance(c, str) else plain_text(c) for c in node.children)


def cell_text(node: Node, options: Options) -> str:
    """What a reader sees of a cell: line breaks stay, hidden parts, footnotes and inner tables do not count, images and inputs give their text."""
    out: list[str] = []
    end = "\n" if options.line_breaks else " "

    def walk(n: Node) -> None:
        if n.tag in SILENT or hidden(n) or (not options.keep_footnotes and (n.tag == "sup" or "reference" in n.classes)):
            return
        if n.tag == "br":
            out.append(end)
        elif n.tag == "img" and options.image_text:
            out.append(n.attrs.get("alt", ""))
        elif n.tag == "input":
            kind = n.attrs.get("type", "text").lower()
            if kind in ("checkbox", "radio"):
                out.append("true" if "checked" in n.attrs else "false")
            elif kind not in ("password", "hidden"):
                out.append(n.attrs.get("value", ""))
        elif n.tag == "select":
            out.append(chosen(n))
        else:
            for c in n.children:
                if isinstance(c, str):
                    out.append(c)
                else:
                    walk(c)
            if n.tag in BLOCKS:
                out.append(end)

    walk(node)
    text = "".join(out)
    return trimmed(text) if options.trim else text


def trimmed(text: str) -> str:
    text = re.sub(r"[ \t\f\v]+", " ", text.replace("\xa0", " "))
    return re.sub(r"\n{2,}", "\n", re.sub(r" *\n *", "\n", text)).strip(WHITE)


def image_of(node: Node) -> str:
    image = next(node.all("img"), None)
    return (image.attrs.get("alt") or image.attrs.get("src", "")) if image else ""


def link_of(node: Node) -> str:
    return next((a.attrs["href"] for a in node.all("a") if "href" in a.attrs), "")


def span(node: Node, name: str) -> int:
    found = re.match(r"\s*[+-]?\d+", node.attrs.get(name, ""))
    return min(LONGEST_SPAN, max(1, int(found[0]) or 1)) if found else 1


def rows_of(table: Node) -> list[Node]:
    """The rows of a table in order, not those of tables inside it."""
    out = []
    for c in table.elements:
        if c.tag == "tr":
            out.append(c)
        elif c.tag in ("thead", "tbody", "tfoot"):
            out += rows_of(c)
    return out


@dataclass
class Cell:
    """A cell where it starts: the first free place of its row."""

    r: int
    c: int
    row_span: int
    col_span: int
    node: Node


def placed_cells(table: Node) -> list[Cell]:
    """The cells of a table; places that cells above reach into are taken."""
    out, reaching = [], []  # (first column, column behind the last, last row)
    for r, row in enumerate(rows_of(table)):
        reaching = [x for x in reaching if x[2] >= r]
        at, own = 0, []
        for node in row.elements:
            if node.tag not in ("td", "th"):
                continue
            while behind := max((b for a, b, _ in reaching if a <= at < b), default=0):
                at = behind
            cell = Cell(r, at, span(node, "rowspan"), span(node, "colspan"), node)
            out.append(cell)
            own.append((at, at + cell.col_span, r + cell.row_span - 1))
            at += cell.col_span
        reaching += [x for x in own if x[2] > r]
    return out


def head_rows(table: Node) -> int:
    """The rows of the head of a table that has one."""
    head = next((c for c in table.elements if c.tag == "thead"), None)
    return sum(1 for _ in head.all("tr")) if head else 0


def numbers(row: list[str]) -> int:
    return sum(bool(NUMERIC.match(c)) for c in row if c)


def header_rows(texts: list[list[str]], grid: list[dict[int, Cell]], head: int, infer: bool = True) -> int:
    """How many rows are headers: those of the head, else the leading ones of header cells only, else a first row of labels above numbers."""
    if 0 < head < len(texts):
        return head
    if not infer or len(texts) < 2:
        return 0
    leading = next((i for i, g in enumerate(grid) if not g or any(x.node.tag != "th" for x in g.values())), len(grid))
    if leading:
        return min(leading, len(texts) - 1)
    first, second = texts[:2]
    good = sum(map(bool, first)) >= max(2, int(0.6 * len(first))) and not numbers(first) and numbers(second) and all(len(c) <= LONGEST_HEADER for c in first)
    return int(bool(good))


def extract(table: Node, options: Options | None = None) -> Table:
    from ..grid import unique_names

    o = options or Options()
    cells, grid = placed_cells(table), []
    for x in cells:
        while len(grid) < x.r + x.row_span:
            grid.append({})
        for i in range(x.row_span):
            for j in range(x.col_span):
                grid[x.r + i].setdefault(x.c + j, x)
    while len(grid) < len(rows_of(table)):
        grid.append({})
    width = max((max(g, default=-1) + 1 for g in grid), default=0)
    text = {id(x): cell_text(x.node, o) for x in cells}
    plain = [[text[id(g[j])] if j in g else "" for j in range(width)] for g in grid]
    if o.image_text:
        text = {id(x): text[id(x)] or image_of(x.node) for x in cells}

    def shown(r: int, j: int) -> str:
        x = grid[r].get(j)
        if x is None:
            return ""
        return text[id(x)] if o.span_policy == FILL or (x.r, x.c) == (r, j) else "" if o.span_policy == BLANK else MARKED

    texts = [[shown(r, j) for j in range(width)] for r in range(len(grid))]
    n_head = header_rows(plain, grid, head_rows(table), o.infer_headers) if grid else 0
    stacked = []
    for j in range(width):
        parts = []
        for row in texts[:n_head]:
            t = row[j].strip()
            if t and (not parts or parts[-1] != t):
                parts.append(t)
        stacked.append(re.sub(r"\s*\n\s*", " ", " – ".join(parts)))
    body = [(g, t) for g, t in zip(grid[n_head:], texts[n_head:], strict=True) if any(t)]
    links = {j for g in grid for j, x in g.items() if link_of(x.node)} if o.links else set()
    names, rows = [], [[] for _ in body]
    for j in range(width):
        names.append(stacked[j])
        for row, (_, t) in zip(rows, body, strict=True):
            row.append(t[j])
        if j in links:
            names.append(f"{stacked[j]} link".strip())
            for row, (g, _) in zip(rows, body, strict=True):
                row.append(link_of(g[j].node) if j in g else "")
    caption = next((cell_text(c, o) for c in table.elements if c.tag == "caption"), "")
    return Table(unique_names(names), rows, caption, any(x.row_span > 1 or x.col_span > 1 for x in cells))


def box_rows(node: Node, options: Options) -> list[list[str]] | None:
    """The rows of a container of like children that have like children, if it is one: most share a tag and classes, and a width.

    A first child of another shape is a header and stays; others of another shape go, and so do blank rows.
    """
    o = options
    kids = [k for k in node.elements if k.tag not in ("script", "style", "template")]
    if not max(2, o.min_rows) <= len(kids) <= MOST_ROWS:
        return None
    shape = lambda n: (n.tag, tuple(sorted(n.classes[:3])))
    usual = Counter(map(shape, kids)).most_common(1)[0][0]
    body = [k for k in kids if shape(k) == usual]
    if len(body) < max(2, o.min_rows):
        return None
    alike = body if kids[0] is body[0] else [kids[0], *body]
    width = len(alike[0].elements)
    if len(alike) < 0.8 * len(kids) or not width or width < o.min_columns or any(len(r.elements) != width for r in alike[:COMPARED]):
        return None
    rows = [r for r in ([cell_text(c, o) for c in r.elements] for r in alike) if any(r)]
    if len(rows) < o.min_rows or sum(bool(c) for r in rows for c in r) < FILLED * len(rows) * width:
        return None
    return rows


def box_header(rows: list[list[str]], infer: bool = True) -> int:
    return int(infer and len(rows) > 1 and not numbers(rows[0]) and all(len(c) <= LONGEST_HEADER for c in rows[0]))


def box_table(rows: list[list[str]], options: Options) -> Table:
    from ..grid import unique_names

    width = len(rows[0])
    rows = [r + [""] * (width - len(r)) for r in rows]
    n = box_header(rows, options.infer_headers)
    return Table(unique_names([re.sub(r"\s*\n\s*", " ", c) for c in rows[0]] if n else [""] * width), rows[n:])


def box_grids(root: Node, options: Options) -> Iterator[tuple[Node, list[list[str]]]]:
    """The outermost grids of a root, outside its tables."""
    waiting = root.elements[::-1]
    while waiting:
        node = waiting.pop()
        if node.tag == "table":
            continue
        may = node.tag in GRIDS or (node.tag == "tbody" and "role" in node.attrs) or node.attrs.get("role") in GRID_ROLES
        rows = box_rows(node, options) if may else None
        if rows:
            yield node, rows
        else:
            waiting += node.elements[::-1]


@dataclass
class Found:
    """A table or grid of a page before it is judged by its size. ``holds`` numbers the tables inside a grid, by their places in the list."""

    kind: str
    path: str
    node: Node
    rows: list[list[str]] | None = None
    virtual: bool = False
    holds: list[int] = field(default_factory=list)

    @property
    def named(self) -> str:
        return next((self.node.attrs[k] for k in ("aria-label", "summary", "id") if self.node.attrs.get(k)), "")


def virtualised(node: Node, above: list[Node]) -> bool:
    """Whether most rows may not be in the page: by the classes that such scrollers have, and rows that are moved about."""
    marked = any("virtual" in n.attrs.get("class", "") or "Virtual" in n.attrs.get("class", "") or "ag-body-viewport" in n.classes or "data-virtuoso-scroller" in n.attrs for n in [node, *above])
    return marked or bool(re.search(r"transform:\s*translate", node.attrs.get("style", ""), re.I))


def candidates_of(text: str, options: Options | None = None) -> list[Found]:
    """All tables of a page in order, root by root, and then all its grids."""
    o, out = options or Options(), []
    roots = list(roots_of(Tree(text).root))
    places: dict[Node, int] = {}
    above: dict[Node, list[Node]] = {}
    for path, root in roots:
        waiting = [(root, [])]
        while waiting:
            node, over = waiting.pop()
            above[node] = over
            if node.tag == "table":
                places[node] = len(out)
                out.append(Found("table", path, node, None, virtualised(node, over)))
            waiting += [(c, [*over, node]) for c in node.elements[::-1]] if len(over) < 2 * MOST_OPEN else []
    for path, root in roots:
        for node, rows in box_grids(root, o):
            out.append(Found("grid", path, node, rows, virtualised(node, above[node]), [places[t] for t in node.all("table")]))
    return out


def accepted(found: list[Found], tables: list[Table], options: Options) -> list[int]:
    """The candidates that count: large enough; grids only where tables are few, and none that holds one."""
    big = [len(t.rows) >= options.min_rows and len(t.headers) >= options.min_columns for t in tables]
    first = [i for i, f in enumerate(found) if f.kind == "table" and big[i]]
    more = [i for i, f in enumerate(found) if f.kind == "grid" and big[i] and not set(f.holds) & set(first)]
    return first + (more if len(first) < ENOUGH_TABLES else [])


def tables_of(text: str, options: Options | None = None) -> list[tuple[Found, Table]]:
    o = options or Options()
    found = candidates_of(text, o)
    tables = [extract(f.node, o) if f.kind == "table" else box_table(f.rows, o) for f in found]
    return [(found[i], tables[i]) for i in accepted(found, tables, o)]


def find_tables(text: str, options: Options | None = None) -> list[Table]:
    """Tables of a page in order; box grids are looked for where there are fewer than eight."""
    return [t for _, t in tables_of(text, options)]


#: A row up to its end tag: cells of text only, without attributes.
PLAIN_ROW = re.compile(r"\s*<tr>\s*(?:<td>[^<]*</td>\s*)+")
PLAIN_CELL = re.compile(r"<td>([^<]*)</td>")


def plain_row(unit: str) -> list[str] | None:
    """The cells of a plain row without its end tag, as a parser of the whole page gives them; None if it is another text."""
    return [trimmed(unescape(c)) for c in PLAIN_CELL.findall(unit)] if PLAIN_ROW.fullmatch(unit) else None


def plain_table(first: list[str], foot: str) -> Table | None:
    """The one table of a page that begins with some rows, goes on with plain ones and ends with ``foot``, with the rows among the first ones.

    None if it cannot be told by these: the last three of the first ones have to be plain, and nothing else may be a table or a grid.
    """
    text = "</tr>".join([*first, foot])
    found = candidates_of(text)
    if len(found) != 1 or found[0].kind != "table" or found[0].path:
        return None
    rows, table = rows_of(found[0].node), extract(found[0].node)
    last = [[cell_text(c, Options()) for c in row.elements] for row in rows[-3:]]
    if len(rows) != len(first) or table.has_merges or len(table.headers) < Options.min_columns or last != [plain_row(x) for x in first[-3:]]:
        return None
    return table


def largest_table(text: str, options: Options | None = None) -> Table:
    found = find_tables(text, options)
    if not found:
        raise ValueError("no table in this page")
    return max(found, key=lambda t: len(t.rows) * len(t.headers))
