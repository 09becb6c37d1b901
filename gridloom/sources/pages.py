"""Tables of whole collections of pages: a table function parses each page beside its row, the layout is Spark's.

The parser gives the cells of a table where they start. Cells are spread over the places that they span by two exploded
sequences, the first claim to a place wins, and the header rows, stacked headers, span policies, sizes and labels follow from
aggregates. All of it happens in one partitioning, by page.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from ..functions.scalar import let
from .html import BLANK, ENOUGH_TABLES, FILL, LONGEST_HEADER, MARK, MARKED, ROW_INDEX_ATTRIBUTES, Options, box_header, candidates_of, cell_text, head_rows, image_of, link_of, placed_cells, plain_text, rows_of
from .text import NUMERIC

CELL = "struct<k: int, r: int, c: int, row_span: int, col_span: int, th: boolean, text: string, image: string, href: string>"
INDEXED = "struct<attributes: map<string, string>, cells: array<string>>"
FOUND = f"seq int, kind string, path string, named string, caption string, virtual boolean, head int, n_rows int, holds array<int>, cells array<{CELL}>, indexed array<{INDEXED}>"
LONGEST_LABEL = 60
_NUMERIC = NUMERIC.pattern


def indexed_rows(node) -> list[tuple[dict, list[str]]]:
    """Rows that bear one of the attributes by which libraries number rows, with the plain text of what stands in them."""
    out = []
    for row in node.all():
        if row.tag == "tr" or row.attrs.get("role") == "row":
            numbers = {k: row.attrs[k] for k in ROW_INDEX_ATTRIBUTES if row.attrs.get(k)}
            cells = [" ".join(plain_text(c).split()) for c in row.elements]
            if numbers and any(cells):
                out.append((numbers, cells))
    return out


def found_rows(html: str | None, o: Options):
    """One row for each table and grid of a page, with its cells."""
    for seq, f in enumerate(candidates_of(html or "", o)):
        caption, head, cells = "", 0, []
        if f.kind == "table":
            caption, head, n_rows = next((cell_text(c, o) for c in f.node.elements if c.tag == "caption"), ""), head_rows(f.node), len(rows_of(f.node))
            for k, x in enumerate(placed_cells(f.node)):
                cells.append(Row(k=k, r=x.r, c=x.c, row_span=x.row_span, col_span=x.col_span, th=x.node.tag == "th", text=cell_text(x.node, o), image=image_of(x.node) if o.image_text else "", href=link_of(x.node)))
        else:
            n_rows, head = len(f.rows), box_header(f.rows, o.infer_headers)
            width = len(f.rows[0])
            for r, row in enumerate(f.rows):
                cells += [Row(k=r * width + c, r=r, c=c, row_span=1, col_span=1, th=False, text=text, image="", href="") for c, text in enumerate(row[:width])]
        yield seq, f.kind, f.path, f.named, caption, f.virtual, head, n_rows, f.holds, cells, [Row(attributes=a, cells=c) for a, c in indexed_rows(f.node)]


def table_function(options: Options):
    """The table function that reads a page: used beside each row of pages, or in SQL once it is registered."""
    told = asdict(options)

    class PageTables:
        def eval(self, html: str):
            yield from found_rows(html, Options(**told))

    return F.udtf(PageTables, returnType=FOUND)


def page_candidates(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", options: Options | None = None) -> DataFrame:
    """The tables and grids of each page, whatever their size: page_id, page_code (which tells pages that repeat an id apart by their html) and what FOUND names.

    Pages that repeat an id and their html count once. A null page has no tables; a null id is an id as any other.
    """
    read = table_function(options or Options())
    own = pages.select(F.col(id_col).alias("page_id"), F.xxhash64(html_col).alias("page_code"), F.col(html_col).cast("string").alias("html")).where("html is not null")
    return own.lateralJoin(read(F.col("html").outer())).drop("html").repartition("page_id", "page_code")


TABLE = ["page_id", "page_code", "seq"]


def page_cells(candidates: DataFrame, about: Column | None = None) -> DataFrame:
    """The long form: a row for each place of each table, with the cell that claimed it first: page_id, page_code, seq, r, c, master (it starts here), th, text, image, href.

    ``about`` is handed on with the first cell of each table, null elsewhere.
    """
    about = F.lit(None).cast("string") if about is None else about
    starts = candidates.select(*TABLE, about.alias("about"), F.inline("cells")).withColumn("about", F.when(F.col("k") == 0, F.col("about")))
    spread = starts.select("*", F.explode(F.sequence("r", F.col("r") + F.col("row_span") - 1)).alias("row")).select("*", F.explode(F.sequence("c", F.col("c") + F.col("col_span") - 1)).alias("column"))
    cell = F.struct(((F.col("r") == F.col("row")) & (F.col("c") == F.col("column"))).alias("master"), "th", "text", "image", "href", "about")
    return spread.groupBy(*TABLE, "row", "column").agg(F.min_by(cell, "k").alias("cell")).select(*TABLE, F.col("row").alias("r"), F.col("column").alias("c"), "cell.*")


def _rows(cells: DataFrame, policy: str) -> DataFrame:
    """A row for each row of a table that has cells: its places, and what the header rule asks of it."""
    text = F.when(F.col("text") == "", F.col("image")).otherwise(F.col("text"))
    shown = {FILL: text, BLANK: F.when(F.col("master"), text).otherwise(""), MARK: F.when(F.col("master"), text).otherwise(MARKED)}[policy]
    number = F.col("text").rlike(_NUMERIC) & (F.col("text") != "")
    return cells.withColumn("shown", shown).groupBy(*TABLE, "r").agg(
        F.collect_list(F.struct("c", "shown", "href")).alias("places"), (F.max("c") + 1).alias("width"), F.bool_and("th").alias("all_th"),
        F.count_if(F.col("text") != "").alias("filled"), F.count_if(number).alias("numbers"), F.max(F.length("text")).alias("longest"), F.bool_or(F.col("shown") != "").alias("any"), F.first("about", ignorenulls=True).alias("about"),
    )


def _header_rows() -> Column:
    """How many rows are headers, out of a table's rows in order: those of the head, else the leading ones of header cells only, else one of labels above numbers."""
    at = lambda i: F.get("grid", F.lit(i))
    # the first row that is not all header cells; one without cells ends the header as well
    wrong = F.filter(F.transform("grid", lambda x, i: F.when(~x["all_th"] | (x["r"] != i), i)), lambda x: x.isNotNull())
    leading = F.least(F.coalesce(F.get(wrong, F.lit(0)), F.size("grid")), F.col("n") - 1)
    good = (at(0)["r"] == 0) & (at(1)["r"] == 1) & (at(0)["filled"] >= F.greatest(F.lit(2), F.floor(F.col("width") * 0.6))) & (at(0)["numbers"] == 0) & (at(1)["numbers"] > 0) & (at(0)["longest"] <= LONGEST_HEADER)
    inferred = let(leading, lambda k: F.when(F.col("n") < 2, 0).when(k > 0, k).otherwise(F.coalesce(good, F.lit(False)).cast("int")))
    head = F.col("about.head")
    return F.when(F.col("about.kind") == "grid", head).when((head > 0) & (head < F.col("n")), head).when(F.col("infer"), inferred).otherwise(0)


def _line(row: Column, value: str) -> Column:
    """The values of one row from the first to the last column."""
    places = F.map_from_entries(F.transform(row["places"], lambda p: F.struct(p["c"], p[value])))
    return F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda c: F.coalesce(F.element_at(places, c), F.lit("")))


def _unique(names: Column) -> Column:
    """Blank names become `Column i`, repeats get a number behind them."""
    named = F.transform(names, lambda x, i: F.when(F.trim(x) == "", F.concat(F.lit("Column "), (i + 1).cast("string"))).otherwise(x))
    behind = lambda every, x, i: let(F.size(F.filter(F.slice(every, 1, i + 1), lambda y: y == x)), lambda n: F.when(n == 1, x).otherwise(F.concat(x, F.lit(" ("), n.cast("string"), F.lit(")"))))
    return let(named, lambda every: F.transform(every, lambda x, i: behind(every, x, i)))


def page_tables(candidates: DataFrame, options: Options | None = None) -> DataFrame:
    """The tables that count, one row each: page_id, page_code, nth (from 1), kind, path, label, caption, headers, body (rows of cells), rows, columns, header_rows, merged, virtual.

    A table counts if it has enough rows and columns without its headers and blank rows; a grid if it has, holds no table that counts
    and the page has fewer than eight of them. Tables come before grids, each in the order of roots and then of the page.
    """
    o = options or Options()
    candidates = candidates.withColumn("merged", F.exists("cells", lambda x: (x["row_span"] > 1) | (x["col_span"] > 1)))
    about = F.struct("kind", "path", "named", "caption", "virtual", "head", "n_rows", "holds", "merged")
    whole = _rows(page_cells(candidates, about), o.span_policy).groupBy(*TABLE).agg(
        F.array_sort(F.collect_list(F.struct("r", "places", "all_th", "filled", "numbers", "longest", "any"))).alias("grid"), F.max("width").alias("width"), (F.max("r") + 1).alias("last"), F.first("about", ignorenulls=True).alias("about")
    )
    whole = whole.withColumns({"n": F.greatest("about.n_rows", "last"), "infer": F.lit(o.infer_headers)}).withColumn("header_rows", _header_rows())

    lines = F.transform(F.filter("grid", lambda x: x["r"] < F.col("header_rows")), lambda x: _line(x, "shown"))
    filled = lambda c: F.filter(F.transform("lines", lambda x: F.trim(F.get(x, c))), lambda t: t != "")
    once = lambda parts: let(parts, lambda t: F.filter(t, lambda x, i: (i == 0) | (x != F.get(t, i - 1))))
    stacked = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda c: F.regexp_replace(F.array_join(once(filled(c)), " – "), r"\s*\n\s*", " "))
    whole = whole.withColumn("lines", lines).withColumn("headers", _unique(stacked))
    body = F.filter("grid", lambda x: (x["r"] >= F.col("header_rows")) & x["any"])
    whole = whole.withColumns({"body": F.transform(body, lambda x: _line(x, "shown")), "n_body": F.size(body)}).withColumn("big", (F.col("n_body") >= o.min_rows) & (F.col("width") >= o.min_columns))

    page, grid = Window.partitionBy("page_id", "page_code"), F.col("about.kind") == "grid"
    whole = whole.withColumn("tables", F.collect_list(F.when(F.col("big") & ~grid, F.col("seq"))).over(page))
    whole = whole.where(F.col("big") & (~grid | ((F.size("tables") < ENOUGH_TABLES) & ~F.arrays_overlap("about.holds", "tables"))))
    nth = F.row_number().over(page.orderBy(grid, "seq"))
    named = F.when(F.col("about.caption") != "", F.col("about.caption")).when(F.col("about.named") != "", F.left("about.named", F.lit(LONGEST_LABEL))).otherwise(F.left(F.array_join(F.slice("headers", 1, 3), ", "), F.lit(LONGEST_LABEL)))
    return whole.select("page_id", "page_code", nth.alias("nth"), "about.kind", "about.path", named.alias("label"), "about.caption", "headers", "body", F.col("n_body").alias("rows"), F.col("width").alias("columns"), "header_rows", "about.merged", "about.virtual")


def catalogue(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", options: Options | None = None) -> DataFrame:
    """What tables each page has: page_id, nth, kind, path, label, caption, rows, columns, header_rows, merged, virtual."""
    return page_tables(page_candidates(pages, id_col, html_col, options), options).select("page_id", "nth", "kind", "path", "label", "caption", "rows", "columns", "header_rows", "merged", "virtual")


def rows_of_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", options: Options | None = None, with_label: bool = False) -> DataFrame:
    """The rows of all tables of all pages: page_id, nth, r (from 0; the headers are row -1), cells; with the table's label if wanted."""
    found = page_tables(page_candidates(pages, id_col, html_col, options), options)
    rows = F.concat(F.array(F.struct(F.lit(-1).alias("r"), F.col("headers").alias("cells"))), F.transform("body", lambda x, i: F.struct(i.alias("r"), x.alias("cells"))))
    return found.select("page_id", "nth", *["label"] * with_label, F.inline(rows))


def numbered_rows(candidates: DataFrame) -> DataFrame:
    """Rows that their page numbers by an attribute: page_id, page_code, seq, index, cells (the plain text of what stands in them)."""
    told = F.coalesce(*[F.element_at("attributes", F.lit(a)).try_cast("double") for a in ROW_INDEX_ATTRIBUTES]).cast("long")
    return candidates.select(*TABLE, F.inline("indexed")).select(*TABLE, told.alias("index"), "cells").where("index is not null")
