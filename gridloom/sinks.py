"""Writing grids: each format gives one string a row in the JVM, a head, a foot and what stands between rows, so that files of any size are written in parts."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from datetime import date
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import scalar as S
from .grid import POS, Grid, numbered
from .shared import new_path, put_together
from .workbook import NUMERIC, WIDEST, write_workbook, xlsx

# fixed values: each format's file extension and media type
FORMATS = {
    "csv": ("csv", "text/csv"), "tsv": ("tsv", "text/tab-separated-values"), "xlsx": ("xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
    "json": ("json", "application/json"), "json-arrays": ("json", "application/json"), "jsonl": ("jsonl", "application/x-ndjson"), "xml": ("xml", "application/xml"),
    "markdown": ("md", "text/markdown"), "html": ("html", "text/html"), "sql": ("sql", "text/plain"), "yaml": ("yaml", "text/yaml"), "latex": ("tex", "text/plain"), "text": ("txt", "text/plain"),
}
# fixed values: tokens that JSON, XML and YAML write as booleans, and those that SQL does
JSON_TRUE, JSON_FALSE = ["true", "yes", "y", "1", "✓", "✔"], ["false", "no", "n", "0", "✗", "✘"]
SQL_TRUE, SQL_FALSE = ["true", "yes", "y", "1"], ["false", "no", "n", "0"]
#: Rows of one INSERT, and columns that padded formats give a cell at most.
BATCH = 500
BOM = "﻿"
# fixed values: the style sheet of a whole HTML page
STYLE = """<style>
table{border-collapse:collapse;font-family:system-ui,sans-serif;font-size:14px}
caption{text-align:left;font-weight:600;padding:8px 0}
th,td{border:1px solid #d0d7de;padding:6px 10px;text-align:left}
th{background:#f6f8fa;font-weight:600}
tr:nth-child(even) td{background:#fafbfc}
</style>
"""


@dataclass(frozen=True)
class Lines:
    """A text: head, rows (_pos, line) with ``between`` after each but the last, and foot; head and foot end with a newline where they are not empty."""

    head: str
    rows: DataFrame
    foot: str = ""
    between: str = ""
    newline: str = "\n"
    empty: str | None = None  # the whole text of a grid without rows, where it is not head and foot
    ends: bool = True  # whether the last line ends with a newline


def quoted(cell: Column, delimiter: str, guard: bool = True) -> Column:
    """A delimited field; one that a spreadsheet would run as a formula gets a tab before it."""
    if guard:
        cell = F.when((F.length(cell) > 1) & cell.rlike(r"^[=+\-@\t\r]") & ~cell.rlike(r"^-?[\d.,]+$"), F.concat(F.lit("\t"), cell)).otherwise(cell)
    return F.when(cell.rlike(f'[{re.escape(delimiter)}"\r\n]'), F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def py_quoted(cell: str, delimiter: str) -> str:
    return '"' + cell.replace('"', '""') + '"' if re.search(f'[{re.escape(delimiter)}"\r\n]', cell) else cell


def escaped(c: Column, quotes: bool = False) -> Column:
    for a, b in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")][: 4 if quotes else 3]:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def xml_escaped(c: Column) -> Column:
    return F.regexp_replace(escaped(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def json_string(c: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def typed_or(cell: Column, kind: str, text: Column) -> Column:
    """A number or boolean as JSON writes it where the column's type says so and the cell agrees, else ``text``."""
    if kind in NUMERIC:
        return F.coalesce(S.number_text(S.parse_number(cell)), text)
    if kind == "boolean":
        low = F.lower(cell)
        return F.when(low.isin(JSON_TRUE), "true").when(low.isin(JSON_FALSE), "false").otherwise(text)
    return text


def json_value(cell: Column, kind: str) -> Column:
    return F.when(cell == "", F.lit("null")).otherwise(typed_or(cell, kind, json_string(cell)))


def xml_tag(name: str, i: int) -> str:
    return re.sub(r"^[^A-Za-z_]+", "", re.sub(r"[^\w.-]+", "_", name.strip(), flags=re.ASCII)) or f"field_{i + 1}"


def sql_name(name: str, dialect: str = "postgres") -> str:
    clean = re.sub(r"[^\w]+", "_", name, flags=re.ASCII).strip("_").lower() or "col"
    clean = f"c_{clean}" if clean[0].isdigit() else clean
    return f"`{clean}`" if dialect == "mysql" else f'"{clean}"'


def sql_type(kind: str, dialect: str = "postgres") -> str:
    if kind in NUMERIC:
        return "REAL" if dialect == "sqlite" else "NUMERIC"
    if kind == "boolean":
        return "TINYINT(1)" if dialect == "mysql" else "BOOLEAN"
    return "DATE" if kind == "date" else "TEXT"


def sql_value(cell: Column, kind: str, dialect: str = "postgres") -> Column:
    text = F.concat(F.lit("'"), F.replace(cell, F.lit("'"), F.lit("''")), F.lit("'"))
    if kind in NUMERIC:
        text = F.coalesce(S.number_text(S.parse_number(cell)), text)
    elif kind == "boolean":
        low = F.lower(cell)
        text = F.when(low.isin(SQL_TRUE), "1" if dialect == "mysql" else "TRUE").when(low.isin(SQL_FALSE), "0" if dialect == "mysql" else "FALSE").otherwise(text)
    return F.when(cell == "", F.lit("NULL")).otherwise(text)


def latex_escaped(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit(r"\textbackslash{}"))
    c = F.regexp_replace(c, r"([&%$#_{}])", r"\\$1")
    c = F.replace(F.replace(c, F.lit("~"), F.lit(r"\textasciitilde{}")), F.lit("^"), F.lit(r"\textasciicircum{}"))
    return F.replace(c, F.lit("\n"), F.lit(" "))


def py_latex(text: str) -> str:
    text = re.sub(r"([&%$#_{}])", r"\\\1", text.replace("\\", r"\textbackslash{}"))
    return text.replace("~", r"\textasciitilde{}").replace("^", r"\textasciicircum{}").replace("\n", " ")


def yaml_scalar(cell: Column, kind: str) -> Column:
    risky = cell.rlike(r"""^\s|\s$|[:#\-?{}\[\],&*!|>'"%@`]|^(?i:true|false|null|~|\d)""")
    text = F.when(cell.contains("\n"), F.concat(F.lit("|-\n    "), F.replace(cell, F.lit("\n"), F.lit("\n    ")))).when(risky, F.concat(F.lit("'"), F.replace(cell, F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(cell)
    return F.when(cell == "", F.lit("null")).otherwise(typed_or(cell, kind, text))


def padded(grid: Grid, shown: list[Column], names: list[str], right: list[bool], least: int, cut: bool) -> tuple[list[int], list[str], list[Column]]:
    """Widths of columns, headers and cells brought to them."""
    widths = grid.df.agg(*[F.max(F.length(c)).alias(f"w{i}") for i, c in enumerate(shown)]).first()  # one row
    w = [min(WIDEST, max(least, len(n), x or 0)) for n, x in zip(names, widths, strict=True)]
    cells = []
    for c, n, r in zip(shown, w, right, strict=True):
        long = F.substring(c, 1, n) if cut else c
        cells.append(F.when(F.length(c) >= n, long).otherwise(F.lpad(c, n, " ") if r else F.rpad(c, n, " ")))
    return w, [(x[:n] if cut else x).rjust(n) if r else (x[:n] if cut else x).ljust(n) for x, n, r in zip(names, w, right, strict=True)], cells


def record_keys(headers: tuple[str, ...]) -> list[tuple[str, int]]:
    """(key, column) of a record: of equal headers the last column counts, at the first one's place; whole numbers come first, in order."""
    last = {}
    for i, h in enumerate(headers):
        last[h] = i
    whole = lambda k: re.fullmatch(r"0|[1-9]\d*", k) and int(k) < 2**32 - 1
    return sorted([x for x in last.items() if whole(x[0])], key=lambda x: int(x[0])) + [x for x in last.items() if not whole(x[0])]


def lines_of(
    grid: Grid, fmt: str, types: tuple[str, ...] | None = None, delimiter: str = ",", newline: str = "\r\n", include_headers: bool = True, guard_formulas: bool = True, typed: bool = True, indent: int = 2,
    table: str = "data", dialect: str = "postgres", root: str = "table", row: str = "row", align: bool = True, pad: bool = True, full: bool = True, styled: bool = True,
) -> Lines:
    """A grid in a text format. An unknown format gives CSV."""
    cols, types = [F.col(c) for c in grid.columns], types or ("text",) * len(grid.columns)
    h = list(grid.headers)
    right = [t in NUMERIC for t in types]
    if fmt in ("json", "jsonl"):
        value = lambda i: json_value(cols[i], types[i]) if typed or fmt == "jsonl" else json_string(cols[i])
        gap = ":" if fmt == "jsonl" or not indent else ": "
        body = [F.concat(F.lit(json.dumps(k, ensure_ascii=False) + gap), value(i)) for k, i in record_keys(grid.headers)]
        if fmt == "jsonl":
            return Lines("", line_df(grid, F.concat(F.lit("{"), F.concat_ws(",", *body), F.lit("}"))), empty="\n")
        one, two = " " * indent, " " * 2 * indent
        return Lines("[\n", line_df(grid, F.concat(F.lit(f"{one}{{\n{two}"), F.concat_ws(f",\n{two}", *body), F.lit(f"\n{one}}}"))), "]", ",", empty="[]", ends=False)
    if fmt == "json-arrays":
        one, two = " " * indent, " " * 2 * indent
        head = f"{one}[\n{two}" + f",\n{two}".join(json.dumps(x, ensure_ascii=False) for x in h) + f"\n{one}]"
        rows = line_df(grid, F.concat(F.lit(f"{one}[\n{two}"), F.concat_ws(f",\n{two}", *[json_string(c) for c in cols]), F.lit(f"\n{one}]")))
        return Lines(f"[\n{head},\n" if include_headers else "[\n", rows, "]", ",", empty=f"[\n{head}\n]" if include_headers else "[]", ends=False)
    if fmt == "xml":
        parts = [F.concat(F.lit(f"    <{xml_tag(n, i)}>"), xml_escaped(typed_or(c, t, c)), F.lit(f"</{xml_tag(n, i)}>")) for i, (n, c, t) in enumerate(zip(h, cols, types, strict=True))]
        return Lines(f'<?xml version="1.0" encoding="UTF-8"?>\n<{root}>\n', line_df(grid, F.concat(F.lit(f"  <{row}>\n"), F.concat_ws("\n", *parts), F.lit(f"\n  </{row}>"))), f"</{root}>\n", ends=False)
    if fmt == "html":
        esc = lambda x: escape(x, {'"': "&quot;"})
        head = "".join(f"<th>{esc(x)}</th>" for x in h)
        caption = f"<caption>{esc(grid.caption)}</caption>\n" if grid.caption else ""
        page = f'<!doctype html>\n<meta charset="utf-8">\n<title>{esc(grid.caption or "Table")}</title>\n{STYLE if styled else ""}' if full else ""
        body = line_df(grid, F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *[escaped(c, quotes=True) for c in cols]), F.lit("</td></tr>")))
        head, foot = f"{page}<table>\n{caption}<thead>\n<tr>{head}</tr>\n</thead>\n<tbody>\n", "</tbody>\n</table>" + ("\n" if full else "")
        return Lines(head, body, foot, empty=f"{head}\n{foot}", ends=False)
    if fmt == "sql":
        names, name = [sql_name(n, dialect) for n in h], sql_name(table, dialect)
        head = f"CREATE TABLE {name} (\n" + ",\n".join(f"  {n} {sql_type(t, dialect)}" for n, t in zip(names, types, strict=True)) + "\n);\n\n"
        into = F.lit(f"INSERT INTO {name} ({', '.join(names)}) VALUES\n")
        line = F.concat(F.lit("  ("), F.concat_ws(", ", *[sql_value(c, t, dialect) for c, t in zip(cols, types, strict=True)]), F.lit(")"))
        df, total = numbered(grid.df)
        last = (F.col("_n") % BATCH == BATCH - 1) | (F.col("_n") == total - 1)
        rows = df.select(POS, F.concat(F.when(F.col("_n") % BATCH == 0, into).otherwise(""), line, F.when(last, ";\n").otherwise(",")).alias("line"))
        return Lines(head, rows, ends=False, empty=head[:-1])
    if fmt == "yaml":
        key = lambda x: x if re.fullmatch(r"[\w.-]+", x, re.ASCII) else "'" + x.replace("'", "''") + "'"
        body = [F.concat(F.lit(f"{key(n)}: "), yaml_scalar(c, t)) for n, c, t in zip(h, cols, types, strict=True)]
        return Lines("", line_df(grid, F.concat(F.lit("- "), F.concat_ws("\n  ", *body))), empty="\n")
    if fmt == "latex":
        head = " & ".join(rf"\textbf{{{py_latex(x)}}}" for x in h)
        spec = "".join("r" if r else "l" for r in right)
        return Lines(f"\\begin{{tabular}}{{{spec}}}\n\\hline\n{head} \\\\\n\\hline\n", line_df(grid, F.concat(F.concat_ws(" & ", *[latex_escaped(c) for c in cols]), F.lit(r" \\"))), "\\hline\n\\end{tabular}", ends=False)
    if fmt == "markdown":
        shown = [F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>")) for c in cols]
        names = [n.replace("|", "\\|").replace("\n", "<br>") for n in h]
        w = [3] * len(h)
        if pad:
            w, names, shown = padded(grid, shown, names, right, 3, cut=False)
        rule = " | ".join("-" * (n - 1) + (":" if r and align else "-") for n, r in zip(w, right, strict=True))
        return Lines(f"| {' | '.join(names)} |\n| {rule} |\n", line_df(grid, F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |"))))
    if fmt == "text":
        w, names, shown = padded(grid, [F.replace(c, F.lit("\n"), F.lit(" ")) for c in cols], [n.replace("\n", " ") for n in h], right, 0, cut=True)
        return Lines("  ".join(names).rstrip() + "\n" + "  ".join("-" * n for n in w) + "\n", line_df(grid, F.rtrim(F.concat_ws("  ", *shown))))
    d = "\t" if fmt == "tsv" else delimiter
    head = d.join(py_quoted(x, d) for x in h) + newline if include_headers and h else ""
    return Lines(head, line_df(grid, F.concat_ws(d, *[quoted(c, d, guard_formulas) for c in cols])), newline=newline, empty=head.removesuffix(newline), ends=False)


def line_df(grid: Grid, line: Column) -> DataFrame:
    return grid.df.select(POS, line.alias("line"))


def write_grid(grid: Grid, path: str, fmt: str = "csv", types: tuple[str, ...] | None = None, bom: bool = False, one_file: bool = False, **options) -> None:
    """Writes a folder of text parts in order, which put one behind the other are the whole text. xlsx is one file.

    ``bom`` puts a byte-order mark before CSV, which some spreadsheets need to read it as UTF-8. With ``one_file`` the folder holds
    one part, which is put together out of those that many tasks have written.
    """
    if fmt == "xlsx":
        return write_workbook(grid, path, types, **options)
    out = lines_of(grid, fmt, types, **options)
    last = out.rows.agg(F.max(POS)).first()[0]  # one row
    head, foot = (BOM if bom and fmt == "csv" else "") + out.head, out.foot
    line = F.concat("line", F.when(F.col(POS) == last, "").otherwise(out.between)) if out.between else F.col("line")
    framed = out.rows.select(F.lit(0).alias("part"), POS, line.alias("line"))
    if last is None:
        head, foot = (BOM if bom and fmt == "csv" else "") + (out.empty if out.empty is not None else head + foot), ""
    spark = grid.df.sparkSession
    for part, text in ((-1, head), (1, foot)):
        if text:  # the writer ends each line
            framed = framed.union(spark.createDataFrame([(part, 0, text.removesuffix(out.newline))], "part int, _pos long, line string"))
    ordered = framed.orderBy("part", POS).select("line")
    if not one_file:
        return ordered.write.mode("overwrite").option("lineSep", out.newline).text(path)
    parts = new_path(spark, "parts")
    ordered.write.option("lineSep", out.newline).text(parts)
    old = spark._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    put_together(spark, parts, f"{path}/part-00000.txt")


def to_string(grid: Grid, fmt: str, types: tuple[str, ...] | None = None, **options) -> str:
    """The whole text, for results that fit on the driver."""
    out = lines_of(grid, fmt, types, **options)
    body = [r["line"] for r in out.rows.orderBy(POS).collect()]
    if not body:
        return out.empty if out.empty is not None else out.head + out.foot
    text = out.head + (out.between + out.newline).join(body)
    return text + (out.newline + out.foot if out.foot else out.newline if out.ends else "")


def suggested_filename(title: str, fmt: str, on: date | None = None) -> str:
    stem = re.sub(r"-+", "-", re.sub(r"\s+", "-", re.sub(r"[^\w\s-]", "", title.lower(), flags=re.ASCII)))
    stem = re.sub(r"^-|-$", "", stem)[:60] or "table"
    return f"{stem}-{(on or date.today()).isoformat()}.{FORMATS.get(fmt, FORMATS['csv'])[0]}"


def media_type(fmt: str) -> str:
    return FORMATS.get(fmt, FORMATS["csv"])[1]


def clipboard(grid: Grid, fmt: str, types: tuple[str, ...] | None = None, **options) -> dict[str, str]:
    """What a copy puts on the clipboard, by media type: the text, and for delimited and plain text an HTML table too. A workbook cannot be copied."""
    if fmt == "xlsx":
        raise ValueError("a workbook cannot be copied as text")
    found = {"text/plain": to_string(grid, fmt, types, **options)}
    if fmt in ("csv", "tsv", "text"):
        found["text/html"] = to_string(grid, "html", types, full=False)
    return found
