"""Reading grids: a sample on the driver decides format, header and width; executors parse."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import POS, Grid, unique_names
from ..shared import head_of, kept
from .html import plain_row, plain_table
from .ranges import Delimited, JsonList, by_range, records, sizes_of, split_records, units_of
from .text import detect_format, is_header, is_rule, markdown_cells, padded, parse_text, sniff_delimiter, split_delimited

CELLS = "id long, fmt string, header boolean, r int, cells array<string>, error string"
#: Where Spark's reader puts a record that is not as long as the schema.
BROKEN = "_broken"
#: Characters of a line that tell a format.
HEAD = 1 << 16
#: Bytes of a JSON list or a Markdown file from which many tasks read it: parsed whole, it takes many times as much.
WHOLE = 16 << 20
#: The same of an HTML file: a tree takes some 45 times as much.
WHOLE_PAGE = 4 << 20
#: Rows at the begin of an HTML table that are parsed together, the first half of which may be of any form.
FIRST = 6
#: Columns that the keys of JSON Lines may make.
MAX_KEYS = 10_000


def table_rows(blobs: DataFrame, id_col: str, text_col: str, fmt: str = "auto", has_header: bool | None = None) -> DataFrame:
    """(id, fmt, header, r, cells, error): the rows of the table in each text, its headers as row -1. Texts are parsed side by side.

    A text that cannot be parsed gives one row with header true, no cells and what is wrong in error, which is null elsewhere.
    """

    def run(batches):
        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    table, used = parse_text(text or "", fmt, has_header)
                except ValueError as e:
                    out.append((i, fmt, True, -1, [], str(e)))
                    continue
                out.append((i, used, True, -1, table.headers, None))
                out += [(i, used, False, r, row, None) for r, row in enumerate(table.rows)]
            if out:
                types = [pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.list_(pa.string()), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], ["id", "fmt", "header", "r", "cells", "error"])

    return blobs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, CELLS)


def read_text(spark: SparkSession, text: str, fmt: str = "auto", has_header: bool | None = None) -> Grid:
    """A grid of pasted text."""
    table, _ = parse_text(text, fmt, has_header)
    width = len(table.headers)
    rows = [(i, *r[:width], *[""] * (width - len(r))) for i, r in enumerate(table.rows)]
    schema = ", ".join([f"{POS} long", *[f"c{i} string" for i in range(width)]])
    return Grid(spark.createDataFrame(rows, schema), tuple(table.headers), tuple(range(width)), table.caption)


def first_lines(spark: SparkSession, path: str, n: int = 50) -> list[str]:
    """The first lines of files in the order of their paths, HEAD characters of each; Spark's own order is that of sizes."""
    # each file that is not empty has a line
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path").orderBy("path").limit(n).collect()
    out: list[str] = []
    for r in files:
        if len(out) < n:
            plain = re.sub(r"([\\*?\[\]{}])", r"\\\1", r.path)  # signs that would be read as a pattern of paths
            out += [x[0] for x in spark.read.text(plain).select(F.left("value", F.lit(HEAD))).limit(n - len(out)).collect()]
    return out


def widest(df: DataFrame, last: str) -> int:
    """Cells of the longest record, or 0 if some record has more than there are columns."""
    names = [c for c in df.columns if c != BROKEN]
    # a record that is not as long as the schema is marked as broken; one that fills it all the same is longer
    seen = df.agg(F.max(F.col(BROKEN).isNotNull() & F.col(last).isNotNull()).alias("more"), F.max(F.greatest(*[F.when(F.col(c).isNotNull(), i).otherwise(0) for i, c in enumerate(names, 1)], F.lit(0))).alias("n")).first()
    return 0 if seen["more"] else seen["n"] or 0


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, header: bool | None = None, multi_line: bool | None = None) -> Grid:
    """A grid of delimited files of any size, by Spark's reader; a first piece tells the delimiter and, unless given, whether there is a header.

    Columns are as many as the widest record has cells; shorter ones are filled up, blank ones go. Files are split among tasks, also
    where quotes hold newlines (``multi_line``, which is looked for unless it is given): each task then finds out in what state it
    leaves its range. The order is that of paths and of places within them.
    """
    lines = spark.read.text(path)
    head = "\n".join(first_lines(spark, path)).removeprefix("\ufeff")
    delimiter = delimiter or ("\t" if detect_format(head) == "tsv" else sniff_delimiter(head))
    if multi_line is None:
        multi_line = not lines.where((F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2 == 1).isEmpty()
    if multi_line:
        return scanned(kept(split_records(records(spark, path, Delimited(delimiter)), delimiter), "records"), header)
    sample = split_delimited(head, delimiter)
    if header is None:
        header = len(sample) > 1 and is_header(padded(sample)[0])
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN, "nullValue": "\x00", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    width, n = 0, max(1, max(map(len, sample), default=1)) + 1
    while not width:
        names = [f"c{i}" for i in range(n)]
        df = spark.read.schema(", ".join([*(f"{c} string" for c in names), f"{BROKEN} string"])).csv(path, **options)
        width = widest(df, names[-1])
        if not width and df.select("c0").isEmpty():
            return Grid(spark.createDataFrame([], f"{POS} long"), (), ())
        n *= 2
    names = names[:width]
    cells = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in names]
    place = df.select(F.struct("_metadata.file_path", "_metadata.file_block_start").alias("_file"), F.monotonically_increasing_id().alias(POS), *cells)
    if len(df.inputFiles()) > 1:
        place = place.orderBy("_file", POS).withColumn(POS, F.monotonically_increasing_id())
    rows = place.drop("_file").where(F.exists(F.array(*names), lambda x: F.trim(x) != ""))
    top = rows.orderBy(POS).limit(1).first() if width else None
    labels = [top[c] for c in names] if top else []
    if labels:
        labels[0] = labels[0].removeprefix("\ufeff")
        rows = rows.where(F.col(POS) > top[POS]) if header else rows.withColumn("c0", F.when(F.col(POS) == top[POS], F.ltrim("c0", F.lit("\ufeff"))).otherwise(F.col("c0")))
    return Grid(rows.select(POS, *names), tuple(unique_names(labels if header else [""] * width)), tuple(range(width)))


def scanned(rows: DataFrame, header: bool | None) -> Grid:
    """A grid of records with cells, in the order of paths, ranges and places in them; the header is looked for unless it is known."""
    spark = rows.sparkSession
    width = rows.agg(F.max(F.size("cells"))).first()[0]  # one row
    if not width:
        return Grid(spark.createDataFrame([], f"{POS} long"), (), ())
    cells = [F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(f"c{i}") for i in range(width)]
    found = rows.select("file_path", "block", "n", *cells).orderBy("file_path", "block", "n").limit(2).collect()
    top = [list(r)[3:] for r in found]
    if header is None:
        header = len(top) > 1 and is_header(top[0])
    if header:  # told by its place: positions are not the same in every plan
        rows = rows.where(~((F.col("file_path") == found[0].file_path) & (F.col("block") == found[0].block) & (F.col("n") == found[0].n)))
    ordered = rows.orderBy("file_path", "block", "n").select(F.monotonically_increasing_id().alias(POS), *cells)
    return Grid(ordered, tuple(unique_names(top[0] if header else [""] * width)), tuple(range(width)))


def read_json(spark: SparkSession, path: str, head: str, has_header: bool | None = None) -> Grid:
    """A grid of files with a JSON list each, which any number of tasks read: an element is found by its depth. Lists of records or of rows."""
    start = JsonList().opened(head)
    opening = head[start:].lstrip()[:1] if start else ""
    if opening not in ("{", "["):
        raise ValueError("that JSON is not a list of records or rows")
    found = kept(records(spark, path, JsonList("}" if opening == "{" else "]")).where("text <> ''"), "records")
    if not found.where(F.try_parse_json("text").isNull()).isEmpty():
        raise ValueError("an element is not JSON")
    if opening == "[":
        return scanned(found.select("file_path", "block", (F.col("n") * (1 << 20) + F.col("k")).alias("n"), F.transform(F.from_json("text", "array<string>"), lambda x: F.coalesce(x, F.lit(""))).alias("cells")), has_header)
    placed = found.orderBy("file_path", "block", "n", "k").select(F.monotonically_increasing_id().alias("_at"), "text")
    df, keys = json_records(placed, "text", "_at")
    return Grid(df, tuple(unique_names(keys)), tuple(range(len(keys))))


def sampled_format(head: str) -> str:
    """The format that the first lines of a file tell; JSON that goes on beyond them counts by how it begins."""
    found = detect_format(head)
    return "json" if found in ("csv", "tsv") and head.lstrip("\ufeff \t\n")[:1] in ("[", "{") else found


def read_grid(spark: SparkSession, path: str, fmt: str = "auto", has_header: bool | None = None, delimiter: str | None = None, whole_json: int | None = None) -> Grid:
    """A grid of files in any format that texts may have; ``auto`` tells it by the first lines.

    Delimited files and JSON Lines may have any size, and so may JSON lists, which many tasks read where a file is larger than
    ``whole_json`` bytes (or WHOLE, or spark.sql.files.maxPartitionBytes if that is less), one large Markdown file, and one large HTML file
    that is one table of plain rows. Other Markdown, HTML and JSON is parsed a file at a time, by one task each; of several files with one table each the rows follow one another in the order of paths, under the first one's headers.
    """
    if fmt == "auto":
        fmt = sampled_format("\n".join(first_lines(spark, path)))
    if fmt in ("csv", "tsv"):
        return read_delimited(spark, path, "\t" if fmt == "tsv" else delimiter, has_header)
    if fmt == "jsonl":
        lines = spark.read.text(path).select(F.struct("_metadata.file_path", "_metadata.file_block_start").alias("_file"), F.monotonically_increasing_id().alias("_at"), "value").where(F.trim("value") != "")
        lines = lines.orderBy("_file", "_at").withColumn("_at", F.monotonically_increasing_id())
        if not lines.where(F.try_parse_json("value").isNull()).isEmpty():
            raise ValueError("a line is not JSON")
        first = lines.orderBy("_at").select("value").first()
        if first and first[0].strip()[:1] == "[":  # rows, not records
            cells = F.transform(F.from_json("value", "array<string>"), lambda x: F.coalesce(x, F.lit("")))
            return scanned(lines.select(F.lit("").alias("file_path"), F.lit(0).alias("block"), F.col("_at").alias("n"), cells.alias("cells")), has_header)
        df, keys = json_records(lines, "value", "_at")
        if not keys:  # scalars are one column
            return Grid(lines.select(F.col("_at").alias(POS), F.coalesce(F.try_parse_json("value").try_cast("string"), F.lit("")).alias("c0")), ("Column 1",), (0,)) if first else Grid(df, (), ())
        return Grid(df, tuple(unique_names(keys)), tuple(range(len(keys))))
    if fmt == "json":
        most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
        size = sizes_of(spark, path)
        if size > (min(WHOLE, most) if whole_json is None else whole_json):
            head = head_of(spark, path, HEAD)
            start = JsonList().opened(head)
            # one record, or a list of something else, is parsed whole as long as a task may take it
            if whole_json is not None or size > most or (start and head[start:].lstrip()[:1] in ("{", "[")):
                return read_json(spark, path, head, has_header)
    if fmt == "markdown" and sizes_of(spark, path) > WHOLE and spark.read.format("binaryFile").load(path).where("length > 0").count() == 1 and (grid := read_markdown(spark, path)):
        return grid
    if fmt == "html" and sizes_of(spark, path) > WHOLE_PAGE and spark.read.format("binaryFile").load(path).where("length > 0").count() == 1 and (grid := read_html(spark, path)):
        return grid
    texts = spark.read.text(path, wholetext=True).select("_metadata.file_path", "value").orderBy("file_path").select(F.monotonically_increasing_id().alias("id"), "value")
    rows = table_rows(texts, "id", "value", fmt, has_header)
    told = rows.where("header").orderBy("id").collect()  # one row a file
    for r in told:
        if r["error"]:
            raise ValueError(r["error"])
    headers = next((r["cells"] for r in told), [])
    width = max((len(r["cells"]) for r in told), default=0)
    headers = unique_names([*headers, *[""] * (width - len(headers))])
    cells = [F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(f"c{i}") for i in range(width)]
    out = rows.where("not header").select(F.monotonically_increasing_id().alias(POS), "id", "r", *cells).orderBy("id", "r")
    return Grid(out.select(F.monotonically_increasing_id().alias(POS), *[f"c{i}" for i in range(width)]), tuple(headers), tuple(range(width)))


def read_markdown(spark: SparkSession, path: str) -> Grid | None:
    """A grid of one large Markdown file, whose lines are read by many tasks; None if its first lines have no header above a rule."""
    top = [x for line in first_lines(spark, path) for x in map(str.strip, line.splitlines()) if "|" in x]
    rule = next((i for i, x in enumerate(top) if is_rule(x)), 0)
    if not rule or len(top[rule - 1]) >= HEAD:  # a rule on the first line is above no row
        return None

    def run(batches):
        n, key = 0, None
        for batch in batches:
            out = []
            for block, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block != key:
                    n, key = 0, block
                for x in map(str.strip, line.splitlines()):
                    if "|" in x:
                        out.append((block, n, None if is_rule(x) else markdown_cells(x)))
                        n += 1
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.string())), strict=True)], ["block", "n", "cells"])

    lines = spark.read.text(path).select(F.col("_metadata.file_block_start").alias("block"), "value").where(F.contains("value", F.lit("|")))
    rows = kept(lines.mapInArrow(run, "block long, n long, cells array<string>"), "lines").where("cells is not null")
    width = rows.agg(F.max(F.size("cells"))).first()[0]  # one row
    header = markdown_cells(top[rule - 1])
    rows = rows.where(~((F.col("block") == 0) & (F.col("n") == rule - 1))).orderBy("block", "n")
    cells = [F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(f"c{i}") for i in range(width)]
    return Grid(rows.select(F.monotonically_increasing_id().alias(POS), *cells), tuple(unique_names(header + [""] * (width - len(header)))), tuple(range(width)))


def read_html(spark: SparkSession, path: str) -> Grid | None:
    """A grid of one large HTML file whose one table has plain rows but for the first ones, read by many tasks; None if it is of another form."""

    def run(batches):
        key, n, rows = None, 0, []

        def flushed():
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string()), strict=True)], ["block", "n", "cells", "other"])

        for found, unit in by_range(batches):
            if found != key:
                key, n = found, 0
            cells = plain_row(unit)
            first = found[1] == 0 and n < FIRST
            rows.append((found[1], n, cells, unit[:HEAD] if first or cells is None else None))
            n += 1
            if len(rows) >= 4096:
                yield flushed()
        yield flushed()

    rows = kept(units_of(spark, path, "</tr>").mapInArrow(run, "block long, n long, cells array<string>, other string"), "rows")
    told = rows.where("other is not null").orderBy("block", "n").limit(FIRST + 2).collect()
    first, rest = told[:FIRST], told[FIRST:]
    if len(first) < FIRST or first[-1].block or first[-1].n != FIRST - 1 or len(rest) > 1 or any(len(r.other) >= HEAD for r in told):
        return None
    # one row
    seen = rows.agg(F.max(F.struct("block", "n")).alias("last"), F.max(F.size("cells")).alias("width")).first()
    if rest and (rest[0].block, rest[0].n) != tuple(seen["last"]):
        return None
    table = plain_table([r.other for r in first], rest[0].other if rest else "")
    width = len(table.headers) if table else 0
    if not table or seen["width"] > width:
        return None
    schema = rows.select("block", "n", "cells").schema
    top = spark.createDataFrame([(-1, i, r) for i, r in enumerate(table.rows)], schema)
    body = rows.where(F.col("cells").isNotNull() & ((F.col("block") > 0) | (F.col("n") >= FIRST)) & F.exists("cells", lambda c: c != "")).select("block", "n", "cells")
    cells = [F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(f"c{i}") for i in range(width)]
    ordered = top.unionAll(body).orderBy("block", "n")
    return Grid(ordered.select(F.monotonically_increasing_id().alias(POS), *cells), tuple(table.headers), tuple(range(width)))


def json_records(lines: DataFrame, text_col: str, order_col: str) -> tuple[DataFrame, list[str]]:
    """Records of JSON objects as grid rows; the columns are the union of keys as first seen, by one aggregation over the keys.

    More than MAX_KEYS distinct keys raise an error: a grid has a column for each.
    """
    keyed = lines.select(order_col, F.posexplode(F.json_object_keys(text_col)).alias("at", "key"))
    keys = [r["key"] for r in keyed.groupBy("key").agg(F.min(F.struct(order_col, "at")).alias("first")).orderBy("first").limit(MAX_KEYS + 1).collect()]
    if len(keys) > MAX_KEYS:
        raise ValueError(f"more than {MAX_KEYS} distinct keys")
    record = F.from_json(F.col(text_col), "map<string,string>")
    out = lines.select(F.col(order_col).cast("long").alias(POS), record.alias("m"))
    return out.select(POS, *[F.coalesce(F.element_at("m", F.lit(k)), F.lit("")).alias(f"c{i}") for i, k in enumerate(keys)]), keys
