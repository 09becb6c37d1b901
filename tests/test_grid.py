"""Parsing, clean-up, sinks and captures on literal cases."""

import io
import os
import random
import re
import json
import zipfile
import zlib
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridloom import sinks
from gridloom.functions import scalar as S
from gridloom.grid import POS, bucketed, from_dataframe, numbered, numbered_in_ranges, unique_names
from gridloom.plans.pipeline import apply_spec
from gridloom.plans.spec import GridSpec, Replace, Sort, unsafe_pattern
from gridloom.sources import reader
from gridloom.sources.html import BLANK, MARK, Options, find_tables, largest_table
from gridloom.sources.reader import read_text
from gridloom.sources.text import detect_format, parse_text, sniff_delimiter
from gridloom.operators.combine import merge_tables
from gridloom.operators.region import rebuild, synthesised
from gridloom.streaming.capture import accumulate, accumulated, grown


def cells(grid):
    return [list(r) for r in grid.preview()]


def test_delimited_hazards():
    t, fmt = parse_text('name,note\n"a, ""b""","two\nlines"\n\nc,d\n')
    assert fmt == "csv" and t.headers == ["name", "note"] and t.rows == [['a, "b"', "two\nlines"], ["c", "d"]]
    assert sniff_delimiter("a;b;c\n1;2;3") == ";"
    assert parse_text("")[0].rows == []


def test_json_union_and_envelope():
    t, _ = parse_text('{"data":[{"a":1,"b":null},{"b":true,"c":{"x":[1]}}]}')
    assert t.headers == ["a", "b", "c"] and t.rows == [["1", "", ""], ["", "true", '{"x":[1]}']]
    with pytest.raises(ValueError):
        parse_text('{"a":1}\nnot json', "jsonl")


def test_json_lines_with_too_many_keys_raise(spark, monkeypatch):
    lines = lambda n: spark.createDataFrame([(i, f'{{"k{i}": {i}}}') for i in range(n)], "n long, line string")
    with pytest.raises(ValueError):
        reader.json_records(lines(10_001), "line", "n")
    monkeypatch.setattr(reader, "MAX_KEYS", 3)
    assert reader.json_records(lines(3), "line", "n")[1] == ["k0", "k1", "k2"]
    with pytest.raises(ValueError):
        reader.json_records(lines(4), "line", "n")


def test_markdown_pipes():
    t, _ = parse_text("| Name | Qty |\n|---|--:|\n| Bolt \\| big | 2 |\n| Nut | 3 |")
    assert t.rows == [["Bolt | big", "2"], ["Nut", "3"]]
    assert detect_format('{"a":1}\n{"a":2}') == "jsonl"


SPANS = "<table><caption>Cap</caption><tr><th colspan=2>Region<th>Total</tr><tr><th>Country<th>City<th>Sales</tr><tr><td rowspan=2>UK<td>London<td>1</tr><tr><td>Leeds<td>2</tr></table>"


def test_html_spans():
    t = largest_table(SPANS)
    assert t.headers == ["Region – Country", "Region – City", "Total – Sales"] and t.rows == [["UK", "London", "1"], ["UK", "Leeds", "2"]]
    assert t.caption == "Cap" and t.has_merges
    assert largest_table(SPANS, Options(span_policy=BLANK)).rows[1][0] == ""
    assert largest_table(SPANS, Options(span_policy=MARK)).rows[1][0] == "↳"


def test_box_grid_and_prose():
    row = "<div class='r'><span>{}</span><span>{}</span></div>"
    page = "<div>" + row.format("Name", "Qty") + row.format("a", 1) + row.format("b", 2) + "</div>"
    assert find_tables(page)[0].rows == [["a", "1"], ["b", "2"]]
    assert find_tables("<div><p>one</p><p>two</p></div>") == []


def test_region_rows_and_gaps():
    item = lambda t, left, top: {"text": t, "left": left, "top": top, "right": left + 40, "bottom": top + 10}
    got, share = synthesised([item("a", 0, 0), item("b", 100, 1), item("c", 200, 0), item("a2", 0, 20), item("c2", 200, 21)])
    assert got == [["a", "b", "c"], ["a2", "", "c2"]] and round(share, 2) == 0.83


def test_spec_steps(spark):
    g = read_text(spark, "a,b,c\n1,x,\n1,x,\n3,,z\n,,\n2,y,w", "csv", True)
    assert cells(apply_spec(g, GridSpec(dedupe=True))) == [["1", "x", ""], ["3", "", "z"], ["2", "y", "w"]]
    assert cells(apply_spec(g, GridSpec(sort=Sort(0, "desc")))) == [["3", "", "z"], ["2", "y", "w"], ["1", "x", ""], ["1", "x", ""]]
    assert cells(apply_spec(g, GridSpec(hidden=frozenset({0}), search="Z"))) == [["", "z"]]
    assert cells(apply_spec(g, GridSpec(fill_down=(1,))))[2] == ["3", "x", "z"]
    t = apply_spec(g, GridSpec(transpose=True, dedupe=True))
    assert t.headers == ("a", "1", "3", "2") and cells(t) == [["b", "x", "", "y"], ["c", "", "z", "w"]]
    spec = GridSpec(renames={1: "B"}, sort=Sort(1), replace=Replace("x", "y"), hidden=frozenset({2}))
    assert GridSpec.from_json(spec.to_json()) == spec


def test_natural_order_and_blanks_last(spark):
    g = read_text(spark, "k,v\nitem 10,1\nItem 9,2\n,3\nitem 2,4", "csv", True)
    assert [r[0] for r in cells(apply_spec(g, GridSpec(sort=Sort(0))))] == ["item 2", "Item 9", "item 10", ""]
    assert [r[0] for r in cells(apply_spec(g, GridSpec(sort=Sort(0, "desc"))))] == ["item 10", "Item 9", "item 2", ""]


def test_patterns_are_gated(spark):
    assert unsafe_pattern("(a+)+$", spark) and unsafe_pattern("[", spark) and unsafe_pattern("(a*)*(a*)*(a*)*b", spark)
    assert not any(unsafe_pattern(p, spark) for p in (r"(\d+)-(x)", "(foo|bar)+", r"\p{L}+"))
    g = read_text(spark, "a,b\n1.5,125", "csv", True)
    assert cells(apply_spec(g, GridSpec(replace=Replace("1.5", "z")))) == [["z", "125"]]
    out = apply_spec(g, GridSpec(replace=Replace("(a+)+$", "z", regex=True)))
    assert out.pattern_error and cells(out) == [["1.5", "125"]]


def test_guarded_export_and_workbook(spark):
    g = read_text(spark, 'a,n\n=1+1,2\n"x, ""y""",-3', "csv", True)
    assert sinks.to_string(g, "csv") == 'a,n\r\n\t=1+1,2\r\n"x, ""y""",-3'
    assert '"n": 2' in sinks.to_string(g, "json", ("text", "number"))
    assert "\\textbackslash\\{\\}" in sinks.to_string(read_text(spark, "a,b\n\\,1", "csv", True), "latex")
    book = zipfile.ZipFile(io.BytesIO(sinks.xlsx(g, ("text", "number"))))
    assert '<c r="B3" t="n"><v>-3</v></c>' in book.read("xl/worksheets/sheet1.xml").decode()
    assert sinks.suggested_filename("  Größe: My (Table)!", "markdown", date(2024, 1, 2)) == "gre-my-table-2024-01-02.md"
    assert set(sinks.clipboard(g, "csv")) == {"text/plain", "text/html"} and sinks.media_type("jsonl") == "application/x-ndjson"
    with pytest.raises(ValueError):
        sinks.clipboard(g, "xlsx")


def test_workbooks_are_put_together_from_parts(spark, tmp_path):
    from xml.etree import ElementTree

    from gridloom import workbook

    a, b = b"some bytes", bytes(range(256)) * 40
    assert workbook.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b) and workbook.joined_crc(zlib.crc32(a), 0, 0) == zlib.crc32(a)
    df = spark.range(503).selectExpr("id", "concat('$', id, '.50') as price", "if(id % 5 = 0, '', concat('<é&\"> ', char(id % 32), id)) as note").repartition(6)
    g = from_dataframe(df, "id", ["price", "note"], ["price", "a <note>"])
    sinks.write_grid(g, str(tmp_path / "a.xlsx"), "xlsx", ("currency", "text"), most_rows=101, title="All: rows")
    book, got, space = zipfile.ZipFile(tmp_path / "a.xlsx"), [], {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    assert book.testzip() is None and len([n for n in book.namelist() if "worksheets" in n]) == 6
    assert [x.get("name") for x in ElementTree.fromstring(book.read("xl/workbook.xml")).iterfind(".//m:sheet", space)] == ["All rows", *[f"All rows {i}" for i in range(2, 7)]]
    for i in range(1, 7):
        rows = list(ElementTree.fromstring(book.read(f"xl/worksheets/sheet{i}.xml")).iterfind(".//m:row", space))
        assert [int(r.get("r")) for r in rows] == list(range(1, len(rows) + 1)) and ["".join(c.itertext()) for c in rows[0]] == ["price", "a <note>"]
        got += [["".join(c.itertext()) for c in r] for r in rows[1:]]
    bare = lambda i: "".join(c for c in chr(i % 32) if c in "\t\n\r" or c >= " ").replace("\r", "\n")
    assert got == [[f"{i}.5", *([f'<é&"> {bare(i)}{i}'] if i % 5 else [])] for i in range(503)]
    sinks.write_grid(g.with_df(g.df.limit(0)), str(tmp_path / "b.xlsx"), "xlsx")
    assert zipfile.ZipFile(tmp_path / "b.xlsx").testzip() is None
    assert zipfile.ZipFile(io.BytesIO(sinks.xlsx(g, ("currency", "text")))).read("xl/worksheets/sheet1.xml").decode().count("<row ") == 504


def written(grid, path, fmt, **options):
    """The parts of a written folder, one behind the other."""
    sinks.write_grid(grid, path, fmt, ("number", "text"), **options)
    return b"".join(p.read_bytes() for p in sorted(Path(path).glob("part-*"))).decode()


@pytest.mark.parametrize("fmt", ["csv", "tsv", "json", "json-arrays", "jsonl", "xml", "markdown", "html", "sql", "yaml", "latex", "text", "no such format"])
def test_written_parts_are_the_text(spark, tmp_path, fmt):
    g = from_dataframe(spark.range(1203).selectExpr("id", "id as k", "concat('a\n|', id) as t").repartition(5), "id", ["k", "t"])
    text = sinks.to_string(g, fmt, ("number", "text"))
    assert written(g, str(tmp_path / "a"), fmt).rstrip("\r\n") == text.rstrip("\n")
    if fmt.startswith("json"):
        assert len([json.loads(x) for x in text.splitlines()] if fmt == "jsonl" else json.loads(text)) == 1203 + (fmt == "json-arrays")
    if fmt == "sql":
        assert text.count("INSERT") == 3 and text.count(";") == 4
    none = g.with_df(g.df.limit(0))
    assert written(none, str(tmp_path / "b"), fmt).rstrip("\r\n") == sinks.to_string(none, fmt, ("number", "text")).rstrip("\r\n")
    if fmt == "csv":
        assert written(g, str(tmp_path / "c"), fmt, bom=True).startswith("\ufeffk,t\r\n") and written(g, str(tmp_path / "d"), fmt, include_headers=False).startswith("0,")


def test_large_numbers_do_not_crash(spark):
    g = from_dataframe(spark.createDataFrame([(1, 1e30), (2, 1.2e-13), (3, float("nan"))], "k int, x double"), "k")
    assert [r[1] for r in cells(g)] == ["1e+30", "1.2e-13", "NaN"]
    assert [r[1] for r in cells(apply_spec(g, GridSpec(clean_values=True)))][:2] == ["1e+30", "1.2e-13"]


def test_rows_are_numbered_in_order(spark):
    df = spark.range(5000).select((F.col("id") * F.col("id")).alias(POS)).repartition(7)
    got, total = numbered(df)
    assert total == 5000 and {(r[POS], r["_n"]) for r in got.collect()} == {(i * i, i) for i in range(5000)}
    g = from_dataframe(spark.range(30).selectExpr("id", "id as k"), "id", ["k"])
    assert cells(apply_spec(g, GridSpec(skip_rows=12, limit=2))) == [["12"], ["13"]]


def test_unique_names():
    assert unique_names(["a", "", "a"]) == ["a", "Column 2", "a (2)"]


def test_streaming_upsert(spark, tmp_path):
    schema, src, out = "idx long, at long, v string", str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i * 7 % 50, i, f"v{i}") for i in range(200)]
    order = [rows[k::10] for k in (3, 0, 9, 1, 5, 2, 7, 4, 8, 6, 3, 0)]  # out of order, some twice
    with pytest.raises(ValueError):
        accumulated(spark, out, "idx", "at", ["v"])
    for n, batch in enumerate(order):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        accumulate(spark.readStream.schema(schema).parquet(src), out, "idx", "at", ["v"], str(tmp_path / "cp"), fan=3).awaitTermination(60)
        newest = {}
        for idx, at, v in sorted((r for b in order[: n + 1] for r in b), key=lambda r: r[1]):
            newest[idx] = (at, v)
        assert {r.idx: (r.at, r.v) for r in accumulated(spark, out, "idx", "at", ["v"]).collect()} == newest
    runs = sorted(p.name for p in (tmp_path / "out" / "runs").iterdir() if not p.name.startswith("."))
    assert len(runs) <= 12 and grown(5, 5) == (False, 0)


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    schema, src, out = "idx long, at long, v string", str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(4):
        spark.createDataFrame([(n, n, "a"), (9, n, f"b{n}")], schema).coalesce(1).write.mode("append").parquet(src)
        if n == 3:  # the last batch is told to run again: its end was not written down
            for name in ("commits/2", "commits/.2.crc"):
                (tmp_path / "cp" / name).unlink(missing_ok=True)
        accumulate(spark.readStream.schema(schema).parquet(src), out, "idx", "at", ["v"], str(tmp_path / "cp"), fan=2).awaitTermination(60)
    assert sorted((r.idx, r.v) for r in accumulated(spark, out, "idx", "at", ["v"]).collect()) == [(0, "a"), (1, "a"), (2, "a"), (3, "a"), (9, "b3")]


def test_positions_of_typed_tables(spark):
    df = spark.createDataFrame([(3, 1.5), (1, None)], "k int, x double")
    g = from_dataframe(df, "k")
    assert g.df.columns == [POS, "c0", "c1"] and cells(g) == [["1", ""], ["3", "1.5"]]


FILES = {
    "a.csv": ("\ufeffa,b\n1,2,3\n\n4\n", ("a", "b", "Column 3"), [("1", "2", "3"), ("4", "", "")]), "h.csv": ("1,2\n3,4\n", ("Column 1", "Column 2"), [("1", "2"), ("3", "4")]),
    "q.csv": ('name,note\n"a, ""b""","two\nlines"\nc,d\n', ("name", "note"), [('a, "b"', "two\nlines"), ("c", "d")]), "t.tsv": ("a\tb\nx,y\t2\n", ("a", "b"), [("x,y", "2")]),
    "j.json": ('[{"a":1,"b":null},\n{"b":true,"c":{"x":[1]}}]', ("a", "b", "c"), [("1", "", ""), ("", "true", '{"x":[1]}')]), "l.jsonl": ('{"a":1}\n\n{"b":"x","a":2}\n', ("a", "b"), [("1", ""), ("2", "x")]),
    "m.md": ("| Name | Qty |\n|---|--:|\n| Bolt \\| big | 2 |\n", ("Name", "Qty"), [("Bolt | big", "2")]), "t.html": ("<table><tr><th>a<th>b</tr><tr><td>1<td>2</tr><tr><td>3<td>4</tr></table>", ("a", "b"), [("1", "2"), ("3", "4")]),
    "e.csv": ("", (), []), "b.csv": ('a,b\n,\n"",7\n', ("a", "b"), [("", "7")]),
}


@pytest.mark.parametrize("name", list(FILES))
def test_files_of_every_format(spark, tmp_path, name):
    text, headers, rows = FILES[name]
    (tmp_path / name).write_text(text)
    g = reader.read_grid(spark, str(tmp_path / name))
    assert g.headers == headers and g.preview() == rows


def test_several_files_in_order_and_a_broken_one(spark, tmp_path):
    for i in (2, 1, 3):
        (tmp_path / f"{i}.csv").write_text("k,v\n" * (i == 1) + f"{i},a\n{i},b\n")
    assert [r[0] for r in reader.read_grid(spark, str(tmp_path), has_header=True).preview()] == ["1", "1", "2", "2", "3", "3"]
    (tmp_path / "x.jsonl").write_text('{"a":1}\n{"a":2}\nnot json\n')
    with pytest.raises(ValueError):
        reader.read_grid(spark, str(tmp_path / "x.jsonl"))
    bad = reader.table_rows(spark.createDataFrame([(1, "{"), (2, '[{"a":1}]')], "id long, text string"), "id", "text", "json").collect()
    assert [(r.id, r.header, r.error is None) for r in bad] == [(1, True, False), (2, True, True), (2, False, True)]


def test_specs_by_the_click():
    spec = GridSpec(order=(2, 0), hidden=frozenset({1}), renames={0: "x"}, sort=Sort(1))
    assert spec.showing_one(3).hidden == {0, 1} and spec.showing_all().hidden == frozenset() and spec.columns_reset() == GridSpec(sort=Sort(1)) and GridSpec.reset() == GridSpec()
    assert spec.sort_toggled(1).sort == Sort(1, "desc") and spec.sort_toggled(1).sort_toggled(1).sort is None and spec.sort_toggled(0).sort == Sort(0)


def test_regions_with_headers(spark):
    rows = [("a", "Name", 0, 0), ("a", "Qty", 100, 0), ("a", "Nut", 0, 20), ("a", "3", 100, 20), ("b", "1", 0, 0), ("b", "2", 100, 0), ("b", "3", 0, 20), ("b", "4", 100, 20)]
    df = spark.createDataFrame([(i, t, float(x), float(y), x + 40.0, y + 10.0) for i, t, x, y in rows], "region_id string, text string, left double, top double, right double, bottom double")
    got = sorted((r.region_id, r.header, r.r, r.cells) for r in rebuild(df).collect())
    assert got == [("a", False, 0, ["Nut", "3"]), ("a", True, -1, ["Name", "Qty"]), ("b", False, 0, ["1", "2"]), ("b", False, 1, ["3", "4"])]


def test_merges_say_from_how_many(spark):
    one, two = read_text(spark, "a,b\n1,2", "csv", True), read_text(spark, "a\n1", "csv", True)
    assert merge_tables([one, one, two]).merged_from == 2 and cells(merge_tables([one, one])) == [["1", "2"]]


def test_numbers_of_sorted_rows_need_no_other_order(spark):
    from gridloom.plans.pipeline import apply_spec, ranked
    from gridloom.plans.spec import GridSpec, Sort

    df = spark.range(5000).selectExpr("id", "string(date_add(date'2020-01-01', int(id * 37 % 211))) as day").repartition(7)
    g = apply_spec(from_dataframe(df, "id"), GridSpec(sort=Sort(1, "desc")))
    assert g.in_order and not g.with_df(g.df.repartition(3)).in_order
    got = ranked(g)
    assert "Exchange" not in got._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0] and "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = sorted(df.collect(), key=lambda r: (r.day, -r.id), reverse=True)
    assert [(r["rank"], r["c0"]) for r in sorted(got.collect(), key=lambda r: r["rank"])] == [(i, str(r.id)) for i, r in enumerate(want, 1)]


def test_large_workbooks_have_the_wide_form(spark, tmp_path, monkeypatch):
    from gridloom import workbook

    g = from_dataframe(spark.range(400).selectExpr("id", "repeat('x', 50) as note").repartition(5), "id")
    monkeypatch.setattr(workbook, "MOST_BYTES", 4000)
    monkeypatch.setattr(workbook, "PART_ROWS", 30)
    sinks.write_grid(g, str(tmp_path / "a.xlsx"), "xlsx", ("number", "text"), most_rows=101)
    book = zipfile.ZipFile(tmp_path / "a.xlsx")
    assert book.testzip() is None and len([n for n in book.namelist() if "worksheets" in n]) == 4
    rows = [r for i in range(1, 5) for r in re.findall(r"<v>(\d+)</v>", book.read(f"xl/worksheets/sheet{i}.xml").decode())]
    assert rows == [str(i) for i in range(400)] and b"PK\x06\x06" in (tmp_path / "a.xlsx").read_bytes()


def test_workbooks_are_packed_and_leave_no_scratch(spark, tmp_path, monkeypatch):
    from gridloom import workbook

    monkeypatch.setattr(workbook, "new_path", lambda _, name: f"file://{tmp_path}/scratch/{name}")
    monkeypatch.setattr(workbook, "PART_PIECES", 2)
    df = spark.range(6000).selectExpr("id", "concat('row ', id, if(id % 3 = 0, '\n</x>', '')) as note").repartition(7)
    grids = {"steady": from_dataframe(df, "id"), "sorted": from_dataframe(df, ["id"], unique=False), "counted wrongly": from_dataframe(df, "id")}
    assert [g.steady for g in grids.values()] == [True, False, True] and not grids["steady"].with_df(df).steady
    for name, g in grids.items():
        kept, path = [], str(tmp_path / f"{name}.xlsx")
        with monkeypatch.context() as m:
            m.setattr(workbook, "numbered", lambda *a, _kept=kept, **k: _kept.append(1) or numbered(*a, **k))
            if name == "counted wrongly":
                rows_of = lambda df: (lambda x: (x[0].withColumn("_n", F.expr("_n + if(_n > 3000, 1, 0)")), *x[1:]))(numbered_in_ranges(df))
                m.setattr(workbook, "numbered_in_ranges", rows_of)
            sinks.write_grid(g, path, "xlsx", ("number", "text"), most_rows=2501)
        assert bool(kept) == (name != "steady")  # rows with steady positions are not kept on disk beside the shuffle
        book = zipfile.ZipFile(path)
        sheets = [book.read(f"xl/worksheets/sheet{i}.xml").decode() for i in (1, 2, 3)]
        assert book.testzip() is None and [re.findall(r"<v>(\d+)</v>", x) for x in sheets] == [[str(i) for i in range(a, min(a + 2500, 6000))] for a in (0, 2500, 5000)]
        assert 4 * os.path.getsize(path) < sum(len(x) for x in sheets)
        assert not (tmp_path / "scratch").exists() or not [f for _, _, files in os.walk(tmp_path / "scratch") for f in files]
        got = workbook.workbook_rows(spark, path).collect()
        assert sorted(r.value for r in got) == sorted(x for s in sheets for x in s.replace(workbook.MARK, "").split("<sheetData>")[1].split("</row>")[1:-1])


def test_workbooks_are_read_in_ranges_whatever_cells_hold(spark, tmp_path, monkeypatch):
    from gridloom import workbook

    monkeypatch.setattr(workbook, "PART_ROWS", 40)
    noise = random.Random(3)
    cells = [workbook.MARK * 3, "PK\x03\x04", "</row>", *["".join(chr(noise.randrange(32, 0x2000)) for _ in range(noise.randrange(60))) for _ in range(700)], "x" * 3_000_000]
    g = from_dataframe(spark.createDataFrame(list(enumerate(cells)), "i long, note string"), "i", ["note"], [f"a{workbook.MARK}b"])
    path = str(tmp_path / "a.xlsx")
    sinks.write_grid(g, path, "xlsx", title=workbook.MARK)
    assert zipfile.ZipFile(path).testzip() is None
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        got = workbook.workbook_rows(spark, path)
        assert got.rdd.getNumPartitions() > 20
        rows = {int(r[0]): r[1] for r in (re.fullmatch(r'<row r="(\d+)">(.*)', x.value, re.S).groups() for x in got.collect())}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert rows == {i: f'<c r="A{i}" t="inlineStr"><is><t xml:space="preserve">{workbook.cell_xml(c)}</t></is></c>' if c else "" for i, c in enumerate(cells, 2)}


def test_numbers_of_workbooks_are_those_of_doubles(spark):
    from gridloom import workbook

    shown = ["0", "-0", "00", "007", "1.50", "1.5", "-1.5", "-0.5", "0.0", "0.00001", "0.000001", "0.0000001", "9999999999", "12345678901", "1234567890.12345", "1234567890.123456", "1e5", "5\n", ".5", "5.", "$3", "x", "", "٣", "--1", "+1", "1,000"]
    g = from_dataframe(spark.createDataFrame(list(enumerate(shown)), "i long, v string"), "i", ["v"])
    lines = workbook.sheet_rows(g, ("number",), g.df.withColumn("_n", F.col("_pos")), 1000)
    plain = {r[0]: r[1] for r in g.df.select("_pos", S.number_text(S.parse_number(F.col("c0")))).collect()}
    got = {r.r - 2: re.search(r"<v>(.*)</v>", r.line, re.S) for r in lines.collect()}
    assert {i: m and m[1] for i, m in got.items()} == plain


def test_buckets_are_the_bounds_below(spark):
    df = spark.range(3000).select((F.xxhash64("id") % 700).alias("_pos")).union(spark.sql("select cast(null as bigint)"))
    bounds = sorted(set(df.approxQuantile("_pos", [i / 256 for i in range(1, 256)], 0.002)))
    rows = bucketed(df).collect()
    assert len(rows) == 3001 and all(r["_bucket"] == (0 if r["_pos"] is None else sum(b <= r["_pos"] for b in bounds)) for r in rows)
    assert {r["_bucket"] for r in bucketed(df.where("_pos is null")).collect()} == {0}


def test_one_file_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "new_path", lambda _, name: f"file://{tmp_path}/scratch/{name}")
    df = spark.range(0, 4000, 1, 8).selectExpr("id", "concat(id, '\n\"x\"') as note")
    g = from_dataframe(df, "id")
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "part-old").write_text("old")
    sinks.write_grid(g, str(tmp_path / "one"), "csv", one_file=True)
    sinks.write_grid(g, str(tmp_path / "many"), "csv")
    parts = lambda name: sorted((tmp_path / name).glob("part-*"))
    assert len(parts("one")) == 1 and parts("one")[0].read_bytes() == b"".join(p.read_bytes() for p in parts("many"))
    assert (tmp_path / "scratch").exists() and not [p for p in (tmp_path / "scratch").iterdir()]
