"""Files in ranges: records that reach over them, against readers that take the whole text."""

import csv
import io
import json
import random

import pytest

from gridloom.sources.ranges import Delimited, JsonList, fields, records
from gridloom.sources.reader import read_grid
from gridloom.sources.text import parse_text


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def in_order(found):
    return [r.text for r in sorted(found.collect(), key=lambda r: (r.file_path, r.block, r.n, r.k))]


def tasks(found):
    return found.select("file_path", "block").distinct().count()


CELLS = ["", "plain", 'a "q" b', "two\nlines", "x,y", "\n\n", '"', "five\n\n\nnew\nlines", "é", '5" pipe', "end\n"]


@pytest.mark.parametrize("seed", range(2))
def test_quoted_newlines_over_ranges(small_ranges, tmp_path, seed):
    spark, r = small_ranges, random.Random(seed)
    wanted = {}
    for name in ("a", "b"):
        rows = [[str(i), r.choice(CELLS), r.choice(CELLS) * r.choice([1, 1, 40])] for i in range(150)]
        out = io.StringIO()
        csv.writer(out, lineterminator="\r\n" if name == "b" else "\n").writerows(rows)
        (tmp_path / f"{name}.csv").write_text(("﻿" if name == "a" else "") + out.getvalue(), newline="")
        wanted[name] = rows
    found = records(spark, str(tmp_path), Delimited(","))
    assert tasks(found) > 5
    assert [fields(t, ",") for t in in_order(found)] == wanted["a"] + wanted["b"]
    g = read_grid(spark, str(tmp_path), "csv", has_header=False)
    assert [list(x) for x in g.preview(1000)] == wanted["a"] + wanted["b"]


def test_quotes_inside_fields_open_nothing(small_ranges, tmp_path):
    lines = ['5" pipe,x', 'a,"b" tail', 'c,"d ""e"" ', 'f"', '""",g', '"",""', "h,\"i\r\nj\""] * 60
    (tmp_path / "a.csv").write_text("\n".join(lines), newline="")
    found = [fields(t, ",") for t in in_order(records(small_ranges, str(tmp_path), Delimited(",")))]
    assert found == walked("\n".join(lines)) and found[:2] == [['5" pipe', "x"], ["a", "b tail"]]


def walked(text):
    """The cells of all records by a walk over the characters."""
    rows, row, cell, quoted, i = [], [], "", False, 0
    while i < len(text):
        c = text[i]
        if quoted and c == '"' and text[i + 1 : i + 2] == '"':
            cell, i = cell + '"', i + 1
        elif quoted and c == '"':
            quoted = False
        elif quoted:
            cell += c
        elif c == '"' and not cell:
            quoted = True
        elif c in ",\n":
            row.append(cell)
            cell = ""
            if c == "\n":
                rows.append(row)
                row = []
        elif c != "\r":
            cell += c
        i += 1
    return [*rows, [*row, cell]]


@pytest.mark.parametrize("wrap", ["{}", '{{"meta":{{"a":[1,2],"b":"[x]"}},"rows":{},"more":[{{"no":1}}]}}'])
def test_json_lists_over_ranges(small_ranges, tmp_path, wrap):
    r = random.Random(3)
    odd = ["plain", "}{][", 'q"uote', "back\\slash", "new\nline", "", "}" * 50, '\\"', "é", {"x": [1, {"y": "}"}]}, [1, "]"], None, 1.5, True]
    rows = [{"k": i, r.choice("abc"): r.choice(odd), "z": "long " * r.choice([0, 0, 0, 300])} if i % 17 else r.choice([5, "s}", None, [1], {}]) for i in range(1, 300)]
    for pretty in (None, 1):
        text = wrap.format(json.dumps(rows, indent=pretty, ensure_ascii=False))
        path = tmp_path / f"{pretty}.json"
        path.write_text(text)
        found = records(small_ranges, str(path), JsonList())
        assert tasks(found) > 5 and [json.loads(t) for t in in_order(found)] == rows
        g, want = read_grid(small_ranges, str(path), "json"), parse_text(text, "json")[0]
        assert list(g.headers) == want.headers and len(g.preview(1000)) == len(want.rows)
        assert [x[0] for x in g.preview(1000)] == [x[0] for x in want.rows]


def test_json_rows_over_ranges_and_broken_lists(small_ranges, tmp_path):
    rows = [["name", "qty"], *[[f"n]{i}", i] for i in range(900)]]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    g = read_grid(small_ranges, str(tmp_path / "a.json"))
    assert g.headers == ("name", "qty") and [list(x) for x in g.preview(1000)] == [[a, str(b)] for a, b in rows[1:]]
    (tmp_path / "b.json").write_text("[" + ",".join('{"a":tru}' for _ in range(800)) + "]")
    with pytest.raises(ValueError):
        read_grid(small_ranges, str(tmp_path / "b.json"), "json")
    (tmp_path / "c.json").write_text(json.dumps({"a": "x" * 9000}))
    with pytest.raises(ValueError):
        read_grid(small_ranges, str(tmp_path / "c.json"), "json")


def test_json_and_markdown_by_the_rules():
    assert parse_text('[{"a":1},5,{"":2}]', "json")[0].rows == [["1", ""], ["", ""], ["", "2"]] and parse_text('[{"a":1},5,{"":2}]', "json")[0].headers == ["a", "Column 2"]
    assert parse_text("[5,{\"a\":1}]", "json")[0].rows == [[""], ["1"]] and parse_text('[1,"x",null]', "json")[0].rows == [["1"], ["x"], [""]]
    assert parse_text('{"a":1}\n5\n{"b":2}', "jsonl")[0].rows == [["1", ""], ["", ""], ["", "2"]]
    t = parse_text("|x|1|\n|a|b|\n|-|-|\n|c<BR>d|2|\n|-|-|\n|e|3|f|", "markdown")[0]
    assert t.headers == ["a", "b", "Column 3"] and t.rows == [["x", "1", ""], ["c\nd", "2", ""], ["e", "3", "f"]]
    assert parse_text("|-|-|\n|name|qty|\n|a|1|", "markdown")[0].headers == ["name", "qty"]
    with pytest.raises(ValueError):
        parse_text("no pipes here", "markdown")


def test_json_lines_of_rows_and_scalars(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('["name","qty"]\n["x",1]\n["y",null]\n')
    g = read_grid(spark, str(tmp_path / "a.jsonl"), "jsonl")
    assert g.headers == ("name", "qty") and g.preview() == [("x", "1"), ("y", "")]
    (tmp_path / "b.jsonl").write_text('1\n"x"\nnull\n')
    assert read_grid(spark, str(tmp_path / "b.jsonl"), "jsonl").preview() == [("1",), ("x",), ("",)]


@pytest.mark.parametrize("fmt", ["csv", "tsv"])
def test_the_header_stands_in_the_first_file_not_in_the_largest(spark, tmp_path, fmt):
    sign = "," if fmt == "csv" else "\t"
    (tmp_path / "part-0.csv").write_text("")
    (tmp_path / "part-1.csv").write_text(f"key{sign}name\n1{sign}one\n")
    (tmp_path / "part-2.csv").write_text("".join(f"{i}{sign}{'x' * 500}\n" for i in range(2, 400)))
    g = read_grid(spark, str(tmp_path), fmt)
    assert g.headers == ("key", "name")
    assert [r[0] for r in g.preview(1000)] == [str(i) for i in range(1, 400)]


@pytest.mark.parametrize("top", ["| a | b |\n|---|---|\n", "| 0 | over |\n| a | b |\n|:-:|---|\n"])
def test_large_markdown_is_read_by_lines(small_ranges, tmp_path, monkeypatch, top):
    from gridloom.sources import reader

    text = top + "".join(f"| {i} | x\\|{'y' * (i % 50)}<br>{i} |{' more |' if i == 700 else ''}\n{'text' if i % 9 else '|---|---|'}\n" for i in range(900))
    (tmp_path / "a.md").write_text(text)
    want = parse_text(text, "markdown")[0]
    monkeypatch.setattr(reader, "WHOLE", 1000)
    monkeypatch.setattr(reader, "table_rows", None)  # the whole text is parsed by no task
    g = read_grid(small_ranges, str(tmp_path), "markdown")
    assert list(g.headers) == want.headers and [list(r) for r in g.preview(2000)] == want.rows


ROWS = "".join(f"<tr><td>{i}</td> <td>x &amp; &lt;{'y' * (i % 50)}&gt;\n é&nbsp; {i} </td></tr>\n" + "<tr><td></td><td> </td></tr>" * (i % 7 == 0) + "<tr><td>short</td></tr>" * (i == 500) for i in range(900))


@pytest.mark.parametrize("top", ["<!doctype html><title>T</title><style>td{a:b}</style><table><caption>c</caption><thead>\n<tr><th>a</th><th class='x'>b</th></tr></thead>\n<tbody>", "<table><tr><td>name</td><td>text</td></tr>", "<p>x</p><table><tbody>"])
def test_large_html_of_plain_rows_is_read_in_ranges(small_ranges, tmp_path, monkeypatch, top):
    from gridloom.sources import reader

    text = f"{top}{ROWS}</tbody>\n</table><p>end</p>"
    (tmp_path / "a.html").write_text(text)
    want = parse_text(text, "html")[0]
    monkeypatch.setattr(reader, "WHOLE_PAGE", 1000, raising=False)
    monkeypatch.setattr(reader, "table_rows", None)  # the whole text is parsed by no task
    g = read_grid(small_ranges, str(tmp_path), "html")
    assert list(g.headers) == want.headers and [list(r) for r in g.preview(2000)] == want.rows


def test_large_html_of_another_form_is_parsed_whole(small_ranges, tmp_path, monkeypatch):
    from gridloom.sources import reader

    monkeypatch.setattr(reader, "WHOLE_PAGE", 1000, raising=False)
    wide, spans = "<tr><td>1</td><td>2</td><td>3</td></tr>", "<tr><td rowspan=2>1</td><td>2</td></tr><tr><td>3</td></tr>"
    for k, text in enumerate((f"<table>{ROWS}{wide}</table>", f"<table>{ROWS}{spans}{ROWS}</table>", f"<table>{ROWS[:3000]}</tbody></table><table>{ROWS}</table>", f"<!--{ROWS}--><table>{ROWS}</table>")):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "a.html").write_text(text)
        want = parse_text(text, "html")[0]
        g = read_grid(small_ranges, str(tmp_path / str(k)), "html")
        assert list(g.headers) == want.headers and [list(r) for r in g.preview(4000)] == want.rows
