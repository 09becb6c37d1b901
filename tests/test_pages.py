"""Pages: the parser on literal cases, and the layout in Spark against the one in Python on random tables."""

import random

import pytest

from gridloom.sources.html import BLANK, FILL, MARK, Options, find_tables, largest_table, tables_of
from gridloom.sources.pages import catalogue, page_candidates, page_cells, rows_of_pages
from gridloom.streaming.capture import captured


def first_cell(html, **options):
    return largest_table(f"<table><tr>{html}<td>1</tr><tr><td>x<td>2</tr></table>", Options(infer_headers=False, **options)).rows[0][0]


@pytest.mark.parametrize(
    "html,text",
    [
        ("<td hidden>secret</td>", ""), ("<td><span style='visibility: hidden'>a</span>b", "b"), ("<td><b style='color:red;display : none'>a</b>b", "b"), ("<td aria-hidden=true>x", ""), ("<td><input type=checkbox checked>", "true"),
        ("<td><input type=radio>", "false"), ("<td><input value=v><input type=password value=p>", "v"), ("<td><select><option>a<option selected>b</select>", "b"), ("<td><select><option disabled>a<option>c</select>", "c"), ("<td>a<div>b</div>c", "ab\nc"),
        ("<td>a<br>b", "a\nb"), ("<td> a\n   b ", "a\nb"), ("<td>a&nbsp; b", "a b"), ("<td>n<sup>1</sup><i class='x reference'>2</i>", "n"), ("<td><img alt=pic>", "pic"), ("<td><img src=u.png>", "u.png"), ("<td><template>t</template>u<noscript>v</noscript>", "u"),
    ],
)
def test_cell_texts(html, text):
    assert first_cell(html) == text


def test_options():
    assert first_cell("<td>a<br>b", line_breaks=False) == "a b" and first_cell("<td> a ", trim=False) == " a " and first_cell("<td><img alt=p>q", image_text=False) == "q"
    assert first_cell("<td>n<sup>1</sup>", keep_footnotes=True) == "n1"
    page = "<table><tr><td>Name<td>Qty</tr><tr><td>a<td>1</tr><tr><td>b<td>2</tr></table>"
    assert largest_table(page).headers == ["Name", "Qty"] and largest_table(page, Options(infer_headers=False)).headers == ["Column 1", "Column 2"]
    with pytest.raises(ValueError):
        largest_table("<table><tr><th>a<th>b</tr><tr><td>1<td>2</tr></table>")  # one row is no table
    linked = find_tables("<table><tr><th>a<th>b</tr><tr><td><a href=u>x</a><td>1</tr><tr><td>y<td>2</tr></table>", Options(links=True))[0]
    assert linked.headers == ["a", "a link", "b"] and linked.rows == [["x", "u", "1"], ["y", "", "2"]]


def test_grids_of_boxes():
    row = "<div class='{}'><span>{}</span><span>{}</span></div>"
    rows = row.format("row", "a", 1) + row.format("row", "b", 2)
    head = row.format("row head", "Name", "Qty")
    assert find_tables(f"<div>{head}{rows}</div>")[0].headers == ["Name", "Qty"]  # a header of another shape stays
    assert find_tables(f"<div>{rows}{row.format('foot', 'c', 3) * 2}</div>") == []  # too many of another shape
    assert find_tables(f"<div>{rows}{row.format('row', '', '')}</div>")[0].rows == [["a", "1"], ["b", "2"]]  # blank rows go
    assert find_tables(f"<nav role=grid>{rows}</nav>")[0].rows == [["a", "1"], ["b", "2"]] and find_tables(f"<article>{rows}</article>") == []
    assert len(find_tables(f"<main><div><div>{rows}</div></div></main>")) == 1  # the outermost that is one
    table = "<table><tr><td>a<td>b</tr><tr><td>1<td>c</tr><tr><td>1<td>d</tr></table>"
    found = tables_of(table + f"<ul>{rows}</ul>")
    assert [f.kind for f, _ in found] == ["table", "grid"] and [f.kind for f, _ in tables_of(table * 8 + f"<ul>{rows}</ul>")] == ["table"] * 8
    assert [f.virtual for f, _ in tables_of(f"<div class='virtual-list'>{table}</div>{table}")] == [True, False]


def test_roots():
    table = "<table><tr><td>a<td>b</tr><tr><td>1<td>c</tr><tr><td>1<td>d</tr></table>"
    page = f"{table}<x-card><template shadowrootmode=open>{table}</template><p>light</p></x-card><p><template>{table}</template></p><iframe srcdoc='{table}'></iframe><iframe sandbox srcdoc='{table}'></iframe><div><template shadowrootmode=closed>{table}</template></div>"
    assert [f.path for f, _ in tables_of(page)] == ["", "/shadow", "/frame"]
    assert find_tables("<div>" * 3000 + table)[0].rows  # deep pages do not end the parser


def random_table(r):
    def cell(tag):
        text = r.choice(["", "12", "3.5 %", "label", "a longer label", "<img alt=i>", "x<br>y"])
        return f"<{tag} rowspan={r.choice([1, 1, 1, 2, 3])} colspan={r.choice([1, 1, 1, 2])}>{text}"

    rows = ["<tr>" + "".join(cell(r.choice(["td", "td", "th"]) if r.random() < 0.9 else "th") for _ in range(r.randint(0, 4))) + "</tr>" for _ in range(r.randint(1, 6))]
    head = f"<thead><tr>{''.join(cell('th') for _ in range(3))}</tr></thead>" if r.random() < 0.3 else ""
    return f"<table id=t{r.randint(0, 9)}>{'<caption>C</caption>' if r.random() < 0.2 else ''}{head}{''.join(rows)}</table>"


@pytest.mark.parametrize("policy", [FILL, BLANK, MARK])
def test_layout_in_spark_matches_the_one_in_python(spark, policy):
    r, o = random.Random(policy), Options(span_policy=policy)
    pages = [(i, "".join(random_table(r) for _ in range(r.randint(1, 3)))) for i in range(80)] + [(None, random_table(random.Random(7))), (500, None), (501, ""), (502, "<p>no table</p>")]
    df = spark.createDataFrame(pages, "page_id int, html string").repartition(3)
    got = {}
    for x in rows_of_pages(df, options=o).collect():
        got.setdefault((x.page_id, x.nth), []).append((x.r, x.cells))
    want = {(i, n): [(-1, t.headers), *enumerate(t.rows)] for i, html in pages for n, (_, t) in enumerate(tables_of(html or "", o), 1)}
    assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 60
    listed = {(x.page_id, x.nth): (x.kind, x.caption, x.rows, x.columns, x.merged) for x in catalogue(df, options=o).collect()}
    assert listed == {(i, n): (f.kind, t.caption, len(t.rows), len(t.headers), t.has_merges) for i, html in pages for n, (f, t) in enumerate(tables_of(html or "", o), 1)}


def test_long_form_and_repeated_pages(spark):
    html = "<table><tr><td rowspan=2 colspan=2>a<td>b</tr><tr><td>c<td colspan=3000>d</tr></table>"
    df = spark.createDataFrame([(1, html), (1, html)], "page_id int, html string")
    places = page_cells(page_candidates(df)).where("c < 5").collect()
    assert sorted((x.r, x.c, x.text, x.master) for x in places) == [(0, 0, "a", True), (0, 1, "a", False), (0, 2, "b", True), (1, 0, "a", False), (1, 1, "a", False), (1, 2, "c", True), (1, 3, "d", True), (1, 4, "d", False)]
    assert catalogue(df.limit(0)).count() == 0 and catalogue(df).count() == 1  # repeated rows count once
    assert page_cells(page_candidates(df)).where("r = 1").count() == 1003  # spans end at a thousand


def test_captures_never_shrink(spark):
    table = lambda *rows: "<table><tr><th>a<th>b</tr>" + "".join(f"<tr{n}><td>{x}<td>{y}</tr>" for n, x, y in rows) + "</table>"
    steps = [
        ("n", 0, table((" data-index=1", "x", 1), (" data-index=2", "y", 2))), ("n", 1, table((" data-index=2", "y", 9), (" data-index=10", "z", 3))),
        ("c", 0, table(("", "x", 1), ("", "y", 2))), ("c", 1, table(("", "y", 2), ("", "z", 3), ("", "a", "b"))), ("s", 0, table(("", "x", 1), ("", "x", 1), ("", "y", 1))), ("s", 1, None),
    ]
    got = {}
    for r in captured(spark.createDataFrame(steps, "capture_id string, step int, html string")).collect():
        got.setdefault((r.capture_id, r.strategy, r.gained), []).append((r.r, r.cells))
    assert {k: [c for _, c in sorted(v)] for k, v in got.items()} == {
        ("n", "row-index", 1): [["a", "b"], ["x", "1"], ["y", "9"], ["z", "3"]], ("c", "content-dedupe", 1): [["a", "b"], ["x", "1"], ["y", "2"], ["z", "3"]], ("s", "content-dedupe", 0): [["a", "b"], ["x", "1"], ["x", "1"], ["y", "1"]],
    }


def test_boxes_of_all_sizes_match_a_loop(spark):
    from gridloom.operators.region import best_boxes

    r = random.Random(6)

    def box(i):
        w, h, x, y = (10 ** r.uniform(0, 6) for _ in range(4))
        x, y = x * r.choice([-1, 1]), y * r.choice([-1, 1])
        return (i, x, y, x + w, y + h)

    boxes, targets = [box(i) for i in range(300)] + [(900, 0.0, 0.0, 0.0, 5.0), (901, None, 0.0, 1.0, 1.0)], [box(i) for i in range(60)] + [(77, 5.0, 5.0, 4.0, 9.0)]
    cols = "left double, top double, right double, bottom double"
    got = {}
    for x in best_boxes(spark.createDataFrame(boxes, "box_id long, " + cols), spark.createDataFrame(targets, "target_id long, " + cols), keep=4).collect():
        got.setdefault(x.target_id, []).append((x.rank, x.box_id, round(x.coverage, 9)))
    want = {}
    for i, l, t, right, bottom in targets:
        met = []
        for j, a, b, c, d in boxes[:300]:
            if l < c and right > a and t < d and bottom > b:
                met.append((-(min(right, c) - max(l, a)) * (min(bottom, d) - max(t, b)) / max(1, (right - l) * (bottom - t)), j))
        if met and right > l:
            want[i] = [(k, j, round(-x, 9)) for k, (x, j) in enumerate(sorted(met)[:4], 1)]
    assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 40
    assert best_boxes(spark.createDataFrame([], "box_id long, " + cols), spark.createDataFrame(targets, "target_id long, " + cols)).count() == 0


def test_slices_keep_columns_that_cannot_be_measured(spark):
    from gridloom.operators.slicing import slice_tables

    # column 1 is only covered by a cell that spans two; row 2 is blank in what is kept
    cells = [(1, 0, 0, "h", True, 1, 0, 50), (1, 0, 1, "wide", True, 2, 50, 150), (1, 0, 2, "wide", True, 2, 50, 150), (1, 1, 0, "a", False, 1, 0, 50), (1, 1, 1, "b", False, 2, 50, 150), (1, 1, 2, "b", False, 2, 50, 150), (1, 2, 0, "gone", False, 1, 0, 50), (1, 2, 1, "", False, 2, 50, 150), (1, 2, 2, "", False, 2, 50, 150)]
    df = spark.createDataFrame([(t, r, c, x, h, s, float(a), float(b), 20.0 * r, 20.0 * r + 20) for t, r, c, x, h, s, a, b in cells], "table_id int, r int, c int, text string, header boolean, col_span int, left double, right double, top double, bottom double")
    box = spark.createDataFrame([(1, 60.0, 0.0, 200.0, 60.0)], "table_id int, left double, top double, right double, bottom double")
    assert sorted((x.r, x.c, x.text, x.partial) for x in slice_tables(df, box).collect()) == [(0, 1, "wide", True), (0, 2, "wide", True), (1, 1, "b", True), (1, 2, "b", True)]


def test_boxes_that_repeat_sides_and_equal_shares_are_not_paired(spark, monkeypatch):
    from gridloom.operators import region

    monkeypatch.setattr(region, "CHUNK", 8)
    r = random.Random(3)
    shape = lambda: (float(r.randrange(12)), float(r.randrange(12)), r.choice([1.0, 3.0, 9.0]), r.choice([1.0, 3.0, 9.0]))
    made = [(i, *((x, y, x + w, y + h) if i % 3 else (0.0, 0.0, 20.0, 20.0))) for i, (x, y, w, h) in enumerate(shape() for _ in range(1500))]
    r.shuffle(made)
    targets = [(f"t{i}", x, y, x + w, y + h) for i, (x, y, w, h) in enumerate(shape() for _ in range(150))]
    cols = "left double, top double, right double, bottom double"
    frame = spark.createDataFrame(targets, "target_id string, " + cols)
    want = set()
    for i, l, t, right, bottom in targets:
        met = [(-round((min(right, c) - max(l, a)) * (min(bottom, d) - max(t, b)) / max(1, (right - l) * (bottom - t)), 9), j) for j, a, b, c, d in made if l < c and right > a and t < d and bottom > b]
        want |= {(i, j, k, -x) for k, (x, j) in enumerate(sorted(met)[:3], 1)}
    got = region.best_boxes(spark.createDataFrame(made, "box_id int, " + cols), frame)
    assert {(x.target_id, x.box_id, x["rank"], round(x.coverage, 9)) for x in got.collect()} == want and dict(got.dtypes)["box_id"] == "int"
    named = region.best_boxes(spark.createDataFrame([(f"b{i:04}", *x) for i, *x in made], "box_id string, " + cols), frame)
    assert {(x.target_id, int(x.box_id[1:]), x["rank"], round(x.coverage, 9)) for x in named.collect()} == want
    # shares that are equal to nine digits are ranked by id; so many pairs of all that overlap would not end here
    near = spark.createDataFrame([(2, 0.0, 0.0, 50.0, 100.0), (1, 0.0, 0.0, 50.0 - 1e-9, 100.0)], "box_id int, " + cols)
    assert [x.box_id for x in region.best_boxes(near, spark.createDataFrame([("t", 0.0, 0.0, 100.0, 100.0)], "target_id string, " + cols)).orderBy("rank").collect()] == [1, 2]
    many = spark.range(300_000).selectExpr("id as box_id", "double(id % 7) as left", "0D as top", "double(id % 7 + 40) as right", "40D as bottom")
    assert region.best_boxes(many, many.withColumnRenamed("box_id", "target_id").where("target_id % 20 = 0")).agg({"box_id": "max", "rank": "count"}).first()[:] == (20, 45_000)
