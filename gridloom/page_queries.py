"""Queries over pages that are built out of the given tables, with SQL for what such pages hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .queries import query, read
from .sources.html import BLANK, FILL, MARK, Options
from .sources.pages import catalogue, rows_of_pages
from .streaming.capture import captured


def joined(rows: DataFrame, key: str, order: str, line: Column) -> DataFrame:
    """The lines of each key, one behind the other."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))).alias("x"), F.count("*").alias("n")).select(key, F.array_join(F.transform("x", lambda x: x["line"]), "").alias("lines"))


def tag(name: str, content: Column, attributes: str = "") -> Column:
    return F.concat(F.lit(f"<{name}{attributes}>"), content.cast("string"), F.lit(f"</{name}>"))


def nation_pages(spark, d) -> DataFrame:
    """A page for each nation: its customers as a table whose segment cells reach over two rows, its suppliers as a grid of boxes, and a table that is too small."""
    nation, customer, supplier = (read(spark, d, t) for t in ("nation", "customer", "supplier"))
    # customers by key; each second one has its segment from the row above
    customer = customer.withColumn("odd", F.expr("row_number() over (partition by c_nationkey order by c_custkey)") % 2 == 1)
    row = tag("tr", F.concat(tag("td", F.col("c_custkey")), tag("td", F.format_number("c_acctbal", 2)), F.when(F.col("odd"), tag("td", F.col("c_mktsegment"), " rowspan=2")).otherwise("")))
    customers = joined(customer, "c_nationkey", "c_custkey", row)
    boxes = joined(supplier, "s_nationkey", "s_suppkey", tag("div", F.concat(tag("span", F.col("s_suppkey")), tag("span", F.col("s_name"))), " class='row'"))
    pages = nation.join(customers, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(boxes.withColumnRenamed("lines", "boxes"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    table = F.concat(F.lit("<table>"), tag("caption", F.col("n_name")), F.lit("<thead><tr><th colspan=2>Customer<th rowspan=2>Segment</tr><tr><th>Key<th>Balance</tr></thead>"), F.coalesce("lines", F.lit("")), F.lit("</table>"))
    grid = F.concat(F.lit("<div id='suppliers'><div class='row head'><span>Key</span><span>Name</span></div>"), F.coalesce("boxes", F.lit("")), F.lit("</div>"))
    small = F.lit("<table><tr><th>a<th>b</tr><tr><td>1<td>2</tr></table>")
    return pages.select(F.col("n_nationkey").alias("page_id"), F.concat(F.lit("<h1>x</h1>"), small, table, F.lit("<p hidden>y</p>"), grid).alias("html"))


@query("""with c as (select n_nationkey, n_name, count(c_custkey) as n from nation left join customer on c_nationkey = n_nationkey group by 1, 2), s as (select n_nationkey, count(s_suppkey) as n from nation left join supplier on s_nationkey = n_nationkey group by 1)
select n_nationkey as page_id, 1 as nth, 'table' as kind, '' as path, n_name as label, n_name as caption, (n + n % 2)::int as rows, 3 as columns, 2 as header_rows, true as merged, false as virtual from c where n > 0
union all select s.n_nationkey, 1 + (c.n > 0)::int, 'grid', '', 'suppliers', '', s.n::int, 2, 1, false, false from s join c using (n_nationkey) where s.n >= 2""")  # fmt: skip
def page_catalogue(spark, d):
    return catalogue(nation_pages(spark, d))


PAIRS = "with p as (select *, row_number() over (partition by c_nationkey order by c_custkey) as i, count(*) over (partition by c_nationkey) as n from customer), q as (select *, lag(c_mktsegment) over (partition by c_nationkey order by c_custkey) as above, format('{:,.2f}', c_acctbal) as balance from p)"
SUPPLIERS = "select s_nationkey as page_id, 'suppliers' as label, row_number() over (partition by s_nationkey order by s_suppkey)::int - 1 as r, [s_suppkey::varchar, s_name] as cells from supplier qualify count(*) over (partition by s_nationkey) >= 2"


def page_rows(policy: str, headers: list[str], below: str, tail: str | None):
    """The rows of all tables of the pages under a span policy: ``below`` is what a covered segment cell shows, ``tail`` what the row that a last cell reaches into shows."""
    extra = f"union all select c_nationkey, n_name, n::int, ['', '', {tail}] from q join nation on n_nationkey = c_nationkey where i = n and n % 2 = 1" if tail else ""
    enough = "n > 0" if tail else "n > 1"
    sql = f"""{PAIRS} select c_nationkey as page_id, n_name as label, i::int - 1 as r, [c_custkey::varchar, balance, case when i % 2 = 1 then c_mktsegment else {below} end] as cells from q join nation on n_nationkey = c_nationkey where {enough} {extra}
union all select distinct c_nationkey, n_name, -1, {headers} from q join nation on n_nationkey = c_nationkey where {enough} union all {SUPPLIERS} union all select distinct page_id, label, -1, ['Key', 'Name'] from ({SUPPLIERS})"""

    def run(spark, d):
        rows = rows_of_pages(nation_pages(spark, d), options=Options(span_policy=policy), with_label=True)
        return rows.select("page_id", "label", "r", "cells")

    run.__name__ = f"page_rows_{policy}"
    return query(sql)(run)


page_rows(FILL, ["Customer – Key", "Customer – Balance", "Segment"], "above", "c_mktsegment")
page_rows(BLANK, ["Customer – Key", "Balance", "Segment"], "''", None)
page_rows(MARK, ["Customer – Key", "↳ – Balance", "Segment – ↳"], "'↳'", "'↳'")

#: Roots in roots on a page; a table in a root of depth 8 is too deep to be seen.
LEVELS = 10


@query(f"""with levels as (select unnest(range({LEVELS})) as level), seen as (select *, array_to_string(list_transform(range(1, level + 1), lambda k: case when k % 3 = 0 then '/frame' else '/shadow' end), '') as path from levels where level <= 7)
select n_nationkey as page_id, level::int + 1 as nth, path, n_name || ', ' || level as label, 2 as rows, 2 as columns from nation, seen""")  # fmt: skip
def page_roots(spark, d):
    def table(level):
        cells = F.concat(tag("th", F.col("n_name")), tag("th", F.lit(level)))
        return F.concat(F.lit("<table><thead><tr>"), cells, F.lit("</tr></thead><tr><td>a<td>b</tr><tr><td>c<td>d</tr></table>"))

    html = table(LEVELS - 1)
    for level in range(LEVELS - 1, 0, -1):  # every third root is a frame
        framed = F.concat(F.lit('<iframe srcdoc="'), F.replace(F.replace(html, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit('"></iframe>'))
        inside = framed if level % 3 == 0 else F.concat(F.lit('<div><template shadowrootmode="open">'), html, F.lit("</template></div>"))
        html = F.concat(table(level - 1), inside)
    return catalogue(read(spark, d, "nation").select(F.col("n_nationkey").alias("page_id"), html.alias("html"))).select("page_id", "nth", "path", "label", "rows", "columns")


#: Steps of each walk, the rows that a step shows and how far it goes on.
STEPS, SHOWN, MOVED = 6, 8, 5


@query(f"""with e as (select event_id // 40 as capture_id, (event_id % 40)::int as i, event_type, user_id from events), named as (select *, capture_id % 3 as kind from e),
seen as (select capture_id, kind, step, i, event_type, user_id from named, range({STEPS}) t(step) where i >= {MOVED} * step and i < {MOVED} * step + {SHOWN}),
windows as (select *, count(*) over (partition by capture_id, step) as n from seen), counted as (select * from windows where n >= 2),
numbered as (select capture_id, i, max(step) as step from counted where kind = 0 group by 1, 2), by_number as (select c.capture_id, c.i, [c.i::varchar, c.event_type, c.step::varchar] as cells from counted c join numbered using (capture_id, i, step)),
distinct_rows as (select capture_id, [event_type, user_id::varchar, case when kind = 1 then i::varchar else 'same' end] as cells, min(step * 1000 + i) as place from counted where kind > 0 group by all),
original as (select capture_id, count(*) as n from counted where step = 0 group by 1),
every as (select capture_id, 'row-index' as strategy, cells, i as place from by_number union all select capture_id, 'content-dedupe', cells, place from distinct_rows),
sized as (select *, count(*) over (partition by capture_id) as found, row_number() over (partition by capture_id order by place) - 1 as r from every)
select capture_id, strategy, (found - n)::int as gained, r::int as r, cells from sized join original using (capture_id) where found > n
union all select capture_id, case when kind = 0 then 'row-index' else 'content-dedupe' end, 0, (row_number() over (partition by capture_id order by i))::int - 1, case kind when 0 then [i::varchar, event_type, '0'] when 1 then [event_type, user_id::varchar, i::varchar] else [event_type, user_id::varchar, 'same'] end
from counted where step = 0 and capture_id in (select capture_id from sized join original using (capture_id) where found <= n)""")  # fmt: skip
def captured_walks(spark, d):
    """Events as tables of 40 rows that are scrolled: every third one numbers its rows, every third has rows that repeat."""
    e = read(spark, d, "events").select(F.expr("event_id div 40").alias("capture_id"), F.expr("int(event_id % 40)").alias("i"), "event_type", "user_id")
    seen = e.withColumn("kind", F.col("capture_id") % 3).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1)))).where(f"i >= {MOVED} * step and i < {MOVED} * step + {SHOWN}")
    td = lambda *cs: F.concat(*[tag("td", c) for c in cs])
    by_kind = F.when(F.col("kind") == 0, td(F.col("i"), F.col("event_type"), F.col("step"))).otherwise(td(F.col("event_type"), F.col("user_id"), F.when(F.col("kind") == 1, F.col("i").cast("string")).otherwise("same")))
    row = F.concat(F.lit("<tr"), F.when(F.col("kind") == 0, F.concat(F.lit(" aria-rowindex="), F.col("i"))).otherwise(""), F.lit(">"), by_kind, F.lit("</tr>"))
    snapshots = seen.groupBy("capture_id", "step").agg(F.array_sort(F.collect_list(F.struct("i", row.alias("line")))).alias("x"))
    html = F.concat(F.lit("<table><thead><tr><th>A<th>B<th>C</tr></thead>"), F.array_join(F.transform("x", lambda x: x["line"]), ""), F.lit("</table>"))
    return captured(snapshots.select("capture_id", "step", html.alias("html"))).where("r >= 0")
