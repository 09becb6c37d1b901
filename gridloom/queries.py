"""Queries over the driver's tables, one for each operator, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import sinks
from .functions import scalar as S
from .grid import POS, Grid, carried_last, from_dataframe
from .operators.combine import adjacent_dedupe, merge_tables, transposed
from .operators.profile import column_sketches, column_stats, inferred, merged_sketches
from .operators.readings import readings, refound
from .operators.region import best_boxes, candidates, rebuild, visible_items
from .operators.slicing import slice_tables
from .plans.pipeline import apply_spec, ranked
from .plans.spec import GridSpec, Replace, Sort
from .shared import new_path
from .sources.reader import json_records, read_grid, table_rows
from .streaming.capture import accumulate, accumulated, first_wins, last_wins, looks_next, page_signature, pages_taken, scroll_stops
from .workbook import workbook_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def typed(grid: Grid, kinds: list[str]) -> DataFrame:
    return grid.df.select(*[F.col(c).cast(k).alias(h) for c, h, k in zip(grid.columns, grid.headers, kinds, strict=True)])


@query("select o_orderkey, o_totalprice, o_orderpriority from orders where o_orderpriority ilike '%urgent%' order by o_totalprice desc, o_orderkey limit 20")
def urgent_orders(spark, d):
    g = from_dataframe(read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), "o_orderkey")
    return typed(apply_spec(g, GridSpec(search="urgent", sort=Sort(1, "desc"), limit=20)), ["bigint", "double", "string"])


@query("select c_mktsegment as segment, c_custkey, c_name from customer")
def project_hide_rename_reorder(spark, d):
    g = from_dataframe(read(spark, d, "customer"), "c_custkey")
    return typed(apply_spec(g, GridSpec(hidden=frozenset({2, 3}), renames={4: "segment"}, order=(4,))), ["string", "bigint", "string"])


@query("select p_partkey, p_name, p_brand, p_type from part where p_name ilike '%re%' or p_brand ilike '%re%' or p_type ilike '%re%' or cast(p_partkey as varchar) ilike '%re%'")
def search_rows(spark, d):
    g = from_dataframe(read(spark, d, "part"), "p_partkey", ["p_partkey", "p_name", "p_brand", "p_type"])
    return typed(apply_spec(g, GridSpec(search="RE")), ["bigint", "string", "string", "string"])


@query("select n_nationkey, n_name from nation order by n_nationkey limit 7 offset 5")
def skip_limit(spark, d):
    g = from_dataframe(read(spark, d, "nation"), "n_nationkey", ["n_nationkey", "n_name"])
    return typed(apply_spec(g, GridSpec(skip_rows=5, limit=7)), ["int", "string"])


@query("select case when event_id % 3 = 0 then '' else event_type end as kind, case when event_id % 3 = 0 or event_id % 2 = 0 then '' else cast(user_id as varchar) end as who from events where event_id % 3 <> 0")
def drop_empty_rows_cols(spark, d):
    e = read(spark, d, "events").select("event_id", F.expr("if(event_id % 3 = 0, '', event_type)").alias("kind"), F.expr("if(event_id % 3 = 0 or event_id % 2 = 0, '  ', string(user_id))").alias("who"), F.lit("").alias("Column 3"))
    return apply_spec(from_dataframe(e, "event_id", ["kind", "who", "Column 3"]), GridSpec(drop_empty=True, trim_cells=True)).to_df()


@query("select l_orderkey, l_linenumber, cast(l_extendedprice as double) as price from lineitem order by price desc, l_orderkey * 10 + l_linenumber limit 50")
def typed_sort_topk(spark, d):
    x = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_orderkey", "l_linenumber", F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)).alias("price"))
    g = apply_spec(from_dataframe(x, "k", ["l_orderkey", "l_linenumber", "price"]), GridSpec(sort=Sort(2, "desc"), limit=50))
    return g.df.select(F.col("c0").cast("bigint").alias("l_orderkey"), F.col("c1").cast("int").alias("l_linenumber"), S.parse_number(F.col("c2")).alias("price"))


def with_rank(grid: Grid, kinds: list[str]) -> DataFrame:
    df = ranked(grid)
    return df.select("rank", *[F.col(c).cast(k).alias(h) for c, h, k in zip(grid.columns, grid.headers, kinds, strict=True)])


@query("select row_number() over (order by case when o_orderkey % 5 = 0 then null else o_custkey end desc nulls last, o_orderkey) as rank, o_orderkey, case when o_orderkey % 5 = 0 then '' else cast(o_custkey as varchar) end as cust from orders")
def sort_blanks_last_desc(spark, d):
    x = read(spark, d, "orders").select("o_orderkey", F.expr("if(o_orderkey % 5 = 0, '', string(o_custkey))").alias("cust"))
    return with_rank(apply_spec(from_dataframe(x, "o_orderkey"), GridSpec(sort=Sort(1, "desc"))), ["bigint", "string"])


@query("select row_number() over (order by c_custkey % 997, c_custkey) as rank, c_custkey, 'Cust ' || (c_custkey % 997) as label from customer")
def natural_sort_rank(spark, d):
    x = read(spark, d, "customer").select("c_custkey", F.concat(F.lit("Cust "), F.col("c_custkey") % 997).alias("label"))
    return with_rank(apply_spec(from_dataframe(x, "c_custkey"), GridSpec(sort=Sort(1))), ["bigint", "string"])


@query("select row_number() over (order by o_orderdate::date desc, o_orderkey) as rank, o_orderkey from orders")
def sort_dates(spark, d):
    date = F.col("o_orderdate")
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(date, "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format(date, "d MMMM yyyy")).otherwise(F.date_format(date, "M/d/yyyy"))
    g = apply_spec(from_dataframe(read(spark, d, "orders").select("o_orderkey", shown.alias("day")), "o_orderkey"), GridSpec(sort=Sort(1, "desc")))
    return with_rank(g, ["bigint", "string"]).select("rank", "o_orderkey")


@query("select event_id, last_value(case when event_id % 4 = 0 then event_type end ignore nulls) over (order by event_id rows unbounded preceding) as kind from events")
def fill_down(spark, d):
    x = read(spark, d, "events").select("event_id", F.expr("if(event_id % 4 = 0, event_type, '')").alias("kind"))
    g = apply_spec(from_dataframe(x, "event_id"), GridSpec(fill_down=(1,)))
    return g.df.select(F.col("c0").cast("bigint").alias("event_id"), F.nullif(F.col("c1"), F.lit("")).alias("kind"))


@query("select l_returnflag, l_linestatus, min(l_orderkey * 10 + l_linenumber) as first_row from lineitem group by 1, 2")
def dedupe_keep_first(spark, d):
    x = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_returnflag", "l_linestatus")
    g = apply_spec(from_dataframe(x, "k", ["l_returnflag", "l_linestatus"]), GridSpec(dedupe=True))
    return g.df.select(F.col("c0").alias("l_returnflag"), F.col("c1").alias("l_linestatus"), F.col(POS).alias("first_row"))


@query("select event_id, event_type from (select event_id, event_type, lag(event_type) over (order by event_id) as p from events) where p is null or p <> event_type")
def adjacent_dedupe_rows(spark, d):
    g = from_dataframe(read(spark, d, "events"), "event_id", ["event_type"])
    return adjacent_dedupe(g.df, g.columns).select(F.col(POS).alias("event_id"), F.col("c0").alias("event_type"))


@query("select o_orderkey, o_orderstatus from orders")
def merge_pages(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    pages = [from_dataframe(o.where(F.col("o_orderkey") % 3 == k), "o_orderkey") for k in range(3)]
    return typed(merge_tables([*pages, from_dataframe(o.select("o_orderkey"), "o_orderkey")]), ["bigint", "string"])


#: Forms of a price, by expressions that both dialects know: {p} has thousands and two decimals, {w} is whole; and the number each stands for.
NUMBER_FORMS = [("{p}", "price"), ("translate({p}, ',.', '.,')", "price"), ("'(' || {w} || ')'", "-whole"), ("'$' || {p}", "price"), ("{w} || '%'", "whole"), ("'abc' || {w}", "null"), ("''", "null"), ("'−' || {w}", "-whole"), ("'+' || {w}", "whole"), ("'R' || {w}", "whole"), ("{w} || 'e5'", "null"), ("'-+' || {w}", "-whole"), ("'+-' || {w}", "null"), ("'( ' || {w} || ' )'", "-whole"), ("{w} || ',5'", "whole + 0.5"), ("'€ ' || {w} || ',25'", "whole + 0.25"), ("{w} || '.1.2'", "null"), ("'1,2,' || {w}", "null"), ("'—' || {w}", "-whole"), ("'.' || {w}", "null")]


@query("with o as (select o_orderkey, round(o_totalprice, 2) as price, floor(o_totalprice)::bigint as whole from orders) select o_orderkey, case o_orderkey % " + str(len(NUMBER_FORMS) - 1) + " " + " ".join(f"when {i} then ({v})::double" for i, (_, v) in enumerate(NUMBER_FORMS[:-1])) + " end as value from o")
def parse_number(spark, d):
    forms = "case o_orderkey % " + str(len(NUMBER_FORMS) - 1) + " " + " ".join(f"when {i} then {f.format(p='p', w='w')}" for i, (f, _) in enumerate(NUMBER_FORMS[:-1])) + " end"
    o = read(spark, d, "orders").select("o_orderkey", F.format_number("o_totalprice", 2).alias("p"), F.floor("o_totalprice").cast("string").alias("w"))
    return o.select("o_orderkey", S.parse_number(F.expr(forms)).alias("value"))


@query("select l_orderkey, l_linenumber, l_extendedprice as price from lineitem")
def clean_values(spark, d):
    x = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("$ "), F.format_number("l_extendedprice", 2)).alias("price"))
    return x.select("l_orderkey", "l_linenumber", S.clean_value(F.col("price"), "currency").cast("double").alias("price"))


@query("select l_orderkey, l_linenumber, round(l_discount, 2) as discount from lineitem")
def percent_fraction(spark, d):
    x = read(spark, d, "lineitem").withColumn("p", F.concat(F.round(F.col("l_discount") * 100).cast("int"), F.lit("%")))
    return x.select("l_orderkey", "l_linenumber", F.round(S.clean_value(F.col("p"), "percent", percent_as_fraction=True).cast("double"), 2).alias("discount"))


@query("select doc_id, quality = 1 as quality, toxic = 1 as toxic from labels")
def boolean_clean(spark, d):
    g = from_dataframe(read(spark, d, "labels"), "doc_id", ["doc_id", "quality", "toxic"])
    return typed(apply_spec(g, GridSpec(clean_values=True)), ["bigint", "boolean", "boolean"])


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as iso from orders where o_orderkey % 4 <> 3 or day(o_orderdate) > 12")
def iso_dates(spark, d):
    o = read(spark, d, "orders")
    date = F.col("o_orderdate")
    shown = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(date, "yyyy-MM-dd HH:mm:ss")).when(F.col("o_orderkey") % 4 == 1, F.date_format(date, "d MMMM yyyy")).when(F.col("o_orderkey") % 4 == 2, F.date_format(date, "MMM d, yyyy")).otherwise(F.date_format(date, "dd/MM/yyyy"))
    return o.select("o_orderkey", S.iso_date(shown).alias("iso")).where("iso is not null")


@query("select l_orderkey, l_linenumber, regexp_replace(((case l_linenumber % 4 when 0 then -1 when 1 then 1 when 2 then 1000 else 0.5 end) * l_extendedprice)::varchar, '\\.0$', '') as text from lineitem")
def number_texts(spark, d):
    scaled = F.expr("double(case l_linenumber % 4 when 0 then -1 when 1 then 1 when 2 then 1000 else 0.5 end) * l_extendedprice")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.number_text(scaled).alias("text"))


@query("""with o as (select o_orderkey, o_orderkey % 8 as k, o_orderdate as t, day(o_orderdate) as day from orders)
select o_orderkey, k not in (6, 7) as is_date, case when k in (0, 1, 2, 3) or (k in (4, 5) and day > 12) then strftime(t, '%Y-%m-%d') end as iso from o""")
def date_forms(spark, d):
    t, k = F.col("o_orderdate"), F.col("o_orderkey") % 8
    forms = ["yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm", "d MMMM yyyy", "MMM d, yyyy", "M/d/yyyy", "dd.MM.yyyy"]
    raw = F.coalesce(*[F.when(k == i, F.date_format(t, f)) for i, f in enumerate(forms)], F.when(k == 6, F.date_format(t, "d. MMMM yyyy")).otherwise(F.concat(F.lit("on "), F.date_format(t, "yyyy-MM-dd"))))
    return read(spark, d, "orders").select("o_orderkey", S.looks_date(raw).alias("is_date"), S.iso_date(raw).alias("iso"))


@query("select page_id, page_id % 6 in (0, 1, 2, 3) as is_url from pages")
def url_forms(spark, d):
    url, bare = F.col("url"), F.regexp_replace("url", "^https?://", "")
    raw = F.expr("case page_id % 6 when 0 then url when 1 then 'www.' || bare when 2 then 'mailto:' || bare when 3 then upper(url) when 4 then 'ftp://' || bare else url || ' ' || bare end")
    return read(spark, d, "pages").select("page_id", url, bare.alias("bare")).select("page_id", S.looks_url(raw).alias("is_url"))


@query("select * from (values (0,'number'),(1,'number'),(2,'text'),(3,'number'),(4,'date'),(5,'text')) as t(column_index, type)")
def infer_types(spark, d):
    return inferred(from_dataframe(read(spark, d, "orders"), "o_orderkey"))


@query("""with x as (select *, case when l_orderkey % 4 = 1 then null else l_discount end as discount from lineitem)
select 0 as column_index, 'l_quantity' as header, count(*) as filled, 0::bigint as empty, least(count(distinct l_quantity), 10000) as "unique", min(l_quantity) as "min", max(l_quantity) as "max", round(sum(l_quantity), 2) as "sum", round(avg(l_quantity), 6) as mean from x
union all select 1, 'l_discount', count(discount), count(*) - count(discount), least(count(distinct discount), 10000), min(discount), max(discount), round(sum(discount), 2), round(avg(discount), 6) from x
union all select 2, 'l_returnflag', count(*), 0, least(count(distinct l_returnflag), 10000), null, null, null, null from x""")
def column_statistics(spark, d):
    blank = F.when(F.col("l_orderkey") % 4 != 1, F.col("l_discount"))
    x = read(spark, d, "lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber")).withColumn("l_discount", blank)
    out = column_stats(from_dataframe(x, "k", ["l_quantity", "l_discount", "l_returnflag"]), ("number", "number", "text"))
    return out.select("column_index", "header", "filled", "empty", "unique", "min", "max", F.round("sum", 2).alias("sum"), "mean")


@query("""select 0 as column_index, count(*) as filled, least(count(distinct l_orderkey), 10000) as "unique", min(l_orderkey)::double as "min", max(l_orderkey)::double as "max", sum(l_orderkey)::double as "sum" from lineitem
union all select 1, count(*), least(count(distinct l_extendedprice), 10000), min(l_extendedprice), max(l_extendedprice), round(sum(l_extendedprice), 2) from lineitem union all select 2, count(*), least(count(distinct l_suppkey), 10000), min(l_suppkey), max(l_suppkey), sum(l_suppkey) from lineitem""")
def capped_distinct(spark, d):
    """Columns far above and far below the count at which distinct values stop being told apart."""
    x = read(spark, d, "lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    out = column_stats(from_dataframe(x, "k", ["l_orderkey", "l_extendedprice", "l_suppkey"]), ("number", "number", "number"))
    return out.select("column_index", "filled", "unique", "min", "max", F.round("sum", 2).alias("sum"))


@query("""with e as (select *, event_id % 7 as day from events), a as (select count(*) as n, count(distinct user_id) as users, min(value) as lo, max(value) as hi from e)
select 0 as column_index, n as filled, 0::bigint as empty, true as close, null::double as "min", null::double as "max" from a union all select 1, n, 0, true, lo, hi from a""")
def merged_day_statistics(spark, d):
    """Statistics kept for each of seven days, merged without their rows; the estimate of distinct values beside the exact one."""
    e = read(spark, d, "events").select("event_id", F.concat(F.lit("user "), F.col("user_id")).alias("user"), F.col("value").cast("string").alias("value"))
    days = [column_sketches(from_dataframe(e.where(F.pmod("event_id", F.lit(7)) == k), "event_id", ["user", "value"]), ("text", "number")) for k in range(7)]
    merged = merged_sketches(reduce(DataFrame.unionAll, days))
    exact = e.agg(F.count_distinct("user").alias("u"), F.count_distinct("value").alias("v")).select(F.inline(F.array(F.struct(F.lit(0).alias("i"), F.col("u").alias("n")), F.struct(F.lit(1).alias("i"), F.col("v").alias("n")))))
    close = F.abs(F.col("unique") - F.col("n")) <= 0.08 * F.col("n")
    return merged.join(exact, F.col("column_index") == F.col("i")).select("column_index", "filled", "empty", close.alias("close"), "min", "max")


@query("select p_partkey, replace(p_brand, '#', ' no. ') as brand from part")
def find_replace_literal(spark, d):
    g = from_dataframe(read(spark, d, "part"), "p_partkey", ["p_partkey", "p_brand"], ["p_partkey", "brand"])
    return typed(apply_spec(g, GridSpec(replace=Replace("#", " no. "))), ["bigint", "string"])


@query(r"select p_partkey, regexp_replace(p_type, '([A-Z]+)$', '<\1>', 'gi') as kind from part")
def find_replace_regex(spark, d):
    g = from_dataframe(read(spark, d, "part").select("p_partkey", "p_type"), "p_partkey", headers=["p_partkey", "kind"])
    return typed(apply_spec(g, GridSpec(replace=Replace("([A-Z]+)$", "<$1>", regex=True))), ["bigint", "string"])


@query("select p_partkey, trim(p_name) as name from part")
def trim_cells(spark, d):
    x = read(spark, d, "part").select("p_partkey", F.concat(F.lit("\t  "), "p_name", F.lit(" ﻿\n")).alias("name"))
    return typed(apply_spec(from_dataframe(x, "p_partkey"), GridSpec(trim_cells=True)), ["bigint", "string"])


@query("select n_name as raw, 'nation_' || n_nationkey as snake, 'nation' || n_nationkey as camel, 'Nation ' || n_nationkey as title from nation union all select 'totalSales' || n_nationkey, 'total_sales_' || n_nationkey, 'totalSales' || n_nationkey, 'Total Sales ' || n_nationkey from nation")
def header_cases(spark, d):
    """The names of nations as the headers of a grid, in each case; a grid's headers are at the driver."""
    n = read(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()  # 25 rows
    names = [r.n_name for r in n] + [f"totalSales{r.n_nationkey}" for r in n]
    cased = {c: apply_spec(Grid(spark.range(0).select(F.col("id").alias(POS), *[F.lit("").alias(f"c{i}") for i in range(len(names))]), tuple(names), tuple(range(len(names)))), GridSpec(header_case=c, drop_empty=False)).headers for c in ("snake", "camel", "title")}
    return spark.createDataFrame(list(zip(names, *cased.values(), strict=True)), "raw string, snake string, camel string, title string")


@query("select 'r_name' as r_regionkey, max(case when r_regionkey = 0 then r_name end) as \"0\", max(case when r_regionkey = 1 then r_name end) as \"1\", max(case when r_regionkey = 2 then r_name end) as \"2\", max(case when r_regionkey = 3 then r_name end) as \"3\", max(case when r_regionkey = 4 then r_name end) as \"4\" from region")
def transpose_region(spark, d):
    return transposed(from_dataframe(read(spark, d, "region"), "r_regionkey")).to_df()


@query("select event_id, props from events")
def jsonl_union(spark, d):
    out, keys = json_records(read(spark, d, "events").select("event_id", "props"), "props", "event_id")
    pairs = F.concat_ws(", ", *[F.when(F.col(f"c{i}") != "", F.concat(F.lit(f'"{k}": '), F.when(F.col(f"c{i}").rlike(r"^-?[\d.]+$"), F.col(f"c{i}")).otherwise(F.concat(F.lit('"'), F.col(f"c{i}"), F.lit('"'))))) for i, k in enumerate(keys)])
    return out.select(F.col(POS).alias("event_id"), F.concat(F.lit("{"), pairs, F.lit("}")).alias("props"))


def round_trip(spark, d, fmt: str) -> DataFrame:
    """Customers written as files and read again as a user would."""
    g, path = from_dataframe(read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey"), new_path(spark, f"customers-{fmt}")
    sinks.write_grid(g, path, fmt, one_file=fmt in ("markdown", "json", "json-arrays", "html"))
    return typed(read_grid(spark, path, "json" if fmt == "json-arrays" else fmt), ["bigint", "string", "string"])


for _fmt in ("csv", "tsv", "markdown", "json", "json-arrays", "jsonl", "html"):

    def _trip(spark, d, fmt=_fmt):
        return round_trip(spark, d, fmt)

    QUERIES[f"roundtrip_{_fmt.replace('-', '_')}"] = _trip
    ORACLES[f"roundtrip_{_fmt.replace('-', '_')}"] = "select c_custkey, c_name, c_mktsegment from customer"


@query("select doc_id, case when regexp_matches(text, '^[=+@\\t\\r-]') and length(text) > 1 and not regexp_full_match(text, '-?[\\d.,]+') then chr(9) || text else text end as text, lang from documents")
def csv_with_newlines(spark, d):
    """Documents as one CSV file, whose quoted newlines leave it to be read by many tasks all the same."""
    path = new_path(spark, "documents-csv")
    sinks.write_grid(from_dataframe(read(spark, d, "documents").select("doc_id", "text", "lang"), "doc_id"), path, "csv", one_file=True)
    return typed(read_grid(spark, path, "csv"), ["bigint", "string", "string"])


@query("select event_id, event_type, coalesce(user_id::varchar, '') as user_id, props from events")
def json_list_of_events(spark, d):
    """Events as one JSON list in one file; its elements are found by depth, in as many tasks as the file has ranges."""
    path = new_path(spark, "events-json")
    sinks.write_grid(from_dataframe(read(spark, d, "events").select("event_id", "event_type", "user_id", "props"), "event_id"), path, "json", one_file=True)
    return typed(read_grid(spark, path, "json", whole_json=0), ["bigint", "string", "string", "string"])


# cells with everything that a format must take care of, by expressions that both dialects know
HAZARDS = {
    "k": "cast(p_partkey as string)",
    "name": "p_name || case p_partkey % 6 when 0 then '' when 1 then ' \"q\", x' when 2 then chr(10) || ' b|c' when 3 then ' ' || chr(92) || ' {5%} & ~^_$#' when 4 then ' <it' || chr(39) || 's>: 1' else ' é' end",
    "r n": "case when p_partkey % 7 = 3 then '' when p_partkey % 7 = 5 then '$' || p_size || '.50' else cast(p_size as string) end",
    "ok": "case p_partkey % 4 when 0 then 'yes' when 1 then 'NO' when 2 then 'maybe' else '' end",
}
HAZARD_TYPES = ("number", "text", "currency", "boolean")


def hazards(spark, d) -> Grid:
    x = read(spark, d, "part")
    return from_dataframe(x.select("p_partkey", *[F.expr(e).alias(n) for n, e in HAZARDS.items()]), "p_partkey", list(HAZARDS))


# r is the written number, null where empty; ok is a boolean's JSON form
_CELLS = "with t as (select p_partkey as pos, " + ", ".join(f'{e} as "{n.replace(" ", "_")}"' for n, e in HAZARDS.items()) + """ from part), typed as (select *, case when r_n = '' then null when r_n like '$%' then regexp_replace(substr(r_n, 2), '\\.?0+$', '') else r_n end as r, case ok when 'yes' then 'true' when 'NO' then 'false' when 'maybe' then null end as b from t) """


def exported(fmt: str, line: str, head: str = "", foot: str = "", extra: str = "typed", **options):
    """A query that gives all lines of a format, head and foot at -1 and -2, and its SQL."""

    def f(spark, d):
        out = sinks.lines_of(hazards(spark, d), fmt, HAZARD_TYPES, **options)
        ends = spark.createDataFrame([(-1, out.head), (-2, out.foot)], "pos long, line string")
        return out.rows.select(F.col(POS).alias("pos"), "line").unionAll(ends)

    f.__name__ = "export_" + fmt.replace("-", "_")
    quote = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '") + "'" if not x.startswith("select ") else f"({x})"
    QUERIES[f.__name__] = f
    ORACLES[f.__name__] = _CELLS + f"select pos, {line} as line from {extra} union all select -1, {quote(head)} union all select -2, {quote(foot)}"


def _sql_delimited(d: str) -> str:
    field = lambda c: f"""case when regexp_matches({c}, '[{d}"\n]') then '"' || replace({c}, '"', '""') || '"' else {c} end"""
    sep = f" || '{d}' || "
    return sep.join(["k", field("name"), field("r_n"), "ok"])


exported("csv", _sql_delimited(","), "k,name,r n,ok\r\n")
exported("tsv", _sql_delimited("\t"), "k\tname\tr n\tok\r\n")
_JSON = {"k": "k", "name": "to_json(name)::varchar", "r n": "coalesce(r, 'null')", "ok": "case when ok = 'maybe' then '\"maybe\"' else coalesce(b, 'null') end"}
exported("jsonl", "'{' || " + " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in _JSON.items()) + " || '}'")
exported("json", "'  {' || chr(10) || " + " || ',' || chr(10) || ".join(f"'    \"{k}\": ' || {v}" for k, v in _JSON.items()) + " || chr(10) || '  }'", "[\n", "]")
exported("json-arrays", "'  [' || chr(10) || " + " || ',' || chr(10) || ".join(f"'    ' || to_json({c})::varchar" for c in ("k", "name", "r_n", "ok")) + " || chr(10) || '  ]'", '[\n  [\n    "k",\n    "name",\n    "r n",\n    "ok"\n  ],\n', "]")
_XML = {"k": "k", "name": "replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')", "r_n": "coalesce(r, '')", "ok": "coalesce(b, ok)"}
exported("xml", "'  <row>' || chr(10) || " + " || chr(10) || ".join(f"'    <{k}>' || {v} || '</{k}>'" for k, v in _XML.items()) + " || chr(10) || '  </row>'", '<?xml version="1.0" encoding="UTF-8"?>\n<table>\n', "</table>\n")
exported("html", "'<tr><td>' || k || '</td><td>' || replace(" + _XML["name"] + ", '\"', '&quot;') || '</td><td>' || r_n || '</td><td>' || ok || '</td></tr>'", "<table>\n<thead>\n<tr><th>k</th><th>name</th><th>r n</th><th>ok</th></tr>\n</thead>\n<tbody>\n", "</tbody>\n</table>", full=False)
_INTO = "'INSERT INTO \"data\" (\"k\", \"name\", \"r_n\", \"ok\") VALUES' || chr(10)"
_VALUES = "'  (' || k || ', ''' || replace(name, '''', '''''') || ''', ' || coalesce(r, 'NULL') || ', ' || case when ok = 'maybe' then '''maybe''' else coalesce(upper(b), 'NULL') end || ')'"
exported("sql", f"case when n % 500 = 0 then {_INTO} else '' end || {_VALUES} || case when n % 500 = 499 or n = total - 1 then ';' || chr(10) else ',' end", 'CREATE TABLE "data" (\n  "k" NUMERIC,\n  "name" TEXT,\n  "r_n" NUMERIC,\n  "ok" BOOLEAN\n);\n\n', extra="(select *, row_number() over (order by pos) - 1 as n, count(*) over () as total from typed)")
_YAML = "case when contains(name, chr(10)) then '|-' || chr(10) || '    ' || replace(name, chr(10), chr(10) || '    ') when regexp_matches(name, '[:#\\-?{}\\[\\],&*!|>''\"%@`]') then '''' || replace(name, '''', '''''') || '''' else name end"
exported("yaml", f"'- k: ' || k || chr(10) || '  name: ' || {_YAML} || chr(10) || '  ''r n'': ' || coalesce(r, 'null') || chr(10) || '  ok: ' || case when ok = 'maybe' then ok else coalesce(b, 'null') end")
_TEX = "replace({0}, '\\', '\\textbackslash{{}}')"
for _a in "&%$#_{}":
    _TEX = f"replace({_TEX}, '{_a * 2 if _a in '{}' else _a}', '\\{_a * 2 if _a in '{}' else _a}')"
_TEX = f"replace(replace(replace({_TEX}, '~', '\\textasciitilde{{{{}}}}'), '^', '\\textasciicircum{{{{}}}}'), chr(10), ' ')".replace("{{{{}}}}", "{{}}")
exported("latex", " || ' & ' || ".join(_TEX.format(c) for c in ("k", "name", "r_n", "ok")) + r" || ' \\'", "\\begin{tabular}{rlrl}\n\\hline\n\\textbf{k} & \\textbf{name} & \\textbf{r n} & \\textbf{ok} \\\\\n\\hline\n", "\\hline\n\\end{tabular}")
_WIDE = "(select *, greatest({least}, length('k'), max(length(k)) over ())::int as wk, least(60, greatest({least}, length('name'), max(length(shown)) over ()))::int as wn, greatest({least}, 3, max(length(r_n)) over ())::int as wr, greatest({least}, 2, max(length(ok)) over ())::int as wo from (select *, {shown} as shown from typed))"
_PAD = {"k": "lpad({0}, wk, ' ')", "name": "shown || repeat(' ', wn - length(shown))", "r_n": "lpad({0}, wr, ' ')", "ok": "rpad({0}, wo, ' ')"}
_NAMES = ["lpad('k', wk, ' ')", "rpad('name', wn, ' ')", "lpad('r n', wr, ' ')", "rpad('ok', wo, ' ')"]
_MD, _TXT = _WIDE.format(least=3, shown="replace(replace(name, '|', '\\|'), chr(10), '<br>')"), _WIDE.format(least=0, shown="replace(name, chr(10), ' ')")
_RULE = {"md": " || ' | ' || ".join(["repeat('-', wk - 1) || ':'", "repeat('-', wn)", "repeat('-', wr - 1) || ':'", "repeat('-', wo)"]), "txt": " || '  ' || ".join(f"repeat('-', {w})" for w in ("wk", "wn", "wr", "wo"))}
exported("markdown", "'| ' || " + " || ' | ' || ".join(v.format(k) for k, v in _PAD.items()) + " || ' |'", f"select '| ' || {' || \' | \' || '.join(_NAMES)} || ' |' || chr(10) || '| ' || {_RULE['md']} || ' |' || chr(10) from {_MD} limit 1", extra=_MD)
exported("text", "rtrim(" + " || '  ' || ".join(v.format(k) for k, v in _PAD.items()) + ")", f"select rtrim({' || \'  \' || '.join(_NAMES)}) || chr(10) || {_RULE['txt']} || chr(10) from {_TXT} limit 1", extra=_TXT)


@query("select l_orderkey, l_linenumber, l_extendedprice, case when l_linenumber % 3 = 0 then '' else l_returnflag || ' <&\"> ' || l_orderkey end as note from lineitem")
def roundtrip_xlsx(spark, d):
    """Line items as a workbook of several sheets. It is packed in pieces, so its rows are written and read by many tasks."""
    x = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_orderkey", "l_linenumber", "l_extendedprice", F.expr("if(l_linenumber % 3 = 0, '', l_returnflag || ' <&\"> ' || l_orderkey)").alias("note"))
    path = new_path(spark, "lineitem") + ".xlsx"
    sinks.write_grid(from_dataframe(x, "k", ["l_orderkey", "l_linenumber", "l_extendedprice", "note"]), path, "xlsx", ("number", "number", "number", "text"), most_rows=25_000)
    rows = workbook_rows(spark, path)
    number = lambda c: F.regexp_extract("value", f'<c r="{c}[0-9]+" t="n"><v>([^<]*)', 1)
    note = F.regexp_extract("value", '<c r="D[0-9]+" t="inlineStr"><is><t xml:space="preserve">([^<]*)', 1)
    for sign, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("&", "&amp;")):
        note = F.replace(note, F.lit(name), F.lit(sign))
    return rows.select(number("A").cast("long").alias("l_orderkey"), number("B").cast("int").alias("l_linenumber"), number("C").cast("double").alias("l_extendedprice"), note.alias("note"))


@query("select c_nationkey as id, case c_nationkey % 7 when 0 then 'csv' when 1 then 'tsv' when 2 then 'csv' when 3 then 'json' when 4 then 'jsonl' when 5 then 'markdown' else 'html' end as format, count(*) as n from customer group by 1 having count(*) > 1")
def detect_formats(spark, d):
    """The customers of each nation as a text in one of the formats, which each text tells by itself."""
    c = read(spark, d, "customer").where("c_nationkey is not null").select("c_nationkey", "c_custkey", "c_name")
    kind = F.col("c_nationkey") % 7
    line = F.expr("""case c_nationkey % 7 when 0 then c_custkey || ',' || c_name when 1 then c_custkey || chr(9) || c_name || ', x' when 2 then c_custkey || ';' || c_name when 5 then '|' || c_custkey || '|' || c_name || '|'
        when 6 then '<tr><td>' || c_custkey || '<td>' || c_name || '</tr>' else '{"k":' || c_custkey || ',"name":"' || c_name || '"}' end""")
    texts = c.withColumn("line", line).groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("t"), F.count("*").alias("n")).where("n > 1")
    text = F.when(kind == 3, F.concat(F.lit("["), F.regexp_replace("t", "\n", ","), F.lit("]"))).when(kind == 5, F.concat(F.lit("|k|name|\n|-|-|\n"), "t")).when(kind == 6, F.concat(F.lit("<table><thead><tr><th>k<th>name</tr></thead>"), "t", F.lit("</table>"))).otherwise(F.col("t"))
    rows = table_rows(texts.select("c_nationkey", text.alias("text")), "c_nationkey", "text", has_header=None)
    return rows.where("not header").groupBy(F.col("id"), F.col("fmt").alias("format")).agg(F.count("*").alias("n"))


@query("select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey")
def html_span_fill(spark, d):
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    each = n.groupBy("r_regionkey", "r_name").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    first = F.concat(F.lit("<tr><td rowspan="), F.size("x").cast("string"), F.lit(">"), "r_name", F.lit("<td>"))
    body = F.array_join(F.transform("x", lambda y: F.concat(y["n_nationkey"].cast("string"), F.lit("</td><td>"), y["n_name"], F.lit("</td></tr>"))), "<tr><td>")
    page = each.select(F.col("r_regionkey").alias("id"), F.concat(F.lit("<table><thead><tr><th>r<th>k<th>n</thead><tbody>"), first, body, F.lit("</tbody></table>")).alias("text"))
    rows = table_rows(page, "id", "text", "html").where("not header")
    return rows.select(F.get("cells", F.lit(1)).cast("int").alias("n_nationkey"), F.get("cells", F.lit(2)).alias("n_name"), F.get("cells", F.lit(0)).alias("r_name"))


@query("select count(*) filter (html like '%<table%') as n_tables, count(*) filter (html not like '%<table%') as n_without from pages")
def html_pages_without_tables(spark, d):
    rows = table_rows(read(spark, d, "pages"), "page_id", "html", "html")
    return rows.where("header").agg(F.count_if(F.col("error").isNull()).alias("n_tables"), F.count_if(F.col("error").isNotNull()).alias("n_without"))


@query("""with b as (select p_partkey as id, p_size * 10.0 as l, (p_partkey % 100) * 10.0 as t from part),
p as (select x.id as target_id, y.id as box_id, greatest(0, least(x.l + 30, y.l + 50) - greatest(x.l, y.l)) * greatest(0, least(x.t + 20, y.t + 40) - greatest(x.t, y.t)) / 600.0 as coverage
from b x join b y on x.l < y.l + 50 and x.l + 30 > y.l and x.t < y.t + 40 and x.t + 20 > y.t where x.id % 50 = 0),
r as (select *, row_number() over (partition by target_id order by coverage desc, box_id) as rank from p)
select target_id, box_id, round(coverage, 6) as coverage, cast(rank as int) as rank from r where rank <= 3""")
def coverage_join(spark, d):
    b = read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 10.0).alias("left"), ((F.col("p_partkey") % 100) * 10.0).alias("top"))
    boxes = b.select(F.col("id").alias("box_id"), "left", "top", (F.col("left") + 50).alias("right"), (F.col("top") + 40).alias("bottom"))
    targets = b.where("id % 50 = 0").select(F.col("id").alias("target_id"), "left", "top", (F.col("left") + 30).alias("right"), (F.col("top") + 20).alias("bottom"))
    return best_boxes(boxes, targets).withColumn("coverage", F.round("coverage", 6))


_SIZED = "select p_partkey as id, power(10, p_partkey % 7)::double as w, power(10, (p_partkey // 7) % 7)::double as h, (p_partkey * 7919 % 100003) * 13.0 - 300000 as l, (p_partkey * 104729 % 99991) * 11.0 as t from part"


@query(f"""with x as ({_SIZED}), y as (select id, case when id % 2 = 0 then w else h end as w, h, l + 0.5 as l, t + 0.5 as t from x where id % 20 = 0),
p as (select y.id as target_id, x.id as box_id, (least(y.l + y.w, x.l + x.w) - greatest(y.l, x.l)) * (least(y.t + y.h, x.t + x.h) - greatest(y.t, x.t)) / (y.w * y.h) as coverage from x join y on x.l < y.l + y.w and x.l + x.w > y.l and x.t < y.t + y.h and x.t + x.h > y.t),
r as (select *, row_number() over (partition by target_id order by round(coverage, 9) desc, box_id) as rank from p) select target_id, box_id, round(coverage, 6) as coverage, rank::int as rank from r where rank <= 5""")
def coverage_join_of_all_sizes(spark, d):
    """Boxes with sides from 1 to 1,000,000 against targets with such sides."""
    p = read(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"))
    x = p.selectExpr("id", "power(10, id % 7) as w", "power(10, (id div 7) % 7) as h", "double((id * 7919 % 100003) * 13 - 300000) as l", "double((id * 104729 % 99991) * 11) as t")
    sides = lambda df, name: df.select(F.col("id").alias(name), F.col("l").alias("left"), F.col("t").alias("top"), (F.col("l") + F.col("w")).alias("right"), (F.col("t") + F.col("h")).alias("bottom"))
    y = x.where("id % 20 = 0").selectExpr("id", "if(id % 2 = 0, w, h) as w", "h", "l + 0.5 as l", "t + 0.5 as t")
    return best_boxes(sides(x, "box_id"), sides(y, "target_id"), keep=5).withColumn("coverage", F.round("coverage", 6))


@query("select n_regionkey, n_nationkey, n_name from nation")
def region_rebuild(spark, d):
    n = read(spark, d, "nation")
    cells = F.array(*[F.struct(F.lit(i).alias("k"), F.col(c).cast("string").alias("text")) for i, c in enumerate(("n_nationkey", "n_name"))])
    items = n.select(F.col("n_regionkey").cast("string").alias("region_id"), (F.col("n_nationkey") * 20.0).alias("top"), F.inline(cells))
    items = items.select("region_id", "text", (F.col("k") * 100.0).alias("left"), "top", (F.col("k") * 100.0 + 60).alias("right"), (F.col("top") + 12).alias("bottom"))
    return rebuild(items).select(F.col("region_id").cast("int").alias("n_regionkey"), F.get("cells", F.lit(0)).cast("int").alias("n_nationkey"), F.get("cells", F.lit(1)).alias("n_name"))


@query("select user_id, arg_max(event_type, event_id) as event_type, max(event_id) as event_id from events group by 1")
def accumulate_last_wins(spark, d):
    return last_wins(read(spark, d, "events"), "user_id", "event_id", ["event_type", "event_id"])


@query("select event_type, user_id, min(event_id) as event_id from events group by 1, 2")
def accumulate_first_wins(spark, d):
    return first_wins(read(spark, d, "events"), ["event_type", "user_id"], "event_id")


@query("select cast(o_orderkey as bigint) as k, last_value(case when o_orderkey % 7 = 0 then o_orderstatus end ignore nulls) over (order by o_orderkey rows unbounded preceding) as last_status from orders")
def carry_last(spark, d):
    g = read(spark, d, "orders").select(F.col("o_orderkey").alias(POS), "o_orderstatus")
    return carried_last(g, {"last_status": F.when(F.col(POS) % 7 == 0, F.col("o_orderstatus"))}).select(F.col(POS).alias("k"), "last_status")


@query("select n_regionkey as table_id, n_nationkey % 5 as r, 1 as c, n_name as text from nation where n_nationkey % 5 between 1 and 3")
def slice_region(spark, d):
    n = read(spark, d, "nation")
    both = F.array(F.struct(F.lit(0).alias("c"), F.col("n_nationkey").cast("string").alias("text")), F.struct(F.lit(1).alias("c"), F.col("n_name").alias("text")))
    cells = n.select(F.col("n_regionkey").alias("table_id"), (F.col("n_nationkey") % 5).alias("r"), F.inline(both))
    cells = cells.withColumns({"left": F.col("c") * 100.0, "right": F.col("c") * 100.0 + 100, "top": F.col("r") * 20.0, "bottom": F.col("r") * 20.0 + 20, "col_span": F.lit(1), "header": F.lit(False)})
    box = read(spark, d, "region").select(F.col("r_regionkey").alias("table_id"), F.lit(90.0).alias("left"), F.lit(15.0).alias("top"), F.lit(300.0).alias("right"), F.lit(75.0).alias("bottom"))
    return slice_tables(cells, box).select("table_id", "r", "c", "text")


LABELS = [("Next ›", True), ("next", True), ("Next page →", True), ("›", True), ("»", True), ("Load more…", True), ("Show more", True), ("Previous", False), ("‹ Prev", False), ("Page 2 of 3", False), ("", False)]


@query("select c_custkey, case c_custkey % " + str(len(LABELS) + 1) + " " + " ".join(f"when {i} then {str(b).lower()}" for i, (_, b) in enumerate(LABELS)) + " else false end as is_next from customer")
def next_labels(spark, d):
    """A control for each customer: one of the labels, or the customer's name."""
    label = F.coalesce(F.get(F.lit([a for a, _ in LABELS]), (F.col("c_custkey") % (len(LABELS) + 1)).cast("int")), F.col("c_name"))
    return read(spark, d, "customer").select("c_custkey", looks_next(label).alias("is_next"))


@query("select user_id, max(event_id) as event_id, max_by(event_type, event_id) as event_type from events group by user_id")
def streamed_upsert(spark, d):
    """Events in ten batches, out of order and the first of them twice, as a stream of upserts by user."""
    root = new_path(spark, "upserts")
    e = read(spark, d, "events").select("user_id", "event_id", "event_type")
    for k in (7, 2, 9, 0, 5, 1, 8, 3, 6, 4, 7):
        e.where(F.pmod("event_id", F.lit(10)) == k).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    accumulate(stream, f"{root}/table", "user_id", "event_id", ["event_type"], f"{root}/checkpoint").awaitTermination()
    return accumulated(spark, f"{root}/table", "user_id", "event_id", ["event_type"])


@query("select conv_id, count(*) || '|' || substr(min(text), 1, 120) as signature from conversations group by 1")
def page_signatures(spark, d):
    pages = read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.min("text").alias("text"))
    return pages.select("conv_id", page_signature(F.col("text"), F.col("n")).alias("signature"))


_STEPS = """select user_id as capture_id, row_number() over w as step, (event_id % 7) // 3 as gain, event_id % 5 = 0 as still, event_id % 97 = 1 as asked_to_stop from events window w as (partition by user_id order by event_id)"""
_WALK = f"""with recursive s as ({_STEPS}), walk as (
select capture_id, 0::bigint as step, 0::bigint as scrolls, 0::bigint as rows, 0::bigint as top, 0::bigint as stalls, 0::bigint as stuck, null::varchar as reason from s where step = 1
union all select capture_id, step, case when asked_to_stop or (still and (top >= 396 or stuck >= 2)) then scrolls else scrolls + 1 end, case when asked_to_stop then rows else rows + gain end, case when still then top else top + 100 end,
case when gain = 0 and step > 1 then stalls + 1 else 0 end, case when still then stuck + 1 else 0 end,
case when asked_to_stop then 'asked' when still and top >= 396 then 'end' when still and stuck >= 2 then 'stuck' when gain = 0 and step > 1 and stalls >= 3 then 'stalled' end
from (select w.*, x.step as next_step, x.gain, x.still, x.asked_to_stop from walk w join s x on x.capture_id = w.capture_id and x.step = w.step + 1 where w.reason is null) as t(capture_id, old_step, scrolls, rows, top, stalls, stuck, reason_before, step, gain, still, asked_to_stop))
select capture_id, scrolls, coalesce(reason, 'open') as reason, coalesce(reason, 'open') not in ('asked', 'open') as complete, coalesce(reason, '') = 'asked' as stopped from walk qualify row_number() over (partition by capture_id order by step desc) = 1"""


@query(_WALK)
def scroll_walks(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    s = read(spark, d, "events").select(F.col("user_id").alias("capture_id"), F.row_number().over(w).alias("step"), F.floor(F.col("event_id") % 7 / 3).alias("gain"), (F.col("event_id") % 5 == 0).alias("still"), (F.col("event_id") % 97 == 1).alias("asked_to_stop"))
    upto = Window.partitionBy("capture_id").orderBy("step")
    s = s.withColumn("rows", F.sum("gain").over(upto)).withColumn("moved_to", F.sum(F.when(F.col("still"), 0).otherwise(100)).over(upto))
    s = s.withColumns({"moved_from": F.col("moved_to") - F.when(F.col("still"), 0).otherwise(100), "viewport": F.lit(600), "height": F.lit(1000)})
    return scroll_stops(s).select("capture_id", "scrolls", "reason", "complete", "stopped")


_PAGES = "select conv_id as capture_id, turn as page, role as signature, length(text) % 9 as rows, (conv_id + turn) % 6 <> 0 as has_next, (conv_id * 7 + turn) % 11 = 0 as asked_to_stop from conversations"
_TAKEN = f"""with recursive p as (select *, row_number() over (partition by capture_id order by page) as k from ({_PAGES})), walk as (select capture_id, page, k, signature, rows, has_next, asked_to_stop from p where k = 1
union all select x.capture_id, x.page, x.k, x.signature, x.rows, x.has_next, x.asked_to_stop from walk w join p x on x.capture_id = w.capture_id and x.k = w.k + 1 where w.has_next and not w.asked_to_stop and x.signature <> w.signature and x.rows > 0 and x.k <= 100)
select w.capture_id, w.page, max(not l.asked_to_stop and (not l.has_next or n.k is not null)) over (partition by w.capture_id) as complete
from walk w join (select * from walk qualify row_number() over (partition by capture_id order by k desc) = 1) l on l.capture_id = w.capture_id left join p n on n.capture_id = l.capture_id and n.k = l.k + 1"""


@query(_TAKEN)
def paged_walks(spark, d):
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("capture_id"), F.col("turn").alias("page"), F.col("role").alias("signature"), (F.length("text") % 9).alias("rows"), ((F.col("conv_id") + F.col("turn")) % 6 != 0).alias("has_next"), ((F.col("conv_id") * 7 + F.col("turn")) % 11 == 0).alias("asked_to_stop"))
    return pages_taken(c).select("capture_id", "page", "complete")


@query("""select c_custkey as capture_id, min(n_nationkey) as nth from customer join nation on n_regionkey = c_nationkey % 5 and 2 + n_nationkey % 4 = 2 + c_custkey % 7 group by 1""")
def refound_tables(spark, d):
    tables = read(spark, d, "nation").select(F.col("n_regionkey").alias("page_id"), F.col("n_nationkey").alias("nth"), (2 + F.col("n_nationkey") % 4).cast("int").alias("columns"))
    captures = read(spark, d, "customer").select(F.col("c_custkey").alias("capture_id"), (F.col("c_nationkey") % 5).alias("page_id"), (2 + F.col("c_custkey") % 7).cast("int").alias("columns"))
    return refound(tables, captures).select("capture_id", "nth")


@query("""with x as (select n_regionkey as e, n_nationkey as k, n_name as name from nation)
select e::bigint as element_id, case e when 0 then 'registry' when 1 then 'layout' when 2 then 'text' else 'table' end as how, k::varchar || '|' || name as line from x where e < 4""")
def readings_of_elements(spark, d):
    n = read(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("element_id"), F.col("n_nationkey").cast("string").alias("k"), F.col("n_name").alias("name"))
    registry = n.where("element_id = 0").select("element_id", F.lit(False).alias("header"), F.col("k").cast("int").alias("r"), F.array("k", "name").alias("cells"))
    cells = F.array(*[F.struct(F.lit(i * 100.0).alias("left"), F.col(c).alias("text")) for i, c in enumerate(("k", "name"))])
    items = n.where("element_id in (0, 1, 3)").select("element_id", (F.col("k").cast("double") * 20).alias("top"), F.inline(cells))
    items = items.select("element_id", "text", "left", "top", (F.col("left") + 60).alias("right"), (F.col("top") + 12).alias("bottom"))
    rows = n.groupBy("element_id").agg(F.sort_array(F.collect_list(F.struct("k", "name"))).alias("x"))
    table = F.concat(F.lit("<div><table><tr><td>"), F.array_join(F.transform("x", lambda y: F.concat(y["k"], F.lit("</td><td>"), y["name"])), "</td></tr><tr><td>"), F.lit("</td></tr></table></div>"))
    text = F.array_join(F.transform("x", lambda y: F.concat(y["k"], F.lit(","), y["name"])), "\n")
    elements = rows.select("element_id", F.when(F.col("element_id") == 3, table).otherwise("<p>x</p>").alias("html"), F.when(F.col("element_id") == 2, text).when(F.col("element_id") == 4, "no table here").otherwise("").alias("text"))
    return readings(elements, registry, items).where("not header").select("element_id", "how", F.array_join("cells", "|").alias("line"))


@query("""with b as (select p_partkey as box_id, (p_partkey % 13) * 40.0 as l, p_size * 10.0 as t from part where p_partkey % 50 = 0), t as (select p_partkey as table_id, (p_partkey % 17) * 30.0 as l, p_size * 12.0 as t, p_partkey % 3 = 0 as grid, p_partkey % 5 as rows from part),
m as (select b.box_id, t.table_id, t.grid, t.rows, greatest(0, least(b.l + 50, t.l + 60) - greatest(b.l, t.l)) * greatest(0, least(b.t + 40, t.t + 30) - greatest(b.t, t.t)) as a from b join t on b.l < t.l + 60 and b.l + 50 > t.l and b.t < t.t + 30 and b.t + 40 > t.t),
r as (select *, row_number() over (partition by box_id order by a desc, table_id) as rank from m), k as (select * from r where rank <= 3 and rows > 0),
every as (select box_id, 2 * rank + 1 as p, case when grid then 'grid' else 'table' end as kind, table_id from k union all select box_id, 2 * rank, 'slice', table_id from k where a / 1800.0 < 0.92 and not grid and table_id % 2 = 0 union all select box_id, 8, 'layout', null from b where box_id % 4 = 0)
select box_id, kind, table_id, row_number() over (partition by box_id order by p) as nth from every""")
def box_candidates(spark, d):
    p = read(spark, d, "part")
    boxes = p.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("box_id"), (F.col("p_partkey") % 13 * 40.0).alias("left"), (F.col("p_size") * 10.0).alias("top"))
    boxes = boxes.withColumns({"right": F.col("left") + 50, "bottom": F.col("top") + 40})
    tables = p.select(F.col("p_partkey").alias("table_id"), (F.col("p_partkey") % 17 * 30.0).alias("left"), (F.col("p_size") * 12.0).alias("top"), (F.col("p_partkey") % 3 == 0).alias("grid"), (F.col("p_partkey") % 5).alias("rows"), F.lit(2).alias("columns"))
    tables = tables.withColumns({"right": F.col("left") + 60, "bottom": F.col("top") + 30})
    met = best_boxes(tables.withColumnRenamed("table_id", "box_id"), boxes.withColumnRenamed("box_id", "target_id")).select(F.col("target_id").alias("box_id"), F.col("box_id").alias("table_id"))
    slices = met.join(tables.select("table_id", "rows", "columns"), "table_id").withColumn("partial", F.col("table_id") % 2 == 0)
    layouts = boxes.select("box_id", F.lit(9).alias("items"), F.lit(3).alias("rows"), F.when(F.col("box_id") % 4 == 0, 2).otherwise(1).alias("columns"))
    return candidates(boxes, tables, slices, layouts).select("box_id", "kind", "table_id", "nth")


@query("select doc_id as region_id, turn as nth from (select conv_id as doc_id, turn, text, row_number() over (partition by conv_id order by turn) as k from conversations where turn % 3 <> 1 and turn < 7) where k <= 3")
def items_in_view(spark, d):
    c = read(spark, d, "conversations")
    items = c.select(F.col("conv_id").alias("region_id"), F.col("turn").alias("nth"), "text", F.lit(0.0).alias("left"), F.lit(90.0).alias("right"), (F.col("turn") * 10.0).alias("top"), (F.col("turn") * 10.0 + 9).alias("bottom"), (F.col("turn") % 3 != 1).alias("visible"))
    items = items.withColumns({"box_left": F.lit(0.0), "box_top": F.lit(-5.0), "box_right": F.lit(50.0), "box_bottom": F.lit(70.0)})
    return visible_items(items, limit=3).select("region_id", "nth")
