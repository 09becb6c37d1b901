"""Reading an element by the first way that gives a table: known tables, its markup, a grid of boxes, its layout, its text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.html import tables_of
from ..sources.text import parse_text
from .region import LAYOUT_ITEMS, rebuild

#: The ways in order of trust, and the length from which text is not read as delimited any more.
WAYS, LONGEST_TEXT = ("registry", "table", "grid", "layout", "text"), 400_000
ROWS = "element_id long, how string, header boolean, r int, cells array<string>"


def looked_up(registry: DataFrame, wanted: DataFrame, key: str = "table_id") -> DataFrame:
    """The rows of the tables that are asked for by id; ids that are not known give none."""
    return registry.join(wanted.select(key).distinct(), key, "left_semi")


def by_markup(batches):
    """The largest table of each element's markup, else its first grid of boxes, else its delimited text."""
    for batch in batches:
        out = []
        for i, html, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            found = tables_of(html or "")
            kind, table = max(found, key=lambda x: len(x[1].rows) * len(x[1].headers), default=(None, None))
            how = kind.kind if kind else ""
            if table is None and "\n" in (text or "").strip() and len(text) < LONGEST_TEXT:
                try:
                    table, how = parse_text(text.strip())[0], "text"
                except ValueError:
                    pass
                if table is not None and (not table.rows or len(table.headers) < 2):
                    table = None
            if table is not None:
                out.append((i, how, True, -1, table.headers))
                out += [(i, how, False, r, row) for r, row in enumerate(table.rows)]
        if out:
            types = [pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], ["element_id", "how", "header", "r", "cells"])


def readings(elements: DataFrame, registry: DataFrame, items: DataFrame) -> DataFrame:
    """(element_id, how, header, r, cells) of each element that can be read.

    elements: element_id, html, text; registry: element_id, header, r, cells of tables that are known already; items: element_id,
    text and sides of the text in view. Elements that nothing reads give no rows.
    """
    known = registry.select("element_id", F.lit("registry").alias("how"), "header", "r", "cells")
    marked = elements.select(F.col("element_id").cast("long"), F.col("html").cast("string"), F.col("text").cast("string")).mapInArrow(by_markup, ROWS)
    many = items.groupBy("element_id").agg(F.count("*").alias("n")).where(F.col("n") >= LAYOUT_ITEMS)
    laid = rebuild(items.join(many, "element_id", "left_semi").withColumnRenamed("element_id", "region_id"))
    wide = laid.groupBy("region_id").agg(F.max(F.size("cells")).alias("width"), F.count_if(~F.col("header")).alias("n")).where("width >= 2 and n >= 1")
    laid = laid.join(wide.select("region_id"), "region_id", "left_semi").select(F.col("region_id").cast("long").alias("element_id"), F.lit("layout").alias("how"), "header", "r", "cells")
    every = known.unionByName(marked).unionByName(laid).withColumn("_way", F.array_position(F.lit(list(WAYS)), F.col("how")))
    best = every.groupBy("element_id").agg(F.min("_way").alias("_best"))
    return every.join(best, "element_id").where("_way = _best").drop("_way", "_best")


def refound(tables: DataFrame, captures: DataFrame) -> DataFrame:
    """For each capture (capture_id, page_id, columns) whose element is gone, the first table (page_id, nth, columns) of its page that has as many columns."""
    same = captures.join(tables.withColumnRenamed("columns", "_columns"), "page_id").where("columns = _columns")
    return same.withColumn("_at", F.row_number().over(Window.partitionBy("capture_id").orderBy("nth"))).where("_at = 1").drop("_at", "_columns")
