"""The part of each table that a box covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A row or a column is kept if the box covers this share of its extent.
COVERED = 0.35


def share(low: str, high: str, box_low: Column, box_high: Column) -> Column:
    over = F.greatest(F.lit(0.0), F.least(F.col(high), box_high) - F.greatest(F.col(low), box_low))
    return over / F.greatest(F.lit(1.0), F.col(high) - F.col(low))


def slice_tables(cells: DataFrame, box: DataFrame) -> DataFrame:
    """(table_id, r, c, header, text, rows_total, columns_total, partial) of the kept cells.

    cells: table_id, r, c, text, left, top, right, bottom, col_span, header; box: table_id and sides, one row a table at most.
    Header rows are always kept and do not count; other rows without text in the kept columns go. Columns are measured by cells
    that span one column only and have a width; a column without such cells is kept.
    """
    sides = box.select(F.col("table_id").alias("t"), *[F.col(s).cast("double").alias(f"b_{s}") for s in ("left", "top", "right", "bottom")])
    placed = cells.join(sides, F.col("table_id") == F.col("t")).drop("t")
    edges = [F.first(f"b_{s}").alias(f"b_{s}") for s in ("left", "top", "right", "bottom")]
    rows = placed.groupBy("table_id", "r").agg(F.min("top").alias("lo"), F.max("bottom").alias("hi"), F.max("header").alias("head"), *edges)
    rows = rows.select(F.col("table_id").alias("rt"), F.col("r").alias("rr"), "head", (F.col("head") | (share("lo", "hi", F.col("b_top"), F.col("b_bottom")) >= COVERED)).alias("row_in"))
    alone = (F.col("col_span") == 1) & (F.col("right") > F.col("left"))
    columns = placed.groupBy("table_id", "c").agg(F.min(F.when(alone, F.col("left"))).alias("lo"), F.max(F.when(alone, F.col("right"))).alias("hi"), *edges)
    over = F.greatest(F.lit(0.0), F.least("hi", "b_right") - F.greatest("lo", "b_left")) / (F.col("hi") - F.col("lo"))
    columns = columns.select(F.col("table_id").alias("ct"), F.col("c").alias("cc"), (F.col("lo").isNull() | (over >= COVERED)).alias("column_in"))
    totals = rows.groupBy("rt").agg(F.count_if(~F.col("head")).alias("rows_total"), F.count_if(F.col("row_in") & ~F.col("head")).alias("rows_in"))
    widths = columns.groupBy("ct").agg(F.count("*").alias("columns_total"), F.count_if("column_in").alias("columns_in"))
    kept = placed.join(rows.where("row_in"), (F.col("table_id") == F.col("rt")) & (F.col("r") == F.col("rr"))).drop("rt", "rr")
    kept = kept.join(columns.where("column_in"), (F.col("table_id") == F.col("ct")) & (F.col("c") == F.col("cc"))).drop("ct", "cc")
    kept = kept.join(totals, F.col("table_id") == F.col("rt")).join(widths, F.col("table_id") == F.col("ct"))
    partial = (F.col("rows_in") < F.col("rows_total")) | (F.col("columns_in") < F.col("columns_total"))
    kept = kept.withColumn("_any", F.col("header") | F.max(F.col("text") != "").over(Window.partitionBy("table_id", "r"))).where("_any")
    return kept.select("table_id", "r", "c", "header", "text", "rows_total", "columns_total", partial.alias("partial"))
