"""Type inference by vote, and column statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..grid import POS, Grid

#: Cells of a column that vote on its type, and the count at which distinct values stop being told apart.
VOTERS, DISTINCT_CAP = 200, 10_000
#: Rows that are looked at first for a column's voters.
HEAD = 2000


def long_form(grid: Grid) -> DataFrame:
    """(_pos, column_index, cell): one row a cell, without a shuffle."""
    cells = F.array(*[F.struct(F.lit(i).alias("column_index"), F.col(c).alias("cell")) for i, c in enumerate(grid.columns)])
    return grid.df.select(POS, F.inline(cells))


def votes(grid: Grid, columns: list[int]) -> dict[int, tuple[str, int]]:
    """(type, voters) of the given columns by their first cells; one bounded row a column comes back.

    The first cells are found by a rank limit that each task applies before the shuffle, so a column's cells never meet.
    """
    cells = long_form(grid).where(F.col("column_index").isin(columns)).withColumn("cell", S.trimmed(F.col("cell"))).where("cell != ''")
    first = cells.withColumn("nth", F.row_number().over(Window.partitionBy("column_index").orderBy(POS))).where(F.col("nth") <= VOTERS)
    c = F.col("cell")
    first = first.withColumns({"data": ~S.placeholder(c), "number": S.parse_number(c).isNotNull()})
    yes = lambda test: F.count_if(F.col("data") & test)
    number = F.col("number")
    counts = first.groupBy("column_index").agg(
        F.count("*").alias("voters"), F.count_if("data").alias("n"), yes(S.looks_boolean(c)).alias("boolean"), yes(S.looks_url(c)).alias("url"), yes(number).alias("number"), yes(S.looks_date(c)).alias("date"),
        yes(number & c.rlike(f"[{S.CURRENCY}]")).alias("sign"), yes(number & c.contains("%")).alias("percent"),
    )
    most = lambda name: F.col(name) >= 0.8 * F.col("n")
    half = lambda name: F.col(name) >= 0.5 * F.col("n")
    kind = (
        F.when(F.col("n") == 0, "text").when(most("boolean"), "boolean").when(most("url"), "url").when(most("number") & half("sign"), "currency").when(most("number") & half("percent"), "percent")
        .when(most("date") & ~most("number"), "date").when(most("number"), "number").otherwise("text")
    )
    return {r["column_index"]: (r["type"], r["voters"]) for r in counts.select("column_index", "voters", kind.alias("type")).collect()}


def infer_types(grid: Grid) -> tuple[str, ...]:
    """The type of each column, by vote of its first VOTERS cells; blanks and placeholders do not count.

    The first HEAD rows mostly tell; only columns with too few cells there are looked at as a whole.
    """
    head = grid.with_df(grid.df.orderBy(POS).limit(HEAD))
    every = list(range(len(grid.columns)))
    found = votes(head, every)
    short = [i for i in every if found.get(i, ("", 0))[1] < VOTERS]
    if short and len(grid.df.select(POS).limit(HEAD + 1).take(HEAD + 1)) > HEAD:
        found |= votes(grid, short)
    return tuple(found.get(i, ("empty", 0))[0] for i in every)


def inferred(grid: Grid) -> DataFrame:
    """(column_index, type) of each column."""
    return grid.df.sparkSession.createDataFrame(list(enumerate(infer_types(grid))), "column_index int, type string")


def column_stats(grid: Grid, types: tuple[str, ...] | None = None) -> DataFrame:
    """column_index, header, type, filled, empty, unique (capped), and min, max, sum, mean of columns with numbers.

    A first pass counts distinct cells by mergeable sketches, which tell the columns that are far above the cap: of those no
    values are told apart. In the others equal cells become one row with a count before any is parsed.
    """
    types = types or infer_types(grid)
    spark = grid.df.sparkSession
    about = spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(zip(grid.headers, types, strict=True))], "column_index int, header string, type string")
    if not grid.columns:
        return about.select("*", *[F.lit(0).cast("long").alias(c) for c in ("filled", "empty", "unique")], *[F.lit(None).cast("double").alias(c) for c in ("min", "max", "sum", "mean")])
    told = grid.df.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(S.trimmed(F.col(c)), F.lit(SKETCH_BITS))).alias(c) for c in grid.columns]).first()  # one row
    many = [i for i, c in enumerate(grid.columns) if (told[c] or 0) > SURELY_ABOVE * DISTINCT_CAP]
    few = [i for i in range(len(grid.columns)) if i not in many]
    cells = long_form(grid).select("column_index", S.trimmed(F.col("cell")).alias("t"))
    parts = []
    if few:
        parts.append(cells.where(F.col("column_index").isin(few)).groupBy("column_index", "t").agg(F.count("*").alias("n")))
    if many:
        parts.append(cells.where(F.col("column_index").isin(many)).withColumn("n", F.lit(1).cast("long")))
    stats = None
    for part, unique in zip(parts, [F.least(F.count("t"), F.lit(DISTINCT_CAP))] * bool(few) + [F.lit(DISTINCT_CAP)] * bool(many), strict=True):
        found = aggregated(part, types, unique)
        stats = found if stats is None else stats.unionAll(found)
    return about.join(stats, "column_index", "left").fillna({"filled": 0, "empty": 0, "unique": 0})


#: Rows of a distinct-count sketch as a power of two, which give an error of 1.6 % in one of three cases; and how far above the cap an estimate is proof.
SKETCH_BITS, SURELY_ABOVE = 12, 1.2


def aggregated(cells: DataFrame, types: tuple[str, ...], unique: Column, *more: Column) -> DataFrame:
    """Statistics of (column_index, t, n): cells that come n times."""
    numeric = [i for i, t in enumerate(types) if t in ("number", "currency", "percent")]
    value = F.when(F.col("column_index").isin(numeric), S.parse_number(F.col("t"))) if numeric else F.lit(None).cast("double")
    cells = cells.select("column_index", "n", F.nullif("t", F.lit("")).alias("t"), value.alias("v")).withColumn("d", F.col("v").try_cast("decimal(38,12)"))
    count, exact = F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.sum(F.col("d") * F.col("n").cast("decimal(20,0)")).cast("double")
    # numbers too large for a decimal are added as doubles
    total = F.when(F.count_if(F.col("d").isNull() & F.col("v").isNotNull()) > 0, F.sum(F.col("v") * F.col("n"))).otherwise(exact)
    return cells.groupBy("column_index").agg(
        F.sum(F.when(F.col("t").isNotNull(), F.col("n")).otherwise(0)).alias("filled"), F.sum(F.when(F.col("t").isNull(), F.col("n")).otherwise(0)).alias("empty"), unique.cast("long").alias("unique"),
        F.min("v").alias("min"), F.max("v").alias("max"), F.round(total, 6).alias("sum"), F.round(total / count, 6).alias("mean"), *more,
    )


def column_sketches(grid: Grid, types: tuple[str, ...]) -> DataFrame:
    """Statistics of a grid that can be merged with those of others, a row for each column: header, filled, empty, sketch (of its distinct cells, as bytes), min, max, sum, mean and numbers (how many cells are).

    Kept for each day or file, they give those of any span by ``merged_sketches`` without its rows.
    """
    about = grid.df.sparkSession.createDataFrame(list(enumerate(grid.headers)), "column_index int, header string")
    cells = long_form(grid).select("column_index", S.trimmed(F.col("cell")).alias("t"), F.lit(1).cast("long").alias("n"))
    found = aggregated(cells, types, F.lit(0), F.hll_sketch_agg("t", F.lit(SKETCH_BITS)).alias("sketch"), F.count("v").alias("numbers"))
    return about.join(found.drop("unique"), "column_index")


def merged_sketches(sketches: DataFrame) -> DataFrame:
    """Statistics over all grids whose sketches are given: unique is an estimate without a cap, off by 1.6 % in one of three cases."""
    total = F.sum(F.coalesce("sum", F.lit(0.0)))
    return sketches.groupBy("column_index", "header").agg(
        F.sum("filled").alias("filled"), F.sum("empty").alias("empty"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("unique"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.when(F.sum("numbers") > 0, F.round(total, 6)).alias("sum"), F.when(F.sum("numbers") > 0, F.round(total / F.sum("numbers"), 6)).alias("mean"),
    )
