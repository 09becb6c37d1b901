"""Putting grids together and turning them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..grid import POS, Grid, bucketed, unique_names


def adjacent_dedupe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Without rows that equal the row right before them. Buckets work side by side; each is handed the last row before it."""
    rows = bucketed(df).withColumn("_row", F.struct(*columns))
    within = Window.partitionBy("_bucket").orderBy(POS)
    ends = rows.groupBy("_bucket").agg(F.max_by("_row", POS).alias("_end"))
    ends = ends.select(F.col("_bucket").alias("_b"), F.lag("_end").over(Window.orderBy("_bucket")).alias("_end"))
    rows = rows.join(F.broadcast(ends), F.col("_bucket") == F.col("_b"))  # one row a bucket, of which there is a fixed number
    before = F.when(F.row_number().over(within) == 1, F.col("_end")).otherwise(F.lag("_row").over(within))
    return rows.withColumn("_before", before).where(F.col("_before").isNull() | ~F.col("_row").eqNullSafe(F.col("_before"))).select(*df.columns)


def merge_tables(grids: list[Grid]) -> Grid | None:
    """All rows under the first grid's headers, in the order of the grids; those of another width are skipped. Rows that repeat the one before go."""
    if not grids:
        return None
    base = grids[0]
    if len(grids) == 1:
        return base
    frames = [g.df.select(F.lit(i).alias("_src"), *g.df.columns) for i, g in enumerate(grids) if len(g.columns) == len(base.columns)]
    df = frames[0]
    for f in frames[1:]:
        df = df.union(f)
    df = df.withColumnRenamed(POS, "_at").orderBy("_src", "_at").withColumn(POS, F.monotonically_increasing_id()).drop("_src", "_at")
    return base.with_df(adjacent_dedupe(df, base.columns).select(*base.df.columns), merged_from=len(frames))


def transposed(grid: Grid, most_rows: int = 20_000) -> Grid:
    """Rows become columns: the header row joins the cells, the corner stays. The rows, now columns, must fit in a schema."""
    head = [r[0] for r in grid.df.orderBy(POS).select("c0" if "c0" in grid.columns else grid.columns[0]).limit(most_rows + 1).collect()]
    if len(head) > most_rows:
        raise ValueError(f"more than {most_rows} rows cannot become columns")
    places = [r[0] for r in grid.df.orderBy(POS).select(POS).collect()]
    rest = grid.columns[1:]
    cells = F.array(*[F.struct(F.lit(i).alias("r"), F.col(c).alias("v")) for i, c in enumerate(rest)])
    turned = grid.df.select(POS, F.inline(cells)).groupBy("r").pivot(POS, places).agg(F.first("v"))
    names = grid.df.sparkSession.createDataFrame([(i, grid.headers[i + 1]) for i in range(len(rest))], "i int, name string")
    out = names.join(turned, F.col("i") == F.col("r"), "left").select(F.col("i").cast("long").alias(POS), F.col("name").alias("c0"), *[F.coalesce(F.col(f"`{p}`"), F.lit("")).alias(f"c{k}") for k, p in enumerate(places, 1)])
    return replace(grid, df=out, headers=tuple(unique_names([grid.headers[0], *head])), sources=tuple([None] * (1 + len(head))), types=None)
