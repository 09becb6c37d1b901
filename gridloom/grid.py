"""A grid: a DataFrame of string cells in order, with display headers beside it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions.scalar import number_text

POS = "_pos"
#: Buckets of rows that ordered operations work on side by side, and rows from which on buckets that follow one another are a task of their own.
BUCKETS, TASK_ROWS = 256, 25_000


@dataclass(frozen=True)
class Grid:
    """Cells are strings, '' the only missing value; columns c0, c1, … are physical names, headers may repeat."""

    df: DataFrame
    headers: tuple[str, ...]
    sources: tuple[int | None, ...] = ()
    caption: str = ""
    types: tuple[str, ...] | None = field(default=None, compare=False)
    pattern_error: str | None = None
    merged_from: int = 1
    in_order: bool = field(default=False, compare=False)  # whether the rows lie in the order of positions, from partition to partition and in each
    steady: bool = field(default=False, compare=False)  # whether positions come from a column, so that they are the same when rows are worked out again

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != POS]

    def with_df(self, df: DataFrame, **more) -> Grid:
        return replace(self, **{"df": df, "in_order": False, "steady": False, **more})

    def to_df(self, names: list[str] | None = None) -> DataFrame:
        """Cells under their display headers (which must not repeat) or the given names."""
        names = names or list(self.headers)
        return self.df.select(*[F.col(c).alias(n) for c, n in zip(self.columns, names, strict=True)])

    def preview(self, n: int = 500) -> list[tuple]:
        return [tuple(r) for r in self.df.orderBy(POS).limit(n).drop(POS).collect()]


def cell_text(c: Column, kind: str) -> Column:
    """The canonical text of a typed value: null is ''; doubles without trailing zeros."""
    if kind in ("double", "float"):
        return F.coalesce(number_text(c.cast("double")), F.lit(""))
    if kind.startswith(("array", "map", "struct")):
        return F.coalesce(F.to_json(c), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def from_dataframe(df: DataFrame, order_by: str | list[str], columns: list[str] | None = None, headers: list[str] | None = None, unique: bool = True) -> Grid:
    """A grid of a typed DataFrame. Order comes from ``order_by``: one whole-number column is the position itself, else rows are sorted by range.

    ``unique`` says that such a column has no nulls and repeats no number; where it may, pass False and rows are numbered anew.
    """
    columns = columns or list(df.columns)
    kinds = dict(df.dtypes)
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    steady = len(keys) == 1 and kinds[keys[0]] in ("int", "bigint", "smallint", "tinyint") and unique
    if steady:
        placed = df.withColumn(POS, F.col(keys[0]).cast("long"))
    else:
        placed = df.orderBy(*keys).withColumn(POS, F.monotonically_increasing_id())
    cells = [cell_text(F.col(c), kinds[c]).alias(f"c{i}") for i, c in enumerate(columns)]
    return Grid(placed.select(POS, *cells), tuple(headers or columns), tuple(range(len(columns))), steady=steady)


def unique_names(names: list[str]) -> list[str]:
    """Blank names become `Column i`, repeats get a number behind them."""
    seen: dict[str, int] = {}
    out = []
    for i, n in enumerate(names, 1):
        n = n.strip() or f"Column {i}"
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n} ({seen[n]})")
    return out


def bucketed(df: DataFrame, name: str = "_bucket") -> DataFrame:
    """Adds a bucket that grows with the position: bounds from quantiles, so that ordered windows need no single partition."""
    bounds = sorted(set(df.approxQuantile(POS, [i / BUCKETS for i in range(1, BUCKETS)], 0.002))) if BUCKETS > 1 else []
    if not bounds:
        return df.withColumn(name, F.lit(0))
    # by halves: a step forward wherever the bound before it is not above the position
    out, step = df.withColumn(name, F.lit(0)), 1 << len(bounds).bit_length() - 1
    while step:
        out = out.withColumn(name, F.col(name) + F.when(F.get(F.lit(bounds), F.col(name) + F.lit(step - 1)) <= F.col(POS), F.lit(step)).otherwise(F.lit(0)))
        step //= 2
    return out


def carried_last(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """For each name, the last non-null value at or before the row: within buckets, and carried over from the buckets before."""
    rows = bucketed(df)
    within = Window.partitionBy("_bucket").orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_v{i}": v for i, v in enumerate(values.values())})
    ends = rows.groupBy("_bucket").agg(*[F.max_by(f"_v{i}", F.when(F.col(f"_v{i}").isNotNull(), F.col(POS))).alias(f"_e{i}") for i in range(len(values))])
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("_bucket").alias("_b"), *[F.last(f"_e{i}", ignorenulls=True).over(before).alias(f"_c{i}") for i in range(len(values))])
    out = rows.join(F.broadcast(ends), F.col("_bucket") == F.col("_b"))  # at most BUCKETS rows
    out = out.withColumns({name: F.coalesce(F.last(f"_v{i}", ignorenulls=True).over(within), F.col(f"_c{i}")) for i, name in enumerate(values)})
    return out.select(*df.columns, *[n for n in values if n not in df.columns])


def numbered(df: DataFrame, name: str = "_n", in_order: bool = False) -> tuple[DataFrame, int]:
    """Adds the number of each row in the order of positions, from 0, and gives the number of rows: counts of partitions, then places within each.

    Rows are sorted first unless they lie ``in_order`` already, from partition to partition and in each. They stay on the
    executors' disks, so that both passes see the same places; a lost one is worked out again. Who has written the rows lets
    them go by ``released``.
    """
    held = (df if in_order else df.orderBy(POS)).persist(StorageLevel.DISK_ONLY)
    counts = {r["part"]: r["count"] for r in held.groupBy(F.spark_partition_id().alias("part")).count().collect()}  # one row a partition
    if not counts:
        return df.withColumn(name, F.lit(0).cast("long")), 0
    starts, total = [], 0
    for part in range(max(counts) + 1):
        starts.append(total)
        total += counts.get(part, 0)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    out = held.withColumn(name, F.get(F.lit(starts).cast("array<bigint>"), F.spark_partition_id()) + place)
    out.held = held
    return out, total


def numbered_in_ranges(df: DataFrame, name: str = "_n") -> tuple[DataFrame, int, dict[str, int]]:
    """Adds the number of each row in the order of positions, from 0, and gives the number of rows and the length of each column's longest cell.

    Buckets of positions are counted, then each task sorts those that follow one another. Rows are worked out once more instead of
    kept; if they then have other positions the numbers have gaps or repeat, which the caller must look for.
    """
    rows, cells = bucketed(df), [c for c in df.columns if c != POS]
    told = {r["_bucket"]: r for r in rows.groupBy("_bucket").agg(F.count("*").alias("_count"), *[F.max(F.length(c)).alias(c) for c in cells]).collect()}  # at most BUCKETS rows
    starts, task_of, total = [], [], 0
    for bucket in range(max(told, default=-1) + 1):
        if not starts or total - starts[-1] >= TASK_ROWS:
            starts.append(total)
        task_of.append(len(starts) - 1)
        total += told[bucket]["_count"] if bucket in told else 0
    longest = {c: max((r[c] or 0 for r in told.values()), default=0) for c in cells}
    if not total:
        return df.withColumn(name, F.lit(0).cast("long")), 0, longest
    tasks = rows.withColumn("_task", F.get(F.lit(task_of), F.col("_bucket"))).drop("_bucket").repartitionById(len(starts), "_task").sortWithinPartitions(POS)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return tasks.withColumn(name, F.get(F.lit(starts).cast("array<bigint>"), F.col("_task")) + place).drop("_task"), total, longest


def released(df: DataFrame) -> None:
    """Lets go what ``numbered`` has kept for these rows."""
    if hasattr(df, "held"):
        df.held.unpersist()
