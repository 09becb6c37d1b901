"""Captures that arrive bit by bit: upserts by row index, first-seen rows by content, pages in order."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import kept
from ..sources.html import ROW_INDEX_ATTRIBUTES, Options
from ..sources.pages import numbered_rows, page_candidates, page_tables

# fixed values: what a control to the next page says, bare of its arrows
NEXT_LABELS = ("next", "next page", "older", "load more", "show more", "view more", "more results")
_ARROWS = "›»→⟩>▶❯"


def looks_next(label: Column) -> Column:
    """Whether a control's label leads to the next page: one of the known phrases around arrows and dots, or arrows alone."""
    plain = F.trim(F.regexp_replace(F.coalesce(label, F.lit("")), r"(?U)\s+", " "))
    bare = F.trim(F.regexp_replace(F.regexp_replace(plain, f"[{_ARROWS}]+", " "), "[.…]+$", ""))
    return plain.rlike(f"^[{_ARROWS}]+$") | F.lower(F.regexp_replace(bare, " +", " ")).isin(*NEXT_LABELS)


def row_index(attributes: Column) -> Column:
    """The row number that an element's attributes (a map) give: the first of the known ones that holds a number."""
    return F.coalesce(*[F.element_at(attributes, F.lit(a)).try_cast("double") for a in ROW_INDEX_ATTRIBUTES]).cast("long")


def last_wins(rows: DataFrame, index: str, arrival: str, values: list[str]) -> DataFrame:
    """One row an index: the values that arrived last. Partial aggregation keeps hot indices small."""
    return rows.groupBy(index).agg(F.max_by(F.struct(*values), arrival).alias("v")).select(index, *[F.col(f"v.{c}").alias(c) for c in values])


def first_wins(rows: DataFrame, keys: list[str], arrival: str, header: list[str] | None = None) -> DataFrame:
    """Distinct rows by content with their first arrival; rows that repeat the header go."""
    if header:
        rows = rows.where(~F.array(*[F.col(k).cast("string") for k in keys]).eqNullSafe(F.lit(header)))
    return rows.groupBy(*keys).agg(F.min(arrival).alias(arrival))


def page_signature(text: Column, count: Column) -> Column:
    return F.concat(count.cast("string"), F.lit("|"), F.substring(text, 1, 120))


#: Runs of one level that are merged into one of the next.
FAN = 8


def _manifest(spark, path: str, n: int | None = None) -> tuple[int, list[list]]:
    """The number of the newest batch up to ``n`` that is done, and its runs: level and name. -1 and none before the first."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/done")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
    done = max((int(x) for x in names if x.isdigit() and (n is None or int(x) <= n)), default=-1)
    return (done, json.loads(spark.read.text(f"{path}/done/{done}", wholetext=True).first()[0])) if done >= 0 else (-1, [])


def _commit(spark, path: str, n: int, runs: list[list]) -> None:
    """Makes the runs those of the table, at one blow; runs that only older batches name go."""
    made = spark._jvm.org.apache.hadoop.fs.Path
    fs = made(path).getFileSystem(spark._jsc.hadoopConfiguration())
    before = {name for _, name in _manifest(spark, path, n - 1)[1]}
    out = fs.create(made(f"{path}/done/_{n}"), True)
    out.write(json.dumps(runs).encode())
    out.close()
    fs.delete(made(f"{path}/done/{n}"), False)
    fs.rename(made(f"{path}/done/_{n}"), made(f"{path}/done/{n}"))
    # the batch before stays readable, for a batch that runs again
    for run in fs.listStatus(made(f"{path}/runs")):
        if run.getPath().getName() not in before | {name for _, name in runs}:
            fs.delete(run.getPath(), True)
    for old in fs.listStatus(made(f"{path}/done")):
        if old.getPath().getName().isdigit() and int(old.getPath().getName()) < n - 1:
            fs.delete(old.getPath(), False)


def accumulate(stream: DataFrame, path: str, index: str, arrival: str, values: list[str], checkpoint: str, fan: int = FAN):
    """A streaming upsert: what an index was given last stays. Returns the started query; ``accumulated`` reads the table.

    Each batch writes a run of its own rows and reads nothing; as soon as ``fan`` runs of one level are there they are merged into
    one of the next. So a row is written once for each level, of which there are as many as the logarithm of the number of
    batches, and what a batch writes follows its own size. A batch that runs twice after a failure writes the same runs again.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, n: int) -> None:
        runs = _manifest(spark, path, n - 1)[1]

        def write(rows: DataFrame, level: int) -> None:
            last_wins(rows, index, arrival, [arrival, *values]).write.mode("overwrite").parquet(f"{path}/runs/{n}-{level}")
            runs.append([level, f"{n}-{level}"])

        write(batch, 0)
        level = 0
        while len(full := [name for k, name in runs if k == level]) >= fan:
            runs = [x for x in runs if x[0] != level]
            write(spark.read.parquet(*[f"{path}/runs/{name}" for name in full]), level + 1)
            level += 1
        _commit(spark, path, n, runs)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accumulated(spark: SparkSession, path: str, index: str, arrival: str, values: list[str]) -> DataFrame:
    """The table that ``accumulate`` keeps, as of its last batch: one row for each index."""
    runs = _manifest(spark, path)[1]
    if not runs:
        raise ValueError("no batch has been taken in yet")
    return last_wins(spark.read.parquet(*[f"{path}/runs/{name}" for _, name in runs]), index, arrival, [arrival, *values])


def captured(snapshots: DataFrame, options: Options | None = None) -> DataFrame:
    """What a walk down a virtual table has collected: capture_id, strategy, gained, r (from 0; the headers are row -1), cells.

    snapshots: capture_id, step, html - what the page showed at each step. Rows that bear a number are kept by it, the one seen last
    wins, in the order of numbers (strategy `row-index`, where any row bears one); else distinct rows of the first table of each
    step are kept as first seen, without those that repeat the headers (`content-dedupe`). A capture never gives fewer rows than
    its first step: one that has found no more comes back as that step showed it, with ``gained`` 0.
    """
    keyed = snapshots.select(F.struct("capture_id", "step").alias("page"), "html")
    found = kept(page_candidates(keyed, "page", "html", options), "candidates")  # pages are parsed once, and read for numbers and for tables
    own = ["page_id.capture_id", "page_id.step"]
    shown = page_tables(found, options).where("nth = 1").select(*own, "headers", "body")
    first = shown.groupBy("capture_id").agg(F.min_by("body", "step").alias("original"), F.max_by("headers", "step").alias("headers"), F.min_by("headers", "step").alias("first_headers"))
    # by number: the last step wins, in the order of numbers
    by_number = numbered_rows(found).select(*own, "index", "cells").groupBy("capture_id", "index").agg(F.max_by("cells", "step").alias("cells")).select("capture_id", F.lit(True).alias("numbered"), F.struct(F.lit(0).alias("step"), "index").alias("at"), "cells")
    body = shown.select("capture_id", "step", F.posexplode("body").alias("i", "cells"))
    by_content = body.groupBy("capture_id", "cells").agg(F.min(F.struct("step", F.col("i").cast("long").alias("index"))).alias("at")).join(first.select("capture_id", "first_headers"), "capture_id").where("cells <> first_headers").select("capture_id", F.lit(False).alias("numbered"), "at", "cells")
    rows = by_number.unionByName(by_content).groupBy("capture_id", "numbered").agg(F.array_sort(F.collect_list(F.struct("at", "cells"))).alias("rows"))
    best = rows.groupBy("capture_id").agg(F.max("numbered").alias("numbered"), F.max_by("rows", "numbered").alias("rows")).join(first, "capture_id")
    more = F.size("rows") > F.size("original")
    cells = F.when(more, F.transform("rows", lambda x: x["cells"])).otherwise(F.col("original"))
    strategy = F.when(F.col("numbered"), "row-index").otherwise("content-dedupe")
    out = best.select("capture_id", strategy.alias("strategy"), F.when(more, F.size("rows") - F.size("original")).otherwise(0).alias("gained"), F.when(more, F.col("headers")).otherwise(F.col("first_headers")).alias("headers"), cells.alias("cells"))
    lines = F.concat(F.array(F.struct(F.lit(-1).alias("r"), F.col("headers").alias("cells"))), F.transform("cells", lambda x, i: F.struct(i.alias("r"), x.alias("cells"))))
    return out.select("capture_id", "strategy", "gained", F.inline(lines))


def grown(original: int, collected: int) -> tuple[bool, int]:
    """Whether a capture is kept, and what it gained: one that found no more than was there is not."""
    return (True, collected - original) if collected > original else (False, 0)


#: When a walk down a table ends: steps, steps without a new row, steps without movement, pixels from the end that count as the end; pages.
MOST_STEPS, STALLED, STUCK, AT_END, MOST_PAGES = 600, 4, 3, 4, 100


def run_of(same: Column, walk: Window) -> Column:
    """How many rows in a row, this one included, ``same`` has held."""
    at = F.row_number().over(walk)
    return at - F.coalesce(F.max(F.when(~same, at)).over(walk.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))


def scroll_stops(steps: DataFrame) -> DataFrame:
    """(capture_id, scrolls, rows, reason, complete, stopped): where each walk down a table ends; a step that ends it by not moving is no scroll.

    steps: capture_id, step (from 1), rows (known after it), moved_from, moved_to, viewport, height, asked_to_stop. A walk ends when it is
    asked to, at the end of what scrolls, after STUCK steps without movement or STALLED steps without a new row, or after MOST_STEPS.
    ``complete`` says that nothing but the number of steps or a request ended it.
    """
    walk = Window.partitionBy("capture_id").orderBy("step")
    still = F.col("moved_to") == F.col("moved_from")
    end = still & (F.col("moved_to") + F.col("viewport") >= F.col("height") - AT_END)
    reason = (
        F.when(F.col("asked_to_stop"), "asked").when(end, "end").when(run_of(still, walk) >= STUCK, "stuck")
        .when(run_of(F.col("_same"), walk) >= STALLED, "stalled").when(F.col("step") >= MOST_STEPS, "steps")
    )
    told = steps.withColumn("_same", F.coalesce(F.col("rows") == F.lag("rows").over(walk), F.lit(False))).withColumn("reason", reason)
    last = F.coalesce(F.min(F.when(F.col("reason").isNotNull(), F.col("step"))).over(Window.partitionBy("capture_id")), F.max("step").over(Window.partitionBy("capture_id")))
    out = told.withColumn("_last", last).where("step = _last")
    why = F.coalesce("reason", F.lit("open"))
    return out.select("capture_id", (F.col("step") - why.isin("asked", "end", "stuck").cast("int")).alias("scrolls"), "rows", why.alias("reason"), (~why.isin("asked", "steps", "open")).alias("complete"), (why == "asked").alias("stopped"))


def pages_taken(pages: DataFrame) -> DataFrame:
    """The pages of each capture that a walk through them takes, with ``complete``: whether it came to their end.

    pages: capture_id, page (from 1), signature, rows, has_next (a control leads on), asked_to_stop. The walk ends before a page that it is
    asked not to turn to, after one without a control, before one whose signature is the last one's or that has no rows, and after MOST_PAGES.
    """
    walk = Window.partitionBy("capture_id").orderBy("page")
    before = lambda c: F.lag(c).over(walk)
    first = F.col("page") == F.min("page").over(Window.partitionBy("capture_id"))
    why = F.when(first, None).when(F.row_number().over(walk) > MOST_PAGES, "pages").when(F.coalesce(before("asked_to_stop"), F.lit(False)), "asked").when(~before("has_next"), "end").when(F.col("signature") == before("signature"), "end").when(F.col("rows") == 0, "end")
    told = pages.withColumn("_why", why)
    upto = F.min(F.when(F.col("_why").isNotNull(), F.col("page"))).over(Window.partitionBy("capture_id"))
    told = told.withColumn("_stop", upto).where(F.col("_stop").isNull() | (F.col("page") <= F.col("_stop")))
    last = F.max(F.struct("page", "_why", "has_next", "asked_to_stop")).over(Window.partitionBy("capture_id"))
    ended = F.when(last["_why"].isNotNull(), last["_why"] == "end").otherwise(~last["has_next"] & ~last["asked_to_stop"])
    return told.withColumn("complete", ended).where("_why is null").drop("_why", "_stop")


def accumulate_distinct(stream: DataFrame, keys: list[str], event_time: str | None = None, late: str = "1 hour") -> DataFrame:
    """First-seen rows of a stream; with an event time, state is dropped once rows are too late."""
    if event_time:
        return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)
