"""Tables out of positioned text, a region at a time; and matching of boxes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..grid import POS, numbered
from ..shared import new_path
from ..sources.text import NUMERIC

SIDES = ("left", "top", "right", "bottom")


def upper_median(values: list[float]) -> float:
    return sorted(values)[len(values) // 2] if values else 0.0


def overlap(a0: float, a1: float, b0: float, b1: float) -> float:
    return max(0.0, min(a1, b1) - max(a0, b0))


def text_rows(items: list[dict], tolerance: float) -> list[list[dict]]:
    """Rows of items, top to bottom: an item joins the last row if they share half of the lower height, or their middles are near."""
    rows: list[tuple[float, float, list[dict]]] = []
    for x in sorted(items, key=lambda x: (x["top"], x["left"])):
        if rows:
            top, bottom, row = rows[-1]
            height = min(bottom - top, x["bottom"] - x["top"])
            near = abs((top + bottom) / 2 - (x["top"] + x["bottom"]) / 2) <= tolerance
            if near or (height > 0 and overlap(top, bottom, x["top"], x["bottom"]) >= 0.5 * height):
                rows[-1] = (min(top, x["top"]), max(bottom, x["bottom"]), [*row, x])
                continue
        rows.append((x["top"], x["bottom"], [x]))
    return [row for _, _, row in rows]


def best_band(bands: list[list[float]], x: dict) -> int:
    """The band that an item overlaps most, the first of equals; -1 for none."""
    shares = [overlap(b[0], b[1], x["left"], x["right"]) for b in bands]
    best = max(range(len(bands)), key=lambda i: (shares[i], -i), default=-1)
    return best if best >= 0 and shares[best] > 0 else -1


def column_bands(rows: list[list[dict]]) -> list[list[float]]:
    """Bands start from the first of the fullest rows; others widen them or add new ones; bands that overlap become one."""
    widest = max(rows, key=len)
    bands = [[x["left"], x["right"]] for x in sorted(widest, key=lambda x: x["left"])]
    for row in rows:
        for x in row:
            k = best_band(bands, x)
            if k < 0:
                bands.append([x["left"], x["right"]])
                bands.sort()
            elif sum(overlap(b[0], b[1], x["left"], x["right"]) > 0 for b in bands) == 1:
                bands[k] = [min(bands[k][0], x["left"]), max(bands[k][1], x["right"])]
    out: list[list[float]] = []
    for b in sorted(bands):
        if out and b[0] < out[-1][1] - 1:
            out[-1][1] = max(out[-1][1], b[1])
        else:
            out.append(b)
    return out


def synthesised(items: list[dict]) -> tuple[list[list[str]], float]:
    """Cells of the rows and bands, and the share of filled cells."""
    items = [x for x in items if (x["text"] or "").strip()]
    if not items:
        return [], 0.0
    rows = text_rows(items, max(3.0, 0.5 * upper_median([x["bottom"] - x["top"] for x in items])))
    bands = column_bands(rows)
    cells = [[""] * len(bands) for _ in rows]
    for r, row in enumerate(rows):
        for x in sorted(row, key=lambda x: x["left"]):
            k = max(0, best_band(bands, x))
            cells[r][k] = f"{cells[r][k]} {x['text'].strip()}".strip()
    used = [k for k in range(len(bands)) if any(row[k] for row in cells)]
    cells = [[row[k] for k in used] for row in cells]
    filled = sum(bool(c) for row in cells for c in row)
    return cells, filled / max(1, len(cells) * len(used))


#: Pieces of text that a region takes at most, the first ones in order: what one view of a page can hold.
ITEMS = 4000
#: A header of a region has no cell longer than this.
HEADER_CHARS = 60


def visible_items(items: DataFrame, order: str = "nth", limit: int = ITEMS) -> DataFrame:
    """The items (region_id, text, sides, visible, the region's box as box_left, ...) that are seen in their region: with text, a pixel wide and high, and inside its box in part; the first ``limit`` of each."""
    inside = S.intersects({c: F.col(c) for c in SIDES}, {c: F.col(f"box_{c}") for c in SIDES})
    seen = items.where(F.col("visible") & ~S.blank(F.col("text")) & (F.col("right") - F.col("left") >= 1) & (F.col("bottom") - F.col("top") >= 1) & inside)
    seen = seen.withColumn("text", S.trimmed(F.regexp_replace("text", rf"[{S.SPACES}]+", " ")))
    nth = F.row_number().over(Window.partitionBy("region_id").orderBy(order))
    return seen.withColumn("_nth", nth).where(F.col("_nth") <= limit).drop("_nth")


def heads(cells: list[list[str]]) -> bool:
    """Whether the first row is a header: no number in it, no long cell, and rows below."""
    return len(cells) > 1 and not any(c and NUMERIC.match(c) for c in cells[0]) and all(len(c) <= HEADER_CHARS for c in cells[0])


def rebuild(items: DataFrame, infer_headers: bool = True) -> DataFrame:
    """(region_id, header, r, cells, confidence) out of (region_id, text, left, top, right, bottom); regions are rebuilt side by side.

    A first row of short labels without numbers is the header, as row -1. A region's items meet in one task: ``visible_items`` bounds them.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        cells, share = synthesised(table.to_pylist())
        head = int(infer_headers and heads(cells))
        n = len(cells)
        return pa.table({"region_id": pa.array([key[0].as_py()] * n, pa.string()), "header": pa.array([k < head for k in range(n)], pa.bool_()), "r": pa.array([k - head for k in range(n)], pa.int32()), "cells": pa.array(cells, pa.list_(pa.string())), "confidence": pa.array([share] * n, pa.float64())})

    return items.select(F.col("region_id").cast("string"), "text", *[F.col(c).cast("double") for c in SIDES]).groupBy("region_id").applyInArrow(run, "region_id string, header boolean, r int, cells array<string>, confidence double")


#: A table that a box covers less than this is offered in part too; text is read by its layout from this many pieces on.
WHOLE, LAYOUT_ITEMS = 0.92, 4


def candidates(boxes: DataFrame, tables: DataFrame, slices: DataFrame, layouts: DataFrame, keep: int = 3) -> DataFrame:
    """(box_id, nth, kind, table_id, rows, columns): what a box may mean, the likeliest first.

    boxes: box_id and sides; tables: table_id, grid (no markup), sides, rows, columns; slices: box_id, table_id, rows, columns,
    partial; layouts: box_id, items, rows, columns of the text in each box. The ``keep`` tables that the box lies in most are
    offered whole, before them their covered part if the box covers less than WHOLE of them; the layout comes last.
    """
    near = best_boxes(tables.select(F.col("table_id").alias("box_id"), *SIDES), boxes.select(F.col("box_id").alias("target_id"), *SIDES), keep).select(F.col("target_id").alias("box_id"), F.col("box_id").alias("table_id"), "rank")
    about = tables.where("rows > 0").select("table_id", "grid", "rows", "columns", *[F.col(c).alias(f"t_{c}") for c in SIDES])
    near = near.join(about, "table_id").join(boxes, "box_id").withColumn("covered", S.coverage({c: F.col(f"t_{c}") for c in SIDES}, {c: F.col(c) for c in SIDES}))
    whole = near.select("box_id", (2 * F.col("rank") + 1).alias("at"), F.when(F.col("grid"), "grid").otherwise("table").alias("kind"), "table_id", "rows", "columns")
    part = near.where((F.col("covered") < WHOLE) & ~F.col("grid")).select("box_id", "table_id", "rank").join(slices.where("partial and rows > 0"), ["box_id", "table_id"])
    part = part.select("box_id", (2 * F.col("rank")).alias("at"), F.lit("slice").alias("kind"), "table_id", "rows", "columns")
    layout = layouts.where((F.col("items") >= LAYOUT_ITEMS) & (F.col("columns") >= 2) & (F.col("rows") >= 1)).select("box_id", F.lit(2 * keep + 2).alias("at"), F.lit("layout").alias("kind"), F.lit(None).cast("long").alias("table_id"), "rows", "columns")
    every = whole.unionByName(part).unionByName(layout)
    # at most 2 * keep + 1 rows a box
    return every.withColumn("nth", F.row_number().over(Window.partitionBy("box_id").orderBy("at"))).drop("at")


#: Boxes of a chunk at least, and chunks at most (but for the last ones of sizes and tasks); pairs that are compared at once; digits by which shares are told apart.
CHUNK, MOST_CHUNKS, AT_ONCE, DIGITS = 256, 32_768, 1 << 20, 9
_NONE = np.iinfo(np.int64).max
_MET = ", ".join([*(f"t_{c} double" for c in SIDES), "box_id long", "coverage double", "near long"])


def best_boxes(boxes: DataFrame, targets: DataFrame, keep: int = 3) -> DataFrame:
    """For each target (target_id and sides) the ``keep`` boxes (box_id and sides) that cover most of it; of those equal to nine digits the smaller ids.

    Of boxes with the same sides only the ``keep`` smallest ids count, and targets with the same sides are looked up once. Boxes of
    like size and place make chunks, of which a bounded table says between what bounds their sides lie. It tells for a target
    what a chunk covers of it at least and at most; a chunk that cannot come before what others surely give is left out, by its
    smallest id where shares are equal. What is left is compared box by box. So no pairs are made of all that overlap.
    """
    spark, kind = boxes.sparkSession, dict(boxes.dtypes)["box_id"]
    good = " and ".join(["right > left", "bottom > top", *(f"not isnan({c})" for c in SIDES)])
    sides = lambda df, *more: df.select(*more, *[(F.col(c).cast("double") + 0.0).alias(c) for c in SIDES]).where(good)
    names = None
    if kind not in ("bigint", "int", "smallint", "tinyint"):  # other ids are numbered in their order
        names = numbered(boxes.select("box_id").distinct().orderBy("box_id").select("box_id", F.monotonically_increasing_id().alias(POS)), "_id", in_order=True)[0]
        boxes = boxes.join(names.select("box_id", "_id"), "box_id").drop("box_id").withColumnRenamed("_id", "box_id")
    first = F.row_number().over(Window.partitionBy(*SIDES).orderBy("box_id"))
    own = sides(boxes, F.col("box_id").cast("long").alias("box_id")).withColumn("_nth", first).where(F.col("_nth") <= keep).drop("_nth")
    size = max(CHUNK, -(-boxes.count() // MOST_CHUNKS))
    of_size = [F.ceil(F.log2(F.col(hi) - F.col(lo))) for lo, hi in (("left", "right"), ("top", "bottom"))]
    path = new_path(spark, "boxes")
    own.withColumns({"_w": of_size[0], "_h": of_size[1]}).repartitionByRange("_w", "_h", "left").mapInArrow(chunks(size), "chunk long, box_id long, " + ", ".join(f"{c} double" for c in SIDES)).write.parquet(path)
    laid = spark.read.schema("chunk long, box_id long, " + ", ".join(f"{c} double" for c in SIDES)).parquet(path)
    ends = [f(c).alias(f"{name}_{c}") for c in SIDES for name, f in (("min", F.min), ("max", F.max))]
    wide = [F.max(F.col(hi) - F.col(lo)).alias(name) for name, lo, hi in (("wide", "left", "right"), ("high", "top", "bottom"))]
    ids = F.array_sort(F.collect_list("box_id"))
    about = laid.groupBy("chunk").agg(*ends, *wide, F.min("box_id").alias("first"), F.coalesce(F.get(ids, F.lit(keep - 1)), F.lit(_NONE)).alias("kth")).toPandas()  # MOST_CHUNKS rows, or few more
    each = sides(targets).distinct()
    pairs = each.mapInArrow(promising({c: about[c].to_numpy() for c in about}, keep), "chunk long, " + ", ".join(f"{c} double" for c in SIDES))
    # a chunk's boxes come before the targets that it may serve
    both = laid.unionByName(pairs.withColumn("box_id", F.lit(None).cast("long"))).repartition("chunk").sortWithinPartitions("chunk", F.col("box_id").asc_nulls_last())
    met = both.select("chunk", "box_id", *SIDES).mapInArrow(compared(keep), _MET)
    rank = F.row_number().over(Window.partitionBy(*[f"t_{c}" for c in SIDES]).orderBy(F.desc("near"), "box_id"))
    best = met.withColumn("rank", rank).where(F.col("rank") <= keep)
    found = sides(targets, "target_id").withColumnsRenamed({c: f"t_{c}" for c in SIDES}).join(best, [f"t_{c}" for c in SIDES])
    if names is None:
        return found.select("target_id", F.col("box_id").cast(kind).alias("box_id"), "coverage", "rank")
    return found.withColumnRenamed("box_id", "_id").join(names.select("box_id", "_id"), "_id").select("target_id", "box_id", "coverage", "rank")


def chunks(size: int):
    """Cuts a task's boxes, which are of few sizes, into chunks of near ones: strips from left to right, cut from top to bottom."""

    def run(batches):
        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        at = {c: table[c].to_numpy() for c in table.column_names}
        order = np.lexsort((at["left"], at["_h"], at["_w"]))
        chunk = np.empty(len(order), np.int64)
        base, n = TaskContext.get().partitionId() << 33, 0
        changes = np.flatnonzero(np.diff(at["_w"][order]) | np.diff(at["_h"][order])) + 1
        for alike in np.split(order, changes):
            strip = size * max(1, round((len(alike) / size) ** 0.5))
            for i in range(0, len(alike), strip):
                down = alike[i : i + strip]
                down = down[np.argsort(at["top"][down], kind="stable")]
                chunk[down] = base + n + np.arange(len(down)) // size
                n += -(-len(down) // size)
        yield from table.select(["box_id", *SIDES]).add_column(0, "chunk", pa.array(chunk)).to_batches(max_chunksize=10_000)

    return run


def shares(t: dict, low: dict, high: dict, wide=np.inf, tall=np.inf) -> tuple[np.ndarray, np.ndarray]:
    """What boxes from ``low`` left and top to ``high`` right and bottom cover of each target, and the number by which it is ranked: -1 where they do not meet."""
    across = np.minimum(np.minimum(t["right"][:, None], high["right"]) - np.maximum(t["left"][:, None], low["left"]), wide)
    down = np.minimum(np.minimum(t["bottom"][:, None], high["bottom"]) - np.maximum(t["top"][:, None], low["top"]), tall)
    area = np.maximum(1.0, (t["right"] - t["left"]) * (t["bottom"] - t["top"]))[:, None]
    share = np.maximum(across, 0.0) * np.maximum(down, 0.0) / area
    return share, np.where((across > 0) & (down > 0), np.floor(share * 10.0**DIGITS + 0.5), -1).astype(np.int64)


def promising(about: dict[str, np.ndarray], keep: int):
    """The chunks that may hold one of the best boxes of each target."""
    pick = lambda end: {c: about[f"{e}_{c}"] for c, e in zip(SIDES, end, strict=True)}
    outer, inner = pick(("min", "min", "max", "max")), pick(("max", "max", "min", "min"))

    def run(batches):
        step = max(1, AT_ONCE // max(1, len(about["chunk"])))
        for batch in batches:
            every = {c: batch.column(c).to_numpy() for c in SIDES}
            for i in range(0, batch.num_rows, step):
                t = {c: x[i : i + step] for c, x in every.items()}
                most, least = shares(t, outer, outer, about["wide"], about["high"])[1], shares(t, inner, inner)[1]
                # a chunk of so many boxes gives them all at least so much
                bound = np.where(about["kth"] < _NONE, least, -1).max(axis=1, initial=-1)[:, None]
                sure = (least >= bound) & (bound >= 0)
                last = np.where(sure, about["kth"], _NONE).min(axis=1, initial=_NONE)
                if len(about["chunk"]) >= keep:
                    last = np.minimum(last, np.partition(np.where(sure, about["first"], _NONE), keep - 1, axis=1)[:, keep - 1])
                row, chunk = np.nonzero((most >= 0) & ((most > bound) | ((most == bound) & (about["first"] <= last[:, None]))))
                yield pa.RecordBatch.from_arrays([pa.array(about["chunk"][chunk].astype(np.int64)), *(pa.array(t[c][row]) for c in SIDES)], ["chunk", *SIDES])

    return run


def compared(keep: int):
    """The best boxes of a chunk for each target that follows it."""

    def run(batches):
        now, held, box = None, [], None
        for batch in batches:
            chunk = batch.column("chunk").to_numpy()
            table = pa.Table.from_batches([batch])
            for part in np.split(np.arange(len(chunk)), np.flatnonzero(np.diff(chunk)) + 1):
                rows = table.slice(part[0], len(part))
                if chunk[part[0]] != now:
                    now, held, box = chunk[part[0]], [], None
                n = len(rows) - rows["box_id"].null_count
                if n:
                    held.append(rows.slice(0, n))
                if n == len(rows):
                    continue
                if box is None:
                    box = {c: pa.concat_tables(held)[c].to_numpy() for c in ("box_id", *SIDES)}
                every = {c: rows[c].slice(n).to_numpy() for c in SIDES}
                step = max(1, AT_ONCE // len(box["box_id"]))
                for i in range(0, len(rows) - n, step):
                    t = {c: x[i : i + step] for c, x in every.items()}
                    share, near = shares(t, box, box)
                    of = np.arange(len(near))
                    for _ in range(min(keep, near.shape[1])):
                        best = near.argmax(axis=1)  # the first of equals, which has the smallest id
                        value = near[of, best]
                        yes = value >= 0
                        if not yes.any():
                            break
                        yield pa.RecordBatch.from_arrays([*(pa.array(t[c][yes]) for c in SIDES), pa.array(box["box_id"][best[yes]]), pa.array(share[of, best][yes]), pa.array(value[yes])], [*(f"t_{c}" for c in SIDES), "box_id", "coverage", "near"])
                        near[of, best] = -1

    return run
