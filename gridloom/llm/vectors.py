"""Embedding near-duplicates by an exact metric range join.

Unit vectors whose cosine is at least c are at most sqrt(2 - 2c) apart. In each group, pivots partition the vectors: each
goes to its nearest pivot's cell. A vector also visits every cell that may hold a partner: by the triangle inequality that
needs a distance to the cell's pivot of at most the distance to its own pivot plus twice the range, and, as a partner there is
on the other side of the plane between the two pivots, a distance to that plane of at most the range. Only cells of smaller
number are visited, so a pair meets in exactly one cell. Cells join independently, in blocks; a cell returns counts of links
and a spanning forest, never its pairs. A group has as many pivots as its size asks for while its vectors visit few cells; where they
would visit many, which a sample of it tells, it has the least.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

#: Vectors that a cell should hold as its own. A group of n gets n / CELL pivots at most; only the GROUPS largest groups get any. Together they
#: have no more than PIVOTS * GROUPS, which are broadcast; other groups are one cell. Beyond PIVOTS of its own a group gets more, four
#: times as many each time, while its vectors visit no more than VISITS cells on average.
CELL, PIVOTS, GROUPS, VISITS = 1024, 64, 512, 4.0
#: Rows of a block of cosines, and rows that one side of a task holds on average: crowded cells are cut into slices, and
#: tasks compare two slices.
BLOCK, SLICE = 512, 8192


def unit(rows: list) -> np.ndarray:
    """Rows scaled to length 1, in double precision; NaN where a vector is null, zero or holds nulls or non-finite numbers."""
    width = max((len(r) for r in rows if r is not None), default=0)
    out = np.full((len(rows), max(width, 1)), np.nan)
    for i, r in enumerate(rows):
        if r is not None and len(r) == width and None not in r:
            out[i] = r
    out[~np.isfinite(out).all(1)] = np.nan
    scale = np.abs(out).max(1, keepdims=True)
    out = out / np.where(scale == 0, np.nan, scale)
    return out / np.sqrt((out * out).sum(1, keepdims=True))


def visits(x: np.ndarray, centres: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """For each vector and cell whether it has to be there, and its own cell."""
    far = np.sqrt(np.maximum(0, 2 - 2 * (x @ centres.T)))
    apart = np.sqrt(np.maximum(0, 2 - 2 * (centres @ centres.T)))
    home = far.argmin(1)
    near = far[np.arange(len(x)), home][:, None]
    # margins far above rounding keep the bounds safe
    goes = (far <= near + 2 * reach + 1e-7) & (far * far - near * near <= 2 * apart[home] * (reach + 1e-7) + 1e-9) & (np.arange(len(centres)) < home[:, None])
    goes[np.arange(len(x)), home] = True
    return goes, home


def chosen(sample: np.ndarray, n: int, most: int, reach: float) -> np.ndarray:
    """The pivots of a group of n vectors out of a sample of it, whose second half tells how many cells its vectors visit."""
    found, rest = sample[: -(-len(sample) // 2)], sample[-(-len(sample) // 2) :]
    # near pivots would share a cell
    found = found[np.sort(np.unique(found.round(2), axis=0, return_index=True)[1])][: max(1, min(most, math.ceil(n / CELL)))]
    best, k = found[:PIVOTS], PIVOTS
    while k < len(found) and len(rest):
        k *= 4
        if visits(rest, found[:k], reach)[0].sum(1).mean() <= VISITS:
            best = found[:k]
    return best


def assigned(pivots, reach: float):
    """(label, cell, own, id, name, vector) for each cell that a vector has to be in. pivots: label -> matrix."""

    def run(batches):
        held = pivots.value
        for batch in batches:
            labels = batch.column(1).to_pylist()
            vectors = batch.column(2).to_pylist()
            by: dict = {}
            for i, x in enumerate(labels):
                by.setdefault(x, []).append(i)
            for label, at in by.items():
                x = unit([vectors[i] for i in at])
                good = np.isfinite(x[:, 0])
                if not good.any():
                    continue
                at, x = np.array(at)[good], x[good]
                ids, names = (batch.column(k).take(pa.array(at)).to_numpy() for k in (0, 3))
                centres = held.get(label)
                if centres is None:
                    centres = np.zeros((1, x.shape[1]))
                goes, home = visits(x, centres, reach)
                row, cell = np.nonzero(goes)
                for a in range(0, len(row), 4096):
                    r, c = row[a : a + 4096], cell[a : a + 4096]
                    flat = pa.array(x[r].ravel())
                    yield pa.RecordBatch.from_arrays([pa.array([label] * len(r), pa.string()), pa.array(c, pa.int32()), pa.array(c == home[r]), pa.array(ids[r]), pa.array(names[r]), pa.FixedSizeListArray.from_arrays(flat, x.shape[1]).cast(pa.list_(pa.float64()))], ["label", "cell", "own", "id", "name", "v"])

    return run


def merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links (a, b): the smallest position reachable."""
    while True:
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, labels[a], low)
        np.minimum.at(new, labels[b], low)
        new = new[new]
        new = np.minimum(new, new[new])
        if (new == labels).all():
            return labels
        labels = new


def joined(cosine: float):
    """A task: links between its left rows and its right ones, or among the left ones where there are no right ones."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        cols = [(b.column("right").to_numpy(zero_copy_only=False), b.column("id").to_numpy(), b.column("v"), b.column("name").to_numpy()) for b in table.to_batches() if b.num_rows]
        right = np.concatenate([c[0] for c in cols])
        ids = np.concatenate([c[1] for c in cols])
        x = np.concatenate([np.asarray(c[2].flatten()).reshape(len(c[0]), -1) for c in cols])
        names = np.concatenate([c[3] for c in cols])
        order = np.lexsort((ids, right))
        right, ids, x, names = right[order], ids[order], x[order], names[order]
        n_left, alone = int((~right).sum()), key[2].as_py() == key[3].as_py()
        count, labels = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i in range(0, n_left, BLOCK):
            rows = np.arange(i, min(i + BLOCK, n_left))
            for j in range(i if alone else n_left, len(ids), 8 * BLOCK):
                cols_at = np.arange(j, min(j + 8 * BLOCK, len(ids)))
                close = (x[rows] @ x[cols_at].T >= cosine) & (names[rows][:, None] != names[cols_at][None, :])
                if alone:
                    close &= cols_at[None, :] > rows[:, None]
                if close.any():
                    count[rows] += close.sum(1)
                    count[cols_at] += close.sum(0)
                    a, b = np.nonzero(close)
                    labels = merged(labels, rows[a], cols_at[b])
        some = np.flatnonzero(count)
        return pa.table({"id": ids[some], "links": count[some], "root": ids[labels[some]]})

    return run


def link_vectors(table: DataFrame, scratch: Scratch, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row.

    Vectors of one group link when their cosine, in double precision, is at least ``cosine``; component_id is the smallest id
    reachable by links, kept marks the vectors that are it. Vectors of different widths do not link; those that are
    null, zero, or that hold null or non-finite numbers link with nothing, as do those whose group is null. Every row comes back.
    Rows that repeat an id are one member of their component, and no links of one another: equal ones are one vector, of others
    each has its own n_links, which counts different vectors of other ids. A row with a null id links with nothing: its n_links is 0,
    its component_id null, its kept false. Other columns are not looked at; an empty table gives no rows.
    """
    spark = table.sparkSession
    rows = table.select(F.col(id_col).cast("long").alias("name"), F.col(group_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    # rows get a number that stays, and equal ones that of one of them
    every = scratch.keep(rows.withColumn("row", F.monotonically_increasing_id()))
    keys = every.where("name is not null").select("row", "name", F.xxhash64("label", "v").alias("k"), F.hash("v", "label").alias("h"))
    first = keys.groupBy("name", "k", "h").agg(F.min("row").alias("id"))
    place = scratch.keep(keys.join(first, ["name", "k", "h"]).select("row", "name", "id"))
    one = place.where("row = id").select(F.col("row").alias("id"))
    usable = every.withColumnRenamed("row", "id").join(one, "id", "left_semi").where("label is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('inf')) and exists(v, x -> x != 0)")

    usable = usable.withColumn("label", F.concat_ws("|", F.size("v").cast("string"), "label"))  # other widths are other groups

    large = usable.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > CELL).orderBy(F.desc("n"), "label").limit(GROUPS)
    # the smallest hashes of each large group; twice as many as it may have pivots
    n_large = max(1, large.count())
    most = max(PIVOTS, PIVOTS * GROUPS // n_large)
    drawn = usable.join(large.withColumnRenamed("label", "l"), F.col("label") == F.col("l"))
    drawn = drawn.where(F.pmod(F.xxhash64("name"), F.lit(1 << 30)) <= (2 * most + 64) * F.lit(float(1 << 30)) / F.col("n"))
    reach = math.sqrt(max(0.0, 2 - 2 * cosine))
    held = {}
    for r in drawn.groupBy("label", "n").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("name").alias("h"), "v"))).alias("s")).collect():
        held[r["label"]] = chosen(unit([x["v"] for x in r["s"]][: 2 * most]), r["n"], most, reach)
    pivots = spark.sparkContext.broadcast(held)
    schema = "label string, cell int, own boolean, id long, name long, v array<double>"
    cells = scratch.keep(usable.select("id", "label", "v", "name").mapInArrow(assigned(pivots, reach), schema))

    slices = cells.groupBy("label", "cell").agg(F.count_if("own").alias("n_own"), F.count_if(~F.col("own")).alias("n_far"))
    slices = slices.select(F.col("label").alias("l"), F.col("cell").alias("c"), F.expr(f"int(greatest(1, (n_own + {SLICE} - 1) div {SLICE}))").alias("s"), F.expr(f"int((n_far + {SLICE} - 1) div {SLICE})").alias("t"))
    # own slices 0..s-1 meet one another, and the visitors' slices s..s+t-1; a visitor never meets a visitor
    placed = cells.join(slices, (F.col("label") == F.col("l")) & (F.col("cell") == F.col("c")))
    placed = placed.withColumn("at", F.when(F.col("own"), F.pmod(F.xxhash64("id"), F.col("s"))).otherwise(F.col("s") + F.pmod(F.xxhash64("id"), F.greatest("t", F.lit(1)))).cast("int"))
    as_left = F.expr("if(own, transform(sequence(at, s + t - 1), j -> struct(at as i, j as j, false as right)), array())")
    as_right = F.expr("if(own, if(at > 0, transform(sequence(0, at - 1), i -> struct(i as i, at as j, true as right)), array()), transform(sequence(0, s - 1), i -> struct(i as i, at as j, true as right)))")
    placed = placed.select("label", "cell", "id", "name", "v", F.explode(F.concat(as_left, as_right)).alias("e")).select("label", "cell", "e.i", "e.j", "e.right", "id", "name", "v")
    found = placed.groupBy("label", "cell", "i", "j").applyInArrow(joined(cosine), "id long, links long, root long")
    found = scratch.keep(found)
    # vectors of one id belong together
    vectors = place.where("row = id").select("id", "name")
    least = vectors.groupBy("name").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select(F.col("name").alias("of"), "least")
    same = vectors.join(least, F.col("name") == F.col("of")).select(F.col("id").alias("a"), F.col("least").alias("b"))
    labels = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).unionAll(same), scratch)
    named = labels.join(vectors, F.col("node") == F.col("id")).select("node", "label", "name")
    smallest = named.groupBy("label").agg(F.min("name").alias("component")).withColumnRenamed("label", "l")
    member = scratch.keep(named.join(smallest, F.col("label") == F.col("l")).select("node", "component"))
    links = found.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "of")
    out = place.join(links, F.col("id") == F.col("of"), "left").join(member, F.col("id") == F.col("node"), "left").select("name", "links", F.coalesce("component", "name").alias("component"))
    out = out.unionAll(every.where("name is null").select("name", F.lit(0).cast("long").alias("links"), F.lit(None).cast("long").alias("component")))
    out = scratch.keep(out.select(F.col("name").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("name") == F.col("component"), F.lit(False)).alias("kept")))
    scratch.drop_all_but(out)
    return out
