"""Connected components of a table of links, by alternating large-star and small-star steps over the whole cluster."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, gathered

#: Links that a task contracts at a time.
CONTRACTED = 1 << 18
#: Links for which a step takes a task more.
DEALT = 1 << 13


def contracted(batches):
    """Fewer links (u, v) with the same components: in each piece of a partition, every node is linked with the smallest that it reaches there."""
    held: list = []
    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1))
        if sum(map(len, held)) >= CONTRACTED:
            yield stars(np.concatenate(held))
            held = []
    if held:
        yield stars(np.concatenate(held))


def stars(links: np.ndarray) -> pa.RecordBatch:
    nodes, at = np.unique(links, return_inverse=True)
    at, labels = at.reshape(links.shape), np.arange(len(nodes))
    a, b = at[:, 0], at[:, 1]
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels = labels[labels]
    return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[labels])], ["u", "v"])


def settled(edges: DataFrame, n: int) -> bool:
    """Whether the links form stars: a node that has a smaller one has no other link."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n")).where("up > 0 and n > 1")
    return gathered(ends, 2 * n, DEALT).isEmpty()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels (node, label) of all nodes that ``links`` (a, b: long) touches; label is the smallest node reachable.

    Each distributed step points nodes at the smallest neighbour that they know, first the larger neighbours, then the
    smaller ones, until the links form stars; the steps needed grow with the logarithm of a component's width. Before the first
    step and after each, every task contracts the links that it has at hand, piece by piece; few links are dealt to few tasks.
    Links from a node to itself only keep it in the result, repeated links and links with nulls change nothing, an empty table gives an empty one.
    """
    schema, n = "u long, v long", links.count()  # about as many as a step has at most
    links = links.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))

    def fewest(rows: DataFrame) -> DataFrame:
        return gathered(gathered(rows, n, DEALT).mapInArrow(contracted, schema).distinct(), n, DEALT)

    table = scratch.keep(fewest(links))
    edges = table.where("u > v")
    while not settled(edges, n):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = scratch.keep(gathered(large, n, DEALT))
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        pair = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        fewer = large.join(low, F.col("u") == F.col("k")).select(F.explode(pair).alias("e")).select("e.u", "e.v").where("u > v").distinct()
        fewer = scratch.keep(fewest(fewer).where("u > v"))
        scratch.drop(large, *([edges] if hasattr(edges, "_scratch_path") else []))
        edges = fewer
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("label")), F.struct(F.col("v").alias("node"), F.col("v").alias("label")))))
    out = ends.unionAll(table.toDF("node", "label").where("node = label")).groupBy("node").agg(F.min("label").alias("label"))
    out = scratch.keep(gathered(out, 2 * n, DEALT))
    scratch.drop(table, *([edges] if hasattr(edges, "_scratch_path") else []))
    return out
