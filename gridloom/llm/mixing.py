"""Mixing sources to target weights, in DataFrame functions alone.

Documents of a source are dealt into blocks of about equal numbers of words by a seeded hash. Whole passes over a source, and
one last partial pass, meet its target: blocks are drawn in a permuted order, disjointly, and only the block at the quota's
edge is cut, between two documents. Output shards get exact quotas of each source's blocks from a splitting tree: each
node deals its shards' blocks to two halves by a multivariate hypergeometric draw. In a shard, documents are in hashed order.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Words that a block holds on average, before the bound on blocks of a source.
BLOCK_WORDS, MAX_BLOCKS = 20_000, 1 << 20
MAX_REPEATS = 3
#: Leaves of the splitting tree: for the sources with most blocks, and for all others together.
OWN_LEAVES, SHARED_LEAVES = 960, 64


def hypergeometric(r: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` balls drawn without replacement are good; inversion outwards from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    comb = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    p = math.exp(comb(good, mode) + comb(bad, draws - mode) - comb(good + bad, draws))
    u, a, b, pa, pb = r.random() - p, mode, mode, p, p
    while u > 0 and (a > low or b < high):
        if b < high:
            pb *= (good - b) * (draws - b) / ((b + 1) * (bad - draws + b + 1))
            b += 1
            u -= pb
            if u <= 0:
                return b
        if a > low:
            pa *= a * (bad - draws + a) / ((good - a + 1) * (draws - a + 1))
            a -= 1
            u -= pa
            if u <= 0:
                return a
    return mode


def split(r: random.Random, counts: list[int], shards: int) -> list[list[int]]:
    """For each shard, how many blocks of each source: sums are exact, and shards differ in their totals by one at most."""
    if shards == 1:
        return [counts]
    left = shards // 2
    total = sum(counts)
    draws, rest, half = total * left // shards, total, []
    for n in counts:  # a multivariate draw as a chain of single ones
        half.append(hypergeometric(r, n, rest - n, draws))
        rest, draws = rest - n, draws - half[-1]
    return split(r, half, left) + split(r, [n - h for n, h in zip(counts, half, strict=True)], shards - left)


def word_count(text: str):
    """Runs of characters that are no space, in built-in functions: spaces are made one, then starts of words are counted."""
    plain = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(plain, " "), lambda w: w != "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Adds target to (source, source_size): shares of all words by weight, at most MAX_REPEATS times the source.

    Sources are in code-point order, null last; weights repeat along it. What a full source leaves is shared by weight
    among the others until none is above: sources fill up in the order of their bound over their weight.
    """
    place = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int"))
    bound = (MAX_REPEATS * F.col("source_size")).cast("double")
    rows = sizes.withColumn("w", w).withColumn("bound", bound)
    order = Window.orderBy(F.col("bound") / F.col("w"), F.col("source").isNull(), F.col("source"))
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("bound").over(upto), F.lit(0.0))) / F.sum("w").over(after)
    rows = rows.withColumn("level", level).withColumn("open", F.col("bound") > F.col("level") * F.col("w"))
    # the first source that its bound does not fill sets the level of all after it
    first = F.min(F.when(F.col("open"), F.struct((F.col("bound") / F.col("w")).alias("at"), "level"))).over(Window.partitionBy())
    rows = rows.withColumn("first", first)
    return rows.withColumn("target", F.when(F.col("first").isNull(), F.col("bound")).otherwise(F.least("bound", F.col("w") * F.col("first.level")))).drop("w", "bound", "level", "open", "first")


def mix(docs: DataFrame, scratch: Scratch, weights: tuple[float, ...] = (5.0, 2.0, 1.0), shards: int = 64, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every row; copies are its places in the mix: (pass, block, shard, spot).

    size is the words of a text (0 for null); source_size and target are of the document's source. A document is in the mix once
    for each pass over its source, and once more if the last partial pass reaches it, at most MAX_REPEATS times; a source's
    taken words are off its target by less than its largest document. The same rows give the same mix at any partitioning. A
    null source is a source of its own, last in order; rows that repeat an id go together; a row with a null id is
    a document too. Texts count whole, however long. Documents without words are taken with the pass that their place is in. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = scratch.keep(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size")))
    planned = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    planned = planned.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    planned = planned.withColumn("rest", (F.col("target") - F.col("passes") * F.col("source_size")))
    planned = planned.withColumn("n_blocks", F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("source_size") / BLOCK_WORDS))).cast("int"))
    planned = scratch.keep(planned.withColumn("k", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())))

    # one row a source; blocks and passes of a document follow from hashes
    spot = F.xxhash64(F.lit(seed), "doc_id", "size")
    placed = rows.join(planned, rows["source"].eqNullSafe(planned["source"])).drop(planned["source"])
    placed = placed.withColumn("spot", spot).withColumn("block", F.pmod(F.xxhash64("spot", F.lit(7)), F.col("n_blocks")).cast("int"))
    blocks = placed.groupBy("k", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    drawn = Window.partitionBy("k").orderBy(F.xxhash64(F.lit(seed + 1), "k", "block"), "block")
    blocks = blocks.withColumn("before", F.sum("words").over(drawn) - F.col("words"))
    # whole blocks below the quota, and the one at its edge
    edge = scratch.keep(blocks.where("before < rest").select("k", "block", "before", (F.col("before") + F.col("words") > F.col("rest")).alias("cut")))
    cut = edge.where("cut").select("k", "block", "before")
    within = Window.partitionBy("k", "block").orderBy("spot", "doc_id", "size")
    at_edge = placed.join(cut, ["k", "block"]).select("doc_id", "size", "spot", "k", "block", (F.col("before") + F.sum("size").over(within) - F.col("size")).alias("start"), "rest")
    # nearest: a document is taken if more of it lies below the quota than above
    some = at_edge.where(2 * (F.col("rest") - F.col("start")) >= F.col("size")).select(F.col("k").alias("k2"), F.col("block").alias("b2"), F.col("spot").alias("s"), F.col("doc_id").alias("d"), F.col("size").alias("z")).distinct()

    last = placed.join(edge.where("not cut").select("k", "block", F.lit(True).alias("whole")), ["k", "block"], "left")
    last = last.join(some.withColumn("part", F.lit(True)), (F.col("k") == F.col("k2")) & (F.col("block") == F.col("b2")) & (F.col("spot") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("size") == F.col("z")), "left").drop("k2", "b2", "s", "d", "z")
    n_copies = F.col("passes") + F.when(F.coalesce("whole", "part", F.lit(False)), 1).otherwise(0)
    out = last.withColumn("n", n_copies)

    # one row a block and pass, in a permuted order of each source
    taking = blocks.select("k", "block").join(planned.select("k", "passes"), "k").join(edge.select("k", "block", F.lit(1).alias("more")), ["k", "block"], "left")
    taking = taking.withColumn("n", F.col("passes") + F.coalesce("more", F.lit(0))).where("n > 0")
    taking = scratch.keep(taking.select("k", "block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pass")))
    # the sources with most blocks have leaves of the tree of their own, the others share some; in a shared leaf the permuted
    # order deals each source's blocks, which is the same draw
    largest = [r["k"] for r in taking.groupBy("k").count().orderBy(F.desc("count"), "k").limit(OWN_LEAVES).collect()]
    taking = taking.withColumn("leaf", F.when(F.col("k").isin(largest), F.col("k")).otherwise(F.pmod("k", F.lit(SHARED_LEAVES))))
    dealt = Window.partitionBy("leaf").orderBy(F.xxhash64(F.lit(seed + 2), "k", "block", "pass"), "k", "block", "pass")
    taking = scratch.keep(taking.withColumn("rank", F.row_number().over(dealt) - 1))

    # exact quotas of each leaf's blocks for the shards: a bounded number of leaves, whatever the sources
    totals = [(r["leaf"], r["n"]) for r in taking.groupBy("leaf").agg(F.count("*").alias("n")).orderBy("leaf").collect()]
    quotas = split(random.Random(seed), [n for _, n in totals], max(1, min(shards, sum(n for _, n in totals)))) if totals else []
    ends = [{"q": k, "ends": [sum(quota[j] for quota in quotas[: i + 1]) for i in range(len(quotas))]} for j, (k, _) in enumerate(totals)]
    plan = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(ends)), "array<struct<q: bigint, ends: array<bigint>>>")))
    shard = F.size(F.filter("ends", lambda e: e <= F.col("rank")))
    shards_of = taking.join(F.broadcast(plan), F.col("leaf") == F.col("q")).groupBy("k", "block").agg(F.sort_array(F.collect_list(F.struct(F.col("pass"), shard.alias("shard")))).alias("places"))
    out = out.join(shards_of.withColumnsRenamed({"k": "bk", "block": "bb"}), (F.col("k") == F.col("bk")) & (F.col("block") == F.col("bb")), "left")
    taken = F.slice(F.coalesce("places", F.array()), F.lit(1), F.col("n"))
    copies = F.transform(taken, lambda x: F.struct(x["pass"].alias("pass"), F.col("block"), x["shard"].alias("shard"), F.xxhash64("spot", x["pass"]).alias("spot")))
    out = scratch.keep(out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies")))
    scratch.drop_all_but(out)
    return out


def shards_of(mixed: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, once for each copy, with shard and spot, which replace columns of these names; a shard is read in the order of its spots.

    Rows of one id, source and size go together in the mix, so each finds its copies by these three, nulls included; repeated
    rows each come as often as they are taken, not as often as they meet one another.
    """
    keys = {"_mix_id": F.col(id_col).cast("long"), "_mix_source": F.col(source_col).cast("string"), "_mix_size": word_count(text_col)}
    places = mixed.where(F.size("copies") > 0).dropDuplicates(["doc_id", "source", "size"]).select(F.col("doc_id").alias("_at_id"), F.col("source").alias("_at_source"), F.col("size").alias("_at_size"), F.col("copies").alias("_mix_copies"))
    on = F.lit(True)
    for one, two in zip(keys, ("_at_id", "_at_source", "_at_size"), strict=True):
        on &= F.col(one).eqNullSafe(F.col(two))
    met = docs.drop("shard", "spot").withColumns(keys).join(places, on)
    kept = [c for c in docs.columns if c not in ("shard", "spot")]
    return met.select(*kept, F.explode("_mix_copies").alias("_mix_copy")).select(*kept, F.col("_mix_copy.shard").alias("shard"), F.col("_mix_copy.spot").alias("spot"))
