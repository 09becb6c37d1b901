"""How filters of documents overlap: what each removes at each place of each order.

A document is one set of failing filters. Whatever the order, a filter meets the documents that the filters before it have
kept, and that depends only on the set of those, not on their order: the orders are paths through the lattice of subsets.
So documents are counted by their failing sets, the counts go to the edges (set of filters already applied, next filter) of
the lattice - 80 for five filters - and the steps of all orders - 600 - look their edge up.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Anything but words: the white space that ends them.
GAPS = r"[\x20\x09-\x0D]+"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that look at one text alone: few words, few different words, many capitals, odd signs."""
    words = F.array_remove(F.split(text, GAPS), "")
    n_words, capitals = F.size(words), F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n_words < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n_words,
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failing_sets(docs: DataFrame, labels: DataFrame, repeats: str = "E") -> DataFrame:
    """(part, fails, good, toxic, n): how many documents of a part fail just the filters whose bits are set in ``fails``, by their labels.

    Bit k stands for the k-th letter of ``A`` to ``E``. The last is a filter on the whole table: a text that is the same as that of a
    smaller doc_id fails it. Rows that repeat an id with one text are no copies of each other, and a null id is neither smaller nor
    larger than any. A null text is empty, a null lang is the part ''. A document is good or toxic if any of its labels says so;
    labels without an id count for nothing. Copies are counted before anything is gathered by text, so a text that a third of
    all documents share is a few rows there.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bits = [F.when(c, 1 << k).otherwise(0) for k, c in enumerate(text_failures(F.col("t")).values())]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("t"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("code"), sum(bits[1:], bits[0]).alias("fails"))
    rows = rows.groupBy("doc_id", "part", "code", "fails").agg(F.count("*").alias("n"))
    # rows without an id have no labels; the second key keeps them from meeting in one task
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("code", "part")).otherwise(0)
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).withColumn("zero", F.lit(0).cast("long"))
    rows = rows.withColumn("spread", spread).join(said, (F.col("doc_id") == F.col("id")) & (F.col("spread") == F.col("zero")), "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})

    # of the documents with one text, those with the smallest id are the first; all others with an id repeat it
    alike = rows.groupBy("code", "part", "fails", "good", "toxic").agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    first = F.min("least").over(Window.partitionBy("code"))
    repeated = F.col("n") - F.col("no_id") - F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    both = alike.withColumn("first", first).withColumn("repeated", repeated)
    bit = 1 << "ABCDE".index(repeats)
    outcomes = F.array(F.struct(F.col("fails").alias("fails"), (F.col("n") - F.col("repeated")).alias("n")), F.struct((F.col("fails") + bit).alias("fails"), F.col("repeated").alias("n")))
    return both.select("part", "good", "toxic", F.inline(outcomes)).where("n > 0").groupBy("part", "fails", "good", "toxic").agg(F.sum("n").alias("n"))


def lattice_edges(counted: DataFrame, n_filters: int) -> DataFrame:
    """(part, before, bit, and the counts): one row for each part and edge, from a set of applied filters to the next one."""
    every = (1 << n_filters) - 1
    edges = F.explode(F.sequence(F.lit(0), F.lit(every))).alias("before")
    rows = counted.select("*", edges).select("*", F.explode(F.lit([1 << k for k in range(n_filters)])).alias("bit")).where("before & bit = 0")
    fails, met = F.col("fails").bitwiseAND(F.col("bit")) != 0, F.col("fails").bitwiseAND(F.col("before")) == 0
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return rows.groupBy("part", "before", "bit").agg(
        count(met & ~fails).alias("kept"), count(met & fails).alias("removed"), count(~met & fails).alias("redundant"), count(F.col("fails") == F.col("bit")).alias("unique_fails"),
        count(met & fails & F.col("good")).alias("good_lost"), count(met & fails & F.col("toxic")).alias("toxic_lost"),
    )


def paths(edges: DataFrame, filters: str) -> DataFrame:
    """(part, filter_order, step, the counts, shapley): the edges of each part along each order of the filters.

    ``shapley`` is what the step's filter removes, summed over all orders.
    """
    steps = [("".join(order), k + 1, sum(1 << filters.index(x) for x in order[:k]), 1 << filters.index(order[k])) for order in permutations(filters) for k in range(len(filters))]
    walk = edges.sparkSession.createDataFrame(steps, "filter_order string, step int, before_ int, bit_ int")
    # 600 rows for five filters, whatever the documents
    rows = edges.join(F.broadcast(walk), (F.col("before") == F.col("before_")) & (F.col("bit") == F.col("bit_")))
    return rows.select("part", "filter_order", "step", *COUNTS, F.sum("removed").over(Window.partitionBy("part", "bit")).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The filters A to E over whole documents, in all 120 orders.

    Returns part, filter_order, step (from 1), kept (after the step), removed (by it), redundant (fail its filter, but were removed
    before), unique_fails (fail no other filter), good_lost and toxic_lost (labelled so and removed by it), and shapley; a row for
    each part, order and step, zeros included. An empty table has no parts and gives no rows. What nulls, repeated rows and ties
    do is said at ``failing_sets``; texts of any length are read whole; columns of other names are left alone.
    """
    return paths(lattice_edges(failing_sets(docs, labels), 5), "ABCDE")
