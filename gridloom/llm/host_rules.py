"""Quality rules with verdicts on hosts, in DataFrame functions alone.

Document rules give failures; failures are counted by host; an empirical beta prior, fitted to the hosts' failure rates by
moments, shrinks them; hosts whose shrunk rate stands out of the prior lose the documents that are themselves doubtful.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# fixed values: what separates words, what counts as a symbol, and the width of repeated windows
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def with_repeat_words(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words for the words in column w: those in a window of WINDOW words found at two places or more.

    Windows are compared by 64-bit hashes, made by doubling: a window of 8 from two of 4, of 2, of 1. Only texts that have
    fewer distinct windows than windows sort them. The repeated windows cover what lies before the next one's start, at most
    WINDOW words each, so positions count once. Each step is a column of its own: an array inside a lambda is then read, not built anew.
    """
    rows = rows.withColumn("h1", F.when(F.size("w") > WINDOW, F.transform("w", lambda x: F.xxhash64(x))))
    step = 1
    while step < WINDOW:
        here = F.col(f"h{step}")
        rest = F.size(here) - step
        rows = rows.withColumn(f"h{2 * step}", F.zip_with(F.slice(here, 1, rest), F.slice(here, step + 1, rest), lambda a, b: F.xxhash64(a, b))).drop("w" if step == 1 else f"h{step // 2}")
        step *= 2
    rows = rows.withColumn("placed", F.when(F.size(F.array_distinct(f"h{WINDOW}")) < F.size(f"h{WINDOW}"), F.array_sort(F.transform(f"h{WINDOW}", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    near = lambda x, i, k: F.coalesce(F.get("placed", i + k)["h"] == x["h"], F.lit(False))
    rows = rows.withColumn("spots", F.transform(F.filter("placed", lambda x, i: near(x, i, -1) | near(x, i, 1)), lambda x: x["i"]))
    rows = rows.withColumn("sorted", F.array_sort("spots"))
    gaps = F.zip_with(F.slice("sorted", 2, F.greatest(F.size("sorted") - 1, F.lit(0))), F.slice("sorted", 1, F.greatest(F.size("sorted") - 1, F.lit(0))), lambda b, a: F.least(F.lit(WINDOW), b - a))
    total = F.aggregate(gaps, F.lit(WINDOW), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", F.when(F.size("sorted") > 0, total).otherwise(F.lit(0)).cast("long")).drop("placed", "spots", "sorted", f"h{WINDOW}", f"h{WINDOW // 2}")


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(doc_id, host, word_chars, n_symbols, n_words, n_dup_lines, n_repeat_words) of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), text.alias("t"))
    out = out.select(
        "doc_id", "host", F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        words_of(F.col("t")).alias("w"), F.filter(F.split("t", "\n", -1), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0).alias("lines"),
    )
    out = out.select("doc_id", "host", "word_chars", "n_symbols", "w", F.size("w").cast("long").alias("n_words"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    return with_repeat_words(out)


def verdicts(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 20, max_repeat_percent: int = 30, spreads: float = 2.0) -> DataFrame:
    """doc_id, the counts, base_failed, host_rate (shrunk), doubtful, host_failed and kept of every row.

    base_failed: fewer than ``min_words`` words or more than ``max_repeat_percent`` of them in repeated windows. A host fails
    when its shrunk rate of such documents lies ``spreads`` standard deviations of the prior or more above the prior's mean; of a failed host, documents go that are doubtful as well:
    many symbols for their words, many repeated lines, or words of odd length. A null host is a host of its own; null and
    empty texts have no words and fail. Texts count whole, however long. Repeated rows count each; a tie with the bound fails; other columns are not looked at. An empty table gives no rows.
    """
    found = scratch.keep(measured(docs, id_col, text_col, host_col).withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))))
    hosts = found.groupBy("host").agg(F.count("*").alias("n"), F.count_if("base_failed").alias("failed"))
    hosts = hosts.withColumn("rate", F.col("failed") / F.col("n"))
    # moments of the hosts' rates, less the spread that sampling n documents a host gives anyway
    moments = hosts.agg((F.sum("failed") / F.sum("n")).alias("m"), F.var_pop("rate").alias("v"), F.avg(1 / F.col("n")).alias("inv"))
    spread = F.greatest(F.col("v") - F.col("m") * (1 - F.col("m")) * F.col("inv"), F.col("m") * (1 - F.col("m")) * 1e-3)
    prior = moments.select("m", F.when((F.col("m") > 0) & (F.col("m") < 1), F.greatest(F.lit(1.0), F.col("m") * (1 - F.col("m")) / spread - 1)).otherwise(F.lit(1.0)).alias("weight"))
    # the prior is beta(weight * m, weight * (1 - m)); where all hosts are alike none stands out
    prior = prior.withColumn("bound", F.when((F.col("m") > 0) & (F.col("m") < 1), F.col("m") + spreads * F.sqrt(F.col("m") * (1 - F.col("m")) / (F.col("weight") + 1))))
    judged = hosts.join(F.broadcast(prior)).select(F.col("host").alias("h"), ((F.col("failed") + F.col("weight") * F.col("m")) / (F.col("n") + F.col("weight"))).alias("host_rate"), "bound")  # prior: one row
    doubtful = (10 * F.col("n_symbols") > F.col("n_words")) | (5 * F.col("n_dup_lines") > F.col("n_words")) | (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))
    out = found.join(judged, F.col("host").eqNullSafe(F.col("h")), "left").drop("h", "host")
    host_failed = F.coalesce(F.col("host_rate") >= F.col("bound"), F.lit(False))
    out = out.withColumn("doubtful", doubtful).withColumn("host_failed", host_failed).drop("bound")
    return out.withColumn("kept", ~F.col("base_failed") & ~(F.col("host_failed") & F.col("doubtful"))).withColumnRenamed("doc_id", id_col)
