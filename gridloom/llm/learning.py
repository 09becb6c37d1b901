"""What the trained operators share: bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sampled(rows: DataFrame, classes: str, key: str, bound: int) -> tuple[DataFrame, dict]:
    """At most ``bound`` rows, evenly of the values of the column ``classes`` where they have enough; and the counts of all rows.

    The same rows at any partitioning: those of each class with the smallest hashes of ``key``, and of equal keys the first in
    order. A class in which most rows go is ranked after a cut at an expected 1.5 times its part, so no class meets in one task.
    """
    counts = {r[classes]: r["count"] for r in rows.where(F.col(classes).isNotNull()).groupBy(classes).count().orderBy(F.desc("count"), classes).limit(bound).collect()}
    if not counts:
        return rows.limit(0), {}
    left, quota = bound, {}
    for k, (value, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], str(x[0])))):  # what small classes leave goes to the larger
        quota[value] = min(n, left // (len(counts) - k))
        left -= quota[value]
    of = lambda numbers: F.element_at(F.create_map(*[x for value, n in numbers.items() for x in (F.lit(value), F.lit(n))]), F.col(classes))
    spot = F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = rows.withColumn("_spot", spot).where(F.col(classes).isin(list(counts)) & (F.col("_spot") <= of({v: (1.5 * quota[v] + 30) / n for v, n in counts.items()})))
    order = Window.partitionBy(classes).orderBy("_spot", *[c for c in rows.columns if c != classes])
    ranked = near.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= of(quota))
    return ranked.drop("_spot", "_rank"), counts
