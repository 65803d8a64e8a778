"""The k-th value of groups however large: values are counted in ranges first, and only one range's values are put in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges in which a k-th value is looked for first.
BINS = 1 << 16


def kth_greatest(values: DataFrame, ranks: DataFrame, *keys: str, bins: int = BINS) -> DataFrame:
    """(keys, k, value): for each group of ``values`` (keys, p) the ones of the ranks in ``ranks`` (keys, k), the greatest being 1.

    Values are counted in ranges between a group's least and greatest one, a row for each key, range and task; those of
    the range that holds the k-th are counted by value, so that many equal ones are a row.  Without keys all rows are
    one group.
    """
    if not keys:
        one = lambda df: df.withColumn("__all", F.lit(1))
        return kth_greatest(one(values), one(ranks), "__all", bins=bins).drop("__all")
    ends = values.groupBy(*keys).agg(F.min("p").alias("low"), F.max("p").alias("high"))
    share = (F.col("p") - F.col("low")) / (F.col("high") - F.col("low"))
    place = F.when(F.col("high") > F.col("low"), F.least(F.floor(share * bins), F.lit(bins - 1))).otherwise(0)
    binned = values.join(F.broadcast(ends), list(keys)).withColumn("bin", place).select(*keys, "p", "bin")
    counts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    above = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = counts.withColumn("above", above).join(ranks, list(keys)).filter((F.col("above") < F.col("k")) & (F.col("above") + F.col("n") >= F.col("k")))
    inside = binned.join(F.broadcast(held.select(*keys, "bin", "k", (F.col("k") - F.col("above")).alias("place"))), [*keys, "bin"])
    inside = inside.groupBy(*keys, "k", "place", "p").agg(F.count(F.lit(1)).alias("n"))
    inside = inside.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys, "k").orderBy(F.desc("p"))))
    return inside.filter((F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("n") < F.col("place"))).select(*keys, "k", F.col("p").alias("value"))


def percentile(values: DataFrame, fraction: float, *keys: str) -> DataFrame:
    """(keys, value): the percentile of each group of ``values`` (keys, p), between the two nearest values in proportion; no row for no values."""
    if not keys:
        return percentile(values.withColumn("__all", F.lit(1)), fraction, "__all").drop("__all")
    at: Column = (F.col("n") - 1) * F.lit(fraction)
    n = values.filter("p is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("at", at)
    ranks = n.select(*keys, F.explode(F.array_distinct(F.array(F.col("n") - F.floor("at"), F.col("n") - F.ceil("at")))).alias("k"))
    found = kth_greatest(values.filter("p is not null"), ranks, *keys).join(n, list(keys))
    part = F.when(F.ceil("at") == F.floor("at"), 1.0).when(F.col("k") == F.col("n") - F.floor("at"), F.ceil("at") - F.col("at")).otherwise(F.col("at") - F.floor("at"))
    return found.groupBy(*keys).agg(F.sum(part * F.col("value")).alias("value"))
