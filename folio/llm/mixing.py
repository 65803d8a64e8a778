"""Mixing sources to target weights by pivotal dependent rounding.

Each text has a wanted number of copies, its source's target over the source's size, between 0 and 2.  The whole
part is taken for certain.  The fractions are rounded in pairs: two texts of sizes s and t with fractions p and q
pass words to each other at random until one of them has a fraction of 0 or 1, so that p * s + q * t stays as it
is and each fraction stays right in expectation; the other goes on to the next pair.  A bucket of texts of one
source leaves a single fraction.  The buckets' last ones are rounded the same way, some thousands at a time, in a
tree of reductions until a source has one left, which is rounded by itself.  So a source's taken words differ
from its target by less than its largest text.

Buckets are cut by a hash of the id from the source's count, so a source that holds a third of all rows becomes
as many buckets as its rows need, and all draws are hashes of ids: a rerun gives the same mix.

Defined results: a null text has size 0; a text of size 0 is never taken; a null source is one of its own, last;
rows that repeat an id are rounded each; a source whose texts are all empty has target 0; extra columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import scratch

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Texts of one bucket; memory of a task grows with it, not with the source.
BUCKET = 8192
NEAR = 1e-9


def text_size(text):
    """Number of runs of characters other than blanks (0x20, 0x09-0x0D)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """(source, source_size, n, k) with k the place of a source in code point order, null last.

    Sources are sorted in ranges; a range's first place follows from the counts of the ranges before it.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    placed = scratch.stored(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id()), "mix-sources")
    placed = placed.withColumn("range", F.shiftright("place", 33)).withColumn("k", F.col("place").bitwiseAND((1 << 33) - 1))
    ranges = sorted((r["range"], r["count"]) for r in placed.groupBy("range").count().collect())  # one row for each partition
    before = [(at, sum(n for _, n in ranges[:i])) for i, (at, _) in enumerate(ranges)]
    table = sizes.sparkSession.createDataFrame(before, "range long, before long")
    return placed.join(F.broadcast(table), "range").select("source", "source_size", "n", (F.col("k") + F.col("before")).alias("k"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n, target) from (source, size).

    Targets are the smaller of ``most`` times the size and weight times one common level.  The level rises as the
    sources at their limit pass on their excess; each round sums over all sources, and rounds end when no further
    source reaches its limit.
    """
    ranked = ranked_sources(sizes)
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("k") % len(weights) + 1).cast("int")))
    ranked = scratch.stored(ranked.withColumn("most", F.col("source_size") * F.lit(most)), "mix-weights")
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, held = 0.0, -1
    while True:
        full = F.col("most") < F.col("w") * level
        n, taken, free = ranked.agg(F.count_if(full), F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))).first()
        if n == held or not free:
            break
        held, level = n, (total - taken) / free
    return ranked.select("source", "source_size", "n", F.least(F.col("most"), F.col("w") * level).alias("target"))


def _rounded(rows: pd.DataFrame) -> pd.DataFrame:
    """Rounds the fractions of one bucket pair by pair; all but at most one of them end at 0 or 1."""
    rows = rows.sort_values(["draw", "id"], kind="stable")
    p, size, u = rows["p"].tolist(), rows["size"].tolist(), rows["u"].tolist()
    j = -1
    for i in range(len(p)):
        if p[i] <= NEAR or p[i] >= 1 - NEAR:
            p[i] = float(round(p[i]))
            continue
        if j < 0:
            j = i
            continue
        a, b = p[j] * size[j], p[i] * size[i]
        up = min(size[j] - a, b)  # words that j can take from i
        down = min(a, size[i] - b)
        x = up if u[i] * (up + down) < down else -down
        p[j], p[i] = (a + x) / size[j], (b - x) / size[i]
        for k in (j, i):
            if p[k] <= NEAR or p[k] >= 1 - NEAR:
                p[k] = float(round(p[k]))
        j = next((k for k in (j, i) if 0 < p[k] < 1), -1)
    rows["p"] = p
    return rows


def _uniform(*cols):
    """A number in (0, 1) from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / float(1 << 53)


def round_fractions(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(source, id, size, p) with each p at 0 or 1, from fractions in [0, 1); sizes are positive.

    ``rows`` has (source, id, size, p, n, seed): ids tell rows apart, seeds give the draws, n counts the source.
    """
    schema = "source string, id long, size long, p double, n long, seed long, draw long, u double, bucket long"
    level, done = 0, None
    todo = rows
    while True:
        counted = todo if level == 0 else todo.drop("n").join(todo.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        dealt = counted.select(
            "source", "id", "size", "p", "n", "seed",
            F.xxhash64("seed", F.lit(f"order {level}")).alias("draw"), _uniform(F.col("seed"), F.lit(f"draw {level}")).alias("u"),
            F.pmod(F.xxhash64("seed", F.lit(f"bucket {level}")), F.ceil(F.col("n") / bucket)).alias("bucket"),
        )
        out = scratch.stored(dealt.groupBy("source", "bucket").applyInPandas(_rounded, schema), "mix-rounded")
        whole = out.filter("p = 0 or p = 1").select("source", "id", "size", "p")
        done = whole if done is None else done.unionByName(whole)
        todo = out.filter("p > 0 and p < 1").select("source", "id", "size", "p", "n", "seed")
        if todo.groupBy("source").count().filter("count > 1").isEmpty():
            last = todo.select("source", "id", "size", (_uniform(F.col("seed"), F.lit("last")) < F.col("p")).cast("double").alias("p"))
            return done.unionByName(last)
        level += 1


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, bucket: int = BUCKET) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for each row of ``docs``."""
    told = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), text_size(F.col(text_col)).alias("size"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("seed"))
    sizes = scratch.stored(told.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    targets = scratch.stored(source_targets(sizes, weights, share, most), "mix-targets").withColumnRenamed("source", "s")
    wanted = sizes.join(targets, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    wanted = wanted.withColumn("copies", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    wanted = scratch.stored(wanted.withColumn("whole", F.floor("copies").cast("long")), "mix-wanted")
    fractions = wanted.filter("size > 0 and copies > whole").select("source", F.col("row").alias("id"), "size", (F.col("copies") - F.col("whole")).alias("p"), "n", "seed")
    rounded = round_fractions(fractions, bucket).filter("p = 1").select(F.col("id").alias("row"), F.lit(1).cast("long").alias("more"))
    taken = (F.col("whole") + F.coalesce("more", F.lit(0))).cast("long")
    return wanted.join(rounded, "row", "left").select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", F.col("target"), F.when(F.col("size") > 0, taken).otherwise(0).cast("long").alias("copies")
    ).withColumn("taken", F.col("copies") * F.col("size"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(scratch.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
