"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Target texts are those labelled as good and not toxic, raw texts are all.  The n-grams are words, word pairs, the
first letters of longer words, the marks that end words, and lengths of runs of one word, hashed to buckets; both
generative models are multinomials over the buckets, from occurrences counted over all texts.  A task adds up its
own texts before anything is dealt out.

The log ratio of a bucket is smoothed by ``SMOOTHING`` occurrences and shrunk by how far its target count lies from
what a random choice of as many texts would give (``SHRINK`` standard deviations shrink it to nothing, and the more
a bucket's occurrences stand together in few texts the wider that is), so that what chance leaves in
long texts does not add up; nothing is cut off and small tables have a model too.

A text's log weight is the sum over its n-grams.  Divided by ``TEMPERATURE`` it gets Gumbel noise from a hash of the
id, and the texts of the k greatest keys are kept, which samples without replacement by weight.  Unless k is given it
is the number of texts at or above the weight that parts the labelled texts with fewest errors, the least such
weight on ties; for this each labelled text is weighed by a model of the other half of the targets, as its own label
would favour it.  The k-th key is found by counting keys in ever narrower ranges; no rows are sorted or brought
together for it.

Defined results: a text without words (null or empty too) has no features, the least key and is rejected; without
labels every text with words is kept; with several labels a text is target if all of them say so; rows with equal
ids share their noise; texts of equal keys at the k-th are all kept; a very long text counts whole; an empty table
gives an empty one; extra columns are kept by ``resample``, which drops rows and not ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import kernels, scratch

WORD_BUCKETS = 1 << 20
PAIR_BUCKETS = 1 << 16
MARK_BUCKETS = 1 << 12
HEAD_BUCKETS = 1 << 19
#: Numbers of bytes at the start of a longer word that make a feature of their own.
HEADS_OF = (6, 7, 8)
#: Lengths of runs of one word that are told apart, by powers of two.
AGAIN = 10
PAIRS = WORD_BUCKETS
HEADS = PAIRS + PAIR_BUCKETS
MARKS = HEADS + HEAD_BUCKETS
REPEATS = MARKS + MARK_BUCKETS
BUCKETS = REPEATS + AGAIN
#: Occurrences added to a bucket's target count and to what is expected of it.
SMOOTHING = 1.0
SHRINK = 1.5
TEMPERATURE = 1.0
#: Steps to a unit, and greatest size, of the weights among which the default k is looked for.
STEPS = 8
FURTHEST = 32.0
SEED = "importance"
_KIND = np.array([ord("a") if kernels.LETTERS[b] else b for b in range(256)], np.uint64)


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text numbers, buckets, words of each text): a row for each n-gram that stands in a text."""
    lower = kernels.LOWER[raw]
    start, end, at = kernels.word_spans(lower, offsets, kernels.LETTERS)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    sums = kernels.prefix_sums(lower)
    h = kernels.span_hashes(sums, start, end)
    inner = kernels.within(at, 2)
    pairs = kernels.window_hashes(h, 2)[inner] if len(inner) else np.zeros(0, np.uint64)
    same = np.zeros(len(h), bool)
    same[inner + 1] = h[inner] == h[inner + 1]
    runs = np.flatnonzero(~same)
    length = np.diff(np.concatenate([runs, [len(h)]]))
    said = runs[length > 1]
    again = np.minimum(np.log2(length[length > 1]).astype(np.int64), AGAIN - 1)
    longer = [np.flatnonzero(end - start > n) for n in HEADS_OF]
    heads = np.concatenate([kernels.span_hashes(sums, start[i], start[i] + n) for i, n in zip(longer, HEADS_OF, strict=True)])
    v_start, v_end, v_at = kernels.word_spans(raw, offsets, kernels.VISIBLE)
    v_text = np.repeat(np.arange(len(offsets) - 1), np.diff(v_at))
    marked = ~kernels.LETTERS[raw[v_end - 1]] if len(v_end) else np.zeros(0, bool)
    last, one = v_end[marked] - 1, (v_end - v_start)[marked] == 1
    marks = _KIND[raw[last]] * np.uint64(256) + np.where(one, np.uint64(1), _KIND[raw[last - 1]])
    buckets = np.concatenate([
        h & np.uint64(WORD_BUCKETS - 1),
        np.uint64(PAIRS) + (pairs & np.uint64(PAIR_BUCKETS - 1)),
        np.uint64(HEADS) + (heads & np.uint64(HEAD_BUCKETS - 1)),
        np.uint64(MARKS) + (kernels.mix(marks) & np.uint64(MARK_BUCKETS - 1)),
        np.uint64(REPEATS) + again.astype(np.uint64),
    ]).astype(np.int64)
    owners = np.concatenate([text, text[inner], text[np.concatenate(longer)], v_text[marked], text[said]])
    return owners, buckets, np.diff(at)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, raw, squares, half_0, half_1) occurrences in a task's texts; bucket -1 counts the texts themselves."""
    raw_n, squares, texts = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), np.zeros(1, np.int64)
    halves, targets = np.zeros((2, BUCKETS), np.int64), np.zeros((2, 1), np.int64)
    for rows, raw, offsets in kernels.chunks(batches, "text"):
        text, bucket, words = features(raw, offsets)
        half = rows.column(1).to_numpy(zero_copy_only=False)
        keys, n = np.unique(text * BUCKETS + bucket, return_counts=True)
        text, bucket = keys // BUCKETS, keys % BUCKETS
        np.add.at(raw_n, bucket, n)
        np.add.at(squares, bucket, n * n)
        texts += (words > 0).sum()
        for k in (0, 1):
            own = half[text] == k
            np.add.at(halves[k], bucket[own], n[own])
            targets[k] += ((half == k) & (words > 0)).sum()
    held = np.flatnonzero(raw_n)
    yield pa.RecordBatch.from_pydict({
        "bucket": pa.array(np.concatenate([[-1], held]).astype(np.int32)), "raw": pa.array(np.concatenate([texts, raw_n[held]])),
        "squares": pa.array(np.concatenate([texts, squares[held]])), **{f"half_{k}": pa.array(np.concatenate([targets[k], halves[k][held]])) for k in (0, 1)},
    })


def targets(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, good, half) of labelled texts."""
    told = labels.filter(f"`{id_col}` is not null and quality is not null").groupBy(F.col(id_col).alias("__id")).agg(
        F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good")
    )
    return told.withColumn("half", F.pmod(F.xxhash64("__id", F.lit(SEED)), F.lit(2)).cast("int"))


class Model:
    """Log weights of the buckets that tell target from raw text; at most BUCKETS of them."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray):
        self.buckets, self.weights = buckets, weights.astype(np.float32)
        self._table: np.ndarray | None = None

    def __getstate__(self):
        return {"buckets": self.buckets, "weights": self.weights, "_table": None}

    def score(self, text: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        """Log weights of n texts from their n-grams."""
        if self._table is None:
            self._table = np.zeros(BUCKETS, np.float32)
            self._table[self.buckets] = self.weights
        return np.bincount(text, self._table[bucket], n)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", smoothing: float = SMOOTHING, shrink: float = SHRINK) -> tuple[Model, Model, Model]:
    """The model of all targets and those of either half of them."""
    good = scratch.limited(scratch.stored(targets(labels, id_col).filter("good").select("__id", "half"), "importance-targets"))
    rows = docs.select(F.col(id_col).alias("__key"), F.coalesce(text_col, F.lit("")).alias("text")).join(good, F.col("__key") == F.col("__id"), "left")
    counted = rows.select("text", F.coalesce("half", F.lit(-1)).alias("half")).mapInArrow(_count, "bucket int, raw long, squares long, half_0 long, half_1 long")
    counts = scratch.stored(counted.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("raw", "squares", "half_0", "half_1"))), "importance-counts")
    total = counts.filter("bucket = -1").first()

    def model(*halves: str) -> Model:
        chosen = sum(total[h] for h in halves) if total else 0
        if not chosen or chosen == total["raw"]:
            return Model(np.zeros(0, np.int64), np.zeros(0))
        share, target = chosen / total["raw"], sum(F.col(h) for h in halves)
        expected = F.col("raw") * share
        z = (target - expected) / F.sqrt(F.col("squares") * (share * (1 - share)) + 0.25)
        ratio = F.log((target + smoothing) / (expected + smoothing))
        weights = counts.filter("bucket >= 0").filter(F.abs(z) > shrink).select("bucket", (ratio * (1 - (shrink / z) * (shrink / z))).cast("float").alias("weight"))
        kept = weights.toArrow()  # at most BUCKETS rows of 8 bytes
        return Model(kept["bucket"].to_numpy().astype(np.int64), kept["weight"].to_numpy())

    return model("half_0", "half_1"), model("half_0"), model("half_1")


def scored(docs: DataFrame, models: tuple[Model, ...], *, id_col: str = "doc_id", text_col: str = "text", temperature: float = TEMPERATURE, seed: str = SEED, row_col: str | None = None) -> DataFrame:
    """(id, n_words, log_weight, others, key) for each row, and ``row_col`` as row if there is one.

    ``log_weight`` and the key are the first model's; ``others`` has the weights of the other models.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offsets in kernels.chunks(batches, "text"):
            text, bucket, words = features(raw, offsets)
            first, *others = (m.score(text, bucket, len(rows)) for m in models)
            kept = [n for n in rows.schema.names if n != "text"]
            more = pa.array(list(np.stack(others, 1)) if others else [[]] * len(rows), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(n)) for n in kept), pa.array(words, pa.int64()), pa.array(first, pa.float64()), more], names=[*kept, "n_words", "log_weight", "others"])

    kind = docs.schema[id_col].dataType.simpleString()
    own = [F.col(row_col).alias("row")] if row_col else []
    rows = docs.select(F.col(id_col).alias("id"), *own, F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(score, f"id {kind}, {'row long, ' if row_col else ''}n_words long, log_weight double, others array<double>")
    return rows.withColumn("key", F.when(F.col("n_words") > 0, gumbel_key(F.col("log_weight"), F.col("id"), temperature, seed)))


def gumbel_key(log_weight: Column, id_col: Column, temperature: float = TEMPERATURE, seed: str = SEED) -> Column:
    """The log weight with Gumbel noise; those of the k greatest keys are a sample by weight without replacement."""
    uniform = (F.shiftrightunsigned(F.xxhash64(id_col, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return log_weight / temperature - F.log(-F.log(uniform))


def kth_greatest(keys: DataFrame, k: int, *, ranges: int = 1024, few: int = 2000) -> float:
    """The k-th greatest of the column ``key``, by counts of ever narrower ranges; nulls count as none."""
    inside, left = keys.filter("key is not null"), k
    while True:
        low, high, n = inside.agg(F.min("key"), F.max("key"), F.count("key")).first()
        if k <= 0 or not n:
            return float("inf")
        if left >= n or low == high:
            return low
        if n <= few:
            return sorted((r[0] for r in inside.select("key").collect()), reverse=True)[left - 1]
        place = F.least(F.floor((F.col("key") - low) / ((high - low) / ranges)), F.lit(ranges - 1)).cast("int")
        bins = dict(inside.groupBy(place.alias("place")).count().collect())
        for b in sorted(bins, reverse=True):
            if left <= bins[b]:
                break
            left -= bins[b]
        inside = inside.filter(place == b)


def best_k(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> int:
    """Number of texts at or above the least weight that parts the labelled texts with fewest errors.

    A labelled text counts with the weight of the half that does not hold it.
    """
    told = rows.filter("n_words > 0").join(targets(labels, id_col), F.col("id") == F.col("__id"), "left")
    weight = F.coalesce(F.get("others", 1 - F.col("half")), F.col("log_weight"))
    step = F.floor((F.greatest(F.least(weight, F.lit(FURTHEST)), F.lit(-FURTHEST)) + FURTHEST) * STEPS).cast("int")
    counted = told.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.count_if(x), F.lit(0)).alias(c) for c, x in (("good", F.col("good")), ("bad", ~F.col("good")))))
    by_step = sorted((r["step"], r["n"], r["good"], r["bad"]) for r in counted.collect())
    errors = sum(x[3] for x in by_step)
    best, k, rest = errors, sum(x[1] for x in by_step), sum(x[1] for x in by_step)
    for _, n, good, bad in by_step:
        errors += good - bad
        rest -= n
        if errors < best:
            best, k = errors, rest
    return k


def judged(docs: DataFrame, labels: DataFrame, *, k: int | None = None, id_col: str = "doc_id", text_col: str = "text", temperature: float = TEMPERATURE, seed: str = SEED, row_col: str | None = None) -> DataFrame:
    """(id, n_words, log_weight, key, kept) for each row of ``docs``, and ``row_col`` if there is one."""
    models = fit(docs, labels, id_col=id_col, text_col=text_col)
    rows = scratch.stored(scored(docs, models, id_col=id_col, text_col=text_col, temperature=temperature, seed=seed, row_col=row_col), "importance-scores")
    least = kth_greatest(rows, best_k(rows, labels, id_col) if k is None else k)
    own = [F.col("row").alias(row_col)] if row_col else []
    return rows.select(F.col("id").alias(id_col), *own, "n_words", "log_weight", "key", F.coalesce(F.col("key") >= least, F.lit(False)).alias("kept"))


def resample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that resampling rejects."""
    rows, number = scratch.numbered(docs)
    own = rows.select(F.col(id_col), F.col(text_col), F.col(number))
    return scratch.without(rows, judged(own, labels, id_col=id_col, text_col=text_col, row_col=number, **options).filter("not kept"), number).select(*docs.columns)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(scratch.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
