"""Ground-truth curation: votes, gates, novelty, candidate selection and splits."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.operators import ranks
from folio.operators.tables import stored

#: Vectors that a block of either side holds at least, about, and numbers that it holds at most.
NEAR_BLOCK, NEAR_NUMBERS = 2048, 1 << 22
#: Pairs of blocks from which on blocks grow with the table, and parts that pairs are dealt into at most.
NEAR_PAIRS, NEAR_PARTS = 256, 4096
#: Vectors of either side whose products are made at once.
NEAR_TILE = 256, 4096


def offset_consensus(numbers: DataFrame, min_votes: int = 5) -> DataFrame:
    """(book_id, is_roman, offset, votes): the commonest distance of page index and printed value; the first on ties."""
    votes = numbers.filter("value is not null").groupBy("book_id", "is_roman", (F.col("page_index") - F.col("value")).alias("offset")).agg(F.count(F.lit(1)).alias("votes"), F.min("page_index").alias("first"))
    w = Window.partitionBy("book_id", "is_roman").orderBy(F.desc("votes"), "first")
    return votes.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") == 1) & (F.col("votes") >= min_votes)).select("book_id", "is_roman", "offset", "votes")


def majority(items: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): each key's commonest value that is not null, the one seen first on ties."""
    votes = items.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("first"))
    w = Window.partitionBy(key).orderBy(F.desc("votes"), "first")
    return votes.withColumn("rank", F.row_number().over(w)).filter("rank = 1").select(key, value)


def author_diversity(chapters: DataFrame, least: int = 3, most_share: float = 0.5) -> DataFrame:
    """(book_id, n_authors, max_share, ok) from (book_id, chapter, author): enough authors, none on most chapters."""
    per_author = chapters.select("book_id", "chapter", "author").distinct().groupBy("book_id", "author").agg(F.count(F.lit(1)).alias("n"))
    books = per_author.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_authors"), F.max("n").alias("top"))
    total = chapters.groupBy("book_id").agg(F.count_distinct("chapter").alias("n_chapters"))
    rows = books.join(total, "book_id").withColumn("max_share", F.col("top") / F.col("n_chapters"))
    return rows.select("book_id", "n_authors", "max_share", ((F.col("n_authors") >= least) & (F.col("max_share") <= most_share)).alias("ok"))


def confirmed_gate(chapters: DataFrame, least: int = 3, share: float = 0.8) -> DataFrame:
    """(book_id, n, share, ok): enough chapters with a confirmed page."""
    rows = chapters.groupBy("book_id").agg(F.count_if(F.col("page_index").isNotNull()).alias("n"), F.count(F.lit(1)).alias("all"))
    return rows.select("book_id", "n", (F.col("n") / F.col("all")).alias("share"), ((F.col("n") >= least) & (F.col("n") >= share * F.col("all"))).alias("ok"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows of doubles; null components are not numbers."""
    rows = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    lengths = np.unique(rows.value_lengths().to_numpy(zero_copy_only=False))
    if len(lengths) > 1:
        raise ValueError(f"vectors of {len(lengths)} lengths")
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(rows), int(lengths.max(initial=0)))


def _equal_places(own: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) with own[a] = refs[b], in order of a."""
    order = np.argsort(refs, kind="stable")
    left, right = (np.searchsorted(refs[order], own, side) for side in ("left", "right"))
    a = np.repeat(np.arange(len(own)), right - left)
    within = np.arange(len(a)) - np.repeat(np.cumsum(right - left) - (right - left), right - left)
    return a, order[left[a] + within]


def _least_squares(x: np.ndarray, y: np.ndarray, x_ids: np.ndarray, y_ids: np.ndarray) -> np.ndarray:
    """For each row of ``x`` the least squared distance to a row of ``y`` of another id; infinite without any.

    Products in single precision say which pairs may be the nearest, within a bound of their error; only those are
    summed up, in double precision.  Rows of ``y`` are taken by length, so that a long one widens no other's bound.
    """
    least = np.full(len(x), np.inf)
    unit = max(np.abs(x).max(initial=0.0), np.abs(y).max(initial=0.0)) or 1.0
    order = np.argsort(np.square(y / unit).sum(1), kind="stable")
    y, y_ids = y[order], y_ids[order]
    same_a, same_b = _equal_places(x_ids, y_ids)
    own, refs = x / unit, y / unit
    own2, refs2 = np.square(own).sum(1), np.square(refs).sum(1)
    left = np.concatenate([-2 * own, np.ones((len(x), 1))], 1).astype(np.float32)
    right = np.concatenate([refs, refs2[:, None]], 1).astype(np.float32)
    rounding = 2 * (x.shape[1] + 8) * float(np.finfo(np.float32).eps)
    some = max(1, NEAR_NUMBERS // max(1, x.shape[1]))

    def summed(a: np.ndarray, b: np.ndarray) -> None:
        for k in range(0, len(a), some):
            np.minimum.at(least, a[k : k + some], np.square(x[a[k : k + some]] - y[b[k : k + some]]).sum(1))

    for i in range(0, len(x), NEAR_TILE[0]):
        j = slice(i, i + NEAR_TILE[0])
        at = slice(*np.searchsorted(same_a, [i, i + NEAR_TILE[0]]))
        for k in range(0, len(y), NEAR_TILE[1]):
            rough = left[j] @ right[k : k + NEAR_TILE[1]].T
            same = at.start + np.flatnonzero((same_b[at] >= k) & (same_b[at] < k + NEAR_TILE[1]))
            rough[same_a[same] - i, same_b[same] - k] = np.inf
            slack = rounding * (own2[j] + 2 * refs2[k : k + NEAR_TILE[1]].max()) + 1e-30
            bar = lambda: (least[j] / unit / unit) * (1 + 1e-12) - own2[j] + slack  # noqa: E731, B023
            first = rough.argmin(1)
            smallest = rough[np.arange(len(rough)), first]
            a = np.flatnonzero(np.isfinite(smallest) & (smallest <= bar()) & (least[j] > 0))
            summed(a + i, first[a] + k)
            rough[a, first[a]] = np.inf
            a = a[least[j][a] > 0]
            c, b = np.nonzero((rough[a] <= bar()[a, None]) & np.isfinite(rough[a]))
            summed(a[c] + i, b + k)
    return least


def _nearest(batch: pa.Table) -> pa.Table:
    """Least squared distances from the vectors of a pair of blocks to its reference rows; null where no pair is finite."""
    is_ref = batch["is_ref"].to_numpy()
    ids = pa.concat_arrays(batch["id"].chunks)
    codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
    v = _matrix(batch["v"])
    finite = np.isfinite(v).all(1)
    own, refs = np.flatnonzero(~is_ref & finite), np.flatnonzero(is_ref & finite)
    least = np.full(len(v), np.inf)
    least[own] = _least_squares(v[own], v[refs], codes[own], codes[refs])
    least[np.isinf(least)] = np.nan
    return pa.table({"id": ids.filter(pa.array(~is_ref)), "d2": pa.array(least[~is_ref], pa.float64(), from_pandas=True)})


def _block_size(n_own: int, n_ref: int, width: int, block: int) -> int:
    """Rows of a block: as many as make about ``NEAR_PAIRS`` pairs of blocks, between ``block`` and what a task may hold."""
    return max(block, min(math.isqrt(n_own * n_ref // NEAR_PAIRS), NEAR_NUMBERS // max(1, width)))


def nn_distance(vectors: DataFrame, reference: DataFrame, block: int = NEAR_BLOCK) -> DataFrame:
    """(id, distance): Euclidean distance to the nearest reference vector of another id; null without any.

    Both sides are dealt into blocks by a hash, and each pair of blocks is a group of bounded size; partial minima are
    all that leaves it.  Blocks grow with the table until a task holds as much as it may, so that a vector is copied to
    about as many groups in a large table as in a small one.  Every vector is held against every reference vector, as
    in many dimensions no bound by the distance to a third point rules pairs out.
    """
    (own, own_width), (ref, ref_width) = (df.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first() for df in (vectors, reference))
    size = _block_size(own, ref, max(own_width, ref_width), block)
    n_own, n_ref = (max(1, -(-n // size)) for n in (own, ref))
    dealt = lambda df, n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    kind = vectors.schema["id"].dataType.simpleString()
    sides = lambda df, n, other, is_ref: df.select(F.col("id").cast("string").alias("id"), "v", F.lit(is_ref).alias("is_ref"), dealt(df, n).alias("ref_block" if is_ref else "block"), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("block" if is_ref else "ref_block"))
    both = sides(vectors.filter("v is not null"), n_own, n_ref, False).unionByName(sides(reference.filter("v is not null"), n_ref, n_own, True))
    # as many parts as pairs: few small files of vectors would else be few tasks of much work
    both = both.repartition(min(n_own * n_ref, NEAR_PARTS), "block", "ref_block")
    near = both.groupBy("block", "ref_block").applyInArrow(_nearest, "id string, d2 double")
    return near.groupBy("id").agg(F.sqrt(F.min("d2")).alias("distance")).withColumn("id", F.col("id").cast(kind))


def novelty_threshold(vectors: DataFrame, percentile: float = 90.0) -> DataFrame:
    """One row: the percentile of each vector's distance to the nearest other; distances are written once and read by each count."""
    near = stored(nn_distance(vectors, vectors).select(F.col("distance").alias("p")))
    return ranks.percentile(near, percentile / 100).select(F.col("value").alias("threshold"))


def is_novel(candidates: DataFrame, reference: DataFrame, threshold: DataFrame) -> DataFrame:
    """(book_id, is_novel): any page at the threshold or beyond; null where no page could be measured."""
    far = candidates.select("book_id", "id").join(nn_distance(candidates.filter("v is not null").select("id", "v"), reference), "id", "left")
    far = far.join(F.broadcast(threshold))
    return far.groupBy("book_id").agg(F.bool_or(F.col("distance") >= F.col("threshold")).alias("is_novel"))


def language_priority(manifests: DataFrame, languages: DataFrame) -> DataFrame:
    """(language, n, rank): the wanted languages, rarest in the manifests first."""
    counts = manifests.groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    rows = languages.join(counts, "language", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy("n", "language")))


def language_quota(works: DataFrame, priority: DataFrame, n: int = 5) -> DataFrame:
    """The first n works of each language, languages in their order."""
    w = Window.partitionBy("language").orderBy("arrival")
    return works.join(priority.select("language", "rank"), "language").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n).drop("k")


def new_candidates(works: DataFrame, known: DataFrame) -> DataFrame:
    """Works known neither by ISBN nor by DOI, once each in order of arrival; a missing DOI never blocks."""
    fresh = works.join(known.filter("isbn is not null").select("isbn").distinct(), "isbn", "left_anti")
    fresh = fresh.join(known.filter("doi is not null").select("doi").distinct(), "doi", "left_anti")
    w = Window.partitionBy("isbn").orderBy("arrival")
    return fresh.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank").select(*works.columns)


def toc_range(listings: DataFrame) -> DataFrame:
    """(book_id, start, end, status): the one run of listing pages; ambiguous where there are several."""
    w = Window.partitionBy("book_id").orderBy("page_index")
    runs = listings.withColumn("run", F.col("page_index") - F.row_number().over(w)).groupBy("book_id", "run").agg(F.min("page_index").alias("a"), F.max("page_index").alias("b"))
    rows = runs.groupBy("book_id").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("a"), F.max("b").alias("b"))
    one = F.col("n") == 1
    return rows.select("book_id", F.when(one, F.col("a")).alias("start"), F.when(one, F.col("b")).alias("end"), F.when(one, "ok").otherwise("needs review").alias("status"))


def stratified_split(books: DataFrame, eval_counts: dict[str, int], seed: int = 42) -> DataFrame:
    """(corpus, book_id, split): an exact number of evaluation books of each corpus, by a hash of seed and id.

    The hash that parts them is found by counting ranges of its first digits, and only books that share these digits
    are put in order.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("book_id").cast("string")), 256)
    rows = books.select("corpus", "book_id", digest.alias("digest")).withColumn("p", -F.conv(F.substring("digest", 1, 13), 16, 10).cast("double"))
    quota = books.sparkSession.createDataFrame([(c, n) for c, n in eval_counts.items() if n > 0], "corpus string, k long")
    bars = ranks.kth_greatest(rows.select("corpus", "p"), quota, "corpus").select("corpus", F.col("value").alias("bar"))
    rows = rows.join(F.broadcast(quota), "corpus", "left").join(F.broadcast(bars), "corpus", "left")
    ties = rows.filter("p = bar")
    before = rows.filter("p > bar").groupBy("corpus").agg(F.count(F.lit(1)).alias("before"))
    w = Window.partitionBy("corpus").orderBy("digest", "book_id")
    chosen = ties.withColumn("rank", F.row_number().over(w)).join(before, "corpus", "left").filter(F.col("rank") + F.coalesce("before", F.lit(0)) <= F.col("k")).select("corpus", "book_id", F.lit(True).alias("last"))
    rows = rows.join(chosen.distinct(), ["corpus", "book_id"], "left")
    is_eval = F.col("k").isNotNull() & (F.col("bar").isNull() | (F.col("p") > F.col("bar")) | F.col("last"))
    return rows.select("corpus", "book_id", F.when(F.coalesce(is_eval, F.lit(False)), "eval").otherwise("train").alias("split"))


def candidate_budget(scores: DataFrame, cap: float = 0.15) -> DataFrame:
    """(book_id, page_index): a book's best pages up to a share of its pages, one at least; the earlier page on ties."""
    w = Window.partitionBy("book_id").orderBy(F.desc("p"), "page_index")
    n = F.count(F.lit(1)).over(Window.partitionBy("book_id"))
    rows = scores.withColumn("k", F.row_number().over(w)).withColumn("n", n)
    return rows.filter(F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("n") * cap))).select("book_id", "page_index")


def recall_threshold(scores: DataFrame, recall: float) -> DataFrame:
    """(label, threshold): the greatest probability that still reaches a recall among positives; 1 without any."""
    positive = scores.filter("is_positive and p is not null").select("label", "p")
    wanted = positive.groupBy("label").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * recall)).cast("long").alias("k"))
    at = ranks.kth_greatest(positive, wanted, "label").select("label", F.col("value").alias("threshold"))
    return scores.select("label").distinct().join(at, "label", "left").withColumn("threshold", F.coalesce("threshold", F.lit(1.0)))
