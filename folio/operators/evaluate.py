"""Scoring found chapters against expected ones: boundaries, printed ranges, pooled rates, ranking and checks.

Rates are always made from pooled counts, never averaged; a rate with an empty denominator is 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

END_SLACK = 3


def rate(part, whole):
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _rates(rows: DataFrame) -> DataFrame:
    p, r = rate(F.col("tp"), F.col("found")), rate(F.col("tp"), F.col("expected"))
    rows = rows.withColumn("precision", p).withColumn("recall", r)
    return rows.withColumn("f1", rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def range_matches(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(strategy, book_id, start, end, is_tp) of distinct found ranges; true where the book expects that very range."""
    want = expected.select("book_id", F.col("pdf_start_index").alias("start"), F.col("pdf_end_index").alias("end")).distinct().withColumn("is_tp", F.lit(True))
    have = found.select("strategy", "book_id", F.col("pdf_start_index").alias("start"), F.col("pdf_end_index").alias("end")).distinct()
    return have.join(want, ["book_id", "start", "end"], "left").withColumn("is_tp", F.coalesce("is_tp", F.lit(False)))


def boundary_metrics(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(strategy, book_id, tp, found, expected, precision, recall, f1) for each strategy and each book it found chapters in."""
    hits = range_matches(expected, found).groupBy("strategy", "book_id").agg(F.count_if("is_tp").alias("tp"), F.count(F.lit(1)).alias("found"))
    want = expected.select("book_id", "pdf_start_index", "pdf_end_index").distinct().groupBy("book_id").agg(F.count(F.lit(1)).alias("expected"))
    return _rates(hits.join(want, "book_id", "left").withColumn("expected", F.coalesce("expected", F.lit(0))))


def micro_metrics(per_book: DataFrame, *keys: str) -> DataFrame:
    """Rates of pooled counts for each combination of ``keys``; elapsed seconds are summed where they are given."""
    extra = [F.sum("elapsed_seconds").alias("elapsed_seconds")] if "elapsed_seconds" in per_book.columns else []
    return _rates(per_book.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("tp", "found", "expected")), *extra))


def micro_rollup(per_book: DataFrame) -> DataFrame:
    """Pooled rates for each corpus and a row TOTAL over all of them."""
    rows = per_book.rollup("corpus").agg(*(F.sum(c).alias(c) for c in ("tp", "found", "expected")), F.grouping("corpus").alias("all"))
    return _rates(rows.withColumn("corpus", F.when(F.col("all") == 1, "TOTAL").otherwise(F.col("corpus"))).drop("all"))


def citation_pairs(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Expected rows with a printed range and, where the same page range was found, the last printed range found."""
    from folio.functions.pagenum import split_citation

    w = Window.partitionBy("strategy", "book_id", "pdf_start_index", "pdf_end_index").orderBy(F.desc("chapter_no"))
    last = found.withColumn("rank", F.row_number().over(w)).filter("rank = 1").select("strategy", "book_id", "pdf_start_index", "pdf_end_index", F.col("citation_pages").alias("found_pages"))
    want = expected.withColumn("want", split_citation(F.col("citation_pages"))).filter("want is not null").select("book_id", "pdf_start_index", "pdf_end_index", "want")
    pairs = want.join(last, ["book_id", "pdf_start_index", "pdf_end_index"])
    return pairs.withColumn("got", split_citation(F.col("found_pages")))


def citation_metrics(pairs: DataFrame, slack: int = END_SLACK) -> DataFrame:
    """Per book: pairs with a found range, starts that are equal, ends at most ``slack`` pages late."""
    end, want = F.col("got.end").try_cast("int"), F.col("want.end").try_cast("int")
    near = F.when(end.isNotNull() & want.isNotNull(), (end - want).between(0, slack)).otherwise(F.col("got.end") == F.col("want.end"))
    return pairs.groupBy("strategy", "book_id").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("got").isNotNull()).alias("covered"), F.count_if(F.col("got.start") == F.col("want.start")).alias("start_ok"), F.count_if(near).alias("end_ok")
    ).transform(_citation_rates)


def _citation_rates(rows: DataFrame) -> DataFrame:
    for name, part, whole in (("coverage", "covered", "pairs"), ("start_accuracy", "start_ok", "covered"), ("end_accuracy", "end_ok", "covered")):
        rows = rows.withColumn(name, rate(F.col(part), F.col(whole)))
    return rows


def citation_micro(per_book: DataFrame, *keys: str) -> DataFrame:
    return _citation_rates(per_book.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("pairs", "covered", "start_ok", "end_ok"))))


def bounds_errors(chapters: DataFrame, n_pages: DataFrame | None = None) -> DataFrame:
    """(book_id, chapter_no, error) of ranges that end before they start, pass the last page, or overlap the next."""
    w = Window.partitionBy("book_id").orderBy("pdf_start_index", "pdf_end_index")
    rows = chapters.withColumn("next", F.lead("pdf_start_index").over(w))
    total = F.lit(None).cast("long")
    if n_pages is not None:
        rows, total = rows.join(n_pages, "book_id", "left"), F.col("n_pages")
    start, end = F.col("pdf_start_index"), F.col("pdf_end_index")
    errors = F.array_compact(F.array(F.when(start > end, "start after end"), F.when(end >= total, "end past last page"), F.when(end >= F.col("next"), "overlaps next")))
    return rows.select("book_id", "chapter_no", F.explode(errors).alias("error"))


def rank_strategies(metrics: DataFrame) -> DataFrame:
    """Adds a rank by F1 and flags the best; with a best F1 of 0 there is no best, and ties all are."""
    ordered = Window.orderBy(F.desc("f1"), "strategy")
    best = F.max("f1").over(Window.partitionBy())
    return metrics.withColumn("rank", F.row_number().over(ordered)).withColumn("is_best", (F.col("f1") == best) & (best > 0))


def report_tables(metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row for each book with each strategy's F1 in a column; pooled, ranked strategies)."""
    names = [r[0] for r in metrics.select("strategy").distinct().orderBy("strategy").limit(100).collect()]
    per_document = metrics.groupBy("book_id").pivot("strategy", names).agg(F.first("f1"))
    return per_document, rank_strategies(micro_metrics(metrics, "strategy"))


def strategy_report(expected: DataFrame, found: DataFrame, timed: DataFrame, applicable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row for each book and strategy that applies to it, a ranked row for each strategy).

    ``applicable`` are the (strategy, book_id) pairs that were tried: a strategy that had nothing to go by, such as an
    empty outline, is no pair and counts nowhere, while one that found nothing counts with zeros.  ``timed`` are runs
    (strategy, book_id, elapsed_seconds, date); times add up and the last date stands for a strategy.  Pooled counts
    make the rates, of boundaries and of printed ranges.
    """
    hits = range_matches(expected, found).groupBy("strategy", "book_id").agg(F.count_if("is_tp").alias("tp"), F.count(F.lit(1)).alias("found"))
    want = expected.select("book_id", "pdf_start_index", "pdf_end_index").distinct().groupBy("book_id").agg(F.count(F.lit(1)).alias("expected"))
    times = timed.groupBy("strategy", "book_id").agg(F.sum("elapsed_seconds").alias("elapsed_seconds"), F.max("date").alias("date"))
    rows = applicable.select("strategy", "book_id").distinct().join(want, "book_id", "left").join(hits, ["strategy", "book_id"], "left").join(times, ["strategy", "book_id"], "left")
    per_document = _rates(rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("tp", "found", "expected")}))
    cited = citation_micro(citation_metrics(citation_pairs(expected, found.join(applicable, ["strategy", "book_id"], "left_semi"))), "strategy")
    pooled = per_document.groupBy("strategy").agg(F.count(F.lit(1)).alias("n_books"), *(F.sum(c).alias(c) for c in ("tp", "found", "expected", "elapsed_seconds")), F.max("date").alias("date"))
    return per_document, rank_strategies(_rates(pooled)).join(cited, "strategy", "left")


def match_listing(predicted: DataFrame, expected: DataFrame, threshold: float = 70.0) -> DataFrame:
    """(book_id, matched): listing entries matched in order, by equal page value and resembling titles.

    Both tables have book_id, no, title and value.  Pairs are made by page value only; a greedy fold over each
    book's few pairs takes, entry by entry, the best that comes after the last one taken.
    """
    from folio.functions import fuzzy

    a = predicted.select("book_id", F.col("no").alias("a_no"), F.col("title").alias("a_title"), "value")
    b = expected.select("book_id", F.col("no").alias("b_no"), F.col("title").alias("b_title"), "value")
    pairs = a.join(b, ["book_id", "value"]).withColumn("score", fuzzy.token_sort_ratio(F.lower("a_title"), F.lower("b_title"))).filter(F.col("score") >= threshold)
    from folio.operators.evidence import fold_pairs

    return fold_pairs(pairs).groupBy("book_id").agg(F.count(F.lit(1)).alias("matched"))


def listing_scores(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """Per book: matched, found and expected listing entries with their rates."""
    n = lambda df, name: df.groupBy("book_id").agg(F.count(F.lit(1)).alias(name))
    rows = n(expected, "expected").join(n(predicted, "found"), "book_id", "full").join(match_listing(predicted, expected).withColumnRenamed("matched", "tp"), "book_id", "left")
    return _rates(rows.fillna(0, ["tp", "found", "expected"]))
