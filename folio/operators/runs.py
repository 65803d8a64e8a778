"""Stored results of outside models: latest wins, coverage, choice of models, and what is left to run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most requests in a model's queue for it to count as free.
FREE_DEMAND = 5


def upsert_runs(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("book_id", "model_id"), order: tuple[str, ...] = ("generated_at", "run_id")) -> DataFrame:
    """Both tables with one row of each key, that generated last."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return old.unionByName(new).withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def cached_models(runs: DataFrame) -> DataFrame:
    return runs.select("model_id").distinct()


def covered_models(runs: DataFrame, books: DataFrame) -> DataFrame:
    """Models with a run for every book."""
    total = books.agg(F.count_distinct("book_id").alias("n_books"))
    per_model = runs.join(books.select("book_id").distinct(), "book_id", "left_semi").groupBy("model_id").agg(F.count_distinct("book_id").alias("n"))
    return per_model.join(total, per_model["n"] == total["n_books"]).select("model_id")


def best_model(metrics: DataFrame) -> DataFrame:
    """Per corpus the model with the best pooled F1, the quicker one on ties, then the lesser name."""
    w = Window.partitionBy("corpus").orderBy(F.desc("f1"), "elapsed_seconds", "model_id")
    return metrics.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").select("corpus", "model_id")


def latest_run_date(runs: DataFrame) -> DataFrame:
    return runs.groupBy("model_id").agg(F.max(F.substring(F.col("generated_at").cast("string"), 1, 10)).alias("date"))


def least_loaded(models: DataFrame, limit: int = 5) -> DataFrame:
    """The models with the shortest queues, up to ``limit``, among those that are free enough."""
    return models.filter(F.col("demand") <= FREE_DEMAND).orderBy("demand", "model_id").limit(limit)


def gap_fill(models: DataFrame, covered: DataFrame, limit: int = 5) -> DataFrame:
    return models.filter(F.col("demand") <= FREE_DEMAND).join(covered, "model_id", "left_anti").orderBy("demand", "model_id").limit(limit)


def full_regen(models: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(offered models that have runs, models with runs that are no longer offered)."""
    return models.join(cached, "model_id", "left_semi"), cached.join(models.select("model_id"), "model_id", "left_anti")


def worklist(books: DataFrame, results: DataFrame, keys: tuple[str, ...] = ("book_id", "version", "mode")) -> DataFrame:
    """Books without a readable result of their version and mode."""
    done = results.filter("corrupt is null or not corrupt") if "corrupt" in results.columns else results
    return books.join(done.select(*keys).distinct(), list(keys), "left_anti")


def choose_pages(text_pages: DataFrame, ocr_pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages of each book: its text layer if good enough, else recognised text that is; books without either)."""
    good_text = needs_ocr(text_pages).filter("not needs_ocr").select("book_id")
    good_ocr = needs_ocr(ocr_pages).filter("not needs_ocr").select("book_id").join(good_text, "book_id", "left_anti")
    chosen = text_pages.join(good_text, "book_id", "left_semi").unionByName(ocr_pages.join(good_ocr, "book_id", "left_semi"))
    known = text_pages.select("book_id").union(ocr_pages.select("book_id")).distinct()
    skipped = known.join(good_text.union(good_ocr), "book_id", "left_anti").withColumn("reason", F.lit("no readable text"))
    return chosen, skipped


def needs_ocr(pages: DataFrame, full: int = 500, least_share: float = 0.1, few_lines: int = 3) -> DataFrame:
    """(book_id, needs_ocr): too few full pages, or most of those without line breaks."""
    from folio.functions.text import strip

    stripped = strip(F.coalesce("text", F.lit("")))
    breaks = F.length(F.col("text")) - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    rows = pages.select("book_id", (F.length(stripped) > full).alias("full"), (breaks < few_lines).alias("flat"))
    return rows.groupBy("book_id").agg(F.count_if("full").alias("n_full"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("full") & F.col("flat")).alias("n_flat")).select(
        "book_id", ((F.col("n_full") < least_share * F.col("n")) | (F.col("n_flat") > 0.5 * F.col("n_full"))).alias("needs_ocr")
    )
