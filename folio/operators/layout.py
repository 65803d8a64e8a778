"""Page layout: features of a page's lines, their context in the book, labels and noise statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import ranks


def measured(lines: DataFrame) -> DataFrame:
    """Lines with what their content tells, whether one ends in a number or is a heading, in place of the content."""
    if "content" not in lines.columns:
        return lines
    return lines.withColumn("ends_in_number", T.ends_in_number(F.col("content"))).withColumn("is_heading", T.is_heading_line(F.col("content"))).drop("content")


def page_features(lines: DataFrame) -> DataFrame:
    """A row for each page of (book_id, page_index, line_no, content, hpos, vpos, width, height, font, page_width, page_height).

    Lines may be ``measured`` already.
    """
    lines = measured(lines)
    # a plain number, as structures would have all lines sorted; lines without one come first
    ordered = F.coalesce(F.col("line_no").cast("long"), F.lit(-(1 << 63)))
    fonts = lines.groupBy("book_id", "page_index", "font").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first"))
    w = Window.partitionBy("book_id", "page_index").orderBy(F.desc("n"), "first")
    modal = fonts.filter("font is not null").withColumn("rank", F.row_number().over(w)).filter("rank = 1").select("book_id", "page_index", F.col("font").alias("modal_font"))
    share = lambda c, page: F.col(c) / F.col(page)
    spread = lambda c, page: F.coalesce(F.var_samp(share(c, page)), F.lit(0.0))
    rows = lines.groupBy("book_id", "page_index").agg(
        F.count(F.lit(1)).alias("line_count"), F.avg(share("width", "page_width")).alias("width_mean"), spread("width", "page_width").alias("width_var"),
        F.avg(share("hpos", "page_width")).alias("left_mean"), spread("hpos", "page_width").alias("left_var"), (F.count_if("ends_in_number") / F.count(F.lit(1))).alias("number_share"),
        F.max("font").alias("max_font"), F.min_by(share("vpos", "page_height"), ordered).alias("first_top"), F.max_by(share("vpos", "page_height"), ordered).alias("last_top"), F.min_by("is_heading", ordered).alias("heads"),
    )
    return rows.join(modal, ["book_id", "page_index"], "left").withColumn("font_ratio", F.col("max_font") / F.col("modal_font"))


def book_medians(features: DataFrame) -> DataFrame:
    return features.groupBy("book_id").agg(F.median("line_count").alias("median_lines"), F.coalesce(F.median("modal_font"), F.lit(1.0)).alias("body_font"))


def context_features(features: DataFrame, n_pages: DataFrame) -> DataFrame:
    """Adds features of the page before (0 where that page has none), distance from the edges and the book's medians."""
    w = Window.partitionBy("book_id").orderBy("page_index")
    follows = F.lag("page_index").over(w) == F.col("page_index") - 1
    rows = features.withColumn("previous_lines", F.when(follows, F.lag("line_count").over(w)).otherwise(0)).withColumn("previous_numbers", F.when(follows, F.lag("number_share").over(w)).otherwise(0.0))
    rows = rows.join(book_medians(features), "book_id").join(n_pages, "book_id")
    edge = F.least(F.col("page_index"), F.col("n_pages") - 1 - F.col("page_index"))
    return rows.withColumn("edge_distance", edge).withColumn("lines_to_median", F.col("line_count") / F.greatest("median_lines", F.lit(1.0))).withColumn("font_to_body", F.coalesce(F.col("max_font") / F.col("body_font"), F.lit(0.0)))


def page_labels(pages: DataFrame, expected: DataFrame, toc: DataFrame) -> DataFrame:
    """(book_id, page_index, label): chapter_first over toc over other; books whose contents were never recorded are left out."""
    firsts = expected.select("book_id", F.col("pdf_start_index").alias("page_index")).distinct().withColumn("is_first", F.lit(True))
    rows = pages.select("book_id", "page_index").join(toc.filter("has_toc_field").select("book_id", "toc_start", "toc_end"), "book_id").join(firsts, ["book_id", "page_index"], "left")
    return rows.select("book_id", "page_index", F.when(F.col("is_first"), "chapter_first").when(F.col("page_index").between(F.col("toc_start"), F.col("toc_end")), "toc").otherwise("other").alias("label"))


def lost_pages(labels: DataFrame, features: DataFrame) -> DataFrame:
    return labels.join(features.select("book_id", "page_index"), ["book_id", "page_index"], "left_anti").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def noise_summary(values: DataFrame) -> DataFrame:
    """count, min, max, mean, median and sample deviation of the column ``value``; the median by counted ranges."""
    told = values.agg(F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("stdev"))
    middle = ranks.percentile(values.select(F.col("value").cast("double").alias("p")), 0.5).select(F.col("value").alias("median"), F.lit(1).alias("one"))
    return told.withColumn("one", F.lit(1)).join(middle, "one", "left").select("n", "min", "max", "mean", "median", "stdev")


def contrast_ratios(lines: DataFrame) -> DataFrame:
    """(value): greatest to modal font of each page."""
    return page_features(lines).select(F.col("font_ratio").alias("value")).filter("value is not null")


def lobo_summary(per_book: DataFrame, *keys: str, recall: float = 0.9, share: float = 0.15) -> DataFrame:
    """Share of books with full recall, mean share of pages kept, and whether both meet the bar."""
    rows = per_book.groupBy(*keys).agg(F.avg(F.col("full_recall").cast("double")).alias("full_recall"), F.avg("candidate_share").alias("candidate_share"))
    return rows.withColumn("meets_bar", (F.col("full_recall") >= recall) & (F.col("candidate_share") <= share))
