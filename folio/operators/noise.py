"""Scan noise for training: copies of layout lines with the small disorders that scanned pages show.

Every random number is a hash of the book, the page and the line it is for, so a copy is the same however its rows are
dealt out.  Copies are marked, and classifiers train on them but are never judged by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Copies of each font size, their spread, the pull towards the body's size, and the spread of boxes and pages.
CLONES = 4
FONT = (0.96, 1.04)
CONTRAST = (0.3, 0.7)
BOX = (0.99, 1.01)
DRIFT = (-5.0, 5.0)


def uniform(low: float, high: float, *keys) -> Column:
    """A number between ``low`` and ``high`` that depends on the keys alone: eight hexadecimal digits of a hash of them, as a fraction."""
    digest = F.md5(F.concat_ws("|", *((F.lit(k) if isinstance(k, str) else k).cast("string") for k in keys)))
    share = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2.0**32
    return F.lit(low) + share * F.lit(high - low)


def body_sizes(lines: DataFrame) -> DataFrame:
    """(book_id, body): the font size of most lines of a book, that of the earliest line on ties."""
    n = lines.filter("font is not null").groupBy("book_id", "font").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page_index", "line_no")).alias("first"))
    w = Window.partitionBy("book_id").orderBy(F.desc("n"), "first")
    return n.withColumn("rank", F.row_number().over(w)).filter("rank = 1").select("book_id", F.col("font").alias("body"))


def with_scan_noise(lines: DataFrame) -> DataFrame:
    """A copy of ``lines`` (book_id, page_index, line_no, font, hpos, vpos, width, ...) with the noise of a scan, and ``augmented`` true.

    Each font size is drawn towards the body's by a share of its own for each book and then takes one of four sizes a
    few hundredths around that; boxes change by a hundredth, and a page's lines move together by up to five points,
    never before the page's edge.  Text, order and pages stay, and so do labels.
    """
    book, page, line = F.col("book_id"), F.col("page_index"), F.col("line_no")
    rows = lines.join(body_sizes(lines), "book_id", "left")
    pulled = F.col("body") + (F.col("font") - F.col("body")) * uniform(*CONTRAST, "contrast", book)
    clone = F.floor(uniform(0.0, CLONES, "clone", book, page, line)).cast("int")
    font = F.round(pulled * uniform(*FONT, "font", book, F.round("font", 3), clone), 3)
    box = lambda c, axis: F.greatest(F.lit(0.0), F.round((F.col(c) + uniform(*DRIFT, f"drift-{axis}", book, page)) * uniform(*BOX, c, book, page, line), 2))
    made = {"font": font, "hpos": box("hpos", "x"), "vpos": box("vpos", "y"), "width": F.round(F.col("width") * uniform(*BOX, "width", book, page, line), 2)}
    return rows.select(*(made[c].alias(c) if c in made else F.col(c) for c in lines.columns), F.lit(True).alias("augmented"))
