"""What redaction rests on: pools of words, the deterministic choice among them, and where two versions differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators.tables import apart


def word_pool(documents: DataFrame) -> DataFrame:
    """(lang, length, words): distinct lower-case words of each language by length, sorted."""
    words = documents.select("lang", F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("word")).filter("word <> ''").distinct()
    return words.groupBy("lang", F.length("word").alias("length")).agg(F.array_sort(F.collect_list("word")).alias("words"))


def pick(salt, page, start, word, size):
    """Fixed recipe: place in a pool of ``size``: the first eight bytes of a hash of salt, page, offset and word."""
    digest = F.sha2(F.concat_ws(":", salt.cast("string"), page.cast("string"), start.cast("string"), F.lower(word)), 256)
    # the number in halves of 32 bits, as it would be a decimal in one piece
    high, low = (F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))
    n = size.cast("long")
    return (((high % n) * (F.lit(1 << 32) % n) + low % n) % n).cast("int")


def boundary_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, book_id, start, end): page ranges that only one of two versions has."""
    ranges = lambda df: df.select("book_id", F.col("pdf_start_index").alias("start"), F.col("pdf_end_index").alias("end")).distinct()
    x, y = ranges(a), ranges(b)
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))


def drifted_pages(real: DataFrame, redacted: DataFrame) -> DataFrame:
    """(book_id, page_index) where an entry is found on one version's page and not on the other's."""
    a = real.select("book_id", "entry_no", F.col("page_index").alias("a"))
    b = redacted.select("book_id", "entry_no", F.col("page_index").alias("b"))
    moved = a.join(apart(b), ["book_id", "entry_no"], "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    return moved.select("book_id", F.explode(F.array_compact(F.array("a", "b"))).alias("page_index")).distinct()
