"""From located entries to chapters: ends, trimming, printed page ranges and confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import pagenum as N
from folio.functions import text as T
from folio.operators.tables import apart, stored, worked_out
from folio.operators.toc import page_counts

BLANK_CHARS = 150
INFER_GAP = 10
#: Fixed value: a roman numeral that numbers a title.
ROMAN_PREFIX = r"^[IVXLCDM]+\.\s"


def match_confidence(score, margin):
    """From 0.5 to 1: how far score and margin lie above what a match needs; rounded half to even."""
    strength = F.lit(0.4) * (score - 80.0) / 20.0 + F.lit(0.6) * F.least(margin / 20.0, F.lit(1.0))
    return F.bround(F.lit(0.5) + F.lit(0.5) * strength, 2)


def page_numbers(pages: DataFrame) -> DataFrame:
    """(book_id, page_index, printed, value, is_roman): the number read on each page, and its value if it has one."""
    # read once: kept apart so that the reading is not repeated for every use of it
    full = worked_out(worked_out(pages.select("book_id", "page_index", "text"), raw=F.split("text", r"\R")).drop("text"), full=N.full_lines("raw"))
    rows = stored(full.select("book_id", "page_index", N.printed_of_lines(F.col("full")).alias("printed")))
    return rows.select("book_id", "page_index", "printed", N.page_value(F.col("printed")).alias("value"), (~F.col("printed").rlike(r"^\d+$")).alias("is_roman"))


def infer_printed(numbers: DataFrame, max_gap: int = INFER_GAP) -> DataFrame:
    """Adds ``inferred``: a page's number from the nearest read ones before and after it, if both agree."""
    anchor = F.when(F.col("value").isNotNull(), F.struct((F.col("value") - F.col("page_index")).alias("offset"), F.col("is_roman").alias("roman")))
    w = Window.partitionBy("book_id").orderBy("page_index")
    rows = numbers.withColumn("anchor", anchor)
    rows = rows.withColumn("before", F.last("anchor", ignorenulls=True).over(w.rangeBetween(-max_gap, 0)))
    rows = rows.withColumn("after", F.first("anchor", ignorenulls=True).over(w.rangeBetween(0, max_gap)))
    agree = (F.col("before.offset") == F.col("after.offset")) & (F.col("before.roman") == F.col("after.roman"))
    return rows.withColumn("inferred", F.when(agree, N.format_page(F.col("page_index") + F.col("before.offset"), F.col("before.roman")))).drop("anchor", "before", "after")


def roman_marks_dividers(located: DataFrame) -> DataFrame:
    """Adds ``divider``: a roman prefix marks part dividers where some, and at most half, of a book's entries have one."""
    w = Window.partitionBy("book_id")
    prefixed = F.col("title").rlike(ROMAN_PREFIX)
    marks = F.count_if(prefixed).over(w)
    return located.withColumn("divider", prefixed & (marks > 0) & (marks <= F.floor(F.count(F.lit(1)).over(w) / 2)))


def chapter_ends(located: DataFrame, n_pages: DataFrame) -> DataFrame:
    """Adds start and end (the page before the next located entry, or the last page), and the next entry's number.

    Structural entries bound their neighbours and are dropped after that, as are ranges that end before they start.
    """
    w = Window.partitionBy("book_id").orderBy("page_index", "entry_no")
    rows = roman_marks_dividers(located).join(apart(n_pages), "book_id")
    rows = rows.withColumn("next_start", F.lead("page_index").over(w)).withColumn("next_printed", F.lead("printed").over(w)).withColumn("next_roman", F.lead("is_roman").over(w))
    rows = rows.withColumn("start", F.col("page_index")).withColumn("end", F.coalesce(F.col("next_start") - 1, F.col("n_pages") - 1))
    return rows.filter(~(T.is_structural(F.col("title")) | F.col("divider"))).filter(F.col("end") >= F.col("start")).drop("divider")


def trim_ends(ranges: DataFrame, heads: DataFrame, closed: DataFrame) -> DataFrame:
    """``end`` moved back over pages that are closed (not for outline sources) or almost blank, never before ``start``.

    ``heads`` say of each page whether it is full without its running headers.  The last page with content up to
    each page is carried forward, so a range needs one lookup.
    """
    marked = heads.select("book_id", "page_index", "full").join(apart(closed.select("book_id", "page_index").distinct().withColumn("closed", F.lit(True))), ["book_id", "page_index"], "left")
    w = Window.partitionBy("book_id").orderBy("page_index").rowsBetween(Window.unboundedPreceding, 0)
    page = F.col("page_index")
    carried = marked.select("book_id", page.alias("end"), F.last(F.when(F.col("full") & F.col("closed").isNull(), page), True).over(w).alias("open"), F.last(F.when(F.col("full"), page), True).over(w).alias("any"))
    rows = ranges.join(apart(carried), ["book_id", "end"], "left")
    last = F.when(F.col("source").startswith("outline"), F.col("any")).otherwise(F.col("open"))
    return rows.withColumn("end", F.greatest(F.col("start"), F.coalesce(last, F.col("start")))).drop("open", "any")


def citation_pages(ranges: DataFrame, numbers: DataFrame) -> DataFrame:
    """Adds citation_pages and page_mapping_confidence (high, inferred or unmappable).

    Start: what the contents declare, else what the page shows, else what its neighbours imply.  End: one before
    what the next entry declares in the same numbering, else as for the start, else the page before the next
    entry if its number fits.  "high" needs both ends read: the start declared or shown, the end shown.
    """
    shown = numbers.select("book_id", "page_index", "printed", "inferred")
    at = lambda name: shown.select("book_id", F.col("page_index").alias(name), F.col("printed").alias(f"{name}_shown"), F.col("inferred").alias(f"{name}_inferred"))
    rows = ranges.withColumn("fallback", F.coalesce(F.col("next_start") - 1, F.col("n_pages") - 1))
    for name in ("start", "end", "fallback"):
        rows = rows.join(apart(at(name)), ["book_id", name], "left")
    declared = N.declared_page(F.col("printed"), F.col("is_roman"), F.col("n_pages"))
    next_declared = N.declared_page(F.col("next_printed"), F.col("next_roman"), F.col("n_pages"))
    stand_in = F.coalesce("fallback_shown", "fallback_inferred")
    rows = rows.withColumn("declared", declared).withColumn("next_declared", next_declared).withColumn("next_value", N.page_value(F.col("next_printed"))).withColumn("stand_value", N.page_value(stand_in))
    # narrow rows are kept here, or the optimizer would copy the numeral expressions into every use
    rows = stored(rows)
    rows = rows.withColumn("read", F.coalesce("declared", "start_shown")).withColumn("first", F.coalesce("read", "start_inferred"))
    follows = (F.col("next_roman") == F.col("is_roman")) & F.col("next_declared").isNotNull() & (F.col("next_value") > 1)
    rows = rows.withColumn("derived", F.when(follows, N.format_page(F.col("next_value") - 1, F.col("is_roman"))))
    fits = (F.col("stand_value") >= N.page_value(F.col("first"))) & (stand_in.rlike(r"^\d+$") == F.col("first").rlike(r"^\d+$"))
    rows = rows.withColumn("last", F.coalesce("derived", "end_shown", "end_inferred", F.when(fits, stand_in)))
    both = F.col("first").isNotNull() & F.col("last").isNotNull()
    high = F.col("read").isNotNull() & F.col("derived").isNull() & F.col("end_shown").isNotNull()
    rows = rows.withColumn("citation_pages", F.when(both, F.concat("first", F.lit("-"), "last")))
    rows = rows.withColumn("page_mapping_confidence", F.when(both & high, "high").when(both, "inferred").otherwise("unmappable"))
    extra = [f"{n}_{k}" for n in ("start", "end", "fallback") for k in ("shown", "inferred")]
    return rows.drop("fallback", "read", "first", "derived", "last", "declared", "next_declared", "next_value", "stand_value", *extra)


def chapters(numbers: DataFrame, n_pages: DataFrame, located: DataFrame, heads: DataFrame, closed: DataFrame) -> DataFrame:
    """The chapters table: one row for each chapter with its page range, printed range and confidences."""
    ranges = trim_ends(chapter_ends(located, n_pages), heads, closed)
    rows = citation_pages(ranges, numbers)
    w = Window.partitionBy("book_id").orderBy("start", "entry_no")
    return rows.select(
        "book_id", (F.row_number().over(w) - 1).alias("chapter_no"), "title", "authors", F.col("start").cast("int").alias("pdf_start_index"), F.col("end").cast("int").alias("pdf_end_index"),
        "citation_pages", match_confidence(F.col("score"), F.col("margin")).alias("confidence"), "page_mapping_confidence", "source",
    )


def book_summary(pages: DataFrame, entries: DataFrame, located: DataFrame, found: DataFrame) -> DataFrame:
    """One row for each book: page count, confidence (high if there is a chapter) and counts of each step."""
    n = lambda df, name: df.groupBy("book_id").agg(F.count(F.lit(1)).alias(name))
    sources = found.groupBy("book_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    rows = page_counts(pages).withColumnRenamed("n_pages", "total_pdf_pages")
    for df, name in ((entries, "entries"), (located, "located"), (found, "chapters")):
        rows = rows.join(apart(n(df, name)), "book_id", "left")
    rows = rows.join(apart(sources), "book_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(
        "book_id", "total_pdf_pages", F.when(zero(F.col("chapters")) > 0, "high").otherwise("low").alias("segmentation_confidence"),
        F.struct(*(zero(F.col(c)).alias(c) for c in ("entries", "located", "chapters")), F.coalesce("sources", F.array().cast("array<string>")).alias("sources")).alias("diagnostics"),
    )
