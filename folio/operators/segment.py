"""Segmentation of whole corpora: the contents heuristic, outlines, merged evidence and stored model answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators import boundaries, locate, toc
from folio.operators.tables import stored


def page_facts(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(page counts, tops of pages without running headers, their heads, their printed numbers): what every method needs."""
    n_pages = stored(toc.page_counts(pages))
    headers = stored(locate.page_headers(pages, n_pages))
    bare, heads = locate.page_tops(pages, headers, boundaries.BLANK_CHARS)
    numbers = stored(boundaries.infer_printed(boundaries.page_numbers(pages)))
    return n_pages, bare, heads, numbers


def segment_entries(pages: DataFrame, entries: DataFrame, source: str = "heuristic", facts=None) -> tuple[DataFrame, DataFrame]:
    """(chapters, located) for given contents entries; pages that hold entries are no content."""
    n_pages, bare, heads, numbers = facts or page_facts(pages)
    listed = entries.filter("source_page_index >= 0").select("book_id", F.col("source_page_index").alias("page_index")).distinct()
    located, closed = locate.locate_entries(entries, n_pages, bare, heads, listed)
    located = stored(located if "source" in located.columns else located.withColumn("source", F.lit(source)))
    return boundaries.chapters(numbers, n_pages, located, heads, closed), located


def segment(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chapters, books_summary) of a corpus from its printed contents alone."""
    entries = stored(toc.toc_entries(pages))
    found, located = segment_entries(pages, entries)
    return found, boundaries.book_summary(pages, entries, located, found)
