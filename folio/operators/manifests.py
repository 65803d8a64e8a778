"""Manifest work: where a book's file and license come from, what needs a look, and which rows change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import curate

#: Content types under which files are registered.
FILE_TYPES = ("application/pdf", "unspecified")


def link_choice(links: Column) -> Column:
    """The address of the first of (url, content_type) links that is a file."""
    return F.get(F.filter(links, lambda x: x["content_type"].isin(*FILE_TYPES)), F.lit(0))["url"]


def resolve_pdf_url(works: DataFrame, unpaywall: DataFrame, openalex: DataFrame) -> DataFrame:
    """``works`` with url and url_source: their own link, else what (doi, url) tables of two other services have.

    An empty address counts as none; a work without a DOI has only its own links.
    """
    first = lambda df, name: df.filter("doi is not null and url <> ''").groupBy("doi").agg(F.min("url").alias(name))
    rows = works.join(first(unpaywall, "second"), "doi", "left").join(first(openalex, "third"), "doi", "left")
    own = link_choice(F.col("links"))
    own = F.when(own != "", own)
    source = F.when(own.isNotNull(), "crossref").when(F.col("second").isNotNull(), "unpaywall").when(F.col("third").isNotNull(), "openalex")
    return rows.select(*works.columns, F.coalesce(own, "second", "third").alias("url"), source.alias("url_source"))


def discover(works: DataFrame, known: DataFrame, unpaywall: DataFrame, openalex: DataFrame, manifests: DataFrame, languages: DataFrame, per_language: int = 5) -> DataFrame:
    """New works with a file to fetch, the first of each wanted language, rarest language in the manifests first."""
    fresh = resolve_pdf_url(curate.new_candidates(works, known), unpaywall, openalex).filter("url is not null")
    return curate.language_quota(fresh, curate.language_priority(manifests, languages), per_language)


def resolved_licenses(books: DataFrame, items: DataFrame, fallback: DataFrame) -> DataFrame:
    """(book_id, license, license_source): what most chapter records of a book say, else the code of a fallback table (doi, code)."""
    votes = items.select("book_id", "item_no", T.license_url(F.col("licenses")).alias("license"))
    own = curate.majority(votes, "book_id", "license", "item_no").withColumnRenamed("license", "own")
    other = fallback.filter("doi is not null").groupBy("doi").agg(F.min("code").alias("code")).select("doi", T.license_code_url(F.col("code")).alias("other"))
    rows = books.select("book_id", "doi").join(own, "book_id", "left").join(other, "doi", "left")
    source = F.when(F.col("own").isNotNull(), "crossref").when(F.col("other").isNotNull(), "unpaywall")
    return rows.select("book_id", F.coalesce("own", "other").alias("license"), source.alias("license_source"))


def review_flags(books: DataFrame, chapters: DataFrame, licenses: DataFrame) -> DataFrame:
    """(book_id, reason) of books whose records need a look."""
    n = chapters.groupBy("book_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("citation_pages", F.lit("")) == "").alias("missing"))
    rows = books.select("book_id").join(n, "book_id", "left").join(licenses, "book_id", "left")
    counts = F.when(F.coalesce("n", F.lit(0)) == 0, "zero book-chapter records").when(F.col("missing") > 0, F.concat(F.col("missing").cast("string"), F.lit(" chapter(s) missing page range")))
    return rows.select("book_id", F.explode(F.array_compact(F.array(counts, F.when(F.col("license").isNull(), "no license found")))).alias("reason"))


def license_updates(manifest: DataFrame, licenses: DataFrame) -> DataFrame:
    """The manifest rows that change: (book_id, license, license_source, checked) where something new is known.

    ``manifest`` has ``checked``, false where a license was never looked for: a row that was looked for without finding
    any is left alone while nothing is found, one that never was is written.
    """
    now = licenses.select("book_id", F.col("license").alias("new_license"), F.col("license_source").alias("new_source"))
    rows = manifest.join(now, "book_id")
    changed = ~F.coalesce("checked", F.lit(False)) | ~F.col("license").eqNullSafe(F.col("new_license")) | ~F.col("license_source").eqNullSafe(F.col("new_source"))
    return rows.filter(changed).select("book_id", F.col("new_license").alias("license"), F.col("new_source").alias("license_source"), F.lit(True).alias("checked"))


def updated(manifest: DataFrame, changes: DataFrame) -> DataFrame:
    """``manifest`` with changed rows in place of the old ones."""
    new = changes.select("book_id", F.struct("license", "license_source", "checked").alias("new"))
    rows = manifest.join(new, "book_id", "left")
    pick = lambda c: F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c)
    return rows.select(*(pick(c) if c in ("license", "license_source", "checked") else F.col(c) for c in manifest.columns))


PROMOTION = ("not in the manifest", "no ground truth", "no pages", "bounds errors", "ok")


def promote(wanted: DataFrame, pending: DataFrame, target: DataFrame, truth: DataFrame, n_pages: DataFrame, licenses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcome of each wanted book, the pending manifest without those that pass, the target manifest with them).

    ``truth`` are chapters with ranges; a book already in the target replaces nothing and is not added twice.
    """
    from folio.operators import evaluate

    flag = lambda df, name: df.select("book_id").distinct().withColumn(name, F.lit(True))
    errors = evaluate.bounds_errors(truth.join(wanted.select("book_id"), "book_id", "left_semi"), n_pages)
    rows = wanted.select("book_id").distinct()
    for df, name in ((pending, "listed"), (truth, "has_truth"), (n_pages, "has_pages"), (errors, "wrong")):
        rows = rows.join(flag(df, name), "book_id", "left")
    outcome = F.when(F.col("listed").isNull(), PROMOTION[0]).when(F.col("has_truth").isNull(), PROMOTION[1]).when(F.col("has_pages").isNull(), PROMOTION[2]).when(F.col("wrong"), PROMOTION[3]).otherwise(PROMOTION[4])
    outcomes = rows.select("book_id", outcome.alias("outcome"))
    passed = outcomes.filter("outcome = 'ok'").select("book_id")
    moved = updated(pending.join(passed, "book_id", "left_semi"), licenses.withColumn("checked", F.lit(True)))
    added = moved.join(target.select("book_id"), "book_id", "left_anti")
    return outcomes, pending.join(passed, "book_id", "left_anti"), target.unionByName(added.select(*target.columns))
