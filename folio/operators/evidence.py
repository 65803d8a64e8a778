"""Chapters known from other sources: outlines, bibliographic records and catalogs, aligned and merged in book order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import fuzzy
from folio.functions import pagenum as N
from folio.functions import text as T
from folio.operators.tables import apart, stored

ALIGN = 70.0
BOOK_TITLE = 90.0


def crossref_chapters(raw: DataFrame) -> DataFrame:
    """Evidence rows of stored book records: (book_id, items ARRAY<STRUCT<DOI, title, subtitle, author, page, type>>)."""
    rows = raw.select("book_id", F.posexplode("items").alias("cand_no", "x")).filter("x.type = 'book-chapter'")
    title = F.get("x.title", F.lit(0))
    people = F.transform(F.filter("x.author", lambda a: F.coalesce(a["family"], F.lit("")) != ""), lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"])))
    return rows.select(
        "book_id", "cand_no", F.concat_ws(": ", title, F.get("x.subtitle", F.lit(0))).alias("title"), F.coalesce(people, F.array().cast("array<string>")).alias("authors"),
        N.first_page(F.col("x.page")).alias("printed_page_number"), F.lit(None).cast("int").alias("pdf_page_index"), F.col("x.DOI").alias("chapter_doi"), F.lit("crossref").alias("source"), F.lit(0.9).alias("metadata_confidence"),
    ).filter(F.col("title") != "")


def catalog_score(book: str = "b", section: str = "s"):
    """How well a catalog section fits a book: the same ISBN is certain, else year, publisher and editors add up."""
    b, s = (lambda c: F.col(f"{book}.{c}")), (lambda c: F.col(f"{section}.{c}"))
    isbn = T.normalize_isbn(b("isbn")) == T.normalize_isbn(s("isbn"))
    year = F.when(b("year") == T.year_of(s("date")), 0.15).otherwise(0.0)
    publisher = F.when((F.lower(F.trim(b("publisher"))) == F.lower(F.trim(s("publisher")))) & (F.trim(b("publisher")) != ""), 0.15).otherwise(0.0)
    editors = F.when(F.arrays_overlap(b("editors"), s("editors")), 0.2).otherwise(0.0)
    return F.when(isbn, 1.0).otherwise(F.least(F.lit(1.0), F.lit(0.6) + year + publisher + editors))


def catalog_candidates(books: DataFrame, sections: DataFrame) -> DataFrame:
    """Sections whose book title is the book's own; of several for one chapter title the surest stays."""
    joined = books.alias("b").join(sections.alias("s"), F.trim("b.title") == F.trim("s.book_title"))
    rows = joined.select(F.col("b.book_id"), F.col("s.title"), "s.authors", N.first_page(F.col("s.pages")).alias("printed_page_number"), F.col("s.doi").alias("chapter_doi"), catalog_score().alias("metadata_confidence"), F.col("s.cand_no"))
    w = Window.partitionBy("book_id", "title").orderBy(F.desc("metadata_confidence"), "cand_no")
    rows = rows.withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")
    return rows.withColumn("source", F.lit("catalog")).withColumn("pdf_page_index", F.lit(None).cast("int"))


def drop_book_title(evidence: DataFrame, books: DataFrame, threshold: float = BOOK_TITLE) -> DataFrame:
    """Without rows whose title is the book's own under another order of words."""
    rows = evidence.join(apart(books.select("book_id", F.col("title").alias("__book"))), "book_id", "left")
    score = fuzzy.token_sort_ratio(F.lower("title"), F.lower("__book"))
    return rows.withColumn("__score", score).filter("__book is null or __score < " + str(threshold)).drop("__book", "__score")


def fold_pairs(pairs: DataFrame) -> DataFrame:
    """Ordered greedy choice among scored pairs (book_id, a_no, b_no, score): each a takes the best b after the last one.

    A book has tens of entries; its pairs are folded in the JVM.
    """
    options = F.array_sort(F.collect_list(F.struct("a_no", (-F.col("score")).alias("neg"), "b_no")))
    start = F.struct(F.array().cast("array<struct<a_no:int,b_no:int>>").alias("out"), F.lit(-1).alias("last_b"), F.lit(-1).alias("last_a"))

    def step(s, x):
        take = (x["b_no"] > s["last_b"]) & (x["a_no"] != s["last_a"])
        pair = F.array(F.struct(x["a_no"].cast("int").alias("a_no"), x["b_no"].cast("int").alias("b_no")))
        return F.struct(F.when(take, F.concat(s["out"], pair)).otherwise(s["out"]).alias("out"), F.when(take, x["b_no"].cast("int")).otherwise(s["last_b"]).alias("last_b"), F.when(take, x["a_no"].cast("int")).otherwise(s["last_a"]).alias("last_a"))

    folded = pairs.groupBy("book_id").agg(options.alias("options")).select("book_id", F.aggregate("options", start, step)["out"].alias("out"))
    return folded.select("book_id", F.inline("out"))


def align(a: DataFrame, b: DataFrame, threshold: float = ALIGN) -> DataFrame:
    """(book_id, a_no, b_no): titles of two lists matched in order; only titles of one book meet."""
    left = a.select("book_id", F.col("cand_no").alias("a_no"), F.lower("title").alias("a_title"))
    right = b.select("book_id", F.col("cand_no").alias("b_no"), F.lower("title").alias("b_title"))
    pairs = left.join(apart(right), "book_id").withColumn("score", fuzzy.token_sort_ratio("a_title", "b_title")).filter(F.col("score") >= threshold)
    return fold_pairs(pairs)


def book_order(evidence: DataFrame) -> DataFrame:
    """``cand_no`` in order of printed page, unknown ones last."""
    w = Window.partitionBy("book_id").orderBy(F.asc_nulls_last("printed_page_number"), "cand_no", "title")
    return evidence.withColumn("cand_no", F.row_number().over(w) - 1)


EVIDENCE = ("title", "authors", "printed_page_number", "pdf_page_index", "chapter_doi", "source", "metadata_confidence")


def _paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """(book_id, p, q, cand_no): rows of both lists, matched ones side by side."""
    pairs = align(a, b)
    p = a.select("book_id", F.col("cand_no").alias("a_no"), F.struct(*EVIDENCE).alias("p"))
    q = b.select("book_id", F.col("cand_no").alias("b_no"), F.struct(*EVIDENCE).alias("q"))
    left = p.join(apart(pairs), ["book_id", "a_no"], "left").join(apart(q), ["book_id", "b_no"], "left")
    alone = q.join(apart(pairs), ["book_id", "b_no"], "left_anti").withColumn("p", F.lit(None).cast(p.schema["p"].dataType)).withColumn("a_no", F.col("b_no") + 1_000_000)
    return left.select("book_id", F.col("a_no").alias("cand_no"), "p", "q").unionByName(alone.select("book_id", F.col("a_no").alias("cand_no"), "p", "q"))


def _merge_two(a: DataFrame, b: DataFrame) -> DataFrame:
    rows = _paired(a, b)
    q_wins = F.col("p").isNull() | (F.col("q.metadata_confidence") > F.col("p.metadata_confidence"))
    win = F.when(F.coalesce(q_wins, F.lit(False)), F.col("q")).otherwise(F.col("p"))
    sure = F.lower("p.chapter_doi") == F.lower("q.chapter_doi")
    rows = rows.select("book_id", "cand_no", win.alias("w"), F.coalesce(sure, F.lit(False)).alias("sure"))
    merged = rows.select("book_id", "cand_no", *(F.col(f"w.{c}").alias(c) for c in EVIDENCE if c != "metadata_confidence"), F.when(F.col("sure"), 1.0).otherwise(F.col("w.metadata_confidence")).alias("metadata_confidence"))
    return book_order(merged)


def merge_metadata(sources: list[DataFrame]) -> DataFrame:
    """Evidence lists merged by priority: the surer row wins, the earlier list on ties; equal DOIs make it certain."""
    merged = book_order(sources[0])
    for more in sources[1:]:
        merged = _merge_two(merged, book_order(more))
    return merged


def merge_outline(outline: DataFrame, metadata: DataFrame) -> DataFrame:
    """Outline and metadata rows merged; structural titles go first, and a matched row takes the outline's page."""
    plain = lambda df: df.filter(~T.is_structural(F.col("title")))
    rows = _paired(plain(outline), plain(metadata))
    both = F.col("p").isNotNull() & F.col("q").isNotNull()
    base = F.coalesce("q", "p")
    merged = rows.select(
        "book_id", "cand_no", base["title"].alias("title"), base["authors"].alias("authors"), F.coalesce(base["printed_page_number"], F.col("p.printed_page_number")).alias("printed_page_number"),
        F.coalesce(F.col("p.pdf_page_index"), F.col("q.pdf_page_index")).alias("pdf_page_index"), base["chapter_doi"].alias("chapter_doi"),
        F.when(both, F.concat(F.lit("outline+"), F.col("q.source"))).otherwise(base["source"]).alias("source"), base["metadata_confidence"].alias("metadata_confidence"),
    )
    return book_order(merged)


def dedupe_evidence(evidence: DataFrame, key: tuple[str, ...] = ("title", "authors", "printed_page_number", "pdf_page_index")) -> DataFrame:
    """One row of each key, the surest, the first on ties."""
    w = Window.partitionBy("book_id", *key).orderBy(F.desc("metadata_confidence"), "cand_no")
    return evidence.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def plausible_outlines(outline: DataFrame, n_pages: DataFrame, least: int = 2, pages_per_entry: tuple[int, int] = (3, 150)) -> DataFrame:
    """Books whose outlines can be their contents: enough real entries, and a sane number of pages for each."""
    real = outline.filter(~T.is_structural(F.col("title"))).groupBy("book_id").agg(F.count(F.lit(1)).alias("n"))
    return real.join(apart(n_pages), "book_id").filter((F.col("n") >= least) & (F.col("n_pages") / F.col("n")).between(*pages_per_entry)).select("book_id")


def segment_outline(numbers: DataFrame, n_pages: DataFrame, heads: DataFrame, outline: DataFrame) -> DataFrame:
    """Chapters straight from outline rows with a page: score 100, margin 20, confidence 0.98."""
    from folio.operators import boundaries

    rows = outline.join(apart(plausible_outlines(outline, n_pages)), "book_id", "left_semi").filter("pdf_page_index is not null")
    located = rows.select(
        "book_id", F.col("cand_no").alias("entry_no"), "title", "authors", F.col("printed_page_number").cast("string").alias("printed"), F.lit(False).alias("is_roman"),
        F.col("pdf_page_index").alias("page_index"), F.lit(100.0).alias("score"), F.lit(20.0).alias("margin"), F.lit("outline").alias("source"),
    )
    none = heads.select("book_id", "page_index").filter(F.lit(False))
    return boundaries.chapters(numbers, n_pages, located, heads, none).withColumn("confidence", F.lit(0.98))


def segment_evidence(pages: DataFrame, books: DataFrame, outline: DataFrame, sources: list[DataFrame]) -> DataFrame:
    """Chapters from merged evidence; entries without a page are located, books without evidence use their contents.

    Confidence is 0.98 for outline rows, else the evidence's times the match's.
    """
    from folio.operators import boundaries, locate, segment, toc

    facts = segment.page_facts(pages)
    n_pages, bare, heads, numbers = facts
    merged = stored(book_order(dedupe_evidence(drop_book_title(merge_outline(outline, merge_metadata(sources)), books))))
    listed = stored(toc.toc_entries(pages))
    contents = listed.select("book_id", F.col("source_page_index").alias("page_index")).distinct()
    common = merged.select("book_id", F.col("cand_no").alias("entry_no"), "title", "authors", F.col("printed_page_number").cast("string").alias("printed"), F.lit(False).alias("is_roman"), "pdf_page_index", "source", "metadata_confidence")
    fixed = common.filter("pdf_page_index is not null").withColumn("page_index", F.col("pdf_page_index")).withColumn("score", F.lit(100.0)).withColumn("margin", F.lit(20.0))
    open_rows = common.filter("pdf_page_index is null").withColumn("title_variants", F.array().cast("array<string>")).withColumn("source_page_index", F.lit(-1))
    found, closed = locate.locate_entries(open_rows, n_pages, bare, heads, contents)
    columns = ["book_id", "entry_no", "title", "authors", "printed", "is_roman", "page_index", "score", "margin", "source"]
    located = fixed.select(*columns).unionByName(found.select(*columns))
    rows = boundaries.chapters(numbers, n_pages, located, heads, closed)
    sure = apart(merged).join(located.select("book_id", F.col("entry_no").alias("cand_no"), F.col("page_index").alias("pdf_start_index")), ["book_id", "cand_no"])
    last = sure.groupBy("book_id", "pdf_start_index").agg(F.max_by("metadata_confidence", "cand_no").alias("meta"))
    rows = rows.join(apart(last), ["book_id", "pdf_start_index"], "left")
    rows = rows.withColumn("confidence", F.when(F.col("source").startswith("outline"), 0.98).otherwise(F.bround(F.coalesce("meta", F.lit(1.0)) * F.col("confidence"), 2))).drop("meta")
    bare_books = pages.join(apart(merged.select("book_id").distinct()), "book_id", "left_anti")
    rest, _ = segment.segment(bare_books)
    return rows.unionByName(rest)
