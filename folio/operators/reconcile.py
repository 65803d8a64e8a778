"""Ground truth drafted from records: chapters located in order or near their printed page, and gates that books pass.

Pages are scored against titles where they meet; what depends on order is folded per book in the JVM, and what depends
on a printed page joins the few pages around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import fuzzy
from folio.functions import pagenum as N
from folio.functions import text as T
from folio.operators import curate, evaluate, locate
from folio.operators.boundaries import BLANK_CHARS
from folio.operators.tables import stored

#: Characters at a page's top that a title is looked for in.
HEAD = 250
WINDOW = 6
AUTHOR_BONUS = 5.0
CONFIRMED = 90.0
MATCH = 85.0
#: Fixed value: a line of a contents page, as drafting tells it.
LISTING_LINE = r"(?U)^.{3,100}?[.\s]{1,}\d{1,4}\s*$"
LISTING_LINES = 3


def heads(pages: DataFrame) -> DataFrame:
    return pages.select("book_id", "page_index", F.lower(F.substring("text", 1, HEAD)).alias("head"))


def listing_pages(pages: DataFrame) -> DataFrame:
    """(book_id, page_index) of pages with enough lines that end in a number."""
    hits = F.size(F.filter(F.transform(T.lines(F.col("text")), T.strip), lambda x: x.rlike(LISTING_LINE)))
    return pages.filter(hits >= LISTING_LINES).select("book_id", "page_index")


def loose_numbers(pages: DataFrame) -> DataFrame:
    """(book_id, page_index, printed, value, is_roman): numbers as drafting reads them, positive ones only."""
    rows = stored(pages.select("book_id", "page_index", N.printed_number_loose(F.col("text")).alias("printed")))
    rows = rows.withColumn("value", N.page_value(F.col("printed"))).withColumn("is_roman", ~F.col("printed").rlike(r"^\d+$"))
    return rows.withColumn("value", F.when(F.col("value") > 0, F.col("value")))


def locate_sequential(entries: DataFrame, pages: DataFrame, excluded: DataFrame) -> DataFrame:
    """(book_id, entry_no, page_index, score): each entry's opening page, looked for after the page of the entry before it.

    ``entries`` are (book_id, entry_no, title, authors) in the book's order.  The best page with a score of 90 or more
    whose head names an author wins, else the best page by title alone; the first on ties; none if nothing is alike.
    A book's scores, a number for each entry and page, are one row that is gone through in the entries' order.
    """
    own = entries.select("book_id", "entry_no", F.lower("title").alias("title"), "authors")
    told = own.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("entry_no", "title", "authors"))).alias("entries"))
    top = heads(pages).join(excluded.select("book_id", "page_index").distinct(), ["book_id", "page_index"], "left_anti")
    top = top.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "book_id", "page_index")
    met = top.join(told, "book_id").withColumn("scores", fuzzy.partial_ratios_from(0.0)(F.transform("entries", lambda e: e["title"]), "head"))
    marked = F.transform("entries", lambda e, i: F.struct(F.get("scores", i).alias("score"), locate.author_confirmed(e["authors"], F.col("head")).alias("named")))
    rows = stored(met.select("book_id", "page_index", marked.alias("marks")))
    books = rows.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "marks"))).alias("pages")).join(told.select("book_id", F.transform("entries", lambda e: e["entry_no"]).alias("numbers")), "book_id")
    begin = F.struct(F.array().cast("array<struct<page_index:int,score:double>>").alias("found"), F.lit(0).alias("from"))

    def step(s: Column, k: Column) -> Column:
        open_pages = F.filter("pages", lambda p: p["page_index"] >= s["from"])
        options = F.transform(open_pages, lambda p: F.struct(F.get(p["marks"], k)["score"].alias("score"), (-p["page_index"]).alias("less"), F.get(p["marks"], k)["named"].alias("named")))
        sure = F.array_max(F.filter(options, lambda o: o["named"] & (o["score"] >= CONFIRMED)))
        best = F.coalesce(sure, F.array_max(F.filter(options, lambda o: o["score"] > 0)))
        page = (-best["less"]).cast("int")
        return F.struct(F.concat(s["found"], F.array(F.struct(page.alias("page_index"), F.coalesce(best["score"], F.lit(0.0)).alias("score")))).alias("found"), F.coalesce(page + 1, s["from"]).cast("int").alias("from"))

    folded = books.select("book_id", "numbers", F.aggregate(F.sequence(F.lit(0), F.size("numbers") - 1), begin, step)["found"].alias("found"))
    out = folded.select("book_id", F.explode(F.arrays_zip("numbers", "found")).alias("x"))
    return out.select("book_id", F.col("x.numbers").alias("entry_no"), F.col("x.found.page_index").alias("page_index"), F.col("x.found.score").alias("score"))


def confirm_near(chapters: DataFrame, pages: DataFrame, excluded: DataFrame, window: int = WINDOW) -> DataFrame:
    """(book_id, chapter_no, page_index, score): the best page within ``window`` of ``center`` for each (book_id, chapter_no, title, authors, center).

    A head that names an author counts 5 more, 100 at most; the first page on ties; none if nothing is alike.  A
    chapter is copied to the pages around its center and joins them by book and page, so no other pairs are made.
    """
    around = chapters.select("book_id", "chapter_no", F.lower("title").alias("title"), "authors", F.explode(F.sequence(F.greatest(F.col("center") - window, F.lit(0)), F.col("center") + window)).alias("page_index"))
    around = around.join(excluded.select("book_id", "page_index").distinct(), ["book_id", "page_index"], "left_anti")
    met = around.join(heads(pages), ["book_id", "page_index"])
    scored = met.withColumn("score", fuzzy.partial_ratio("title", "head"))
    scored = scored.withColumn("score", F.when(locate.author_confirmed(F.col("authors"), F.col("head")), F.least(F.lit(100.0), F.col("score") + AUTHOR_BONUS)).otherwise(F.col("score")))
    best = scored.filter("score > 0").groupBy("book_id", "chapter_no").agg(F.max(F.struct("score", (-F.col("page_index")).alias("less"))).alias("best"))
    return best.select("book_id", "chapter_no", (-F.col("best.less")).cast("int").alias("page_index"), F.col("best.score").alias("score"))


def outline_disagreements(outline: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(book_id, chapter_no, outline_page, page_index) where a chapter's best outline title, of 85 or more, stands on another page."""
    met = confirmed.select("book_id", "chapter_no", F.col("pdf_start_index").alias("page_index"), F.lower("title").alias("a")).join(outline.select("book_id", "cand_no", F.lower("title").alias("b"), F.col("pdf_page_index").alias("outline_page")), "book_id")
    scored = met.withColumn("score", fuzzy.partial_ratio("a", "b"))
    best = scored.filter("score > 0").groupBy("book_id", "chapter_no", "page_index").agg(F.max(F.struct("score", (-F.col("cand_no")).alias("less"), "outline_page")).alias("best"))
    return best.filter((F.col("best.score") >= MATCH) & ~F.col("best.outline_page").eqNullSafe(F.col("page_index"))).select("book_id", "chapter_no", F.col("best.outline_page").alias("outline_page"), "page_index")


def centers(chapters: DataFrame, offsets: DataFrame, n_pages: DataFrame) -> DataFrame:
    """``chapters`` with ``center``, the page that their printed start stands for by the votes of their kind of numbers; only those inside the book."""
    start = T.strip(F.split_part(F.col("citation_pages"), F.lit("-"), F.lit(1)))
    rows = chapters.withColumn("first", F.when(start != "", start)).withColumn("is_roman", ~F.col("first").rlike(r"^\d+$")).withColumn("value", N.page_value(F.col("first")))
    rows = rows.join(offsets.select("book_id", "is_roman", "offset"), ["book_id", "is_roman"]).join(n_pages, "book_id")
    return rows.withColumn("center", (F.col("offset") + F.col("value")).cast("int")).filter((F.col("center") >= 0) & (F.col("center") < F.col("n_pages"))).drop("first", "value", "offset", "n_pages")


def trimmed_ends(confirmed: DataFrame, pages: DataFrame, n_pages: DataFrame) -> DataFrame:
    """``confirmed`` with pdf_end_index: the page before the next chapter, moved back over almost blank pages, never before the start."""
    w = Window.partitionBy("book_id").orderBy("pdf_start_index")
    rows = confirmed.join(n_pages, "book_id").withColumn("end", F.coalesce(F.lead("pdf_start_index").over(w), F.col("n_pages")).cast("int") - 1).drop("n_pages")
    full = pages.select("book_id", F.col("page_index").alias("end"), F.when(F.length(T.strip(F.col("text"))) >= BLANK_CHARS, F.col("page_index")).alias("full"))
    carried = full.select("book_id", "end", F.last("full", True).over(Window.partitionBy("book_id").orderBy("end").rowsBetween(Window.unboundedPreceding, 0)).alias("last"))
    return rows.join(carried, ["book_id", "end"], "left").withColumn("pdf_end_index", F.greatest("pdf_start_index", F.coalesce("last", "pdf_start_index"))).drop("end", "last")


OUTCOMES = ("no chapters", "too few authors", "one author on most chapters", "no page offset", "too few confirmed", "bounds errors", "no layout", "not novel", "ok")


def reconcile(books: DataFrame, chapters: DataFrame, pages: DataFrame, vectors: DataFrame, reference: DataFrame, threshold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row for each book with its outcome and what each gate saw, the chapters of books that pass).

    ``chapters`` are record rows (book_id, chapter_no, title, authors, citation_pages); ``vectors`` (book_id, page_index,
    v) the layout of pages whose features could be read, ``reference`` those of accepted books and ``threshold`` what
    counts as far from them.  Gates come in order, and each works only on books that passed all before it; of chapters
    confirmed on one page the last stays.
    """
    n_pages = stored(pages.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_pages")))
    counts = chapters.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_chapters"))
    named = chapters.select("book_id", F.col("chapter_no").alias("chapter"), F.explode("authors").alias("author")).filter(T.strip(F.col("author")) != "")
    per_author = named.groupBy("book_id", "author").agg(F.count(F.lit(1)).alias("n")).groupBy("book_id").agg(F.count(F.lit(1)).alias("n_authors"), F.max("n").alias("top"))
    gates = books.select("book_id").distinct().join(counts, "book_id", "left").join(per_author, "book_id", "left")
    gates = stored(gates.select("book_id", F.coalesce("n_chapters", F.lit(0)).alias("n_chapters"), F.coalesce("n_authors", F.lit(0)).alias("n_authors"), (F.coalesce("top", F.lit(0)) / F.col("n_chapters")).alias("top_share")))
    alive = gates.filter("n_chapters > 0 and n_authors >= 3 and top_share <= 0.5").select("book_id")
    some = stored(pages.join(alive, "book_id", "left_semi"))
    listings = stored(listing_pages(some))
    offsets = stored(curate.offset_consensus(loose_numbers(some)))
    paged = chapters.join(offsets.select("book_id").distinct(), "book_id", "left_semi")
    start = T.strip(F.split_part(F.col("citation_pages"), F.lit("-"), F.lit(1)))
    with_page = paged.filter(start != "").groupBy("book_id").agg(F.count(F.lit(1)).alias("with_page"))
    near = confirm_near(centers(paged, offsets, n_pages), some, listings).filter(F.col("score") >= MATCH)
    candidates = stored(near.join(paged, ["book_id", "chapter_no"]).withColumnRenamed("page_index", "pdf_start_index"))
    confirmed = candidates.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_confirmed"))
    told = stored(with_page.join(confirmed, "book_id", "left").withColumn("n_confirmed", F.coalesce("n_confirmed", F.lit(0))))
    passed = told.filter("n_confirmed >= 3 and n_confirmed >= 0.8 * with_page").select("book_id")
    w = Window.partitionBy("book_id", "pdf_start_index").orderBy(F.desc("chapter_no"))
    single = candidates.join(passed, "book_id", "left_semi").withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")
    ranges = stored(trimmed_ends(single, some, n_pages))
    errors = stored(evaluate.bounds_errors(ranges, n_pages).groupBy("book_id").agg(F.count(F.lit(1)).alias("n_errors")))
    sound = ranges.join(errors, "book_id", "left_anti")
    opening = sound.select("book_id", F.col("pdf_start_index").alias("page_index")).join(vectors, ["book_id", "page_index"], "left")
    opening = opening.withColumn("id", F.concat_ws(":", F.col("book_id").cast("string"), F.col("page_index").cast("string")))
    novel = stored(curate.is_novel(opening, reference.withColumn("id", F.col("id").cast("string")), threshold))
    contents = curate.toc_range(listings)
    rows = gates.join(offsets.select("book_id").distinct().withColumn("has_offset", F.lit(True)), "book_id", "left").join(told, "book_id", "left").join(errors, "book_id", "left").join(novel, "book_id", "left")
    rows = rows.join(contents.select("book_id", "start", "end", "status"), "book_id", "left")
    outcome = (
        F.when(F.col("n_chapters") == 0, OUTCOMES[0]).when(F.col("n_authors") < 3, OUTCOMES[1]).when(F.col("top_share") > 0.5, OUTCOMES[2]).when(F.col("has_offset").isNull(), OUTCOMES[3])
        .when(F.coalesce((F.col("n_confirmed") < 3) | (F.col("n_confirmed") < 0.8 * F.col("with_page")), F.lit(True)), OUTCOMES[4]).when(F.col("n_errors") > 0, OUTCOMES[5])
        .when(F.col("is_novel").isNull(), OUTCOMES[6]).when(~F.col("is_novel"), OUTCOMES[7]).otherwise(OUTCOMES[8])
    )
    rows = stored(rows.withColumn("outcome", outcome))
    good = F.col("outcome") == "ok"
    told = rows.select(
        "book_id", "outcome", "n_chapters", "n_authors", "top_share", F.coalesce("with_page", F.lit(0)).alias("with_page"), F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"),
        F.when(good, F.coalesce("status", F.lit("no contents"))).alias("toc_status"), F.when(good, F.col("start")).alias("toc_start_index"), F.when(good, F.col("end")).alias("toc_end_index"),
    )
    kept = sound.join(rows.filter(good).select("book_id"), "book_id", "left_semi").select("book_id", "chapter_no", "title", "authors", "citation_pages", "pdf_start_index", "pdf_end_index")
    return told, kept
