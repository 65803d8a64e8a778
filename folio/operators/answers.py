"""Stored answers of models: contents entries read from them, choices between candidate pages, and segmentation with both.

A model is asked elsewhere; its answers are rows of text.  What an answer holds is read as VARIANT, so each element of a
list is judged by its own type: one that is no object, or has a title of fewer than three characters, is left out, and
authors that are no list count as none.  An answer that cannot be parsed gives no entries and no choice.

Whole methods route books, not rows: books that the contents heuristic cannot segment, and only those, take the entries
of their answer, and the two halves are located apart and put together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import pagenum as N
from folio.functions import text as T
from folio.operators import boundaries, locate, segment, toc
from folio.operators.tables import apart, stored

MIN_TITLE = 3
#: Number literals that other JSON writers put out and the parser here does not take; they count as null.
NO_NUMBER = r"([:\[,]\s*)(?:NaN|-?Infinity)(?=\s*[,}\]])"


def parsed(answer: Column, kind: str = "array") -> Column:
    """The outermost array or object of an answer as VARIANT; null if there is none or it is broken."""
    return F.try_parse_json(F.regexp_replace(T.extract_json(answer, kind), NO_NUMBER, "$1null"))


def _kind(item: Column, path: str) -> Column:
    """The type of what stands at ``path``: STRING, BIGINT, DECIMAL(..), ARRAY<..>, VOID; null where nothing stands there."""
    return F.schema_of_variant(F.try_variant_get(item, path, "variant"))


def printed_of(item: Column) -> Column:
    """The printed page number of an answer's item in canonical form, by the type that it was given in."""
    path = "$.printed_page_number"
    kind = _kind(item, path)
    number = F.try_variant_get(item, path, "double")
    return F.when(kind == "STRING", N.normalize_printed(F.try_variant_get(item, path, "string"))).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), N.normalize_printed(number, "double"))


def authors_of(item: Column) -> Column:
    """The names of an answer's item; none unless they are a list."""
    listed = F.try_variant_get(item, "$.authors", "array<variant>")
    names = F.transform(listed, lambda a: T.strip(F.try_variant_get(a, "$", "string")))
    named = F.filter(names, lambda x: F.coalesce(x, F.lit("")) != "")
    return F.coalesce(F.when(_kind(item, "$.authors").startswith("ARRAY"), named), F.array().cast("array<string>"))


def response_entries(responses: DataFrame) -> DataFrame:
    """Contents entries of stored answers (book_id, response), in the order in which they stand there.

    (book_id, entry_no, title, title_variants, printed, value, is_roman, authors, source_page_index, skip, source);
    no page of the book is their source, which is written as -1.
    """
    items = responses.select("book_id", F.posexplode(F.try_variant_get(parsed(F.col("response")), "$", "array<variant>")).alias("at", "item"))
    items = items.filter(F.schema_of_variant("item").startswith("OBJECT"))
    title = F.coalesce(F.try_variant_get("item", "$.title", "string"), F.lit(""))
    # a title of 0 or false counts as none, as an empty one does
    kind = _kind(F.col("item"), "$.title")
    title = F.when(kind.rlike("^(BOOLEAN|VOID)") | (~(kind == "STRING") & (title == "0")), "").otherwise(T.strip(title))
    rows = items.select(
        "book_id", "at", title.alias("title"), authors_of(F.col("item")).alias("authors"), printed_of(F.col("item")).alias("printed"),
        F.coalesce(F.try_variant_get("item", "$.skip", "boolean"), F.lit(False)).alias("skip"),
    ).filter(F.length("title") >= MIN_TITLE)
    value = N.page_value(F.col("printed"))
    w = Window.partitionBy("book_id").orderBy("at")
    return rows.select(
        "book_id", (F.row_number().over(w) - 1).alias("entry_no"), "title", F.array().cast("array<string>").alias("title_variants"), "printed", value.alias("value"),
        F.coalesce(F.col("printed").isNotNull() & ~F.col("printed").rlike(r"(?U)^\d+$") & value.isNotNull(), F.lit(False)).alias("is_roman"), "authors", F.lit(-1).alias("source_page_index"), "skip", F.lit("llm").alias("source"),
    )


def contested(entries: DataFrame, located: DataFrame, heads: DataFrame, excluded: DataFrame) -> DataFrame:
    """(book_id, entry_no, candidate_no, page_index, score, author_confirmed) of entries that stayed open between several pages.

    Candidates count from 1, the likeliest first, as they were shown to the model.
    """
    rest = entries.join(apart(located.select("book_id", "entry_no")), ["book_id", "entry_no"], "left_anti")
    titles = rest.select("book_id", "entry_no", "authors", F.lit(0).alias("variant_no"), F.col("title").alias("reading"))
    heads = heads.select("book_id", "page_index", "head").join(apart(excluded.select("book_id", "page_index").distinct()), ["book_id", "page_index"], "left_anti")
    heads = heads.join(apart(titles.select("book_id").distinct()), "book_id", "left_semi")
    scored = locate.score_title_pages(titles, heads).withColumnRenamed("reading", "low")
    met = apart(titles.withColumn("low", F.lower("reading"))).join(scored, ["book_id", "low"]).join(apart(heads), ["book_id", "page_index"])
    met = met.withColumn("author_confirmed", locate.author_confirmed(F.col("authors"), F.col("head"))).drop("head", "low", "authors")
    clusters = locate.cluster_candidates(met).withColumn("key", locate.ranking_key(F.col("score"), F.col("author_confirmed")))
    w = Window.partitionBy("book_id", "entry_no")
    ranked = clusters.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("candidate_no", F.row_number().over(w.orderBy(F.desc("key"), "page_index")))
    return ranked.filter("n > 1").select("book_id", "entry_no", "candidate_no", "page_index", "score", "author_confirmed")


def choose(candidates: DataFrame, choices: DataFrame) -> DataFrame:
    """The candidates that stored answers (book_id, entry_no, response) name by number, with the least margin that locates.

    An answer that names none, or a number that was not shown, chooses nothing.
    """
    number = F.try_variant_get("answer", "$.chosen_candidate", "int")
    kind = _kind(F.col("answer"), "$.chosen_candidate")
    told = choices.select("book_id", "entry_no", parsed(F.col("response"), "object").alias("answer")).filter(kind == "BIGINT").select("book_id", "entry_no", number.alias("candidate_no"))
    told = told.dropDuplicates(["book_id", "entry_no", "candidate_no"])
    return candidates.join(apart(told), ["book_id", "entry_no", "candidate_no"]).drop("candidate_no").withColumn("margin", F.lit(locate.MARGIN))


def _locate_or_choose(entries: DataFrame, excluded: DataFrame, choices: DataFrame, facts) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(located entries with their source, how many of each book were chosen, pages that hold no content)."""
    n_pages, bare, heads, _ = facts
    located, closed = locate.locate_entries(entries, n_pages, bare, heads, excluded)
    located = stored(located)
    chosen = stored(choose(contested(entries, located, heads, excluded), choices))
    own = entries.drop("title_variants", "source").join(apart(chosen), ["book_id", "entry_no"]).withColumn("source", F.lit("llm"))
    columns = ["book_id", "entry_no", "title", "authors", "printed", "is_roman", "page_index", "score", "margin", "source"]
    return stored(located.select(*columns).unionByName(own.select(*columns))), chosen.groupBy("book_id").agg(F.count(F.lit(1)).alias("chosen")), closed


def _scanned(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """The pages in which a listing is looked for, of books that have entries."""
    return toc.scan_range(pages).select("book_id", "page_index").join(apart(entries.select("book_id").distinct()), "book_id", "left_semi")


def _summary(pages: DataFrame, entries: DataFrame, located: DataFrame, chosen: DataFrame, chapters: DataFrame, answered: DataFrame) -> DataFrame:
    """One row for each book: pages, confidence, entries found and located, and where answers were used."""
    n = lambda df, name: df.groupBy("book_id").agg(F.count(F.lit(1)).alias(name))
    rows = toc.page_counts(pages).withColumnRenamed("n_pages", "total_pdf_pages")
    for df in (n(entries, "toc_matches_found"), n(located, "toc_matches_located"), n(chapters, "chapters"), chosen, answered.withColumn("answered", F.lit(True))):
        rows = rows.join(apart(df), "book_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(
        "book_id", "total_pdf_pages", F.when(zero("chapters") > 0, "high").otherwise("low").alias("segmentation_confidence"), zero("chapters").alias("chapters"), zero("toc_matches_found").alias("toc_matches_found"),
        zero("toc_matches_located").alias("toc_matches_located"), F.coalesce("answered", F.lit(False)).alias("llm_toc_extraction_used"), zero("chosen").alias("llm_disambiguation_used"),
    )


def segment_answers(pages: DataFrame, responses: DataFrame, choices: DataFrame, facts=None) -> tuple[DataFrame, DataFrame]:
    """(chapters, summary) from stored answers alone; books without a usable one have no chapters."""
    facts = facts or segment.page_facts(pages)
    n_pages, _, heads, numbers = facts
    entries = stored(response_entries(responses).join(apart(n_pages.select("book_id")), "book_id", "left_semi"))
    located, chosen, closed = _locate_or_choose(entries, _scanned(pages, entries), choices, facts)
    found = stored(boundaries.chapters(numbers, n_pages, located, heads, closed))
    return found, _summary(pages, entries, located, chosen, found, entries.select("book_id").distinct())


def segment_with_fallback(pages: DataFrame, responses: DataFrame, choices: DataFrame, facts=None) -> tuple[DataFrame, DataFrame]:
    """(chapters, summary) from printed contents, and from stored answers where those fail.

    Books without an entry or without a chapter take their answer's entries, if it has any; in all books, entries that
    stay open between several pages take the page that a stored choice names.
    """
    facts = facts or segment.page_facts(pages)
    n_pages, bare, heads, numbers = facts
    own = stored(toc.toc_entries(pages).withColumn("source", F.lit("heuristic")))
    listed = own.select("book_id", F.col("source_page_index").alias("page_index")).distinct()
    columns = ["book_id", "entry_no", "title", "title_variants", "printed", "is_roman", "authors", "source_page_index", "source"]
    located, chosen, closed = _locate_or_choose(own.select(*columns), listed, choices, facts)
    plain = located.filter("source = 'heuristic'")
    able = stored(boundaries.chapters(numbers, n_pages, plain, heads, closed).select("book_id").distinct())
    answered = stored(response_entries(responses).join(apart(n_pages.select("book_id")), "book_id", "left_semi").join(apart(able), "book_id", "left_anti"))
    routed = answered.select("book_id").distinct()
    some = tuple(x.join(apart(routed), "book_id", "left_semi") for x in (n_pages, bare, heads, numbers))
    told, told_chosen, told_closed = _locate_or_choose(answered.select(*columns), _scanned(pages, answered), choices, some)
    keep = lambda df: df.join(apart(routed), "book_id", "left_anti")
    located = keep(located).unionByName(told)
    chosen = keep(chosen).unionByName(told_chosen)
    closed = keep(closed).unionByName(told_closed)
    entries = keep(own.select(*columns)).unionByName(answered.select(*columns))
    found = stored(boundaries.chapters(numbers, n_pages, located, heads, closed))
    return found, _summary(pages, entries, located, chosen, found, routed)
