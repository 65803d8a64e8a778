"""Finding the page on which each contents entry's chapter opens."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import fuzzy
from folio.functions import text as T
from folio.operators.tables import apart, stored, worked_out

HEADER_LINES = 5
HEADER_CHARS = 8
HEADER_SHARE = 0.2
HEADER_PAGES = 5
HEAD = 200
BODY = 2000
SCORE = 80.0
LISTING_SCORE = 90.0
LISTING_TITLE = 15
LISTING_ENTRIES = 3
MIN_HEAD = 20
CLUSTER_GAP = 3
MARGIN = 8.0
AUTHOR_BONUS = 15.0


def running_headers(lines: DataFrame, n_pages: DataFrame) -> DataFrame:
    """(book_id, header_form) of lines that stand near the top of many pages."""
    top = lines.filter(F.col("line_no") < HEADER_LINES).select("book_id", "page_index", T.header_form(F.col("line")).alias("header_form"))
    on_pages = top.filter(F.length("header_form") >= HEADER_CHARS).distinct().groupBy("book_id", "header_form").agg(F.count(F.lit(1)).alias("n"))
    least = F.greatest(F.lit(HEADER_PAGES), F.floor(F.col("n_pages") * HEADER_SHARE))
    return on_pages.join(apart(n_pages), "book_id").filter(F.col("n") >= least).select("book_id", "header_form")


def page_headers(pages: DataFrame, n_pages: DataFrame) -> DataFrame:
    """``running_headers`` from pages: the forms of a page's top lines are told apart inside its row."""
    top = F.slice(F.split("text", r"\R", HEADER_LINES + 1), 1, HEADER_LINES)
    forms = worked_out(pages.filter("text <> ''").select("book_id", "text"), forms=F.transform(top, T.header_form)).drop("text")
    long = F.array_distinct(F.filter("forms", lambda x: F.length(x) >= HEADER_CHARS))
    on_pages = forms.select("book_id", F.explode(long).alias("header_form")).groupBy("book_id", "header_form").agg(F.count(F.lit(1)).alias("n"))
    least = F.greatest(F.lit(HEADER_PAGES), F.floor(F.col("n_pages") * HEADER_SHARE))
    # few forms stand on so many pages
    return on_pages.filter(F.col("n") >= HEADER_PAGES).join(apart(n_pages), "book_id").filter(F.col("n") >= least).select("book_id", "header_form")


def strip_headers(pages: DataFrame, headers: DataFrame) -> DataFrame:
    """``pages`` with leading header lines (and lines without letters next to them) dropped where a book has headers."""
    known = headers.groupBy("book_id").agg(F.collect_set("header_form").alias("headers"))
    # lines beyond those looked at stay in one piece
    rows = worked_out(pages.join(apart(known), "book_id", "left"), top=F.when(F.col("headers").isNotNull(), F.split("text", r"\R", HEADER_LINES + 1)))
    rows = worked_out(rows, forms=F.transform(F.slice("top", 1, HEADER_LINES), T.header_form))
    keeps = F.filter(F.transform("forms", lambda x, i: F.when((x == "") | F.array_contains("headers", x), F.lit(HEADER_LINES)).otherwise(i)), lambda i: i < HEADER_LINES)
    rows = worked_out(rows, skip=F.coalesce(F.get(keeps, F.lit(0)), F.lit(HEADER_LINES)))
    last = F.regexp_replace(F.get("top", F.lit(HEADER_LINES)), r"\R", "\n")
    left = F.array_join(F.concat(F.slice("top", F.col("skip") + 1, F.greatest(HEADER_LINES - F.col("skip"), F.lit(0))), F.array_compact(F.array(last))), "\n")
    rows = worked_out(rows, left=left)
    # no line follows a last line break
    left = F.when(F.endswith("left", F.lit("\n")), F.substring("left", F.lit(1), F.length("left") - 1)).otherwise(F.col("left"))
    return rows.withColumn("text", F.when(F.col("top").isNotNull(), left).otherwise(F.col("text"))).drop("top", "forms", "skip", "left", "headers")


def readings(entries: DataFrame) -> DataFrame:
    """A row for each reading of an entry's title: variant 0 is the title, the others are its wrapped forms."""
    return entries.select("book_id", "entry_no", "is_roman", "authors", F.posexplode(F.concat(F.array("title"), F.col("title_variants"))).alias("variant_no", "reading"))


def author_confirmed(authors, head):
    """Whether a last name of the authors stands in a page's head."""
    names = F.filter(F.transform(authors, lambda a: F.lower(F.element_at(F.split(T.strip(a), r"\s+"), -1))), lambda n: n != "")
    return F.coalesce(F.exists(names, lambda n: F.contains(F.lower(head), n)), F.lit(False))


def score_title_pages(titles: DataFrame, heads: DataFrame, threshold: float = SCORE) -> DataFrame:
    """(book_id, page_index, reading, score) of pages whose head resembles a reading; only pages of the same book meet.

    A page is one row with all readings of its book, so its text goes to the scorer once; a reading that stands in the
    head as it is scores 100.
    """
    t = titles.select("book_id", F.lower("reading").alias("reading")).groupBy("book_id").agg(F.array_sort(F.collect_set("reading")).alias("readings"))
    h = heads.filter(F.length(T.strip(F.col("head"))) >= MIN_HEAD).select("book_id", "page_index", F.lower("head").alias("head"))
    # a stated number of partitions: the tables are small beside the scorer's work, and adaptive plans would join them in few tasks
    h = h.repartition(int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions")), "book_id")
    scored = h.join(apart(t), "book_id").withColumn("scores", fuzzy.partial_ratios_from(threshold)("readings", "head"))
    pairs = scored.select("book_id", "page_index", F.explode(F.arrays_zip("readings", "scores")).alias("p"))
    return pairs.select("book_id", "page_index", F.col("p.readings").alias("reading"), F.col("p.scores").alias("score")).filter(F.col("score") >= threshold)


def secondary_listings(entries: DataFrame, bodies: DataFrame) -> DataFrame:
    """(book_id, page_index) of pages outside the contents that name several entries; never a chapter's opening."""
    longest = F.array_max(F.transform(F.concat(F.array("title"), F.col("title_variants")), lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("i"), t.alias("t"))))
    titles = entries.select("book_id", "entry_no", longest["t"].alias("reading")).filter(F.length("reading") >= LISTING_TITLE)
    found = score_title_pages(titles, bodies.withColumnRenamed("body", "head"), LISTING_SCORE)
    counted = apart(titles.withColumn("low", F.lower("reading")).drop("reading")).join(found.withColumnRenamed("reading", "low"), ["book_id", "low"])
    return counted.groupBy("book_id", "page_index").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LISTING_ENTRIES).select("book_id", "page_index")


def last_front_page(entries: DataFrame, n_pages: DataFrame) -> DataFrame:
    """(book_id, front): the last contents page in a book's first half."""
    front = entries.join(apart(n_pages), "book_id").filter((F.col("source_page_index") >= 0) & (F.col("source_page_index") < F.floor(F.col("n_pages") / 2)))
    return front.groupBy("book_id").agg(F.max("source_page_index").alias("front"))


def allowed_pages(candidates: DataFrame, excluded: DataFrame, front: DataFrame) -> DataFrame:
    """Candidates on pages where their entry may open: none of the excluded ones, and for entries that are not in
    roman pages none up to the front contents."""
    kept = candidates.join(apart(excluded.select("book_id", "page_index").distinct()), ["book_id", "page_index"], "left_anti")
    kept = kept.join(apart(front), "book_id", "left")
    return kept.filter(F.col("is_roman") | F.col("front").isNull() | (F.col("page_index") > F.col("front"))).drop("front")


def cluster_candidates(candidates: DataFrame, gap: int = CLUSTER_GAP) -> DataFrame:
    """Clusters of candidate pages, chained by steps of at most ``gap``: first page, best score, any author seen."""
    keys = ["book_id", "entry_no", "variant_no", "reading"]
    w = Window.partitionBy(*keys).orderBy("page_index")
    island = F.sum(F.coalesce((F.col("page_index") - F.lag("page_index").over(w) > gap).cast("int"), F.lit(0))).over(w)
    return candidates.withColumn("island", island).groupBy(*keys, "island").agg(
        F.min("page_index").alias("page_index"), F.max("score").alias("score"), F.bool_or("author_confirmed").alias("author_confirmed")
    ).drop("island")


def ranking_key(score, confirmed):
    return score + F.when(confirmed, AUTHOR_BONUS).otherwise(0.0)


def best_cluster(clusters: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Each reading's best cluster with its margin over the next; none where two are too close."""
    ranked = clusters.withColumn("key", ranking_key(F.col("score"), F.col("author_confirmed")))
    w = Window.partitionBy("book_id", "entry_no", "variant_no").orderBy(F.desc("key"), "page_index")
    ranked = ranked.withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("key").over(w))
    ranked = ranked.filter("rank = 1").withColumn("margin", F.col("key") - F.coalesce("next", F.lit(0.0)))
    return ranked.filter(F.col("next").isNull() | (F.col("margin") >= margin)).drop("rank", "next")


def best_variant(matches: DataFrame) -> DataFrame:
    """The reading of each entry that is located most surely: by min(key, margin), key, length, then the first."""
    order = [F.desc(F.least("key", "margin")), F.desc("key"), F.desc(F.length("reading")), F.asc("variant_no")]
    w = Window.partitionBy("book_id", "entry_no").orderBy(*order)
    return matches.withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")


def order_disambiguate(entries: DataFrame, located: DataFrame, clusters: DataFrame, n_pages: DataFrame) -> DataFrame:
    """Locates entries that stayed open between their located neighbours in contents order.

    (book_id, entry_no, reading, page_index, score, margin, author_confirmed) of what this pass adds.  An entry's
    lower bound counts what this pass found before it, so each book is gone through in order; a book has some
    tens of entries, and only books with an open entry that has candidates come here.
    """
    options = clusters.withColumn("key", ranking_key(F.col("score"), F.col("author_confirmed")))
    options = options.join(apart(located.select("book_id", "entry_no")), ["book_id", "entry_no"], "left_anti").withColumn("pinned", F.lit(False))
    fixed = located.select("book_id", "entry_no", "variant_no", "reading", "page_index", "score", "author_confirmed", "key").withColumn("pinned", F.lit(True))
    rows = options.select(*fixed.columns).unionByName(fixed.join(apart(options.select("book_id").distinct()), "book_id", "left_semi"))
    # a stated number of partitions: the rows are few beside the work on a book
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "book_id").join(apart(n_pages), "book_id")
    schema = "book_id long, entry_no int, reading string, page_index int, score double, margin double, author_confirmed boolean"

    def walk(book: pd.DataFrame) -> pd.DataFrame:
        pinned = book[book.pinned].sort_values("entry_no")
        first_after = {}
        for e in sorted(set(book.entry_no)):
            later = pinned[pinned.entry_no > e].page_index
            first_after[e] = int(later.min()) if len(later) else int(book.n_pages.iloc[0])
        lower, out = -1, []
        fixed_at = dict(zip(pinned.entry_no, pinned.page_index, strict=True))
        for e, own in book.sort_values(["entry_no", "variant_no"]).groupby("entry_no", sort=True):
            if e in fixed_at:
                lower = max(lower, int(fixed_at[e]))
                continue
            best = None
            for _, some in own.groupby("variant_no", sort=True):
                fits = some[(some.page_index > lower) & (some.page_index < first_after[e])]
                if len(fits) < 2 and len(fits) == len(some):
                    continue
                for r in fits.itertuples():
                    mark = (r.key, -r.page_index, len(r.reading))
                    if best is None or mark > best[0]:
                        best = (mark, r)
            if best is not None:
                r = best[1]
                out.append((r.book_id, r.entry_no, r.reading, r.page_index, r.score, MARGIN, r.author_confirmed))
                lower = max(lower, int(r.page_index))
        return pd.DataFrame(out, columns=["book_id", "entry_no", "reading", "page_index", "score", "margin", "author_confirmed"])

    return rows.groupBy("book_id").applyInPandas(walk, schema)


def page_heads(bare: DataFrame, blank_chars: int) -> DataFrame:
    """(book_id, page_index, head, full) of pages without running headers; full pages are not blank."""
    return bare.select("book_id", "page_index", F.substring("text", 1, HEAD).alias("head"), _holds(F.col("text"), blank_chars).alias("full"))


def _holds(text, least: int):
    """Whether a text has ``least`` characters, 2 or more, from its first to its last one that is no blank."""
    return text.rlike(rf"(?Us)\S.{{{least - 2},}}\S")


def page_tops(pages: DataFrame, headers: DataFrame, blank_chars: int) -> tuple[DataFrame, DataFrame]:
    """(book_id, page_index, text) of pages without running headers as far as they are read, and their ``page_heads``; written once."""
    bare = worked_out(strip_headers(pages.select("book_id", "page_index", "text"), headers).withColumnRenamed("text", "whole"), text=F.col("whole")).drop("whole")
    tops = stored(bare.select("book_id", "page_index", F.substring("text", 1, BODY).alias("text"), F.substring("text", 1, HEAD).alias("head"), _holds(F.col("text"), blank_chars).alias("full")))
    return tops.select("book_id", "page_index", "text"), tops.select("book_id", "page_index", "head", "full")


def locate_entries(entries: DataFrame, n_pages: DataFrame, bare: DataFrame, heads: DataFrame, excluded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(located entries with page_index, score and margin; all pages that hold no content).

    ``entries`` need book_id, entry_no, title, title_variants, printed, is_roman, authors and source_page_index.
    """
    bodies = bare.select("book_id", "page_index", F.substring("text", 1, BODY).alias("body")).join(apart(excluded.select("book_id", "page_index")), ["book_id", "page_index"], "left_anti")
    closed = stored(excluded.select("book_id", "page_index").unionByName(secondary_listings(entries, bodies)).distinct())
    titles = readings(entries)
    heads = heads.select("book_id", "page_index", "head")
    scored = score_title_pages(titles, heads).withColumnRenamed("reading", "low")
    met = apart(titles.withColumn("low", F.lower("reading"))).join(scored, ["book_id", "low"]).join(apart(heads), ["book_id", "page_index"])
    candidates = met.withColumn("author_confirmed", author_confirmed(F.col("authors"), F.col("head"))).drop("head", "low", "authors")
    candidates = allowed_pages(candidates, closed, last_front_page(entries, n_pages))
    clusters = stored(cluster_candidates(candidates))
    first = stored(best_variant(best_cluster(clusters)))
    more = order_disambiguate(entries, first, clusters, n_pages)
    found = first.select("book_id", "entry_no", "reading", "page_index", "score", "margin", "author_confirmed").unionByName(more)
    own = entries.drop("title", "title_variants")
    return own.join(apart(found.withColumnRenamed("reading", "title")), ["book_id", "entry_no"]), closed
