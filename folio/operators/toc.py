"""Contents pages: parsing contents lines, their wrapped titles, and choosing a book's one listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import pagenum as N
from folio.functions import text as T
from folio.operators.tables import apart, stored

MIN_LINES = 3
MIN_LINES_AFTER = 2
CLUSTER_GAP = 2
LONGEST_LINE = 120
AUTHOR_LINE = r"^(?:par|by|et)\s+([A-ZÀ-Þ].+)$"
MIN_AUTHOR_LINES = 3
BARE_LEADER = r"^[.\s…·]*\d{1,4}$"


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_pages"))


def explode_lines(pages: DataFrame) -> DataFrame:
    """(book_id, page_index, line_no, line): stripped lines of all pages."""
    return pages.select("book_id", "page_index", F.posexplode(F.transform(T.lines(F.col("text")), T.strip)).alias("line_no", "line"))


def top_lines(pages: DataFrame, most: int) -> DataFrame:
    """(book_id, page_index, line_no, line): stripped lines at the top of all pages; the rest of a page is never cut up."""
    first = F.slice(F.split("text", r"\R", most + 1), 1, most)
    return pages.filter("text <> ''").select("book_id", "page_index", F.posexplode(F.transform(first, T.strip)).alias("line_no", "line"))


def in_scan_range(front: float = 0.15, back: float = 0.05):
    """Whether a page stands in the front or back share of its book's ``n_pages``; at least one page each."""
    first = F.greatest(F.lit(1), F.floor(F.col("n_pages") * front))
    last = F.greatest(F.lit(1), F.floor(F.col("n_pages") * back))
    return (F.col("page_index") < first) | (F.col("page_index") >= F.col("n_pages") - last)


def scan_range(pages: DataFrame, front: float = 0.15, back: float = 0.05) -> DataFrame:
    """Pages at the front and the back in which a listing is looked for."""
    return pages.join(apart(page_counts(pages)), "book_id").filter(in_scan_range(front, back)).drop("n_pages")


def _ends_title(line):
    """Lines that no wrapped title reaches over: none, blank, contents lines, addresses, imprints, long ones."""
    return line.isNull() | (line == "") | line.rlike(N.TOC_LINE) | T.is_url_line(line) | T.is_imprint_line(line) | (F.length(line) > LONGEST_LINE)


def _may_end_in_number(line):
    """Whether the last characters of a line may be a page number after a blank or a dot; true of all contents lines."""
    end = F.regexp_replace(F.substring(line, -40, 40), r"(?U)\s+$", "")
    return F.substring(end, -7, 7).rlike(r"(?U)(?:^|[.\s])(?:\d{1,4}|[ivxlcdm]{1,6}|[IVXLCDM]{1,6})$") | (end == "")


def toc_lines(pages: DataFrame, n_pages: DataFrame | None = None) -> DataFrame:
    """(book_id, page_index, line_no, title, printed, value, is_roman, title_variants) of all valid contents lines.

    The end of each line is looked at inside the row of its page; only lines that may end in a page number leave the
    row, with the four lines before them, and everything else is worked out on those few.
    """
    rows = pages.select("book_id", "page_index", T.lines(F.col("text")).alias("lines"))
    rows = rows.select("book_id", "page_index", F.explode(F.filter(F.transform("lines", lambda x, i: F.when(_may_end_in_number(x), F.struct(
        i.alias("line_no"), x.alias("own"), *(F.when(i >= k, F.get("lines", i - k)).alias(f"b{k}") for k in range(1, 5))
    ))), lambda r: r.isNotNull())).alias("r")).select("book_id", "page_index", "r.*")
    rows = rows.withColumns({c: T.strip(F.col(c)) for c in ("own", "b1", "b2", "b3", "b4")}).filter(F.col("own").rlike(N.TOC_LINE))
    rows = rows.filter(~T.is_url_line(F.col("own")) & ~T.is_imprint_line(F.col("own")))
    rows = rows.withColumn("read", T.strip_title(F.regexp_extract("own", N.TOC_LINE, 1))).withColumn("printed", F.regexp_extract("own", N.TOC_LINE, 2))
    rows = rows.withColumn("value", N.page_value(F.col("printed"))).filter("value is not null")
    rows = rows.join(apart(page_counts(pages) if n_pages is None else n_pages), "book_id").filter(F.col("value") <= N.RATIO_MOST * F.col("n_pages"))
    # a leader without title takes the line before it, and what is merged starts one line higher
    rows = rows.withColumn("bare", F.length("read") < 3).withColumn("above", T.strip_title(F.col("b1")))
    adopts = F.col("own").rlike(BARE_LEADER) & ~_ends_title(F.col("b1")) & (F.length("above") >= 3)
    rows = rows.filter(~F.col("bare") | F.coalesce(adopts, F.lit(False))).withColumn("title", F.when(F.col("bare"), F.col("above")).otherwise(F.col("read")))
    going, said, variants = F.lit(True), F.col("title"), []
    for k in (1, 2, 3):
        line = F.when(F.col("bare"), F.col(f"b{k + 1}")).otherwise(F.col(f"b{k}"))
        header = T.is_part_divider(line) | T.plain_title(line).isin(*T.BACK_MATTER)
        rows = rows.withColumn(f"p{k}", line).withColumn(f"ok{k}", ~_ends_title(line) & ~F.coalesce(header, F.lit(False)))
        going = going & F.col(f"ok{k}")
        said = F.concat_ws(" ", f"p{k}", said)
        variants.append(F.when(going, T.strip_title(said)))
    return rows.select("book_id", "page_index", "line_no", "title", "printed", "value", (~F.col("printed").rlike(r"^\d+$")).alias("is_roman"), F.array_compact(F.array(*variants)).alias("title_variants"))


def listing_pages(entries: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(book_id, page_index, n) of pages with enough valid contents lines."""
    return entries.groupBy("book_id", "page_index").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_lines)


def first_cluster(listings: DataFrame, gap: int = CLUSTER_GAP) -> DataFrame:
    """Pages of each book's first run of listing pages with steps of at most ``gap``."""
    w = Window.partitionBy("book_id").orderBy("page_index")
    island = F.sum(F.coalesce((F.col("page_index") - F.lag("page_index").over(w) > gap).cast("int"), F.lit(0))).over(w)
    return listings.withColumn("island", island).filter("island = 0").select("book_id", "page_index")


def extend_cluster(cluster: DataFrame, entries: DataFrame, listings: DataFrame, gap: int = CLUSTER_GAP) -> DataFrame:
    """The cluster and the pages after it that go on with two lines or more, steps of at most ``gap``.

    Pages that are listings of their own are no part of such a chain and do not bridge it.
    """
    last = cluster.groupBy("book_id").agg(F.max("page_index").alias("last"))
    more = listing_pages(entries, MIN_LINES_AFTER).join(apart(listings.select("book_id", "page_index")), ["book_id", "page_index"], "left_anti")
    after = more.join(apart(last), "book_id").filter("page_index > last")
    w = Window.partitionBy("book_id").orderBy("page_index")
    step = F.col("page_index") - F.coalesce(F.lag("page_index").over(w), F.col("last"))
    chain = after.withColumn("broken", F.max((step > gap).cast("int")).over(w)).filter("broken = 0")
    return cluster.unionByName(chain.select("book_id", "page_index"))


def apply_author_marker(entries: DataFrame, min_lines: int = MIN_AUTHOR_LINES) -> DataFrame:
    """Where several entries are author lines ("by Name"), only those stay, with the names read off them."""
    marked = F.filter(F.concat(F.array("title"), F.col("title_variants")), lambda t: t.rlike(AUTHOR_LINE))
    names = F.regexp_extract(F.get(marked, F.lit(0)), AUTHOR_LINE, 1)
    people = F.filter(F.transform(F.split(names, r"\s+et\s+|\s+and\s+|,|\bpar\b"), T.strip), lambda x: x != "")
    rows = entries.withColumn("names", F.when(F.size(marked) > 0, people))
    rows = rows.withColumn("marks", F.count("names").over(Window.partitionBy("book_id")))
    rows = rows.filter((F.col("marks") < min_lines) | F.col("names").isNotNull())
    authors = F.when(F.col("marks") >= min_lines, F.col("names")).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("authors", authors).drop("names", "marks")


def toc_entries(pages: DataFrame) -> DataFrame:
    """The contents entries of every book in listing order, numbered from 0 by ``entry_no``."""
    n_pages = page_counts(pages)
    lines = stored(toc_lines(pages, n_pages))
    scanned = lines.join(apart(n_pages), "book_id").filter(in_scan_range()).drop("n_pages")
    listings = listing_pages(scanned)
    chosen = extend_cluster(first_cluster(listings), lines, listings)
    entries = apply_author_marker(lines.join(apart(chosen), ["book_id", "page_index"], "left_semi"))
    w = Window.partitionBy("book_id").orderBy("page_index", "line_no")
    return entries.withColumn("entry_no", F.row_number().over(w) - 1).withColumnRenamed("page_index", "source_page_index")


def llm_scan_range(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """(book_id, page_index) to show a model: a page around each contents page, or the plain scan range without any."""
    around = entries.select("book_id", F.explode(F.sequence(F.col("source_page_index") - 1, F.col("source_page_index") + 1)).alias("page_index")).distinct()
    around = around.join(pages.select("book_id", "page_index"), ["book_id", "page_index"], "left_semi")
    rest = scan_range(pages).select("book_id", "page_index").join(entries.select("book_id").distinct(), "book_id", "left_anti")
    return around.unionByName(rest)


def prompt_table(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """(book_id, prompt): page texts under page marks, in order, for a model outside."""
    shown = pages.join(llm_scan_range(pages, entries), ["book_id", "page_index"], "left_semi")
    block = F.concat(F.lit("[PAGE "), F.col("page_index").cast("string"), F.lit("]\n"), F.col("text"))
    blocks = F.array_sort(F.collect_list(F.struct("page_index", block.alias("block"))))
    return shown.groupBy("book_id").agg(F.array_join(F.transform(blocks, lambda x: x["block"]), "\n\n").alias("prompt"))
