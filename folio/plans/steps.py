"""Queries of single steps that whole segmentation, evidence and curation are made of, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import pagenum as N
from folio.functions import text as T
from folio.operators import boundaries, curate, evaluate, evidence, layout, locate, redact, runs
from folio.operators.tables import dealt
from folio.plans.queries import CITED, EXPECTED, citation_accuracy, expected, page_labels, query, table

BOOK_PAGES = "book_pages as (select doc_id, doc_id // 25 as book_id, cast(doc_id % 25 as integer) as page_index, text from documents)"


def book_pages(spark, sf_dir) -> DataFrame:
    """Every document as a page of a book of 25."""
    return table(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 25").alias("book_id"), F.expr("cast(doc_id % 25 as int)").alias("page_index"), "text")


@query("""with b as (select p_partkey as book_id, concat('978', lpad(cast(p_partkey as varchar), 10, '0')) as isbn, 1990 + p_size as year, concat('press ', cast(p_size % 5 as varchar)) as publisher, [p_partkey % 7, 100 + p_size % 11] as editors from part),
s as (select l_partkey as book_id, l_orderkey * 10 + l_linenumber as cand_no, l_suppkey, l_linenumber, case when l_linenumber = 1 then concat('978', lpad(cast(l_partkey as varchar), 10, '0')) end as isbn, 1990 + cast(l_quantity as integer) as year, concat('press ', cast(cast(l_quantity as integer) % 5 as varchar)) as publisher, [l_suppkey % 7] as editors from lineitem),
c as (select book_id, concat('Chapter ', cast(l_suppkey as varchar)) as title, cast(l_linenumber * 10 as integer) as printed_page_number, cand_no, cast(case when b.isbn = s.isbn then 1.0 else round(least(1.0, 0.6 + case when b.year = s.year then 0.15 else 0 end + case when b.publisher = s.publisher then 0.15 else 0 end + case when list_has_any(b.editors, s.editors) then 0.2 else 0 end), 6) end as double) as confidence from b join s using (book_id))
select book_id, title, printed_page_number, cand_no, confidence from (select *, row_number() over (partition by book_id, title order by confidence desc, cand_no) as r from c) where r = 1""")
def catalog_candidates(spark, sf_dir):
    """The surest catalog section of each chapter title whose book title is the book's own."""
    names = lambda *c: F.array(*(F.concat(F.lit("E"), F.expr(x).cast("string")) for x in c))
    isbn = lambda c: F.concat(F.lit("978-"), F.lpad(F.col(c).cast("string"), 10, "0"))
    books = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("book_id"), F.concat(F.lit("Book "), "p_partkey").alias("title"), isbn("p_partkey").alias("isbn"), (1990 + F.col("p_size")).alias("year"),
        F.concat(F.lit("Press "), F.col("p_size") % 5).alias("publisher"), names("p_partkey % 7", "100 + p_size % 11").alias("editors"),
    )
    whole = F.col("l_quantity").cast("int")
    sections = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cand_no"), F.concat(F.lit("Chapter "), "l_suppkey").alias("title"), F.concat(F.lit(" Book "), "l_partkey", F.lit(" ")).alias("book_title"),
        F.when(F.col("l_linenumber") == 1, isbn("l_partkey")).alias("isbn"), F.concat(F.lit("May "), (1990 + whole).cast("string")).alias("date"), F.concat(F.lit(" press "), whole % 5).alias("publisher"),
        names("l_suppkey % 7").alias("editors"), F.array().cast("array<string>").alias("authors"), F.concat((F.col("l_linenumber") * 10).cast("string"), F.lit("-99")).alias("pages"), F.lit(None).cast("string").alias("doi"),
    )
    rows = evidence.catalog_candidates(books, sections)
    return rows.select("book_id", "title", "printed_page_number", "cand_no", F.round("metadata_confidence", 6).alias("confidence"))


@query("""with i as (select l_orderkey as book_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as integer) as cand_no, * from lineitem)
select book_id, cand_no, concat('Of part ', cast(l_partkey as varchar), case when l_linenumber % 2 = 0 then ': a study' else '' end) as title, case when l_suppkey % 3 = 0 then '' else concat('Ann Supplier', cast(l_suppkey as varchar)) end as authors,
case when l_suppkey % 4 = 0 then null else cast(l_partkey as integer) end as printed_page_number, concat('10.1/', cast(l_partkey as varchar)) as chapter_doi from i where l_returnflag <> 'R'""")
def crossref_chapters(spark, sf_dir):
    """Chapters of stored book records, items of other types left out."""
    given, family = F.lit("Ann").alias("given"), F.when(F.col("l_suppkey") % 3 != 0, F.concat(F.lit("Supplier"), "l_suppkey")).alias("family")
    item = F.struct(
        F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.concat(F.lit("10.1/"), "l_partkey").alias("DOI"), F.array(F.concat(F.lit("Of part "), "l_partkey")).alias("title"),
        F.when(F.col("l_linenumber") % 2 == 0, F.array(F.lit("a study"))).otherwise(F.array().cast("array<string>")).alias("subtitle"), F.array(F.struct(given, family)).alias("author"),
        F.concat(F.when(F.col("l_suppkey") % 4 == 0, F.lit("x")).otherwise(F.col("l_partkey").cast("string")), F.lit("-9999")).alias("page"), F.when(F.col("l_returnflag") != "R", "book-chapter").otherwise("book").alias("type"),
    )
    raw = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("book_id")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return evidence.crossref_chapters(raw).select("book_id", "cand_no", "title", F.array_join("authors", ",").alias("authors"), "printed_page_number", "chapter_doi")


EVIDENCE = "ev as (select l_partkey as book_id, l_orderkey * 10 + l_linenumber as cand_no, concat('T', cast(l_suppkey % 5 as varchar)) as title, case when l_linenumber <> 3 then cast(l_quantity as integer) % 4 end as printed_page_number, (l_linenumber % 3) / 2.0 as metadata_confidence from lineitem)"


def _evidence(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("book_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cand_no"), F.concat(F.lit("T"), F.col("l_suppkey") % 5).alias("title"),
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity").cast("int") % 4).alias("printed_page_number"), (F.col("l_linenumber") % 3 / 2.0).alias("metadata_confidence"),
    )


@query(f"with {EVIDENCE} select book_id, cand_no, title from (select *, row_number() over (partition by book_id, title, printed_page_number order by metadata_confidence desc, cand_no) as r from ev) where r = 1")
def dedupe_evidence(spark, sf_dir):
    """One row of evidence for each title and page, the surest."""
    return evidence.dedupe_evidence(_evidence(spark, sf_dir), ("title", "printed_page_number")).select("book_id", "cand_no", "title")


@query(f"with {EVIDENCE} select book_id, title, printed_page_number, row_number() over (partition by book_id order by printed_page_number asc nulls last, cand_no, title) - 1 as cand_no from ev")
def book_order(spark, sf_dir):
    """Evidence numbered in order of printed page."""
    return evidence.book_order(_evidence(spark, sf_dir)).select("book_id", "title", "printed_page_number", "cand_no")


RANGES = """ranges as (select *, coalesce(next_start - 1, n_pages - 1) as "end" from (select book_id, page_index as start, lead(page_index) over (partition by book_id order by page_index) as next_start, count(*) over (partition by book_id) as c, n_pages, cast((page_index - 2) // 3 as integer) as entry_no from book_pages join (select book_id, count(*) as n_pages from book_pages group by book_id) using (book_id) where page_index >= 2 and page_index % 3 = 2))"""


def _ranges(spark, sf_dir) -> DataFrame:
    rows = book_pages(spark, sf_dir)
    located = rows.filter("page_index >= 2 and page_index % 3 = 2").withColumn("entry_no", F.expr("cast((page_index - 2) div 3 as int)")).withColumn("title", F.lit("Of trees"))
    located = located.withColumn("is_roman", F.col("entry_no") == 0).withColumn("printed", F.when(F.col("entry_no") == 0, "i").when(F.col("entry_no") % 3 != 2, (F.col("page_index") - 1).cast("string")))
    located = located.withColumn("source", F.when(F.col("entry_no") % 2 == 1, "outline").otherwise("heuristic")).drop("text", "doc_id")
    return boundaries.chapter_ends(located, rows.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_pages")))


@query(f"""with {BOOK_PAGES}, {RANGES}, facts as (select book_id, page_index, doc_id * 37 % 101 > 60 as full_page, doc_id * 13 % 7 < 2 as closed from book_pages)
select book_id, entry_no, start, greatest(start, coalesce(max(page_index) filter (where full_page and (entry_no % 2 = 1 or not closed)), start)) as "end" from ranges left join facts using (book_id) where page_index <= "end" group by book_id, entry_no, start""")
def trailing_trim(spark, sf_dir):
    """Ranges without the closed and the almost empty pages at their ends."""
    rows = book_pages(spark, sf_dir)
    heads = rows.select("book_id", "page_index", (F.col("doc_id") * 37 % 101 > 60).alias("full"))
    closed = rows.filter("doc_id * 13 % 7 < 2").select("book_id", "page_index")
    return boundaries.trim_ends(_ranges(spark, sf_dir), heads, closed).select("book_id", "entry_no", "start", "end")


@query(f"""with {BOOK_PAGES}, {RANGES}, n as (select book_id, page_index, case when doc_id % 4 <> 0 then page_index - 1 end as shown, case when doc_id % 3 <> 0 then page_index - 1 end as inferred from book_pages),
r as (select *, greatest(start, "end" - entry_no % 2) as e, coalesce(next_start - 1, n_pages - 1) as f, case when entry_no = 0 then 1 when entry_no % 3 <> 2 then start - 1 end as declared, case when (entry_no + 1) % 3 <> 2 and entry_no > 0 and next_start is not null then next_start - 1 end as next_value from ranges),
j as (select r.*, s.shown as ss, s.inferred as si, x.shown as es, x.inferred as ei, coalesce(y.shown, y.inferred) as stand from r left join n s on s.book_id = r.book_id and s.page_index = start left join n x on x.book_id = r.book_id and x.page_index = e left join n y on y.book_id = r.book_id and y.page_index = f),
k as (select *, coalesce(declared, ss) as read, coalesce(declared, ss, si) as first, case when next_value > 1 then next_value - 1 end as derived from j),
l as (select *, coalesce(derived, es, ei, case when stand >= first and entry_no > 0 then stand end) as last from k)
select book_id, entry_no, case when first is not null and last is not null then concat(case when entry_no = 0 then 'i' else cast(first as varchar) end, '-', cast(last as varchar)) end as citation_pages,
case when first is null or last is null then 'unmappable' when read is not null and derived is null and es is not null then 'high' else 'inferred' end as page_mapping_confidence from l""")
def citation_pages(spark, sf_dir):
    """Printed ranges from what contents declare, pages show and neighbours imply."""
    number = (F.col("page_index") - 1).cast("string")
    numbers = book_pages(spark, sf_dir).select("book_id", "page_index", F.when(F.col("doc_id") % 4 != 0, number).alias("printed"), F.when(F.col("doc_id") % 3 != 0, number).alias("inferred"))
    ranges = _ranges(spark, sf_dir).withColumn("end", F.greatest(F.col("start"), F.col("end") - F.col("entry_no") % 2))
    return boundaries.citation_pages(ranges, numbers).select("book_id", "entry_no", "citation_pages", "page_mapping_confidence")


@query(f"""with {BOOK_PAGES}, l as (select book_id, page_index, page_index - row_number() over (partition by book_id order by page_index) as run from book_pages where doc_id * 37 % 101 < 9),
r as (select book_id, run, min(page_index) as a, max(page_index) as b from l group by all)
select book_id, case when count(*) = 1 then min(a) end as start, case when count(*) = 1 then max(b) end as "end", case when count(*) = 1 then 'ok' else 'needs review' end as status from r group by book_id""")
def toc_range(spark, sf_dir):
    """The one run of listing pages of each book, or that it needs review."""
    return curate.toc_range(book_pages(spark, sf_dir).filter("doc_id * 37 % 101 < 9").select("book_id", "page_index"))


@query("""with c as (select l_orderkey as book_id, count(*) filter (where l_suppkey % 5 <> 0) as n, count(*) as total from lineitem group by all)
select book_id, n, n / total as share, n >= 3 and n >= 0.8 * total as ok from c""")
def confirmed_gate(spark, sf_dir):
    """Books with enough confirmed chapters."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book_id"), F.when(F.col("l_suppkey") % 5 != 0, F.col("l_linenumber")).alias("page_index"))
    return curate.confirmed_gate(rows)


@query(f"""with {CITED}, t as (select strategy, sum(pairs) as pairs, sum(covered) as covered, sum(start_ok) as start_ok, sum(end_ok) as end_ok from p group by strategy)
select *, covered / pairs as coverage, case when covered > 0 then start_ok / covered else 0 end as start_accuracy, case when covered > 0 then end_ok / covered else 0 end as end_accuracy from t""")
def citation_rollup(spark, sf_dir):
    """Pooled rates of printed ranges for each strategy."""
    return evaluate.citation_micro(citation_accuracy(spark, sf_dir), "strategy")


@query("""with b as (select event_type as model, user_id as book_id, min(value) >= 1 as full_recall, (user_id % 30) / 100.0 as candidate_share from events group by event_type, user_id),
a as (select model, round(avg(cast(full_recall as double)), 9) as full_recall, round(avg(candidate_share), 9) as candidate_share from b group by model) select *, full_recall >= 0.9 and candidate_share <= 0.15 as meets_bar from a""")
def classifier_summary(spark, sf_dir):
    """Recall and candidate shares of classifiers over books that were left out."""
    per_book = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model"), F.col("user_id").alias("book_id")).agg((F.min("value") >= 1).alias("full_recall"))
    rows = layout.lobo_summary(per_book.withColumn("candidate_share", F.col("book_id") % 30 / 100.0), "model")
    return rows.select("model", F.round("full_recall", 9).alias("full_recall"), F.round("candidate_share", 9).alias("candidate_share"), "meets_bar")


@query(f"""with {BOOK_PAGES}, {EXPECTED}, l as (select b.doc_id, case when e.book_id is not null then 'chapter_first' when b.page_index = 1 then 'toc' else 'other' end as label from book_pages b left join expected e on e.book_id = b.book_id and e.pdf_start_index = b.page_index where b.book_id % 5 <> 0)
select label, count(*) as n from l where doc_id % 7 = 0 group by label""")
def lost_pages(spark, sf_dir):
    """Labelled pages without layout features, by label."""
    return layout.lost_pages(page_labels(spark, sf_dir), book_pages(spark, sf_dir).filter("doc_id % 7 <> 0"))


CANDIDATES = "candidates as (select l_orderkey // 8 as book_id, cast(l_linenumber % 2 as integer) as entry_no, cast(l_suppkey % 2 as integer) as variant_no, concat('reading ', repeat('x', cast(l_suppkey % 2 as integer))) as reading, cast(l_partkey % 40 as integer) as page_index, cast(80 + cast(l_quantity as integer) % 19 as double) as score, l_tax > 0.05 as author_confirmed, l_returnflag = 'R' as is_roman from lineitem)"
CLUSTERS = f"""{CANDIDATES}, islands as (select *, sum(step) over (partition by book_id, entry_no, variant_no order by page_index) as island from (select *, case when page_index - lag(page_index) over (partition by book_id, entry_no, variant_no order by page_index) > {locate.CLUSTER_GAP} then 1 else 0 end as step from candidates)),
clusters as (select book_id, entry_no, variant_no, reading, min(page_index) as page_index, max(score) as score, bool_or(author_confirmed) as author_confirmed from islands group by book_id, entry_no, variant_no, reading, island)"""
BEST = f"""{CLUSTERS}, keyed as (select *, score + case when author_confirmed then {locate.AUTHOR_BONUS} else 0 end as key from clusters),
ranked as (select *, row_number() over w as r, lead(key) over w as next from keyed window w as (partition by book_id, entry_no, variant_no order by key desc, page_index)),
best as (select *, key - coalesce(next, 0) as margin from ranked where r = 1 and (next is null or key - next >= {locate.MARGIN}))"""


def _candidates(spark, sf_dir) -> DataFrame:
    variant = (F.col("l_suppkey") % 2).cast("int")
    items = table(spark, sf_dir, "lineitem")
    rows = items.select(
        F.expr("l_orderkey div 8").alias("book_id"), (F.col("l_linenumber") % 2).cast("int").alias("entry_no"), variant.alias("variant_no"), F.concat(F.lit("reading "), F.repeat(F.lit("x"), variant)).alias("reading"),
        (F.col("l_partkey") % 40).cast("int").alias("page_index"), (80.0 + F.col("l_quantity").cast("int") % 19).alias("score"), (F.col("l_tax") > 0.05).alias("author_confirmed"), (F.col("l_returnflag") == "R").alias("is_roman"),
    )
    return dealt(rows, "book_id", items.count())


@query(f"with {CLUSTERS} select * from clusters")
def location_clusters(spark, sf_dir):
    """Candidate pages of each reading, chained into clusters."""
    return locate.cluster_candidates(_candidates(spark, sf_dir))


@query(f"with {BEST} select book_id, entry_no, variant_no, page_index, key, margin from best")
def best_cluster_margin(spark, sf_dir):
    """Each reading's best cluster where it stands clear of the next."""
    return locate.best_cluster(locate.cluster_candidates(_candidates(spark, sf_dir))).select("book_id", "entry_no", "variant_no", "page_index", "key", "margin")


@query(f"with {BEST} select book_id, entry_no, variant_no, page_index from (select *, row_number() over (partition by book_id, entry_no order by least(key, margin) desc, key desc, length(reading) desc, variant_no) as n from best) where n = 1")
def best_reading(spark, sf_dir):
    """The reading of each entry that is located most surely."""
    rows = locate.best_variant(locate.best_cluster(locate.cluster_candidates(_candidates(spark, sf_dir))))
    return rows.select("book_id", "entry_no", "variant_no", "page_index")


@query(f"""with {CANDIDATES}, x as (select distinct l_orderkey // 8 as book_id, l_suppkey % 40 as page_index from lineitem where l_linenumber = 7), f as (select l_orderkey // 8 as book_id, max(l_partkey % 30) as front from lineitem where l_linenumber = 1 and l_partkey % 30 < 20 group by all)
select book_id, entry_no, variant_no, page_index, score, is_roman from candidates left join f using (book_id) where (book_id, page_index) not in (select (book_id, page_index) from x) and (is_roman or front is null or page_index > front)""")
def allowed_pages(spark, sf_dir):
    """Candidates on pages where their entry may open."""
    rows = table(spark, sf_dir, "lineitem").withColumn("book_id", F.expr("l_orderkey div 8"))
    excluded = rows.filter("l_linenumber = 7").select("book_id", (F.col("l_suppkey") % 40).cast("int").alias("page_index"))
    listed = rows.filter("l_linenumber = 1").select("book_id", (F.col("l_partkey") % 30).alias("source_page_index"))
    front = locate.last_front_page(listed, rows.select("book_id").distinct().withColumn("n_pages", F.lit(40)))
    return locate.allowed_pages(_candidates(spark, sf_dir), excluded, front).select("book_id", "entry_no", "variant_no", "page_index", "score", "is_roman")


@query(f"""with {BOOK_PAGES}, m as (select book_id, case when doc_id % 11 <> 0 then page_index end as a, case when doc_id % 7 <> 0 then page_index + case when doc_id % 5 = 0 then 1 else 0 end end as b from book_pages)
select distinct * from (select book_id, unnest([a, b]) as page_index from m where a is distinct from b) where page_index is not null""")
def drifted_pages(spark, sf_dir):
    """Pages where redaction moves a located entry."""
    rows = book_pages(spark, sf_dir).withColumn("entry_no", F.col("page_index"))
    moved = rows.filter("doc_id % 7 <> 0").withColumn("page_index", F.expr("page_index + if(doc_id % 5 = 0, 1, 0)"))
    return redact.drifted_pages(rows.filter("doc_id % 11 <> 0"), moved)


@query(f"""with {BOOK_PAGES}, both_layers as (select 'text' as layer, book_id, page_index, case when book_id % 3 = 0 then '' else text end as text from book_pages union all select 'ocr', book_id, page_index, case when book_id % 2 = 0 then replace(text, chr(10), ' ') else text end from book_pages),
f as (select layer, book_id, length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 500 as f, length(text) - length(replace(text, chr(10), '')) < 3 as flat from both_layers),
bad as (select layer, book_id, count(*) filter (where f) < 0.1 * count(*) or count(*) filter (where f and flat) > 0.5 * count(*) filter (where f) as bad from f group by all),
pick as (select book_id, case when not bool_or(bad) filter (where layer = 'text') then 'text' when not bool_or(bad) filter (where layer = 'ocr') then 'ocr' end as layer from bad group by book_id)
select book_id, page_index, md5(text) as digest, cast(null as varchar) as reason from both_layers join pick using (book_id, layer) union all select book_id, null, null, 'no readable text' from pick where layer is null""")
def choose_pages(spark, sf_dir):
    """Each book's text layer, else its recognised text; books with neither are named."""
    rows = book_pages(spark, sf_dir).drop("doc_id")
    layer = rows.withColumn("text", F.when(F.col("book_id") % 3 == 0, "").otherwise(F.col("text")))
    read = rows.withColumn("text", F.when(F.col("book_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(" "))).otherwise(F.col("text")))
    chosen, skipped = runs.choose_pages(layer, read)
    chosen = chosen.select("book_id", "page_index", F.md5("text").alias("digest"), F.lit(None).cast("string").alias("reason"))
    return chosen.unionByName(skipped.select("book_id", F.lit(None).cast("int").alias("page_index"), F.lit(None).cast("string").alias("digest"), "reason"))


HEADINGS = ("Part II Roads", "Teil 3", "Partly cloudy", "INDEX", "Mémento par Jean", "Notes on contributors", "Personenverzeichnis", "Cover", "Half title", "Sachregister")
_listed = lambda items: "(" + ", ".join(f"'{x}'" for x in items) + ")"
_PART = r"^(?:teil|part|partie|section|abschnitt)\b[\s.:]*(?:[0-9]+|[ivxlcdm]+)?\b"


@query(f"""with t as (select doc_id, case when doc_id % 3 = 0 then {list(HEADINGS)}[doc_id // 3 % {len(HEADINGS)} + 1] else split_part(text, chr(10), 1) end as title from documents),
n as (select doc_id, title, trim(regexp_replace(regexp_replace(strip_accents(lower(title)), '[^\\pL\\pN_\\s]', '', 'g'), '\\s+', ' ', 'g')) as form from t)
select doc_id, form, regexp_matches(lower(title), '{_PART}') as is_part, form in {_listed(T.BACK_MATTER)} or trim(regexp_split_to_array(form, '\\b(?:par|by)\\b')[1]) in {_listed(T.BACK_MATTER)} as is_back, form in {_listed(T.PRODUCTION)} or ends_with(form, 'verzeichnis') as is_production from n""")
def title_kinds(spark, sf_dir):
    """Normal forms of titles, and which of them are parts, back matter or production pages."""
    heads = F.get(F.array(*map(F.lit, HEADINGS)), F.expr(f"cast(doc_id div 3 % {len(HEADINGS)} as int)"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, heads).otherwise(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"))
    title = F.col("title")
    return rows.select("doc_id", T.plain_title(title).alias("form"), T.is_part_divider(title).alias("is_part"), T.is_back_matter(title).alias("is_back"), T.is_production_bookmark(title).alias("is_production"))


@query("""with r as (select o_orderkey, cast(o_orderkey % 3999 + 1 as integer) as v, o_orderkey % 300 as n, o_orderkey % 6 as k from orders)
select o_orderkey, concat(repeat('m', v // 1000), ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][v // 100 % 10 + 1], ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][v // 10 % 10 + 1], ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][v % 10 + 1]) as roman,
case k when 0 then cast(n as varchar) when 1 then cast(n as varchar) when 2 then concat('R', cast(n as varchar)) when 4 then '-1' end as printed,
case when k in (0) and n between 1 and 200 then cast(n as varchar) when k = 1 then concat(' ', cast(n as varchar), ' ') when k = 2 then concat('R', cast(n as varchar)) end as declared,
case when k <> 5 then cast(n as integer) end as first, case when k not in (4, 5) then concat(cast(n as varchar), '|', cast(n + k as varchar)) end as ends from r""")
def number_fields(spark, sf_dir):
    """Roman numerals, canonical and declared page numbers, and the ends of ranges."""
    n, k = (F.col("o_orderkey") % 300).cast("string"), F.col("o_orderkey") % 6
    raw = F.when(k == 0, n).when(k == 1, F.concat(F.lit(" "), n, F.lit(" "))).when(k == 2, F.concat(F.lit("R"), n)).when(k == 3, "null").when(k == 4, "-1").otherwise(" ")
    span = F.when(k == 4, n).when(k == 5, "x-y-z").otherwise(F.concat(n, F.lit(" - "), (F.col("o_orderkey") % 300 + k).cast("string")))
    ends = N.split_citation(F.col("span"))
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"), span.alias("span")).select(
        "o_orderkey", N.to_roman(F.col("o_orderkey") % 3999 + 1).alias("roman"), N.normalize_printed(F.col("raw")).alias("printed"), N.declared_page(F.col("raw"), F.lit(False), F.lit(100)).alias("declared"),
        N.first_page(F.col("span")).alias("first"), F.when(ends.isNotNull(), F.concat(ends["start"], F.lit("|"), ends["end"])).alias("ends"),
    )


@query("""select doc_id, case lang when 'de' then 'deu' when 'fr' then 'fra' when 'es' then 'spa' when 'en' then 'eng' else 'eng+deu+fra+spa' end as pack, 1900 + cast(doc_id % 150 as integer) as year,
case doc_id % 4 when 0 then 'context_length_exceeded' when 1 then 'invalid_or_truncated_json' else 'api_error' end as failure, case when doc_id % 5 < 2 then 'u2' else 'u1' end as license from documents""")
def record_fields(spark, sf_dir):
    """Recognition packs, years, classes of failures and license addresses of records."""
    k = F.col("doc_id") % 4
    message = F.when(k == 0, "This model's Maximum context length is 8192").when(k == 1, F.concat(F.lit("Expecting value: line "), "doc_id")).otherwise("timed out")
    entry = lambda url, version, delay: F.struct(F.lit(url).alias("url"), version.alias("content_version"), delay.alias("delay"))
    licenses = F.array(entry("u1", F.lit("am"), F.lit(0)), entry("u2", F.lit("vor"), F.when(F.col("doc_id") % 5 >= 2, F.lit(30)).when(F.col("doc_id") % 5 == 1, F.lit(0))))
    date = F.concat_ws("-", (1900 + F.col("doc_id") % 150).cast("string"), F.lit("05"))
    return table(spark, sf_dir, "documents").select("doc_id", T.ocr_pack(F.concat("lang", F.lit("-AT"))).alias("pack"), T.year_of(date).alias("year"), T.failure_class(message).alias("failure"), T.license_url(licenses).alias("license"))


@query("""with m as (select distinct p_brand as model_id from part where p_size < 25), c as (select distinct p_brand as model_id from part where p_size >= 40)
select 'offered' as kind, model_id from m where model_id in (select model_id from c) union all select 'gone', model_id from c where model_id not in (select model_id from m)""")
def full_regeneration(spark, sf_dir):
    """Models whose runs are made again, and those with runs that are no longer offered."""
    models = lambda condition: table(spark, sf_dir, "part").filter(condition).select(F.col("p_brand").alias("model_id")).distinct()
    offered, gone = runs.full_regen(models("p_size < 25"), models("p_size >= 40"))
    return offered.select(F.lit("offered").alias("kind"), "model_id").union(gone.select(F.lit("gone"), "model_id"))


@query("""with e as (select vec_id, cast(embedding as double[]) as v, label from embeddings), a as (select * from e where label < 3), c as (select * from e where label >= 3),
d as (select x.vec_id, min(list_distance(x.v, y.v)) as distance from a x, a y where x.vec_id <> y.vec_id group by all), t as (select quantile_cont(distance, 0.9) as threshold from d),
n as (select c.vec_id, min(list_distance(c.v, a.v)) as distance from c, a group by all)
select vec_id // 10 as book_id, bool_or(distance >= threshold) as is_novel from n, t group by all""")
def novelty_gate(spark, sf_dir):
    """Books with a page at least as far from the accepted ones as nine tenths of those are from each other."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    known, new = rows.filter("label < 3").drop("label"), rows.filter("label >= 3").drop("label")
    return curate.is_novel(new.withColumn("book_id", F.expr("id div 10")), known, curate.novelty_threshold(known))
