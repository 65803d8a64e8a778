"""Curation over the derived corpus: locating from records, the reconciliation funnel, discovery, manifests and scan noise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators import curate, manifests, noise, reconcile
from folio.operators.tables import stored
from folio.plans import fixture
from folio.plans.jobs import book_layout
from folio.plans.queries import LINES, PAGES, query, table


def records(spark, sf_dir) -> DataFrame:
    """Record rows of every chapter of the derived corpus: of every fifth book one author has all, of every seventh none a page."""
    titles = fixture.book_titles(spark, sf_dir)
    author = F.when(F.expr("book_id % 5 = 0"), F.lit("Ann Author")).otherwise(F.concat(F.lit("Bo Writer"), F.col("k").cast("string")))
    pages = F.when(F.expr("book_id % 7 <> 3"), F.expr("concat(k - 1, '-', k + 1)"))
    return titles.select("book_id", F.expr("cast((k - 2) div 3 as int)").alias("chapter_no"), "title", F.array(author).alias("authors"), pages.alias("citation_pages"), F.col("k").cast("int").alias("k"))


def _contents(pages: DataFrame) -> DataFrame:
    return stored(reconcile.listing_pages(pages))


@query()
def near_window(spark, sf_dir):
    """The page near a chapter's supposed one that is most like its title, on uncut texts."""
    p = fixture.stored_pages(spark, sf_dir)
    chapters = records(spark, sf_dir).withColumn("center", F.col("k") + F.expr("cast((book_id + k) % 5 - 2 as int)")).drop("k")
    return reconcile.confirm_near(chapters, p, _contents(p))


@query()
def sequential_location(spark, sf_dir):
    """Opening pages of all chapters, each looked for after the one before, on uncut texts."""
    p = fixture.stored_pages(spark, sf_dir)
    entries = records(spark, sf_dir).withColumnRenamed("chapter_no", "entry_no").select("book_id", "entry_no", "title", "authors")
    return reconcile.locate_sequential(entries, p, _contents(p))


@query()
def outline_disagreement(spark, sf_dir):
    """Chapters that an outline has on another page."""
    rows = records(spark, sf_dir)
    outline = rows.filter("book_id % 2 = 1").select("book_id", F.col("chapter_no").alias("cand_no"), F.upper("title").alias("title"), (F.col("k") + F.expr("cast(chapter_no = 3 as int)")).alias("pdf_page_index"))
    return reconcile.outline_disagreements(outline, rows.withColumnRenamed("k", "pdf_start_index"))


@query()
def reconcile_funnel(spark, sf_dir):
    """The outcome of every derived book in the funnel, with what its gates saw."""
    p = fixture.stored_pages(spark, sf_dir)
    chapters = records(spark, sf_dir).drop("k")
    books = p.select("book_id").distinct()
    vectors = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 25").alias("book_id"), F.expr("cast(vec_id % 25 as int)").alias("page_index"), F.col("embedding").cast("array<double>").alias("v"))
    reference = vectors.filter("book_id % 4 = 1").select(F.concat(F.lit("r"), (F.col("book_id") * 25 + F.col("page_index")).cast("string")).alias("id"), "v")
    threshold = stored(curate.novelty_threshold(reference, 50.0))
    return reconcile.reconcile(books, chapters, p, vectors.filter("book_id % 9 <> 2"), reference, threshold)[0]


def works(spark, sf_dir) -> DataFrame:
    link = "struct(concat('https://p/', doc_id, '.pdf') as url, '{0}' as content_type)"
    page = "struct(concat('https://p/', doc_id) as url, 'text/html' as content_type)"
    links = f"case doc_id % 4 when 0 then array({page}, {link.format('application/pdf')}) when 1 then array({link.format('unspecified')}, {link.format('application/pdf')}) when 2 then array({page}) else array(struct('' as url, 'application/pdf' as content_type)) end"
    return table(spark, sf_dir, "documents").select(
        F.expr("concat('978', lpad(doc_id div 2, 10, '0'))").alias("isbn"), F.expr("case when doc_id % 7 <> 0 then concat('10.5/', doc_id) end").alias("doi"), F.col("lang").alias("language"), F.col("doc_id").alias("arrival"), F.expr(links).alias("links")
    )


def services(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    doi = F.expr("concat('10.5/', doc_id)").alias("doi")
    second = docs.filter("doc_id % 3 = 0").select(doi, F.expr("case when doc_id % 9 = 0 then '' else concat('https://u/', doc_id) end").alias("url"))
    return second, docs.filter("doc_id % 5 < 2").select(doi, F.expr("concat('https://o/', doc_id)").alias("url"))


WORKS = """works as (select concat('978', lpad(cast(doc_id // 2 as varchar), 10, '0')) as isbn, case when doc_id % 7 <> 0 then concat('10.5/', doc_id) end as doi, lang as language, doc_id as arrival,
  case when doc_id % 4 < 2 then concat('https://p/', doc_id, '.pdf') when doc_id % 7 <> 0 and doc_id % 3 = 0 and doc_id % 9 <> 0 then concat('https://u/', doc_id) when doc_id % 7 <> 0 and doc_id % 5 < 2 then concat('https://o/', doc_id) end as url,
  case when doc_id % 4 < 2 then 'crossref' when doc_id % 7 <> 0 and doc_id % 3 = 0 and doc_id % 9 <> 0 then 'unpaywall' when doc_id % 7 <> 0 and doc_id % 5 < 2 then 'openalex' end as url_source from documents)"""


@query(f"with {WORKS} select arrival, url, url_source from works")
def pdf_url_cascade(spark, sf_dir):
    """Where the file of each work can be fetched, by three sources in turn."""
    return manifests.resolve_pdf_url(works(spark, sf_dir), *services(spark, sf_dir)).select("arrival", "url", "url_source")


@query(f"""with {WORKS}, fresh as (select * from works where isbn not in (select isbn from works where arrival % 11 = 0) and (doi is null or doi not in (select doi from works where arrival % 13 = 5 and doi is not null))),
one as (select * from (select *, row_number() over (partition by isbn order by arrival) as r from fresh) where r = 1 and url is not null),
ranks as (select language, row_number() over (order by n, language) as rank from (select lang as language, count(*) as n from documents where doc_id % 10 < 3 group by lang))
select language, rank, arrival, isbn, url, url_source from (select one.*, rank, row_number() over (partition by language order by arrival) as k from one join ranks using (language)) where k <= 5""")
def discovery(spark, sf_dir):
    """New works with a file to fetch, some of each language."""
    all_works = works(spark, sf_dir)
    known = all_works.filter("arrival % 11 = 0").select("isbn", F.lit(None).cast("string").alias("doi")).unionByName(all_works.filter("arrival % 13 = 5").select(F.lit(None).cast("string").alias("isbn"), "doi"))
    have = table(spark, sf_dir, "documents").filter("doc_id % 10 < 3").select(F.col("lang").alias("language"))
    found = manifests.discover(all_works, known, *services(spark, sf_dir), have, have.distinct())
    return found.select("language", "rank", "arrival", "isbn", "url", "url_source")


def license_items(spark, sf_dir) -> DataFrame:
    """(book_id, item_no, licenses): the licenses that each chapter record names, some of preprints or with a delay."""
    one = "named_struct('url', concat('https://l/', {0}), 'content_version', '{1}', 'delay', {2})"
    licenses = f"case doc_id % 6 when 0 then array({one.format('doc_id % 3', 'am', '0')}, {one.format('7', 'vor', '0')}) when 1 then array({one.format('doc_id % 2', 'vor', '12')}) when 2 then array({one.format('7', 'vor', '0')}, {one.format('8', 'vor', '0')}) end"
    return table(spark, sf_dir, "documents").filter("doc_id div 25 % 4 <> 3").select(F.expr("doc_id div 25").alias("book_id"), F.col("doc_id").alias("item_no"), F.expr(licenses).alias("licenses"))


def manifest(spark, sf_dir) -> DataFrame:
    """(book_id, doi, license, license_source, checked): some never looked for, some without any, some out of date."""
    books = table(spark, sf_dir, "documents").select(F.expr("doc_id div 25").alias("book_id")).distinct()
    return books.selectExpr("book_id", "concat('10.6/', book_id) as doi", "case when book_id % 3 = 1 then 'https://l/7' end as license", "case when book_id % 3 = 1 then 'crossref' end as license_source", "book_id % 5 <> 0 as checked")


def licenses(spark, sf_dir) -> DataFrame:
    books = manifest(spark, sf_dir)
    fallback = books.filter("book_id % 2 = 1").selectExpr("doi", "case when book_id % 8 = 7 then 'unheard-of' else 'cc-by' end as code")
    return stored(manifests.resolved_licenses(books, license_items(spark, sf_dir), fallback))


LICENSES = """books as (select distinct doc_id // 25 as book_id from documents), votes as (select doc_id // 25 as book_id, doc_id, case doc_id % 6 when 0 then 'https://l/7' when 1 then concat('https://l/', doc_id % 2) when 2 then 'https://l/7' end as license from documents where doc_id // 25 % 4 <> 3),
own as (select book_id, license from (select *, row_number() over (partition by book_id order by n desc, f) as r from (select book_id, license, count(*) as n, min(doc_id) as f from votes where license is not null group by book_id, license)) where r = 1),
licenses as (select book_id, coalesce(own.license, case when book_id % 2 = 1 and book_id % 8 <> 7 then 'https://creativecommons.org/licenses/by/4.0/' end) as license, case when own.license is not null then 'crossref' when book_id % 2 = 1 and book_id % 8 <> 7 then 'unpaywall' end as license_source from books left join own using (book_id)),
manifest as (select book_id, case when book_id % 3 = 1 then 'https://l/7' end as license, case when book_id % 3 = 1 then 'crossref' end as license_source, book_id % 5 <> 0 as checked from books)"""


@query(f"with {LICENSES} select m.book_id, l.license, l.license_source from manifest m join licenses l using (book_id) where not checked or m.license is distinct from l.license or m.license_source is distinct from l.license_source")
def license_backfill(spark, sf_dir):
    """Manifest rows whose license is news."""
    return manifests.license_updates(manifest(spark, sf_dir), licenses(spark, sf_dir)).drop("checked")


def cited(spark, sf_dir) -> DataFrame:
    """Chapter records with their printed ranges: every third book has one without, every sixth has no records."""
    docs = table(spark, sf_dir, "documents").filter("doc_id div 25 % 6 <> 5 and doc_id % 25 % 3 = 2")
    return docs.select(F.expr("doc_id div 25").alias("book_id"), F.expr("case when doc_id div 25 % 3 = 0 and doc_id % 25 = 8 then '' else concat(doc_id % 25, '-', doc_id % 25 + 2) end").alias("citation_pages"))


@query(f"""with {LICENSES}, c as (select doc_id // 25 as book_id, case when doc_id // 25 % 3 = 0 and doc_id % 25 = 8 then '' else 'x' end as pages from documents where doc_id // 25 % 6 <> 5 and doc_id % 25 % 3 = 2),
n as (select book_id, count(c.book_id) as n, count(*) filter (where pages = '') as missing from books left join c using (book_id) group by all)
select book_id, 'zero book-chapter records' as reason from n where n = 0 union all select book_id, concat(missing, ' chapter(s) missing page range') from n where n > 0 and missing > 0 union all select book_id, 'no license found' from licenses where license is null""")
def record_review(spark, sf_dir):
    """Books whose records need a look, with the reason."""
    return manifests.review_flags(manifest(spark, sf_dir), cited(spark, sf_dir), licenses(spark, sf_dir))


@query(f"""with {LICENSES}, listed as (select * from manifest where book_id % 4 <> 2), truth as (select doc_id // 25 as book_id, doc_id % 25 as s, doc_id % 25 + case when doc_id // 25 % 7 = 4 then 3 else 2 end as e from documents where doc_id // 25 % 5 <> 1 and doc_id % 25 % 3 = 2),
wrong as (select distinct book_id from (select *, lead(s) over (partition by book_id order by s, e) as next from truth) where e >= next or e >= 26),
o as (select book_id, case when book_id not in (select book_id from listed) then 'not in the manifest' when book_id not in (select book_id from truth) then 'no ground truth' when book_id in (select book_id from wrong) then 'bounds errors' else 'ok' end as outcome from books)
select book_id, outcome, case when outcome = 'ok' then 'target' when book_id in (select book_id from listed) then 'pending' end as manifest, case when outcome = 'ok' then l.license else listed.license end as license from o join licenses l using (book_id) left join listed using (book_id)""")
def promotion(spark, sf_dir):
    """What becomes of pending books, in which manifest they stand then, and with which license."""
    pending = manifest(spark, sf_dir).filter("book_id % 4 <> 2")
    docs = table(spark, sf_dir, "documents")
    truth = docs.filter("doc_id div 25 % 5 <> 1 and doc_id % 25 % 3 = 2").selectExpr("doc_id div 25 as book_id", "doc_id as chapter_no", "doc_id % 25 as pdf_start_index", "doc_id % 25 + case when doc_id div 25 % 7 = 4 then 3 else 2 end as pdf_end_index")
    books = manifest(spark, sf_dir)
    outcomes, left, moved = manifests.promote(books.select("book_id"), pending, pending.filter("false"), truth, books.select("book_id", F.lit(26).alias("n_pages")), licenses(spark, sf_dir))
    stands = left.select("book_id", F.lit("pending").alias("manifest"), "license").unionByName(moved.select("book_id", F.lit("target").alias("manifest"), "license"))
    return outcomes.join(stands, "book_id", "left").select("book_id", "outcome", "manifest", "license")


def _uniform(low: float, high: float, *keys: str) -> str:
    number = lambda x: f"{x:.17e}"  # noqa: E731  a double, not a decimal
    return f"({number(low)} + cast(cast('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 8) as ubigint) as double) / {number(2.0**32)} * {number(high - low)})"


def _box(c: str, axis: str) -> str:
    return f"greatest(0, round(({c} + {_uniform(*noise.DRIFT, repr(f'drift-{axis}'), 'book_id', 'page_index')}) * {_uniform(*noise.BOX, repr(c), 'book_id', 'page_index', 'line_no')}, 2))"


@query(f"""with {PAGES}, {LINES}, l as (select book_id, page_index, line_no, cast(50 + (7 * line_no) % 30 as double) as hpos, cast(40 + 14 * line_no as double) as vpos, least(500.0, 5.0 * length(line))::double as width,
  case when line_no = 0 and page_index >= 2 and page_index % 3 = 2 and (book_id * 7 + page_index) % 5 <> 0 or (book_id + page_index * 3 + line_no) % 97 = 0 then 18.0::double else 10.0::double end as font from lines where book_id < {fixture.ANNEX}),
body as (select book_id, font as body from (select *, row_number() over (partition by book_id order by n desc, f) as r from (select book_id, font, count(*) as n, min(page_index * 1000000 + line_no) as f from l group by book_id, font)) where r = 1),
p as (select *, body + (font - body) * {_uniform(*noise.CONTRAST, "'contrast'", 'book_id')} as pulled, cast(floor({_uniform(0.0, noise.CLONES, "'clone'", 'book_id', 'page_index', 'line_no')}) as integer) as clone from l join body using (book_id))
select book_id, page_index, line_no, round(pulled * {_uniform(*noise.FONT, "'font'", 'book_id', 'round(font, 3)', 'clone')}, 3) as font, {_box('hpos', 'x')} as hpos, {_box('vpos', 'y')} as vpos, round(width * {_uniform(*noise.BOX, "'width'", 'book_id', 'page_index', 'line_no')}, 2) as width from p""")
def scan_noise_augment(spark, sf_dir):
    """Layout lines of the derived corpus with the noise of scans."""
    return noise.with_scan_noise(book_layout(spark, sf_dir, ascii_only=True)).select("book_id", "page_index", "line_no", "font", "hpos", "vpos", "width")
