"""Queries of the engine over the driver tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text
from folio.operators import boundaries, curate, evaluate, evidence, layout, locate, redact, runs, segment, toc
from folio.plans import fixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def roman(n: int) -> str:
    return "".join(("", "x", "xx", "xxx", "xl", "l")[n // 10 : n // 10 + 1] + ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")[n % 10 : n % 10 + 1])


PAGES = f"pages_book as (select * from {fixture.book_pages_sql()})"
ROMANS = "romans(s, v) as (values " + ", ".join(f"('{roman(i)}', {i})" for i in range(1, 51)) + ")"
LINES = "lines as (select book_id, page_index, i - 1 as line_no, trim(l[i]) as line from (select book_id, page_index, string_split(text, chr(10)) as l from pages_book where text <> ''), unnest(range(1, len(l) + 1)) as u(i) where not (i = len(l) and l[i] = ''))"
NPAGES = "n_pages as (select book_id, count(*) as n_pages from pages_book group by book_id)"
TOC_RE = r"^(.{3,120}?)[.\s]{1,}(\d{1,4}|[ivxlcdm]{1,6}|[IVXLCDM]{1,6})\s*$"
VALID = rf"""valid as (select lines.book_id, page_index, line_no, trim(regexp_extract(line, '{TOC_RE}', 1), ' .') as title, regexp_extract(line, '{TOC_RE}', 2) as printed,
  coalesce(try_cast(regexp_extract(line, '{TOC_RE}', 2) as integer), v) as value, n_pages
  from lines join n_pages using (book_id) left join romans on lower(regexp_extract(line, '{TOC_RE}', 2)) = s
  where regexp_matches(line, '{TOC_RE}') and not regexp_matches(lower(line), 'doi\.org|http://|https://|www\.') and not regexp_matches(line, '(?i)^\s*([@]\s*\d{{4}}\b|isbn\b|gedruckt\b|printed in\b)'))"""
LISTED = """listed as (select book_id, page_index, count(*) as n from valid where value <= 2 * n_pages and length(title) >= 3
  and (page_index < greatest(1, floor(n_pages * 0.15)) or page_index >= n_pages - greatest(1, floor(n_pages * 0.05))) group by book_id, page_index having count(*) >= 3),
first as (select book_id, page_index from (select *, sum(new) over (partition by book_id order by page_index) as island from (select *, case when page_index - lag(page_index) over (partition by book_id order by page_index) > 2 then 1 else 0 end as new from listed)) where island = 0)"""
TEXT_CTES = ", ".join((PAGES, ROMANS, LINES, NPAGES, VALID))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.book_pages(spark, sf_dir, ascii_only=True)


@query(f"with {TEXT_CTES}, {LISTED} select v.book_id, v.page_index as source_page_index, v.title, v.printed, v.value from valid v join first using (book_id, page_index) where value <= 2 * n_pages and length(title) >= 3")
def toc_entries(spark, sf_dir):
    """Contents entries of every book."""
    return toc.toc_entries(pages(spark, sf_dir)).select("book_id", "source_page_index", "title", "printed", "value")


@query(f"with {TEXT_CTES} select book_id, page_index, count(*) as n from valid where value <= 2 * n_pages and length(title) >= 3 group by book_id, page_index having count(*) >= 3")
def toc_listing_pages(spark, sf_dir):
    """Pages with enough contents lines, wherever they stand."""
    return toc.listing_pages(toc.toc_lines(pages(spark, sf_dir)))


@query(f"""with {PAGES}, {LINES}, {NPAGES},
f as (select distinct book_id, page_index, lower(trim(regexp_replace(regexp_replace(line, '[0-9]+', '', 'g'), '\\s+', ' ', 'g'))) as header_form from lines where line_no < 5)
select f.book_id, header_form from f join n_pages using (book_id) where length(header_form) >= 8 group by f.book_id, header_form, n_pages having count(*) >= greatest(5, floor(n_pages * 0.2))""")
def running_headers(spark, sf_dir):
    """Lines that head many pages of a book."""
    p = pages(spark, sf_dir)
    return locate.running_headers(toc.top_lines(p, locate.HEADER_LINES), toc.page_counts(p))


@query(f"""with {PAGES}, f as (select book_id, length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 500 as f, length(text) - length(replace(text, chr(10), '')) < 3 as flat from pages_book)
select book_id, count(*) filter (where f) < 0.1 * count(*) or count(*) filter (where f and flat) > 0.5 * count(*) filter (where f) as needs_ocr from f group by book_id""")
def needs_ocr(spark, sf_dir):
    """Books whose text layer is no good."""
    return runs.needs_ocr(pages(spark, sf_dir))


PRINTED = r"""full_lines as (select book_id, page_index, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as l from pages_book),
shown as (select book_id, page_index, l, list_filter(list_concat(l[1:2], l[greatest(len(l) - 1, 1):]), lambda x: regexp_matches(x, '(?i)^([0-9]{1,4}|[ivxlcdm]{1,7})$')) as alone,
  list_filter(l, lambda x: not regexp_matches(lower(x), 'doi\.org|http://|https://|www\.'))[1] as head from full_lines),
numbers as (select book_id, page_index, coalesce(alone[1], case when length(head) < 120 then coalesce(nullif(regexp_extract(head, '(?i)(?:^|\s)(\d{1,4}|[ivxlcdm]{1,7})\s*$', 1), ''), nullif(regexp_extract(head, '(?i)^(\d{1,4}|[ivxlcdm]{1,7})(?:\s|$)', 1), '')) end) as printed from shown),
valued as (select numbers.*, coalesce(try_cast(printed as integer), v) as value, not regexp_matches(printed, '^\d+$') as is_roman from numbers left join romans on lower(printed) = s)"""


@query(f"with {PAGES}, {ROMANS}, {PRINTED} select book_id, page_index, printed, value from valued")
def printed_page_numbers(spark, sf_dir):
    """The number printed on each page, where one can be read."""
    return boundaries.page_numbers(pages(spark, sf_dir)).select("book_id", "page_index", "printed", "value")


@query(f"""with {PAGES}, {ROMANS}, {PRINTED},
a as (select *, case when value is not null then value - page_index end as off from valued),
w as (select book_id, page_index, last_value(off ignore nulls) over b as bo, last_value(case when off is not null then is_roman end ignore nulls) over b as br, first_value(off ignore nulls) over c as co, first_value(case when off is not null then is_roman end ignore nulls) over c as cr from a
  window b as (partition by book_id order by page_index range between 10 preceding and current row), c as (partition by book_id order by page_index range between current row and 10 following))
select book_id, page_index, cast(page_index + bo as varchar) as inferred from w where bo = co and br = cr and not br""")
def page_number_inference(spark, sf_dir):
    """Arabic numbers that a page's neighbours imply."""
    rows = boundaries.infer_printed(boundaries.page_numbers(pages(spark, sf_dir)))
    return rows.filter("inferred is not null and inferred rlike '^[0-9]+$'").select("book_id", "page_index", "inferred")


@query(f"""with {PAGES}, {ROMANS}, {PRINTED}, votes as (select book_id, is_roman, page_index - value as off, count(*) as votes, min(page_index) as f from valued where value is not null group by all)
select book_id, is_roman, off as "offset", votes from (select *, row_number() over (partition by book_id, is_roman order by votes desc, f) as r from votes) where r = 1 and votes >= 5""")
def offset_consensus(spark, sf_dir):
    """Distance of page index and printed number that most pages of a book agree on."""
    return curate.offset_consensus(boundaries.page_numbers(pages(spark, sf_dir)))


def expected(spark, sf_dir) -> DataFrame:
    """The derived ground truth: a chapter every third page from page 2."""
    docs = table(spark, sf_dir, "documents").select(F.expr("doc_id div 25").alias("book_id"), F.expr("cast(doc_id % 25 as int)").alias("k")).filter("k >= 2 and k % 3 = 2")
    end = F.expr("case when book_id % 3 = 0 and k + 2 <= 24 then k + 1 else least(k + 2, 24) end")
    return docs.select("book_id", F.expr("cast((k - 2) div 3 as int)").alias("chapter_no"), F.col("k").alias("pdf_start_index"), end.alias("pdf_end_index")).withColumn("citation_pages", F.expr("concat(pdf_start_index - 1, '-', pdf_end_index - 1)"))


EXPECTED = """expected as (select *, concat(pdf_start_index - 1, '-', pdf_end_index - 1) as citation_pages from (select doc_id // 25 as book_id, cast((doc_id % 25 - 2) // 3 as integer) as chapter_no, cast(doc_id % 25 as integer) as pdf_start_index,
  cast(case when (doc_id // 25) % 3 = 0 and doc_id % 25 + 2 <= 24 then doc_id % 25 + 1 else least(doc_id % 25 + 2, 24) end as integer) as pdf_end_index from documents where doc_id % 25 >= 2 and (doc_id % 25) % 3 = 2))"""
STRATEGIES = {"heuristic": "(book_id + chapter_no) % 5 <> 0", "outline": "book_id % 2 = 1", "llm": "(book_id + chapter_no) % 3 <> 0"}
_MOVED = "cast(case when (3 * book_id + chapter_no) % 7 = 0 then least(pdf_end_index + 1, 24) else pdf_end_index end as int)"
FOUND = "found as (" + " union all ".join(f"select '{s}' as strategy, book_id, chapter_no, pdf_start_index, {_MOVED} as pdf_end_index, citation_pages from expected where {c}" for s, c in STRATEGIES.items()) + ")"


def found(spark, sf_dir) -> DataFrame:
    """Chapters that three strategies are taken to have found, with some ends one page late."""
    rows = expected(spark, sf_dir)
    out = None
    for name, condition in STRATEGIES.items():
        some = rows.filter(condition).select(F.lit(name).alias("strategy"), "book_id", "chapter_no", "pdf_start_index", F.expr(_MOVED).alias("pdf_end_index"), "citation_pages")
        out = some if out is None else out.unionByName(some)
    return out


SCORED = f"""{EXPECTED}, {FOUND}, hits as (select strategy, f.book_id, count(distinct (f.pdf_start_index, f.pdf_end_index)) as found, count(distinct case when e.book_id is not null then (f.pdf_start_index, f.pdf_end_index) end) as tp from found f left join expected e using (book_id, pdf_start_index, pdf_end_index) group by all),
per_book as (select strategy, hits.book_id, tp, found, count(distinct (e.pdf_start_index, e.pdf_end_index)) as expected from hits left join expected e on e.book_id = hits.book_id group by all)"""
RATES = "case when found > 0 then tp / found else 0 end as precision, case when expected > 0 then tp / expected else 0 end as recall, case when tp > 0 then 2 * tp / (found + expected) else 0 end as f1"


@query(f"with {SCORED} select *, {RATES} from per_book")
def precision_recall(spark, sf_dir):
    """Boundary scores of each strategy and book."""
    return evaluate.boundary_metrics(expected(spark, sf_dir), found(spark, sf_dir))


@query(f"with {SCORED}, p as (select strategy, sum(tp) as tp, sum(found) as found, sum(expected) as expected from per_book group by strategy), r as (select *, {RATES} from p) select *, row_number() over (order by f1 desc, strategy) as rank, f1 = max(f1) over () and max(f1) over () > 0 as is_best from r")
def strategy_ranking(spark, sf_dir):
    """Pooled scores of the strategies, ranked."""
    return evaluate.rank_strategies(evaluate.micro_metrics(evaluate.boundary_metrics(expected(spark, sf_dir), found(spark, sf_dir)), "strategy"))


@query(f"with {SCORED}, p as (select coalesce(c, 'TOTAL') as corpus, sum(tp) as tp, sum(found) as found, sum(expected) as expected from (select *, concat('corpus', cast(book_id % 4 as varchar)) as c from per_book) group by rollup (c)) select *, {RATES} from p")
def micro_rollup(spark, sf_dir):
    """Pooled scores of each corpus and of all."""
    rows = evaluate.boundary_metrics(expected(spark, sf_dir), found(spark, sf_dir))
    return evaluate.micro_rollup(rows.withColumn("corpus", F.expr("concat('corpus', book_id % 4)")))


APPLIED = "applied as (select distinct strategy, doc_id // 25 as book_id from documents, (values ('heuristic'), ('outline'), ('llm')) as v(strategy) where strategy <> 'outline' or (doc_id // 25) % 4 = 1)"


@query(f"""with {SCORED}, {APPLIED}, want as (select book_id, count(*) as expected from expected group by book_id), d as (select a.strategy, a.book_id, coalesce(p.tp, 0) as tp, coalesce(p.found, 0) as found, coalesce(w.expected, 0) as expected, (a.book_id * 3) % 7 + 0.5 as s, concat('2026-0', 1 + a.book_id % 9, '-01') as date
  from applied a left join want w on w.book_id = a.book_id left join per_book p on p.strategy = a.strategy and p.book_id = a.book_id),
p as (select strategy, count(*) as n_books, sum(tp) as tp, sum(found) as found, sum(expected) as expected, sum(s) as elapsed_seconds, max(date) as date from d group by strategy), r as (select *, {RATES} from p),
c as (select strategy, count(*) as pairs from found join expected using (book_id, pdf_start_index, pdf_end_index) semi join applied using (strategy, book_id) group by strategy)
select r.*, row_number() over (order by f1 desc, r.strategy) as rank, f1 = max(f1) over () and max(f1) over () > 0 as is_best, pairs from r left join c using (strategy)""")
def strategy_report(spark, sf_dir):
    """Pooled scores, times and dates of the strategies over the books that each could be tried on."""
    names = F.when(F.expr("book_id % 4 = 1"), F.array(*map(F.lit, STRATEGIES))).otherwise(F.array(F.lit("heuristic"), F.lit("llm")))
    applied = table(spark, sf_dir, "documents").select(F.expr("doc_id div 25").alias("book_id")).distinct().select(F.explode(names).alias("strategy"), "book_id")
    timed = applied.withColumn("elapsed_seconds", F.expr("(book_id * 3) % 7 + 0.5D")).withColumn("date", F.expr("concat('2026-0', 1 + book_id % 9, '-01')"))
    report = evaluate.strategy_report(expected(spark, sf_dir), found(spark, sf_dir), timed, applied)[1]
    return report.drop("covered", "start_ok", "end_ok", "coverage", "start_accuracy", "end_accuracy")


CITED = f"""{EXPECTED}, {FOUND}, c as (select strategy, book_id, (book_id + 2 * found.chapter_no) % 6 <> 0 as given, (3 * book_id + found.chapter_no) % 4 <> 1 as start_right, 2 * ((book_id + found.chapter_no) % 5) <= 3 as end_right
  from found join expected using (book_id, pdf_start_index, pdf_end_index)), p as (select strategy, book_id, count(*) as pairs, count(*) filter (where given) as covered, count(*) filter (where given and start_right) as start_ok, count(*) filter (where given and end_right) as end_ok from c group by all)"""


@query(f"with {CITED} select *, covered / pairs as coverage, case when covered > 0 then start_ok / covered else 0 end as start_accuracy, case when covered > 0 then end_ok / covered else 0 end as end_accuracy from p")
def citation_accuracy(spark, sf_dir):
    """How many printed ranges of rightly found chapters are there and right; some starts are one late, ends up to eight."""
    start = F.expr("pdf_start_index - 1 + if((3 * book_id + chapter_no) % 4 = 1, 1, 0)")
    end = F.expr("pdf_end_index - 1 + 2 * ((book_id + chapter_no) % 5)")
    shown = F.when(F.expr("(book_id + 2 * chapter_no) % 6 <> 0"), F.concat(start.cast("string"), F.lit("-"), end.cast("string")))
    return evaluate.citation_metrics(evaluate.citation_pairs(expected(spark, sf_dir), found(spark, sf_dir).withColumn("citation_pages", shown)))


@query(f"""with {EXPECTED}, {FOUND}, s as (select *, lead(pdf_start_index) over (partition by book_id order by pdf_start_index, pdf_end_index) as next from found where strategy = 'heuristic')
select book_id, chapter_no, 'overlaps next' as error from s where pdf_end_index >= next union all select book_id, chapter_no, 'end past last page' from s where pdf_end_index >= 24""")
def bounds_errors(spark, sf_dir):
    """Found ranges that overlap or pass the 24th page."""
    rows = found(spark, sf_dir).filter("strategy = 'heuristic'")
    return evaluate.bounds_errors(rows, rows.select("book_id").distinct().withColumn("n_pages", F.lit(24)))


@query(f"""with {EXPECTED}, {FOUND}, a as (select distinct book_id, pdf_start_index, pdf_end_index from expected), b as (select distinct book_id, pdf_start_index, pdf_end_index from found where strategy = 'llm')
select 'left' as side, book_id, pdf_start_index as start, pdf_end_index as "end" from (select * from a except select * from b) union all select 'right', book_id, pdf_start_index, pdf_end_index from (select * from b except select * from a)""")
def boundary_parity(spark, sf_dir):
    """Ranges that only one of two versions has."""
    return redact.boundary_diff(expected(spark, sf_dir), found(spark, sf_dir).filter("strategy = 'llm'"))


@query(f"""with {EXPECTED}, n as (select book_id, chapter_no, pdf_start_index as start, coalesce(lead(pdf_start_index) over (partition by book_id order by pdf_start_index) - 1, 24) as "end" from expected)
select * from n""")
def chapter_ranges(spark, sf_dir):
    """Ends of chapters from the next one's start."""
    rows = expected(spark, sf_dir).select("book_id", F.col("chapter_no").alias("entry_no"), F.lit("Of trees").alias("title"), F.lit(None).cast("string").alias("printed"), F.lit(False).alias("is_roman"), F.col("pdf_start_index").alias("page_index"))
    ends = boundaries.chapter_ends(rows, rows.select("book_id").distinct().withColumn("n_pages", F.lit(25)))
    return ends.select("book_id", F.col("entry_no").alias("chapter_no"), "start", "end")


@query("select l_orderkey, l_linenumber, round_even(0.5 + 0.5 * (0.4 * (s - 80.0) / 20.0 + 0.6 * least(m / 20.0, 1.0)), 2) as confidence from (select l_orderkey, l_linenumber, 80.37 + cast(l_quantity % 19 as double) as s, 8.1 + cast(l_linenumber * 3 as double) as m from lineitem)")
def match_confidence(spark, sf_dir):
    """Confidence from score and margin."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.lit(80.37) + (F.col("l_quantity") % 19).cast("double")).alias("s"), (F.lit(8.1) + (F.col("l_linenumber") * 3).cast("double")).alias("m"))
    return rows.select("l_orderkey", "l_linenumber", boundaries.match_confidence(F.col("s"), F.col("m")).alias("confidence"))


RUNS = "runs as (select user_id % 20 as book_id, event_type as model_id, value as elapsed_seconds, ts as generated_at, event_id as run_id from events)"


def all_runs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("book_id"), F.col("event_type").alias("model_id"), F.col("value").alias("elapsed_seconds"), F.col("ts").alias("generated_at"), F.col("event_id").alias("run_id"))


@query(f"with {RUNS} select book_id, model_id, run_id from (select *, row_number() over (partition by book_id, model_id order by generated_at desc, run_id desc) as r from runs) where r = 1")
def llm_upsert(spark, sf_dir):
    """The latest run of each book and model, from two loads."""
    rows = all_runs(spark, sf_dir)
    return runs.upsert_runs(rows.filter("run_id % 2 = 0"), rows.filter("run_id % 2 = 1")).select("book_id", "model_id", "run_id")


@query(f"with {RUNS} select model_id from runs group by model_id having count(distinct book_id) = (select count(distinct book_id) from runs)")
def model_coverage(spark, sf_dir):
    """Models with a run for every book."""
    rows = all_runs(spark, sf_dir)
    return runs.covered_models(rows, rows.select("book_id").distinct())


@query(f"with {RUNS} select model_id, max(strftime(generated_at, '%Y-%m-%d')) as date from runs group by model_id")
def latest_run_dates(spark, sf_dir):
    """The day of each model's last run."""
    return runs.latest_run_date(all_runs(spark, sf_dir))


@query(f"""with {RUNS}, m as (select concat('corpus', cast(book_id % 4 as varchar)) as corpus, model_id, sum(elapsed_seconds) as s, count(*) % 7 as f1 from runs group by all)
select corpus, model_id from (select *, row_number() over (partition by corpus order by f1 desc, s, model_id) as r from m) where r = 1""")
def best_model(spark, sf_dir):
    """The best model of each corpus, the quicker on ties."""
    rows = all_runs(spark, sf_dir).groupBy(F.expr("concat('corpus', book_id % 4)").alias("corpus"), "model_id").agg(F.sum("elapsed_seconds").alias("elapsed_seconds"), (F.count(F.lit(1)) % 7).alias("f1"))
    return runs.best_model(rows)


@query("""with m as (select p_brand as model_id, min(p_size) % 9 as demand from part group by p_brand), c as (select p_brand as model_id from part group by p_brand having count(*) % 2 = 0)
select * from m where demand <= 5 and model_id not in (select model_id from c) order by demand, model_id limit 5""")
def gap_fill_models(spark, sf_dir):
    """The least loaded models among those that do not cover everything yet."""
    part = table(spark, sf_dir, "part")
    models = part.groupBy(F.col("p_brand").alias("model_id")).agg((F.min("p_size") % 9).alias("demand"))
    return runs.gap_fill(models, part.groupBy(F.col("p_brand").alias("model_id")).count().filter("count % 2 = 0").select("model_id"))


@query("select o_orderkey as book_id from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linenumber = 3)")
def incremental_worklist(spark, sf_dir):
    """Books without a result of their version and mode."""
    books = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("book_id"), F.lit(3).alias("version"), F.lit("plain").alias("mode"))
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").cast("int").alias("version"), F.lit("plain").alias("mode"))
    return runs.worklist(books, done).select("book_id")


@query("""with a as (select l_partkey as book_id, l_suppkey, count(distinct (l_orderkey, l_linenumber)) as n from lineitem group by all), b as (select book_id, count(*) as n_authors, max(n) as top from a group by book_id), t as (select l_partkey as book_id, count(distinct (l_orderkey, l_linenumber)) as c from lineitem group by 1)
select book_id, n_authors, top / c as max_share, n_authors >= 3 and top / c <= 0.5 as ok from b join t using (book_id)""")
def author_diversity(spark, sf_dir):
    """Books by enough different authors."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("book_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("chapter"), F.col("l_suppkey").alias("author"))
    return curate.author_diversity(rows)


LICENSE = "(MIT License|Apache License|GNU General Public License|CC BY[A-Z-]*)"


@query(f"""with v as (select source, doc_id, regexp_extract(text, '{LICENSE}', 1) as license from documents), c as (select source, license, count(*) as n, min(doc_id) as f from v where license <> '' group by all)
select source, license from (select *, row_number() over (partition by source order by n desc, f) as r from c) where r = 1""")
def license_vote(spark, sf_dir):
    """The license most documents of a source name."""
    found_license = F.regexp_extract("text", LICENSE, 1)
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.when(found_license != "", found_license).alias("license"))
    return curate.majority(rows, "source", "license", "doc_id")


@query("""with c as (select lang as language, count(*) as n from documents group by lang), p as (select *, row_number() over (order by n, language) as rank from c)
select doc_id, language, rank from (select doc_id, lang as language, rank, row_number() over (partition by lang order by doc_id) as k from documents join p on lang = language) where k <= 5""")
def language_quota(spark, sf_dir):
    """The first works of each language, rarest language first."""
    works = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("language"), F.col("doc_id").alias("arrival"))
    priority = curate.language_priority(works.select("language"), works.select("language").distinct())
    return curate.language_quota(works, priority).select("doc_id", "language", "rank")


@query("""with w as (select l_orderkey * 10 + l_linenumber as arrival, cast(l_partkey as varchar) as isbn, case when l_linenumber % 2 = 0 then cast(l_suppkey as varchar) end as doi from lineitem), k as (select cast(p_partkey as varchar) as isbn, case when p_size % 50 = 0 then cast(p_partkey % 100 as varchar) end as doi from part where p_size < 20),
f as (select * from w where isbn not in (select isbn from k) and (doi is null or doi not in (select doi from k where doi is not null)))
select isbn, arrival from (select *, row_number() over (partition by isbn order by arrival) as r from f) where r = 1""")
def new_candidates(spark, sf_dir):
    """Works that are known by neither number, once each."""
    works = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("arrival"), F.col("l_partkey").cast("string").alias("isbn"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey").cast("string")).alias("doi"))
    known = table(spark, sf_dir, "part").filter("p_size < 20").select(F.col("p_partkey").cast("string").alias("isbn"), F.when(F.col("p_size") % 50 == 0, (F.col("p_partkey") % 100).cast("string")).alias("doi"))
    return curate.new_candidates(works, known).select("isbn", "arrival")


@query("""select corpus, book_id, case when r <= case corpus when 'src0' then 3 when 'src1' then 5 else 0 end then 'eval' else 'train' end as split from
(select source as corpus, doc_id as book_id, row_number() over (partition by source order by sha256(concat('42:', cast(doc_id as varchar))), doc_id) as r from documents)""")
def stratified_split(spark, sf_dir):
    """An exact number of evaluation books of each corpus."""
    books = table(spark, sf_dir, "documents").select(F.col("source").alias("corpus"), F.col("doc_id").alias("book_id"))
    return curate.stratified_split(books, {"src0": 3, "src1": 5})


SCORES = "scores as (select doc_id // 25 as book_id, doc_id % 25 as page_index, (doc_id * 37 % 101) / 101.0 as p, doc_id % 25 % 3 = 2 as is_positive, case when doc_id % 2 = 0 then 'toc' else 'chapter_first' end as label, doc_id from documents)"


def scores(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.expr("doc_id div 25").alias("book_id"), F.expr("doc_id % 25").alias("page_index"), (F.col("doc_id") * 37 % 101 / 101.0).alias("p"), F.expr("doc_id % 25 % 3 = 2").alias("is_positive"), F.expr("case when doc_id % 2 = 0 then 'toc' else 'chapter_first' end").alias("label"), "doc_id")


@query(f"with {SCORES} select book_id, page_index from (select *, row_number() over (partition by book_id order by p desc, page_index) as k, count(*) over (partition by book_id) as n from scores) where k <= greatest(1, floor(n * 0.15))")
def candidate_budget(spark, sf_dir):
    """A book's best pages within its budget."""
    return curate.candidate_budget(scores(spark, sf_dir))


@query(f"with {SCORES}, q as (select label, p, row_number() over (partition by label order by p desc, doc_id) as k, count(*) over (partition by label) as n from scores where is_positive) select label, p as threshold from q where k = ceil(n * 0.95)")
def recall_threshold(spark, sf_dir):
    """The greatest probability that reaches a recall."""
    return curate.recall_threshold(scores(spark, sf_dir).drop("page_index").withColumnRenamed("doc_id", "page_index"), 0.95)


LAYOUT = """layout as (select l_orderkey // 200 as book_id, l_orderkey % 200 as page_index, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 as line_no, cast(50 + (7 * l_linenumber) % 30 as double) as hpos, cast(40 + 14 * l_linenumber as double) as vpos,
  cast(l_quantity * 5 as double) as width, cast(case when l_linenumber = 1 and l_partkey % 3 = 0 then 18 else 10 end as double) as font, concat('line ', cast(l_suppkey as varchar)) as content from lineitem)"""


def layout_lines(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    number = F.expr("row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) - 1")
    return rows.select(
        F.expr("l_orderkey div 200").alias("book_id"), (F.col("l_orderkey") % 200).alias("page_index"), number.alias("line_no"), (50 + (7 * F.col("l_linenumber")) % 30).cast("double").alias("hpos"), (40 + 14 * F.col("l_linenumber")).cast("double").alias("vpos"),
        (F.col("l_quantity") * 5).cast("double").alias("width"), F.expr("cast(case when l_linenumber = 1 and l_partkey % 3 = 0 then 18 else 10 end as double)").alias("font"), F.concat(F.lit("line "), F.col("l_suppkey").cast("string")).alias("content"), F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"),
    )


FEATURES = f"""{LAYOUT}, fonts as (select book_id, page_index, font as modal_font from (select *, row_number() over (partition by book_id, page_index order by n desc, f) as r from (select book_id, page_index, font, count(*) as n, min(line_no) as f from layout group by all)) where r = 1),
feats as (select book_id, page_index, count(*) as line_count, avg(width / 600) as width_mean, coalesce(var_samp(width / 600), 0) as width_var, max(font) as max_font, arg_min(vpos / 800, line_no) as first_top, arg_max(vpos / 800, line_no) as last_top, avg(cast(regexp_matches(content, ' [0-9]{{1,4}}$') as integer)) as number_share from layout group by all),
features as (select *, max_font / modal_font as font_ratio from feats join fonts using (book_id, page_index))"""
FEATURE_NAMES = ["book_id", "page_index", "line_count", "width_mean", "width_var", "max_font", "first_top", "last_top", "number_share", "modal_font", "font_ratio"]


def _rounded(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*(F.round(n, 9).alias(n) if t == "double" else F.col(n) for n in names for m, t in df.dtypes if m == n))


@query(f"with {FEATURES} select book_id, page_index, line_count, round(width_mean, 9) as width_mean, round(width_var, 9) as width_var, max_font, round(first_top, 9) as first_top, round(last_top, 9) as last_top, round(number_share, 9) as number_share, modal_font, round(font_ratio, 9) as font_ratio from features")
def page_features(spark, sf_dir):
    """Layout features of every page."""
    return _rounded(layout.page_features(layout_lines(spark, sf_dir)), FEATURE_NAMES)


@query(f"""with {FEATURES}, c as (select book_id, page_index, case when lag(page_index) over w = page_index - 1 then lag(line_count) over w else 0 end as previous_lines, median(line_count) over (partition by book_id) as median_lines, count(*) over (partition by book_id) as n_pages from features window w as (partition by book_id order by page_index))
select book_id, page_index, previous_lines, median_lines, least(page_index, n_pages - 1 - page_index) as edge_distance from c""")
def context_features(spark, sf_dir):
    """Features of a page's neighbours and its book."""
    rows = layout.page_features(layout_lines(spark, sf_dir))
    return layout.context_features(rows, rows.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_pages"))).select("book_id", "page_index", "previous_lines", "median_lines", "edge_distance")


@query(f"with {FEATURES} select count(font_ratio) as n, min(font_ratio) as min, max(font_ratio) as max, round(avg(font_ratio), 9) as mean, median(font_ratio) as median, round(stddev_samp(font_ratio), 9) as stdev from features")
def noise_summary(spark, sf_dir):
    """Contrast of title and body fonts over all pages."""
    return _rounded(layout.noise_summary(layout.contrast_ratios(layout_lines(spark, sf_dir))), ["n", "min", "max", "mean", "median", "stdev"])


@query(f"""with {EXPECTED}, p as (select doc_id // 25 as book_id, cast(doc_id % 25 as integer) as page_index from documents)
select p.book_id, p.page_index, case when e.book_id is not null then 'chapter_first' when p.page_index between 1 and 1 then 'toc' else 'other' end as label from p left join expected e on e.book_id = p.book_id and e.pdf_start_index = p.page_index where p.book_id % 5 <> 0""")
def page_labels(spark, sf_dir):
    """Labels of pages for training a classifier."""
    rows = table(spark, sf_dir, "documents").select(F.expr("doc_id div 25").alias("book_id"), F.expr("cast(doc_id % 25 as int)").alias("page_index"))
    contents = rows.select("book_id").distinct().select("book_id", F.expr("book_id % 5 <> 0").alias("has_toc_field"), F.lit(1).alias("toc_start"), F.lit(1).alias("toc_end"))
    return layout.page_labels(rows, expected(spark, sf_dir), contents)


@query("""with e as (select vec_id, embedding as v from embeddings where label < 3), c as (select vec_id, embedding as v from embeddings where label >= 3), d as (select c.vec_id as id, min(list_distance(cast(c.v as double[]), cast(e.v as double[]))) as distance from c, e group by all)
select id, round(distance, 6) as distance from d""")
def nn_novelty(spark, sf_dir):
    """Distance of each new page to the nearest accepted one."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    near = curate.nn_distance(rows.filter("label >= 3").drop("label"), rows.filter("label < 3").drop("label"))
    return near.select("id", F.round("distance", 6).alias("distance"))


@query("""with w as (select distinct lang, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) as word from documents) select lang, length(word) as length, count(*) as n, min(word) as first from w where word <> '' group by all""")
def word_pool(spark, sf_dir):
    """Sizes of the pools of replacement words."""
    return redact.word_pool(table(spark, sf_dir, "documents")).select("lang", "length", F.size("words").cast("long").alias("n"), F.get("words", F.lit(0)).alias("first"))


@query()
def segment_corpus(spark, sf_dir):
    """Chapters of every derived book from its contents, on uncut texts."""
    return segment.segment(fixture.stored_pages(spark, sf_dir))[0]


def _outline(spark, sf_dir) -> DataFrame:
    rows = expected(spark, sf_dir).filter("book_id % 2 = 1")
    return rows.select("book_id", F.col("chapter_no").alias("cand_no"), F.expr("concat('Study of matters ', chapter_no)").alias("title"), F.array().cast("array<string>").alias("authors"), F.expr("pdf_start_index - 1").alias("printed_page_number"), F.col("pdf_start_index").alias("pdf_page_index"), F.lit(None).cast("string").alias("chapter_doi"), F.lit("outline").alias("source"), F.lit(1.0).alias("metadata_confidence"))


@query()
def outline_chapters(spark, sf_dir):
    """Chapters straight from outlines."""
    n_pages, _, heads, numbers = segment.page_facts(fixture.stored_pages(spark, sf_dir, ascii_only=True))
    return evidence.segment_outline(numbers, n_pages, heads, _outline(spark, sf_dir))


@query()
def fuzzy_alignment(spark, sf_dir):
    """Titles of two lists of each book matched in order."""
    rows = _outline(spark, sf_dir)
    return evidence.align(rows, rows.filter("cand_no <> 3").withColumn("title", F.concat(F.col("title"), F.lit(" revised"))))


@query(f"""with {TEXT_CTES}, {LISTED}, listings as (select distinct book_id, page_index from valid join first using (book_id, page_index) where value <= 2 * n_pages and length(title) >= 3),
shown as (select distinct book_id, unnest([page_index - 1, page_index, page_index + 1]) as page_index from listings union
  select book_id, page_index from pages_book join n_pages using (book_id) where book_id not in (select book_id from listings) and (page_index < greatest(1, floor(n_pages * 0.15)) or page_index >= n_pages - greatest(1, floor(n_pages * 0.05))))
select book_id, string_agg(concat('[PAGE ', cast(page_index as varchar), ']', chr(10), text), concat(chr(10), chr(10)) order by page_index) as prompt from pages_book join shown using (book_id, page_index) group by book_id""")
def prompt_table(spark, sf_dir):
    """What a model outside is shown of each book."""
    p = pages(spark, sf_dir)
    return toc.prompt_table(p, toc.toc_entries(p))


@query("""select doc_id, case doc_id % 4 when 0 then concat('978', lpad(cast(doc_id as varchar), 10, '0')) when 1 then concat(lpad(cast(doc_id as varchar), 9, '0'), 'X') when 2 then concat('979', lpad(cast(doc_id as varchar), 10, '0')) end as isbn from documents""")
def isbn_normalize(spark, sf_dir):
    """The first long, else the first short number of book number fields written in several ways."""
    nine, ten = F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lpad(F.col("doc_id").cast("string"), 10, "0")
    raw = (
        F.when(F.expr("doc_id % 4 = 0"), F.concat(nine, F.lit("1; 978-"), ten)).when(F.expr("doc_id % 4 = 1"), F.concat(F.lit("12345 "), nine, F.lit("x")))
        .when(F.expr("doc_id % 4 = 2"), F.concat(F.lit("979"), ten, F.lit(" 9780000000000"))).otherwise(F.lit("none; 123"))
    )
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_isbn(raw).alias("isbn"))
