"""Whole jobs over the derived corpus: stored answers, merged evidence, classifiers, and redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators import answers, classify, evidence, layout, locate, redact, regions, segment, toc
from folio.operators.tables import apart, stored
from folio.plans import fixture
from folio.plans.queries import LINES, NPAGES, PAGES, ROMANS, expected, query, table

#: One answer's item for a chapter, in the forms that models write: the same text in both engines.
_ITEM = """case cast((book_id * 3 + k) % 8 as int)
 when 0 then concat('{"title": "', title, '", "authors": ["Ann Author", " Bo Writer "], "printed_page_number": "', n, '"}')
 when 1 then concat('{"title": "  ', title, ' ", "authors": [], "printed_page_number": ', n, '}')
 when 2 then concat('{"title": "', title, '", "printed_page_number": null}')
 when 3 then concat('{"title": "', title, '", "authors": ["A B"], "printed_page_number": "vii"}')
 when 4 then concat('{"title": "', title, '", "authors": "Jane Doe", "printed_page_number": ', n, '.0}')
 when 5 then concat('"note", {"title": "Hi", "authors": [], "printed_page_number": ', n, '}, {"title": "', title, '", "authors": [""], "printed_page_number": "R', n, '"}')
 when 6 then concat('{"title": "', title, '", "authors": [], "printed_page_number": -1}, 12, [1]')
 else concat('{"title": "', title, '", "authors": ["A", 7, "B"], "printed_page_number": "', n, '"}') end"""
_FENCE = "```"
_ANSWER = f"""case when book_id % 7 = 0 then concat('{_FENCE}json', chr(10), body, chr(10), '{_FENCE}') when book_id % 11 = 5 then substr(body, 1, length(body) - 1)
 when book_id % 13 = 6 then concat('Here is the list: ', body, ' I hope that this helps.') else body end"""


def responses(spark, sf_dir, ascii_only: bool = False) -> DataFrame:
    """(book_id, response): stored answers about every derived book; some are fenced, cut off or wrapped in prose."""
    items = fixture.book_titles(spark, sf_dir, ascii_only).withColumn("n", F.expr("cast(k - 1 as string)")).select("book_id", "k", F.expr(_ITEM).alias("item"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("k", "item"))), lambda x: x["item"])
    bodies = items.groupBy("book_id").agg(F.concat(F.lit("["), F.array_join(listed, ", "), F.lit("]")).alias("body"))
    return bodies.select("book_id", F.expr(_ANSWER).alias("response"))


RESPONSES = f"""titles as (select * from {fixture.book_titles_sql()}), items as (select book_id, k, {_ITEM} as item from (select *, cast(k - 1 as varchar) as n from titles)),
responses as (select book_id, {_ANSWER} as response from (select book_id, concat('[', string_agg(item, ', ' order by k), ']') as body from items group by book_id))"""


@query(rf"""with {ROMANS}, {RESPONSES}, j as (select book_id, regexp_extract(response, '(?s)\[.*\]', 0) as j from responses), v as (select * from j where json_valid(j)),
x as (select book_id, i, json_extract(j, concat('$[', i, ']')) as item from v, unnest(range(cast(json_array_length(j) as bigint))) as u(i)),
e as (select book_id, i, trim(json_extract_string(item, '$.title')) as title, json_type(item, '$.printed_page_number') as kind, trim(json_extract_string(item, '$.printed_page_number')) as raw,
  case when json_type(item, '$.authors') = 'ARRAY' then list_filter(list_transform(from_json(json_extract(item, '$.authors'), '["VARCHAR"]'), lambda a: trim(a)), lambda a: a <> '') else [] end as authors from x where json_type(item) = 'OBJECT'),
p as (select *, case when kind = 'VARCHAR' then case when raw <> '' and lower(raw) <> 'null' then raw end when kind in ('UBIGINT', 'BIGINT', 'DOUBLE') and cast(cast(raw as double) as bigint) <> -1 then cast(cast(cast(raw as double) as bigint) as varchar) end as printed from e where length(title) >= 3)
select book_id, row_number() over (partition by book_id order by i) - 1 as entry_no, title, printed, coalesce(try_cast(printed as integer), v) as value, coalesce(v is not null and not regexp_matches(printed, '^\d+$'), false) as is_roman, array_to_string(authors, '|') as authors
from p left join romans on lower(printed) = s""")
def response_entries(spark, sf_dir):
    """Contents entries read from stored answers."""
    rows = answers.response_entries(responses(spark, sf_dir, ascii_only=True))
    return rows.select("book_id", "entry_no", "title", "printed", "value", "is_roman", F.array_join("authors", "|").alias("authors"))


def choices(spark, sf_dir) -> DataFrame:
    """(book_id, entry_no, response): stored choices between candidates: the first, the second, none, one that was not shown."""
    books = table(spark, sf_dir, "documents").select(F.expr("doc_id div 25").alias("book_id")).distinct()
    rows = books.select("book_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("entry_no"))
    said = F.when(F.expr("entry_no % 4 = 0"), '{"chosen_candidate": 1}').when(F.expr("entry_no % 4 = 1"), 'I take {"chosen_candidate": 2}').when(F.expr("entry_no % 4 = 2"), '{"chosen_candidate": null}').otherwise('{"chosen_candidate": 9}')
    return rows.withColumn("response", said)


@query()
def segment_llm_rows(spark, sf_dir):
    """Chapters of every derived book from stored answers alone, on uncut texts."""
    return answers.segment_answers(fixture.stored_pages(spark, sf_dir), responses(spark, sf_dir), choices(spark, sf_dir))[0]


@query()
def segment_fallback(spark, sf_dir):
    """Chapters from printed contents, and from stored answers in the fourth of all books whose contents pages have lost their numbers."""
    lost = F.regexp_replace("text", r" \.+ \d+", "")
    p = fixture.stored_pages(spark, sf_dir).withColumn("text", F.when(F.expr("book_id % 4 = 1 and page_index = 1"), lost).otherwise(F.col("text")))
    return answers.segment_with_fallback(p, responses(spark, sf_dir), choices(spark, sf_dir))[0]


def _evidence(rows: DataFrame, source: str, confidence: float, page, index) -> DataFrame:
    authors = F.when(F.expr("k % 2 = 0"), F.array(F.concat(F.lit("Ann Author"), F.col("k").cast("string")))).otherwise(F.array().cast("array<string>"))
    doi = F.concat(F.lit("10.1/"), F.col("book_id").cast("string"), F.lit("."), F.col("k").cast("string"))
    return rows.select(
        "book_id", F.expr("cast((k - 2) div 3 as int)").alias("cand_no"), "title", authors.alias("authors"), page.cast("int").alias("printed_page_number"), index.cast("int").alias("pdf_page_index"),
        (F.lit(None).cast("string") if source == "outline" else doi).alias("chapter_doi"), F.lit(source).alias("source"), F.lit(confidence).alias("metadata_confidence"),
    )


def all_evidence(spark, sf_dir) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(books, outline, metadata sources): outlines of every third book with every second chapter, records and catalog rows of others."""
    titles = fixture.book_titles(spark, sf_dir)
    books = titles.select("book_id", F.concat(F.lit("Book "), F.col("book_id").cast("string")).alias("title")).distinct()
    outline = _evidence(titles.filter("book_id % 3 = 0 and ((k - 2) div 3) % 2 = 0"), "outline", 1.0, F.lit(None), F.col("k"))
    records = _evidence(titles.filter("book_id % 3 <> 2"), "crossref", 0.9, F.col("k") - 1, F.lit(None))
    catalog = _evidence(titles.filter("book_id % 4 = 0").withColumn("title", F.upper("title")), "catalog", 0.8, F.col("k") - 1, F.lit(None))
    own = _evidence(books.withColumn("k", F.lit(2)), "crossref", 0.9, F.lit(None), F.lit(None)).withColumn("cand_no", F.lit(99))
    return books, outline, [records.unionByName(own.join(apart(records.select("book_id").distinct()), "book_id", "left_semi")), catalog]


@query()
def segment_evidence(spark, sf_dir):
    """Chapters from merged outline, record and catalog rows; books without any from their contents, on uncut texts."""
    return evidence.segment_evidence(fixture.stored_pages(spark, sf_dir), *all_evidence(spark, sf_dir))


def book_layout(spark, sf_dir, ascii_only: bool = False) -> DataFrame:
    """Layout lines of the derived corpus: widths follow the text, and most chapters open with a larger line."""
    lines = toc.explode_lines(fixture.book_pages(spark, sf_dir, ascii_only, annexes=False).filter(F.col("book_id") < fixture.ANNEX))
    large = F.expr("line_no = 0 and page_index >= 2 and page_index % 3 = 2 and (book_id * 7 + page_index) % 5 <> 0 or (book_id + page_index * 3 + line_no) % 97 = 0")
    return lines.select(
        "book_id", "page_index", "line_no", F.col("line").alias("content"), (50 + (7 * F.col("line_no")) % 30).cast("double").alias("hpos"), (40 + 14 * F.col("line_no")).cast("double").alias("vpos"),
        F.least(F.lit(500.0), 5.0 * F.length("line")).alias("width"), F.lit(12.0).alias("height"), F.when(large, 18.0).otherwise(10.0).alias("font"), F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"),
    )


def training_rows(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(feature rows of all labelled pages whose layout could be read, labels of all pages)."""
    all_pages = fixture.book_pages(spark, sf_dir, annexes=False).filter(F.col("book_id") < fixture.ANNEX).select("book_id", "page_index")
    contents = all_pages.select("book_id").distinct().select("book_id", F.expr("book_id % 9 <> 4").alias("has_toc_field"), F.lit(1).alias("toc_start"), F.lit(1).alias("toc_end"))
    labels = stored(layout.page_labels(all_pages, expected(spark, sf_dir), contents))
    n_pages = all_pages.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_pages"))
    # the fits read these rows many times: they are dealt evenly, a share for each task
    rows = classify.feature_table(book_layout(spark, sf_dir), labels, n_pages)
    return stored(rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "book_id", "page_index")), labels


@query()
def lobo_budget(spark, sf_dir):
    """What a budget of pages recalls of each book, ranked by classifiers that never saw it."""
    rows, labels = training_rows(spark, sf_dir)
    return classify.lobo_budget(rows, labels)


@query()
def lobo_threshold(spark, sf_dir):
    """What thresholds set on other books recall of each book."""
    rows, labels = training_rows(spark, sf_dir)
    return classify.lobo_threshold(rows, labels)


def languages(spark, sf_dir) -> DataFrame:
    """(book_id, lang) of derived books and their annexes."""
    docs = table(spark, sf_dir, "documents").filter("doc_id % 25 = 2").select(F.expr("doc_id div 25").alias("book_id"), "lang")
    return docs.unionByName(docs.withColumn("book_id", F.col("book_id") + fixture.ANNEX))


_LANGS = f"langs as (select doc_id // 25 + u.a as book_id, lang from documents, (values (0), ({fixture.ANNEX})) as u(a) where doc_id % 25 = 2)"
_FORM = "lower(trim(regexp_replace(regexp_replace(line, '[0-9]+', '', 'g'), '\\s+', ' ', 'g')))"
REDACTED = rf"""{PAGES}, {LINES}, {NPAGES}, {_LANGS},
counted as (select lang, word, length(word) as len, count(*) as n from (select lang, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) as word from documents) where length(word) between 1 and {regions.POOL_LENGTH} group by all),
pool as (select lang, len, list(word order by r) as words from (select *, row_number() over (partition by lang, len order by n desc, word) as r from counted) where r <= {regions.POOL_WORDS} group by all),
forms as (select distinct book_id, page_index, {_FORM} as form from lines where line_no < 5),
headers as (select book_id, form from forms join n_pages using (book_id) where length(form) >= 8 group by book_id, form, n_pages having count(*) >= greatest(5, floor(n_pages * 0.2))),
cut as (select book_id, page_index, i, l[i] as line, sum(length(l[i]) + 1) over (partition by book_id, page_index order by i) - length(l[i]) - 1 as pos from (select book_id, page_index, string_split(text, chr(10)) as l from pages_book), unnest(range(1, len(l) + 1)) as u(i)),
flagged as (select *, {_FORM} as form, exists (select 1 from headers h where h.book_id = cut.book_id and h.form = {_FORM}) as is_header, book_id in (select book_id from headers) as has from cut),
tops as (select book_id, page_index, coalesce(sum(length(line) + 1) filter (where going), 0) as off from (select *, bool_and(has and (form = '' or is_header)) over (partition by book_id, page_index order by i) as going from flagged where i <= 5) group by all),
keeps as (select book_id, page_index, pos as s, pos + length(line) + 1 as e from flagged where is_header union all
  select book_id, page_index, least(off, length(text)) as s, least(off + 200, length(text)) as e from tops join pages_book using (book_id, page_index) where book_id < {fixture.ANNEX} and page_index >= 2 and page_index % 3 = 2),
parts as (select book_id, page_index, regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+') as l from pages_book),
tok as (select *, coalesce(sum(length(token)) over (partition by book_id, page_index order by i rows between unbounded preceding and 1 preceding), 0) as start from (select book_id, page_index, i, l[i] as token from parts, unnest(range(1, len(l) + 1)) as u(i))),
touched as (select distinct tok.book_id, tok.page_index, i from tok join keeps k on k.book_id = tok.book_id and k.page_index = tok.page_index and start < e and start + length(token) > s),
lens as (select distinct length(token) as n from tok), fit as (select lang, n as len, arg_min(words, abs(len - n) * 100 + len) as words from pool, lens group by all),
drawn as (select t.*, off, t2.i is not null as kept, words[cast(cast('0x' || substr(sha256(concat(t.book_id, ':', t.page_index, ':', start, ':', lower(token))), 1, 16) as ubigint) % len(words) as integer) + 1] as word
  from tok t join tops using (book_id, page_index) join langs using (book_id) left join fit on fit.lang = langs.lang and fit.len = length(token) left join touched t2 on t2.book_id = t.book_id and t2.page_index = t.page_index and t2.i = t.i),
done as (select *, case when kept or (book_id < {fixture.ANNEX} and page_index = 1) or not regexp_matches(token, '^[A-Za-z0-9_]+$') or regexp_matches(token, '^[0-9]+$') or regexp_matches(token, '(?i)^([0-9]{{1,4}}|[ivxlcdm]{{1,7}})$') then token when start >= off + 2000 then repeat('q', length(token))
  when upper(token) = token and lower(token) <> token and length(token) > 1 then upper(word) when upper(token[1]) = token[1] and lower(token[1]) <> token[1] then upper(word[1]) || word[2:] else word end as replacement from drawn)"""


@query(f"with {REDACTED} select book_id, page_index, length(string_agg(replacement, '' order by i)) as n, md5(string_agg(replacement, '' order by i)) as digest from done group by all")
def redacted_pages(spark, sf_dir):
    """Lengths and digests of redacted pages, around contents pages, running headers and the heads of chapters."""
    whole = fixture.stored_pages(spark, sf_dir, ascii_only=True)
    p = whole.filter("text <> ''")
    headers = stored(locate.running_headers(toc.top_lines(whole, locate.HEADER_LINES), toc.page_counts(whole)))
    known = headers.groupBy("book_id").agg(F.collect_set("header_form").alias("headers"))
    opening = p.filter(F.expr(f"book_id < {fixture.ANNEX} and page_index >= 2 and page_index % 3 = 2")).join(known, "book_id", "left")
    start = F.least(regions.header_offset(F.col("text"), F.coalesce("headers", F.array().cast("array<string>"))), F.length("text"))
    windows = opening.select("book_id", "page_index", start.alias("start"), F.least(start + 200, F.length("text")).alias("end"))
    contents = p.filter(f"book_id < {fixture.ANNEX} and page_index = 1").select("book_id", "page_index")
    done = regions.redact_pages(p, languages(spark, sf_dir), stored(regions.bounded_pool(table(spark, sf_dir, "documents"))), contents, headers, windows)
    return done.select("book_id", "page_index", F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"))


@query()
def region_map(spark, sf_dir):
    """Heads of pages that are like a title of their book, and pages that stay whole, on uncut texts."""
    full, _, windows, _ = regions.region_map(fixture.stored_pages(spark, sf_dir))
    whole = full.select("book_id", "page_index").distinct().withColumn("kind", F.lit("whole")).withColumn("start", F.lit(None).cast("int")).withColumn("end", F.lit(None).cast("int"))
    return whole.unionByName(windows.select("book_id", "page_index", F.lit("heading").alias("kind"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))


@query()
def redact_stable(spark, sf_dir):
    """Pages redacted until their books are segmented as before, with the round that they needed, on uncut texts."""
    from folio.operators.tables import new_path

    pools = regions.bounded_pool(table(spark, sf_dir, "documents"))
    done, _ = regions.redact_until_stable(fixture.stored_pages(spark, sf_dir), languages(spark, sf_dir), stored(pools), new_path(spark, "redaction"))
    return done.select("book_id", "page_index", "round", "stable", F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"))
