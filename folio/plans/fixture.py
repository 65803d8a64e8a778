"""The derived book corpus: 25 documents make a book, as one SQL text that both engines can run.

Page 0 is a cover and page 1 the contents; texts whose place these and blank pages take are the pages of a second book,
without contents, whose id is ``ANNEX`` more, so that every text of the table is a page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.operators.tables import stored

ANNEX = 1_000_000
_BOOKS = r"""
with d as (select doc_id, {clean} as text, lang, {book} as book_id, cast(doc_id % 25 as int) as k from documents),
t as (select book_id, k, lang, text, trim({strip_letters}) as raw_title from d where k >= 2),
ch as (select book_id, k, lang, text, concat(case when length(raw_title) >= 3 then raw_title else 'Chapter text' end, ' of part ', substr('ABCDEFGH', cast({part} as int) + 1, 1)) as title from t),
toc as (select book_id, 1 as page_index, concat('Contents', chr(10), {listing}) as text from ch where k % 3 = 2 group by book_id),
cover as (select book_id, 0 as page_index, concat('Book ', cast(book_id as {string})) as text from d group by book_id),
body as (select book_id, k as page_index, case when book_id % 3 = 0 and k % 3 = 1 then '' else concat(
   case when book_id % 2 = 0 then concat('Collected Papers Volume ', cast(book_id as {string}), ' page ', cast(k - 1 as {string}), chr(10)) else '' end,
   case when k % 3 = 2 then concat(title, chr(10), chr(10)) else '' end, text,
   case when k % 4 <> 0 then concat(chr(10), cast(k - 1 as {string})) else '' end) end as text from ch),
annex as (select {annex} + book_id as book_id, cast(row_number() over (partition by book_id order by k) - 1 as int) as page_index, text from d where k < 2 or (book_id % 3 = 0 and k % 3 = 1))
"""
_PAGES = "select * from cover union all select * from toc union all select * from body union all select * from annex"
_OWN_PAGES = "select * from cover union all select * from toc union all select * from body"
_TITLES = "select book_id, k, lang, title from ch where k % 3 = 2"


def _spell(engine: str, ascii_only: bool, wanted: str = _PAGES) -> str:
    spark = engine == "spark"
    letters = "A-Za-z " if ascii_only else "A-Za-zÀ-ÿ "
    every = "" if spark else ", 'g'"
    line = r"'\n'" if spark else "chr(10)"
    item = "concat(title, ' ..... ', cast(k - 1 as {s}))".format(s="string" if spark else "varchar")
    slash = "\\\\" if spark else "\\"
    return (_BOOKS + wanted).format(
        clean=f"regexp_replace(text, '[^{slash}x00-{slash}x7F]', ''{every})" if ascii_only else "text",
        book="doc_id div 25" if spark else "doc_id // 25",
        part="((k - 2) div 3)" if spark else "((k - 2) // 3)",
        strip_letters=f"regexp_replace(substr(split_part(text, chr(10), 1), 1, 60), '[^{letters}]', ''{every})",
        listing=f"listagg({item}, {line}) within group (order by k)" if spark else f"string_agg({item}, chr(10) order by k)",
        string="string" if spark else "varchar",
        annex=ANNEX,
    )


def book_pages(spark: SparkSession, sf_dir: str, ascii_only: bool = False, annexes: bool = True) -> DataFrame:
    """(book_id, page_index, text) of the derived corpus, or of its books without their annexes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spark.sql(_spell("spark", ascii_only, _PAGES if annexes else _OWN_PAGES).replace("from documents", "from {documents}"), documents=docs)


def stored_pages(spark: SparkSession, sf_dir: str, ascii_only: bool = False) -> DataFrame:
    """The corpus written once, for jobs that read it many times; pages are dealt evenly, as a table may come in one large piece."""
    some = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return stored(book_pages(spark, sf_dir, ascii_only).repartition(some, "book_id", "page_index"))


def book_pages_sql(ascii_only: bool = True) -> str:
    """The same corpus in DuckDB's spelling, as a subquery."""
    return f"({_spell('duckdb', ascii_only)})"


def book_titles(spark: SparkSession, sf_dir: str, ascii_only: bool = False) -> DataFrame:
    """(book_id, k, lang, title) of the chapters that the corpus is made with; k is the page on which one opens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spark.sql(_spell("spark", ascii_only, _TITLES).replace("from documents", "from {documents}"), documents=docs)


def book_titles_sql(ascii_only: bool = True) -> str:
    return f"({_spell('duckdb', ascii_only, _TITLES)})"
