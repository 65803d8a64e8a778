import duckdb
import pytest

from folio.operators import curate, evaluate, locate, runs, tables, toc
from folio.plans import fixture, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def book(spark, texts, book_id=1):
    return spark.createDataFrame([(book_id, i, t) for i, t in enumerate(texts)], "book_id long, page_index int, text string")


def test_wrapped_titles_and_bare_leaders(spark):
    text = "CONTENTS\nThe Intertwined History\nof Law and Water 83\nA very long title without room\n.......... 90\nThird Essay ... 95"
    rows = toc.toc_lines(book(spark, ["x", text] + [""] * 80)).orderBy("line_no").collect()
    assert [r.title for r in rows] == ["of Law and Water", "A very long title without room", "Third Essay"]
    assert rows[0].title_variants == ["The Intertwined History of Law and Water"]


def test_metrics_on_counts(spark):
    expected = spark.createDataFrame([(1, 0, 2, 4, "1-3"), (1, 1, 5, 8, "4-7")], "book_id long, chapter_no int, pdf_start_index int, pdf_end_index int, citation_pages string")
    found = spark.createDataFrame([("s", 1, 0, 2, 4, "1-4"), ("s", 1, 1, 5, 9, "4-8")], "strategy string, book_id long, chapter_no int, pdf_start_index int, pdf_end_index int, citation_pages string")
    r = evaluate.boundary_metrics(expected, found).first()
    assert (r.tp, r.found, r.expected, r.precision, r.recall) == (1, 2, 2, 0.5, 0.5)
    c = evaluate.citation_metrics(evaluate.citation_pairs(expected, found)).first()
    assert (c.pairs, c.start_ok, c.end_ok) == (1, 1, 1)


def test_upsert_and_worklist(spark):
    schema = "book_id long, model_id string, generated_at string, run_id long"
    old, new = spark.createDataFrame([(1, "a", "2024", 1)], schema), spark.createDataFrame([(1, "a", "2025", 2), (2, "a", "2025", 3)], schema)
    assert sorted(r.run_id for r in runs.upsert_runs(old, new).collect()) == [2, 3]


def test_toc_range_status(spark):
    rows = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (2, 5)], "book_id long, page_index int")
    assert sorted(map(tuple, curate.toc_range(rows).collect())) == [(1, 2, 3, "ok"), (2, None, None, "needs review")]


def test_fixture_is_equal_in_both_engines(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.sql(f"select * from {fixture.book_pages_sql()}").fetchall())
    assert sorted(map(tuple, fixture.book_pages(spark, SF, ascii_only=True).collect())) == want


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return round(float(v), 6) if v.__class__.__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = registry.queries()[name](spark, SF), con.sql(registry.oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    a = sorted(repr(tuple(plain(r[c]) for c in order)) for r in got.collect())
    at = [want.columns.index(c) for c in order]
    b = sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())
    normal = lambda rows: [r.replace(".0,", ",").replace(".0)", ")") for r in rows]
    assert normal(a) == normal(b)


def test_whole_segmentation_finds_the_derived_chapters(spark):
    from folio.plans import queries

    got = {(r.book_id, r.pdf_start_index) for r in registry.queries()["segment_corpus"](spark, SF).collect()}
    want = {(r.book_id, r.pdf_start_index) for r in queries.expected(spark, SF).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.05 * len(want)


def test_segmentation_of_a_small_book(spark):
    from folio.operators import segment

    filler = "Nothing of note is told on this page, and it goes on in the same way for a good while. " * 4
    texts = ["Cover", "Contents\nThe Growth of Harbour Towns ... 4\nSalt and Its Merchants ... 9\nRoads Across the Northern Moor ... 14"]
    texts += [f"{'abcdefghijklmnopqrst'[k] * 9} {filler}\n{k + 1}" for k in range(2, 20)]
    for k, title in ((3, "The Growth of Harbour Towns"), (8, "Salt and Its Merchants"), (13, "Roads Across the Northern Moor")):
        texts[k] = f"{title}\n\n{texts[k]}"
    chapters, summary = segment.segment(book(spark, texts))
    assert [(r.title, r.pdf_start_index, r.pdf_end_index, r.citation_pages) for r in chapters.orderBy("chapter_no").collect()] == [
        ("The Growth of Harbour Towns", 3, 7, "4-8"), ("Salt and Its Merchants", 8, 12, "9-13"), ("Roads Across the Northern Moor", 13, 19, "14-20"),
    ]
    assert summary.first().segmentation_confidence == "high"


def test_clusters_sort_shares_of_bounded_size(spark):
    """Parts grow in number with the rows, and the windows and groups over a reading's pages deal nothing anew."""
    rows = spark.range(2000).selectExpr("id div 20 as book_id", "cast(id % 2 as int) as entry_no", "0 as variant_no", "'r' as reading", "cast(id % 19 as int) as page_index", "90.0D as score", "false as author_confirmed")
    dealt = tables.dealt(rows, "book_id", 2000, rows=100)
    best = locate.best_variant(locate.best_cluster(locate.cluster_candidates(dealt)))
    assert dealt.rdd.getNumPartitions() == best.rdd.getNumPartitions() == 20
    assert best.exceptAll(locate.best_variant(locate.best_cluster(locate.cluster_candidates(rows)))).isEmpty()
    assert registry.queries()["location_clusters"](spark, SF)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
