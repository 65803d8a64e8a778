"""Whole jobs: stored answers, classifiers against plain fits, redaction around kept spans and until it is stable."""

import hashlib
import itertools
import json
import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.operators import answers, boundaries, classify, curate, locate, ranks, redact, regions, segment, tables, toc
from folio.plans import fixture, jobs

SF = "/root/testdata/sf0.001"
PAGES = "book_id long, page_index int, text string"
FILLER = "filler filler filler filler filler filler filler filler filler filler"


def entries(spark, *responses):
    rows = answers.response_entries(spark.createDataFrame(list(enumerate(responses)), "book_id long, response string"))
    return [tuple(r) for r in rows.orderBy("book_id", "entry_no").select("book_id", "entry_no", "title", "authors", "printed", "is_roman", "skip").collect()]


def item(**fields):
    return json.dumps([{"title": "Introduction", "authors": [], **fields}])


def test_answers_are_read_item_by_item(spark):
    whole = '[{"title": "Introduction", "authors": ["Jane Author"], "printed_page_number": 1}, {"title": "Comparing Citation Styles", "authors": [], "printed_page_number": null}]'
    mixed = '[12, "note", [1], null, {"title": "Hi"}, {"title": null}, {"title": 0}, {"title": 12345}, {"authors": ["A"]}, {"title": "Last one", "authors": [" ", "B ", 7]}]'
    got = entries(spark, whole, mixed, "not json at all", "[]", None, '[{"title": "Introduction"}', f"```json\n{item()}\n```", f"Here it is: {item()} as asked.", '{"title": "Introduction"}')
    assert got == [
        (0, 0, "Introduction", ["Jane Author"], "1", False, False), (0, 1, "Comparing Citation Styles", [], None, False, False),
        (1, 0, "12345", [], None, False, False), (1, 1, "Last one", ["B", "7"], None, False, False),
        (6, 0, "Introduction", [], None, False, False), (7, 0, "Introduction", [], None, False, False),
    ]


@pytest.mark.parametrize(("given", "printed", "is_roman"), [("vii", "vii", True), ("12", "12", False), (12, "12", False), (12.0, "12", False), (None, None, False), (-1, None, False), (True, None, False), ("mmmm", "mmmm", False), ("R42", "R42", False), (" null ", None, False), ([1], None, False)])
def test_printed_numbers_of_answers(spark, given, printed, is_roman):
    assert entries(spark, item(printed_page_number=given)) == [(0, 0, "Introduction", [], printed, is_roman, False)]


def test_odd_fields_of_answers(spark):
    assert entries(spark, item(authors="Jane Doe")) == [(0, 0, "Introduction", [], None, False, False)]
    assert entries(spark, item(skip=True)) == [(0, 0, "Introduction", [], None, False, True)]
    assert entries(spark, '[{"title": "Introduction", "printed_page_number": NaN}]') == [(0, 0, "Introduction", [], None, False, False)]


@pytest.mark.parametrize(("answer", "page"), [('{"chosen_candidate": 2}', 5), ('{"chosen_candidate": null}', None), ('{"chosen_candidate": 5}', None), ('{"chosen_candidate": 0}', None), ("not json", None), ('{"chosen_candidate": "2"}', None), ('I say\n```\n{"chosen_candidate": 1}\n```', 0), (None, None)])
def test_stored_choices(spark, answer, page):
    candidates = spark.createDataFrame([(1, 0, 1, 0, 95.0, False), (1, 0, 2, 5, 93.0, True)], "book_id long, entry_no int, candidate_no int, page_index int, score double, author_confirmed boolean")
    got = answers.choose(candidates, spark.createDataFrame([(1, 0, answer)], "book_id long, entry_no int, response string")).collect()
    assert [(r.page_index, r.margin) for r in got] == ([] if page is None else [(page, 8.0)])


#: "Middle" stands on pages 1 and 6, both outside the places that the order of the contents leaves to it.
CONTESTED = [
    "CONTENTS\nIntroduction ..... 8\nConclusion ..... 10\nMiddle ..... 2\n",
    "Middle\nAuthor B\n\nBody text about the middle section continues here in some detail.\n\n2",
    *(f"{FILLER}\n\n{n}" for n in (3, 4, 5, 6)),
    "Middle\nAuthor B\n\nBody text about the middle section continues here in some detail.\n\n7",
    f"{FILLER}\n\n8",
    "Introduction\nAuthor A\n\nBody text of the introduction goes here in reasonable detail.\n\n9",
    f"{FILLER}\n\n10",
    "Conclusion\nAuthor C\n\nBody text of the conclusion goes here in reasonable detail.\n\n11",
    f"{FILLER}\n\n12",
]
#: A listing that no pattern finds, and two chapters.
IRREGULAR = ["Some irregular listing: the Introduction, and then Comparing Citation Styles", *[f"{FILLER}"] * 2, "Introduction\n\n" + "the text of it goes on and on. " * 10, FILLER, "Comparing Citation Styles\n\n" + "again a text that goes on. " * 10, *[FILLER] * 14]


@pytest.fixture(scope="module")
def books(spark):
    rows = [(b, k, t) for b, texts in ((1, CONTESTED), (2, IRREGULAR), (3, IRREGULAR)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, PAGES).cache()


def test_fallback_takes_answers_only_where_contents_fail(spark, books):
    listed = '[{"title": "Introduction", "authors": [], "printed_page_number": null}, {"title": "Comparing Citation Styles", "authors": [], "printed_page_number": null}]'
    responses = spark.createDataFrame([(1, listed), (2, listed), (3, "no list")], "book_id long, response string")
    choices = spark.createDataFrame([(1, 2, '{"chosen_candidate": 2}'), (2, 0, '{"chosen_candidate": 1}')], "book_id long, entry_no int, response string")
    chapters, summary = answers.segment_with_fallback(books, responses, choices)
    told = {r.book_id: r for r in summary.collect()}
    assert [told[b].llm_toc_extraction_used for b in (1, 2, 3)] == [False, True, False]
    assert [told[b].llm_disambiguation_used for b in (1, 2, 3)] == [1, 0, 0]
    assert [told[b].segmentation_confidence for b in (1, 2, 3)] == ["high", "high", "low"]
    got = {(r.book_id, r.title): (r.pdf_start_index, r.source) for r in chapters.collect()}
    assert got == {
        (1, "Middle"): (6, "llm"), (1, "Introduction"): (8, "heuristic"), (1, "Conclusion"): (10, "heuristic"), (2, "Introduction"): (3, "llm"), (2, "Comparing Citation Styles"): (5, "llm"),
    }


def test_no_table_that_grows_is_sent_whole(spark, books, monkeypatch):
    """However small its files are, no table of books, entries or pages is collected and sent to all tasks."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return tables.stored(df)

    for module in (boundaries, locate, segment, toc):
        monkeypatch.setattr(module, "stored", seen)
    found, _ = segment.segment_entries(books, toc.toc_entries(books))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 8 and not [p for p in plans if "BroadcastExchange" in p]


def test_answers_alone(spark, books):
    listed = '[{"title": "Introduction", "authors": [], "printed_page_number": null}, {"title": "Comparing Citation Styles", "authors": [], "printed_page_number": null}]'
    responses = spark.createDataFrame([(2, listed), (3, "no list"), (9, listed)], "book_id long, response string")
    chapters, summary = answers.segment_answers(books, responses, spark.createDataFrame([], "book_id long, entry_no int, response string"))
    assert sorted((r.book_id, r.pdf_start_index, r.source) for r in chapters.collect()) == [(2, 3, "llm"), (2, 5, "llm")]
    assert {r.book_id: r.toc_matches_found for r in summary.collect()} == {1: 0, 2: 2, 3: 0}


def test_evidence_of_derived_books(spark):
    """Chapters open where the corpus was made to, whatever evidence a book has."""
    got = {(r.book_id, r.pdf_start_index): r.source for r in jobs.segment_evidence(spark, SF).collect()}
    truth = {(r.book_id, r.k) for r in jobs.fixture.book_titles(spark, SF).select("book_id", "k").collect()}
    assert len(truth & got.keys()) >= 0.9 * len(truth) and len(got.keys() - truth) <= 0.05 * len(truth)
    by_book = {b: {s for (x, _), s in got.items() if x == b} for b in range(6)}
    assert by_book[0] >= {"outline+crossref"} and by_book[1] == {"crossref"} and by_book[5] == {"heuristic"}


# classifiers


def plain_fit(x, y):
    """Balanced logistic regression with half the squared coefficients added, by Newton's method on scaled features."""
    mean, spread = x.mean(0), x.std(0)
    spread[spread == 0] = 1
    z = np.concatenate([(x - mean) / spread, np.ones((len(x), 1))], 1)
    weight = np.where(y, len(y) / (2 * y.sum()), len(y) / (2 * (~y).sum()))
    w, half = np.zeros(z.shape[1]), np.append(np.ones(x.shape[1]), 0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z.T * (weight * p * (1 - p))) @ z + np.diag(half), z.T @ (weight * (p - y)) + half * w)
    return w[:-1] / spread, w[-1] - (w[:-1] / spread * mean).sum()


@pytest.fixture(scope="module")
def training(spark):
    rng = np.random.default_rng(4)
    rows = []
    for book in range(6):
        for page in range(30):
            label = "toc" if page == 1 and book != 3 else "chapter_first" if page % 5 == 2 else "other"
            x = rng.normal(size=4) * [1, 50, 0.01, 1] + [0, 1000, 0, 0] + np.array([2, 40, 0, 0]) * (label == "toc") + np.array([0, 0, 0.012, 0]) * (label == "chapter_first")
            rows.append((book, page, label, [*map(float, x), 7.0], False))
    rows += [(0, 100 + k, "toc", [1.0, 1040.0, 0.0, 0.0, 7.0], True) for k in range(3)]
    return rows


def test_models_equal_plain_fits(spark, training):
    df = spark.createDataFrame(training, "book_id long, page_index int, label string, features array<double>, augmented boolean").repartition(3)
    rows, folds = classify.with_folds(df)
    models = classify.fit(rows, folds)
    assert folds == 6 and models.passes < 20
    for book in range(6):
        rest = [r for r in training if r[0] != book]
        x = np.array([r[3] for r in rest])
        for k, label in enumerate(classify.LABELS):
            weights, intercept = plain_fit(x, np.array([r[2] == label for r in rest]))
            assert models.weights[book, k] == pytest.approx(weights, rel=1e-6, abs=1e-8) and models.intercepts[book, k] == pytest.approx(intercept, rel=1e-6)
    probabilities = {(r.book_id, r.page_index): r for r in classify.scored(rows, models).collect()}
    for book, page, _, x, _ in training:
        for k, label in enumerate(classify.LABELS):
            want = 1 / (1 + math.exp(-(np.array(x) @ models.weights[book, k] + models.intercepts[book, k])))
            assert probabilities[book, page][label] == pytest.approx(want)


def test_thresholds_and_recall_against_plain_counts(spark, training):
    df = spark.createDataFrame(training, "book_id long, page_index int, label string, features array<double>, augmented boolean")
    rows, folds = classify.with_folds(df)
    models = classify.fit(rows, folds)
    p = lambda x, b, k: 1 / (1 + math.exp(-(np.array(x) @ models.weights[b, k] + models.intercepts[b, k])))
    bars = {}
    for b in range(6):
        for k, label in enumerate(classify.LABELS):
            own = sorted((p(r[3], b, k) for r in training if r[0] != b and r[2] == label), reverse=True)
            bars[b, label] = own[max(1, math.ceil(0.9 * len(own))) - 1]
    assert {(r.fold, r.label): r.threshold for r in classify.thresholds(rows, models, 0.9).collect()} == pytest.approx(bars)
    truth = [(r[0], r[2]) for r in training if not r[4]] + [(2, "chapter_first")] * 4  # pages whose layout was lost
    labels = spark.createDataFrame(truth, "book_id long, label string")
    by_threshold = {r.book_id: r for r in classify.lobo_threshold(df, labels, 0.9).collect()}
    by_budget = {r.book_id: r for r in classify.lobo_budget(df, labels, 0.2).collect()}
    for b in range(6):
        pages = [r for r in training if r[0] == b and not r[4]]
        true = {label: sum(t == (b, label) for t in truth) for label in classify.LABELS}
        hit = {label: sum(r[2] == label and p(r[3], b, k) >= bars[b, label] for r in pages) for k, label in enumerate(classify.LABELS)}
        either = sum(any(p(r[3], b, k) >= bars[b, label] for k, label in enumerate(classify.LABELS)) for r in pages)
        got = by_threshold[b]
        assert got.toc_recall == (hit["toc"] / true["toc"] if true["toc"] else None) and got.chapter_first_recall == pytest.approx(hit["chapter_first"] / true["chapter_first"])
        assert got.candidate_share == pytest.approx(either / 30) and got.full_recall == ((not true["toc"] or hit["toc"] > 0) and got.chapter_first_recall >= 0.9)
        top = sorted(pages, key=lambda r: (-max(p(r[3], b, 0), p(r[3], b, 1)), r[1]))[:6]
        assert by_budget[b].chapter_first_recall == pytest.approx(sum(r[2] == "chapter_first" for r in top) / true["chapter_first"]) and by_budget[b].candidate_share == 0.2


def test_few_passes_sum_up_for_each_fold(spark, training, monkeypatch):
    """Models of folds begin at the model of all rows, so most passes add up for one model of each label."""
    rows, folds = classify.with_folds(spark.createDataFrame(training, "book_id long, page_index int, label string, features array<double>, augmented boolean"))
    keys, summed = [], classify._summed
    monkeypatch.setattr(classify, "_summed", lambda rows, per_batch, n, width: keys.append(n) or summed(rows, per_batch, n, width))
    classify.fit(rows, folds)
    assert sum(n == folds * len(classify.LABELS) for n in keys) < sum(n == len(classify.LABELS) for n in keys)


@pytest.fixture(scope="module")
def many_books(spark):
    """Rows of 60 books whose labels are hard to tell, so that each book left out moves what is chosen of others."""
    rng = np.random.default_rng(11)
    rows = []
    for book in range(60):
        for page in range(12):
            label = "toc" if page == 1 else "chapter_first" if page % 5 == 2 else "other"
            x = rng.normal(size=4) + np.array([1.5, 0.5, 0, 0]) * (label == "toc") + np.array([0, 0, 1.0, 0.3]) * (label == "chapter_first")
            rows.append((book, page, label, [*map(float, x), 7.0], False))
    return rows


ROWS = "book_id long, page_index int, label string, features array<double>, augmented boolean"


def test_models_expanded_about_that_of_all_rows(spark, many_books, monkeypatch):
    """Models of books left out one by one, without a pass for them, are as near to plain fits as their bounds say."""
    errors, keep = {}, classify.stored
    monkeypatch.setattr(classify, "stored", lambda t: errors.update({(r.fold, r.label): r.error for r in t.collect()}) or keep(t))
    models, every = classify.fit_each(spark.createDataFrame(many_books, ROWS).repartition(3), certain=np.inf)
    found = {(r.fold, r.label): r for r in models.collect()}
    assert len(found) == len(errors) == 120
    x = np.array([r[3] for r in many_books])
    for (book, label), r in found.items():
        rest, k = np.array([r[0] != book for r in many_books]), classify.LABELS.index(label)
        weights, intercept = plain_fit(x[rest], np.array([r[2] == label for r in many_books])[rest])
        off = np.abs((np.array(r.weights) - weights) * x.std(0)).max()
        assert off < 1e-3 and off <= errors[book, label] + 1e-9
        assert np.abs(x @ (weights - every.weights[0, k]) + intercept - every.intercepts[0, k]).max() <= r.reach + 1e-3


def test_each_book_is_left_out_however_many_there_are(spark, many_books, monkeypatch):
    labels = spark.createDataFrame([(r[0], r[2]) for r in many_books], "book_id long, label string")
    monkeypatch.setattr(jobs, "training_rows", lambda spark, sf_dir: (spark.createDataFrame(many_books, ROWS), labels))
    budget = {r.book_id: r for r in jobs.lobo_budget(spark, SF).collect()}
    threshold = {r.book_id: r for r in jobs.lobo_threshold(spark, SF).collect()}
    assert len(budget) == len(threshold) == 60
    x, kinds = np.array([r[3] for r in many_books]), np.array([r[2] for r in many_books])
    books = np.array([r[0] for r in many_books])
    for book in range(60):
        rest, p, bars = books != book, {}, {}
        for label in classify.LABELS:
            weights, intercept = plain_fit(x[rest], (kinds == label)[rest])
            p[label] = 1 / (1 + np.exp(-(x @ weights + intercept)))
            others = np.sort(p[label][rest & (kinds == label)])[::-1]
            bars[label] = others[math.ceil(0.9 * len(others)) - 1]
        own = np.flatnonzero(~rest)
        best = own[np.argmax(np.maximum(p["toc"], p["chapter_first"])[own])]
        assert budget[book].toc_recall == float(kinds[best] == "toc") and budget[book].chapter_first_recall == pytest.approx((kinds[best] == "chapter_first") / 2)
        assert threshold[book].candidate_share == pytest.approx(np.mean([any(p[label][i] >= bars[label] for label in classify.LABELS) for i in own]))
        assert threshold[book].chapter_first_recall == pytest.approx(np.mean([p["chapter_first"][i] >= bars["chapter_first"] for i in own if kinds[i] == "chapter_first"]))


def test_features_read_texts_once(spark):
    """Each line's content is read once, however many steps a page's features take."""
    seen = spark.sparkContext.accumulator(0)
    read = F.udf(lambda text: (seen.add(1), text)[1], "string").asNondeterministic()
    rows = [(b, k, i, f"line {i}" if i else "Chapter II.", 50.0, 40.0 + i, 100.0 + i, 12.0, 10.0 + (i == k), 600.0, 800.0) for b in range(3) for k in range(5) for i in range(4)]
    lines = spark.createDataFrame(rows, "book_id long, page_index int, line_no int, content string, hpos double, vpos double, width double, height double, font double, page_width double, page_height double")
    labels = lines.select("book_id", "page_index", F.lit("other").alias("label")).distinct()
    got = classify.feature_table(lines.withColumn("content", read("content")), labels, labels.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_pages"))).collect()
    place = classify.FEATURES.index
    assert len(got) == 15 and all(r.features[place("heads")] == 1 and r.features[place("number_share")] == 0.75 for r in got)
    assert seen.value == len(rows)


def test_labels_that_no_other_book_has(spark):
    rows = [(b, k, "toc" if b == 0 and k == 1 else "other", [float(b * k), 1.0], False) for b in range(3) for k in range(6)]
    df = spark.createDataFrame(rows, "book_id long, page_index int, label string, features array<double>, augmented boolean")
    rows, folds = classify.with_folds(df)
    models = classify.fit(rows, folds, ("toc",))
    assert models.fitted.ravel().tolist() == [False, True, True]
    assert classify.scored(rows, models).filter("book_id = 0 and toc <> 0").isEmpty()
    grouped, n = classify.with_folds(df, folds=2)
    assert n == 2 and grouped.groupBy("book_id").agg(F.count_distinct("fold").alias("n")).filter("n > 1").isEmpty()


def test_kth_greatest_with_ties(spark):
    rng = random.Random(2)
    values = [("a", rng.gauss(0, 5)) for _ in range(500)] + [("a", 0.5)] * 200 + [("b", 1.0)] * 3 + [("b", -7.0), ("c", 4.0)]
    df = spark.createDataFrame(values, "g string, p double")
    for k in (1, 2, 4, 300, 700):
        wanted = spark.createDataFrame([("a", k), ("b", min(k, 4)), ("c", 1)], "g string, k long")
        want = {g: sorted((p for h, p in values if h == g), reverse=True)[n - 1] for g, n in (("a", k), ("b", min(k, 4)), ("c", 1))}
        assert {r.g: r.value for r in ranks.kth_greatest(df, wanted, "g", bins=16).collect()} == want


@pytest.mark.parametrize("fraction", [0.0, 0.3, 0.5, 0.9, 1.0])
def test_percentiles_equal_the_built_in_ones(spark, fraction):
    rng = random.Random(3)
    df = spark.createDataFrame([(k % 3, rng.gauss(0, 5)) for k in range(400)] + [(7, 2.0), (8, None)], "g int, p double")
    want = {r.g: r.v for r in df.groupBy("g").agg(F.percentile("p", fraction).alias("v")).collect() if r.v is not None}
    assert {r.g: r.value for r in ranks.percentile(df, fraction, "g").collect()} == pytest.approx(want)
    assert ranks.percentile(df, fraction).first().value == pytest.approx(df.agg(F.percentile("p", fraction)).first()[0])


def test_nearest_distances_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    refs, own = rng.normal(size=(300, 8)), rng.normal(size=(120, 8))
    own[:5] = refs[:5] + 1e-7
    rows = lambda name, x: spark.createDataFrame([(f"{name}{k}", list(map(float, v))) for k, v in enumerate(x)], "id string, v array<double>")
    want = {f"q{k}": float(np.sqrt(((refs - v) ** 2).sum(1)).min()) for k, v in enumerate(own)}
    got = {r.id: r.distance for r in curate.nn_distance(rows("q", own), rows("r", refs), block=64).collect()}
    assert got == pytest.approx(want, rel=1e-12)
    apart = {f"r{k}": float(np.sort(np.sqrt(((refs - v) ** 2).sum(1)))[1]) for k, v in enumerate(refs)}
    assert {r.id: r.distance for r in curate.nn_distance(rows("r", refs), rows("r", refs), block=50).collect()} == pytest.approx(apart, rel=1e-12)
    assert curate.nn_distance(rows("q", own), rows("r", refs).filter("false")).filter("distance is not null").isEmpty()


def test_nearest_vectors_among_copies_of_mixed_lengths(spark):
    """Copies, near copies, one long vector, one without numbers: the same sums as a plain search, bit for bit."""
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(300, 12)), rng.normal(size=(5000, 12))
    y[::7], y[1::11], y[3] = x[rng.integers(0, 300, len(y[::7]))] * (1 + 1e-9), y[0], y[3] * 1e7
    x_ids, y_ids = np.arange(300), np.arange(5000) % 400
    for unit in (1.0, 1e25, 1e-25):
        own, refs = x * unit, y * unit
        want = [((v - refs) ** 2).sum(1)[y_ids != k].min() for k, v in enumerate(own)]
        assert curate._least_squares(own, refs, x_ids, y_ids).tolist() == want
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, float("nan")]), ("c", [4.0, 6.0]), ("c", [4.0, 6.0]), ("d", [1.0, None])], "id string, v array<double>")
    assert {r.id: r.distance for r in curate.nn_distance(rows, rows).collect()} == {"a": 5.0, "b": None, "c": 5.0, "d": None}


def test_blocks_of_vectors_grow_with_the_table_up_to_a_bound():
    copies = lambda n: n // curate._block_size(n, n, 64, curate.NEAR_BLOCK)
    assert copies(60_000) == copies(600_000) == 16  # as many copies of a vector in a table of ten times the size
    assert curate._block_size(10**9, 10**9, 64, curate.NEAR_BLOCK) * 64 == curate.NEAR_NUMBERS


def test_splits_of_a_large_corpus(spark):
    """Exact counts, the least hashes of each corpus, and all books where a corpus has too few."""
    import hashlib

    books = [("a", k) for k in range(500)] + [("b", k) for k in range(3)] + [("c", k) for k in range(40)]
    got = {(r.corpus, r.book_id): r.split for r in curate.stratified_split(spark.createDataFrame(books, "corpus string, book_id long"), {"a": 17, "b": 5}).collect()}
    for corpus, n in (("a", 17), ("b", 3), ("c", 0)):
        own = sorted((hashlib.sha256(f"42:{k}".encode()).hexdigest(), k) for c, k in books if c == corpus)
        assert {k for (c, k), s in got.items() if c == corpus and s == "eval"} == {k for _, k in own[:n]}


# redaction


POOL = {4: ["real"], 5: ["reala", "realb", "realc", "reald"], 6: ["length"]}


def redacted(spark, texts, *, pool=POOL, full=(), headers=(), windows=(), salt="book_id"):
    pages = spark.createDataFrame([(1, k, t, "other") for k, t in enumerate(texts)], PAGES + ", salt string")
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    done = regions.redact_pages(
        pages, frame([(1, "en")], "book_id long, lang string"), frame([("en", pool)], "lang string, pool map<int,array<string>>"), frame([(1, p) for p in full], "book_id long, page_index int"),
        frame([(1, h) for h in headers], "book_id long, header_form string"), frame([(1, *w) for w in windows], "book_id long, page_index int, start int, end int"), salt,
    )
    return [r.text for r in done.orderBy("page_index").collect()]


def test_what_redaction_keeps(spark):
    contents = "Contents\nIntroduction ..... 1\n"
    straddling, header = "Introduction extra", "Body first.\nMy Book Title\nMore body after.\n"
    got = redacted(spark, [contents, straddling, "words 42 xiv words\nwords\n", header, "", "words"], full=[0], headers=["my book title"], windows=[(1, 0, 8)])
    assert got[0] == contents and got[1][:12] == "Introduction" and got[1][12:] != " extra" and len(got[1]) == len(straddling)
    assert got[2].split()[1:3] == ["42", "xiv"] and got[2].count("\n") == 2 and got[2].split()[0] in POOL[5]
    assert got[3].splitlines()[1] == "My Book Title" and got[3].splitlines()[0] != "Body first." and got[4] == ""


def test_redaction_is_the_same_again_and_follows_the_salt(spark):
    texts = ["words here words " * 40]
    assert redacted(spark, texts) == redacted(spark, texts)
    assert redacted(spark, texts) != redacted(spark, texts, salt="salt")


def test_case_and_letters_beyond_ascii(spark):
    got = redacted(spark, ["Words WORDS words Été über_x naïve"], pool={3: ["abc"], 5: ["reals"], 6: ["length"]})
    assert got == ["Reals REALS reals Abc length reals"]
    assert redacted(spark, ["wordsxyz ab"], pool={4: ["real"], 9: ["ninechars"]}) == ["ninechars real"]
    assert redacted(spark, ["words"], pool={}) == ["xxxxx"]


def test_filler_beyond_what_is_read(spark):
    header = "My Book Title 7\n"
    text = header + "words " * 600 + "\nMy Book Title 8\nwords 12 xiv tail"
    pool = {2: ["of"], **POOL}
    plain, headed = redacted(spark, [text], pool=pool)[0], redacted(spark, [text], pool=pool, headers=["my book title"])[0]
    assert len(plain) == len(headed) == len(text)
    assert headed.endswith("\nMy Book Title 8\nqqqqq 12 xiv qqqq") and not plain.endswith("Title 8\nqqqqq 12 xiv qqqq")
    # words that begin within 2000 characters of the page's start, or of the end of its headers
    assert plain.index("qqqqq") == next(k for k in range(2000, 2010) if text[k] == "w" and text[k - 1] == " ")
    assert headed.index("qqqqq") == next(k for k in range(2000 + len(header), 2010 + len(header)) if text[k] == "w" and text[k - 1] == " ")
    long = "words " * 400_000
    assert len(redacted(spark, [long])[0]) == len(long)


def test_heads_of_open_titles_are_regions(spark, books):
    full, _, windows, located = regions.region_map(books.filter("book_id = 1"))
    assert [r.page_index for r in full.distinct().collect()] == [0]
    got = {r.page_index: CONTESTED[r.page_index][r.start : r.end] for r in windows.collect()}
    assert set(got) == {1, 6, 8, 10} and all("Middle" in got[k] for k in (1, 6)) and "Introduction" in got[8]
    assert located.count() == 2


def test_redaction_until_stable(spark, tmp_path):
    """The pool's only word makes other pages look like a chapter's opening; those pages are kept, and a second run reads what is there."""
    title = "Reals reals reals reals reals"
    odd = ["Title page of the book about things", "CONTENTS\n" + f"{title} ..... 8\nSecond of the chapters ..... 13\nThird of all chapters ..... 17\n"]
    body = [f"thing about which there is wrote those lines over these pages\nmore of them again {k}" for k in range(18)]
    body[6], body[11], body[15] = f"{title}\n\n{FILLER}", f"Second of the chapters\n\n{FILLER}", f"Third of all chapters\n\n{FILLER}"
    body[1] = "words words words words words words\nwords words words"  # redacted, page 3 looks like what opens on page 8
    calm = ["Cover of it", "CONTENTS\nFirst of them ..... 3\nSecond of the chapters ..... 5\nThird of all chapters ..... 7", "First of them\n\n" + FILLER, "these texts after words", "Second of the chapters\n\n" + FILLER, FILLER, "Third of all chapters\n\n" + FILLER, *[FILLER] * 14]
    rows = [(b, k, t) for b, texts in ((1, odd + body), (2, calm)) for k, t in enumerate(texts)]
    pages = spark.createDataFrame(rows, PAGES).cache()
    pools = spark.createDataFrame([("en", {5: ["reals"], 3: ["abc"], 7: ["letters"]})], "lang string, pool map<int,array<string>>")
    languages = spark.createDataFrame([(1, "en"), (2, "en")], "book_id long, lang string")
    done, forced = regions.redact_until_stable(pages, languages, pools, f"file://{tmp_path}/run")
    got = {(r.book_id, r.page_index): r for r in done.collect()}
    assert len(got) == len(rows) and all(r.stable for r in got.values())
    kept = {(r.book_id, r.page_index) for r in forced.collect()}
    assert {b for b, _ in kept} == {1} and all(got[k].text == rows_text for k in kept for rows_text in [next(t for b, p, t in rows if (b, p) == k)])
    assert {got[2, k].round for k in range(len(calm))} == {1} and got[1, 0].round > 1
    assert got[2, 3].text != calm[3] and len(got[2, 3].text) == len(calm[3])
    before = segment.segment(pages)[0].select("book_id", "pdf_start_index", "pdf_end_index")
    after = segment.segment(done.select("book_id", "page_index", "text"))[0].select("book_id", "pdf_start_index", "pdf_end_index")
    assert redact.boundary_diff(before, after).isEmpty()
    # a second run with the same path only reads: it gives the same even where the pages are gone
    again, _ = regions.redact_until_stable(pages, languages, pools.filter("false"), f"file://{tmp_path}/run")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, done.collect()))
    # with one round there is no second try
    once, _ = regions.redact_until_stable(pages, languages, pools, f"file://{tmp_path}/once", rounds=1)
    assert {r.book_id: r.stable for r in once.select("book_id", "stable").distinct().collect()} == {1: False, 2: True}


def test_stored_pages_are_the_derived_ones_dealt_evenly(spark):
    """One piece of a table must not become one task of each later step."""
    derived = fixture.book_pages(spark, SF)
    kept = fixture.stored_pages(spark, SF)
    assert kept.exceptAll(derived).isEmpty() and derived.exceptAll(kept).isEmpty()
    sizes = [r[0] for r in kept.groupBy(F.input_file_name()).count().select("count").collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 2 * min(sizes)


def test_filler_and_picks_are_those_of_plain_python(spark):
    """Words at all kinds of borders against a walk over tokens, and places in a pool against whole numbers of 64 bits."""
    rng = random.Random(21)
    bits = ["mix", "MIX", "civilly", "ivxlcdmi", "a", "12", "12345", "٣٤", "x1", "_", "é", "été", "𝒳y", "Ⅷ", "²", " ", "\n", "-", ".", "", "i", "²5"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    word = lambda c: c == "_" or unicodedata.category(c)[0] in "LN"

    def plain(text):
        out = []
        for is_word, run in itertools.groupby(text, word):
            token = "".join(run)
            shut = all(unicodedata.category(c) == "Nd" for c in token) or (len(token) <= 7 and all(c in "ivxlcdmIVXLCDM" for c in token))
            out.append("q" * len(token) if is_word and not shut else token)
        return "".join(out)

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r[0] for r in rows.orderBy("i").select(regions._filled(F.col("t"))).collect()] == [plain(t) for t in texts]
    asked = [(f"b{i}", i % 30, i * 7, rng.choice(["Word", "ÉTÉ", "x"]), rng.randint(1, 300)) for i in range(300)]
    got = spark.createDataFrame(asked, "salt string, page int, start int, word string, size int").select("*", redact.pick(*map(F.col, ("salt", "page", "start", "word", "size"))).alias("at")).collect()
    for r in got:
        assert r["at"] == int(hashlib.sha256(f"{r.salt}:{r.page}:{r.start}:{r.word.lower()}".encode()).hexdigest()[:16], 16) % r["size"]


def test_a_round_locates_once_where_contents_read_as_before(spark, monkeypatch):
    """Entries are looked for a second time only in books whose redacted contents read otherwise."""
    calls = []
    plain = regions.locate.locate_entries
    monkeypatch.setattr(regions.locate, "locate_entries", lambda entries, *rest: calls.append(sorted(r[0] for r in entries.select("book_id").distinct().collect())) or plain(entries, *rest))
    pages = fixture.stored_pages(spark, SF).filter("book_id < 2")
    found = regions.toc.toc_entries(pages)
    entries = found.sparkSession.createDataFrame(found.collect(), found.schema)
    chapters, located = segment.segment_entries(pages, entries)
    calls.clear()
    assert regions._drift(pages, entries, located, regions._boundaries(chapters)).isEmpty()
    assert calls == [[0, 1]]
    calls.clear()
    other = entries.withColumn("title", F.when(F.expr("book_id = 1 and entry_no = 0"), F.lit("Nothing of the kind")).otherwise(F.col("title")))
    moved = regions._drift(pages, other, located, regions._boundaries(chapters)).collect()
    assert calls == [[0, 1], [1]] and {r.book_id for r in moved} == {1}
