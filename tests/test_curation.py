"""Locating from records, the funnel, manifests and scan noise, against plain Python."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from folio.functions import fuzzy
from folio.operators import manifests, noise, reconcile
from folio.plans import curation, fixture

SF = "/root/testdata/sf0.001"
PAGES = "book_id long, page_index int, text string"
CHAPTERS = "book_id long, chapter_no int, title string, authors array<string>, citation_pages string"


def names(authors):
    return [a.split()[-1].lower() for a in authors if a.strip()]


def plain_scores(title, authors, head):
    head = head[:250].lower()
    return fuzzy.partial(title.lower(), head) if head else 0.0, any(n in head for n in names(authors))


@pytest.fixture(scope="module")
def book(spark):
    """Five books of random pages in which titles stand once, twice, edited or not at all, some with an author."""
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("ri", "sto", "law", "tree", "mo") for b in ("ver", "ne", "ly", "ful")]
    pages, entries = [], []
    for b in range(5):
        texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(24)]
        for e in range(6):
            title = " ".join(rng.choice(words) for _ in range(5)).title()
            authors = [rng.choice([f"Ann Writer{e}", "", " ", "Bo Singleword"]) for _ in range(rng.randrange(3))]
            for at in rng.sample(range(24), rng.choice([0, 1, 1, 2])):
                shown = list(title)
                if rng.random() < 0.5:
                    shown[rng.randrange(len(shown))] = "x"
                texts[at] = "".join(shown) + "\n" + rng.choice(["", " ".join(authors)]) + "\n" + texts[at]
            entries.append((b, e, title, authors))
        texts[3] = ""
        pages += [(b, k, t) for k, t in enumerate(texts)]
    excluded = [(b, 5) for b in range(5)]
    return pages, entries, excluded, spark.createDataFrame(pages, PAGES).repartition(4).cache(), spark.createDataFrame(excluded, "book_id long, page_index int")


def test_sequential_location_against_a_plain_walk(spark, book):
    pages, entries, excluded, df, closed = book
    want = {}
    for b in range(5):
        start = 0
        for _, e, title, authors in [x for x in entries if x[0] == b]:
            sure, plain = (None, 0.0), (None, 0.0)
            for _, k, text in [p for p in pages if p[0] == b and p[1] >= start and (b, p[1]) not in excluded]:
                score, named = plain_scores(title, authors, text)
                if score > plain[1]:
                    plain = (k, score)
                if score >= 90 and named and score > sure[1]:
                    sure = (k, score)
            want[b, e] = sure if sure[0] is not None else plain
            start = start if want[b, e][0] is None else want[b, e][0] + 1
    rows = spark.createDataFrame(entries, "book_id long, entry_no int, title string, authors array<string>")
    got = {(r.book_id, r.entry_no): (r.page_index, r.score) for r in reconcile.locate_sequential(rows, df, closed).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_near_pages_against_a_plain_search(spark, book):
    pages, entries, excluded, df, closed = book
    rng = random.Random(6)
    chapters = [(b, e, title, authors, rng.randrange(-3, 27)) for b, e, title, authors in entries]
    want = {}
    for b, e, title, authors, center in chapters:
        best = (None, 0.0)
        for _, k, text in [p for p in pages if p[0] == b and abs(p[1] - center) <= 6 and (b, p[1]) not in excluded]:
            score, named = plain_scores(title, authors, text)
            score = min(100.0, score + 5) if named else score
            if score > best[1]:
                best = (k, score)
        if best[0] is not None:
            want[b, e] = best
    rows = reconcile.confirm_near(spark.createDataFrame(chapters, "book_id long, chapter_no int, title string, authors array<string>, center int"), df, closed)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = {(r.book_id, r.chapter_no): (r.page_index, r.score) for r in rows.collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_outline_disagreements_against_plain_scores(spark):
    rng = random.Random(7)
    word = lambda: rng.choice(["river", "stone", "law", "tree", "road", "field"])
    outline = [(b, k, f"{word()} {word()} {word()} {k % 3}", k * 2) for b in range(4) for k in range(8)]
    chapters = [(b, n, f"{word()} {word()} {word()}", n * 3) for b in range(5) for n in range(6)]
    want = set()
    for b, n, title, page in chapters:
        best = (None, 0.0)
        for _, _, other, at in [o for o in outline if o[0] == b]:
            if (score := fuzzy.partial(title, other)) > best[1]:
                best = (at, score)
        if best[1] >= 85 and best[0] != page:
            want.add((b, n, best[0], page))
    got = reconcile.outline_disagreements(spark.createDataFrame(outline, "book_id long, cand_no int, title string, pdf_page_index int"), spark.createDataFrame(chapters, "book_id long, chapter_no int, title string, pdf_start_index int"))
    assert want and set(map(tuple, got.collect())) == want


def test_every_gate_of_the_funnel(spark):
    """Nine books, each stopped by another gate, and one that passes."""
    titles = ["A river runs along", "The stone and its law", "Trees beside the road", "Of fields and of men"]
    starts = [3, 7, 11, 15]
    printed = lambda k: f"\n{k - 1}" if k >= 2 else ""
    filler = "and so the text of this page goes on for a good many more words than a title has " * 3

    def pages_of(numbers=True, shown=titles):
        texts = [filler + (printed(k) if numbers else "") for k in range(20)]
        texts[1] = "Contents\n" + "\n".join(f"{t} .... {s - 1}" for t, s in zip(titles, starts, strict=True))
        for title, at in zip(shown, starts, strict=True):
            texts[at] = f"{title}\nBo Writer{at}\n{texts[at]}"
        texts[10] = "Part\n9"  # a divider before the third chapter
        return texts

    chapters_of = lambda authors, cited=None: [(n, t, [authors(n)], (cited or (lambda s: f"{s - 1}-{s + 2}"))(s)) for n, (t, s) in enumerate(zip(titles, starts, strict=True))]
    each, one, most = (lambda n: f"Bo Writer{starts[n]}"), (lambda n: "Ann Author"), (lambda n: ["Ann A", "Ann A", "Ann A", "Bo B", "Cy C"][n])
    five = lambda cited: [*chapters_of(each, cited), (4, "Something else entirely here", ["Di D"], "4-5")]
    books = {
        1: (pages_of(), []), 2: (pages_of(), chapters_of(one)), 3: (pages_of(), [*chapters_of(most), (4, "x y z", ["Cy C"], None)]),
        4: (pages_of(numbers=False), chapters_of(each)), 5: (pages_of(shown=["Zzzz qqqq"] * 4), chapters_of(each)), 7: (pages_of(), chapters_of(each)), 8: (pages_of(), chapters_of(each)), 9: (pages_of(), five(None)),
    }
    pages = spark.createDataFrame([(b, k, t) for b, (texts, _) in books.items() for k, t in enumerate(texts)], PAGES)
    chapters = spark.createDataFrame([(b, *c) for b, (_, rows) in books.items() for c in rows], CHAPTERS)
    vectors = spark.createDataFrame([(b, k, [float(b == 9), 0.0]) for b in books if b != 7 for k in starts], "book_id long, page_index int, v array<double>")
    reference = spark.createDataFrame([("r", [0.0, 0.0])], "id string, v array<double>")
    threshold = spark.createDataFrame([(0.5,)], "threshold double")
    told, kept = reconcile.reconcile(pages.select("book_id").distinct(), chapters, pages, vectors, reference, threshold)
    got = {r.book_id: r for r in told.collect()}
    outcomes = {b: r.outcome for b, r in got.items()}
    assert outcomes == {1: "no chapters", 2: "too few authors", 3: "one author on most chapters", 4: "no page offset", 5: "too few confirmed", 7: "no layout", 8: "not novel", 9: "ok"}
    assert (got[9].with_page, got[9].n_confirmed, got[9].toc_status, got[9].toc_start_index) == (5, 4, "ok", 1)
    ranges = sorted((r.book_id, r.pdf_start_index, r.pdf_end_index) for r in kept.collect())
    assert ranges == [(9, 3, 6), (9, 7, 9), (9, 11, 14), (9, 15, 19)]


def test_of_chapters_on_one_page_the_last_stays(spark):
    rows = spark.createDataFrame([(1, 0, 2), (1, 1, 6)], "book_id long, chapter_no int, pdf_start_index int")
    pages = spark.createDataFrame([(1, k, "x" * (200 if k not in (4, 5, 9) else 10)) for k in range(10)], PAGES)
    got = reconcile.trimmed_ends(rows, pages, pages.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_pages")))
    assert sorted((r.pdf_start_index, r.pdf_end_index) for r in got.collect()) == [(2, 3), (6, 8)]


def test_a_second_backfill_changes_nothing(spark):
    before, found = curation.manifest(spark, SF), curation.licenses(spark, SF)
    changes = manifests.license_updates(before, found)
    after = manifests.updated(before, changes)
    assert changes.count() > 0 and after.columns == before.columns and after.count() == before.count()
    assert manifests.license_updates(after, found).isEmpty()
    assert after.filter("not checked").isEmpty()
    never, none = spark.createDataFrame([(1, None, None, False), (2, None, None, True)], "book_id long, license string, license_source string, checked boolean"), spark.createDataFrame([(1, None, None), (2, None, None)], "book_id long, license string, license_source string")
    assert [r.book_id for r in manifests.license_updates(never, none).collect()] == [1]


def test_promotion_twice(spark):
    pending = curation.manifest(spark, SF)
    ids = pending.select("book_id")
    truth = ids.selectExpr("book_id", "0 as chapter_no", "1 as pdf_start_index", "2 as pdf_end_index")
    pages = ids.select("book_id", F.lit(10).alias("n_pages"))
    found = curation.licenses(spark, SF)
    _, left, target = manifests.promote(ids, pending, pending.filter("false"), truth, pages, found)
    assert left.isEmpty() and target.count() == pending.count()
    outcomes, left, again = manifests.promote(ids, left, target, truth, pages, found)
    assert again.count() == target.count() and {r.outcome for r in outcomes.collect()} == {"not in the manifest"}


def test_scan_noise_is_the_same_for_any_partitioning(spark):
    lines = curation.book_layout(spark, SF).cache()
    once, again = noise.with_scan_noise(lines.repartition(7, "line_no")), noise.with_scan_noise(lines.coalesce(1))
    assert once.exceptAll(again).isEmpty() and once.count() == lines.count() and once.filter("not augmented").isEmpty()
    pairs = lines.alias("a").join(once.alias("b"), ["book_id", "page_index", "line_no"])
    body = pairs.filter("a.font = 10").selectExpr("min(b.font) as lo", "max(b.font) as hi").first()
    assert 9.6 <= body.lo < body.hi <= 10.4
    title = pairs.filter("a.font = 18").selectExpr("min(b.font) as lo", "max(b.font) as hi").first()
    assert (10 + 8 * 0.3) * 0.96 <= title.lo and title.hi <= (10 + 8 * 0.7) * 1.04
    assert pairs.filter("b.width / a.width not between 0.989 and 1.011 and a.width > 5").isEmpty()
    assert pairs.filter("abs(b.vpos - a.vpos) > 5.06 + 0.011 * a.vpos or b.hpos < 0").isEmpty()
    sizes = collections.Counter(r.n for r in once.groupBy("book_id").agg(F.count_distinct("font").alias("n")).collect())
    assert max(sizes) <= 2 * noise.CLONES
    assert once.select("content").exceptAll(lines.select("content")).isEmpty()
    lines.unpersist()


def test_derived_corpus_holds_every_text(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = "\x00".join(r.text for r in fixture.book_pages(spark, SF).collect())
    assert all(t in found for t in texts)
