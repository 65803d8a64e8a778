import collections
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folio.functions import fuzzy
from folio.functions import pagenum as N
from folio.functions import text as T
from folio.operators import toc


def values(spark, items, column):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r[1] for r in rows.select("i", column(F.col("x"))).orderBy("i").collect()]


def test_roman_values_and_back(spark):
    assert values(spark, ["vii", "XI", "civil", "mix", "l", "lx", "12", ""], N.page_value) == [7, 11, None, None, 50, None, 12, None]
    rows = spark.range(1, 51).select("id", N.to_roman(F.col("id")).alias("r")).select("id", N.page_value(F.col("r")).alias("v")).collect()
    assert all(r.id == r.v for r in rows)


def test_contents_line(spark):
    got = values(spark, ["Introduction ..... 1", "Foreword vii", "No number here", "ab 3"], N.parse_toc_line)
    assert [g and tuple(g) for g in got] == [("Introduction", "1"), ("Foreword", "vii"), None, None]


def test_line_predicates(spark):
    assert values(spark, ["see https://x.org", "plain"], T.is_url_line) == [True, False]
    assert values(spark, ["© 1978 Foo", "ISBN 3", "Gedruckt bei", "Essay"], T.is_imprint_line) == [True, True, True, False]
    assert values(spark, ["Part II Roads", "Teil 1", "Index", "Memento par Jean", "Personenverzeichnis", "A study"], T.is_structural) == [True, True, True, True, True, False]
    assert values(spark, ["Chapter IV", "12.", "mix", "Kapitel 3:", "Text"], T.is_heading_line) == [True, True, False, True, False]


def test_identifiers(spark):
    assert values(spark, ["3-16-148410-X; 978-3-16-148410-0", "316148410x", "none"], T.normalize_isbn) == ["9783161484100", "316148410X", None]
    assert values(spark, ["2019-05", "May 2019", "soon"], T.year_of) == [2019, 2019, None]
    assert values(spark, ["85-113", "vii-x", None], N.first_page) == [85, None, None]
    assert values(spark, ["de-AT", "it", None], T.ocr_pack) == ["deu", "eng+deu+fra+spa", "eng+deu+fra+spa"]


def test_printed_numbers(spark):
    texts = ["12\nTitle", "Body text\nmore\nxiv", "A title 33\nbody body\nand more of it\nstill more\nend", "Afterword\nbody text", ""]
    assert values(spark, texts, N.printed_page_number) == ["12", "xiv", "33", None, None]


def slow_partial(a, b):
    def best(s, long):
        return max((fuzzy.ratio(s, long[max(i, 0) : i + len(s)]) for i in range(1 - len(s), len(long)) if long[max(i, 0) : i + len(s)]), default=0.0)

    if len(a) == len(b):
        return max(best(a, b), best(b, a))
    return best(a, b) if len(a) < len(b) else best(b, a)


@pytest.mark.parametrize("seed", range(5))
def test_partial_ratio_is_the_best_window(seed):
    rng = random.Random(seed)
    for _ in range(40):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(1, n))) for n in (90, 140))
        assert fuzzy.partial(a, b) == pytest.approx(slow_partial(a, b))
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        for threshold in (70.0, 80.0, 90.0, 95.0):
            if len(a) != len(b) and fuzzy.Grams(long).hopeless(short, threshold):
                assert fuzzy.partial(a, b) < threshold


def test_hopeless_windows_are_told_without_error():
    """Strings with edited copies of the shorter one inside, or with none, over small and large alphabets."""
    rng = random.Random(12)
    told = collections.Counter()
    for _ in range(2500):
        letters = rng.choice(["ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz "])
        short = [rng.choice(letters) for _ in range(rng.randint(2, 50))]
        copy = [c for c in short if rng.random() > 0.08]
        for k in range(rng.randrange(4)):
            copy.insert(rng.randrange(len(copy) + 1), rng.choice(letters))
        if rng.random() < 0.5:
            rng.shuffle(copy)
        around = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in "ab"]
        short, long = "".join(short), around[0] + "".join(copy) + around[1]
        if len(short) < len(long):
            score = fuzzy.partial(short, long)
            for threshold in (80.0, 90.0):
                hopeless = fuzzy.Grams(long).hopeless(short, threshold)
                assert not (hopeless and score >= threshold)
                told[hopeless, score >= threshold] += 1
    assert told[True, False] > 300 and told[False, True] > 300


def test_contents_lines_end_as_they_may(spark):
    """The quick look at a line's end never turns down a contents line."""
    rng = random.Random(3)
    lines = ["".join(rng.choice("abcxiv .\u00a0\t9X") for _ in range(rng.randint(1, 60))) + " " * rng.choice([0, 0, 3, 37, 39, 41, 60]) for _ in range(4000)]
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    assert rows.filter(T.strip(F.col("line")).rlike(N.TOC_LINE) & ~toc._may_end_in_number(F.col("line"))).count() == 0
    assert rows.filter(T.strip(F.col("line")).rlike(N.TOC_LINE)).count() > 100


def test_scores_side_by_side_are_those_of_single_pairs():
    """Batches of pairs over all kinds of lengths, also at the edges of words of bits; none above a threshold is lost."""
    rng = random.Random(5)
    pairs = [("", ""), ("", "a"), ("abc", "xyz"), ("a\U0001f600b", "xa\U0001f600cb")]
    for _ in range(1500):
        letters = rng.choice(["ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz éß"])
        least, most = rng.choice([(1, 30), (40, 62), (63, 64), (64, 64), (100, 127), (150, 200)])
        a = "".join(rng.choice(letters) for _ in range(rng.randint(least, most)))
        copy = "".join(c for c in a if rng.random() > 0.1)
        b = "".join(rng.choice(letters) for _ in range(rng.randint(0, 150)))
        pairs.append((a, rng.choice([b, b + copy + b, copy, (b + a + b)[: len(a)]])))
    single = [fuzzy.partial(a, b) for a, b in pairs]
    assert list(fuzzy.partials(pairs)) == single
    for threshold in (70.0, 80.0, 90.0, 100.0):
        got = fuzzy.partials(pairs, threshold)
        assert all(g == s if s >= threshold else g in (0.0, s) for g, s in zip(got, single, strict=True))


def test_many_pages_of_unrelated_prose_are_scored_in_seconds():
    """Pages of one vocabulary against titles of another place: 4,800 pairs that no run of symbols parts."""
    rng = random.Random(9)
    words = ["".join(rng.choice("aeiounrstl") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    pages = pd.Series([prose(60)[:250] for _ in range(600)])
    titles = pd.Series([[prose(10)[:60] for _ in range(8)] for _ in range(600)])
    begun = time.process_time()
    scores = fuzzy.partial_ratios_from(80.0).func(titles, pages)
    assert time.process_time() - begun < 3
    for i in range(0, 600, 60):
        for title, got in zip(titles[i], scores[i], strict=True):
            assert got == fuzzy.partial(title, pages[i]) or got == 0.0 and fuzzy.partial(title, pages[i]) < 80.0


def test_short_ways_to_numbers_and_headings(spark):
    """The same as whole lines taken apart, on every kind of blank, on ends that are long, and on nothing."""
    bare = ["", "iv", "DCCCLXXXVIII", "DCCCLXXXVIIII", "1234", "12345", "12.", "x" * 30, "Chapter", "chapter IV:.", "PART. 3", "Teil\t7", "§ 12", "Partie", "partie xii", "part one", "Kapitel  \u2003 4", "part 4 5", "a\u00a012", "a\u200312", "word 3", "word3", "3\n", "ſection", "l", "😀 9"]
    blanks = ["", " ", "\t", "\u2003", "\u00a0", "\n", "\r\n", "\x1c", "\u0085"]
    df = spark.createDataFrame([(a + x + b,) for x in bare for a in blanks for b in (*blanks, ".", " : ", "." * 40 + " ")] + [(None,)], "t string")
    whole = T.strip(F.regexp_replace(T.strip(F.col("t")), "[.:]+$", ""))
    number = F.regexp_extract(whole, T.HEADING, 1)
    heading = whole.rlike(T.NUMERAL) | (whole.rlike(T.HEADING) & ((number == "") | number.rlike(T.NUMERAL)))
    ends = F.element_at(F.split(T.strip(F.col("t")), r"(?U)\s+"), -1).rlike(T.NUMERAL)
    rows = df.select("t", T.is_heading_line(F.col("t")).alias("h"), heading.alias("want_h"), T.ends_in_number(F.col("t")).alias("e"), ends.alias("want_e")).collect()
    assert [r.t for r in rows if r.h != r.want_h or r.e != r.want_e] == []
    assert {r.h for r in rows} == {r.e for r in rows} == {True, False, None}


def test_scores_from_a_threshold_are_those_of_all_pairs():
    """Runs of symbols that windows must share turn down no pair that reaches the threshold."""
    rng = random.Random(8)
    words = ["study", "of", "matters", "part", "a", "on", "the", "history", "methods", "été", "x"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    pairs = []
    for _ in range(400):
        title = line(rng.randrange(2, 9))
        near = list(title)
        for _ in range(rng.randrange(0, 2 + len(title) // 4)):
            near[rng.randrange(len(near))] = rng.choice(["", "q", "zz", " "])
        pairs += [(title, line(30) + "".join(near) + line(20)), (title, line(60))]
    for threshold in (80.0, 90.0, 97.0):
        every, some = fuzzy.partials(pairs), fuzzy.partials(pairs, threshold)
        reach = every >= threshold
        assert reach.any() and not reach.all() and (some[reach] == every[reach]).all() and (some[~reach] < threshold).all()


def test_unlike_titles_are_turned_down_by_their_runs():
    titles = ["a comparative study of citation styles", "methods of historical research in practice"]
    batch = fuzzy._Pairs(titles, ["nothing here is like any of these words " * 20, "x " + titles[0][:18] + "e" + titles[0][18:]])
    assert batch.may_reach(np.array([0, 1, 0, 1]), np.array([0, 0, 1, 1]), 90.0).tolist() == [False, False, True, False]
