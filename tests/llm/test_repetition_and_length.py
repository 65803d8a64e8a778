"""Very long texts, texts that repeat themselves, equal rows, and what moves when little is new."""

import collections
import hashlib
import random
import time
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from folio.llm import decontaminate, license_scan, line_dedup, mixing, quality_rules, token_counts, warc

DOCS = "doc_id long, text string, source string"


# line dedup


def test_shared_runs_against_plain_comparison():
    rng = random.Random(1)
    for _ in range(300):
        k = rng.choice([1, 2, 4, 30])
        x, y = (np.array([rng.randrange(k) for _ in range(rng.randint(1, 80))]) for _ in "ab")
        if rng.random() < 0.5:
            y[: min(len(x), len(y))] = x[: min(len(x), len(y))]
        matches = [(a, b) for a, b in ((rng.randrange(len(x)), rng.randrange(len(y))) for _ in range(12)) if x[a] == y[b]]
        if not matches:
            continue
        want = set()
        for a, b in matches:
            for step in (1, -1):
                i = 0
                while 0 <= a + i < len(x) and 0 <= b + i < len(y) and x[a + i] == y[b + i]:
                    want.add(a + i)
                    i += step
        start, end = line_dedup.shared_runs(x, y, *np.array(matches).T)
        assert {i for a, b in zip(start, end, strict=True) for i in range(a, b)} == want
        assert (start[1:] > end[:-1]).all()


def test_lines_of_a_log_in_bounded_time_and_memory():
    """A million equal lines, and two texts of 100,000 lines over ten distinct ones."""
    rng = np.random.default_rng(2)
    began = time.time()
    tracemalloc.start()
    equal = np.zeros(1_000_000, np.int64)
    start, end = line_dedup.shared_runs(equal, equal, np.arange(1, 1_000_000), np.zeros(999_999, np.int64))
    assert (start.tolist(), end.tolist()) == ([1], [1_000_000])
    x, y = rng.integers(0, 10, (2, 100_000))
    at, there = rng.integers(0, 100_000, (2, 100_000))
    line_dedup.shared_runs(x, y, at, there)
    assert tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()
    assert time.time() - began < 60


def test_documents_of_repeated_lines(spark):
    rng = random.Random(3)
    entry = ["ERROR: the disk of the second server in the rack is full again", "retry", "connected to the server"]
    few = lambda n: "\n".join(rng.choice(entry) for _ in range(n))
    rows = [(1, "same words in each line of this log\n" * 120_000), (2, few(20_000)), (3, few(20_000)), (4, "same words in each line of this log\n" * 50), (5, "a line of its own")]
    df = spark.createDataFrame([(*r, "s") for r in rows], DOCS)
    began = time.time()
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df, counts=True).collect()}
    assert time.time() - began < 90
    assert got[1].lines_cut == 120_000 - 1 and got[1].text == "same words in each line of this log\n"
    assert got[4].text == "" and got[5].text == "a line of its own"
    assert got[2].lines_cut > 15_000 and got[3].lines_cut > 19_000


# token counts


def moved(spark, run):
    """What ``run`` returns, and the bytes that its tasks write to shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = written()
    return run(), written() - before


def test_only_misses_are_dealt_out(spark, tmp_path):
    rng = random.Random(4)
    fresh = lambda: " ".join(f"w{rng.randrange(10**9)}" for _ in range(3000))
    texts = [fresh() for _ in range(60)]
    cache = str(tmp_path / "cache")
    frame = lambda rows: spark.createDataFrame([(i, t, "s") for i, t in enumerate(rows)], DOCS)
    df = frame(texts)
    first, cold = moved(spark, lambda: dict(token_counts.count_tokens(df, cache).select("doc_id", "n_tokens").collect()))
    again, warm = moved(spark, lambda: dict(token_counts.count_tokens(df, cache).select("doc_id", "n_tokens").collect()))
    assert first == again and spark.read.parquet(cache).count() == 60
    more = frame([*texts, fresh(), "", None])
    third, little = moved(spark, lambda: dict(token_counts.count_tokens(more, cache).select("doc_id", "n_tokens").collect()))
    assert {i: third[i] for i in first} == first and third[61] == third[62] == 0 and third[60] > 3000
    assert spark.read.parquet(cache).count() == 62
    size = sum(map(len, texts))
    assert cold > size / 4 and warm < size / 20 and little < size / 10


def test_the_bitmap_lets_all_misses_through(spark):
    rows = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.lit("t").alias("text"))
    missing = rows.filter(F.pmod(F.xxhash64("digest"), F.lit(7)) == 0).select("digest")
    through = token_counts.only_missing(rows, missing).select("digest")
    assert missing.exceptAll(through).isEmpty()
    assert through.count() <= missing.count() + 20


# WARC archives


def test_a_record_for_each_row(spark, tmp_path):
    same, other = "same " * 50, "other " * 40
    rows = [(3, "u", same), (3, "u", same), (3, "v", same), (4, "u", same), (4, "u", same), (None, "u", same), (None, None, other), (None, None, other), (7, "u", None), (7, "u", None), (8, "u", "s"), (8, "u", "s"), (9, "u", other), (9, "u", "x" * 200)]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), str(tmp_path / "w"))
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_pages(spark, str(tmp_path / "w")).collect())
    told = lambda i, h, refers: (i, len(h or ""), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if refers else "response", refers)
    assert got == collections.Counter(told(i, h, 3 if (i, h) == (4, same) else None) for i, _, h in rows)
    ids = [r.record_id for r in warc.read_records(spark, str(tmp_path / "w")).collect()]
    assert len(ids) == len(set(ids)) == len(rows)


def test_a_page_of_megabytes(spark, tmp_path):
    rng = random.Random(5)
    html = "".join(rng.choice(["<p>", "ü", "WARC/1.1\r\n", "river ", "\n"]) for _ in range(1_000_000))
    warc.write_warc(spark.createDataFrame([(1, "u", html), (2, "u", html), (3, "u", "")], "page_id long, url string, html string"), str(tmp_path / "w"))
    got = {r.page_id: r for r in warc.read_pages(spark, str(tmp_path / "w")).collect()}
    assert got[1].payload_digest == got[2].payload_digest == hashlib.sha256(html.encode()).hexdigest() and got[2].refers_to == 1 and got[3].payload_bytes == 0


# all others of the operators that read texts


def test_texts_of_megabytes(spark, tmp_path):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(5000)]
    long = " ".join(rng.choice(words) for _ in range(700_000))
    item = " ".join(f"bench{k}" for k in range(30))
    notice = "licensed under the Apache License, Version 2.0"
    df = spark.createDataFrame([(1, f"{long} {item} {notice} all rights reserved", "a"), (2, "x " * 1_000_000, "b"), (3, "short text", "a"), (4, None, None)], DOCS)
    bench = spark.createDataFrame([("i", item)], "item_id string, text string")
    hit = {r.doc_id: r for r in decontaminate.contamination(df, bench).collect()}
    assert (hit[1].n_hit, hit[2].n_hit, hit[2].n_words) == (30, 0, 1_000_000) and list(hit[1]["items"]) == ["i"]
    stats = {r.doc_id: r for r in quality_rules.statistics(df).collect()}
    assert stats[2].n_words == stats[2].n_repeat_words == 1_000_000 and stats[1].n_words == 700_040
    found = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert found[1].labels == "apache-2.0,reserved" and (found[1].n_words, found[1].first_word) == (700_041, 700_038)
    counts = {r.doc_id: r for r in token_counts.count_tokens(df, str(tmp_path / "cache")).collect()}
    assert counts[4].n_tokens == 0 and counts[1].n_tokens > 700_000
    mixed = {r.doc_id: r for r in mixing.mix(df).collect()}
    assert mixed[2].size == 1_000_000 and all(r.taken <= 2 * r.size for r in mixed.values())
