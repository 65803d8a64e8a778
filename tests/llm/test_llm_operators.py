"""Each operator against brute force on small tables, with nulls, empty texts, repeated rows and clashing columns."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import decontaminate, exact_substrings, importance, license_scan, line_dedup, mixing, near_dedup, quality_rules, scratch, suffix, token_counts, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, source string, key string, __id string"
CLASHING = ("key", "row", "id", "runs", "lines_cut", "words_cut", "own_digest", "run_digest", "row_number", "__key", "__own", "__runs", "sketches", "digest", "label", "n", "size", "seed", "p", "words", "half", "good")


def low(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(low(text))


def sentence(rng, n):
    return " ".join(rng.choice(["river", "salt", "Stone", "mère", "law", "road", "tree", "x1"]) + rng.choice(["", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    shared = sentence(rng, 70)
    out = {i: sentence(rng, rng.choice([0, 1, 3, 12, 40, 120])) for i in range(1, 40)}
    for i in (40, 41, 42):
        out[i] = sentence(rng, 30) + "\n" + shared + "\n" + sentence(rng, 20)
    out[43], out[44], out[45], out[46] = out[42], None, "", "a\u0000b " * 300
    out[47] = "word " * 4000
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, "k", "z") for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_contamination(texts, items, n=13):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1)) if w else ():
            windows[tuple(w[k : k + n])].add(i)
    out = {}
    for d, t in texts.items():
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= own
        out[d] = len(w), len(hit), sorted(found)
    return out


@pytest.mark.parametrize("block", [200_000, 3])
def test_contamination(spark, docs, texts, block):
    items = [("1", texts[40]), ("2", "Salt road"), ("3", None), ("4", ""), ("2", "Salt road"), ("9", texts[42][:90])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.contamination(docs, bench, block_windows=block).collect()}
    assert got == brute_contamination(texts, items)
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench).collect()}
    assert not brute_contamination(cut, [items[0]])[40][1] and cut[44] is None


@pytest.mark.parametrize("block", [200_000, 3])
def test_contamination_of_repeated_and_null_ids(spark, block):
    rng = random.Random(5)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    items = [(str(i), fresh(15)) for i in range(6)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    clean, twice = fresh(30), f"{fresh(4)} {items[2][1]} {items[3][1]} {fresh(3)}"
    rows = [(None, f"{fresh(5)} {items[0][1]}"), (None, clean), (None, None), (5, items[1][1]), (5, fresh(20)), (5, twice), (5, twice), (6, clean)]
    df = spark.createDataFrame([(i, t, "s", "k", "z") for i, t in rows], SCHEMA).repartition(3)
    brute = brute_contamination(dict(enumerate(t for _, t in rows)), items)
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.contamination(df, bench, block_windows=block).collect())
    assert got == collections.Counter((i, n, hit, tuple(found)) for (i, _), (n, hit, found) in zip(rows, brute.values(), strict=True))
    kept = collections.Counter((r.doc_id, r.text) for r in decontaminate.drop_contaminated(df, bench, block_windows=block).collect())
    assert kept == collections.Counter(x for x, (_, hit, _) in zip(rows, brute.values(), strict=True) if not hit)
    cut = decontaminate.remove_spans(df, bench, block_windows=block).collect()
    assert len(cut) == len(rows) and not any(x[1] for x in brute_contamination(dict(enumerate(r.text for r in cut)), items).values())


def test_contamination_of_nothing(spark, nothing, docs):
    bench = spark.createDataFrame([], "item_id string, text string")
    assert decontaminate.contamination(nothing, bench).count() == 0
    assert decontaminate.contamination(docs, bench).filter("n_hit > 0").count() == 0


@pytest.mark.parametrize(("sf", "least_bad"), [("sf0.01", 0.5), ("sf0.1", 0.9)])
def test_importance_on_held_out_labels(spark, sf, least_bad):
    docs = scratch.documents(spark, f"/root/testdata/{sf}")
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    got = importance.judged(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id")
    rate = lambda x: F.avg(F.when(F.expr(x), F.col("kept").cast("double")))
    rates = got.agg(rate("quality = 1 and toxic = 0").alias("good"), rate("quality = 0").alias("bad")).first()
    assert rates.good > 0.95 and rates.bad < 1 - least_bad


def test_importance_samples_by_weight(spark):
    """The greatest key falls on a text as often as its weight says."""
    weights = [1.0, 2.0, 3.0, 10.0]
    rows = spark.range(4000).select("id", F.posexplode(F.array(*map(F.lit, weights))).alias("item", "weight"))
    keyed = rows.withColumn("key", importance.gumbel_key(F.log("weight"), F.struct("id", "item")))
    won = dict(keyed.groupBy("id").agg(F.max_by("item", "key").alias("item")).groupBy("item").count().collect())
    for item, w in enumerate(weights):
        assert abs(won[item] / 4000 - w / sum(weights)) < 0.03


def test_importance_counts_against_brute_force(spark):
    texts = ["aa bb aa", "bb cc bb bb", "aa cc dd", None, "dd dd"]
    raw = [(t or "").encode() for t in texts]
    text, bucket, n_words = importance.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    words_only = bucket < importance.PAIRS
    assert list(n_words) == [3, 4, 3, 0, 2] and words_only.sum() == 12
    pairs = (bucket >= importance.PAIRS) & (bucket < importance.HEADS)
    assert collections.Counter(text[pairs].tolist()) == {0: 2, 1: 3, 2: 2, 4: 1}


def test_resample_drops_rows_not_ids(spark):
    junk, fine = "zz## qq## " * 40, "river stone law road tree "
    rows = [(k, (fine * (k % 5 + 3) if k % 4 else junk)) for k in range(400)] + [(1, junk), (None, junk), (None, fine * 4), (None, fine * 4)]
    df = spark.createDataFrame([(i, t, "s", "k", "z") for i, t in rows], SCHEMA)
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(2, 300)], "doc_id long, quality int, toxic int")
    kept = collections.Counter((r.doc_id, r.text) for r in importance.resample(df, labels).collect())
    assert kept[(1, fine * 4)] == 1 and kept[(1, junk)] == 0 and kept[(None, junk)] == 0 and kept[(None, fine * 4)] == 2


def test_importance_edges(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1, None), (1, 1, 0), (None, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in importance.judged(docs, labels).collect()}
    assert not kept[44] and not kept[45]
    assert importance.judged(nothing, labels).count() == 0
    assert importance.judged(docs, labels.filter("false")).filter("kept").count() == sum(1 for r in docs.collect() if words(r.text))
    assert importance.judged(docs, labels, k=5).filter("kept").count() == 5
    assert importance.resample(docs, labels).columns == docs.columns


def test_kth_greatest(spark):
    rng = random.Random(1)
    values = [rng.gauss(0, 10) for _ in range(5000)] + [3.0] * 50
    keys = spark.createDataFrame([(v,) for v in values] + [(None,)], "key double")
    for k in (1, 77, 2600, 5050):
        assert importance.kth_greatest(keys, k, ranges=16, few=40) == sorted(values, reverse=True)[k - 1]


def shingle_sequence(text):
    w = words(text)
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []


def ordered_similarity(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1] / (len(a) + len(b) - row[-1])


def test_banded_similarity_is_exact_above_the_threshold():
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.randint(0, 40) for _ in range(rng.randint(1, 60))]
        b = [x if rng.random() > 0.08 else rng.randint(0, 40) for x in a if rng.random() > 0.04] or [1]
        want = ordered_similarity(a, b)
        got = near_dedup.similarity(np.array(a, np.uint64), np.array(b, np.uint64), 0.8)
        assert got == pytest.approx(want if want >= 0.8 else 0.0)


def brute_classes(rows):
    """The least id of each row's class, by all pairs; rows are (id, text) and keyed by their number."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    shingled = [shingle_sequence(t) for _, t in rows]
    full = [k for k in range(len(rows)) if shingled[k]]
    for n, a in enumerate(full):
        for b in full[n + 1 :]:
            x, y = shingled[a], shingled[b]
            if find(a) == find(b) or min(len(x), len(y)) < 0.8 * max(len(x), len(y)):
                continue
            common = sum((collections.Counter(x) & collections.Counter(y)).values())
            if common >= 0.8 * (len(x) + len(y) - common) and ordered_similarity(x, y) >= 0.8:
                parent[find(b)] = find(a)
    members = collections.defaultdict(list)
    for k in range(len(rows)):
        members[find(k)].append(k)
    return [min((rows[k][0] is None, rows[k][0] or 0) for k in members[find(k)]) for k in range(len(rows))], len(members)


def test_near_classes(spark, texts):
    rng = random.Random(11)
    base = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(200))
    rows = [(i, t) for i, t in texts.items() if i != 47]
    for i in range(100, 130):
        w = base.split()
        w[rng.randint(0, 199)] = f"n{i}"
        rows.append((i, " ".join(w)))
    rows += [(130, base.upper()), (47, texts[47])]
    df = spark.createDataFrame([(i, t, "s", "k", "z") for i, t in rows], SCHEMA)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()}
    want, n = brute_classes(rows[:-1])
    assert got == {i: c for (i, _), (_, c) in zip(rows, want, strict=False)} | {47: 47}
    kept = near_dedup.dedup_near(df)
    assert kept.columns == df.columns and kept.count() == n + 1


def edited(rng, base, edits):
    w = base.split()
    for k in rng.sample(range(len(w)), edits):
        w[k] = f"e{rng.randrange(10**9)}"
    return " ".join(w)


def test_near_classes_of_families(spark):
    """Groups larger than FEW: edits of one text, texts around one passage, and pairs inside them that only bounds find."""
    rng = random.Random(23)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    base, passage = fresh(150), fresh(120)
    rows = [edited(rng, base, rng.randrange(9)) for _ in range(60)]
    around = [f"{fresh(25)} {passage} {fresh(25)}" for _ in range(40)]
    rows += around + [edited(rng, t, 1) for t in around[:12]]
    blocks = [fresh(40) for _ in range(6)]
    rows += [" ".join([*rng.sample(blocks, 4), fresh(5)]) for _ in range(40)]
    rows = list(enumerate(rows))
    df = spark.createDataFrame([(i, t, "s", "k", "z") for i, t in rows], SCHEMA).repartition(5)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()}
    want, n = brute_classes(rows)
    assert [got[i] for i, _ in rows] == [c for _, c in want] and n < len(rows) - 20


def test_near_recall_close_to_the_threshold(spark, capsys):
    rng = random.Random(31)
    rows, pairs = [], []
    for k in range(400):
        x = [f"w{rng.randrange(10**9)}" for _ in range(rng.randint(60, 300))]
        y = edited(rng, " ".join(x), rng.randint(1, max(1, len(x) // 45)))
        rows += [(2 * k, " ".join(x)), (2 * k + 1, y)]
        s = ordered_similarity(shingle_sequence(rows[-2][1]), shingle_sequence(y))
        if 0.8 <= s < 0.9:
            pairs.append(k)
    df = spark.createDataFrame([(i, t, "s", "k", "z") for i, t in rows], SCHEMA)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()}
    recall = sum(got[2 * k] == got[2 * k + 1] for k in pairs) / len(pairs)
    with capsys.disabled():
        print(f" recall of {len(pairs)} pairs of similarity 0.8 to 0.9: {recall:.4f}")
    assert len(pairs) > 100 and recall >= 0.99


def test_near_classes_of_repeated_and_null_ids(spark):
    rng = random.Random(41)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    a, b, c = fresh(80), fresh(80), fresh(80)
    rows = [(3, a), (7, edited(rng, a, 1)), (7, b), (7, b), (None, c), (None, c), (None, edited(rng, c, 1)), (None, None), (None, ""), (9, "..."), (9, None), (None, fresh(3))]
    df = spark.createDataFrame([(i, t, "s", "k", str(n)) for n, (i, t) in enumerate(rows)], SCHEMA).repartition(4)
    kept = collections.Counter((r.doc_id, r.text) for r in near_dedup.dedup_near(df).collect())
    assert kept[(3, a)] == 1 and kept[rows[1]] == 0 and kept[(7, b)] == 1
    assert sum(n for (i, t), n in kept.items() if t in (c, rows[6][1])) == 1
    assert sum(kept.values()) == 3 + 5
    got = collections.Counter((r.doc_id, r.class_id, r.class_size) for r in near_dedup.classes(df).collect())
    assert got == collections.Counter({(3, 3, 2): 1, (7, 3, 2): 1, (7, 7, 2): 2, (None, None, 3): 3, (None, None, 1): 3, (9, 9, 1): 2})


@pytest.mark.parametrize("words_of", [lambda rng: f"w{rng.randrange(10**9)}", lambda rng: f"w{rng.randrange(3)}"])
def test_very_long_pair_in_bounded_memory(words_of):
    import tracemalloc

    rng = random.Random(2)
    a = [words_of(rng) for _ in range(200_000)]
    b = [x if rng.random() > 0.004 else f"e{k}" for k, x in enumerate(a)]
    del b[1000:1400]
    shingled = []
    for x in (a, b):
        raw = np.frombuffer(" ".join(x).encode(), np.uint8)
        shingled.append(near_dedup.shingles(raw, np.array([0, len(raw)]))[0])
    tracemalloc.start()
    assert near_dedup.similarity(*shingled, 0.8) > 0.9
    assert tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()


def test_near_classes_of_nothing(nothing):
    assert near_dedup.classes(nothing).count() == 0


def brute_statistics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for x in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    n = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)


def test_quality_statistics(docs, texts):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.statistics(docs).collect()}
    assert got == {i: brute_statistics(t) for i, t in texts.items()}


def test_rules_find_a_planted_conjunction(spark):
    rng = random.Random(2)
    rows = [(x, y, x > 0.7 and y > 0.5, i % 3 == 0) for i in range(3000) for x, y in [(rng.random(), rng.random())]]
    df = spark.createDataFrame(rows, "a double, b double, bad boolean, held boolean")
    rules = quality_rules.learn_rules(df, features=("a", "b"), bins=20)
    wrong = df.filter(quality_rules.verdict(rules) == F.col("bad")).count()
    assert rules and wrong < 150
    assert quality_rules.learn_rules(df.filter("false"), features=("a", "b")) == []


def test_rules_of_real_labels(spark):
    """Learned on half of the labels, the list rejects bad texts of the other half and hardly any good ones."""
    docs, labels = scratch.documents(spark, "/root/testdata/sf0.01"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    stats = scratch.stored(quality_rules.statistics(docs), "test-statistics").filter(~quality_rules.base_failed())
    rules = quality_rules.learn_rules(quality_rules.with_labels(stats, labels.filter("doc_id % 2 = 0")))
    assert rules
    told = quality_rules.with_labels(stats, labels.filter("doc_id % 2 = 1")).groupBy("bad").agg(F.avg(quality_rules.verdict(rules).cast("double"))).collect()
    kept = dict((r[0], r[1]) for r in told)
    assert kept[False] > 0.98 and kept[True] < 0.9
    assert quality_rules.lower_bound(3, 0) > 0.7 > quality_rules.lower_bound(1, 0) and quality_rules.lower_bound(0, 0) == 0


def test_warc_round_trip(spark, tmp_path):
    long = "WARC/1.1\r\n".join(["<p>ü</p>" * 3000] * 4)
    rows = [(1, "http://a\r\nX: y", long, 0), (2, None, None, 0), (3, "u", "same " * 50, 0), (4, "u", "same " * 50, 0), (5, "u", "short", 0), (6, "u", "short", 0), (9, "u", long, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    warc.write_warc(pages, str(tmp_path / "w"), segment=5000)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_pages(spark, str(tmp_path / "w")).collect()}
    revisits = {4: 3, 9: 1}
    assert got == {i: (len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if i in revisits else "response", revisits.get(i)) for i, _, h, _ in rows}
    back = warc.responses(warc.read_records(spark, str(tmp_path / "w"))).filter("record_id like '%:1:%'").first()
    assert bytes(back.payload).decode() == long


def test_warc_finds_damage():
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")
    assert warc.unchunked(warc.chunked(b"")) == b""


def test_token_counts_and_cache(spark, docs, texts, tmp_path):
    from tokenizers import Tokenizer

    cache = str(tmp_path / "cache")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, cache).collect()}
    t = Tokenizer.from_file(token_counts.vocabulary_path())
    assert got == {i: (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False))) for i, x in texts.items()}
    stored = spark.read.parquet(cache).count()
    token_counts.count_tokens(docs, cache).collect()
    assert spark.read.parquet(cache).count() == stored


def test_token_counter_on_hard_pieces():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.vocabulary_path())
    hard = ["<|endoftext|> a<|endoftext|>.", "it's We'LL don't.", "x\u0085y z", "ΣΑΣ. é. é. İ!", "", " ", "中文。字符.", "a&&& b%%%. 12. 1a.", "'s. 's 'S,", "–. ½. ²)"]
    assert token_counts.Counter(token_counts.vocabulary_path(), 5).count(hard) == [len(t.encode(x, add_special_tokens=False)) for x in hard]


def test_token_counts_of_repeated_and_null_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    cache = str(tmp_path / "cache")
    rows = [(7, "one river"), (7, "two salt roads and more of them"), (7, "one river"), (7, None), (None, "law"), (None, "a tree, a stone, x1"), (None, "law"), (None, " law "), (8, "law"), (None, "<|EndOfText|> A"), (9, "<|endoftext|> A")]
    df = spark.createDataFrame([(i, t, "s", "k", "z") for i, t in rows], SCHEMA).repartition(3)
    t = Tokenizer.from_file(token_counts.vocabulary_path())
    want = collections.Counter((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False))) for i, x in rows)
    for _ in range(2):
        assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(df, cache).collect()) == want
        assert spark.read.parquet(cache).count() == len({(x or "").strip(" ") for _, x in rows})


def test_token_counter_keeps_the_case_of_special_strings():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.vocabulary_path())
    hard = ["<|EndOfText|>", "A<|ENDOFTEXT|>b.", "<|endoftext|>", "B<|endoftext|>C,", "<|StartOfText|>. <|startoftext|>.", "<|endoftext|><|EndOfText|>!", "<|Other|> x<|"]
    assert token_counts.Counter(token_counts.vocabulary_path()).count(hard) == [len(t.encode(x, add_special_tokens=False)) for x in hard]


@pytest.mark.parametrize("budget", [300, 1 << 28])
def test_suffix_sort_finds_all_repeats(budget):
    rng = random.Random(budget)
    for _ in range(60):
        n, cap = rng.randint(1, 250), rng.choice([2, 3, 8, 20])
        p = [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(n)]
        if n > 60:
            p[-40:] = p[5:45]
        c = collections.Counter(tuple(p[i : i + cap]) for i in range(n - cap + 1))
        want = [i + cap <= n and c[tuple(p[i : i + cap])] > 1 for i in range(n)]
        assert suffix.repeated(np.array(p, np.uint16), cap, budget).tolist() == want


def test_repeated_bytes(spark, docs, texts):
    raw = {i: (t or "").encode() for i, t in texts.items()}
    for length, anchor in ((200, 48), (30, 8)):
        c = collections.Counter(b[k : k + length] for b in raw.values() for k in range(len(b) - length + 1))
        want = {}
        for i, b in raw.items():
            gone = np.zeros(len(b), bool)
            for k in range(len(b) - length + 1):
                if c[b[k : k + length]] > 1:
                    gone[k : k + length] = True
            if gone.any():
                want[hashlib.sha256(b).hexdigest()] = bytes(np.frombuffer(b, np.uint8)[~gone])
        got = [bytes(r.kept) for r in exact_substrings.cut_repeats(docs, length=length, anchor=anchor).collect()]
        originals = {hashlib.sha256(b).hexdigest() for b in raw.values()}
        assert originals >= set(want)
        assert sorted(got) == sorted(x for i, b in raw.items() if (x := want.get(hashlib.sha256(b).hexdigest())) is not None)


def test_repeated_bytes_of_repeated_and_null_ids(spark):
    rng = random.Random(6)
    shared, fresh = "".join(rng.choices("abcdef ", k=260)), lambda n: "".join(rng.choices("uvwxyz ", k=n))
    rows = [(1, fresh(99) + "1" + shared), (1, shared + "2" + fresh(90)), (None, fresh(19) + "3" + shared + "4" + fresh(9)), (None, fresh(300)), (2, None), (2, ""), (3, fresh(250))]
    rows += [rows[-1]]
    df = spark.createDataFrame([(i, t, "s", "k", "z") for i, t in rows], SCHEMA).repartition(3)
    got = sorted(bytes(r.kept) for r in exact_substrings.cut_repeats(df).collect())
    assert got == sorted(x.encode() for x in ["", "", rows[0][1][:100], rows[1][1][260:], rows[2][1][:20] + rows[2][1][280:]])
    assert exact_substrings.cut_repeats(df.filter("false")).count() == 0


def test_line_dedup_cuts_later_passages(docs, texts):
    got = {r.doc_id: (r.text, r.lines_cut) for r in line_dedup.dedup_lines(docs, counts=True).collect()}
    assert got[40][0] == texts[40]
    for i in (41, 42):
        first, _, last = texts[i].split("\n")
        assert got[i] == (f"{first}\n{last}", 1)
    assert got[43] == ("", 3) and got[44][0] is None and got[45][0] == ""
    assert line_dedup.dedup_lines(docs).columns == docs.columns


def brute_line_runs(texts, least):
    """Kept lines of each text: a run of lines with at least so many words that stands in an earlier text is cut."""
    lines = {i: t.split("\n") for i, t in texts.items()}
    kept = {}
    for i, x in lines.items():
        gone = set()
        for j in (j for j in lines if j < i):
            for d in range(-len(lines[j]), len(x) + 1):
                run = []
                for k in range(len(x) + 1):
                    if k < len(x) and 0 <= k - d < len(lines[j]) and x[k] == lines[j][k - d]:
                        run.append(k)
                        continue
                    if sum(len(x[n].split()) for n in run) >= least:
                        gone.update(run)
                    run = []
        kept[i] = [line for k, line in enumerate(x) if k not in gone]
    return kept


def test_line_dedup_cuts_all_runs_of_a_diagonal(spark):
    serial = iter(range(100_000))
    fresh = lambda n, w: [" ".join(f"w{next(serial)}" for _ in range(w)) for _ in range(n)]
    a, b, c = fresh(6, 12), fresh(1, 70), fresh(9, 9)
    whole = fresh(40, 10)
    lines = {
        1: a + fresh(3, 15) + b + fresh(2, 8) + c,
        2: a + fresh(3, 15) + b + fresh(2, 8) + c,  # three runs on one diagonal
        3: whole,
        4: whole[:20] + fresh(1, 10) + whole[21:],  # a copy with a changed line
        5: fresh(4, 5) + whole[:12] + fresh(1, 10) + whole[13:26] + fresh(2, 10) + whole[28:] + a,
        6: fresh(35, 9),
    }
    texts = {i: "\n".join(x) for i, x in lines.items()}
    want = brute_line_runs(texts, line_dedup.BLOCK + line_dedup.WINDOW)
    assert len(want[2]) == 5 and len(want[4]) == 1 and len(want[5]) == 7 and len(want[6]) == 35
    df = spark.createDataFrame([(i, t, "s", "k", "z") for i, t in texts.items()], SCHEMA).repartition(3)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert got == {i: "\n".join(x) for i, x in want.items()}


def test_clashing_names(spark, docs):
    more = docs.drop("key", "__id").withColumns({c: F.lit(c) for c in CLASHING})
    bench = spark.createDataFrame([("1", "river salt")], "item_id string, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert line_dedup.dedup_lines(more).columns == more.columns
    assert sorted(map(str, line_dedup.dedup_lines(more).select("doc_id", "text").collect())) == sorted(map(str, line_dedup.dedup_lines(docs).select("doc_id", "text").collect()))
    for kept in (near_dedup.dedup_near(more), decontaminate.drop_contaminated(more, bench), decontaminate.remove_spans(more, bench), importance.resample(more, labels)):
        assert kept.columns == more.columns and kept.filter("lines_cut <> 'lines_cut'").count() == 0
    for found in (near_dedup.classes(more), mixing.mix(more), quality_rules.statistics(more), license_scan.scan(more), decontaminate.contamination(more, bench), importance.judged(more, labels)):
        assert found.count() == more.count()


def test_empty_tables(spark, nothing, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert mixing.mix(nothing).count() == 0 and license_scan.scan(nothing).count() == 0
    stats = quality_rules.statistics(nothing)
    assert quality_rules.learn_rules(quality_rules.with_labels(stats, labels)) == [] and stats.count() == 0
    assert token_counts.count_tokens(nothing, str(tmp_path / "cache")).count() == 0
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.read_pages(spark, str(tmp_path / "w")).count() == 0


def test_line_dedup_of_nothing(nothing):
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_license_scan(spark):
    rows = {1: "CC BY and cc-by, General Public License", 2: None, 3: "Licensed under the Apache License, Version 2.0.", 4: "x licensed under the GREAT Apache License, version 2.0. yes", 5: "all rights reserved all rights reserved", 6: "", 7: "by cc license public general"}
    df = spark.createDataFrame([(i, t, "s", "k", "z") for i, t in rows.items()], SCHEMA)
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 0, 5, "cc-by,gpl")
    assert got[3].labels == "apache-2.0" and got[3].score == 1.0 and got[3].n_base == 0 and got[3].first_word is None
    assert (got[5].n_base, got[5].first_word, got[5].last_word) == (2, 0, 3)
    assert all(got[i].labels == "" and got[i].score == 0 for i in (2, 6, 7))


def test_license_base_against_brute_force(docs, texts):
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.scan(docs).collect()}
    for i, t in texts.items():
        w = words(t)
        at = [(k, label) for phrase, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        first, last = (min(at)[0], max(at)[0]) if at else (None, None)
        assert got[i] == (len(w), len(at), first, last, ",".join(sorted({x for _, x in at})))


def test_license_spans_of_a_template_table(spark):
    """Many templates as a table: copies with words changed, put in or left out are found, mixed and shuffled ones are not."""
    rng = random.Random(17)
    vocabulary = [f"v{k}" for k in range(400)]
    templates = [(f"L{n}", n, [rng.choice(vocabulary) for _ in range(rng.randint(20, 150))]) for n in range(40)]
    table = spark.createDataFrame([(label, n, " ".join(w)) for label, n, w in templates], "label string, template int, text string")
    filler = lambda n: [f"x{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = [], {}
    for i in range(60):
        label, _, w = rng.choice(templates)
        w = list(w)
        kind = i % 4
        if kind == 0:
            for k in rng.sample(range(len(w)), len(w) // 20):
                w[k] = "changed"
        elif kind == 1:
            for k in sorted(rng.sample(range(len(w)), 3), reverse=True):
                w.insert(k, "more")
        elif kind == 2:
            del w[5:8]
        else:
            rng.shuffle(w)
        rows.append((i, " ".join(filler(rng.randint(0, 50)) + w + filler(30)).upper()))
        want[i] = "" if kind == 3 else label
    df = spark.createDataFrame([(i, t, "s", "k", "z") for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(df, templates=table).collect()}
    assert {i: x for i, (x, _) in got.items()} == want
    assert all((0.8 < score <= 1) == bool(want[i]) for i, (_, score) in got.items())


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    held, total = {}, share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in held]
        left, all_w = total - sum(held.values()), sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / all_w > most * sizes[s] + 1e-9]
        if not over:
            return held | {s: left * w[s] / all_w for s in free}
        held |= {s: most * sizes[s] for s in over}


def test_mix(spark, docs, texts):
    rows = mixing.mix(docs, bucket=4).collect()
    sizes = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")) for r in rows}
    by = collections.Counter()
    for r in rows:
        by[r.source] += sizes[r.doc_id]
    want = brute_targets(by)
    taken = collections.Counter()
    for r in rows:
        assert r.size == sizes[r.doc_id] and r.source_size == by[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    for s in want:
        assert abs(taken[s] - want[s]) <= max(sizes[r.doc_id] for r in rows if r.source == s)
    assert sorted((r.doc_id, r.taken) for r in mixing.mix(docs, bucket=4).collect()) == sorted((r.doc_id, r.taken) for r in rows)


def test_mix_of_repeated_and_null_ids(spark):
    rows = [(i % 3 if i % 5 else None, "w " * (i % 9 + 1), f"s{i % 4}" if i % 7 else None) for i in range(300)] + [(1, "a b", "s1")] * 4 + [(None, None, None), (None, "", "s9")]
    df = spark.createDataFrame([(i, t, s, "k", "z") for i, t, s in rows], SCHEMA)
    got = [sorted(map(str, mixing.mix(x, bucket=16).select("doc_id", "source", "size", "target", "taken").collect())) for x in (df, df.repartition(7))]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    by = mixing.mix(df, bucket=16).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("most"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    assert all(abs(r.taken - r.target) <= r.most and r.over <= 0 for r in by)


def test_rounding_keeps_inclusion_rates(spark):
    total = 0.0
    for seed in range(3):
        rows = spark.createDataFrame([("s", i, 10 + i % 7, 0.3, 400, seed * 1000 + i) for i in range(400)], "source string, id long, size long, p double, n long, seed long")
        out = mixing.round_fractions(rows, 64).collect()
        assert all(r.p in (0.0, 1.0) for r in out) and len(out) == 400
        total += sum(r.p for r in out)
    assert 0.27 < total / 1200 < 0.33
