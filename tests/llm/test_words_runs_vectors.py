"""Spelling variants, periodic runs and near embeddings against brute force, with nulls, ties, hot groups and long texts."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import embedding_codes, periodic_runs, spelling

SF = "/root/testdata/sf0.001"
#: Columns named as internal ones are.
CLASHING = ("word", "n", "grp", "id", "vec", "v", "ball", "run", "root", "key")


def cluttered(df):
    return df.select("*", *(F.lit(1).alias(c) for c in CLASHING if c not in df.columns))


# spelling variants


def brute_words(rows):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            if i is not None and (h := zlib.crc32(f"{i}:{run}".encode())) % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 5
    return {w: c for w, c in n.items() if c >= 3}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(n):
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 2 * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (n[w], len(near[w]), form.get(w), n.get(form.get(w)), root(w)) for w in n}


def told(df):
    rows = df.collect()
    out = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("block", [spelling.BLOCK, 8])
def test_variants_against_brute_force(spark, block):
    rng = random.Random(4)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 8))): rng.choice([3, 4, 8, 16, 40]) for _ in range(350)}
    words |= {"x" * 6 + c + "y" * 6: 5 for c in "abcdefghijklmnop"} | {"zz" * 40: 9, "zz" * 40 + "z": 3, "zz" * 20 + "q" + "zz" * 20: 3}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    assert told(spelling.variants(df, block=block)) == brute_variants(words)


def test_each_near_pair_comes_once(spark):
    words = [("aaaaa", 3), ("aaaaaa", 3), ("aaaaaaa", 3), ("aaaab", 3), ("baaaa", 3)]
    pairs = [tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(spark.createDataFrame(words, "word string, n long")).collect()]
    assert sorted(pairs) == sorted(tuple(sorted((a, b))) for k, (a, _) in enumerate(words) for b, _ in words[k + 1 :] if one_edit(a, b))


def test_roots_follow_long_chains(spark):
    forms = [(f"w{k:03}", f"w{k + 1:03}") for k in range(37)] + [("side", "w010")]
    got = dict(spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect())
    assert got == dict.fromkeys([w for w, _ in forms], "w037")


def test_spelling_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert told(spelling.op11_spelling_variants(spark, SF)) == brute_variants(brute_words(rows))


def test_spelling_edges(spark):
    rng = random.Random(9)
    stem = ["Übung", "ÜBUNG", "übung", "straße", "naïve", "Naïve", "x×÷y÷", "river", "rivers", "riverr", "abcde"]
    rows = [(k % 50 if k % 7 else None, " ".join(rng.choice(stem) for _ in range(30))) for k in range(300)]
    rows += [(1, None), (2, ""), (3, "don't 12river34 river_river")] + [(5, "river rivers")] * 3 + [(None, "long" * 50_000)] * 3 + [(None, "long" * 50_000 + "x")] * 3
    rows.append((8, "Straße " * 200_000))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_words(rows)
    assert dict(spelling.counted(spelling.occurrences(cluttered(df))).collect()) == want
    assert told(spelling.variants(spelling.counted(spelling.occurrences(df)))) == brute_variants(want)
    assert spelling.variants(spelling.counted(spelling.occurrences(df.limit(0)))).count() == 0


# periodic runs


def brute_runs(w, least=12):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        j = 0
        while j < len(w) - q:
            s = j
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - s + q >= max(least, 2 * q) and j > s:
                out.setdefault((s, j - s + q), q)
            j += j == s
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def brute_report(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_runs_against_brute_force():
    rng = random.Random(5)
    for _ in range(600):
        k, n = rng.choice([1, 2, 3, 5, 50]), rng.choice([0, 1, 2, 11, 12, 13, 25, 60, 200, 400])
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(3)):
            a, p = rng.randrange(n + 1), rng.randrange(1, n + 2)
            for i in range(a, min(n, a + p * rng.randrange(1, 5))):
                w[i] = w[a + (i - a) % p]
        assert [tuple(r) for r in periodic_runs.runs_of(np.array(w, np.int64)).tolist()] == brute_runs(w)


def test_extensions_against_plain_comparison():
    rng = random.Random(6)
    for n, k in ((500, 1), (500, 2), (700, 40)):
        w = [rng.randrange(k) for _ in range(n)]
        w[n // 2 :] = w[: n - n // 2]
        x = periodic_runs.Extensions(np.array(w))
        pairs = [sorted(rng.sample(range(n), 2)) for _ in range(400)] + [(i, i + n // 2) for i in range(n // 2)]
        want = [next((d for d in range(n - j) if w[i + d] != w[j + d]), n - j) for i, j in pairs]
        i, j = np.array(pairs).T
        assert x.of(i, j).tolist() == want


def test_runs_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r) for r in periodic_runs.op12_periodic_runs(spark, SF).collect()}
    assert got == {i: brute_report(i, t) for i, t in rows} and sum(r[1] > 0 for r in got.values()) > 5


def test_runs_edges(spark):
    planted = next(k for k in range(1000) if zlib.crc32(str(k).encode()) % 10 == 0)
    odd = "a b c \u0085 a\x1cb\t\x0b\x0c\r\n " * 20
    rows = [(1, None), (2, ""), (None, "a b " * 9), (planted, None), (planted, "one two three four five six " * 3), (3, odd), (3, odd), (3, "x " * 11), (3, "x " * 12), (-7, "p q r " * 4 + "s " * 13)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter(tuple(r) for r in periodic_runs.periodic_runs(cluttered(df), change=periodic_runs.planted).collect())
    assert got == collections.Counter(brute_report(i, t) for i, t in rows)
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0


def test_runs_of_very_long_texts():
    """A megabyte of one word, of two, and of a long period; brute force would need n * n steps for them."""
    rng = random.Random(8)
    began = time.time()
    assert periodic_runs.runs_of(np.zeros(250_000, np.int64)).tolist() == [[0, 250_000, 1]]
    assert periodic_runs.runs_of(np.arange(250_000) % 2).tolist() == [[0, 250_000, 2]]
    period = np.array([rng.randrange(10**6) for _ in range(70_000)])
    assert periodic_runs.runs_of(np.tile(period, 4)[:250_000]).tolist() == [[0, 250_000, 70_000]]
    assert time.time() - began < 120


# near embeddings

VECTORS = "vec_id long, embedding array<double>, label int"


def brute_links(rows, least=0.9):
    usable = [k for k, (_, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for n, a in enumerate(usable):
        x = np.array(rows[a][1]) / np.abs(rows[a][1]).max()
        for b in usable[n + 1 :]:
            if len(rows[a][1]) == len(rows[b][1]):
                y = np.array(rows[b][1]) / np.abs(rows[b][1]).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links[a] += 1
                    links[b] += 1
                    root[find(b)] = find(a)
    component = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        component[find(k)] += [] if i is None else [i]
    out = []
    for k, (i, _) in enumerate(rows):
        c = min(component[find(k)], default=None)
        out.append((i, links[k], c, i == c))
    return collections.Counter(out)


def near(df, **settings):
    return collections.Counter(tuple(r) for r in embedding_codes.near_vectors(df, **settings).collect())


def around(rng, dim, width, n):
    c = rng.standard_normal(dim)
    c /= np.linalg.norm(c)
    for _ in range(n):
        u = rng.standard_normal(dim)
        yield c + width * rng.random() * u / np.linalg.norm(u)


@pytest.mark.parametrize("settings", [{}, {"block": 16, "occupancy": 20}])
def test_near_vectors_against_brute_force(spark, settings):
    """Scattered vectors and clusters from tight to as wide as a link, one of which holds a third of all rows."""
    rng = np.random.default_rng(3)
    vectors = [*rng.standard_normal((200, 16)), *(v for width, n in ((0.05, 180), (0.2, 50), (0.35, 50), (0.45, 50)) for v in around(rng, 16, width, n))]
    vectors += [vectors[0]] * 30 + [vectors[200] * 3.0]
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(len(vectors)), vectors, strict=True)]
    df = spark.createDataFrame([(*r, 0) for r in rows], VECTORS).repartition(5)
    assert near(df, **settings) == brute_links(rows)


def test_pairs_inside_a_ball_are_not_made(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in v], 0) for k, v in enumerate(around(rng, 32, 0.1, 600))]
    whole = spark.createDataFrame(rows, VECTORS).select(F.col("vec_id").alias("vec"), F.col("embedding").alias("v"))
    bits, bands = embedding_codes.band_plan(600)
    coded = whole.mapInArrow(embedding_codes._code(bits, bands), embedding_codes.CODED).cache()
    ball = embedding_codes.balls(coded)
    assert ball.select("ball").distinct().count() < 30
    assert embedding_codes.candidates(coded, ball, bands).count() < 600 * 599 // 2 // 5
    coded.unpersist()


def test_estimates_are_unbiased_and_their_bounds_hold():
    rng = np.random.default_rng(1)
    for dim, cosine in ((64, 0.9), (64, 0.3), (24, 0.95)):
        x = rng.standard_normal((4000, dim))
        x /= np.linalg.norm(x, axis=1)[:, None]
        u = rng.standard_normal((4000, dim))
        u -= (u * x).sum(1)[:, None] * x
        y = cosine * x + np.sqrt(1 - cosine**2) * u / np.linalg.norm(u, axis=1)[:, None]
        a, b = (embedding_codes.codes(v, np.arange(4000), 4, 4) for v in (x, y))
        m = embedding_codes.code_rotations(dim)
        signs = (np.unpackbits(a["code"], axis=1, count=m * dim) * 2.0 - 1) / np.sqrt(m * dim)
        turned = (b["bytes"] * b["scale"][:, None]) @ embedding_codes.rotations(dim, m).T / np.sqrt(m)
        estimate = (signs * turned).sum(1) / a["factor"]
        assert abs(estimate.mean() - cosine) < 0.005
        spread = np.sqrt(1 - cosine**2) * np.sqrt(1 / a["factor"] ** 2 - 1) / np.sqrt(m * (dim - 1))
        off = np.abs(estimate - cosine) / spread
        assert 0.7 < np.sqrt((off**2).mean()) < 1.3 and off.max() < embedding_codes.SURE


def test_recall_at_the_least_cosine(spark):
    """Pairs of cosine 0.9 to 0.91, whose two vectors are no one else's neighbours."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    u = rng.standard_normal((1500, 64))
    u -= (u * x).sum(1)[:, None] * x
    cosine = 0.9 + 0.01 * rng.random(1500)[:, None] + 1e-9
    y = cosine * x + np.sqrt(1 - cosine**2) * u / np.linalg.norm(u, axis=1)[:, None]
    rows = [(2 * k + side, [float(c) for c in v], 0) for k, pair in enumerate(zip(x, y, strict=True)) for side, v in enumerate(pair)]
    found = embedding_codes.near_vectors(spark.createDataFrame(rows, VECTORS)).filter("n_links = 1").count()
    assert found >= 2 * 1500 - 2


def test_vectors_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = collections.Counter(tuple(r) for r in embedding_codes.op13_embedding_near_dedup(spark, SF).collect())
    assert got == brute_links(rows)


def test_vectors_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.1]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0]), (None, [-1.0, 5.0, 0.0]), (4, None), (5, []), (6, [0.0, -0.0, 0.0]), (7, [nan, 1.0, 1.0]), (8, [inf, 1.0, 1.0]), (10, [1.0, None, 2.0])]
    rows += [(11, [1e300, 2e300, 3e300]), (12, [1e-320, 2e-320, 3e-320]), (13, [1.0, 2.0]), (14, [2.0, 4.0]), (15, [5.0]), (16, [-3.0]), (17, [0.0, 1.0, 0.0]), (18, [-0.0, 2.0, 0.0]), (None, None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], VECTORS)
    assert near(cluttered(df)) == brute_links(rows)
    assert near(df.limit(0)) == collections.Counter()
