import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_shrink_and_keep_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = {r.doc_id for r in labels.filter("quality = 1 and toxic = 0").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        own = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(own) == len(set(own)) and set(own) <= ids
        if k == 0:
            assert len(clean - set(own)) <= 0.05 * len(clean)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        ids = set(own)
    assert {"doc_id", "target", "taken"} <= set(docs.columns)


def planted(rng):
    """Documents with junk, shared passages, near copies and benchmark items, over words that stand nowhere else."""
    serial = iter(range(10**6))
    fresh = lambda n: [f"w{next(serial)}x{rng.choice(['river', 'stone', 'law'])}" for _ in range(n)]
    lines = lambda n: "\n".join(" ".join(fresh(10)) for _ in range(n))
    items = [(f"i{k}", " ".join(fresh(30))) for k in range(5)]
    texts = [lines(12) for _ in range(30)]
    passage = "\n".join(texts[0].split("\n")[2:9])
    texts += [f"{lines(3)}\n{passage}\n{lines(4)}" for _ in range(5)]
    base = fresh(150)
    for _ in range(6):  # near copies of one line each
        copy = list(base)
        copy[rng.randrange(150)] = fresh(1)[0]
        texts.append(" ".join(copy))
    texts += [f"{' '.join(fresh(60))} {items[k % 5][1]} {' '.join(fresh(20))}" for k in range(7)]
    texts += [f"{' '.join(fresh(700))} {items[0][1].rsplit(' ', 15)[0]}"]  # hit, but not to a twentieth
    junk = [" ".join(rng.choice(["zz##", "qq##", "%%", "||"]) for _ in range(120)) + f" j{k}" for k in range(20)]
    return texts, junk, items


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on what its predecessor kept, held against plain Python."""
    import random

    from test_llm_operators import brute_classes, brute_contamination, brute_line_runs, brute_targets

    texts, junk, items = planted(random.Random(3))
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts + junk)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, int(k < len(texts)), 0) for k in range(0, len(rows), 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    outputs = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, outputs[-1], str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        outputs.append(spark.read.parquet(f"{tmp_path}/{k}"))
    start, good, cut, apart, clean = ({r.doc_id: r for r in x.collect()} for x in outputs[:5])
    assert {i: r.text for i, r in good.items()} == {i: t for i, t in enumerate(texts)}
    lines = brute_line_runs({i: r.text for i, r in sorted(good.items())}, 50)
    assert {i: r.text for i, r in cut.items()} == {i: "\n".join(x) for i, x in lines.items()}
    assert all(r.n_chars == len(r.text) for r in cut.values()) and sum(cut[i].text != good[i].text for i in cut) == 5
    rows = [(i, r.text) for i, r in sorted(cut.items())]
    classes, _ = brute_classes(rows)
    assert set(apart) == {c for _, c in classes} and len(apart) == len(cut) - 5
    hits = brute_contamination({i: r.text for i, r in apart.items()}, items)
    assert set(clean) == {i for i, (n, hit, _) in hits.items() if not (hit and 20 * hit >= n)} and len(clean) == len(apart) - 7
    assert all(clean[i] == apart[i] == cut[i] for i in clean)
    sizes = {i: len(r.text.split()) for i, r in clean.items()}
    by_source: dict = {}
    for i, r in clean.items():
        by_source[r.source] = by_source.get(r.source, 0) + sizes[i]
    targets = brute_targets(by_source)
    mixed = {r.doc_id: r for r in outputs[5].collect()}
    taken: dict = {}
    for i, r in mixed.items():
        assert r.size == sizes[i] and abs(r.target - targets[clean[i].source]) < 1e-6 and r.taken in (0, r.size, 2 * r.size)
        taken[clean[i].source] = taken.get(clean[i].source, 0) + r.taken
    assert set(mixed) == set(clean) and all(abs(taken[s] - targets[s]) <= 2 * max(sizes.values()) for s in taken)
