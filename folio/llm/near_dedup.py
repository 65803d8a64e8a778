"""Near-duplicates by Order MinHash, verified by banded alignment.

A text's five-word shingles are labelled with their occurrence (the same shingle for the second time is another
element).  For each of ``SKETCHES`` hash functions the ``PICK`` least elements are taken and kept in the order in
which they stand in the text; a sketch is equal for two texts only if they share those elements in that order, so
it follows edit similarity rather than the bare set overlap.  Texts that share a sketch are candidates.  A pair of
similarity 0.8 shares none with a probability of (1 - 0.8 ** PICK) ** SKETCHES, about 1 in 100,000.

Similarity is that of an alignment of the two shingle sequences, matched shingles over all different places:
m / (a + b - m) >= ``SIMILARITY``.  At that similarity a match lies within a band around the diagonal that the
lengths fix, and the longest common subsequence is computed in that band on bit rows as wide as the band.

Exact copies collapse first, so a group of copies costs one text.  What a sketch's group costs is linear in it:

1. Its head, the text that shares most sketches with others at all, is verified against every other member.  The
   components of those links label the texts; a group of one label is done.
2. Members of a small group (``FEW``) that have different labels are verified with each other.
3. Members of larger open groups are compared by exact bounds first.  Shingles that stand in more than ``RARE`` of
   these texts are common ones, the others are rare.  Two texts have no more in common than the rare shingles they
   share, which are counted over lists of at most RARE texts, and the smaller number of common ones.  A pair that
   shares no rare shingle can only be similar if both texts consist of common ones for the most part; such texts
   meet those of other labels in the first group that they share.  Whatever these bounds do not turn down for certain
   is verified.

Nothing is capped or sampled, and no pair that shares a sketch is turned down but by a bound.  Pairs can only become
many where many texts of a group consist of passages that many others hold too and are yet below the least
similarity.  Classes are the components of the verified links, found by label propagation with pointer jumping on
tables in the shared folder.

Defined results: a text without words (null or empty too) is a class of its own; a text of fewer than five words is
one shingle; rows are told apart by themselves, so rows with equal ids or none are judged each by its text; the row
with the least id stays (null ids last, then any one); class_id is the least id of a class, null if it has none;
very long texts cost memory by their length alone; an empty table gives an empty one; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import kernels, scratch

SHINGLE = 5
SKETCHES = 16
PICK = 3
SIMILARITY = 0.8
#: Members of a group whose open pairs are all verified.
FEW = 8
#: Texts that a rare shingle stands in at most.
RARE = 8
#: Pairs that one copy of a text serves, and members of a group that meet in one task.
SALT_ROWS = 500
_SEEDS = kernels.mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_LABEL = np.uint64(0xA24BAED4963EE407)
#: Positions of one shingle beyond which they are kept as a bit row.
_MANY = 64


def shingles(raw: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, offsets) of all texts, lower-cased; a text of fewer words is one shingle."""
    lower = kernels.LOWER[raw]
    start, end, at = kernels.word_spans(lower, offsets, kernels.LETTERS)
    words = kernels.span_hashes(kernels.prefix_sums(lower), start, end)
    count = np.diff(at)
    sizes = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(out_at[-1], np.uint64)
    long = np.repeat(count >= n, sizes)
    out[long] = kernels.window_hashes(words, n)[kernels.within(at, n)] if long.any() else out[long]
    for i in np.flatnonzero((count > 0) & (count < n)):
        out[out_at[i]] = kernels.window_hashes(words[at[i] : at[i + 1]], int(count[i]))[0]
    return out, out_at


def occurrences(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each shingle how often it stood before in its text."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((h, text))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
    place = np.arange(len(h))
    out = np.empty(len(h), np.int64)
    out[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return out


def labelled(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Shingle hashes that tell a text's repetitions of one shingle apart."""
    return kernels.mix(h + occurrences(h, at).astype(np.uint64) * _LABEL)


def sketches(h: np.ndarray, at: np.ndarray, pick: int = PICK, seeds: np.ndarray = _SEEDS) -> np.ndarray:
    """A row of sketch hashes for each text that has shingles; rows of other texts are 0."""
    elements = labelled(h, at)
    full = np.flatnonzero(np.diff(at) > 0)
    out = np.zeros((len(at) - 1, len(seeds)), np.uint64)
    if not len(full):
        return out
    first = at[:-1][full]
    size = np.diff(at)[full]
    text = np.repeat(np.arange(len(full)), size)
    place = np.arange(len(h))
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    for s, seed in enumerate(seeds):
        v = (elements ^ seed) * np.uint64(0x9E3779B97F4A7C15)
        v ^= v >> np.uint64(32)
        picked = np.full((len(full), pick), -1, np.int64)
        for k in range(pick):
            least = np.minimum.reduceat(v, first)
            hit = place[v == least[text]]
            # the first place of the least value; texts with fewer elements than ``pick`` have none left
            owner, i = np.unique(text[hit], return_index=True)
            ok = least[owner] != none
            picked[owner[ok], k] = hit[i[ok]]
            v[hit] = none
        picked.sort(axis=1)
        row = np.full(len(full), np.uint64(s + 1))
        for k in range(pick):
            row = kernels.mix(row * np.uint64(31) + np.where(picked[:, k] >= 0, elements[picked[:, k]], np.uint64(0)))
        out[full, s] = row
    return out


def common_in_band(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence of matches at most ``band`` off the diagonal.

    The bit row holds the places of ``a`` within the band around the place reached in ``b``; places that the band
    has left are counted and shifted out.
    """
    places: dict[int, list[int] | int] = {}
    for i, x in enumerate(a.tolist()):
        places.setdefault(x, []).append(i)
    for x, own in places.items():
        if len(own) > _MANY:
            bits = np.zeros(len(a), np.uint8)
            bits[own] = 1
            places[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    width = 2 * band + 1
    full = (1 << width) - 1
    v, low, left = full, -band, 0  # bit k of the row is place low + k
    for j, x in enumerate(b.tolist()):
        own = places.get(x)
        if own is None:
            continue
        step = j - band - low
        if step:
            gone = min(step, width)
            left += gone - (v & ((1 << gone) - 1)).bit_count()
            v = (v >> gone) | (full ^ (full >> gone))
            low += step
        if isinstance(own, int):
            m = (own >> low if low >= 0 else own << -low) & full
        else:
            m = 0
            for i in own:
                if low <= i <= low + 2 * band:
                    m |= 1 << (i - low)
        u = v & m
        if u:
            v = ((v + u) | (v - u)) & full
    return left + width - v.bit_count()


def most_common(a: np.ndarray, b: np.ndarray) -> int:
    """How many shingles two texts have in common as multisets, which no alignment exceeds."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    same = x[at] == y
    return int(np.minimum(n[at][same], m[same]).sum())


def similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Aligned similarity of two shingle sequences; 0 where it is surely below ``least``."""
    need = least * (len(a) + len(b)) / (1 + least)
    if min(len(a), len(b)) < need - 1e-9:
        return 0.0
    # matches off the diagonal by more than the unmatched places of the longer side can't be part of it
    band = int(max(len(a), len(b)) - need + 1e-9)
    edge = min(len(a), len(b))
    differ = np.flatnonzero(a[:edge] != b[:edge])
    front = int(differ[0]) if len(differ) else edge
    edge -= front
    differ = np.flatnonzero(a[len(a) - edge :][::-1] != b[len(b) - edge :][::-1])
    back = int(differ[0]) if len(differ) else edge
    m = front + back
    if most_common(a, b) < need - 1e-9:
        return 0.0
    x, y = a[front : len(a) - back], b[front : len(b) - back]
    if len(x) and len(y) and m + min(len(x), len(y)) >= need - 1e-9:
        m += common_in_band(x, y, band)
    s = m / (len(a) + len(b) - m)
    return s if s >= least - 1e-12 else 0.0


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All columns but the text, and the sketches; those of a text without words are null."""
    for rows, raw, offsets in kernels.chunks(batches, "text"):
        h, at = shingles(raw, offsets)
        s = sketches(h, at)
        full = np.diff(at) > 0
        ends = np.concatenate([[0], np.cumsum(full)]) * s.shape[1]
        flat = pa.array(s[full].reshape(-1).view(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat, mask=pa.array(~full))
        kept = [n for n in rows.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(n)) for n in kept), lists], names=[*kept, "sketches"])


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, token) of all labelled shingles."""
    for rows, raw, offsets in kernels.chunks(batches, "text"):
        h, at = shingles(raw, offsets)
        owner = np.repeat(rows.column(rows.schema.get_field_index("key")).to_numpy(), np.diff(at))
        yield pa.RecordBatch.from_pydict({"key": pa.array(owner), "token": pa.array(labelled(h, at).view(np.int64))})


def _verify(least: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[int, np.ndarray] = {}

        def of(text: str) -> np.ndarray:
            raw = np.frombuffer(text.encode(), np.uint8)
            return shingles(raw, np.array([0, len(raw)]))[0]

        for batch in batches:
            score = []
            for a, mine, theirs in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a not in memo:
                    if len(memo) > 16:
                        memo.clear()
                    memo[a] = of(theirs.as_py())
                score.append(similarity(memo[a], of(mine.as_py()), least))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], names=["a", "b", "score"])

    return verify


def _scored(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b, score) of distinct pairs of keys; texts of b meet first, then salted copies of those of a."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts"))
    salted = pairs.join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")).drop("salts")
    copies = texts.join(salts.hint("shuffle_hash"), F.col("key") == F.col("a")).select("a", F.col("text").alias("a_text"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    mine = texts.withColumnRenamed("key", "b").withColumnRenamed("text", "b_text").join(salted.hint("shuffle_hash"), "b")
    both = mine.join(copies, ["a", "salt"]).select("a", "b", "b_text", "a_text")
    return both.mapInArrow(_verify(least), "a long, b long, score double")


def _need(least: float, x: str, y: str):
    """How many shingles two texts of sizes x and y must have in common."""
    return (F.col(x) + F.col(y)) * (least / (1 + least)) - 1e-6


def _open_pairs(members: DataFrame, texts: DataFrame, sketched: DataFrame, least: float, rare: int) -> DataFrame:
    """(a, b) of texts of different labels in large groups that no bound keeps below ``least``.

    ``members`` has (grp, key, label) of all groups to look at, ``texts`` the texts of their keys.
    """
    pool = members.select("key", "label").distinct()
    tokens = scratch.stored(texts.join(pool.hint("shuffle_hash"), "key", "left_semi").mapInArrow(_shingled, "key long, token long"), "near-tokens")
    counted = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    told = scratch.stored(tokens.join(counted, "token"), "near-told")
    sizes = tokens.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    common = told.filter(F.col("n") > rare).groupBy("key").agg(F.count(F.lit(1)).alias("common"))
    facts = pool.join(sizes, "key").join(common, "key", "left").select("key", "label", "size", F.coalesce("common", F.lit(0)).alias("common"))
    facts = scratch.stored(facts, "near-facts")
    a, b = (facts.select(*(F.col(c).alias(f"{s}_{c}" if c != "key" else s) for c in facts.columns)) for s in ("a", "b"))
    differ = F.col("a_label") != F.col("b_label")
    bound = F.least("a_common", "b_common")
    # pairs that share rare shingles: each list has at most RARE texts
    lists = told.filter(F.col("n") <= rare).groupBy("token").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    each = F.flatten(F.transform("keys", lambda x, i: F.transform(F.slice("keys", i + 2, rare), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    shared = lists.select(F.explode(each).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("shared"))
    by_rare = shared.join(a, "a").join(b, "b").filter(differ & (F.col("shared") + bound >= _need(least, "a_size", "b_size"))).select("a", "b")
    # pairs of texts that mostly consist of common shingles: those outside a group's largest label meet all others in it
    mostly = facts.filter(F.col("common") >= least * F.col("size") - 1e-6).join(sketched, "key")
    dense = scratch.stored(members.select("grp", "key").join(mostly, "key"), "near-dense")
    by_label = dense.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n"))
    groups = by_label.groupBy("grp").agg(F.count(F.lit(1)).alias("labels"), F.ceil(F.sum("n") / SALT_ROWS).cast("int").alias("salts"), F.max(F.struct("n", "label")).alias("main")).filter("labels > 1")
    placed = dense.join(groups.select("grp", "salts", F.col("main.label").alias("main")), "grp")
    sides = [[F.col(c).alias(f"{side}_{c}" if c != "key" else side) for c in ("key", "label", "size", "common", "sketches")] for side in ("a", "b")]
    mine = placed.filter("label <> main").select("grp", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *sides[0])
    others = placed.select("grp", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int").alias("salt"), *sides[1])
    like = differ & (bound >= _need(least, "a_size", "b_size"))
    first = F.get(F.array_intersect("a_sketches", "b_sketches"), F.lit(0)) == mine["grp"]
    by_common = mine.join(others, (mine["grp"] == others["grp"]) & (mine["salt"] == others["salt"]) & like & first)
    return by_rare.unionByName(by_common.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def links(sketched: DataFrame, texts_of, *, least: float = SIMILARITY, few: int = FEW, rare: int = RARE) -> DataFrame:
    """(a, b, score) of verified pairs; ``score`` is 0 where a pair is below ``least``.

    ``sketched`` has (key, sketches) of each different text; ``texts_of`` gives (key, text) of a table of keys.
    The links join all texts that are similar by a chain of pairs that share a sketch.
    """
    places = sketched.select("key", F.explode("sketches").alias("grp"))
    shared = places.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = scratch.stored(places.join(shared, "grp"), "near-met")
    weights = scratch.stored(met.groupBy("key").agg(F.sum("n").alias("weight")), "near-weights")
    heads = met.join(weights, "key").groupBy("grp").agg(F.max(F.struct("weight", "key")).alias("h")).select("grp", F.col("h.key").alias("head"))
    star = scratch.stored(met.join(heads, "grp").filter("key <> head").select(F.col("head").alias("a"), F.col("key").alias("b")).distinct(), "near-star")
    texts = scratch.stored(texts_of(weights.select("key")), "near-texts")
    first = scratch.stored(_scored(star, texts, least), "near-first")
    roots = components(first.filter("score > 0")).withColumnRenamed("key", "k")
    members = met.join(roots, F.col("key") == F.col("k"), "left").select("grp", "key", F.coalesce("root", "key").alias("label"))
    members = scratch.stored(members, "near-members")
    groups = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("x"), F.max("label").alias("y")).filter("n > 2 and x <> y").select("grp", "n")
    rows = scratch.stored(members.join(groups, "grp"), "near-open")
    small = rows.filter(F.col("n") <= few)
    other = small.select("grp", F.col("key").alias("b"), F.col("label").alias("b_label"))
    pairs = small.join(other, "grp").filter((F.col("key") < F.col("b")) & (F.col("label") != F.col("b_label"))).select(F.col("key").alias("a"), "b")
    large = rows.filter(F.col("n") > few).select("grp", "key", "label")
    pairs = pairs.unionByName(_open_pairs(large, texts, sketched, least, rare)).distinct()
    known = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return first.unionByName(scratch.stored(_scored(pairs.join(known, ["a", "b"], "left_anti"), texts, least), "near-second"))


def components(edges: DataFrame) -> DataFrame:
    """(key, root): the least key of each key's component, over all keys that have a link.

    Each round gives a key the least label among its neighbours' and its own and then that label's own label, so
    long chains shorten by jumps; rounds end when nothing changes.
    """
    both = scratch.stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges")
    labels = scratch.stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "key"), "near-labels")
    while True:
        near = both.join(labels.select(F.col("key").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        hooked = labels.join(near, labels["key"] == near["a"]).select("key", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        jump = labels.select(F.col("key").alias("root"), F.col("root").alias("far"))
        after = scratch.stored(hooked.join(jump, "root", "left").select("key", F.least("root", F.coalesce("far", "root")).alias("root"), "was"), "near-labels")
        if after.filter("root <> was").isEmpty():
            return after.select("key", "root")
        labels = after.select("key", "root")


def _judged(rows: DataFrame, docs: DataFrame, text_col: str, least: float) -> DataFrame:
    """(row, id, class_id, class_size, is_kept) from rows of (row, id, digest, sketches); texts are read from ``docs``."""
    distinct = rows.filter("sketches is not null").groupBy("digest").agg(F.min("row").alias("key"))
    distinct = scratch.stored(distinct, "near-distinct")
    sketched = scratch.stored(rows.join(distinct.select("key").hint("shuffle_hash"), F.col("row") == F.col("key")).select("key", "sketches"), "near-sketches")

    def texts_of(keys: DataFrame) -> DataFrame:
        wanted = scratch.limited(scratch.stored(distinct.join(keys, "key"), "near-wanted"))
        found = docs.select(scratch.digest(F.col(text_col)).alias("digest"), F.col(text_col).alias("text")).join(wanted, "digest")
        return found.groupBy("key").agg(F.first("text").alias("text"))

    roots = components(links(sketched, texts_of, least=least).filter("score > 0")).withColumnRenamed("key", "k")
    named = distinct.join(roots, F.col("key") == F.col("k"), "left").select("digest", F.coalesce("root", "key").alias("root"))
    # the few rows of a digest are summed up before classes are, so that groups of copies send a row for each task
    told = rows.filter("sketches is not null").groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"), F.count(F.lit(1)).alias("n"))
    per_digest = scratch.stored(told.join(named, "digest"), "near-named")
    per_root = per_digest.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    per_digest = per_digest.select("digest", "root").join(per_root, "root").select("digest", F.col("first.id").alias("class_id"), F.col("first.row").alias("kept"), "n")
    alone = F.col("sketches").isNull()
    joined = rows.join(scratch.stored(per_digest, "near-classes"), "digest", "left")
    return joined.select(
        "row", "id", F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, 1).otherwise(F.col("n")).cast("long").alias("class_size"), (alone | (F.col("row") == F.col("kept"))).alias("is_kept")
    )


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(id, class_id, class_size, is_kept) for each row; class_id is the least id of the class."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketched = own.withColumn("digest", scratch.digest(F.col("text"))).mapInArrow(_sketch, f"id {own.schema['id'].dataType.simpleString()}, digest binary, sketches array<long>")
    rows = scratch.stored(sketched.withColumn("row", F.monotonically_increasing_id()), "near-rows")
    found = _judged(rows, own, "text", least)
    return found.select(F.col("id").alias(id_col), "class_id", "class_size", "is_kept")


def dedup_near(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class, that of the least id; rows without words all stay."""
    numbered, number = scratch.numbered(docs)
    own = numbered.select(F.col(number).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketched = own.withColumn("digest", scratch.digest(F.col("text"))).mapInArrow(_sketch, f"row long, id {own.schema['id'].dataType.simpleString()}, digest binary, sketches array<long>")
    gone = _judged(scratch.stored(sketched, "near-rows"), own, "text", least).filter(~F.col("is_kept")).select(F.col("row").alias(number))
    return scratch.without(numbered, gone, number).select(*docs.columns)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(scratch.documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", "is_kept")
