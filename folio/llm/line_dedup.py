"""Line dedup: winnowing over hashes of line blocks, joins of positions, and extension of matches both ways.

A block starts at a line with words and goes on to the line in which its ``BLOCK`` words are reached; lines
without words are left out of all this.  Of the blocks that start within ``WINDOW`` words the one with the least
hash is a fingerprint, so any run of lines of BLOCK + WINDOW words or more that two places share has a
fingerprint in common.  Fingerprints that stand at several places are joined with the first of those places, by
(id, line); the matches of two texts are taken together, each is extended line by line both ways, and all runs found
are cut from the later text.
No pair of two later places is ever made, so a passage that stands in a third of all texts costs a row for each.

Narrow columns only take part in the joins: line hashes, word counts and positions.  A first place that many
texts match is joined through salted copies, as many as its matches ask for.

Defined results: a null text stays null; a run within one text is cut where it stands for the second time; a text
may end up empty, and its row stays; rows with equal ids or none are told apart by their texts, and rows equal in
both are one text, cut alike; null ids come first; of equally early places the lesser text digest is the first; a
very long text travels as a hash for each line, and one that repeats a line costs like any other of its length; an empty table gives an empty one; extra columns are kept, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import kernels, periodic_runs, scratch

BLOCK = 25
WINDOW = 25
#: Matches that one copy of a first place serves.
SALT_ROWS = 2000
PRINTS = "array<struct<at:int,h:long>>"


def line_table(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines with words of all texts: (hash, words, start, end, first line of each text), bytes from the buffer's start.

    A line's hash is that of its words, letter case aside; blanks do not count.  End is after the newline.
    """
    lower = kernels.LOWER[raw]
    w_start, w_end, _ = kernels.word_spans(lower, offsets, kernels.VISIBLE)
    breaks = np.flatnonzero(raw == 10) + 1
    bounds = np.unique(np.concatenate([offsets, breaks])) if len(raw) else offsets[:1]
    at = np.searchsorted(w_start, bounds)
    words = np.diff(at)
    has = np.flatnonzero(words > 0)
    h = kernels.span_hashes(kernels.prefix_sums(lower), w_start, w_end)
    up, down = kernels.powers(max(len(h), 1) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
    a, b = at[:-1][has], at[1:][has]
    hashes = kernels.mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
    starts = bounds[:-1][has]
    return hashes, words[has], starts, bounds[1:][has], np.searchsorted(starts, offsets)


def fingerprints(h: np.ndarray, words: np.ndarray, block: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(first lines, block hashes) that winnowing selects from one text's lines."""
    n = len(h)
    before = np.concatenate([[0], np.cumsum(words)])
    end = np.searchsorted(before, before[:-1] + block)  # blocks are lines [i, end)
    m = int(np.searchsorted(end, n, "right"))
    if not m:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = kernels.powers(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:n], dtype=np.uint64)])
    first = np.arange(m)
    own = kernels.mix((sums[end[:m]] - sums[first]) * down[first] + (end[:m] - first).astype(np.uint64))
    stop = np.minimum(np.maximum(np.searchsorted(before, before[:m] + window), first + 1), m)
    # the least block of each window [i, stop), the first one on ties
    best, size = first.copy(), 1
    width = stop - first
    chosen = first.copy()
    levels = [best]
    while size * 2 <= int(width.max()):
        a = levels[-1][: m - 2 * size + 1]
        b = levels[-1][size : m - size + 1]
        levels.append(np.where(own[b] < own[a], b, a))
        size *= 2
    level = np.floor(np.log2(width)).astype(np.int64)
    for k, table in enumerate(levels):
        rows = np.flatnonzero(level == k)
        a, b = table[first[rows]], table[stop[rows] - (1 << k)]
        chosen[rows] = np.where(own[b] < own[a], b, a)
    picked = np.unique(chosen)
    return picked, own[picked]


def _index(text_col: str, block: int, window: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offsets in kernels.chunks(batches, text_col):
            h, words, _, _, first = line_table(raw, offsets)
            prints, at = [], [0]
            values = []
            for a, b in zip(first[:-1], first[1:], strict=True):
                picked, own = fingerprints(h[a:b], words[a:b], block, window)
                prints.append(picked)
                values.append(own)
                at.append(at[-1] + len(picked))
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(prints).astype(np.int32)), pa.array(np.concatenate(values).view(np.int64))], names=["at", "h"])
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64))), pa.ListArray.from_arrays(pa.array(np.array(at, np.int32)), pairs)], names=["id", "key", "lines", "prints"]
            )

    return index


def shared_runs(mine: np.ndarray, theirs: np.ndarray, at: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the lines of ``mine`` around its matches, as far as both texts go on equally; runs that touch are one.

    How far a match goes on is a common extension of two places of both texts' lines in one sequence, so a text with
    as many matches as lines, such as one that repeats a line, costs no more than sorting its lines.
    """
    n = len(mine)
    names = np.unique(np.concatenate([mine, theirs]), return_inverse=True)[1].ravel()
    both = np.concatenate([names[:n], [-2], names[n:]])
    at, there = at.astype(np.int64), there.astype(np.int64)
    after = periodic_runs.Extensions(both).of(at, n + 1 + there)
    before = np.zeros(len(at), np.int64)
    inner = np.flatnonzero((at > 0) & (there > 0))
    last = len(both)
    before[inner] = periodic_runs.Extensions(both[::-1]).of(last - (n + 1 + there[inner]), last - at[inner])
    start, end = at - before, at + after
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    return start[first], end[np.append(first[1:], len(start)) - 1]


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out_key, start, end = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        keys, offsets = batch.column(0).to_pylist(), batch.column(3).to_pylist()
        for key, mine, theirs, offset, ats in zip(keys, batch.column(1), batch.column(2), offsets, batch.column(4), strict=True):
            x, y, ats = (v.values.to_numpy(zero_copy_only=False) for v in (mine, theirs, ats))
            a, b = shared_runs(x, y, ats >> 32, (ats & 0xFFFFFFFF) - offset)
            out_key.extend([key] * len(a))
            start.append(a)
            end.append(b)
        start, end = np.concatenate(start), np.concatenate(end)
        yield pa.RecordBatch.from_pydict({"key": pa.array(out_key, pa.binary()), "start": pa.array(start.astype(np.int32)), "end": pa.array(end.astype(np.int32))})


def repeated_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, window: int = WINDOW) -> DataFrame:
    """(key, runs) for each text with later repeated runs; key is the row's digest and runs are line ranges."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), scratch.row_digest(id_col, text_col).alias("key"), F.coalesce(text_col, F.lit("")).alias("text"))
    index = scratch.stored(rows.mapInArrow(_index("text", block, window), f"id long, key binary, lines array<long>, prints {PRINTS}"), "line-index")
    places = index.select("id", "key", F.explode("prints").alias("x")).select("id", "key", F.col("x.at").alias("at"), F.col("x.h").alias("h"))
    firsts = places.groupBy("h").agg(F.min(F.struct("id", "key", "at")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", F.col("f.id").alias("f_id"), F.col("f.key").alias("f_key"), F.col("f.at").alias("f_at"))
    # read again, the firsts are dealt out for the join alone, where the places of a very common block can be split
    later = places.join(scratch.stored(firsts, "line-firsts"), "h").filter(~(F.col("id").eqNullSafe(F.col("f_id")) & (F.col("key") == F.col("f_key")) & (F.col("at") == F.col("f_at"))))
    # one row for two texts, with the places of all their matches: both texts' lines travel once, however they repeat
    match = F.shiftleft(F.col("at").cast("long"), 32) + F.col("f_at")
    later = later.groupBy("key", "f_key").agg(F.collect_list(match).alias("ats"), F.min(F.col("f_at") - F.col("at")).alias("low"), F.max(F.col("f_at") - F.col("at")).alias("high"))
    later = scratch.stored(later, "line-matches")
    salts = later.groupBy("f_key").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts"))
    lines = index.groupBy("key").agg(F.first("lines").alias("lines"))
    mine = later.join(lines, "key").join(salts, "f_key").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int"))
    theirs = salts.join(lines.withColumnRenamed("key", "f_key"), "f_key").select("f_key", F.col("lines").alias("f_lines"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    # of the first text only the lines that this one's can meet
    offset = F.greatest(F.col("low"), F.lit(0))
    window = F.slice("f_lines", offset + 1, F.col("high") + F.size("lines") - offset)
    pairs = mine.join(theirs, ["f_key", "salt"]).select("key", "lines", window.alias("f_lines"), offset.alias("offset"), "ats")
    runs = pairs.mapInArrow(_extended, "key binary, start int, end int")
    return runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))


def _cut(out_schema: pa.Schema, text_col: str, runs_col: str, made_cols: tuple[str, str]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offsets in kernels.chunks(batches, text_col):
            runs = rows.column(rows.schema.get_field_index(runs_col))
            text = rows.column(rows.schema.get_field_index(text_col))
            texts, lines_cut, words_cut = text.to_pylist(), [0] * len(rows), [0] * len(rows)
            todo = [i for i in range(len(rows)) if runs[i].is_valid]
            if todo:
                _, words, start, end, first = line_table(raw, offsets)
                for i in todo:
                    a, b = int(first[i]), int(first[i + 1])
                    drop = np.zeros(b - a, bool)
                    for r in runs[i].as_py():
                        drop[r["start"] : r["end"]] = True
                    edges = np.zeros(int(offsets[i + 1] - offsets[i]) + 1, np.int64)
                    edges[start[a:b][drop] - offsets[i]] += 1
                    edges -= np.bincount(end[a:b][drop] - offsets[i], minlength=len(edges))
                    keep = np.cumsum(edges[:-1]) == 0
                    left = raw[offsets[i] : offsets[i + 1]][keep].tobytes().decode()
                    texts[i] = left[:-1] if left.endswith("\n") and not texts[i].endswith("\n") else left
                    lines_cut[i], words_cut[i] = int(drop.sum()), int(words[a:b][drop].sum())
            made = {text_col: pa.array(texts, pa.string()), **{c: pa.array(n, pa.int64()) for c, n in zip(made_cols, (lines_cut, words_cut), strict=True)}}
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else rows.column(rows.schema.get_field_index(f.name)).cast(f.type) for f in out_schema], schema=out_schema)

    return cut


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, window: int = WINDOW, counts: bool = False) -> DataFrame:
    """``docs`` with later repeated runs cut out of the texts; with ``counts``, also lines_cut and words_cut."""
    from pyspark.sql.pandas.types import to_arrow_schema

    own, key, runs_col, lines_cut, words_cut = (scratch.fresh(n, *docs.columns) for n in ("own_digest", "run_digest", "runs", "lines_cut", "words_cut"))
    runs = repeated_runs(docs, id_col=id_col, text_col=text_col, block=block, window=window).select(F.col("key").alias(key), F.col("runs").alias(runs_col))
    keyed = docs.withColumn(own, scratch.row_digest(id_col, text_col))
    joined = keyed.join(runs.hint("shuffle_hash"), F.col(own) == F.col(key), "left").drop(own, key)
    schema = docs.select("*", F.lit(0).cast("long").alias(lines_cut), F.lit(0).cast("long").alias(words_cut)).schema
    out = joined.mapInArrow(_cut(to_arrow_schema(schema), text_col, runs_col, (lines_cut, words_cut)), schema)
    return out if counts else out.drop(lines_cut, words_cut)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(scratch.documents(spark, sf_dir), counts=True)
    return found.select("doc_id", "lines_cut", "words_cut", F.octet_length("text").cast("long").alias("kept_bytes"), F.sha2("text", 256).alias("kept_sha256"), "text")
