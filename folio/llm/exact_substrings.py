"""Removal of repeated byte strings by suffix sorting in shards.

Every string of ``LENGTH`` bytes holds k-grams, of which the one with the least hash (the first on ties) is its
anchor.  Equal strings have equal anchors at equal offsets, so the strings that share an anchor can be compared
apart from all others.  Strings that start one after another and have one anchor form a piece; pieces of anchors
that stand at two or more places are dealt to shards by anchor.  Equal pieces travel once, with their count, and
an anchor whose pieces are all equal needs no sorting, as all its strings are repeated.

In a shard an external induced sort (module ``suffix``) finds every start whose suffix shares LENGTH bytes with
another one.  Those starts, and all starts of a piece that stands more than once, are repeated strings; their bytes
are removed from every text that they stand in, judged on the input.

Two scans of the texts find the anchors; texts meet a shuffle only where they are cut or give pieces to a shard.
Defined results: a null text is empty; matches never cross texts; a row that is there twice repeats
all its strings; rows with equal ids or none are told apart by their texts; a very long text is gone through in parts
that overlap by a string; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import kernels, scratch, suffix

LENGTH = 200
ANCHOR = 48
#: Bytes of pieces that a shard holds about; more shards are made for more pieces.
SHARD_BYTES = 4 << 20
_PLACE = np.uint64((1 << 24) - 1)
#: A text is gone through in parts of at most so many starts, which fits the 24 bits for a place.
_PART = 1 << 22
_NOT_PLACE = ~_PLACE


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` keys in a row."""
    out, size = keys, 1
    while size * 2 <= width:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def pieces(raw: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, piece hash, first start, starts) of one buffer's pieces."""
    m = len(raw) - length + 1
    if m <= 0:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none
    sums = kernels.prefix_sums(raw)
    at = np.arange(len(raw) - anchor + 1)
    grams = kernels.span_hashes(sums, at, at + anchor)
    place = _least((grams & _NOT_PLACE) | at.astype(np.uint64), length - anchor + 1) & _PLACE
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.concatenate([first, [m]]))
    where = place[first].astype(np.int64)
    own = kernels.span_hashes(sums, first, first + count + length - 1) ^ kernels.mix((where - first).astype(np.uint64))
    return grams[where], own, first, count


def _texts(batches: Iterator[pa.RecordBatch], length: int):
    """(row number in its batch of rows, rows, bytes, offset of the first byte) of parts of texts."""
    for rows, raw, offsets in kernels.chunks(batches, "text"):
        for i in range(len(rows)):
            text = raw[offsets[i] : offsets[i + 1]]
            for a in range(0, max(len(text) - length + 1, 1), _PART):
                yield rows, i, text[a : a + _PART + length - 1], a


def _scan(length: int, anchor: int, only_anchors: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        names: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            anchors, own, first, count, owner = (np.concatenate([x[k] for x in held]) for k in range(5))
            if only_anchors:
                order = np.argsort(anchors, kind="stable")
                anchors, own = anchors[order], own[order].view(np.int64)
                at = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
                n = np.diff(np.concatenate([at, [len(anchors)]]))
                return pa.RecordBatch.from_pydict({
                    "anchor": pa.array(anchors[at].view(np.int64)), "n": pa.array(n.astype(np.int64)), "low": pa.array(np.minimum.reduceat(own, at)), "high": pa.array(np.maximum.reduceat(own, at)),
                })
            return pa.RecordBatch.from_pydict({
                "anchor": pa.array(anchors.view(np.int64)), "piece": pa.array(own.view(np.int64)), "key": pa.array(names, pa.binary()).take(pa.array(owner)), "first": pa.array(first), "starts": pa.array(count.astype(np.int32)),
            })

        for rows, i, text, a in _texts(batches, length):
            anchors, own, first, count = pieces(text, length, anchor)
            if len(anchors):
                held.append((anchors, own, first + a, count, np.full(len(anchors), len(names), np.int32)))
                names.append(b"" if only_anchors else rows.column(0)[i].as_py())
                size += len(anchors)
            if size > 200_000:
                yield out()
                held, names, size = [], [], 0
        if held:
            yield out()

    return scan


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the pieces that a text stands for."""
    for batch in batches:
        for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
            raw, wanted = text.as_py().encode(), wanted.as_py()
            yield pa.RecordBatch.from_pydict({
                "anchor": pa.array([x["anchor"] for x in wanted], pa.int64()), "piece": pa.array([x["piece"] for x in wanted], pa.int64()), "n": pa.array([x["n"] for x in wanted], pa.int64()),
                "bytes": pa.array([raw[x["first"] : x["first"] + x["size"]] for x in wanted], pa.binary()),
            })


def _sort_shard(length: int):
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Starts of repeated strings in each piece of a shard, as ranges."""
        room = suffix.Workspace()
        parts, heads, counts, sizes = [], [], [], []
        for batch in batches:
            column = batch.column(3)
            _, offsets, data = column.buffers()
            at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if len(column) else np.zeros(0, np.uint8)
            own = np.diff(at)
            # each piece is followed by a symbol that no byte has
            spread = room.empty(len(raw) + len(own), np.uint16)
            spread[:] = 1
            spread[np.arange(len(raw)) + np.repeat(np.arange(len(own)), own)] = raw.astype(np.uint16) + 2
            parts.append(spread)
            sizes.append(own)
            heads.append((batch.column(0), batch.column(1)))
            counts.append(batch.column(2).to_numpy())
        if not parts:
            return
        flags = suffix.repeated(np.concatenate(parts), length)
        at = 0
        for (anchors, own, n), size in zip(((*h, c) for h, c in zip(heads, counts, strict=True)), sizes, strict=True):
            ranges = []
            for k, s in enumerate(size.tolist()):
                hit = np.ones(s - length + 1, bool) if n[k] > 1 else flags[at : at + s - length + 1]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                ranges.append([{"start": int(a), "stop": int(b)} for a, b in edges.reshape(-1, 2)])
                at += s + 1
            yield pa.RecordBatch.from_pydict({"anchor": anchors, "piece": own, "ranges": pa.array(ranges, RANGES)})

    return sort


RANGES = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def repeated_ranges(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """((key, ranges) of texts with repeated strings, by their starts; (key, text) of all texts that hold an anchor twice found)."""
    spark = docs.sparkSession
    rows = docs.select(scratch.row_digest(id_col, text_col).alias("key"), F.coalesce(text_col, F.lit("")).alias("text"))
    counted = docs.select(F.lit(0).alias("key"), F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(_scan(length, anchor, True), "anchor long, n long, low long, high long")
    anchors = counted.groupBy("anchor").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    twice = scratch.stored(anchors.filter("n > 1").select("anchor", (F.col("low") != F.col("high")).alias("differ")), "suffix-anchors")
    found = rows.mapInArrow(_scan(length, anchor, False), "anchor long, piece long, key binary, first long, starts int")
    places = scratch.stored(found.join(twice, "anchor"), "suffix-places")
    own = places.filter("differ").groupBy("anchor", "piece").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "first", "starts")).alias("x"))
    own = own.select("anchor", "piece", "n", "x.key", "x.first", (F.col("x.starts") + length - 1).alias("size"))
    wanted = own.groupBy("key").agg(F.collect_list(F.struct("anchor", "piece", "n", "first", "size")).alias("wanted"))
    wanted = scratch.stored(places.select("key").distinct().join(wanted, "key", "left"), "suffix-wanted")
    texts = scratch.stored(rows.join(wanted.hint("shuffle_hash"), "key"), "suffix-texts")
    cut = texts.filter("wanted is not null")
    cut = (cut.dropDuplicates(["key"]) if _repeats(texts) else cut).select("text", "wanted")
    cut = cut.mapInArrow(_slices, "anchor long, piece long, n long, bytes binary")
    size = wanted.select(F.sum(F.aggregate("wanted", F.lit(0).cast("long"), lambda s, x: s + x["size"]))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    ranges = scratch.stored(cut.repartition(shards, "anchor").mapInArrow(_sort_shard(length), "anchor long, piece long, ranges array<struct<start:long,stop:long>>").filter(F.size("ranges") > 0), "suffix-ranges")
    sorted_ = places.filter("differ").join(ranges, ["anchor", "piece"]).select("key", F.transform("ranges", lambda r: F.struct((r["start"] + F.col("first")).alias("start"), (r["stop"] + F.col("first")).alias("stop"))).alias("ranges"))
    equal = places.filter("not differ").select("key", F.array(F.struct(F.col("first").alias("start"), (F.col("first") + F.col("starts")).alias("stop"))).alias("ranges"))
    return sorted_.unionByName(equal).groupBy("key").agg(F.flatten(F.collect_list("ranges")).alias("ranges")), texts.select("key", "text")


def _repeats(texts: DataFrame) -> bool:
    """Whether a key stands in more than one row, as rows equal in id and text share it."""
    return not texts.groupBy("key").count().filter("count > 1").isEmpty()


def _merged(ranges: list[dict[str, int]], length: int) -> list[tuple[int, int]]:
    """Byte ranges covered by strings that start in the given ranges."""
    out: list[list[int]] = []
    for r in sorted((x["start"], x["stop"] + length - 1) for x in ranges):
        if out and r[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r[1])
        else:
            out.append(list(r))
    return [(a, b) for a, b in out]


def _cut(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, ranges in zip(*(batch.column(i) for i in range(3)), strict=True):
                raw, spans = text.as_py().encode(), _merged(ranges.as_py(), length)
                kept = b"".join(raw[b:a] for b, a in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(raw)], strict=True))
                yield pa.RecordBatch.from_pydict({"key": pa.array([key.as_py()], pa.binary()), "spans": pa.array([[{"start": a, "stop": b} for a, b in spans]], RANGES), "kept": pa.array([kept], pa.binary())})

    return cut


def cut_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """(key, spans, kept) of each text that loses bytes: byte ranges removed and the bytes that are left."""
    ranges, texts = repeated_ranges(docs, id_col=id_col, text_col=text_col, length=length, **options)
    return texts.join(ranges.hint("shuffle_hash"), "key").select("key", "text", "ranges").mapInArrow(_cut(length), "key binary, spans array<struct<start:long,stop:long>>, kept binary")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scratch.documents(spark, sf_dir)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    cut = cut_repeats(docs).select(F.col("key").alias("k"), removed.alias("removed"), F.size("spans").cast("long").alias("spans"), F.sha2("kept", 256).alias("digest")).dropDuplicates(["k"])
    text = F.coalesce("text", F.lit(""))
    whole = docs.select("doc_id", scratch.row_digest("doc_id", "text").alias("key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("own"))
    return whole.join(cut, F.col("key") == F.col("k"), "left").select(
        "doc_id", "n_bytes", F.coalesce("removed", F.lit(0)).alias("n_removed"), F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("digest", "own").alias("kept_sha256")
    )


ORACLE = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
s as (select doc_id, i, substr(h, cast(2 * i + 1 as integer), 400) as w from (select doc_id, h, unnest(range(0, n - 199)) as i from d where n >= 200)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by md5(w)) as c from s) where c > 1),
marked as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 200 then 0 else 1 end as new from twice),
runs as (select doc_id, i, sum(new) over (partition by doc_id order by i) as run from marked),
spans as (select doc_id, run, min(i) as a, max(i) + 200 as b from runs group by doc_id, run),
gaps as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from spans),
kept as (select g.doc_id, count(*) as n_spans, sum(b - a) as n_removed, string_agg(substr(h, cast(2 * before + 1 as integer), cast(2 * (a - before) as integer)), '' order by a) as front, max(b) as last from gaps g join d using (doc_id) group by g.doc_id)
select d.doc_id, cast(n as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
       sha256(unhex(case when last is null then h else concat(front, substr(h, cast(2 * last + 1 as integer))) end)) as kept_sha256
from d left join kept using (doc_id)
"""
