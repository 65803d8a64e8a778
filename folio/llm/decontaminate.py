"""Benchmark decontamination: a broadcast set of item n-grams is looked up in every training text.

The windows of all benchmark items become a sorted array of 64-bit hashes with the words behind each hash.
The array goes to every task; a task hashes the word windows of its whole texts, looks them up, and compares
the words of each hit, so that no collision counts.  The array is bounded: items are dealt to blocks of at most
``block_windows`` windows, one scan of the texts for each block, and the blocks' hits are merged per row.

Verdicts meet their rows by a key of id and text, so rows with the same id or none are told apart; rows equal in
both have equal verdicts.

Defined results: a null or empty text has no words; an item without words has no window; an item id that is
null counts under the empty string; repeated items count once by id; a repeated document row gives a row each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import kernels
from folio.llm.scratch import documents, stored

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NGRAM = 13
#: Windows of items in one broadcast block; about 200 bytes each in a task.
BLOCK_WINDOWS = 200_000
#: A text is contaminated if at least one word in so many is hit.
HIT_SHARE = 20
_UPPER = re.compile("[A-Z]+")


def item_words(text: str | None) -> list[str]:
    return WORD.findall(_UPPER.sub(lambda m: m[0].lower(), text or ""))


class Windows:
    """The windows of a block of items, ready for lookup."""

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        ids: dict[tuple[str, ...], set[str]] = {}
        for item, text in items:
            words = item_words(text)
            for i in range(max(1, len(words) - n + 1)) if words else ():
                ids.setdefault(tuple(words[i : i + n]), set()).add(item)
        self.by_length: dict[int, tuple[np.ndarray, dict[int, list[tuple[bytes, frozenset[str]]]], np.ndarray]] = {}
        for size in sorted({len(w) for w in ids}):
            found: dict[int, list[tuple[bytes, frozenset[str]]]] = {}
            for words, owners in ids.items():
                if len(words) == size:
                    joined = " ".join(words).encode()
                    buf = np.frombuffer(joined, np.uint8)
                    start, end, _ = kernels.word_spans(buf, np.array([0, len(buf)]), kernels.LETTERS)
                    h = kernels.span_hashes(kernels.prefix_sums(buf), start, end)
                    found.setdefault(int(kernels.window_hashes(h, size)[0]), []).append((joined, frozenset(owners)))
            keys = np.array(sorted(found), np.uint64)
            sieve = np.zeros(1 << 22, bool)
            sieve[(keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
            self.by_length[size] = keys, found, sieve

    def hits(self, words: np.ndarray, start: np.ndarray, end: np.ndarray, per_text: np.ndarray, lower: np.ndarray) -> Iterator[tuple[int, int, frozenset[str]]]:
        """(first word, words, item ids) of each occurrence."""
        for size, (keys, found, sieve) in self.by_length.items():
            h = kernels.window_hashes(words, size)
            maybe = np.flatnonzero(sieve[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
            if not len(maybe):
                continue
            place = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
            for i in maybe[keys[place] == h[maybe]].tolist():
                if per_text[i] != per_text[i + size - 1]:
                    continue
                said = b" ".join(lower[start[k] : end[k]].tobytes() for k in range(i, i + size))
                for text, owners in found[int(h[i])]:
                    if text == said:
                        yield i, size, owners


def _scan(windows: Windows, id_col: str, text_col: str, spans: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offsets in kernels.chunks(batches, text_col):
            lower = kernels.LOWER[raw]
            start, end, words_at = kernels.word_spans(lower, offsets, kernels.LETTERS)
            per_text = np.repeat(np.arange(len(rows)), np.diff(words_at))
            words = kernels.span_hashes(kernels.prefix_sums(lower), start, end)
            hit = np.zeros(len(start) + 1, np.int32)
            items: list[set[str]] = [set() for _ in range(len(rows))]
            for i, size, owners in windows.hits(words, start, end, per_text, lower):
                hit[i] += 1
                hit[i + size] -= 1
                items[per_text[i]] |= owners
            covered = np.cumsum(hit[:-1]) > 0
            at = np.concatenate([[0], np.cumsum(covered)])
            out = {
                id_col: rows.column(rows.schema.get_field_index(id_col)),
                "n_words": pa.array(np.diff(words_at), pa.int64()),
                "n_hit": pa.array(at[words_at[1:]] - at[words_at[:-1]], pa.int64()),
                "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            }
            if spans:
                edges = np.diff(np.concatenate([[0], covered.view(np.int8), [0]]))
                runs: list[list[dict[str, int]]] = [[] for _ in range(len(rows))]
                # a run of hit words ends where its text does
                for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
                    while a < b:
                        t = int(per_text[a])
                        stop = min(b, int(words_at[t + 1]))
                        runs[t].append({"start": int(start[a] - offsets[t]), "end": int(end[stop - 1] - offsets[t])})
                        a = stop
                out["spans"] = pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_pydict(out)

    return scan


def _blocks(benchmark: DataFrame, n: int, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str, str | None]]]:
    """Blocks of items with at most about ``limit`` windows; the items pass the driver one at a time."""
    block: list[tuple[str, str | None]] = []
    size = 0
    for item, text in benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), text_col).toLocalIterator():
        windows = max(1, len(item_words(text)) - n + 1)
        if block and size + windows > limit:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += windows
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = NGRAM, block_windows: int = BLOCK_WINDOWS, spans: bool = False) -> DataFrame:
    """For each row of ``docs``: its id, n_words, n_hit, the items found and, if asked for, the byte spans hit.

    One block of items (the usual case) needs a single scan and no shuffle.  Of more blocks each one's hits are
    stored before the block after the next is read; words that two blocks hit are counted from merged spans.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    counts, places = "n_words long, n_hit long, items array<string>", ", spans array<struct<start:long,end:long>>"
    blocks = _blocks(benchmark, n, item_col, item_text_col, block_windows)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        schema = f"`{id_col}` {kind}, {counts}" + (places if spans else "")
        return docs.select(id_col, text_col).mapInArrow(_scan(Windows(block, n), id_col, text_col, spans), schema)
    key = f"{id_col}_{text_col}_key"  # a name that neither column has
    rows = docs.select(id_col, text_col, _row_key(id_col, text_col).alias(key))
    merged = None
    while block is not None:
        found = rows.select(key, text_col).mapInArrow(_scan(Windows(block, n), key, text_col, True), f"`{key}` string, {counts}{places}")
        found = stored(found.filter("n_hit > 0").select(key, "items", "spans"), "contamination-hits")
        merged = found if merged is None else merged.unionByName(found)
        block, after = after, next(blocks, None)
    merged = merged.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"))
    return rows.join(merged, key, "left").mapInArrow(_recount(id_col, text_col), f"`{id_col}` {kind}, {counts}{places}")


def _row_key(id_col: str, text_col: str):
    return F.concat(F.sha2(F.coalesce(text_col, F.lit("")), 256), F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("")))


def _recount(id_col: str, text_col: str):
    """Joins the spans of several blocks and counts the words inside them."""

    def recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offsets in kernels.chunks(batches, text_col):
            start, _, words_at = kernels.word_spans(raw, offsets, kernels.LETTERS)
            merged, hit = [], []
            for t, spans in enumerate(rows.column(rows.schema.get_field_index("spans")).to_pylist()):
                out: list[dict[str, int]] = []
                for x in sorted(spans or [], key=lambda x: (x["start"], x["end"])):
                    if out and x["start"] <= out[-1]["end"]:
                        out[-1]["end"] = max(out[-1]["end"], x["end"])
                    else:
                        out.append(dict(x))
                own = start[words_at[t] : words_at[t + 1]] - offsets[t]
                hit.append(sum(int(np.searchsorted(own, x["end"]) - np.searchsorted(own, x["start"])) for x in out))
                merged.append(out)
            yield pa.RecordBatch.from_pydict({
                id_col: rows.column(rows.schema.get_field_index(id_col)), "n_words": pa.array(np.diff(words_at), pa.int64()), "n_hit": pa.array(hit, pa.int64()),
                "items": pa.array([sorted(x or []) for x in rows.column(rows.schema.get_field_index("items")).to_pylist()], pa.list_(pa.string())),
                "spans": pa.array(merged, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            })

    return recount


def is_contaminated(share: int = HIT_SHARE):
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: int = HIT_SHARE, **options) -> DataFrame:
    """``docs`` without the rows that are contaminated; all other rows and columns stay as they are.

    Only keys of contaminated rows are joined, by a left anti join.
    """
    key = max(docs.columns, key=len) + "_key"  # a name that no column has
    keyed = docs.withColumn(key, _row_key(id_col, text_col))
    bad = contamination(keyed, benchmark, id_col=key, text_col=text_col, **options).filter(is_contaminated(share))
    return keyed.join(bad.select(key).distinct(), key, "left_anti").select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the hit spans cut out of the text, each row otherwise as it is."""
    key, found_spans = (max(docs.columns, key=len) + x for x in ("_key", "_spans"))  # names that no column has
    keyed = docs.withColumn(key, _row_key(id_col, text_col))
    found = contamination(keyed, benchmark, id_col=key, text_col=text_col, spans=True, **options).filter("n_hit > 0")
    found = found.select(key, F.col("spans").alias(found_spans)).dropDuplicates([key])

    @F.pandas_udf("string")
    def cut(texts, spans):
        def one(text, own):
            if text is None or own is None:
                return text
            raw, out, last = text.encode(), [], 0
            for x in own:
                out.append(raw[last : x["start"]])
                last = x["end"]
            return b"".join([*out, raw[last:]]).decode()

        return texts.combine(spans, one) if len(texts) else texts

    joined = keyed.join(found, key, "left")
    return joined.withColumn(text_col, cut(F.col(text_col), F.col(found_spans))).select(*docs.columns)


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), F.coalesce(is_contaminated(), F.lit(False)).alias("contaminated")
    )


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, least(13, len(w)) as n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as win
       from (select item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as win
       from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
hits as (select doc_id, i, dw.n as n, item_id from dw join bw on dw.win = bw.win and dw.n = bw.n),
covered as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from hits) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, cast(item_id as varchar) as id from hits) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join covered using (doc_id) left join found using (doc_id)
"""
