"""Spelling variants: all pairs of words one edit apart, found in dense tiles of padded code points.

A pair of words of lengths b and b or b + 1 is cut in ``PARTS`` parts of the base length b.  One inserted, deleted or
replaced code point falls into one part, so the words share what stands before that part, counted from the left, and
what stands after it, counted from the right.  Each word is sent to the group of each such key, once for its own length
and once as the longer word of the length below; no pair is looked for outside these groups.

Inside a task the words of its groups are rows of two padded matrices of code points, one aligned left and one right.
Groups are cut into tiles of ``TILE`` words, and pairs of tiles are compared column by column: two words are one edit
apart if their common prefix and common suffix together reach the longer length minus one.  A pair that shares several
keys is told at the first of them only, so each pair comes out once.

Groups over ``BLOCK`` words, such as those of a very common stem, are dealt into blocks by the word's hash, and each
pair of blocks is a group of its own; no group is held that is larger than two blocks.  Nothing but pairs one edit
apart leaves a task.  A word has few of them, as many as there are letters to put in each place.

Defined results: a null text has no words; with a null id no code point is deleted; rows with equal ids or texts are
counted each; among near words of equal counts the least in code-point order is the form; an empty table gives an empty
one; a very long text is exploded like any other; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import scratch

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: One of so many occurrences loses a code point.
ONE_IN = 97
PARTS = 4
TILE = 8
#: Words that a group holds before it is dealt into blocks.
BLOCK = 2048
#: Cells of the matrices of some groups together; a larger group makes its own.
CELLS = 1 << 22
#: Pairs of tiles that are compared at a time.
SLICE = 1 << 14
PAIRS = "a string, a_n long, b string, b_n long"


def lower_ascii(word: Column) -> Column:
    """A-Z in lower case and all else as it is."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def occurrences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word): one row for each occurrence of a word of at least ``least_length`` code points."""
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.char_length("run") >= least_length).select("id", lower_ascii(F.col("run")).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = F.pmod("h", F.char_length("run")).cast("int")
    short = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    runs = runs.filter((F.col("h") % ONE_IN != 0) | F.col("h").isNull() | (F.char_length("run") > least_length))
    return runs.select(F.when(F.col("h") % ONE_IN == 0, short).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that occur often enough."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def places(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(grp, part, base, longer, word, n): a row for each key of each word, both as the shorter and as the longer of a pair."""
    length = F.char_length("word")
    keys = []
    for longer in (0, 1):
        base = (length - longer).cast("int")
        for part in range(parts):
            head, tail = F.floor(base * part / parts).cast("int"), (base - F.floor(base * (part + 1) / parts)).cast("int")
            shared = F.xxhash64(base, F.lit(part), F.substring("word", F.lit(1), head), F.substring("word", length - tail + 1, tail))
            keys.append(F.struct(shared.alias("grp"), F.lit(part).alias("part"), base.alias("base"), F.lit(bool(longer)).alias("longer")))
    return words.select("word", "n", F.explode(F.array(*keys)).alias("k")).select("k.*", "word", "n")


def _blocked(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` with their own block and the pair of blocks (x, y) to which each copy goes; one block for most groups."""
    sizes = scratch.stored(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > block).select("grp", F.ceil(F.col("size") / block).cast("int").alias("blocks")), "spelling-groups")
    dealt = rows.join(scratch.limited(sizes), "grp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, "own").alias("x"), F.greatest(k, "own").alias("y")))
    return dealt.select("grp", "part", "base", "longer", "word", "n", "own", F.explode(others).alias("p")).select("grp", "p.x", "p.y", "part", "base", "longer", "word", "n", "own")


class _Tiles:
    """The words of some groups as padded matrices, and the pairs of tiles inside those groups."""

    def __init__(self, words: list[str], starts: np.ndarray):
        n = len(words)
        wide = np.array(words, dtype=str)
        width = wide.dtype.itemsize // 4
        codes = np.zeros((n + 1, width), np.uint32)  # the last row stands for no word
        codes[:n] = wide.view(np.uint32).reshape(n, width)
        self.lengths = (codes > 0).sum(1)
        from_right = self.lengths[:, None] - 1 - np.arange(width)
        turned = np.where(from_right >= 0, np.take_along_axis(codes, np.maximum(from_right, 0), 1), 0)
        kind = np.uint8 if codes.max(initial=0) < 256 else np.uint32
        self.left, self.right = (np.ascontiguousarray(m.T.astype(kind)) for m in (codes, turned))
        sizes = np.diff(np.append(starts, n))
        tiles = -(-sizes // TILE)
        group = np.repeat(np.arange(len(sizes)), tiles)
        first_tile = np.cumsum(tiles) - tiles
        within = np.arange(len(group)) - first_tile[group]
        cell = within[:, None] * TILE + np.arange(TILE)
        self.rows = np.where(cell < sizes[group][:, None], starts[group][:, None] + cell, n)
        later = tiles[group] - within
        self.u = np.repeat(np.arange(len(group)), later)
        self.v = self.u + np.arange(len(self.u)) - np.repeat(np.cumsum(later) - later, later)

    def common(self, matrix: np.ndarray, p: np.ndarray, q: np.ndarray, width: int) -> np.ndarray:
        going = np.ones((len(p), TILE, TILE), bool)
        count = np.zeros(going.shape, np.uint8 if width < 256 else np.uint32)
        for column in matrix[:width]:
            going &= column[p][:, :, None] == column[q][:, None, :]
            count += going
        return count

    def near(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(row, row, common prefix, common suffix) of all pairs one edit apart."""
        for k in range(0, len(self.u), SLICE):
            p, q = self.rows[self.u[k : k + SLICE]], self.rows[self.v[k : k + SLICE]]
            a, b = self.lengths[p][:, :, None], self.lengths[q][:, None, :]
            shorter, longer = np.minimum(a, b), np.maximum(a, b)
            width = int(longer.max())
            head, tail = (np.minimum(self.common(m, p, q, width), shorter) for m in (self.left, self.right))
            close = (longer - shorter <= 1) & (head + tail >= longer - 1) & (head < longer) & (shorter > 0) & (p[:, :, None] < q[:, None, :])
            t, x, y = np.nonzero(close)
            yield p[t, x], q[t, y], head[t, x, y].astype(np.int64), tail[t, x, y].astype(np.int64)


def _pairs(parts: int):
    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """The pairs of whole groups.  Groups go by the length of their words, so that a long one pads no others."""
        grp, x, y = (rows[c].to_numpy() for c in ("grp", "x", "y"))
        edge = np.ones(len(grp), bool)
        edge[1:] = (grp[1:] != grp[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        starts = np.flatnonzero(edge)
        sizes = np.diff(np.append(starts, len(grp)))
        width = np.maximum.reduceat(rows["base"].to_numpy(), starts) + 1
        several = np.flatnonzero(sizes > 1)
        several = several[np.argsort(width[several], kind="stable")]
        k = 0
        while k < len(several):
            upto = k + 1
            cells = int(sizes[several[k]] * width[several[k]])
            while upto < len(several) and (cells := cells + int(sizes[several[upto]] * width[several[upto]])) <= CELLS and width[several[upto]] <= 2 * width[several[k]]:
                upto += 1
            chosen = several[k:upto]
            own = np.cumsum(sizes[chosen]) - sizes[chosen]
            at = np.repeat(starts[chosen] - own, sizes[chosen]) + np.arange(int(sizes[chosen].sum()))
            yield from compared(rows.take(pa.array(at)), own)
            k = upto

    def compared(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, y, part, base, longer, n, own = (rows[c].to_numpy() for c in ("x", "y", "part", "base", "longer", "n", "own"))
        words = rows["word"].to_pylist()
        for i, j, head, tail in _Tiles(words, starts).near():
            fits = (base[i] == base[j]) & (part[i] == part[j]) & ~(longer[i] & longer[j]) & ((x[i] == y[i]) | (own[i] != own[j]))
            for k in range(parts - 1):  # a pair that shares an earlier key is told there
                before = (head >= base[i] * k // parts) & (tail >= base[i] - base[i] * (k + 1) // parts)
                fits &= ~(before & (k < part[i]))
            i, j = i[fits], j[fits]
            if len(i):
                yield pa.RecordBatch.from_pydict({"a": pa.array([words[k] for k in i]), "a_n": pa.array(n[i]), "b": pa.array([words[k] for k in j]), "b_n": pa.array(n[j])})

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
            last = [rows[c].to_numpy() for c in ("grp", "x", "y")]
            ends = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in last]))
            cut = int(ends[-1]) + 1 if len(ends) else 0
            if cut:
                yield from found(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None and len(held):
            yield from found(held)

    return pairs


def near_pairs(words: DataFrame, *, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """(a, a_n, b, b_n): each pair of distinct words one edit apart, once, from distinct (word, n)."""
    dealt = _blocked(places(words, parts), block)
    return dealt.repartition("grp", "x", "y").sortWithinPartitions("grp", "x", "y").mapInArrow(_pairs(parts), PAIRS)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each row of (word, form): the last word that forms lead to.  Each round doubles the steps taken."""
    found = scratch.stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = scratch.stored(found.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if after.filter("moved").isEmpty():
            return after.select("word", "root")
        found = after.select("word", "root")


def variants(words: DataFrame, *, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of distinct (word, n)."""
    words = scratch.stored(words.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    pairs = near_pairs(words, parts=parts, block=block)
    both = pairs.select(F.explode(F.array(*(F.struct(F.col(x).alias("word"), F.col(f"{x}_n").alias("n"), F.col(y).alias("other"), F.col(f"{y}_n").alias("other_n")) for x, y in ("ab", "ba")))).alias("p")).select("p.*")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"), F.first("n").alias("own"))
    led = -F.col("best.less") >= 2 * F.col("own")
    near = scratch.stored(near.select("word", "n_near", F.when(led, F.col("best.form")).alias("form"), F.when(led, -F.col("best.less")).alias("form_n")), "spelling-near")
    ends = roots(near.filter("form is not null"))
    out = words.join(near, "word", "left").join(ends, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", F.col("form_n").cast("long").alias("form_n"), F.coalesce("root", "word").alias("root"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(counted(occurrences(scratch.documents(spark, sf_dir))))
