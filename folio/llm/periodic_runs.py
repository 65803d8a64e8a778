"""Periodic runs: stretches of words that repeat with a period, found by longest common extensions over a difference cover.

The words of a text become numbers.  A stretch of period p and at least 2p words holds a multiple i of p with all of
``words[i:]`` and ``words[i + p:]`` equal for some way, so all places of the harmonic grid (p, i = kp) are asked how
far the text goes on equally after i and i + p, and before them.  Grid places whose own words differ are turned down
at once, those with few equal words after some comparisons.

A common extension of i and j compares words only up to the next shift at which both are sampled: a difference cover
modulo ``MODULUS`` has one below MODULUS for any two places.  Only sampled suffixes are sorted, by the names of their
blocks of MODULUS words and then by doubling; their neighbours' common prefixes stand in a sparse table, whose range
minimum answers the rest.  A text is sampled only if one of its questions gets that far, and the same is done over the
reversed text for extensions to the left.

A stretch that has period p and a smaller one has one that divides p, with the same ends, so of equal ends the least
period stays.

Work is done text by text inside Arrow tasks, whose memory is that of one text and a bounded part of its grid; nothing
is shuffled.  Defined results: a null or empty text has no words and no runs, and the digest of nothing; a null id
changes no words; rows with equal ids are answered each by itself; an empty table gives an empty one; a very long text
costs n log n grid places; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import scratch

LEAST = 12
#: Residues whose differences take every value modulo MODULUS.
MODULUS = 31
COVER = np.array([1, 5, 11, 24, 25, 27])
#: Grid places that are held at a time.
GRID = 1 << 20
#: Words that a stretch is compared by before it is asked for its whole extension; LEAST // 2 + 1 suits every period.
PROBE = 4
#: Runs of so many words are remembered while the grid is gone through.
LONG = 64
SCHEMA = "id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"

_SAMPLED = np.isin(np.arange(MODULUS), COVER)
#: _SHIFT[a, b]: the least shift that takes residues a and b into the cover together.
_SHIFT = np.array([[next(d for d in range(MODULUS) if _SAMPLED[(a + d) % MODULUS] and _SAMPLED[(b + d) % MODULUS]) for b in range(MODULUS)] for a in range(MODULUS)])


class Extensions:
    """Longest common extensions of two places of one sequence, which ends at a word that stands nowhere else."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.words = np.concatenate([words, [-1]])
        self.table: list[np.ndarray] | None = None

    def _sample(self) -> None:
        n = self.n
        at = np.flatnonzero(_SAMPLED[np.arange(n) % MODULUS])
        index = np.full(n + 1, len(at), np.int64)
        index[at] = np.arange(len(at))
        padded = np.concatenate([self.words[:n], np.full(MODULUS, -1, self.words.dtype)])
        blocks = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, MODULUS)[at].astype(np.int32))
        names = np.unique(blocks.view(np.dtype((np.void, 4 * MODULUS))).ravel(), return_inverse=True)[1].ravel()
        # a name for 2**k blocks from a place on; places beyond the end share the name -1
        levels, step = [names.astype(np.int64)], MODULUS
        while len(levels[-1]) and levels[-1].max() + 1 < len(at) and step < n:
            rank = np.append(levels[-1], -1)
            later = rank[index[np.minimum(at + step, n)]]
            levels.append(np.unique(rank[:-1] * (len(at) + 1) + later + 1, return_inverse=True)[1].ravel())
            step *= 2
        order = np.argsort(levels[-1], kind="stable")
        self.rank = np.empty(len(at), np.int64)
        self.rank[order] = np.arange(len(at))
        self.index = index
        a, b = at[order[:-1]].copy(), at[order[1:]].copy()
        common = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            rank = np.append(levels[k], -1)
            x, y = np.minimum(a + common, n), np.minimum(b + common, n)
            same = (rank[index[x]] == rank[index[y]]) & (np.maximum(x, y) + (MODULUS << k) <= n)
            common[same] += MODULUS << k
        common += self._compared(a + common, b + common, np.full(len(a), MODULUS))
        self.table = [common]
        while 2 << len(self.table) - 1 <= len(common):
            half = 1 << len(self.table) - 1
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def _compared(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, up to ``most``; i differs from j."""
        count = np.zeros(len(i), np.int64)
        open_ = np.flatnonzero((most > 0) & (np.maximum(i, j) < self.n))
        while len(open_):
            x, y = i[open_] + count[open_], j[open_] + count[open_]
            open_ = open_[self.words[np.minimum(x, self.n)] == self.words[np.minimum(y, self.n)]]
            count[open_] += 1
            open_ = open_[(count[open_] < most[open_]) & (np.maximum(i[open_], j[open_]) + count[open_] < self.n)]
        return count

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, for i < j."""
        shift = _SHIFT[i % MODULUS, j % MODULUS]
        count = self._compared(i, j, shift)
        far = np.flatnonzero((count == shift) & (j + shift < self.n))
        if len(far):
            if self.table is None:
                self._sample()
            a, b = (self.rank[self.index[x[far] + shift[far]]] for x in (i, j))
            low, width = np.minimum(a, b), np.abs(a - b)
            level = np.frexp(width.astype(np.float64))[1] - 1  # floor(log2(width)): exact below 2**53
            for k in np.unique(level):
                rows = level == k
                least = self.table[k]
                count[far[rows]] += np.minimum(least[low[rows]], least[low[rows] + width[rows] - (1 << k)])
        return count


def _grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, p) for all periods p up to n / 2 and i = 0, p, 2p ... below n - p, some at a time."""
    p = 1
    while p <= n // 2:
        counts = (n - 1) // np.arange(p, min(n // 2, p + GRID) + 1)
        upto = max(1, int(np.searchsorted(np.cumsum(counts), GRID, "right")))
        counts = counts[:upto]
        for first in range(0, int(counts[0]) if upto == 1 else 1, GRID):  # a period of its own may need several parts
            if upto == 1:
                k = np.arange(first, min(first + GRID, int(counts[0])))
                periods = np.full(len(k), p)
            else:
                periods = np.repeat(np.arange(p, p + upto), counts)
                k = np.arange(len(periods)) - np.repeat(np.cumsum(counts) - counts, counts)
            yield k * periods, periods
        p += upto


def _stretch(words: np.ndarray, i: np.ndarray, p: np.ndarray, side: int) -> np.ndarray:
    """Equal words from i and i + p on to one side, PROBE at most."""
    n, count = len(words), np.zeros(len(i), np.int64)
    going = np.ones(len(i), bool)
    for k in range(PROBE):
        x = i + side * k - (side < 0)
        y = x + p
        going = going & (x >= 0) & (y < n)
        going[going] = words[x[going]] == words[y[going]]
        count += going
    return count


def runs_of(words: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of all runs, by start and then period."""
    n = len(words)
    right, left = Extensions(words), Extensions(words[::-1])
    found = [np.zeros((0, 3), np.int64)]
    # of the long runs found so far, the one that goes on furthest from each word: its end and period
    upto, every = np.zeros(n, np.int64), np.ones(n, np.int64)
    for i, p in _grid(n):
        keep = words[i] == words[i + p]
        i, p = i[keep], p[keep]
        keep = (i + p >= upto[i]) | (p % every[i] > 0)  # else that run is all that can be found here
        i, p = i[keep], p[keep]
        # a run of period p spans p equal pairs and least - p of them, those before and after i together
        few = np.minimum(np.maximum(p, least - p), PROBE)
        keep = _stretch(words, i, p, 1) + _stretch(words, i, p, -1) >= few
        i, p = i[keep], p[keep]
        if not len(i):
            continue
        after = right.of(i, i + p)
        before = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > 0)
        before[inner] = left.of(n - i[inner] - p[inner], n - i[inner])
        length = before + after + p
        keep = length >= np.maximum(least, 2 * p)
        found.append(np.unique(np.stack([i[keep] - before[keep], length[keep], p[keep]], 1), axis=0))
        for start, size, period in found[-1][found[-1][:, 1] >= LONG].tolist():
            further = start + np.flatnonzero(upto[start : start + size] < start + size)
            upto[further], every[further] = start + size, period
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    if len(runs):
        first = np.ones(len(runs), bool)
        first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
        runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Words that stand in a run after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:-1]) > 0


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal ones."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the repetition that the id asks for."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]


def _rows(change):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                doc_id, raw = doc_id.as_py(), (text.as_py() or "").encode()
                words = raw.split()  # bytes are cut at blanks and \x09-\x0D alone
                words = change(words, doc_id) if change else words
                runs = runs_of(numbered(words))
                drop = dropped(len(words), runs)
                kept = b" ".join(w for w, gone in zip(words, drop.tolist(), strict=True) if not gone)
                told = b"".join(b"%d,%d,%d\n" % tuple(r) for r in runs.tolist())
                longest = [None] * 4
                if len(runs):
                    start, length, period = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
                    longest = [start, length, period, 1000 * length // period]
                out.append((doc_id, len(runs), *longest, hashlib.sha256(told).hexdigest(), hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return rows


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", change=None) -> DataFrame:
    """(id, n_runs, the longest run, digests of all runs and of the words that stay) for each row.

    ``change(words, id)`` may alter a text's words before they are looked through.
    """
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_rows(change), SCHEMA).withColumnRenamed("id", id_col)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(scratch.documents(spark, sf_dir), change=planted)
