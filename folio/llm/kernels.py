"""Array kernels over batches of whole texts, used inside Arrow tasks.

A batch of texts is one byte buffer with offsets.  Words are byte spans whose bytes a 256-entry table
accepts; no word crosses a text.  Hashes are polynomial prefix sums modulo 2**64, mixed afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are taken together up to about this many bytes; one longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _byte_table(accept) -> np.ndarray:
    return np.array([accept(b) for b in range(256)], bool)


#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` once A-Z are lower-cased.
LETTERS = _byte_table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
#: Word bytes of ``[^\x20\x09-\x0D]``.
VISIBLE = _byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: A-Z to a-z.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def chunks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of runs of rows with about CHUNK_BYTES of text; a null text is empty."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if column.null_count:
            column = column.fill_null("")
        if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            kind = np.int64
        else:
            kind = np.int32
        if not len(column):
            continue
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(column):
            j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK_BYTES, "right")) - 1)
            j = min(j, len(column))
            yield batch.slice(i, j - i), raw[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse."""
    for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
        if len(_powers[name]) < n:
            more = np.full(n, base, np.uint64)
            more[0] = 1
            _powers[name] = np.cumprod(more, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    up, _ = powers(max(len(buf), 1))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans: equal for equal bytes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def word_spans(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets): words of text i are those from word offset i to i + 1."""
    inside = table[buf]
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    edges = offsets[:-1]
    edges = edges[edges < len(buf)]
    before[edges] = False
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words, by its first; runs may cross texts and are the caller's to discard."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    up, _ = powers(n + 1)
    h = np.zeros(m, np.uint64)
    for j in range(n):
        h += words[j : j + m] * up[j + 1]
    return mix(h)


def within(word_offsets: np.ndarray, n: int) -> np.ndarray:
    """The first words of all runs of n words that stay in one text."""
    counts = np.maximum(np.diff(word_offsets) - n + 1, 0)
    if not counts.sum():
        return np.zeros(0, np.int64)
    first = np.repeat(word_offsets[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return first + np.arange(counts.sum())
