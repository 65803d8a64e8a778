"""External induced suffix sorting of one shard, with common-prefix values carried through the induction.

Symbols are small integers, so the priority queue of the induction is one first-in first-out run for each symbol:
suffixes are put in by increasing rank, which keeps every run sorted.  Runs beyond a memory budget go to disk, and so
do the arrays of a shard that is larger than it.  A suffix travels as (position, common prefix with the one before it
in its run); the common prefix of two suffixes that are put in one after another is one symbol more than the least
one among the suffixes passed between them.

The order of the leftmost-S suffixes comes from induction on their substrings, then from ranks of their names, which
are doubled until they differ or reach the wanted length; their common prefixes are measured on the text, eight bytes
at a time, and the second induction carries them on.  All values are cut off at ``cap``.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Bytes of arrays, and of queued suffixes, that stay in memory.
BUDGET = 256 << 20
#: Symbols handled at once where a whole array is gone through.
STEP = 1 << 20


class Workspace:
    """Arrays in memory up to a budget, in unlinked temporary files beyond."""

    def __init__(self, budget: int = BUDGET):
        self.left = budget

    def empty(self, n: int, dtype) -> np.ndarray:
        size = max(n, 1) * np.dtype(dtype).itemsize
        if size <= self.left:
            self.left -= size
            return np.empty(n, dtype)
        with tempfile.TemporaryFile() as file:
            file.truncate(size)
            return np.memmap(file, dtype, "r+", shape=(max(n, 1),))[:n]

    def of(self, values: np.ndarray) -> np.ndarray:
        out = self.empty(len(values), values.dtype)
        out[:] = values
        return out


class Runs:
    """First-in first-out runs of (position, common prefix), one for each symbol."""

    def __init__(self, symbols: int, budget: int = BUDGET):
        self.blocks: list[list] = [[] for _ in range(symbols)]
        self.held, self.budget, self.file = 0, budget, None

    def put(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.blocks[symbol].append((pos, lcp))
        self.held += pos.nbytes + lcp.nbytes
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, os.SEEK_END)
        for run in self.blocks:
            for i, (pos, lcp) in enumerate(run):
                if not isinstance(pos, int):
                    at = self.file.tell()
                    self.file.write(np.ascontiguousarray(pos).tobytes())
                    self.file.write(np.ascontiguousarray(lcp).tobytes())
                    run[i] = (at, (len(pos), pos.dtype, lcp.dtype))
        self.held = 0

    def take(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """All that a run holds, which leaves it empty."""
        out = []
        for pos, lcp in self.blocks[symbol]:
            if isinstance(pos, int):
                n, a, b = lcp
                self.file.seek(pos)
                pos = np.frombuffer(self.file.read(n * a.itemsize), a)
                lcp = np.frombuffer(self.file.read(n * b.itemsize), b)
            else:
                self.held -= pos.nbytes + lcp.nbytes
            out.append((pos, lcp))
        self.blocks[symbol] = []
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _range_min(v: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The least of v[start:stop] for each range; ranges are not empty."""
    level = np.frexp((stop - start).astype(np.float64))[1] - 1
    out = np.empty(len(start), v.dtype)
    table, k = v, 0
    while True:
        rows = np.flatnonzero(level == k)
        if len(rows):
            out[rows] = np.minimum(table[start[rows]], table[stop[rows] - (1 << k)])
        k += 1
        if k > (int(level.max()) if len(level) else 0):
            return out
        half = 1 << (k - 1)
        table = np.minimum(table[: len(table) - half], table[half:])


class _Passed:
    """For each symbol the least common prefix among the suffixes passed since its last one; 255 at first use."""

    def __init__(self, symbols: int, cap: int):
        self.least = np.full(symbols, 255, np.uint8)
        self.used = np.zeros(symbols, bool)
        self.cap = cap

    def put(self, lcp: np.ndarray, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Common prefixes for the suffixes put in at places ``at`` (sorted by symbol, then place) of a wave."""
        new = np.ones(len(at), bool)
        new[1:] = symbol[1:] != symbol[:-1]
        start = np.where(new, 0, np.concatenate([[0], at[:-1] + 1]))
        out = _range_min(lcp, start, at + 1) if len(at) else np.zeros(0, np.uint8)
        heads = np.flatnonzero(new)
        s = symbol[heads]
        out[heads] = np.where(self.used[s], np.minimum(out[heads], self.least[s]), 0)
        fresh = heads[~self.used[s]]
        out = np.minimum(out.astype(np.int16) + 1, self.cap).astype(np.uint8)
        out[fresh] = 0
        self.least = np.minimum(self.least, lcp.min()) if len(lcp) else self.least
        tails = np.concatenate([heads[1:] - 1, [len(at) - 1]]).astype(np.int64) if len(at) else np.zeros(0, np.int64)
        s, last = symbol[tails], at[tails]
        rest = np.full(len(tails), 255, np.uint8)
        more = last + 1 < len(lcp)
        if more.any():
            rest[more] = _range_min(lcp, last[more] + 1, np.full(int(more.sum()), len(lcp)))
        self.least[s] = rest
        self.used[s] = True
        return out


def _induce(text: np.ndarray, is_s: np.ndarray, lms: np.ndarray, lms_lcp: np.ndarray | None, symbols: int, cap: int, budget: int):
    """(symbol, L positions, L prefixes, S positions, S prefixes) by falling symbol; S ones in falling order.

    A prefix of an L suffix is that with the one before it in L order, of an S suffix that with the one before
    it in its falling order.  Without ``lms_lcp`` prefixes are not carried.
    """
    carry = lms_lcp is not None
    left = Runs(symbols, budget)
    done_l: list[tuple[np.ndarray, np.ndarray]] = []
    store = Runs(symbols, budget)
    passed = _Passed(symbols, cap)
    bounds = np.searchsorted(text[lms], np.arange(symbols + 1))

    def wave(pos: np.ndarray, lcp: np.ndarray, queue: Runs, want_s: bool) -> None:
        if not len(pos):
            return
        ok = pos > 0
        before = np.where(ok, pos - 1, 0)
        ok &= is_s[before] == want_s
        at = np.flatnonzero(ok)
        before = before[at]
        symbol = text[before]
        order = np.argsort(symbol, kind="stable")
        at, before, symbol = at[order], before[order], symbol[order]
        out = passed.put(lcp, at, symbol) if carry else np.zeros(len(at), np.uint8)
        edges = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1], [True]])) if len(at) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            queue.put(int(symbol[a]), before[a:b], out[a:b])

    last = np.zeros(symbols, np.int64) - 1
    for c in range(symbols):
        while left.blocks[c]:
            pos, lcp = left.take(c)
            store.put(c, pos, lcp)
            last[c] = pos[-1]
            wave(pos, lcp, left, False)
        a, b = int(bounds[c]), int(bounds[c + 1])
        if b > a:
            pos = lms[a:b]
            lcp = lms_lcp[a:b].copy() if carry else np.zeros(b - a, np.uint8)
            if carry:
                lcp[0] = direct_lcp(text, int(last[c]), int(pos[0]), cap) if last[c] >= 0 else 0
            wave(pos, lcp, left, False)
    passed = _Passed(symbols, cap)
    right = Runs(symbols, budget)
    for c in range(symbols - 1, -1, -1):
        s_pos, s_lcp = [], []
        while right.blocks[c]:
            pos, lcp = right.take(c)
            s_pos.append(pos)
            s_lcp.append(lcp)
            wave(pos, lcp, right, True)
        pos, lcp = store.take(c)
        s = np.concatenate(s_pos) if s_pos else np.zeros(0, np.int64)
        if len(pos):
            back = np.empty(len(pos), np.uint8)
            back[1:] = lcp[1:][::-1]
            back[0] = direct_lcp(text, int(pos[-1]), int(s[-1]), cap) if carry and len(s) else 0
            wave(pos[::-1], back, right, True)
        yield c, pos, lcp, s, np.concatenate(s_lcp) if s_lcp else np.zeros(0, np.uint8)


def _s_type(text: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one, from the end on in blocks."""
    out[-1] = True
    for b in range(len(text) - 1, 0, -STEP):
        a = max(0, b - STEP)
        rises = np.sign(text[a + 1 : b + 1].astype(np.int32) - text[a:b].astype(np.int32))
        place = np.where(rises != 0, np.arange(b - a), b - a)
        after = np.minimum.accumulate(place[::-1])[::-1]
        known = np.concatenate([rises > 0, out[b : b + 1]])
        out[a:b] = known[after]
    return out


def direct_lcp(text: np.ndarray, i: int, j: int, cap: int) -> int:
    n = min(cap, len(text) - max(i, j))
    differ = np.flatnonzero(text[i : i + n] != text[j : j + n])
    return int(differ[0]) if len(differ) else n


def _pair_lcp(words: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of pairs of positions; ``words`` holds the four symbols from each position on."""
    out = np.zeros(len(a), np.int64)
    active = np.arange(len(a))
    step = 0
    while len(active) and step < cap:
        x = words[np.minimum(a[active] + step, len(words) - 1)] ^ words[np.minimum(b[active] + step, len(words) - 1)]
        same = x == 0
        x = x[~same]
        part = np.zeros(len(x), np.int64)
        for k in (16, 32, 48):
            part += (x & np.uint64((1 << k) - 1)) == 0
        out[active[~same]] = step + part
        active = active[same]
        step += 4
    out[active] = cap
    return np.minimum(out, cap)


def repeated(parts: np.ndarray, cap: int, budget: int = BUDGET) -> np.ndarray:
    """Whether the suffix at each place shares its first ``cap`` (up to 254) symbols with another suffix.

    ``parts`` are symbols from 1 on; an end symbol 0 is added.
    """
    room = Workspace(budget)
    n = len(parts) + 1
    text = room.empty(n, np.uint16)
    text[:-1] = parts
    text[-1] = 0
    flags = room.empty(n, bool)
    flags[:] = False
    if n <= 2:
        return flags[:-1]
    symbols = int(text.max()) + 1
    is_s = _s_type(text, room.empty(n, bool))
    is_lms = room.empty(n, bool)
    is_lms[0] = False
    is_lms[1:] = is_s[1:] & ~is_s[:-1]
    in_text = np.flatnonzero(is_lms)
    # first induction: substrings in order
    start = in_text[np.argsort(text[in_text], kind="stable")]
    found = []
    for _, _, _, s, _ in _induce(text, is_s, start, None, symbols, cap, budget):
        found.append(s[is_lms[s]])
    order = np.concatenate([in_text[-1:], *(x[::-1] for x in reversed(found))]) if found else in_text[-1:]
    order = order if len(order) == len(in_text) else np.concatenate([in_text[-1:], order[order != in_text[-1]]])
    # names of substrings, by their hashes and lengths
    number = np.searchsorted(in_text, order)
    length = np.diff(np.concatenate([in_text, [n - 1]])) + 1
    hashes = _substring_hashes(text, in_text, np.minimum(in_text + length, n))
    same = np.zeros(len(order), bool)
    same[1:] = (hashes[number][1:] == hashes[number][:-1]) & (length[number][1:] == length[number][:-1])
    rank = np.empty(len(order), np.int64)
    rank[number] = np.cumsum(~same) - 1
    # ranks of names, doubled until they differ or reach the wanted length
    span = 1
    while same.any() and span * 2 <= cap + 2:
        key = rank * (len(rank) + 1)
        key[:-span] += rank[span:] + 1
        by = np.argsort(key, kind="stable")
        same = np.zeros(len(by), bool)
        same[1:] = key[by][1:] == key[by][:-1]
        rank[by] = np.cumsum(~same) - 1
        number = by
        span *= 2
    lms = in_text[number]
    words = room.empty(n, np.uint64)
    words[:] = text
    for i in range(0, n, STEP):
        for k in (1, 2, 3):
            more = text[i + k : i + k + STEP].astype(np.uint64) << np.uint64(16 * k)
            words[i : i + len(more)] |= more
    lcp = np.zeros(len(lms), np.uint8)
    lcp[1:] = _pair_lcp(words, lms[:-1], lms[1:], cap)
    for _, l_pos, l_lcp, s_pos, s_lcp in _induce(text, is_s, lms, lcp, symbols, cap, budget):
        for pos, own in ((l_pos, l_lcp), (s_pos, s_lcp)):
            hit = np.flatnonzero(own >= cap)
            flags[pos[hit]] = True
            flags[pos[hit - 1]] = True
        if len(l_pos) and len(s_pos) and direct_lcp(text, int(l_pos[-1]), int(s_pos[-1]), cap) >= cap:
            flags[l_pos[-1]] = flags[s_pos[-1]] = True
    return flags[:-1]


def _substring_hashes(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of substrings by sums over runs of their own, so that no power grows with the text."""
    out = np.zeros(len(start), np.uint64)
    active = np.arange(len(start))
    step = 0
    while len(active):
        out[active] = (out[active] ^ text[start[active] + step].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out[active] ^= out[active] >> np.uint64(29)
        step += 1
        active = active[start[active] + step < end[active]]
    return out
