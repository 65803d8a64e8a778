"""Fuzzy string scores as Arrow functions, with bounds on shared runs of symbols that spare hopeless pairs.

A ratio is 200 * LCS / (len a + len b).  The partial ratio is the best ratio of the shorter string with any window
of its length in the longer one, or with a shorter window at either end.  The LCS of all windows is computed at
once on rows of bits, one bit for a symbol of the shorter string.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def _lcs(a: str, b: str) -> int:
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & masks.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * _lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _windows_lcs(short: str, long: str) -> np.ndarray:
    """LCS of ``short`` with each of its windows in ``long``, by the window's first place (from 1 - len short on).

    One row of bits for each window, in words of 32 so that sums carry into the upper half.
    """
    n, m = len(long), len(short)
    words = -(-m // 32)
    masks: dict[str, int] = {}
    for i, c in enumerate(short):
        masks[c] = masks.get(c, 0) | 1 << i
    seen = {c: [masks[c] >> (32 * w) & 0xFFFFFFFF for w in range(words)] for c in masks}
    none = [0] * words
    # places before and after the text match nothing, which makes the windows at both ends shorter
    symbols = np.zeros((words, n + 2 * (m - 1)), np.uint64)
    symbols[:, m - 1 : m - 1 + n] = np.array([seen.get(c, none) for c in long], np.uint64).reshape(n, words).T
    count = n + m - 1
    low = np.uint64(0xFFFFFFFF)
    full = np.array([(1 << min(32, m - 32 * w)) - 1 for w in range(words)], np.uint64)
    rows = np.repeat(full[:, None], count, axis=1)
    for t in range(m):
        carry = np.zeros(count, np.uint64)
        for w in range(words):
            u = rows[w] & symbols[w, t : t + count]
            total = rows[w] + u + carry
            carry = total >> np.uint64(32)
            rows[w] = ((total & low) | (rows[w] - u)) & full[w]
    return m - np.bitwise_count(rows).sum(axis=0).astype(np.int64)


class Grams:
    """The runs of 2, 3 and 4 symbols of one text, for asking many shorter strings whether any window can be like them."""

    SIZES = (2, 3, 4)

    def __init__(self, text: str):
        codes = _codes(text)
        self.known = []
        for q in self.SIZES:
            own = self._keys(codes, q)
            self.known.append(np.unique(own, return_inverse=True) if len(own) else (own, own))

    @staticmethod
    def _keys(codes: np.ndarray, q: int) -> np.ndarray:
        """A number for each run; equal runs share it (runs of four and characters far apart may, too)."""
        n = max(len(codes) - q + 1, 0)
        key = np.zeros(n, np.int64)
        for k in range(q):
            key = (key << 16 | key >> 47) ^ codes[k : k + n]
        return key

    def hopeless(self, short: str, threshold: float) -> bool:
        """Whether no window holds enough of the runs of ``short`` to reach a threshold (never in error).

        With an LCS of L in a window of w symbols, the m + w - 2L symbols left out on both sides part the common ones
        into one more stretch than that at most, so L - (q - 1)(m + w - 2L + 1) runs of q symbols are common.
        """
        t, m = threshold / 200.0, len(short)
        codes = None
        for q, (known, at) in zip(self.SIZES, self.known, strict=True):
            share = t - (q - 1) * (1 - 2 * t)
            need = share * (m + m * t / (1 - t)) - (q - 1)
            if share <= 0 or need <= 0 or m < q:
                continue
            codes = _codes(short) if codes is None else codes
            if not len(known):
                return True
            own = np.unique(self._keys(codes, q))
            place = np.minimum(np.searchsorted(known, own), len(known) - 1)
            held = np.zeros(len(known), bool)
            held[place[known[place] == own]] = True
            hits = np.concatenate([[0], np.cumsum(held[at])])
            if float((hits[np.minimum(np.arange(len(hits)) + m - q + 1, len(hits) - 1)] - hits).max()) < need - 1e-9:
                return True
        return False


def best_window(short: str, long: str) -> float:
    m, n = len(short), len(long)
    if not m:
        return 100.0 if not n else 0.0
    if short in long:
        return 100.0
    lcs = _windows_lcs(short, long)
    first = np.arange(len(lcs)) - (m - 1)
    size = np.minimum(first + m, n) - np.maximum(first, 0)
    return float((200.0 * lcs / (m + size)).max())


def partial(a: str, b: str) -> float:
    if len(a) == len(b):
        return max(best_window(a, b), best_window(b, a))
    return best_window(a, b) if len(a) < len(b) else best_window(b, a)


#: The 63 bits of a word; the highest takes what a sum carries.
_LOW = (1 << 63) - 1
#: Pairs that the bound is worked out for at once, and rows of bits of windows that are: both stay in a core's cache.
BLOCK = 8192
ROWS = 1 << 16
#: Characters of texts that are laid out at once.
LAID_OUT = 1 << 22
#: Symbols of the runs that windows are asked for first, and numbers that stand for them; runs may share one.
RUN, KINDS = 3, 1 << 12


class _Pairs:
    """Pairs (short, long) of a batch, numbered by their distinct strings, whose scores are worked out side by side."""

    def __init__(self, shorts: list[str], longs: list[str]):
        self.shorts, self.longs = shorts, longs
        self.m = np.fromiter(map(len, shorts), np.int64, len(shorts))
        self.n = np.fromiter(map(len, longs), np.int64, len(longs))
        self.words = np.maximum(-(-self.m // 63), 1)
        self.starts = np.concatenate([[0], np.cumsum(self.n)])
        letters = sorted(set().union(*shorts)) if shorts else []
        self.kinds = len(letters) + 1
        # 0 stands for all symbols that no short string has
        table = np.zeros(0x110000, np.int32)
        table[[ord(c) for c in letters]] = np.arange(1, self.kinds)
        self.text = table[_codes("".join(longs))]
        self.table = table
        number = {c: i + 1 for i, c in enumerate(letters)}
        #: where each short string's table begins: a row of words of 63 bits for each kind of symbol
        self.base = np.concatenate([[0], np.cumsum(self.words * self.kinds)])
        self.masks = np.zeros(self.base[-1], np.uint64)
        for k, short in enumerate(shorts):
            own: dict[int, int] = {}
            for i, c in enumerate(short):
                own[number[c]] = own.get(number[c], 0) | 1 << i
            first, words = int(self.base[k]), int(self.words[k])
            for c, mask in own.items():
                for w in range(words):
                    self.masks[first + w * self.kinds + c] = mask >> (63 * w) & _LOW

    def _laid_out(self, longs: np.ndarray, before: int, width: int) -> np.ndarray:
        """The symbols of texts in rows of ``width``, from place ``before`` on, with none around them."""
        n = self.n[longs]
        out = np.zeros((len(longs), width), np.int32)
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(np.arange(len(longs)), n), within + before] = self.text[np.repeat(self.starts[longs], n) + within]
        return out

    def _runs(self, symbols: np.ndarray) -> np.ndarray:
        """A number for the run that begins at each place but the last ones."""
        n = max(len(symbols) - RUN + 1, 0)
        key = np.zeros(n, np.uint32)
        for k in range(RUN):
            key = key * np.uint32(self.kinds) + symbols[k : k + n].astype(np.uint32)
        return (key * np.uint32(2654435761) >> np.uint32(20)).astype(np.int16)

    def may_reach(self, s: np.ndarray, x: np.ndarray, threshold: float) -> np.ndarray:
        """Whether some window holds enough of a short string's runs to reach a threshold (never false in error).

        With D edits, the most that the threshold allows, all but RUN * D runs stay, at different places of a window of
        m + D symbols.
        """
        out = np.ones(len(s), bool)
        most = ((100.0 - threshold) * self.m + 1e-6) // 50.0
        need = self.m - RUN + 1 - RUN * most
        order = np.lexsort((x, s))
        order = order[need[s[order]] > 1]
        if not len(order):
            return out
        runs, held, own = self._runs(self.text), np.zeros(KINDS, np.int32), np.zeros(0, np.int16)
        last = -1
        for i in order.tolist():
            k, j = int(s[i]), int(x[i])
            if k != last:
                held[own] = 0
                own = self._runs(self.table[_codes(self.shorts[k])])
                held[own] = 1
                last, size, least = k, int(self.m[k] + most[k]) - RUN + 1, need[k]
            first = int(self.starts[j])
            count = held[runs[first : max(first + int(self.n[j]) - RUN + 1, first)]].cumsum()
            if not len(count) or count[-1] < least:
                out[i] = False
            elif len(count) > size:
                out[i] = count[size - 1] >= least or (count[size:] - count[:-size]).max() >= least
        return out

    def least_edits(self, s: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The fewest insertions, deletions and replacements that make each short string a part of its text (bits of Myers' columns)."""
        out = np.empty(len(s), np.int64)
        order = np.lexsort((x, self.n[x], self.words[s]))
        low, one = np.uint64(_LOW), np.uint64(1)
        at = 0
        while at < len(order):
            words = int(self.words[s[order[at]]])
            some = order[at : at + BLOCK]
            some = some[self.words[s[some]] == words]
            some = some[: max(1, LAID_OUT // max(int(self.n[x[some]].max()), 1))]
            at += len(some)
            texts, row = np.unique(x[some], return_inverse=True)
            width = int(self.n[texts].max())
            columns = np.ascontiguousarray(self._laid_out(texts, 0, width).T)
            base = self.base[s[some]]
            top = ((self.m[s[some]] - 1) % 63).astype(np.uint64)
            edits = self.m[s[some]].copy()
            least = edits.copy()
            pv = np.full((words, len(some)), low, np.uint64)
            mv = np.zeros((words, len(some)), np.uint64)
            for j in range(width):
                symbol = base + columns[j][row]
                carry = up = down = None
                for w in range(words):
                    eq, p, n = self.masks[symbol + w * self.kinds], pv[w], mv[w]
                    xv = eq | n
                    total = (eq & p) + p
                    if carry is not None:
                        total += carry
                    xh = ((total & low) ^ p) | eq
                    ph = n | (~(xh | p) & low)
                    mh = p & xh
                    if w == words - 1:
                        edits += ((ph >> top) & one).view(np.int64)
                        edits -= ((mh >> top) & one).view(np.int64)
                    else:
                        carry = total >> np.uint64(63)
                        over, under = ph >> np.uint64(62), mh >> np.uint64(62)
                    ph, mh = (ph << one) & low, (mh << one) & low
                    if up is not None:
                        ph, mh = ph | up, mh | down
                    if w < words - 1:
                        up, down = over, under
                    pv[w] = mh | (~(xv | ph) & low)
                    mv[w] = ph & xv
                np.minimum(least, edits, out=least)
            out[some] = least
        return out

    def best_windows(self, s: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The best ratio of each short string with a window of its text: all windows of pairs of one length side by side."""
        out = np.empty(len(s))
        order = np.lexsort((self.n[x], self.m[s]))
        low = np.uint64(_LOW)
        at = 0
        while at < len(order):
            m = int(self.m[s[order[at]]])
            some = order[at : at + ROWS]
            some = some[self.m[s[some]] == m]
            some = some[: max(1, int(np.searchsorted(np.arange(1, len(some) + 1) * (self.n[x[some]] + m - 1), ROWS, "right")))]
            at += len(some)
            n = self.n[x[some]]
            count, words = int(n.max()) + m - 1, -(-m // 63)
            # places before and after the text match nothing, which makes the windows at both ends shorter
            symbols = self._laid_out(x[some], m - 1, count + m - 1) + self.base[s[some]][:, None]
            bits = [self.masks[symbols + w * self.kinds] for w in range(words)]
            rows = [np.full((len(some), count), low) for _ in range(words)]
            for t in range(m):
                carry = None
                for w in range(words):
                    r = rows[w]
                    u = r & bits[w][:, t : t + count]
                    total = r + u
                    if carry is not None:
                        total += carry
                    r -= u
                    if words > 1:
                        carry = total >> np.uint64(63)
                        total &= low
                    rows[w] = r | total
            lcs = np.full((len(some), count), m, np.int64)
            for w in range(words):
                lcs -= np.bitwise_count(rows[w] & np.uint64((1 << min(63, m - 63 * w)) - 1))
            first = np.arange(count) - (m - 1)
            size = np.minimum(first + m, n[:, None]) - np.maximum(first, 0)
            ratios = np.where(size > 0, 200.0 * lcs / (m + np.maximum(size, 1)), 0.0)
            out[some] = ratios.max(axis=1)
        return out


def partials(pairs: list[tuple[str, str]], threshold: float = 0.0) -> np.ndarray:
    """The partial ratio of each pair, 0 for those that surely stay below a threshold; the pairs are worked out side by side.

    With D the fewest edits that make the shorter string of m symbols a part of the other, a window of w symbols has
    m + w - 2 LCS >= D, so its ratio is at most 100 (1 - D / (m + w)), and w is at most m.
    """
    out = np.zeros(len(pairs))
    shorts: dict[str, int] = {}
    longs: dict[str, int] = {}
    todo = []
    for i, (a, b) in enumerate(pairs):
        if len(a) > len(b):
            a, b = b, a
        if not a:
            out[i] = 0.0 if b else 100.0
        elif a in b:
            out[i] = 100.0
        else:
            todo.append((i, shorts.setdefault(a, len(shorts)), longs.setdefault(b, len(longs))))
            if len(a) == len(b):
                todo.append((i, shorts.setdefault(b, len(shorts)), longs.setdefault(a, len(longs))))
    if not todo:
        return out
    i, s, x = np.array(todo).T
    batch = _Pairs(list(shorts), list(longs))
    if threshold > 0:
        open_pairs = batch.may_reach(s, x, threshold)
        open_pairs = np.isin(i, i[open_pairs])
        i, s, x = i[open_pairs], s[open_pairs], x[open_pairs]
        open_pairs = 50.0 * batch.least_edits(s, x) <= (100.0 - threshold) * batch.m[s] + 1e-6
        # pairs of one length have two directions, which stay or go together
        open_pairs = np.isin(i, i[open_pairs])
        i, s, x = i[open_pairs], s[open_pairs], x[open_pairs]
    np.maximum.at(out, i, batch.best_windows(s, x))
    return out


#: Characters of strings and texts whose pairs are worked out at once.
BATCH = 1 << 21


@F.pandas_udf(DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    known = (a.notna() & b.notna()).to_numpy()
    pairs = list(zip(a[known], b[known], strict=True))
    size = np.cumsum([len(x) + len(y) for x, y in pairs]) // BATCH if pairs else np.zeros(0, np.int64)
    scores = np.full(len(a), np.nan)
    scores[known] = np.concatenate([np.zeros(0)] + [partials(pairs[lo:hi]) for lo, hi in _runs(size)])
    return pd.Series(scores, dtype="float64").astype("object").where(known, None)


def _runs(numbers: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the runs of equal numbers."""
    cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)] if len(numbers) else [0]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def partial_ratios_from(threshold: float):
    """An Arrow function of (array of strings, text): the partial ratio of each string, 0 for those that surely stay below a threshold.

    A text comes once for all strings that it is compared with.
    """

    @F.pandas_udf(ArrayType(DoubleType()))
    def scores(shorts: pd.Series, texts: pd.Series) -> pd.Series:
        out: list = [None] * len(texts)
        strings = [None if own is None else list(own) for own in shorts]
        texts = texts.tolist()
        known = [i for i, (own, text) in enumerate(zip(strings, texts, strict=True)) if own is not None and text is not None]
        size = np.cumsum([len(texts[i]) + sum(map(len, strings[i])) for i in known]) // BATCH if known else np.zeros(0, np.int64)
        for lo, hi in _runs(size):
            rows = known[lo:hi]
            found = partials([(x, texts[i]) for i in rows for x in strings[i]], threshold)
            at = 0
            for i in rows:
                out[i] = found[at : at + len(strings[i])]
                at += len(strings[i])
        return pd.Series(out, dtype="object")

    return scores


@F.pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    order = lambda x: " ".join(sorted(x.split()))
    return pd.Series([None if x is None or y is None else ratio(order(x), order(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """A native stand-in for the ratio: 100 * (1 - edits / longer length)."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, F.lit(100.0) * (longest - F.levenshtein(a, b)) / longest).otherwise(100.0)
