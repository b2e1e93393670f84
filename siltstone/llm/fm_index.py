"""An FM-index over a sequence of symbols, built and searched with numpy.

The suffixes are sorted by packed runs of symbols, then by prefix doubling of
the runs that tie. The Burrows-Wheeler transform is held as a wavelet matrix
with rank counts; a pattern is searched backwards for all patterns at once, and
its places are found by stepping back to the nearest sampled suffix.
"""

from __future__ import annotations

import numpy as np

#: Symbols below this are reserved: 0 ends the sequence, 1 parts its texts.
FIRST_SYMBOL = 2
_ONE = np.uint64(1)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The sorted suffixes of s, whose last symbol is 0 and occurs once."""
    n = len(s)
    place = np.int32 if n < 1 << 30 else np.int64  # a place and as many steps more fit
    bits = max(1, int(s.max()).bit_length())
    h = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(h):
        key <<= bits
        key[: max(n - j, 0)] |= s[j:]
    order = np.argsort(key).astype(place)
    head = np.empty(n, bool)
    head[0] = True
    key = key[order]
    np.not_equal(key[1:], key[:-1], out=head[1:])
    del key
    # A group is ranked by its first slot; only groups of several are sorted on.
    rank = np.full(n + 1, -1, place)
    at = np.flatnonzero(head).astype(place)
    size = np.diff(np.append(at, n))
    group = np.repeat(at, size)
    rank[order] = group
    slots = np.flatnonzero(np.repeat(size > 1, size))
    while len(slots):
        who = order[slots]
        pair = group[slots].astype(np.int64)
        pair *= n + 1
        pair += rank[np.minimum(who + h, n)] + 1
        by = np.argsort(pair)
        who, pair = who[by], pair[by]
        order[slots] = who
        fresh = np.empty(len(slots), bool)
        fresh[0] = True
        np.not_equal(pair[1:], pair[:-1], out=fresh[1:])
        del by, pair
        at = np.flatnonzero(fresh)
        size = np.diff(np.append(at, len(slots)))
        group[slots] = np.repeat(slots[at], size)
        rank[who] = group[slots]
        slots = slots[np.repeat(size > 1, size)]
        h *= 2
    return order


class WaveletMatrix:
    """Ranks of symbols in a sequence: per bit plane, its bits in words of 64 and the ones before each word."""

    def __init__(self, s: np.ndarray, bits: int) -> None:
        self.bits, self.n = bits, len(s)
        self.planes: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(bits):
            bit = ((s >> (bits - 1 - level)) & 1).astype(bool)
            plane = np.zeros(self.n // 64 + 1, "<u8")
            plane.view(np.uint8)[: -(-self.n // 8)] = np.packbits(bit, bitorder="little")
            before = np.zeros(len(plane), np.int64)
            np.cumsum(np.bitwise_count(plane[:-1]), out=before[1:])
            self.planes.append(plane)
            self.before.append(before)
            self.zeros.append(self.n - int(bit.sum()))
            s = np.concatenate([s[~bit], s[bit]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """The ones of a plane before the given places."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[level][word] + np.bitwise_count(self.planes[level][word] & ((_ONE << bit) - _ONE))

    def walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where place ``at`` ends up on the way down for the given symbols."""
        for level in range(self.bits):
            ones = self._ones(level, at)
            bit = (symbols >> (self.bits - 1 - level)) & 1
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return at

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at the given places, and where those places end up."""
        symbols = np.zeros(len(at), np.int64)
        for level in range(self.bits):
            ones = self._ones(level, at)
            bit = ((self.planes[level][at >> 6] >> (at & 63).astype(np.uint64)) & _ONE).astype(np.int64)
            symbols = symbols * 2 + bit
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return symbols, at


class FMIndex:
    """Counts and places of patterns in a sequence of symbols from ``FIRST_SYMBOL`` on."""

    def __init__(self, s: np.ndarray, every: int = 8) -> None:
        """s: symbols, ended by the only 0. every: one in so many suffixes keeps its place."""
        n = len(s)
        sa = suffix_array(s)
        sigma = int(s.max()) + 1
        self.n, self.every = n, every
        self.first = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(s, minlength=sigma), out=self.first[1:])
        self.tree = WaveletMatrix(s[sa - 1].astype(np.int32), max(1, (sigma - 1).bit_length()))
        self.base = self.tree.walk(np.arange(sigma), np.zeros(sigma, np.int64))
        marked = sa % every == 0
        self.marked = marked
        self.mark_rank = np.cumsum(marked, dtype=sa.dtype) - 1
        self.sampled = sa[marked]

    def _back(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.first[symbols] + self.tree.walk(symbols, at) - self.base[symbols]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """patterns: one row each, all of one length. Returns the rows that occur, and their ranges of suffixes."""
        who = np.flatnonzero((patterns < len(self.first) - 1).all(1))  # other symbols don't occur
        lo, hi = np.zeros(len(who), np.int64), np.full(len(who), self.n, np.int64)
        for j in reversed(range(patterns.shape[1])):
            symbols = patterns[who, j]
            lo, hi = self._back(symbols, lo), self._back(symbols, hi)
            some = lo < hi
            who, lo, hi = who[some], lo[some], hi[some]
            if not len(who):
                break
        return who, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places in the sequence of the given suffixes, by steps back to sampled ones."""
        out = np.empty(len(rows), np.int64)
        open_, at, steps = np.arange(len(rows)), rows, 0
        while len(open_):
            found = self.marked[at]
            out[open_[found]] = self.sampled[self.mark_rank[at[found]]] + steps
            open_, at = open_[~found], at[~found]
            if len(open_):
                symbols, end = self.tree.access(at)
                at = self.first[symbols] + end - self.base[symbols]
                steps += 1
        return out


def numbers(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [lo, hi)."""
    size = hi - lo
    out = np.repeat(lo - (np.cumsum(size) - size), size)
    out += np.arange(len(out))
    return out


def expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [lo, hi), and of which range each is."""
    return numbers(lo, hi), np.repeat(np.arange(len(lo)), hi - lo)
