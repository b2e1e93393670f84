"""Words of many texts at once: numpy over the UTF-8 bytes of an Arrow column.

A batch is one byte buffer and the offsets of its texts. Words are found with a
byte table, hashed with a polynomial modulo 2**64 through prefix sums, and every
rolling window of words gets a hash the same way, so no Python loop runs over
words. Memory is a few times the size of a slice, which holds about ``SLICE``
bytes of whole texts (a longer text is a slice of its own).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute

SLICE = 2 << 20
_PIECE = 1 << 16
_U = np.uint64

#: True for the bytes that separate words: space and \t \n \v \f \r.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: True for the bytes outside 0-9, a-z and non-ASCII characters.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[0x30:0x3A] = False
NOT_ALNUM[0x61:0x7B] = False
NOT_ALNUM[0x80:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

BYTE_BASE = 0x9E3779B97F4A7C15
BASE_A = 0xD6E8FEB86659FD93
BASE_B = 0xA0761D6478BD642F


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def need(self, n: int) -> None:
        if n <= len(self.up):
            return
        n = max(n, 1 << 16, 2 * len(self.up))
        for name, b in (("up", self.base), ("down", self.inverse)):
            a = np.full(n, b, _U)
            a[0] = 1
            setattr(self, name, np.multiply.accumulate(a))


_POWERS: dict[int, _Powers] = {}


def powers(base: int, n: int) -> _Powers:
    p = _POWERS.setdefault(base, _Powers(base))
    p.need(n)
    return p


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (the finaliser of MurmurHash3)."""
    h = h ^ (h >> _U(33))
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


@dataclass
class Words:
    """Words of a slice. ``first[d]`` to ``first[d + 1]`` are those of text d."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1, dtype=np.int32), self.counts)

    def hashes(self) -> np.ndarray:
        """A mixed 64-bit hash of each word's bytes."""
        out = np.empty(len(self.starts), _U)
        lo = 0
        while lo < len(out):
            hi = max(lo + 1, int(np.searchsorted(self.ends, self.starts[lo] + _PIECE, "right")))
            a, b = int(self.starts[lo]), int(self.ends[hi - 1])
            p = powers(BYTE_BASE, b - a)
            sums = np.empty(b - a + 1, _U)
            sums[0] = 0
            np.cumsum((self.buf[a:b].astype(_U) + _U(1)) * p.up[: b - a], out=sums[1:])
            s, e = self.starts[lo:hi] - a, self.ends[lo:hi] - a
            out[lo:hi] = (sums[e] - sums[s]) * p.down[s]
            lo = hi
        return mix(out)


def find_words(buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> Words:
    """Maximal runs of bytes that ``separators`` doesn't mark; none spans two texts."""
    inside = np.zeros(len(buf) + 1, bool)
    np.logical_not(separators[buf], out=inside[:-1])
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(buf) + 1, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    return Words(buf, starts, ends, np.searchsorted(starts, offsets))


def rolling(h: np.ndarray, k: int, base: int = BASE_A) -> np.ndarray:
    """A mixed hash of each run of k consecutive word hashes (texts not respected)."""
    n = len(h)
    if n < k:
        return np.empty(0, _U)
    p = powers(base, n + 1)
    sums = np.empty(n + 1, _U)
    sums[0] = 0
    np.cumsum(h * p.up[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * p.down[: n - k + 1])


def whole_windows(w: Words, k: int) -> np.ndarray:
    """The positions at which k consecutive words of one text start."""
    n = len(w.starts)
    if n < k:
        return np.empty(0, np.int64)
    last = np.repeat(w.first[1:], w.counts)[: n - k + 1]
    return np.flatnonzero(np.arange(k, n + 1) <= last)


def spans(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """True for the positions below n that any run [start, start + length) covers."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + lengths, n), -1)
    return np.cumsum(d[:-1]) > 0


def give_back() -> None:
    """Return what Arrow and the C library keep of freed memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that a task makes; at its end the worker, which waits for other tasks, keeps no freed memory."""
    try:
        yield from batches
    finally:
        give_back()


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column (null as empty) and the n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def sliced(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE) -> Iterator[pa.Table]:
    """The rows again, in tables of whole texts that hold about ``limit`` bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo, base = 0, 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(ends, base + max(limit - size, 0), "right"))
            if hi == lo and not held:
                hi = lo + 1
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
                size += int(ends[hi - 1]) - base
                lo, base = hi, int(ends[hi - 1])
            if lo < batch.num_rows or size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
