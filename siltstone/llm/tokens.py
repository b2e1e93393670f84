"""Token ids of many texts with a public tokenizer, each distinct chunk encoded once.

A text is cut where the tokenizer's own pre-splitting always cuts, so the ids of
a text are those of its chunks in a row. Chunks are found with numpy, and their
ids kept in a table from 64-bit chunk hashes to ids that a Python worker holds
on to; only chunks it hasn't seen go through the ``tokenizers`` library.
"""

from __future__ import annotations

import functools
import os

import numpy as np

from .fm_index import numbers
from .words import SPACES, Words, find_words

#: Chunks that a worker remembers at most; beyond, it starts afresh.
REMEMBER = 2_000_000

#: First bytes of the UTF-8 forms of Unicode's white space outside ASCII.
_MAYBE_SPACE = (0xC2, 0xE1, 0xE2, 0xE3)

_LETTER = np.zeros(256, bool)  # of ASCII
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_MARK = np.zeros(256, bool)  # ASCII characters that are neither letters, digits, white space nor controls
_MARK[0x21:0x7F] = True
_MARK[0x30:0x3A] = False
_MARK &= ~_LETTER


def _after_letters(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray) -> Words:
    """Chunks, cut once more between an ASCII letter and an ASCII mark after it.

    Both tokenizers' patterns end a run of letters there, whatever follows, and
    go on matching at the mark. Words then have one chunk whether or not a comma
    follows them.
    """
    inner = np.flatnonzero(_LETTER[buf[:-1]] & _MARK[buf[1:]]) + 1 if len(buf) else np.empty(0, np.int64)
    if not len(starts):
        return Words(buf, starts, ends, np.searchsorted(starts, offsets))
    inner = inner[starts[np.searchsorted(starts, inner, "right") - 1] != inner]  # not where a text begins
    at = np.searchsorted(starts, inner)
    starts, ends = np.insert(starts, at, inner), np.insert(ends, at - 1, inner)
    return Words(buf, starts, ends, np.searchsorted(starts, offsets))


def spaced_chunks(buf: np.ndarray, offsets: np.ndarray) -> Words:
    """Chunks for byte-level BPE: a space belongs to the word that follows it.

    A cut is made before a space, and before and after a line feed, that stands
    alone between other characters. What follows must not be white space: it is
    ASCII, or its first byte is not one that a Unicode space starts with. Before
    a space it is enough that an ASCII character other than white space stands
    in front. Longer runs of white space stay inside a chunk.
    """
    n = len(buf)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    if n > 2:
        inner = ~cut[1 : n - 1] & ~cut[2:n]  # the byte and the one after aren't first in a text
        before, here, after = buf[:-2], buf[1:-1], buf[2:]
        after_solid = ~SPACES[after]
        after_sure = after_solid & ~np.isin(after, _MAYBE_SPACE)
        alone = inner & ~SPACES[before]
        space = alone & (here == 0x20) & (after_sure | (after_solid & (before < 0x80)))
        feed = alone & (here == 0x0A) & after_sure
        cut[1 : n - 1] |= space | feed
        cut[2:n] |= feed
    cut[n] = False
    starts = np.flatnonzero(cut)
    if n == 0:
        starts = starts[:0]
    ends = np.append(starts[1:], n) if len(starts) else starts
    return _after_letters(buf, starts, ends, offsets)


def bare_chunks(buf: np.ndarray, offsets: np.ndarray) -> Words:
    """Chunks for tokenizers that drop white space and case: runs without ASCII white space.

    A-Z is lower-cased here, so that a word has one chunk, unless what follows is
    not ASCII: it may be a combining mark, and composing comes before lower case.
    """
    if len(buf):
        small = buf.copy()
        upper = np.flatnonzero((buf[:-1] >= 0x41) & (buf[:-1] <= 0x5A) & (buf[1:] < 0x80))
        small[upper] += 32
        buf = small
    w = find_words(buf, offsets, SPACES)
    return _after_letters(buf, w.starts, w.ends, offsets)


class ChunkTokenizer:
    """Ids of texts; ``kind`` is "spaced" or "bare", see the functions above."""

    def __init__(self, path: str, kind: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.cut, glue = {"spaced": (spaced_chunks, "\n"), "bare": (bare_chunks, " | ")}[kind]
        self.glue = glue
        (self.mark,) = self._ids([glue])[0]
        self.odd = np.zeros(256, bool)  # bytes of chunks that can't be glued to others
        self.odd[[*np.flatnonzero(SPACES), *_MAYBE_SPACE, ord(glue.strip() or glue)]] = True
        self.forget()

    def forget(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.lo = self.hi = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, w: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given chunks in a row, and how many each has."""
        bad = np.zeros(len(w.buf) + 1, np.int32 if len(w.buf) < 1 << 31 else np.int64)
        np.cumsum(self.odd[w.buf], out=bad[1:])
        starts, ends = w.starts[which], w.ends[which]
        inner = starts + (w.buf[starts] == 0x20)  # a leading space is no reason to single a chunk out
        single = (bad[ends] - bad[np.minimum(inner, ends)] > 0) | (inner >= ends)
        text = w.buf.tobytes()
        chunks = [text[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        sizes = np.zeros(len(which), np.int64)
        ids: list[np.ndarray] = [np.empty(0, np.uint32)] * len(which)
        plain = np.flatnonzero(~single)
        groups = [plain[i : i + 1000] for i in range(0, len(plain), 1000)]
        out, order = [], []
        for g in groups:  # one by one, as the library's encodings take many times the memory of their ids
            e = np.array(self._ids([self.glue.join(chunks[i] for i in g) + self.glue])[0], np.uint32)
            at = np.flatnonzero(e == self.mark)
            if len(at) != len(g):
                raise RuntimeError("glued chunks don't come apart")
            sizes[g] = np.diff(at, prepend=-1) - 1
            out.append(e[e != self.mark])
            order.append(g)
        alone = np.flatnonzero(single)
        for some in (alone[i : i + 1000] for i in range(0, len(alone), 1000)):
            for i, e in zip(some, self._ids([chunks[i] for i in some]), strict=True):
                sizes[i] = len(e)
                out.append(np.array(e, np.uint32))
        order.append(alone)
        order = np.concatenate(order) if order else np.empty(0, np.int64)
        flat = np.concatenate(out) if out else np.empty(0, np.uint32)
        end = np.cumsum(sizes[order])
        lo, hi = np.empty(len(which), np.int64), np.empty(len(which), np.int64)
        lo[order], hi[order] = end - sizes[order], end
        return flat[numbers(lo, hi)], sizes

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the n + 1 places where texts begin in them."""
        w = self.cut(buf, offsets)
        keys, first, chunk = np.unique(w.hashes(), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.keys) + len(new) > REMEMBER and len(self.keys):
                self.forget()
                return self.encode(buf, offsets)
            ids, sizes = self._fresh(w, first[new])
            end = np.cumsum(sizes) + len(self.ids)
            merged = np.concatenate([self.keys, keys[new]])
            order = np.argsort(merged, kind="stable")
            self.keys = merged[order]
            self.lo = np.concatenate([self.lo, end - sizes])[order]
            self.hi = np.concatenate([self.hi, end])[order]
            self.ids = np.concatenate([self.ids, ids])
            at = np.searchsorted(self.keys, keys)
        lo, hi = self.lo[at][chunk], self.hi[at][chunk]
        ends = np.concatenate([[0], np.cumsum(hi - lo)])
        return self.ids[numbers(lo, hi)], ends[w.first]


@functools.lru_cache(maxsize=4)
def chunk_tokenizer(path: str, kind: str) -> ChunkTokenizer:
    """One tokenizer for each file and Python process."""
    return ChunkTokenizer(path, kind)
