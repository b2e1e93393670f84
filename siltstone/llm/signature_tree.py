"""Jaccard join of n-gram sets with signature trees, and the components of its links.

A document's set are its distinct runs of four words. Equal sets are one node.
Two nodes link when their intersection is 85 % of their union or more.

Which sets can link at all is found with prefixes: if both sets are sorted in one
order of shingles, and floor(15 n / 100) + 1 of each are taken from its beginning,
two linked sets have one of these in common. The order is from rare to frequent
shingles, so a passage that many documents share is in a prefix only where hardly
anything else is. Sets that share such keys, directly or by way of others, are a
family.

Within a family sets are compared by signature trees. A set's signature is a bitmap
in which each shingle marks a bit, its leaf. Nodes hold the OR of the bitmaps below,
the range of sizes, and by how much a size exceeds its number of bits at most. Two
trees, or a tree and itself, are traversed together from their roots: a pair of
nodes is left as soon as the bits that both mark, with the lesser excess, can't be
as many shingles as the smallest sets below would need, if no sizes below are near
enough, or if all below is in one component already. Pairs of leaves that are
reached are verified by their exact intersections.

A tree holds a block of at most about 128 sets, so no task grows with a family.
In large families the blocks' components are first brought together by trees of
one representative each; then every pair of blocks in which sets of different
components share a key is traversed, so no pair is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .order_minhash import components, merged
from .store import scratch, ship_code, written
from .words import LOWER, SPACES, find_words, mix, rolling, sliced, text_bytes

K, PERCENT = 4, 85
#: Sets and shingles of a tree at most, about, and children of a node.
BLOCK, BLOCK_SHINGLES, FAN = 128, 1 << 17, 8
#: Shingles whose counts are found in one task, about.
BUCKET = 1 << 20
#: Shingles of the small families that are put into one task, about.
PACK = 1 << 19
_U = np.uint64


def needed(total: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection of linked sets whose sizes sum up to ``total``: x >= percent / 100 of (total - x)."""
    return -(-percent * total // (100 + percent))


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles from the beginning two linked sets have one in common of; 0 for an empty set."""
    return np.where(n > 0, n + percent * -n // 100 + 1, 0)


def shingle_sets(code: np.ndarray, first: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of texts of word codes, and where those of each text begin.

    A text of fewer words than ``k``, but not none, has one shingle, which differs
    from those of texts of other lengths.
    """
    count = np.diff(first)
    h = mix(code.astype(_U) + _U(0x9E3779B97F4A7C15))
    last = np.repeat(first[1:], count)
    at = np.flatnonzero(np.arange(len(h)) + k <= last)
    doc = np.repeat(np.arange(len(count)), count)
    x, of = rolling(h, k)[at] if len(at) else np.empty(0, _U), doc[at]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        whole = mix(count[short].astype(_U))
        for j in range(k - 1):
            some = count[short] > j
            whole[some] = mix(whole[some] * _U(0xC4CEB9FE1A85EC53) + h[first[short[some]] + j])
        x, of = np.concatenate([x, whole]), np.concatenate([of, short])
    order = np.lexsort((x, of))
    x, of = x[order], of[order]
    fresh = np.ones(len(x), bool)
    fresh[1:] = (x[1:] != x[:-1]) | (of[1:] != of[:-1])
    x, of = x[fresh], of[fresh]
    return x, np.searchsorted(of, np.arange(len(count) + 1))


BATCH = T.StructType(
    [
        T.StructField("batch", T.LongType()),
        T.StructField("rows", T.ArrayType(T.LongType())),
        T.StructField("ids", T.ArrayType(T.LongType())),
        T.StructField("n", T.ArrayType(T.LongType())),
        T.StructField("whole", T.ArrayType(T.BinaryType())),
        T.StructField("counts", T.BinaryType()),
        T.StructField("words", T.BinaryType()),
    ]
)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for some texts together: their ids, the sizes of their sets, 128 bits that stand for each set, and all words as codes of 32 bits."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for t in sliced(batches):
        buf, offsets = text_bytes(t.column("text"))
        w = find_words(LOWER[buf], offsets, SPACES)
        code = (w.hashes() >> _U(32)).astype("<u4")
        x, first = shingle_sets(code, w.first)
        n = np.diff(first)
        marks = []
        for seed in (0, 0xD6E8FEB86659FD93):
            sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(x ^ _U(seed)))])
            marks.append(mix(sums[first[1:]] - sums[first[:-1]] + n.astype(_U)))
        whole = [r.tobytes() if m else None for r, m in zip(np.stack(marks, 1).astype("<u8"), n, strict=True)]
        rows = t.column("row").to_pylist()
        lists = {"rows": [rows], "ids": [t.column("id").to_pylist()], "n": [n.tolist()], "whole": [whole]}
        blobs = {"counts": [w.counts.astype("<i8").tobytes()], "words": [squeeze.compress(code.tobytes())]}
        yield pa.RecordBatch.from_pydict({"batch": pa.array([rows[0]], pa.int64())} | {k: pa.array(v, pa.list_(pa.binary() if k == "whole" else pa.int64())) for k, v in lists.items()} | {k: pa.array(v, pa.binary()) for k, v in blobs.items()})


def _opened(counts: bytes, words: bytes, open_: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a batch's words, and where those of each text begin."""
    return np.frombuffer(open_.decompress(words), "<u4"), np.append(0, np.cumsum(np.frombuffer(counts, "<i8")))


def _set_of(words: bytes, open_: zstandard.ZstdDecompressor) -> np.ndarray:
    code = np.frombuffer(open_.decompress(words), "<u4")
    return shingle_sets(code, np.array([0, len(code)]))[0]


def _cells(x: np.ndarray, buckets: int) -> np.ndarray:
    """Shingles as bucket (by their upper half) and 32 bits: where two of these are equal by chance, counts are only higher."""
    return ((x >> _U(32)) * _U(buckets) & _U(0xFFFFFFFF00000000)) | (x & _U(0xFFFFFFFF))


def _packed(ascending: np.ndarray) -> bytes:
    """Numbers of 32 bits in ascending order, as their differences with equal places of bytes side by side."""
    steps = np.diff(ascending, prepend=np.zeros(1, np.uint32)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(flat.reshape(4, -1).T).view("<u4").ravel(), dtype=np.uint32)


ASKED = T.StructType([T.StructField("batch", T.LongType()), T.StructField("bucket", T.LongType()), T.StructField("cells", T.BinaryType()), T.StructField("sets", T.BinaryType())])
ANSWERED = T.StructType([T.StructField("batch", T.LongType()), T.StructField("bucket", T.LongType()), T.StructField("df", T.BinaryType())])


def _ask(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of a batch by bucket, and how many of its sets have each (255 at most): a frequent one is one entry a batch."""
    open_, squeeze = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    for b in batches:
        for batch, counts, words in zip(*(b.column(b.schema.get_field_index(c)) for c in ("batch", "counts", "words")), strict=True):
            x = shingle_sets(*_opened(counts.as_py(), words.as_py(), open_))[0]
            cells, many = np.unique(_cells(x, buckets), return_counts=True)
            bucket = (cells >> _U(32)).astype(np.int64)
            at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, np.int64)
            low, many = cells.astype(np.uint32), np.minimum(many, 255).astype(np.uint8)
            ends = np.append(at[1:], len(bucket))
            yield pa.RecordBatch.from_pydict(
                {
                    "batch": pa.array([batch.as_py()] * len(at), pa.int64()),
                    "bucket": pa.array(bucket[at], pa.int64()),
                    "cells": pa.array([_packed(low[i:j]) for i, j in zip(at, ends, strict=True)], pa.binary()),
                    "sets": pa.array([squeeze.compress(many[i:j].tobytes()) for i, j in zip(at, ends, strict=True)], pa.binary()),
                }
            )


def _answer(t: pa.Table) -> pa.Table:
    """How many sets of all batches have each shingle of a bucket, 255 at most, in the order asked."""
    cells = [_unpacked(c.as_py()) for c in t.column("cells")]
    many = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(c.as_py()), np.uint8) for c in t.column("sets")])
    values, code = np.unique(np.concatenate(cells), return_inverse=True)
    df = np.minimum(np.bincount(code, many, len(values)), 255).astype(np.uint8)[code]
    squeeze = zstandard.ZstdCompressor(level=1)
    parts = np.split(df, np.cumsum([len(c) for c in cells])[:-1])
    return pa.table({"batch": t.column("batch"), "bucket": t.column("bucket"), "df": pa.array([squeeze.compress(p.tobytes()) for p in parts], pa.binary())})


LIVE = T.StructType(
    [T.StructField("row", T.LongType()), T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("words", T.BinaryType())]
)


def _prefixes(asked: pa.Table, answers: pa.Table, buckets: int, percent: int) -> pa.Table:
    """Of a batch the sets that may link: those with fewer shingles of their own than the prefix is long, with what else is in it."""
    open_, squeeze = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    counts, words, rows = (asked.column(c)[0].as_py() for c in ("counts", "words", "rows"))
    code, begin = _opened(counts, words, open_)
    x, first = shingle_sets(code, begin)
    n = np.diff(first)
    answers = answers.sort_by("bucket")
    df = np.concatenate([np.empty(0, np.uint8), *(np.frombuffer(zstandard.ZstdDecompressor().decompress(a.as_py()), np.uint8) for a in answers.column("df"))])
    df = df[np.unique(_cells(x, buckets), return_inverse=True)[1]]
    doc = np.repeat(np.arange(len(n)), n)
    alone = np.bincount(doc[df < 2], minlength=len(n))
    left = prefix_length(n, percent) - alone
    pick = np.flatnonzero((df > 1) & (left[doc] > 0))
    pick = pick[np.lexsort((x[pick], df[pick], doc[pick]))]
    start = np.searchsorted(doc[pick], np.arange(len(n) + 1))
    pick = pick[np.arange(len(pick)) - start[doc[pick]] < left[doc[pick]]]
    start = np.searchsorted(doc[pick], np.arange(len(n) + 1))
    live = np.flatnonzero(np.diff(start))
    return pa.table(
        {
            "row": pa.array([rows[d] for d in live], pa.int64()),
            "n": pa.array(n[live], pa.int64()),
            "keys": pa.array([x[pick[start[d] : start[d + 1]]].view(np.int64) for d in live], pa.list_(pa.int64())),
            "words": pa.array([squeeze.compress(code[begin[d] : begin[d + 1]].tobytes()) for d in live], pa.binary()),
        }
    )


def _live_sets(batches: DataFrame, n_shingles: int, percent: int) -> DataFrame:
    """Rows (row, n, keys, words) of the texts that may link, written. ``keys`` is the prefix from rare to frequent shingles.

    A shingle that only one text has is in the prefix but leads to no other set.
    Texts with enough of these are out. Counts come and go packed: a batch asks for
    its distinct shingles by bucket, and gets a byte for each. Equal texts are
    counted one by one here, which makes their shingles seem more frequent; any
    order that is the same for all sets will do.
    """
    buckets = n_shingles // BUCKET + 1
    asked = batches.select("batch", "counts", "words").mapInArrow(lambda b: _ask(b, buckets), ASKED)
    answers = asked.groupBy("bucket").applyInArrow(_answer, ANSWERED)
    some = batches.select("batch", "rows", "counts", "words").groupBy("batch")
    return written(some.cogroup(answers.groupBy("batch")).applyInArrow(lambda a, b: _prefixes(a, b, buckets, percent), LIVE), "live-texts")


def _shared_keys(live: DataFrame) -> DataFrame:
    """Rows (key, id) of the keys that several sets have, written."""
    rows = live.select(F.explode("keys").alias("key"), F.col("row").alias("id"))
    often = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    return written(rows.hint("merge").join(often, "key"), "shared-keys")


def _families(shared: DataFrame) -> DataFrame:
    """Rows (id, family) of sets that share keys, directly or by way of others."""
    least = shared.groupBy("key").agg(F.min("id").alias("b"))
    edges = shared.hint("merge").join(least, "key").where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    return components(edges).withColumnRenamed("class", "family")


class Tree:
    """A signature tree over sets in the order given, neighbours being alike. ``levels[0]`` are the leaves, the last one is the root."""

    def __init__(self, sets: list[np.ndarray], bits: int) -> None:
        n = np.array([len(s) for s in sets], np.int64)
        marks = np.zeros((len(sets), bits), bool)
        doc = np.repeat(np.arange(len(sets)), n)
        marks[doc, (np.concatenate(sets) >> _U(11)).astype(np.int64) & (bits - 1)] = True
        bitmap = np.packbits(marks, axis=1).view(_U)
        self.levels = [(bitmap, n, n, n - np.bitwise_count(bitmap).sum(1, dtype=np.int64))]
        while len(self.levels[-1][1]) > 1:
            bitmap, lo, hi, excess = self.levels[-1]
            at = np.arange(0, len(lo), FAN)
            self.levels.append((np.bitwise_or.reduceat(bitmap, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(excess, at)))

    def spread(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of nodes on the level below, and how many each node has."""
        first = node * FAN
        return first, np.minimum(first + FAN, len(self.levels[level - 1][1])) - first


def _single(own: np.ndarray, levels: int) -> list[np.ndarray]:
    """Per level the component that all below a node are in, or -1."""
    out = [own]
    for _ in range(levels - 1):
        at = np.arange(0, len(out[-1]), FAN)
        lo, hi = np.minimum.reduceat(out[-1], at), np.maximum.reduceat(out[-1], at)
        out.append(np.where(lo == hi, lo, -1))
    return out


def traverse(x: Tree, y: Tree, own_x: np.ndarray, own_y: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of leaves (i of x, j of y) that no bound rules out, and the bound of their overlap. With x as y, i < j.

    Components are numbers of 0 or more. Both trees go down a level at a time; the
    one with more levels first goes down alone.
    """
    cx, cy = _single(own_x, len(x.levels)), _single(own_y, len(y.levels))
    lx, ly = len(x.levels) - 1, len(y.levels) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        (bx, lox, hix, ex), (by, loy, hiy, ey) = x.levels[lx], y.levels[ly]
        small, large = np.minimum(hix[i], hiy[j]), np.maximum(lox[i], loy[j])
        ok = (100 * small >= percent * large) & ((cx[lx][i] != cy[ly][j]) | (cx[lx][i] < 0))
        if x is y:
            ok &= i < j if lx == 0 else i <= j
        i, j = i[ok], j[ok]
        bound = np.empty(len(i), np.int64)
        for lo in range(0, len(i), 4096):
            part = slice(lo, lo + 4096)
            bound[part] = np.bitwise_count(bx[i[part]] & by[j[part]]).sum(1, dtype=np.int64)
        bound = np.minimum(bound + np.minimum(ex[i], ey[j]), np.minimum(hix[i], hiy[j]))
        ok = bound >= needed(lox[i] + loy[j], percent)
        i, j, bound = i[ok], j[ok], bound[ok]
        if not len(i) or lx == ly == 0:
            return i, j, bound
        down_x, down_y = lx >= ly, ly >= lx
        if down_x:
            first, many = x.spread(lx, i)
            at = np.repeat(np.arange(len(i)), many)
            i, j = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many), j[at]
            lx -= 1
        if down_y:
            first, many = y.spread(ly, j)
            at = np.repeat(np.arange(len(j)), many)
            i, j = i[at], first[at] + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            ly -= 1


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _compare(sets: list[np.ndarray], own: np.ndarray, other: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links that join components among the sets, or between those that ``other`` marks and those that it doesn't.

    ``own`` are the components so far and is updated.
    """
    n = max(map(len, sets))
    bits = min(max(512, 1 << math.ceil(math.log2(8 * n))), 1 << 18)
    low = np.array([s[0] for s in sets])  # the smallest hash: equal for sets that are alike, most often
    order = np.lexsort((np.array([s[min(1, len(s) - 1)] for s in sets]), low))
    if other is None:
        sides = [order, order]
    else:
        sides = [order[~other[order]], order[other[order]]]
    x = Tree([sets[i] for i in sides[0]], bits)
    y = x if other is None else Tree([sets[i] for i in sides[1]], bits)
    i, j, bound = traverse(x, y, own[sides[0]], own[sides[1]], percent)
    out = []
    union = np.array([len(s) for s in sets])
    best = np.argsort(-(bound / np.maximum(union[sides[0][i]], union[sides[1][j]])), kind="stable")
    for a, b in zip(sides[0][i[best]].tolist(), sides[1][j[best]].tolist(), strict=True):
        if own[a] != own[b] and linked(sets[a], sets[b], percent):
            out.append((a, b))
            own[own == own[b]] = own[a]
    return out


FOUND = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _central(sets: list[np.ndarray], own: np.ndarray) -> list[int]:
    """Of each component the set whose shingles most sets of the component have: of edited copies one with few edits."""
    out = []
    for c in np.unique(own):
        of = np.flatnonzero(own == c)
        if len(of) > 2:
            values, code, count = np.unique(np.concatenate([sets[i] for i in of]), return_inverse=True, return_counts=True)
            ends = np.cumsum([len(sets[i]) for i in of])
            share = [float(v.mean()) for v in np.split(count[code], ends[:-1])]
            of = of[np.argsort(-np.array(share), kind="stable")]
        out.append(int(of[0]))
    return out


def _own_trees(t: pa.Table, percent: int) -> pa.Table:
    """Links (a, b) within each block of the task; of blocks of larger families also a row (a, null) for a representative of each component."""
    t = t.sort_by([("block", "ascending"), ("id", "ascending")])
    open_ = zstandard.ZstdDecompressor()
    block, ids, large, cls = (t.column(c).to_numpy(zero_copy_only=False) for c in ("block", "id", "large", "class"))
    words = t.column("words")
    out: list[tuple[int, int | None]] = []
    at = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.empty(0, np.int64)
    for lo, hi in zip(at, np.append(at[1:], len(block)), strict=True):
        if hi - lo == 1 and not large[lo]:
            continue
        sets = [_set_of(words[i].as_py(), open_) for i in range(lo, hi)]
        own = np.unique(cls[lo:hi], return_inverse=True)[1].astype(np.int64)
        out += [(int(ids[lo + a]), int(ids[lo + b])) for a, b in _compare(sets, own, None, percent)]
        if large[lo]:
            out += [(int(ids[lo + i]), None) for i in _central(sets, own)]
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _two_trees(t: pa.Table, percent: int) -> pa.Table:
    """Links between two blocks (``side`` 0 and 1), or within one (2)."""
    open_ = zstandard.ZstdDecompressor()
    ids, side, cls = (t.column(c).to_numpy() for c in ("id", "side", "class"))
    sets = [_set_of(w.as_py(), open_) for w in t.column("words")]
    own = np.unique(cls, return_inverse=True)[1].astype(np.int64)
    found = _compare(sets, own, None if side[0] == 2 else side == 1, percent) if len(np.unique(side)) > 1 or side[0] == 2 else []
    return pa.table({"a": pa.array([ids[a] for a, _ in found], pa.int64()), "b": pa.array([ids[b] for _, b in found], pa.int64())})


def _blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (id, family, n, ...) with ``block`` and whether the family has several (``large``), written."""
    sizes = rows.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    dealt = rows.join(sizes, "family").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    return written(dealt.select(*rows.columns, F.xxhash64("family", "part").alias("block"), (F.col("parts") > 1).alias("large")), "blocks")


def _traversed(blocks: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """The result of ``_own_trees`` on all blocks, written. Blocks of small families share tasks."""
    total = blocks.agg(F.sum("n")).first()[0] or 0
    tasks = total // PACK + 1
    task = F.when(F.col("large"), F.col("block")).otherwise(F.pmod("block", F.lit(tasks)))
    full = blocks.hint("merge").join(live.select(F.col("row").alias("id"), "words"), "id").select(task.alias("task"), "block", "id", "class", "large", "words")
    return written(full.groupBy("task").applyInArrow(lambda t: _own_trees(t, percent), FOUND), "tree-links")


def _mixed(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct rows (id, family, class) of the keys whose sets are in several components, written; families are those of these keys."""
    own = written(shared.hint("merge").join(classes.select("id", "class"), "id", "left").select("key", "id", F.coalesce("class", "id").alias("class")), "classed-keys")
    keys = own.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("key")
    left = written(own.hint("merge").join(keys, "key"), "mixed-keys")
    return written(left.select("id", "class").distinct().join(_families(left.select("key", "id")), "id"), "mixed-families")


def _across(rows: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """Links between the components of families, written: every two blocks that may have a pair are traversed.

    Blocks hold sets of near sizes, and of a family's largest component or of
    others; two blocks of the largest component have nothing to compare.
    """
    step = math.log(1.01 * 100 / percent)  # a little more than linked sets can differ by
    count = rows.groupBy("family", "class").agg(F.count("*").alias("n"))
    top = count.groupBy("family").agg(F.max(F.struct("n", "class")).alias("top")).select("family", F.col("top.class").alias("top"))
    cell = ["family", "tier", "major"]
    own = rows.join(top, "family").select("id", "class", "n", "family", F.floor(F.log("n") / step).alias("tier"), (F.col("class") == F.col("top")).alias("major"))
    own = written(own, "cells")
    parts = own.groupBy(*cell).agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    parts = written(parts, "cell-sizes")
    blocks = parts.select(*cell, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    x, y = (blocks.select("family", F.struct("tier", "major", "part").alias(s)) for s in "xy")
    near = x.join(y, "family").where("x <= y AND abs(y.tier - x.tier) <= 1 AND NOT (x.major AND y.major)")
    near = written(near.select(F.monotonically_increasing_id().alias("task"), "family", "x", "y"), "block-pairs")
    left = near.select("task", "family", "x.*", F.when(F.col("x") == F.col("y"), 2).otherwise(0).alias("side"))
    sent = left.unionByName(near.where("x <> y").select("task", "family", "y.*", F.lit(1).alias("side")))
    own = own.join(parts, cell).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    met = own.join(sent, [*cell, "part"]).select("task", "side", "id", "class")
    full = met.hint("merge").join(live.select(F.col("row").alias("id"), "words"), "id")
    return written(full.groupBy("task").applyInArrow(lambda t: _two_trees(t, percent), FOUND), "tree-links")


def _set_links(live: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """Components (id, class) of the linked sets of ``live`` (row, n, words), of which ``shared`` has the keys (key, id)."""
    sizes = live.select(F.col("row").alias("id"), "n")
    rows = _families(shared).hint("merge").join(sizes, "id").withColumn("class", F.col("id"))
    found = _traversed(_blocks(rows), live, percent)
    classes = written(components(found.where("b IS NOT NULL")), "classes")
    central, many = found.where("b IS NULL").select(F.col("a").alias("id")).distinct(), None
    while many != (many := central.count()) and many:
        known = rows.drop("class").join(central, "id").join(classes, "id", "left").withColumn("class", F.coalesce("class", "id"))
        found = _traversed(_blocks(known), live, percent)
        classes = merged(classes, found.where("b IS NOT NULL"))
        central = found.where("b IS NULL").select(F.col("a").alias("id")).distinct()
    mixed = _mixed(shared, classes).hint("merge").join(sizes, "id")
    # Families whose sets were all in one tree are done: what is still apart there was compared.
    large = rows.groupBy("family").agg(F.count("*").alias("sets"), F.sum("n").alias("size")).where((F.col("sets") > BLOCK) | (F.col("size") > BLOCK_SHINGLES))
    open_ = rows.select("id", "family").join(large.select("family"), "family").select("id")
    return merged(classes, _across(mixed.join(open_, "id", "left_semi"), live, percent))


def jaccard_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id that links lead to, or its own).

    Words are runs without white space, A-Z lower-cased. A text of fewer than four
    words has one shingle, the whole; a null or wordless one has none and is
    linked to nothing. Rows with the same id are in one component. A row without an
    id has no component. Ids must be whole numbers. An empty table gives an empty
    result. Only the two columns named are read.
    """
    spark = docs.sparkSession
    ship_code(spark)
    with scratch() as keep:
        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
        batches = written(rows.mapInArrow(_batches, BATCH), "batches")
        known = batches.select(F.explode(F.arrays_zip(F.col("rows").alias("row"), F.col("ids").alias("id"), "n", "whole")).alias("d")).select("d.*")
        some = known.where("id IS NOT NULL AND n > 0")
        nodes = some.groupBy("whole").agg(F.min(F.struct("id", "row")).alias("first"), F.count("*").alias("copies"))
        nodes = written(nodes.select("whole", F.col("first.id").alias("rep"), F.col("first.row").alias("row"), "copies"), "nodes")
        copies = some.select("id", "whole").hint("merge").join(nodes.where("copies > 1").select("whole", "rep"), "whole").where("id <> rep")
        n_shingles = known.agg(F.sum("n")).first()[0] or 0
        live = _live_sets(batches, n_shingles, percent)
        live = written(live.hint("merge").join(nodes.select("row"), "row"), "live-sets")
        classes = _set_links(live, _shared_keys(live), percent)
        reps = classes.hint("merge").join(nodes.select(F.col("row").alias("id"), "rep"), "id")
        heads = reps.groupBy("class").agg(F.min("rep").alias("head"))
        edges = reps.hint("merge").join(heads, "class").where("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b"))
        whole = components(edges.unionByName(copies.select(F.col("id").alias("a"), F.col("rep").alias("b"))))
        out = known.select("id", "n").hint("merge").join(whole, "id", "left")
        out = written(out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("class", "id").alias("component_id")), "components")
        keep.append(out)
    return out
