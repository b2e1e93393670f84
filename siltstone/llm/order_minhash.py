"""Near-duplicates by Order MinHash, verified by banded alignment.

K-mers of five words are labelled with their occurrence in the document. Each of
32 sketches takes the 2 k-mers with the smallest hashes under a hash function of
its own, and keeps them in the order of the text: its key is equal for two
documents if these k-mers are the same and stand in the same order, so sketches
follow edit similarity rather than that of sets. Documents with an equal key are
candidates. They are verified by aligning their words within a band, which gives
the most words m that both have in the same order; the similarity is
m / (a + b - m) for a and b words, and 0.8 or more links them: copies with up to a
ninth of their words changed. An edited word takes five k-mers with it, so of a
copy with a tenth of its words changed at random about 0.59 of the k-mers are
left, 0.42 of the union of both. It shares a given key with a probability of about
0.42 ** 2 = 0.17, and at least one of 32 with 0.997. A copy with a twentieth of its
words changed shares one with more than 0.99999. Texts of few words share a key
less often, as an edit in the middle may leave them no two k-mers; some keys of
texts of 2 to 4 k-mers are of whole sequences and of sequences with one k-mer left
out, so that those one k-mer apart share one surely. For the alignment a word is
16 bits of its hash, so one pair of different words in 65,536 passes for equal
there.

Copies are put together first, by their whole word sequence. A group of equal
keys isn't compared pairwise: its documents are compared with its most central
one, then what isn't linked yet with each other in rounds that only take pairs
of different classes, the last of which leaves no pair out; see ``_rounds``.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fm_index import expand
from .store import scratch, ship_code, shuffle_partitions, written
from .substring import whole_hashes
from .words import SPACES, find_words, lean, mix, rolling, sliced, text_bytes, whole_windows

K, SKETCHES, DEPTH, SIMILARITY = 5, 32, 2, 0.8
#: K-mers of a text among which the smallest ones are looked for, about.
PASS = 16
_U = np.uint64
_MULTIPLIERS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


def kmers(w, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of K words, and where those of each text begin.

    A text of fewer words, but not none, is one k-mer.
    """
    at = whole_windows(w, K)
    out = rolling(h, K)[at]
    first = np.searchsorted(at, w.first)
    short = np.flatnonzero((w.counts > 0) & (w.counts < K))
    if len(short):
        extra = np.array([functools.reduce(lambda a, b: int(mix(np.array([a ^ int(b)], _U))[0]), h[w.first[d] : w.first[d + 1]], int(w.counts[d])) for d in short], _U)
        out = np.insert(out, first[short], extra)
        first = first + np.searchsorted(short, np.arange(len(first)))
    return out, first


def labelled(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The k-mers, each mixed with how many equal ones stand before it in its text."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((np.arange(len(h)), h, doc))
    s, d = h[order], doc[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    nth = np.arange(len(s)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(s) else np.empty(0, np.int64)
    out = np.empty(len(h), _U)
    out[order] = mix(s + nth.astype(_U) * _U(0xD6E8FEB86659FD93))
    return out


def _folded(rows: np.ndarray) -> np.ndarray:
    """One key for each row of k-mers, in their order."""
    key = np.full(len(rows), mix(np.array([SKETCHES + rows.shape[1]], _U))[0])
    for column in rows.T:
        key = mix(key * _U(0xC4CEB9FE1A85EC53) + column)
    return key


def _short_keys(keys: np.ndarray, h: np.ndarray, first: np.ndarray) -> None:
    """Put sure keys for texts of n = 2 to 4 k-mers in the place of some sketches.

    Whole sequences of n and those of n + 1 with one left out have the same
    columns, so texts that are one k-mer apart have an equal key there.
    """
    n, at = np.diff(first), 0
    for size in (DEPTH, DEPTH + 1):
        width = size + 1
        whole, longer = np.flatnonzero(n == size), np.flatnonzero(n == width)
        keys[whole, at : at + width] = _folded(h[first[whole][:, None] + np.arange(size)])[:, None]
        rows = h[first[longer][:, None] + np.arange(width)]
        for gone in range(width):
            keys[longer, at + gone] = _folded(np.delete(rows, gone, 1))
        at += width


def sketches(x: np.ndarray, first: np.ndarray, plain: np.ndarray | None = None) -> np.ndarray:
    """Keys (texts x SKETCHES) of labelled k-mers; every text must have a k-mer.

    Per hash function only k-mers below a threshold that about 16 of a text pass
    are sorted; a text in which fewer than DEPTH pass is sorted whole. ``plain``:
    the k-mers without labels, for the sure keys of short texts.
    """
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    want = np.minimum(n, DEPTH)
    limit = np.where(n > PASS, (PASS / np.maximum(n, 1) * 2.0**64).clip(0, 2.0**64 - 2048).astype(_U), _U(2**64 - 1))[doc]
    out = np.empty((len(n), SKETCHES), _U)
    for j, m in enumerate(_MULTIPLIERS):
        v = x * m
        pick = np.flatnonzero(v <= limit)
        enough = np.bincount(doc[pick], minlength=len(n)) >= want
        if not enough.all():
            pick = np.sort(np.concatenate([pick[enough[doc[pick]]], np.flatnonzero(~enough[doc])]))
        order = np.lexsort((v[pick], doc[pick]))
        at = pick[order]
        begin = np.searchsorted(doc[at], np.arange(len(n)))
        rank = np.arange(len(at)) - begin[doc[at]]
        at = np.sort(at[rank < want[doc[at]]])  # the smallest ones, back in the order of the text
        d = doc[at]
        place = np.arange(len(at)) - np.searchsorted(d, np.arange(len(n)))[d]
        key = np.full(len(n), mix(np.array([j + 1], _U))[0])
        for p in range(DEPTH):
            some = place == p
            key[d[some]] = mix(key[d[some]] * _U(0xC4CEB9FE1A85EC53) + x[at[some]])
        out[:, j] = key
    if plain is not None:
        _short_keys(out, plain, first)
    return out


SKETCH = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("whole", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("words", T.BinaryType())])


def _sketch(batches: Iterator[pa.RecordBatch], text: str, doc_id: str) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for t in sliced(batches, text):
        ids = t.column(doc_id).cast(pa.int64())
        w = find_words(*text_bytes(t.column(text)), SPACES)
        h = w.hashes()
        x, first = kmers(w, h)
        whole = whole_hashes(w, h)
        some = np.flatnonzero(np.diff(first) > 0)
        first = np.append(first[some], first[-1])
        keys = sketches(labelled(x, first), first, x) if len(some) else np.empty((0, SKETCHES), _U)
        code = (h >> _U(48)).astype("<u2")
        packed = [squeeze.compress(code[w.first[d] : w.first[d + 1]].tobytes()) for d in some]
        yield pa.RecordBatch.from_pydict(
            {
                "id": ids.combine_chunks().take(pa.array(some)),
                "n": pa.array(w.counts[some], pa.int32()),
                "whole": pa.array([whole[i] for i in some], pa.binary()),
                "keys": pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())),
                "words": pa.array(packed, pa.binary()),
            }
        )


def _bigrams(words: np.ndarray) -> np.ndarray:
    return words[:-1] * 65536 + words[1:]


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two bags."""
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    same = y[at] == x if len(y) else np.zeros(len(x), bool)
    return int(np.minimum(nx[same], ny[at[same]]).sum())


def _least_bigrams(n, other, most):
    """How many bigrams of a text of n words the other one must have, if at most ``most`` words stand unmatched in both.

    An unmatched word of its own takes two bigrams away, one of the other text
    that stands between two matched words one.
    """
    return n - 1 - most - (most + n - other) // 2


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """m / (len(a) + len(b) - m) for the longest common subsequence m, or 0 where that is below ``least``.

    What both begin and end with is matched at once, the rest within the band of
    diagonals that ``least`` allows.
    """
    la, lb = len(a), len(b)
    # m >= least * (la + lb) / (1 + least), so at most so many words stand unmatched in both together.
    most = int(la + lb - 2 * (least * (la + lb) / (1 + least)) + 1e-9)
    if abs(la - lb) > most:
        return 0.0
    if _overlap(_bigrams(a), _bigrams(b)) < max(_least_bigrams(la, lb, most), _least_bigrams(lb, la, most)):
        return 0.0
    n = min(la, lb)
    same = a[:n] == b[:n]
    head = int(np.argmin(same)) if not same.all() else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    same = a[len(a) - n :][::-1] == b[len(b) - n :][::-1]
    tail = int(np.argmin(same)) if n and not same.all() else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    m = head + tail
    if len(a) and len(b):
        m += _in_order(a, b, most, max(0, -(-(la + lb - most) // 2) - m))
    s = m / (la + lb - m)
    return s if s >= least else 0.0


def _in_order(a: np.ndarray, b: np.ndarray, most: int, need: int) -> int:
    """The longest common subsequence of a and b within a band of ``most`` places, or 0 where it is below ``need``.

    A row of the alignment is one whole number with a bit a place of a, in which a
    bit is 0 where the row gains a match (Hyyro's recurrence, with the matches of
    a row cut to the band), so a word of b takes a few operations on it.
    """
    at: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row, left = full, len(b)
    band = (1 << (2 * most + 1)) - 1
    for j, w in enumerate(b.tolist()):
        here = at.get(w, 0)
        if here:
            here &= band << (j - most) if j > most else band >> (most - j)
            met = row & here
            row = ((row + met) | (row - met)) & full
        left -= 1
        if not left & 63 and len(a) - row.bit_count() + left < need:
            return 0
    found = len(a) - row.bit_count()
    return found if found >= need else 0


def _words_of(words: bytes, expand_: zstandard.ZstdDecompressor) -> np.ndarray:
    """The words of a text as codes of 16 bits."""
    return np.frombuffer(expand_.decompress(words), "<u2").astype(np.int64)


def _verify(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    open_ = zstandard.ZstdDecompressor()
    for t in batches:
        for i in range(0, t.num_rows, 200):
            part = t.slice(i, 200)
            columns = {c: part.column(part.schema.get_field_index(c)) for c in part.schema.names}
            s = [similarity(_words_of(x.as_py(), open_), _words_of(y.as_py(), open_), least) for x, y in zip(columns["wa"], columns["wb"], strict=True)]
            yield pa.RecordBatch.from_pydict({"a": columns["a"], "b": columns["b"], "similarity": pa.array(s, pa.float64())})


LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("similarity", T.DoubleType())])


def _links(pairs: DataFrame, sequences: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose similarity is ``least`` or more, written. No side is broadcast: all of them grow with the data."""
    one = pairs.hint("merge").join(sequences.select(F.col("id").alias("a"), F.col("words").alias("wa"), F.col("n").alias("na")), "a")
    two = one.hint("merge").join(sequences.select(F.col("id").alias("b"), F.col("words").alias("wb"), F.col("n").alias("nb")), "b")
    # Lengths alone rule out what can't be similar enough.
    two = two.where(F.least("na", "nb") >= least * F.greatest("na", "nb")).select("a", "b", "wa", "wb")
    # A pair costs much more to align than to read, so pairs are dealt out by number, not by bytes.
    two = two.repartition(shuffle_partitions(pairs.sparkSession), "a", "b")
    return written(two.mapInArrow(lambda t: lean(_verify(t, least)), LINK).where("similarity > 0"), "links")


def _ends(edges: DataFrame) -> DataFrame:
    """Rows (id, class): where one comes to from each end of the edges by going to the smallest neighbour as long as that is smaller, written."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("class")), "classes")
    while True:
        jump = now.select(F.col("id").alias("class"), F.col("class").alias("far"))
        after = written(now.join(jump, "class").select("id", F.col("class").alias("was"), F.col("far").alias("class")), "component-round")
        now = after.select("id", "class")
        if not after.where("class <> was").limit(1).count():
            return now


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): rows (id, class), the class being the smallest id.

    Every document goes to the smallest one that it reaches by ever smaller
    neighbours. Links then are those between the ends of these ways, each once, and
    what is within one is dropped, until none is left; so a link is read once as
    long as it isn't between ends. Each round is written to the shared folder.
    """
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    known = None
    while known is None or edges.limit(1).count():
        ends = _ends(edges)
        for end in ("a", "b"):
            edges = edges.join(ends.select(F.col("id").alias(end), F.col("class").alias(f"c{end}")), end)
        edges = edges.where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
        edges = written(edges.distinct(), "edges")
        if known is None:
            known = ends
        else:
            further = known.join(ends.select(F.col("id").alias("class"), F.col("class").alias("to")), "class", "left")
            known = written(further.select("id", F.coalesce("to", "class").alias("class")), "classes")
    return known


def merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """The classes (id, class) after further links: components of the links between classes."""
    ends = links.select("a", "b")
    for end in ("a", "b"):
        of = classes.select(F.col("id").alias(end), F.col("class").alias(f"c{end}"))
        ends = ends.join(of, end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    between = written(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct(), "class-links")
    if not between.limit(1).count():
        return classes
    joined = components(between)
    known = classes.join(joined.select(F.col("id").alias("class"), F.col("class").alias("to")), "class", "left")
    known = known.select("id", F.coalesce("to", "class").alias("class"))
    return written(known.unionByName(joined.join(classes.select("id"), "id", "left_anti").select("id", "class")), "classes")


#: Groups of equal keys up to this size have all pairs of different classes compared.
SMALL = 16
#: Orders in which larger groups are sorted for comparing neighbours.
ORDERS = 3
#: Documents and words of a block at most, about. What is left of larger groups is compared block by block.
BLOCK, BLOCK_WORDS = 512, 1 << 17


def _shared(buckets: DataFrame) -> DataFrame:
    """Rows (key, id, size) of the keys that several documents have, written."""
    sizes = buckets.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return written(buckets.join(sizes, "key"), "shared-keys")


def _stars(shared: DataFrame) -> DataFrame:
    """Distinct pairs of each document with the most central one of its key.

    Central is who meets most documents over all keys: among edited copies of one
    text the text itself, which is more similar to each copy than copies are to
    each other.
    """
    rows = shared.select("key", "id", F.sum("size").over(Window.partitionBy("id")).alias("degree"))  # a document has few keys
    hubs = rows.groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("i"))).alias("hub")).select("key", (-F.col("hub.i")).alias("hub"))
    met = shared.select("key", "id").join(hubs, "key").where("id <> hub")
    return met.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def _mixed(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (key, id, class, size) of the keys whose documents are in several classes."""
    own = shared.select("key", "id").join(classes.select("id", "class"), "id", "left").withColumn("class", F.coalesce("class", "id"))
    own = written(own.select("key", "id", "class"), "classed-keys")
    keys = own.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
    return written(own.join(keys.select("key", "size"), "key"), "mixed-keys")


def _across(rows: DataFrame) -> DataFrame:
    """Distinct pairs of documents of one key and different classes; groups are small."""
    x, y = (rows.select("key", F.col("id").alias(n), F.col("class").alias(f"c{n}")) for n in "ab")
    return x.join(y, "key").where("ca < cb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _adjacent(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs of consecutive rows of one key and different classes whose lengths don't rule out ``least``."""
    last = None
    for t in batches:
        key, ids, cls, n = (t.column(t.schema.get_field_index(c)).to_numpy() for c in ("key", "id", "class", "n"))
        if last is not None:
            key, ids, cls, n = (np.concatenate([[x], y]) for x, y in zip(last, (key, ids, cls, n), strict=True))
        if not len(key):
            continue
        last = key[-1], ids[-1], cls[-1], n[-1]
        near = np.minimum(n[1:], n[:-1]) >= least * np.maximum(n[1:], n[:-1])
        hit = np.flatnonzero((key[1:] == key[:-1]) & (cls[1:] != cls[:-1]) & near)
        a, b = ids[hit], ids[hit + 1]
        yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})


def _neighbours(rows: DataFrame, keys: DataFrame, least: float) -> DataFrame:
    """Pairs of documents of one key that stand next to each other in orders by their other keys.

    Documents that are more similar have longer beginnings of such orders in
    common. Rows are dealt by ranges, so a large group is sorted by many tasks.
    """
    full = written(rows.join(keys, "id").select("key", "id", "class", "n", "keys"), "neighbour-keys")  # read by each order, and by its sampling of ranges
    out = None
    for i in range(ORDERS):
        at = F.pmod(F.xxhash64("key", F.lit(i)), F.lit(SKETCHES)).cast("int")
        order = F.concat(F.slice("keys", at + 1, F.lit(SKETCHES)), F.slice("keys", F.lit(1), at))
        dealt = full.select("key", order.alias("order"), "id", "class", "n").repartitionByRange("key", "order", "id").sortWithinPartitions("key", "order", "id")
        pairs = dealt.select("key", "id", "class", "n").mapInArrow(lambda t: lean(_adjacent(t, least)), PAIR)
        out = pairs if out is None else out.unionByName(pairs)
    return out.distinct()


def _compare(t: pa.Table, least: float) -> pa.Table:
    """The links that join classes among two blocks of a key (``side`` 0 and 1) or within one (2).

    A pair is left out if it is in one class, also by links found here; if it
    shares an earlier key, whose group has it; or by its lengths or the number of
    bigrams that both texts have, which rule out ``least``.
    """
    ids, own, side, n = (t.column(c).to_numpy() for c in ("id", "class", "side", "n"))
    own = own.copy()
    keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, SKETCHES)
    group = t.column("key")[0].as_py()
    open_ = zstandard.ZstdDecompressor()
    x = [_words_of(w.as_py(), open_) for w in t.column("words")]
    pairs = [_bigrams(w) for w in x]
    code = np.unique(np.concatenate([*pairs, np.zeros(1, np.int64)]), return_inverse=True)[1]  # the last one so that every text begins within
    first = np.append(0, np.cumsum([len(p) for p in pairs]))
    flag = np.zeros(len(code), bool)
    right = np.flatnonzero(side > 0)
    out = []
    for i in np.flatnonzero(side != 1):
        other = right[right > i] if side[i] == 2 else right
        other = other[(own[other] != own[i]) & (np.minimum(n[other], n[i]) >= least * np.maximum(n[other], n[i]))]
        other = other[keys[i][(keys[other] == keys[i]).argmax(1)] == group]
        if not len(other):
            continue
        flag[code[first[i] : first[i + 1]]] = True
        common = np.where(np.diff(first) > 0, np.add.reduceat(flag[code], first[:-1], dtype=np.int64), 0)[other]
        flag[code[first[i] : first[i + 1]]] = False
        size = n[other].astype(np.int64)
        most = (size + n[i] - 2 * (least * (size + n[i]) / (1 + least)) + 1e-9).astype(np.int64)  # as in ``similarity``
        likely = np.flatnonzero(common >= _least_bigrams(size, int(n[i]), most))
        for j in other[likely[np.argsort(-common[likely], kind="stable")]]:
            if own[i] == own[j]:
                continue
            s = similarity(x[i], x[j], least)
            if s:
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j]), s))
                own[own == own[j]] = own[i]
    a, b, s = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": pa.array(s, pa.float64())})


def _rest(rows: DataFrame, active: DataFrame, least: float) -> DataFrame:
    """Links between the classes of large groups, written: every pair across classes is compared, or excluded by a sure bound.

    A group that fits into one block is one. A larger one is cut into cells by length, in steps such that similar texts are in
    the same or in neighbouring ones, and by whether a document is in the group's
    largest class, within which nothing is to be compared. Cells are cut into
    blocks by the hash of the id, and each two blocks that may have a pair are
    one group of rows.
    """
    step = math.log(1.01 / least)  # a little more than similar texts can differ by
    classes = rows.groupBy("key", "class").agg(F.count("*").alias("n"))
    top = classes.groupBy("key").agg(F.max(F.struct("n", "class")).alias("top")).select("key", F.col("top.class").alias("top"))
    own = rows.select("key", "id", "class").join(active.select("id", "n", "keys"), "id").where(F.array_contains("keys", F.col("key"))).drop("keys")
    cell = ["key", "tier", "major"]
    own = written(own, "lengths")
    whole = own.groupBy("key").agg(((F.count("*") <= BLOCK) & (F.sum("n") <= BLOCK_WORDS)).alias("whole"))
    tier, major = F.floor(F.log("n") / step), F.col("class") == F.col("top")
    own = own.join(top.join(whole, "key"), "key").select("key", "id", "class", "n", F.when(F.col("whole"), 0).otherwise(tier).alias("tier"), (~F.col("whole") & major).alias("major"))
    own = written(own, "cells")
    parts = own.groupBy(*cell).agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_WORDS)).alias("parts"))
    parts = written(parts, "cell-sizes")
    blocks = parts.select(*cell, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    x, y = (blocks.select("key", F.struct("tier", "major", "part").alias(s)) for s in "xy")
    near = x.join(y, "key").where("x <= y AND y.tier - x.tier <= 1 AND NOT (x.major AND y.major)")
    near = written(near.select(F.monotonically_increasing_id().alias("task"), "key", "x", "y"), "block-pairs")
    left = near.select("task", "key", "x.*", F.when(F.col("x") == F.col("y"), 2).otherwise(0).alias("side"))
    sent = left.unionByName(near.where("x <> y").select("task", "key", "y.*", F.lit(1).alias("side")))
    own = own.join(parts, cell).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    met = own.join(sent, [*cell, "part"]).select("task", "key", "side", "id", "class", "n")
    full = met.hint("merge").join(active.select("id", "n", "keys", "words"), ["id", "n"]).where(F.array_contains("keys", F.col("key")))
    return written(full.groupBy("task").applyInArrow(lambda t: _compare(t, least), LINK), "links")


def _rounds(table: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """All links that are found between representatives, in rounds.

    1. Stars: every document of a key against the most central one there.
    2. Of keys whose documents are now in several classes, small ones have all
       pairs across classes compared (links within a class change nothing); in
       large ones neighbours in several orders are.
    3. Large ones that are mixed even now have all pairs across classes compared,
       in blocks (see ``_rest``). The rounds before only leave it fewer of them.

    Sequences are only dealt out again for documents that share a key.
    """
    buckets = written(table.join(reps.hint("merge"), "id", "left_semi").select("id", F.explode("keys").alias("key")).distinct(), "keys")
    shared = _shared(buckets)
    active = written(table.join(shared.select("id").distinct().hint("merge"), "id", "left_semi").select("id", "n", "words", "keys"), "active")
    sequences, keys = active.select("id", "n", "words"), active.select("id", "n", "keys")
    tested = written(_stars(shared), "pairs")
    links = _links(tested, sequences, least)
    classes = components(links)
    mixed = _mixed(shared, classes)
    fresh = _neighbours(mixed.where(F.col("size") > SMALL), keys, least).unionByName(_across(mixed.where(F.col("size") <= SMALL)))
    fresh = written(fresh.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
    more = _links(fresh, sequences, least)
    mixed = _mixed(shared, merged(classes, more)).where(F.col("size") > SMALL)
    return written(links.unionByName(more).unionByName(_rest(mixed, active, least)), "links-so-far")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest id of its class), copy (whether an equal text has a smaller id) and n_links.

    Classes are the connected components of the links. ``n_links`` counts the
    verified links between the document's text and different ones; pairs that
    other links had put into one class before aren't compared, so of a large class
    it has those that hold it together. Texts with the same words are one class. A
    null or wordless text is never linked; a null id gets a null class. A text of
    fewer than five words is linked to equal ones only. Rows with the same id are
    in the same class. Ids must be whole numbers; others are an error. Of equally
    central documents of a key the one with the smallest id counts. Columns besides
    the two named aren't read, so their names don't matter; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    ship_code(spark)
    with scratch() as keep:
        known = written(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(lambda b: lean(_sketch(b, "text", "id")), SKETCH), "sketches").where("id IS NOT NULL")
        first = written(known.groupBy("whole").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "texts")
        copies = written(known.select("id", "whole").join(first.where("n > 1").hint("merge"), "whole").where("id <> rep").select("id", "rep").distinct(), "copies")
        links = _rounds(known, first.select(F.col("rep").alias("id")).distinct(), least)
        classes = components(links.select("a", "b").unionByName(copies.select(F.col("rep").alias("a"), F.col("id").alias("b"))))
        classes = written(classes, "near-classes")
        ends = links.select("a", "b").distinct().select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
        of_copies = copies.hint("merge").join(ends.withColumnRenamed("id", "rep"), "rep").groupBy("id").agg(F.max("n_links").alias("n_links"))
        counts = written(ends.unionByName(of_copies).groupBy("id").agg(F.max("n_links").alias("n_links")), "link-counts")
        keep += [copies, classes, counts]
    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"))
    dup = copies.select(F.col("id").alias("doc_id"), F.lit(True).alias("copy")).distinct()
    out = out.join(classes.select(F.col("id").alias("doc_id"), F.col("class").alias("class_id")), "doc_id", "left").join(dup, "doc_id", "left")
    out = out.join(counts.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy", F.lit(False)).alias("copy"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
