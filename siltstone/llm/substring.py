"""Substring deduplication with fixed-block anchors.

Blocks of ``window // 2`` words at fixed places of every document are the index;
the hash of every rolling run of as many words is a probe. A repeat of
``window`` words holds a whole block of one of its documents, so it shows up as
a hit in all of them. Around the hits every window of the full length gets a
96-bit hash, and those hashes are compared between all documents, which extends
the hits to maximal exact repeats (the union of the equal windows).

What travels is packed. A task reads whole documents in batches; equal hashes of
a batch count once, so a passage that a third of all documents hold is sent once
a batch. Per batch and bucket of hashes one row holds a sorted array, and the
answer is one bit an entry. Batches are written once to the shared folder, so
they stay the same however often a task is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import ship_code, shuffle_partitions, written
from .words import BASE_A, BASE_B, SPACES, Words, find_words, lean, mix, powers, rolling, sliced, spans, text_bytes, whole_windows

_U = np.uint64
_NO_ID = np.iinfo(np.int64).max

BATCH = T.StructType(
    [
        T.StructField("batch", T.LongType()),
        T.StructField("rows", T.BinaryType()),
        T.StructField("ids", T.ArrayType(T.LongType())),
        T.StructField("whole", T.ArrayType(T.BinaryType())),
    ]
)
PROBE = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.LongType()), T.StructField("keys", T.BinaryType())])
ANSWER = T.StructType([T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("bits", T.BinaryType())])


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in the order of the hashes, from their upper halves."""
    return (((h >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int32)


def _parts(sorted_hashes: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the buckets that sorted hashes fall into."""
    if not len(sorted_hashes):
        return []
    b = _bucket(sorted_hashes, buckets)
    at = np.flatnonzero(np.diff(b, prepend=-1))
    return [(int(b[i]), int(i), int(j)) for i, j in zip(at, np.append(at[1:], len(b)), strict=True)]


class _Batch:
    """The rows of a batch with their words."""

    def __init__(self, blob: bytes, text: str) -> None:
        with pa.ipc.open_stream(zstandard.decompress(blob)) as reader:
            self.rows = reader.read_all()
        self.buf, self.offsets = text_bytes(self.rows.column(text))
        self.words: Words = find_words(self.buf, self.offsets, SPACES)
        self.h = self.words.hashes()
        self.doc = self.words.doc_of()

    def ids(self, name: str) -> np.ndarray:
        return self.rows.column(name).cast(pa.int64()).fill_null(_NO_ID).to_numpy()


class _Blocks:
    """Distinct rolling hashes of a batch, sorted: which are aligned blocks, and which are in several documents."""

    def __init__(self, b: _Batch, ids: np.ndarray, block: int) -> None:
        self.at = whole_windows(b.words, block)
        h = rolling(b.h, block)[self.at]
        order = np.argsort(h)
        s = h[order]
        fresh = np.ones(len(s), bool)
        fresh[1:] = s[1:] != s[:-1]
        head = np.flatnonzero(fresh)
        self.order, self.group = order, np.cumsum(fresh) - 1
        self.keys = s[head]
        if not len(s):
            self.aligned = self.several = np.empty(0, bool)
            return
        aligned = (self.at - b.words.first[b.doc[self.at]]) % block == 0
        self.aligned = np.logical_or.reduceat(aligned[order], head)
        _, number = np.unique(ids, return_inverse=True)
        d = number[b.doc[self.at[order]]]
        self.several = np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head)

    def marked(self, yes: np.ndarray, n: int) -> np.ndarray:
        """The words at which a run with a marked hash starts."""
        out = np.zeros(n, bool)
        out[self.at[self.order[yes[self.group]]]] = True
        return out


class _Candidates:
    """Distinct full windows around the marks of a batch, sorted, with the smallest id that holds each."""

    def __init__(self, b: _Batch, ids: np.ndarray, skip: np.ndarray, marks: np.ndarray, window: int, block: int) -> None:
        at = whole_windows(b.words, window)
        sums = np.concatenate([[0], np.cumsum(marks)])
        at = at[(sums[at + window - block + 1] > sums[at]) & ~skip[b.doc[at]]]
        a, c = rolling(b.h, window)[at], rolling(mix(b.h ^ _U(BASE_B)), window, BASE_B)[at]
        order = np.lexsort((c, a))
        a, c = a[order], c[order]
        fresh = np.ones(len(a), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        head = np.flatnonzero(fresh)
        self.at, self.group = at[order], np.cumsum(fresh) - 1
        self.a, self.c = a[head], c[head]
        self.owner = ids[b.doc[self.at]]
        self.least = np.minimum.reduceat(self.owner, head) if len(head) else np.empty(0, np.int64)

    def repeated(self, earlier: np.ndarray) -> np.ndarray:
        """The starts of windows that a document with a smaller id holds too."""
        return self.at[earlier[self.group] | (self.owner > self.least[self.group])]


def _batches(tables: Iterator[pa.RecordBatch], text: str, doc_id: str, limit: int) -> Iterator[pa.RecordBatch]:
    task, n = TaskContext.get().partitionId(), 0
    squeeze = zstandard.ZstdCompressor(level=3)
    for t in sliced(tables, text, limit):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as writer:
            writer.write_table(t.combine_chunks())
        blob = squeeze.compress(sink.getvalue())
        b = _Batch(blob, text)
        whole = whole_hashes(b.words, b.h)
        yield pa.RecordBatch.from_pydict(
            {
                "batch": pa.array([(task << 32) + n], pa.int64()),
                "rows": pa.array([blob], pa.binary()),
                "ids": pa.array([t.column(doc_id).cast(pa.int64()).to_pylist()], pa.list_(pa.int64())),
                "whole": pa.array([whole], pa.list_(pa.binary())),
            }
        )
        n += 1


def whole_hashes(words: Words, hashes: np.ndarray) -> list[bytes]:
    """128 bits for the whole word sequence of each document."""
    first, n = words.first, len(hashes)
    out = []
    sums = []
    for base, h in ((BASE_A, hashes), (BASE_B, mix(hashes ^ _U(BASE_B)))):
        p = powers(base, n + 1)
        s = np.concatenate([[_U(0)], np.cumsum(h * p.up[:n])])
        sums.append(mix((s[first[1:]] - s[first[:-1]]) * p.down[np.minimum(first[:-1], n)] + np.diff(first).astype(_U)))
    for x, y in zip(*sums, strict=True):
        out.append(int(x).to_bytes(8, "little") + int(y).to_bytes(8, "little"))
    return out


def _ids(values: list) -> np.ndarray:
    return np.array([_NO_ID if v is None else v for v in values], np.int64)


def _probe(rows: Iterator[pa.RecordBatch], text: str, block: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for r in rows:
        for batch, blob, ids in zip(r.column("batch").to_pylist(), r.column("rows"), r.column("ids").to_pylist(), strict=True):
            x = _Blocks(_Batch(blob.as_py(), text), _ids(ids), block)
            low = x.keys.astype(np.uint32)
            parts = _parts(x.keys, buckets)
            packed = [(j - i).to_bytes(4, "little") + low[i:j].tobytes() + np.packbits(x.aligned[i:j]).tobytes() + np.packbits(x.several[i:j]).tobytes() for _, i, j in parts]
            yield pa.RecordBatch.from_pydict(
                {"bucket": pa.array([p[0] for p in parts], pa.int32()), "batch": pa.array([batch] * len(parts), pa.int64()), "keys": pa.array(packed, pa.binary())}
            )


def _by_bucket(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """(bucket, batches, keys) for rows that are sorted by bucket."""
    now, batches, keys = None, [], []
    for r in rows:
        for bucket, batch, k in zip(r.column("bucket").to_pylist(), r.column("batch").to_pylist(), r.column("keys"), strict=True):
            if bucket != now and batches:
                yield now, batches, keys
                batches, keys = [], []
            now = bucket
            batches.append(batch)
            keys.append(k.as_py())
    if batches:
        yield now, batches, keys


def _answers(bucket: int, batches: list[int], sizes: list[int], yes: np.ndarray) -> pa.RecordBatch:
    ends = np.cumsum(sizes)
    some = [(b, np.packbits(yes[e - s : e]).tobytes()) for b, s, e in zip(batches, sizes, ends, strict=True) if yes[e - s : e].any()]
    return pa.RecordBatch.from_pydict(
        {"batch": pa.array([b for b, _ in some], pa.int64()), "bucket": pa.array([bucket] * len(some), pa.int32()), "bits": pa.array([x for _, x in some], pa.binary())}
    )


def _match_blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks the runs that equal an indexed block and occur in two documents or more."""
    for bucket, batches, keys in _by_bucket(rows):
        sizes = [int.from_bytes(k[:4], "little") for k in keys]
        low = np.concatenate([np.frombuffer(k, np.uint32, n, 4) for k, n in zip(keys, sizes, strict=True)])
        aligned, several = (
            np.concatenate([np.unpackbits(np.frombuffer(k, np.uint8, -(-n // 8), 4 + 4 * n + which * -(-n // 8)), count=n) for k, n in zip(keys, sizes, strict=True)]).astype(bool)
            for which in (0, 1)
        )
        index = np.unique(low[aligned])
        if not len(index):
            continue
        at = np.searchsorted(index, low)
        at[at == len(index)] = 0
        hit = np.flatnonzero(index[at] == low)
        weight = np.bincount(at[hit], weights=1 + several[hit].astype(np.int64), minlength=len(index))
        yes = np.zeros(len(low), bool)
        yes[hit] = weight[at[hit]] >= 2
        yield _answers(bucket, batches, sizes, yes)


_FULL = np.dtype([("a", "<u8"), ("c", "<u4"), ("doc", "<u4")])


def _match_windows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks the windows of a batch that a document with a smaller id than all of the batch's holds."""
    for bucket, batches, keys in _by_bucket(rows):
        entries, least, sizes = [], [], []
        for k in keys:
            n = int.from_bytes(k[:4], "little")
            e = np.frombuffer(k, _FULL, n, 4)
            entries.append(e)
            least.append(np.frombuffer(k, np.int64, offset=4 + n * _FULL.itemsize)[e["doc"]])
            sizes.append(n)
        e, d = np.concatenate(entries), np.concatenate(least)
        order = np.lexsort((e["c"], e["a"]))
        a, c = e["a"][order], e["c"][order]
        fresh = np.ones(len(a), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        head = np.flatnonzero(fresh)
        smallest = np.minimum.reduceat(d[order], head)
        yes = np.empty(len(d), bool)
        yes[order] = smallest[np.cumsum(fresh) - 1] < d[order]
        yield _answers(bucket, batches, sizes, yes)


def _unpacked(answers: list | None, parts: list[tuple[int, int, int]], n: int) -> np.ndarray:
    yes = np.zeros(n, bool)
    where = {b: (i, j) for b, i, j in parts}
    for x in answers or []:
        i, j = where[x["bucket"]]
        yes[i:j] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=j - i).astype(bool)
    return yes


def _read(r: pa.RecordBatch, text: str, window: int, block: int, buckets: int) -> Iterator[tuple[int, _Batch, np.ndarray, _Candidates, dict]]:
    """The batches of rows that carry their marks, with the windows to compare."""
    for i in range(r.num_rows):
        row = r.slice(i, 1).to_pylist()[0]
        b, ids = _Batch(row["rows"], text), _ids(row["ids"])
        skip = np.zeros(len(ids), bool)
        skip[row["copies"] or []] = True
        x = _Blocks(b, ids, block)
        yes = _unpacked(row["marks"], _parts(x.keys, buckets), len(x.keys))
        yield row["batch"], b, skip, _Candidates(b, ids, skip, x.marked(yes, len(b.h)), window, block), row


def _candidates(rows: Iterator[pa.RecordBatch], text: str, window: int, block: int, buckets: int, tasks: int) -> Iterator[pa.RecordBatch]:
    for r in rows:
        for batch, _, _, x, _ in _read(r, text, window, block, buckets):
            parts = _parts(x.a, tasks)
            packed = []
            for _, i, j in parts:
                ids, which = np.unique(x.least[i:j], return_inverse=True)
                e = np.empty(j - i, _FULL)
                e["a"], e["c"], e["doc"] = x.a[i:j], x.c[i:j].astype(np.uint32), which
                packed.append((j - i).to_bytes(4, "little") + e.tobytes() + ids.tobytes())
            yield pa.RecordBatch.from_pydict(
                {"bucket": pa.array([p[0] for p in parts], pa.int32()), "batch": pa.array([batch] * len(parts), pa.int64()), "keys": pa.array(packed, pa.binary())}
            )


def _cut(b: _Batch, d: int, gone: np.ndarray) -> str:
    """Text d without its runs of marked words, other characters unchanged."""
    lo, hi = b.words.first[d], b.words.first[d + 1]
    edge = np.diff(np.concatenate([[0], gone[lo:hi].astype(np.int8), [0]]))
    out, base = [], int(b.offsets[d])
    for x, y in zip(b.words.starts[lo + np.flatnonzero(edge == 1)].tolist(), b.words.ends[lo + np.flatnonzero(edge == -1) - 1].tolist(), strict=True):
        out.append(b.buf[base:x].tobytes())
        base = y
    out.append(b.buf[base : b.offsets[d + 1]].tobytes())
    return b"".join(out).decode()


def _kept(rows: Iterator[pa.RecordBatch], text: str, window: int, block: int, buckets: int, tasks: int, schema: pa.Schema, rejoin: bool) -> Iterator[pa.RecordBatch]:
    for r in rows:
        for _, b, skip, x, row in _read(r, text, window, block, buckets):
            earlier = _unpacked(row["earlier"], _parts(x.a, tasks), len(x.a))
            starts = x.repeated(earlier)
            gone = spans(starts, np.full(len(starts), window), len(b.h))
            gone |= (skip & (b.words.counts >= window))[b.doc]
            n_gone = np.bincount(b.doc[gone], minlength=len(skip))
            texts, first = [], b.words.first
            for d in range(len(skip)):
                if not rejoin:
                    texts.append(_cut(b, d, gone) if n_gone[d] else b.rows.column(text)[d].as_py())
                    continue
                words = b.buf[b.offsets[d] : b.offsets[d + 1]].tobytes().split()
                if n_gone[d]:
                    words = [w for w, g in zip(words, gone[first[d] : first[d + 1]].tolist(), strict=True) if not g]
                texts.append(b" ".join(words).decode())
            t = b.rows.set_column(b.rows.schema.get_field_index(text), text, pa.array(texts, pa.string()))
            t = t.append_column("n_words", pa.array(b.words.counts, pa.int64())).append_column("n_removed", pa.array(n_gone, pa.int64()))
            yield from t.select(schema.names).cast(schema).to_batches()


def remove_repeats(docs: DataFrame, window: int = 50, text: str = "text", doc_id: str = "doc_id", batch_bytes: int = 2 << 20, rejoin: bool = True) -> DataFrame:
    """The documents without the words of repeated windows, one row each.

    A word goes if a window of ``window`` words that covers it also starts in a
    document with a smaller id; windows are judged on the input. The text becomes
    the kept words joined by one space; n_words (before) and n_removed are added,
    replacing input columns of those names. Without ``rejoin`` the runs of removed
    words are cut out of the text and the rest stays as it is. A null or wordless
    text gives an empty text (without ``rejoin``: stays as it is). A null id counts
    as larger than all others. Rows with the same id don't take from each other.
    Words are what ``bytes.split()`` makes of the UTF-8 text. All other columns are
    carried along, whatever their names; an empty table gives an empty result. A
    text of any length is worked on whole, a very long one as a batch of its own.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    ship_code(spark)
    block = (window + 1) // 2
    docs = docs.drop(*[c for c in ("n_words", "n_removed") if c in docs.columns])
    schema = T.StructType([*[f if f.name != text else T.StructField(text, T.StringType()) for f in docs.schema.fields], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    arrow = to_arrow_schema(schema)
    tasks = shuffle_partitions(spark)
    buckets = 8 * tasks

    batches = written(docs.mapInArrow(lambda t: lean(_batches(t, text, doc_id, batch_bytes)), BATCH), "batches", "none")

    # Documents that are, as a whole, copies of one with a smaller id: they take part in the index, but are gone at once.
    whole = batches.select("batch", F.posexplode(F.arrays_zip("ids", "whole")).alias("pos", "x")).select("batch", "pos", F.col("x.ids").alias("id"), F.col("x.whole").alias("h"))
    first = written(whole.groupBy("h").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"), "first-copies")
    copies = whole.join(first, "h").where("id > first OR (id IS NULL AND first IS NOT NULL)").groupBy("batch").agg(F.collect_list("pos").alias("copies"))

    probes = batches.select("batch", "rows", "ids").mapInArrow(lambda r: lean(_probe(r, text, block, buckets)), PROBE)
    marks = probes.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda r: lean(_match_blocks(r)), ANSWER)
    marks = written(marks, "block-hits").groupBy("batch").agg(F.collect_list(F.struct("bucket", "bits")).alias("marks"))

    dealt = batches.select("batch", "rows", "ids").repartition(tasks, "batch")
    marked = dealt.join(marks.hint("shuffle_hash"), "batch", "left").join(copies.hint("shuffle_hash"), "batch", "left")
    full = marked.mapInArrow(lambda r: lean(_candidates(r, text, window, block, buckets, tasks)), PROBE)
    earlier = full.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda r: lean(_match_windows(r)), ANSWER)
    earlier = earlier.groupBy("batch").agg(F.collect_list(F.struct("bucket", "bits")).alias("earlier"))
    return marked.join(earlier.hint("shuffle_hash"), "batch", "left").mapInArrow(lambda r: lean(_kept(r, text, window, block, buckets, tasks, arrow, rejoin)), schema)
