"""Sequence packing by minimum bin slack.

Tasks tokenize and cut their documents; nothing but small piece rows leaves
them. What decides the packing is the histogram of piece lengths, which has at
most ``size`` entries at any scale, so the driver packs the histogram: per bin,
bitset subset-sum dynamic programming over the lengths that are left finds the
fullest feasible combination, and it is taken as often as the counts allow.
Pieces are then numbered within their length and find their bin in a table of
number ranges, whose size also follows ``size`` and not the data.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import ship_code, written
from .tokens import chunk_tokenizer
from .words import lean, sliced, text_bytes

PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("_task", T.IntegerType()),
        T.StructField("_nth", T.LongType()),
    ]
)


@dataclass(frozen=True)
class Pattern:
    """Bins that all hold the same lengths: (length, how many of it), longest first."""

    lengths: tuple[tuple[int, int], ...]
    bins: int


def fullest(counts: dict[int, int], seed: int, size: int) -> list[tuple[int, int]]:
    """The fullest combination of available lengths that fits and holds ``seed``, longer ones preferred.

    Bit s of a set says that the lengths so far can make the sum s. How many
    there are of a length is reached by doubling, so each takes few shifts.
    """
    room = size - seed
    within = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted(x for x in counts if x <= room):
        n = min(counts[length] - (length == seed), room // length)
        if n <= 0:
            continue
        steps.append((length, n, reach))
        part = 1
        while n > 0:
            part = min(part, n)
            reach |= (reach << (part * length)) & within
            n -= part
            part *= 2
    left = reach.bit_length() - 1
    taken = {seed: 1}
    for length, n, before in reversed(steps):
        for c in range(min(n, left // length), -1, -1):
            if before >> (left - c * length) & 1:
                if c:
                    taken[length] = taken.get(length, 0) + c
                    left -= c * length
                break
    return sorted(taken.items(), reverse=True)


def pack_lengths(histogram: dict[int, int], size: int) -> list[Pattern]:
    """Patterns that take all lengths of the histogram; each length is at least 1 and at most ``size``."""
    counts = {k: v for k, v in histogram.items() if v}
    out = []
    while counts:
        lengths = fullest(counts, max(counts), size)
        bins = min(counts[x] // c for x, c in lengths)
        out.append(Pattern(tuple(lengths), bins))
        for x, c in lengths:
            counts[x] -= c * bins
            if not counts[x]:
                del counts[x]
    return out


class Places:
    """For the n-th piece of a length: its bin and its offset there."""

    def __init__(self, patterns: list[Pattern]) -> None:
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        bin_ = 0
        for p in patterns:
            offset = 0
            for length, c in p.lengths:
                rows.setdefault(length, []).append((used.get(length, 0), bin_, c, offset))
                used[length] = used.get(length, 0) + c * p.bins
                offset += c * length
            bin_ += p.bins
        self.rows = {k: np.array(v, np.int64) for k, v in rows.items()}

    def find(self, length: int, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = self.rows[length]
        row = rows[np.searchsorted(rows[:, 0], nth, "right") - 1]
        nth = nth - row[:, 0]
        return row[:, 1] + nth // row[:, 2], row[:, 3] + nth % row[:, 2] * length


def _pieces(batches: Iterator[pa.RecordBatch], text: str, doc_id: str, path: str, kind: str, end: int, size: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    tokenizer, task = chunk_tokenizer(path, kind), TaskContext.get().partitionId()
    seen = np.zeros(size + 1, np.int64)
    for t in sliced(batches, text):
        ids, at = tokenizer.encode(*text_bytes(t.column(text)))
        ids = np.insert(ids, at[1:], end).astype("<u4")  # the end id after each text
        at = at + np.arange(len(at))
        n = np.diff(at)
        short = n % size
        pieces = n // size + (short > 0)
        doc = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        lead = np.where(short > 0, short, size)[doc]
        start = np.where(piece > 0, lead + (piece - 1) * size, 0)
        length = np.where(piece > 0, size, lead)
        begin = at[doc] + start
        order = np.argsort(length, kind="stable")
        s = length[order]
        nth = np.empty(len(s), np.int64)
        run = np.arange(len(s)) - np.searchsorted(s, s)
        nth[order] = run + seen[s]
        seen += np.bincount(length, minlength=size + 1)
        raw = ids.tobytes()
        crc = [zlib.crc32(raw[4 * b : 4 * (b + m)]) for b, m in zip(begin.tolist(), length.tolist(), strict=True)]
        cols = {
            "doc_id": t.column(doc_id).cast(pa.int64()).combine_chunks().take(pa.array(doc)),
            "piece": pa.array(piece, pa.int32()),
            "start": pa.array(start, pa.int64()),
            "length": pa.array(length, pa.int64()),
            "ids_crc32": pa.array(crc, pa.int64()),
            "_task": pa.array(np.full(len(doc), task), pa.int32()),
            "_nth": pa.array(nth, pa.int64()),
        }
        if keep_ids:
            cols["ids"] = pa.array([ids[b : b + m].astype(np.int32) for b, m in zip(begin, length, strict=True)], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_pydict(cols)


def _place(batches: Iterator[pa.RecordBatch], places: Places) -> Iterator[pa.RecordBatch]:
    for b in batches:
        length, nth = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "_nth"))
        bin_, offset = np.empty(len(nth), np.int64), np.empty(len(nth), np.int64)
        for x in np.unique(length):
            rows = np.flatnonzero(length == x)
            bin_[rows], offset[rows] = places.find(int(x), nth[rows])
        names = [c for c in b.schema.names if c != "_nth"]
        yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(bin_), pa.array(offset)], [*names, "sequence_id", "offset"])


def pack_documents(docs: DataFrame, tokenizer: str, kind: str = "spaced", end: int = 0, size: int = 2048, text: str = "text", doc_id: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most ``size`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset, and ids with ``keep_ids``. A document is its ids and ``end``; only
    one of more than ``size`` tokens is cut, into pieces of ``size`` of which the
    first may be shorter. A null text is as an empty one and packs as ``end``
    alone. Documents with the same or a null id, and repeated rows, are packed
    each by itself. Other columns are left out. An empty table gives no rows.
    """
    ship_code(docs.sparkSession)
    schema = T.StructType([*PIECE.fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else [])])
    pieces = written(docs.select(doc_id, text).mapInArrow(lambda b: lean(_pieces(b, text, doc_id, tokenizer, kind, end, size, keep_ids)), schema), "pieces")
    by_task = written(pieces.groupBy("length", "_task").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    places = Places(pack_lengths(histogram, size))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    base = by_task.select("length", "_task", F.coalesce(before, F.lit(0)).alias("_base"))
    numbered = pieces.join(base, ["length", "_task"]).withColumn("_nth", F.col("_nth") + F.col("_base"))
    names = [f.name for f in schema.fields if f.name not in ("_task", "_nth")]
    out = T.StructType([*[schema[n] for n in names], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return numbered.select(*names, "_nth").mapInArrow(lambda b: lean(_place(b, places)), out)


def sequences(pieces: DataFrame) -> DataFrame:
    """Packed sequences (sequence_id, doc_ids, ids) of pieces that kept their ids; a group has ``size`` ids at most."""
    parts = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return parts.select("sequence_id", F.col("p.doc_id").alias("doc_ids"), F.flatten(F.col("p.ids")).alias("ids"))
