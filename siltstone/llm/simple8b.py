"""Token-id files in Simple-8b: 64-bit words that hold as many ids as fit.

A word has a selector in its upper 4 bits and up to 240 ids of equal width in
the other 60. Blocks of 256 ids start a new word; the offsets of their first
words are stored, and with them all words of a section are decoded at once,
selector by selector. Ids of more than 60 bits (none of a tokenizer's) escape
to a list of raw values; such a word has the value's number there.

File: sections one after the other, each a header of ten little-endian 64-bit
integers (magic, version, documents, ids, blocks, words, escapes, ids in the
file before it, bytes of the section, crc32 of its body) and a body: document
ids, a bitmap of null document ids, ids per document, first word per block,
words, escapes.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import new_path, ship_code, shuffle_partitions, written
from .tokens import chunk_tokenizer
from .words import sliced, text_bytes

BLOCK = 256
MAGIC, VERSION = 0x3842_5349_4C54_4F4B, 1
#: Ids per word and bits per id of selectors 1 to 15 (fixed by the format's 60 bits); 0 escapes.
COUNTS = np.array([1, 240, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_U = np.uint64


def _bits(v: np.ndarray) -> np.ndarray:
    """The bit lengths of unsigned integers, as uint8."""
    big = v >> _U(32) > 0
    if not big.any():
        return np.frexp(v.astype(np.float64))[1].astype(np.uint8)  # exact below 2**53
    return np.where(big, 32 + np.frexp((v >> _U(32)).astype(np.float64))[1], np.frexp((v & _U(0xFFFFFFFF)).astype(np.float64))[1]).astype(np.uint8)


def encode(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each block (with a last entry for the end), and escaped values."""
    n = len(v)
    v = v.astype(_U)
    blocks = -(-n // BLOCK)
    wide = v >> _U(60) > 0
    escapes = v[wide]
    widths = np.zeros((blocks, BLOCK + 240), np.uint8)
    flat = np.zeros(blocks * BLOCK, np.uint8)
    flat[:n] = _bits(v)
    widths[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    length = np.full(blocks, BLOCK)
    if n % BLOCK:
        length[-1] = n % BLOCK
    # The largest count from each place whose ids all fit its width; past a block's end everything fits.
    # What fits a count also fits every smaller one, as its width is larger, so fits are counted, and a
    # block in which a count fits nowhere before its end is done with.
    best = np.where(widths[:, :BLOCK] > 60, np.uint8(0), np.uint8(15))
    open_, runs = np.arange(blocks), {1: widths}
    for c in (2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 120, 240):
        half = max(k for k in runs if k <= c)
        m, short = runs[half], c - half
        if short:  # two overlapping runs of a length that is there
            m = np.maximum(m[:, : m.shape[1] - short], m[:, short:])
        runs[c] = m
        if c != 120:
            fits = m[:, :BLOCK] <= WIDTHS[int(np.flatnonzero(COUNTS[1:] == c)[0]) + 1]
            best[open_] -= fits.view(np.uint8)
            more = fits[:, : BLOCK - c].any(1)
            if not more.all():
                open_ = open_[more]
                runs = {k: x[more] for k, x in runs.items() if 2 * k >= c}
                if not len(open_):
                    break
    at, rows = np.zeros(blocks, np.int64), np.arange(blocks)
    chosen = []
    while len(rows):
        s = best[rows, at[rows]]
        chosen.append(np.stack([rows, at[rows], s], 1))
        at[rows] += COUNTS[s]
        rows = rows[at[rows] < length[rows]]
    steps = np.concatenate(chosen) if chosen else np.empty((0, 3), np.int64)
    steps = steps[np.lexsort((steps[:, 1], steps[:, 0]))]
    first = np.searchsorted(steps[:, 0], np.arange(blocks + 1))
    start, sel = steps[:, 0] * BLOCK + steps[:, 1], steps[:, 2]
    words = sel.astype(_U) << _U(60)
    padded = np.concatenate([v, np.zeros(240, _U)])
    ends = steps[:, 0] * BLOCK + length[steps[:, 0]]
    for s in range(2, 16):
        w = np.flatnonzero(sel == s)
        for j in range(COUNTS[s]):
            value = np.where(start[w] + j < ends[w], padded[start[w] + j], _U(0))
            words[w] |= value << _U(j * WIDTHS[s])
    w = np.flatnonzero(sel == 0)
    words[w] |= np.searchsorted(np.flatnonzero(wide), start[w]).astype(_U)
    return words, first.astype(np.uint32), escapes


def decode(words: np.ndarray, first: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The n values again."""
    out = np.zeros(n, _U)
    sel = (words >> _U(60)).astype(np.int64)
    count = COUNTS[sel]
    block = np.repeat(np.arange(len(first) - 1), np.diff(first.astype(np.int64)))
    total = np.cumsum(count) - count
    start = total - total[first[:-1]][block] + block * BLOCK if len(words) else total
    ends = np.minimum((block + 1) * BLOCK, n)
    for s in range(2, 16):
        w = np.flatnonzero(sel == s)
        mask = _U((1 << int(WIDTHS[s])) - 1)
        for j in range(COUNTS[s]):
            to = start[w] + j
            some = to < ends[w]
            out[to[some]] = (words[w[some]] >> _U(j * WIDTHS[s])) & mask
    w = np.flatnonzero(sel == 0)
    if len(w):
        out[start[w]] = escapes[(words[w] & _U((1 << 60) - 1)).astype(np.int64)]
    return out


@dataclass
class Section:
    doc_ids: np.ndarray
    null_ids: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    before: int

    def to_bytes(self) -> bytes:
        words, first, escapes = encode(self.ids)
        parts = [self.doc_ids.astype("<i8"), np.packbits(self.null_ids), self.counts.astype("<i8"), first.astype("<u4"), words.astype("<u8"), escapes.astype("<u8")]
        body = b"".join(p.tobytes() for p in parts)
        head = [MAGIC, VERSION, len(self.doc_ids), len(self.ids), len(first) - 1, len(words), len(escapes), self.before, 80 + len(body), zlib.crc32(body)]
        return np.array(head, "<i8").tobytes() + body

    @staticmethod
    def read(f: pa.NativeFile) -> Section | None:
        head = f.read(80)
        if not head:
            return None
        magic, version, docs, n, blocks, words, escapes, before, size, crc = np.frombuffer(head, "<i8").tolist()
        body = f.read(size - 80)
        if magic != MAGIC or version != VERSION or len(body) != size - 80 or zlib.crc32(body) != crc:
            raise ValueError("not a section, or a damaged one")
        out, at = [], 0
        for kind, k in (("<i8", docs), ("u1", -(-docs // 8)), ("<i8", docs), ("<u4", blocks + 1), ("<u8", words), ("<u8", escapes)):
            out.append(np.frombuffer(body, kind, k, at))
            at += out[-1].nbytes
        return Section(out[0], np.unpackbits(out[1], count=docs).astype(bool), out[2], decode(out[4], out[3], out[5], n), before)


FILES = T.StructType(
    [T.StructField("part", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("documents", T.LongType()), T.StructField("ids", T.LongType()), T.StructField("bytes", T.LongType())]
)


def _write(batches: Iterator[pa.RecordBatch], folder: str, text: str, doc_id: str, path: str, kind: str, end: int) -> Iterator[pa.RecordBatch]:
    tokenizer, task = chunk_tokenizer(path, kind), TaskContext.get().partitionId()
    fs, root = pa.fs.FileSystem.from_uri(folder)
    name = f"ids-{task:06d}-{uuid.uuid4().hex}.s8b"  # an attempt that is repeated has a file of its own
    docs = total = size = 0
    out = None
    for t in sliced(batches, text):
        ids, at = tokenizer.encode(*text_bytes(t.column(text)))
        ids = np.insert(ids, at[1:], end)
        counts = np.diff(at) + 1
        keys = t.column(doc_id).cast(pa.int64())
        section = Section(keys.fill_null(0).to_numpy(), keys.is_null().to_numpy(), counts, ids, total).to_bytes()
        if out is None:
            fs.create_dir(root, recursive=True)
            out = fs.open_output_stream(f"{root}/{name}")
        out.write(section)
        docs, total, size = docs + t.num_rows, total + len(ids), size + len(section)
    if out is not None:
        out.close()
        yield pa.RecordBatch.from_pylist([{"part": task, "file": f"{folder}/{name}", "documents": docs, "ids": total, "bytes": size}], pa.schema([("part", pa.int32()), ("file", pa.string()), ("documents", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]))


def write_token_files(docs: DataFrame, tokenizer: str, kind: str, end: int, folder: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Write the ids of all documents, in ascending order of doc_id, and return the table of files.

    Each row: part (files in order), file, documents, ids, bytes. The folder must
    be one that all executors share; without one, a new one is made below
    ``spark.checkpoint.dir``. A null text has the end id alone; null ids come
    first; equal ids keep any order among them. Texts are tokenized whole, of any
    length. Only the two columns named are read; an empty table gives no files.
    """
    spark = docs.sparkSession
    ship_code(spark)
    folder = folder or new_path(spark, "token-files")
    rows = docs.select(doc_id, text).repartitionByRange(shuffle_partitions(spark), doc_id).sortWithinPartitions(doc_id)
    return written(rows.mapInArrow(lambda b: _write(b, folder, text, doc_id, tokenizer, kind, end), FILES), "token-file-list")


TOKENS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            fs, path = pa.fs.FileSystem.from_uri(row["file"])
            with fs.open_input_stream(path) as f:
                while section := Section.read(f):
                    ends = np.cumsum(section.counts)
                    raw = section.ids.astype("<u4").tobytes()
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(section.doc_ids, pa.int64(), mask=section.null_ids),
                            "start": pa.array(row["base"] + section.before + ends - section.counts, pa.int64()),
                            "n_tokens": pa.array(section.counts, pa.int64()),
                            "ids": pa.array([raw[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), section.counts.tolist(), strict=True)], pa.binary()),
                        }
                    )


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, and ids as little-endian 32-bit integers."""
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row a file
    based = files.select("file", "part", F.coalesce(before, F.lit(0)).alias("base"))
    return based.repartition(shuffle_partitions(files.sparkSession), "part").mapInArrow(_read, TOKENS)
