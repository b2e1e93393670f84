"""Benchmark decontamination by an FM-index over each shard of the training texts.

A shard is a slice of whole documents that a task reads anyway, so nothing is
shuffled. Test phrases (windows of words) are searched backwards in the shard's
index, their places located, and overlapping places merged to removal spans. A
benchmark is sent to the tasks in blocks of a checked size; a larger one takes
several passes, which hand on what was hit so far.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fm_index import FIRST_SYMBOL, FMIndex, expand
from .store import ship_code, written
from .words import LOWER, NOT_ALNUM, Words, find_words, lean, sliced, spans, text_bytes

#: Bytes of the arrays of one block of the benchmark, and of them for each of its words at most.
BLOCK_BYTES, WORD_BYTES = 32 << 20, 32
#: A word as ``item_words`` finds it, in SQL's regular expressions.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
STATE = ("_hits", "_items")


def item_words(buf: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of letters and digits, A-Z lower-cased."""
    return find_words(LOWER[buf], offsets, NOT_ALNUM)


class Phrases:
    """The windows of a block of benchmark items, grouped by length, as places in a row of words.

    ``words``: hashes of the different words; ``code``: which of them each word
    is. A window is 12 bytes besides its words, equal windows of several items
    are searched each.
    """

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        texts = pa.array([t for _, t in items], pa.large_string())
        w = item_words(*text_bytes(texts))
        self.words, code = np.unique(w.hashes(), return_inverse=True)
        self.code = code.astype(np.int32)
        self.names = sorted({i for i, _ in items})
        number = {x: i for i, x in enumerate(self.names)}
        owner = np.array([number[i] for i, _ in items], np.int32)
        lengths = np.minimum(w.counts, window)
        self.by_length: list[tuple[int, np.ndarray, np.ndarray]] = []
        for length in np.unique(lengths[lengths > 0]).tolist():
            d = np.flatnonzero(lengths == length)
            starts, which = expand(w.first[d], w.first[d] + w.counts[d] - length + 1)
            self.by_length.append((length, starts, owner[d[which]]))

    def nbytes(self) -> int:
        return self.words.nbytes + self.code.nbytes + sum(s.nbytes + o.nbytes for _, s, o in self.by_length)


def _search(w: Words, phrases: Phrases) -> tuple[np.ndarray, list[list[int]]]:
    """Of a shard's words, which are hit; of each text, the items that occur in it."""
    n_docs, n = len(w.first) - 1, len(w.starts)
    found: list[list[int]] = [[] for _ in range(n_docs)]
    hit = np.zeros(n, bool)
    if not n:
        return hit, found
    vocabulary, symbol = np.unique(w.hashes(), return_inverse=True)
    # Texts are parted by symbol 1; word i of text d stands at place i + d.
    seq = np.ones(n + n_docs, np.int32)
    seq[np.arange(n) + w.doc_of()] = symbol + FIRST_SYMBOL
    seq[-1] = 0
    del symbol
    known = np.searchsorted(vocabulary, phrases.words)
    known[known == len(vocabulary)] = 0
    absent = (vocabulary[known] != phrases.words)[phrases.code]
    gone = np.concatenate([[0], np.cumsum(absent)])  # words before a place that this shard doesn't have
    index = None
    for length, starts, owners in phrases.by_length:
        here = np.flatnonzero(gone[starts + length] == gone[starts])
        if not len(here):
            continue
        index = index or FMIndex(seq)
        who, lo, hi = index.search(known[phrases.code[starts[here][:, None] + np.arange(length)]] + FIRST_SYMBOL)
        if not len(who):
            continue
        suffixes, which = expand(lo, hi)
        places = index.locate(suffixes)
        docs = np.searchsorted(w.first[1:] + np.arange(1, n_docs + 1), places, "right")
        hit |= spans(places - docs, np.full(len(places), length), n)
        for d, i in np.unique(np.stack([docs, owners[here[who][which]]], 1), axis=0).tolist():
            found[d].append(i)
    return hit, found


def _pass(batches: Iterator[pa.RecordBatch], text: str, phrases: Phrases, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for t in sliced(batches, text):
        w = item_words(*text_bytes(t.column(text)))
        hit, found = _search(w, phrases)
        hits, items = [], []
        had = zip(t.column("_hits").to_pylist(), t.column("_items").to_pylist(), strict=True)
        for d, (mask, names) in enumerate(had):
            own = hit[w.first[d] : w.first[d + 1]]
            if mask:
                own = own | np.unpackbits(np.frombuffer(mask, np.uint8), count=len(own)).astype(bool)
            hits.append(np.packbits(own).tobytes() if own.any() else None)
            items.append(sorted({*(names or []), *(phrases.names[i] for i in found[d])}))
        kept = t.drop_columns(list(STATE)).append_column("_hits", pa.array(hits, pa.binary())).append_column("_items", pa.array(items, pa.list_(pa.string())))
        yield from kept.select(schema.names).cast(schema).to_batches()


def _finish(batches: Iterator[pa.RecordBatch], text: str, schema: pa.Schema, cut: bool) -> Iterator[pa.RecordBatch]:
    for t in sliced(batches, text):
        buf, offsets = text_bytes(t.column(text))
        w = item_words(buf, offsets)
        out = {"n_words": w.counts, "n_hit": [], "spans": [], "cut": []}
        for d, mask in enumerate(t.column("_hits").to_pylist()):
            a, b = w.first[d], w.first[d + 1]
            if not mask:
                out["n_hit"].append(0)
                out["spans"].append([])
                out["cut"].append(t.column(text)[d].as_py() if cut else None)
                continue
            hit = np.unpackbits(np.frombuffer(mask, np.uint8), count=b - a).astype(np.int8)
            edge = np.diff(np.concatenate([[0], hit, [0]]))
            lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            out["n_hit"].append(int(hit.sum()))
            out["spans"].append([{"start": int(x), "end": int(y)} for x, y in zip(lo, hi, strict=True)])
            if cut:
                left, base = [], int(offsets[d])
                for x, y in zip(w.starts[a + lo], w.ends[a + hi - 1], strict=True):
                    left.append(buf[base:x].tobytes())
                    base = int(y)
                left.append(buf[base : offsets[d + 1]].tobytes())
                out["cut"].append(b"".join(left).decode())
            else:
                out["cut"].append(None)
        items = t.column("_items").to_pylist()
        cols = {
            "n_words": pa.array(out["n_words"], pa.int64()),
            "n_hit": pa.array(out["n_hit"], pa.int64()),
            "items": pa.array(items, pa.list_(pa.string())),
            "n_items": pa.array([len(x) for x in items], pa.int64()),
            "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]),
            "contaminated": pa.array([x > 0 for x in out["n_hit"]]),
            "spans": pa.array(out["spans"], schema.field("spans").type),
        }
        t = t.drop_columns(list(STATE))
        if cut:
            i = t.schema.get_field_index(text)
            t = t.set_column(i, text, pa.array(out["cut"], pa.string()))
        for k, v in cols.items():
            t = t.append_column(k, v)
        yield from t.select(schema.names).cast(schema).to_batches()


RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text", cut: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with the words that benchmark windows cover.

    Adds n_words, n_hit, n_items, items (ids of the items with occurring windows,
    sorted as strings), items_sha256, contaminated and spans (merged, in words).
    cut: take the spans out of the text, from the first byte of their first word
    to the last of their last. An item of fewer than ``window`` words is one
    window; an item without words (null, empty) has none; items of one id count
    as one, and a null id is ignored. A document with null or empty text has no
    words and isn't contaminated. Repeated documents are judged each by itself.
    Input columns named like results are replaced; an empty table of either kind
    gives rows without hits.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ship_code(docs.sparkSession)
    names = [f.name for f in RESULT.fields]
    docs = docs.drop(*[c for c in (*names, *STATE) if c in docs.columns and c != text])
    items = benchmark.select(F.col(item).cast("string").alias("id"), F.col(item_text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    total = items.agg(F.sum(F.regexp_count("text", F.lit(WORD))).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total * WORD_BYTES // block_bytes))  # an item is never cut, so a block has one at least
    if blocks > 1:
        items = written(items.withColumn("b", F.pmod(F.xxhash64("id", "text"), F.lit(blocks))), "benchmark-blocks")
    state = T.StructType([*docs.schema.fields, T.StructField("_hits", T.BinaryType()), T.StructField("_items", T.ArrayType(T.StringType()))])
    arrow = to_arrow_schema(state)
    result = T.StructType([*docs.schema.fields, *RESULT.fields])
    final = to_arrow_schema(result)
    out = docs.withColumns({"_hits": F.lit(None).cast("binary"), "_items": F.lit(None).cast("array<string>")})
    for b in range(blocks):
        block = items.where(F.col("b") == b) if blocks > 1 else items
        phrases = Phrases([(r["id"], r["text"]) for r in block.select("id", "text").toLocalIterator()], window)
        if b + 1 < blocks:
            out = written(out.mapInArrow(lambda batches, p=phrases: lean(_pass(batches, text, p, arrow)), state), "contamination-pass")
    return out.mapInArrow(lambda batches: lean(_finish(_pass(batches, text, phrases, arrow), text, final, cut)), result)
