"""Texts longer than a slice, columns with clashing names, repeated rows and empty tables, for the operators on texts."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import order_minhash, packing, simple8b
from siltstone.llm.decontaminate import find_contamination
from siltstone.llm.substring import remove_repeats
from siltstone.llm.words import SLICE

from .conftest import frame

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def long(words):
    rng = random.Random(12)
    out = [rng.choice(words) for _ in range(900_000)]
    assert len(" ".join(out).encode()) > SLICE + (1 << 20)
    return out


@pytest.fixture(scope="module")
def rows(long):
    own = [f"own{i}" for i in range(80)]
    changed = list(long)
    for i in range(0, len(changed), 100_000):
        changed[i] = "changed"
    return [(1, " ".join(long)), (2, " ".join([*own, *long[1000:1100], *own])), (3, " ".join(long)), (3, " ".join(long)), (4, " ".join(changed)), (5, None), (6, "")]


def clashing(docs):
    """The documents with columns that are named like results and helpers."""
    for c in ("n_words", "n_removed", "class_id", "piece", "ids", "start", "spans", "items", "_hits", "batch", "key", "id"):
        docs = docs.withColumn(c, F.lit("clash"))
    return docs


def test_long_texts_in_substring_dedup(spark, rows, long):
    got = [(r["doc_id"], r["n_words"], r["n_removed"]) for r in remove_repeats(clashing(frame(spark, rows))).collect()]
    n = len(long)
    assert sorted(got)[:4] == [(1, n, 0), (2, 260, 100), (3, n, n), (3, n, n)] and sorted(got)[5:] == [(5, 0, 0), (6, 0, 0)]
    assert dict(x[::2] for x in got)[4] == n - sum(1 for i in range(0, n, 100_000))
    assert remove_repeats(clashing(frame(spark, rows)).limit(0)).count() == 0


def test_long_texts_in_near_dedup(spark, rows):
    got = sorted(tuple(r) for r in order_minhash.near_duplicates(clashing(frame(spark, rows))).collect())
    assert [r[:2] for r in got] == [(1, 1), (2, 2), (3, 1), (3, 1), (4, 1), (5, 5), (6, 6)]
    assert order_minhash.near_duplicates(clashing(frame(spark, rows)).limit(0)).count() == 0


def test_long_texts_in_decontamination(spark, rows, long):
    bench = spark.createDataFrame([(1, " ".join(long[500_050:500_062])), (2, " ".join(f"own{i}" for i in range(5, 20)))], "item_id long, text string").withColumn("id", F.lit("clash"))
    got = {r["doc_id"]: (r["n_hit"], r["items"], [tuple(s) for s in r["spans"]]) for r in find_contamination(clashing(frame(spark, rows)), bench).collect()}
    assert got[1] == got[3] == got[4] == (12, ["1"], [(500_050, 500_062)])
    assert got[2] == (30, ["2"], [(5, 20), (185, 200)]) and got[5] == got[6] == (0, [], [])


def test_long_texts_in_token_files_and_packing(spark, rows):
    from tokenizers import Tokenizer

    some = rows[:2] + rows[4:]
    docs = clashing(frame(spark, some))
    for name, kind in (("word_bpe_49k.json", "bare"), ("byte_bpe_50k.json", "spaced")):
        t = Tokenizer.from_file(P.path(name))
        want = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x in some}
        if kind == "bare":
            got = simple8b.read_token_files(simple8b.write_token_files(docs, P.path(name), kind, 1)).select("doc_id", "n_tokens", F.crc32("ids").alias("c")).collect()
            assert {r["doc_id"]: (r["n_tokens"], r["c"]) for r in got} == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in want.items()}
        else:
            out = packing.pack_documents(docs, P.path(name), kind, end=1, size=2048).collect()
            for i, ids in want.items():
                pieces = sorted((r for r in out if r["doc_id"] == i), key=lambda r: r["piece"])
                assert [r["start"] for r in pieces] == [sum(p["length"] for p in pieces[:k]) for k in range(len(pieces))]
                assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in pieces) and sum(r["length"] for r in pieces) == len(ids)
                assert len(ids) <= 2048 or all(r["length"] == 2048 for r in pieces[1:])
