"""Substring and near-duplicate operators against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import order_minhash as om
from siltstone.llm.substring import remove_repeats
from siltstone.llm.words import SPACES, find_words, rolling, text_bytes, whole_windows

from .conftest import frame


def brute_substring(rows, window=50):
    """Per row: words, words removed, words kept."""
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in texts:
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


@pytest.mark.parametrize("batch_bytes", [2 << 20, 3000])
def test_substring_equals_brute_force(spark, corpus, batch_bytes):
    got = remove_repeats(frame(spark, corpus).repartition(3), batch_bytes=batch_bytes).select("doc_id", "n_words", "n_removed", "text").collect()
    assert sorted(tuple(r) for r in got) == sorted(brute_substring(corpus))


def test_substring_small_windows(spark, corpus):
    got = remove_repeats(frame(spark, corpus), window=7).select("doc_id", "n_words", "n_removed", "text").collect()
    assert sorted(tuple(r) for r in got) == sorted(brute_substring(corpus, 7))


def test_substring_keeps_columns_and_layout(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = frame(spark, [(1, passage), (2, "a\n" + passage + "\n\nb"), (None, passage), (3, None)]).withColumn("n_words", F.lit("clash")).withColumn("extra", F.array(F.lit(1)))
    out = {r["doc_id"]: r for r in remove_repeats(docs, rejoin=False).collect()}
    assert out[2]["text"] == "a\n\n\nb" and out[2]["n_removed"] == 60 and out[2]["extra"] == [1]
    assert out[1]["text"] == passage and out[None]["text"] == "" and out[3]["text"] is None
    assert remove_repeats(docs.limit(0)).count() == 0


def test_words_and_windows():
    import pyarrow as pa

    texts = ["a bb  a bb", "", "bb a", "é\x85z"]
    w = find_words(*text_bytes(pa.array(texts)), SPACES)
    assert w.counts.tolist() == [4, 0, 2, 1]
    h = w.hashes()
    assert h[0] == h[2] == h[5] and h[1] == h[3] == h[4] and len(set(h.tolist())) == 3
    r = rolling(h, 2)
    assert whole_windows(w, 2).tolist() == [0, 1, 2, 4] and r[0] == r[2] and r[1] == r[4]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def near(x, y):
    """Whether two texts link: 0.8 of their words in common order; texts of fewer than five words only if they are equal."""
    x, y = (x or "").encode().split(), (y or "").encode().split()
    if min(len(x), len(y)) < 5:
        return bool(x) and x == y
    most = sum((Counter(x) & Counter(y)).values())
    if most < 0.8 * (len(x) + len(y) - most):
        return False
    m = len(x) if x == y else lcs(x, y)
    return m >= 0.8 * (len(x) + len(y) - m)


@pytest.mark.parametrize("seed", range(6))
def test_alignment_equals_longest_common_subsequence(seed):
    rng = random.Random(seed)
    a = [rng.randint(0, 400) for _ in range(rng.randint(1, 120))]
    b = list(a)
    for _ in range(rng.randint(0, 14)):
        i = rng.randrange(len(b) + 1)
        b[i : i + rng.randint(0, 2)] = [rng.randint(0, 400) for _ in range(rng.randint(0, 2))]
    m = lcs(a, b)
    want = m / (len(a) + len(b) - m)
    got = om.similarity(np.array(a), np.array(b, np.int64))
    assert got == pytest.approx(want if want >= 0.8 else 0.0)


def test_near_duplicates_equal_brute_force(spark, corpus):
    got = {r["doc_id"]: r["class_id"] for r in om.near_duplicates(frame(spark, corpus)).collect()}
    texts = {i: t for i, t in corpus}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and near(texts[a], texts[b]):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    assert got == {i: root(i) for i in texts}
    assert got[1] == 1 and got[2] == 2 and got[3] == 3


def test_near_duplicates_edge_cases(spark):
    docs = frame(spark, [(None, "a b c"), (7, "a b c"), (3, "a  b\nc"), (3, "a b c"), (9, "a b")]).withColumn("class_id", F.lit("x"))
    got = sorted((r["doc_id"] or -1, r["class_id"], r["copy"]) for r in om.near_duplicates(docs).collect())
    assert got == [(-1, None, False), (3, 3, False), (3, 3, False), (7, 3, True), (9, 9, False)]
    assert om.near_duplicates(docs.limit(0)).count() == 0


def test_no_pair_of_a_large_group_is_left_out(spark):
    """Pairs under one key of many texts, which are neither linked to a hub nor neighbours by their other keys."""
    import zstandard

    rng = np.random.default_rng(8)
    rows = []
    for i in range(150):
        code = rng.integers(0, 2**16, 60 + i % 7 * 10).astype("<u2")
        for j in (2 * i, 2 * i + 1):
            code = code.copy()
            code[j % 50] ^= 1
            keys = [77, *rng.integers(0, 2**62, om.SKETCHES - 1).tolist()]
            rows.append((j, len(code), str(j).encode(), keys, zstandard.compress(code.tobytes())))
    table = spark.createDataFrame(rows, om.SKETCH)
    links = om._rounds(table, table.select("id"), 0.8)
    assert {(r["a"], r["b"]) for r in links.collect()} == {(2 * i, 2 * i + 1) for i in range(150)}


def test_drifting_family_equals_brute_force(spark, words):
    """Copies edited from copies, so that no text is near all others."""
    rng = random.Random(4)
    texts = [[rng.choice(words) for _ in range(90)]]
    for i in range(1, 400):
        w = list(texts[max(0, i - rng.randint(1, 20))])
        for _ in range(rng.choice([2, 4, 7, 11, 15])):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(w)
    got = {r["doc_id"]: r["class_id"] for r in om.near_duplicates(frame(spark, [(i, " ".join(w)) for i, w in enumerate(texts)])).collect()}
    number = {w: i for i, w in enumerate(words)}
    grams = [np.array([number[x] for x in w]) for w in texts]
    w = find_words(*text_bytes(pa.array([" ".join(w) for w in texts])), SPACES)
    x, first = om.kmers(w, w.hashes())
    keys = om.sketches(om.labelled(x, first), first, x)
    want = list(range(len(texts)))
    for b in range(len(texts)):
        for a in np.flatnonzero((keys[:b] == keys[b]).any(1)).tolist():  # pairs that share a key; that near ones do is tested by itself
            if want[a] != want[b] and om.similarity(grams[a], grams[b]):
                p, q = sorted((want[a], want[b]))
                want = [p if c == q else c for c in want]
    assert got == dict(enumerate(want)) and len(set(want)) > 1


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    got = {r["id"]: r["class"] for r in om.components(links).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}


def test_components_read_a_link_once(spark, monkeypatch):
    """What is within a class is dropped after a round; links of one star don't come back in each of them."""
    rows, keep = [], om.written

    def counted(df, name, *more):
        out = keep(df, name, *more)
        rows.append((name, out.count()))
        return out

    monkeypatch.setattr(om, "written", counted)
    rng = random.Random(9)
    ids = rng.sample(range(3000), 3000)
    pairs = [(ids[0], x) for x in ids[1:2000]] + [(x, y) for x, y in zip(ids[2000:], ids[2001:], strict=False)]
    got = {r["id"]: r["class"] for r in om.components(spark.createDataFrame(pairs + pairs[:9], "a long, b long")).collect()}
    assert got == {x: min(ids[:2000]) for x in ids[:2000]} | {x: min(ids[2000:]) for x in ids[2000:]}
    edges = [n for name, n in rows if name == "edges"]
    assert edges[0] == len(pairs) and sum(edges[1:]) < 0.6 * len(pairs) + 10 and edges[-1] == 0


def test_neighbours_of_other_lengths_are_no_pairs(spark):
    rows = spark.createDataFrame([(1, i, i) for i in range(40)], "key long, id long, class long")
    keys = spark.createDataFrame([(i, 20 + 180 * (i % 2), [1, *([i // 2] * (om.SKETCHES - 1))]) for i in range(40)], "id long, n int, keys array<long>")
    found = [(r["a"], r["b"]) for r in om._neighbours(rows, keys, 0.8).collect()]
    assert all((a + b) % 2 == 0 for a, b in found)


@pytest.mark.parametrize(("share", "least"), [(0.02, 1.0), (0.05, 1.0), (0.08, 0.99), (0.1, 0.98)])
def test_recall_by_share_of_changed_words(spark, share, least):
    """Copies of 200 words with so many of them changed at random places are in the class of their text; other texts aren't."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(150):
        w = [rng.choice(vocabulary) for _ in range(200)]
        rows.append((2 * i, " ".join(w)))
        for j in rng.sample(range(200), round(share * 200)):
            w[j] = "changed" + rng.choice(vocabulary)
        rows.append((2 * i + 1, " ".join(w)))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in om.near_duplicates(frame(spark, rows)).collect()}
    found = sum(got[2 * i + 1] == (2 * i, 1) for i in range(150))
    assert found >= least * 150
    assert all(got[2 * i][0] == 2 * i for i in range(150))


def test_short_texts_one_word_apart_share_a_key():
    """Texts of 7 to 12 words that have one word more at an end, also with repeated k-mers."""
    rng = random.Random(6)
    for _ in range(300):
        n = rng.randint(7, 12)
        long = [rng.choice("abcdefghij" if rng.random() < 0.7 else "ab") + str(rng.randint(0, 3)) for _ in range(n)]
        short = long[1:] if rng.random() < 0.5 else long[:-1]
        w = find_words(*text_bytes(pa.array([" ".join(long), " ".join(short)])), SPACES)
        x, first = om.kmers(w, w.hashes())
        keys = om.sketches(om.labelled(x, first), first, x)
        assert (keys[0] == keys[1]).any()


def test_near_duplicates_null_texts_and_repeated_ids_in_a_large_group(spark, words):
    rng = random.Random(7)
    base = [rng.choice(words) for _ in range(120)]
    rows = [(i % 40, " ".join([*base[: i % 60], f"edit{i}", *base[i % 60 :]])) for i in range(80)] + [(i, None) for i in range(35, 45)] + [(None, " ".join(base))]
    docs = frame(spark, rows).withColumn("copy", F.lit("clash")).withColumn("words", F.lit(1))
    got = om.near_duplicates(docs)
    assert got.columns == ["doc_id", "class_id", "copy", "n_links"]
    assert Counter((r["doc_id"], r["class_id"]) for r in got.collect()) == Counter((i, None if i is None else 0 if i < 40 else i) for i, _ in rows)
