"""Jaccard components, importance resampling and spelling variants against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import resample as rs
from siltstone.llm import signature_tree as st
from siltstone.llm import spelling as sp

from .conftest import frame

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UP, LOW)


def plain_sets(rows):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        out.append((i, {tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))} if w else set()))
    return out


def plain_components(rows, percent=85):
    sets = plain_sets(rows)
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return Counter((i, len(x), root(i)) for i, x in sets)


def found_components(docs, **options):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in st.jaccard_components(docs, **options).collect())


def test_components_equal_brute_force(spark, corpus):
    assert found_components(frame(spark, corpus)) == plain_components(corpus)


def test_components_of_a_large_family(spark, words, monkeypatch):
    """Copies edited from copies, in trees of few sets, so that links across blocks and sizes count."""
    monkeypatch.setattr(st, "BLOCK", 8)
    rng = random.Random(9)
    texts = [[rng.choice(words) for _ in range(80)]]
    for i in range(1, 260):
        w = list(texts[max(0, i - rng.randint(1, 30))])
        for _ in range(rng.choice([1, 1, 2, 3])):
            j = rng.randrange(len(w))
            w[j : j + 1] = rng.choice([[rng.choice(words)], [], [w[j], rng.choice(words)]])
        texts.append(w)
    rows = [(1000 - i, " ".join(w)) for i, w in enumerate(texts)]
    want = plain_components(rows)
    assert found_components(frame(spark, rows)) == want
    assert 1 < len({c for _, _, c in want}) < 200


def test_components_edge_cases(spark):
    rows = [(None, "a b c d e"), (4, "a b c d e"), (4, "A b  c d E"), (9, "a b c d e"), (5, "a b"), (6, "a b"), (7, "b a"), (8, None), (2, ""), (4, "x y z u v"), (3, "x y z u v")]
    docs = frame(spark, rows).withColumn("component_id", F.lit("clash")).withColumn("n", F.lit(0))
    got = found_components(docs)
    assert got == Counter([(None, 2, None), (4, 2, 3), (4, 2, 3), (9, 2, 3), (5, 1, 5), (6, 1, 5), (7, 1, 7), (8, 0, 8), (2, 0, 2), (4, 2, 3), (3, 2, 3)])
    assert st.jaccard_components(docs.limit(0)).count() == 0


def test_a_common_passage_links_nothing(spark, words):
    """A passage that half of the texts share is no key of texts that have others of their own."""
    rng = random.Random(2)
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = [(i, " ".join(rng.choice(words) for _ in range(120)) + (" " + passage if i % 2 else "")) for i in range(200)]
    assert found_components(frame(spark, rows)) == plain_components(rows)


@pytest.mark.parametrize("seed", range(4))
def test_traversal_reaches_every_link(seed):
    """No pair of sets that links is ruled out, for trees of different heights and any components."""
    rng = np.random.default_rng(seed)
    base = [np.unique(rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.uint64)) for _ in range(12)]
    sets = []
    for _ in range(150):
        s = base[rng.integers(len(base))]
        kept = s[rng.random(len(s)) < rng.choice([0.9, 0.97, 1.0])]
        sets.append(np.unique(np.concatenate([kept, s[:1], rng.integers(0, 2**63, rng.integers(0, 5), dtype=np.uint64)])))
    sets.sort(key=lambda s: tuple(s[:2]))
    own = rng.integers(0, 40, len(sets))
    cut = int(rng.integers(5, 60))
    for lo, hi in ((0, len(sets)), (cut, len(sets))):
        x, y = st.Tree(sets[:cut] if lo else sets, 1024), st.Tree(sets[lo:hi], 1024)
        if not lo:
            y = x
        i, j, bound = st.traverse(x, y, own[: len(x.levels[0][1])], own[lo:hi], 85)
        got = dict(zip(zip(i.tolist(), (j + lo).tolist()), bound.tolist(), strict=True))
        for a in range(len(x.levels[0][1])):
            for b in range(lo or a + 1, hi):
                common = len(np.intersect1d(sets[a], sets[b]))
                if 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common) and own[a] != own[b]:
                    assert got[a, b] >= common
        assert len(got) < len(x.levels[0][1]) * (hi - lo) / 4


def test_packed_cells():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 2**32, 5000).astype(np.uint32))
    assert (st._unpacked(st._packed(x)) == x).all()
    assert len(st._unpacked(st._packed(x[:0]))) == 0


def plain_resample(rows, target, seed=7):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
        return len(w), [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]

    docs = [(i, *features(t)) for i, t in rows]
    s, t = Counter(), Counter()
    for _, _, f in docs:
        s.update(f)
    for _, x in target:
        t.update(features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (big_s + 10000) / ((s[k] + 1) * (big_t + 10000)))) for k in range(10000)]
    out = []
    for i, n, f in docs:
        weight = sum(gain[k] for k in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0], r[2]))
    place = {id(r): k + 1 for k, r in enumerate(able[: 25 * len(able) // 100])}
    return Counter((r[0], r[2], r[3], r[4], place.get(id(r))) for r in out)


def found_resample(docs, target, **options):
    return Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in rs.resample(docs, target, **options).collect())


@pytest.mark.parametrize("chunk", [5, 4096])
def test_resampling_equals_brute_force(spark, corpus, chunk):
    target = [(i, t) for i, t in corpus[::5]] + [(900, None)]
    aim = spark.createDataFrame(target, "item_id long, text string")
    docs = frame(spark, corpus).withColumn("row", F.lit("clash")).withColumn("score", F.lit(1))
    assert found_resample(docs, aim, chunk=chunk, long=3 * chunk) == plain_resample(corpus, target)


def test_resampling_of_ties_and_nothing(spark, words):
    text = " ".join(words[:30])
    rows = [(3, text), (3, text), (None, text + " more"), (1, ""), (2, None), (7, text)]
    aim = spark.createDataFrame([(0, text)], "item_id long, text string")
    assert found_resample(frame(spark, rows), aim) == plain_resample(rows, [(0, text)])
    assert found_resample(frame(spark, rows), aim.limit(0)) == plain_resample(rows, [])
    assert rs.resample(frame(spark, rows).limit(0), aim).count() == 0


def test_chunks_hold_every_feature_once():
    words = [f"w{i % 7}".encode() for i in range(23)]
    for n in (1, 2, 3):
        whole = Counter(rs.buckets_of(words, len(words), n, 997))
        parts = Counter()
        for lo in range(0, 23, 4):
            hi = min(lo + 4, 23)
            parts.update(rs.buckets_of(words[lo : min(hi + n - 1, 23)], hi - lo, n, 997))
        assert parts == whole


def plain_words(rows):
    count = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                count[w] += 1
    return {w: n for w, n in count.items() if n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain_variants(rows):
    words = plain_words(rows)
    near = defaultdict(list)
    listed = sorted(words)
    for k, a in enumerate(listed):
        for b in listed[:k]:
            if one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o))
        if words[best] >= 10 * words[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w) or "", root(w), n, len(near[w]), words[form[w]] if w in form else 0) for w, n in words.items())


def found_variants(docs):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in sp.spelling_variants(docs).collect())


def test_variants_equal_brute_force(spark):
    rng = random.Random(12)
    base = ["".join(rng.choice("abcdé×") for _ in range(rng.randint(6, 10))) for _ in range(150)] + ["aaaaaaaa", "abababab", "aaaaaaa", "AAAAAAAAA", "Éabcdefg"]
    rows = []
    for i in range(500):
        w = []
        for _ in range(60):
            x = base[min(int(rng.paretovariate(0.6)) - 1, len(base) - 1)]
            if rng.random() < 0.1:
                j = rng.randrange(len(x))
                x = x[:j] + rng.choice(["", "a", "b" + x[j]]) + x[j + 1 :]
            w.append(x + rng.choice([" ", "1", "\n", "-"]))
        rows.append((i, "".join(w)))
    rows += [(None, "abcdefgh abcdefgh abcdefgx abcdefgx"), (1000, None), (1001, ""), (7, rows[7][1])]
    docs = frame(spark, rows).withColumn("word", F.lit("clash")).withColumn("n", F.lit(0))
    want = plain_variants(rows)
    assert found_variants(docs) == want
    assert any(r[1] for r in want) and any(r[2] != r[1] and r[1] for r in want)
    assert sp.spelling_variants(docs.limit(0)).count() == 0


def test_keys_meet_for_every_edit():
    """Whatever the order of bigrams, words one edit apart have a key in common at which at most one is the shorter one."""
    rng = random.Random(5)
    for _ in range(3000):
        letters = rng.choice(["ab", "abcdefgh", "a"])
        w = "".join(rng.choice(letters) for _ in range(rng.randint(7, 14)))
        j = rng.randrange(len(w))
        v = rng.choice([w[:j] + w[j + 1 :], w[:j] + rng.choice(letters) + w[j:], w[:j] + rng.choice(letters) + w[j + 1 :]])
        if v == w or len(v) < 7:
            continue
        grams = sorted({x[i : i + 2] for x in (w, v) for i in range(len(x) - 1)})
        rng.shuffle(grams)
        order = {g: i for i, g in enumerate(grams)}
        x, y = set(sp.join_keys(w, order)), set(sp.join_keys(v, order))
        if len(w) == len(v):
            assert any((k, False) in y for k, s in x if not s)
        else:
            long, short = (x, y) if len(w) > len(v) else (y, x)
            assert any((k, True) in short for k, s in long if not s)
