"""Quality rules, URL filters, licenses, decontamination and toxicity."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import fm_index, licenses, toxicity, url_cascade
from siltstone.llm.decontaminate import WORD_BYTES, Phrases, find_contamination
from siltstone.llm.line_quality import clean_documents, frequent_lines, judge_documents, measured
from siltstone.llm.queries import BLOCKED_HOSTS, URL_RULES
from siltstone.llm.words import text_bytes

from .conftest import frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_quality(rows, max_docs):
    lines = [[(" ".join(WORD.findall(x)).lower(), len(WORD.findall(x)), x) for x in (t or "").split("\n") if WORD.search(x)] for _, t, _ in rows]
    docs, first = {}, {}
    for row, ((i, _, s), ls) in enumerate(zip(rows, lines, strict=True)):
        for k, _, _ in ls:
            docs.setdefault((s, k), set()).add(("row", row) if i is None else i)
            if i is not None:
                first[s, k] = min(first.get((s, k), i), i)
    out = []
    for (i, t, s), ls in zip(rows, lines, strict=True):
        w = WORD.findall(t or "")
        g = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        rep = {j + d for j in range(len(w) - 2) if g[tuple(w[j : j + 3])] > 1 for d in range(3)}
        cut = sum(n for k, n, _ in ls if len(docs[s, k]) > max_docs and first.get((s, k)) != i)
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(ls) - len({x for _, _, x in ls}), len(rep), cut, failed, not failed and len(w) - cut >= 0.5 * len(w)))
    return out


def brute_clean(rows, max_docs):
    """The rows that stay, with their texts cut."""
    def norm(line):
        return " ".join(WORD.findall(line)).lower()

    docs = {}
    for i, t, s in rows:
        for line in (t or "").split("\n"):
            docs.setdefault((s, norm(line)), set()).add(i)
    out = {}
    for (i, t, s), judged in zip(rows, brute_quality(rows, max_docs), strict=True):
        if judged[-1]:
            out[i] = "\n".join(x for x in t.split("\n") if not norm(x) or len(docs[s, norm(x)]) <= max_docs or min(docs[s, norm(x)]) == i)
    return out


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept")


def quality_rows(corpus):
    rng = random.Random(2)
    rows = [(i, t, rng.choice(["a", "b", None])) for i, t in corpus]
    shared = "Subscribe  now to OUR list\n"
    long = " ".join(f"boiler{i}" for i in range(60))
    rows += [(200 + i, (shared if i % 2 else shared.lower()) + " ".join(f"u{i}x{j} #" for j in range(40)), "hot") for i in range(30)]
    rows += [(300 + i, f"{long}\nown {i}", "hot") for i in range(15)] + [(400 + i, f"{long}\nsame", "hot") for i in range(3)]
    return rows


def test_quality_equals_brute_force(spark, corpus):
    rows = quality_rows(corpus)
    got = judge_documents(frame(spark, rows), max_docs=10).select(*COLUMNS).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute_quality(rows, 10))


def test_lines_are_counted_by_document(spark):
    own = " ".join(f"w{j}" for j in range(60))
    rows = [(i, f"Shared line of five words\n{own} {i}", "h") for i in range(6)] + [(9, f"{own}\nfive of them share this", "g")] * 7
    rows += [(10 + i, f"{own}\nfive of them share this", "g") for i in range(4)] + [(None, f"{own}\nnobody knows us", "n")] * 6
    got = judge_documents(frame(spark, rows).withColumn("kept", F.lit("clash")), carry=["kept"]).select(*COLUMNS)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, brute_quality(rows, 5)))
    cut = {r["doc_id"]: r["n_removed_words"] for r in got.collect()}
    assert cut[0] == 0 and cut[1] == 5 and cut[9] == cut[10] == 0 and cut[None] == 0  # without any id, none is the first
    share = frequent_lines(measured(frame(spark, rows)), max_docs=3, min_share=0.9)
    assert share.count() == 5  # all documents of a host share them
    assert judge_documents(frame(spark, rows).limit(0)).count() == 0


def test_cleaning_cuts_lines_and_rejects(spark, corpus):
    rows = quality_rows(corpus)
    docs = frame(spark, rows).withColumn("_row", F.lit(1)).withColumn("kept", F.lit("clash"))
    out = {r["doc_id"]: r for r in clean_documents(docs, max_docs=10).collect()}
    want = {r[0] for r in brute_quality(rows, 10) if r[-1]}
    assert set(out) == want and 300 in want and 301 not in want
    assert out[200]["text"].startswith("subscribe") and out[201]["text"].startswith("u1x0") and out[201]["n_chars"] == len(out[201]["text"])
    assert clean_documents(docs.limit(0)).count() == 0 and list(out[200].asDict()) == docs.columns


def plain_verdict(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.key), default=None)
    listed = any(host == b or host.endswith("." + b) for b in BLOCKED_HOSTS)
    return host, path, best.key if best else None, best.verdict if best else "block" if listed else "allow"


def test_urls_equal_plain_rules(spark):
    urls = [None, "", "nothing", "http://", "https://a.com", "https://a.com/", "https://COM/x", "HTTP://Www.Example.COM/en/1?x#y", "https://example.com/en", "https://x.example.com/en/", "https://net/es/", "https://a.net/fr/../", "https://a.net/FR/", "https://icom/", "https://a..com/x", "https://É.com/", "ftp://free-bets.example.net", "https://m.ads-track.example.com?x", "https://casino-win.example.net/de/", "a://b://c.com/", "https://x.com#/", "https://a.com:80/", "https://a.com/\nb"]
    urls += [f"https://h{i}.example.{'com' if i % 2 else 'net'}/{'en' if i % 3 else 'fr'}/{i}" for i in range(300)]
    rows = [(i, u) for i, u in enumerate(urls)] + [(3, "http://")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("clash"))
    for literal_bytes in (url_cascade.LITERAL_BYTES, 0):
        got = url_cascade.judge_urls(pages, URL_RULES, BLOCKED_HOSTS, literal_bytes=literal_bytes).select("page_id", "host", "path", "rule", "verdict").collect()
        assert sorted(map(repr, (tuple(r) for r in got))) == sorted(repr((i, *plain_verdict(u))) for i, u in rows)
    assert url_cascade.judge_urls(pages.limit(0), URL_RULES, BLOCKED_HOSTS).count() == 0
    with pytest.raises(ValueError):
        url_cascade.judge_urls(pages, [url_cascade.Rule("a", "/", "allow"), url_cascade.Rule("a", "/", "block")], [])


def test_cascade_is_exact(spark):
    universe = spark.range(20000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), (F.col("id") % 37 == 0).alias("listed")).cache()
    c = url_cascade.build_cascade(universe)
    assert len(c.levels) > 1
    assert universe.where(c.contains(F.col("key")) != F.col("listed")).count() == 0
    assert url_cascade.build_cascade(universe.withColumn("listed", F.lit(False))).levels == ()


def test_a_long_list_is_a_table_of_blocks(spark):
    """A list whose first level is larger than a literal may be, over keys that are on it and others."""
    n = 150_000
    hosts = spark.range(n).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".example.org")).alias("host"))
    pages = spark.range(0, 2 * n, 3).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.h"), F.col("id").cast("string"), F.lit(".example.org/x")).alias("url"), F.lit("clash").alias("verdict"))
    rules = spark.createDataFrame([("h3.example.org", "/", "allow"), ("h3.example.org", "/", "allow"), (None, "/", "block")], url_cascade.RULE)
    got = url_cascade.judge_urls(pages, rules, hosts.unionByName(hosts.limit(5)), literal_bytes=1 << 14)
    want = F.when((F.col("page_id") < n) & (F.col("page_id") != 3), "block").otherwise("allow")
    assert got.count() == 2 * n // 3 and got.where(F.col("verdict") != want).count() == 0
    assert [r["page_id"] for r in got.where("rule = 'h3.example.org/'").collect()] == [3]


@pytest.mark.parametrize("seed", range(4))
def test_fm_index_finds_all_places(seed):
    rng = np.random.default_rng(seed)
    s = rng.integers(1, 6 if seed % 2 else 40, 3000)
    s[1000:1400] = s[200:600]
    s[2000:2200] = 3
    s[-1] = 0
    sa = fm_index.suffix_array(s)
    key = [tuple(s[i : i + 900]) for i in range(0, 3000, 97)]
    place = {int(x): i for i, x in enumerate(sa)}
    ranked = sorted(range(0, 3000, 97), key=lambda i: tuple(s[i:]))
    assert [place[i] for i in ranked] == sorted(place[i] for i in ranked) and len(key) == 31
    index = fm_index.FMIndex(s)
    for m in (1, 3, 10):
        starts = rng.integers(0, 2980, 50)
        patterns = np.stack([s[a : a + m] for a in starts] + [np.full(m, 39)])
        who, lo, hi = index.search(patterns)
        found = {}
        rows, which = fm_index.expand(lo, hi)
        for p, at in zip(who[which], index.locate(rows), strict=True):
            found.setdefault(int(p), []).append(int(at))
        for i, p in enumerate(patterns):
            want = [j for j in range(len(s) - m + 1) if (s[j : j + m] == p).all()]
            assert sorted(found.get(i, [])) == want


ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(t):
    return ITEM.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute_contamination(rows, items, window=10):
    phrases = {}
    for i, t in items:
        w = item_words(t)
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            phrases.setdefault(tuple(w[j : j + k]), set()).add(str(i))
    out = []
    for i, t in rows:
        w, hit, got = item_words(t), set(), set()
        for k in {len(p) for p in phrases}:
            for j in range(len(w) - k + 1):
                if names := phrases.get(tuple(w[j : j + k])):
                    hit.update(range(j, j + k))
                    got |= names
        out.append((i, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block_bytes", [32 << 20, 400])
def test_decontamination_equals_brute_force(spark, corpus, block_bytes):
    rng = random.Random(4)
    texts = {i: t for i, t in corpus}
    items = [(n, " ".join((texts[i] or "").split()[5 : 5 + rng.randint(3, 40)]).upper()) for n, i in enumerate([12, 20, 61, 72, 85, 102, 102])]
    items += [(7, "one two"), (8, None), (9, "  "), (10, "la li lu la"), (2, "three, FOUR!"), (11, "absent words here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = find_contamination(frame(spark, corpus).withColumn("items", F.lit("clash")), bench, block_bytes=block_bytes)
    got = [tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    assert sorted(got) == sorted(brute_contamination(corpus, items))


def test_blocks_are_bounded_by_their_arrays():
    import pickle

    rng = random.Random(1)
    items = [(str(i), " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 60)))) for i in range(4000)]
    words = sum(len(item_words(t)) for _, t in items)
    phrases = Phrases(items, 10)
    assert phrases.nbytes() <= len(pickle.dumps(phrases)) <= WORD_BYTES * words
    assert sum(len(s) for _, s, _ in phrases.by_length) == sum(max(1, len(item_words(t)) - 9) for _, t in items)


def test_decontamination_cuts_spans(spark):
    bench = spark.createDataFrame([(1, "Alpha, beta gamma")], "item_id long, text string")
    docs = frame(spark, [(1, "x (ALPHA beta; gamma) y alpha"), (2, None), (3, "alpha beta\ngamma")])
    out = {r["doc_id"]: r for r in find_contamination(docs, bench, cut=True).collect()}
    assert out[1]["text"] == "x () y alpha" and [tuple(s) for s in out[1]["spans"]] == [(1, 4)] and out[2]["text"] is None and out[3]["text"] == ""
    assert find_contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert find_contamination(docs.limit(0), bench).count() == 0


def brute_licenses(t):
    """(license, template, start, end, containment) by the definition: every run of shingles against every template."""
    def grams(x):
        w = item_words(x)
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    wanted = {(name, n): set(grams(x)) for name, ts in licenses.TEMPLATES.items() for n, x in enumerate(ts)}
    h, matches = grams(t), []
    for order, ((name, n), want) in enumerate(wanted.items()):
        telling = [want - x for (other, _), x in wanted.items() if other != name]
        c = 1
        while c < len(want):
            c *= 2
        spans = []
        for j in range(len(h)):
            run = h[j : j + c]
            if h[j] in want and len(want & set(run)) >= 0.8 * len(want) and all(2 * len(x & set(run)) >= len(x) for x in telling):
                last = max(k for k, x in enumerate(run) if x in want)
                if spans and j < spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(spans[-1][1], j + last + 5), max(spans[-1][2], len(want & set(run))))
                else:
                    spans.append((j, j + last + 5, len(want & set(run))))
        matches += [(-m, -m / len(want), order, name, n, a, z) for a, z, m in spans]
    out = []
    for _, share, _, name, n, a, z in sorted(matches):
        if not any(name != other and a < y and z > x for other, _, x, y, _ in out):
            out.append((name, n, a, z, pytest.approx(-share)))
    return out


def found_licenses(spark, rows):
    docs = licenses.scan_licenses(frame(spark, rows).withColumn("matches", F.lit("clash")))
    return {r["doc_id"]: [tuple(m) for m in r["matches"]] for r in docs.collect()}


def test_licenses_equal_brute_force(spark, words):
    rng = random.Random(9)

    def filler(n):
        return " ".join(rng.choice(words) for _ in range(n))

    rows = [(0, None), (1, ""), (2, "a b c"), (3, filler(500))]
    texts = [t for ts in licenses.TEMPLATES.values() for t in ts]
    for t in texts:
        for changes in range(4):
            w = t.split()
            for _ in range(changes):
                w[rng.randrange(len(w))] = "changed"
            rows.append((len(rows), f"{filler(rng.randint(0, 90))}\n{' '.join(w).upper()} {filler(rng.randint(0, 30))} {rng.choice(texts)}"))
        rows.append((len(rows), f"{filler(7)} {' '.join(t.split()[: len(t.split()) // 2])} {filler(9)} {t} {t}"))
    got = found_licenses(spark, rows)
    assert all(sorted(got[i], key=repr) == sorted(brute_licenses(t), key=repr) for i, t in rows)
    assert licenses.scan_licenses(frame(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.Templates({"X": ["too short"]})


def test_each_notice_has_its_own_license_only(spark, words):
    texts = [(name, t) for name, ts in licenses.TEMPLATES.items() for t in ts]
    rows = [(i, f"{words[i]} {words[i + 1]} {t} {words[i + 2]}") for i, (_, t) in enumerate(texts)] * 2
    got = found_licenses(spark, rows)
    assert {i: {m[0] for m in got[i]} for i in got} == {i: {name} for i, (name, _) in enumerate(texts)}
    assert all(m[4] == 1 and m[2] == 2 for ms in got.values() for m in ms)
    odd = licenses.TEMPLATES["GPL-3.0"][1].replace("version 3", "version 9")
    assert found_licenses(spark, [(1, odd)]) == {1: []}


def test_license_in_a_text_of_several_slices(spark, words):
    rng = random.Random(3)
    filler = " ".join(rng.choice(words) for _ in range(1_200_000))
    assert len(filler) > 5 << 20
    got = found_licenses(spark, [(1, f"{filler} {licenses.TEMPLATES['AGPL-3.0'][0]} {filler}")])
    assert [(m[0], m[2], m[4]) for m in got[1]] == [("AGPL-3.0", len(item_words(filler)), 1.0)]


def toxic_rows(words, n, start):
    rng, rows = random.Random(start), []
    bad = ["gruxil", "plonkard", "zwafnut", "morbleth"]
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(max(2, len(w) // 20)):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((start + i, " ".join(w), int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark, words):
    rows = toxic_rows(words, 1200, 0)
    docs = frame(spark, [(i, t) for i, t, _ in rows] + [(5000, None), (5001, ""), (None, "x")]).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = {r["doc_id"]: r for r in toxicity.score_documents(docs, model).withColumn("f", toxicity.fold()).collect()}
    held = [(out[i]["score"], y) for i, _, y in rows if out[i]["f"] == 2]
    good = sum((s >= 0.3) == bool(y) for s, y in held) / len(held)
    assert len(held) > 200 and good > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.values())
    again = model.scores(*text_bytes(pa.array([rows[0][1], rows[0][1]])))
    assert again[0] == again[1] == out[0]["score"]
    nothing = toxicity.train(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score_documents(docs, nothing).collect()} == {0.0}


def plain_score(model, text):
    """A score as the module describes it: window by window, each compressed by itself."""
    import zstandard

    params = zstandard.ZstdCompressionParameters(window_log=17, hash_log=17, chain_log=17, search_log=5, min_match=7, target_length=64, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    packers = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params) for d in (model.ordinary, model.toxic)]

    def code(word):
        h = 0
        out = b""
        for i, byte in enumerate(word.encode()):
            h = (h + (byte + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64)) % (1 << 64)
            x = h
            for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
                x = (x ^ (x >> 33)) * m % (1 << 64)
            out += ((x ^ (x >> 33)) >> 48).to_bytes(2, "little")
        return out

    w = [code(x) for x in item_words(text)]
    windows = [b"".join(w[i : i + 16]) for i in range(0, len(w), 16)]
    gain = [len(packers[0].compress(x)) - len(packers[1].compress(x)) for x in windows]
    n = max(1, len(gain))
    steps = [(sum(g >= s for g in gain) / n) ** 0.5 for s in (3, 5, 8)]
    x = np.array([sum(gain) / n, max([0, *gain]) / 8, *steps, (sum(g <= -5 for g in gain) / n) ** 0.5, n**-0.5])
    z = model.weights[0] + ((x - model.mean) / model.scale) @ model.weights[1:]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def test_toxicity_scores_equal_plain_python(spark, words):
    rows = toxic_rows(words, 400, 0)
    docs = frame(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    long = " ".join(t for _, t, _ in rows)
    texts = [(0, None), (1, ""), (2, "Gruxil"), (3, long * (1 + (5 << 20) // len(long)))] + [(10 + i, t) for i, t, _ in rows[:40]] + [(3, "a b")]
    got = sorted((r["doc_id"], r["score"]) for r in toxicity.score_documents(frame(spark, texts), model).collect())
    want = sorted((i, plain_score(model, t or "")) for i, t in texts)
    assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want])
    twice = labels.unionByName(labels).unionByName(spark.createDataFrame([(0, 0), (0, 1)], labels.schema))
    less = toxicity.train(docs, twice)
    assert toxicity.train(docs, labels.where("doc_id <> 0")).toxic == less.toxic
    assert toxicity.train(docs.limit(0), labels).scores(*text_bytes(pa.array(["x", ""]))).tolist() == [0.0, 0.0]
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


def test_thousands_of_cut_lines_in_a_text(spark):
    """Eight texts share 20,000 lines, which go from all but one; blank lines and their own lines stay in place."""
    shared = [f"shared line {i}" for i in range(20_000)]
    rows = [(d, "\n".join([f"own {d} {i}\n\n{line}" for i, line in enumerate(shared)] + [f"tail {d} {i}" for i in range(10)])) for d in range(8)]
    out = {r["doc_id"]: r["text"] for r in clean_documents(frame(spark, rows), min_share=0.1).collect()}
    assert out[0] == rows[0][1]
    for d in range(1, 8):
        assert out[d] == "\n".join([f"own {d} {i}\n" for i in range(len(shared))] + [f"tail {d} {i}" for i in range(10)])
