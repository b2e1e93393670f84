"""Packing, token files and archives: round trips and brute force."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import packing, simple8b, warc
from siltstone.llm.tokens import chunk_tokenizer
from siltstone.llm.words import text_bytes

from .conftest import frame

P = pytest.importorskip("public_tokenizers")
BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def reference(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


PIECES = [" ", "  ", "\n", "\n\n", "\u00a0", "\u3000", "é", "a", "B", "'s", "1", "|", "<|endoftext|>", "ñ", "\u0301", "\t", "ß", "Σ", ".", "\r\n", "€", "\x85", "\x1c", "🙂", "中", "-", "word"]


@pytest.mark.parametrize(("path", "kind"), [(BYTE, "spaced"), (WORD, "bare")])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), max_size=6))
def test_chunked_tokens_are_the_librarys(path, kind, texts):
    import pyarrow as pa

    from siltstone.llm.words import text_bytes

    ids, at = chunk_tokenizer(path, kind).encode(*text_bytes(pa.array(texts, pa.large_string())))
    want = [e.ids for e in reference(path).encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50000), st.integers(0, 2**63)), max_size=700))
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    words, first, escapes = simple8b.encode(v)
    assert (simple8b.decode(words, first, escapes, len(v)) == v).all()
    assert len(escapes) == sum(x >= 1 << 60 for x in values)


def test_damaged_sections_are_noticed(tmp_path):
    import pyarrow as pa

    s = simple8b.Section(np.array([3]), np.array([False]), np.array([2]), np.array([7, 9], np.uint64), 0).to_bytes()
    assert simple8b.Section.read(pa.BufferReader(s)).ids.tolist() == [7, 9]
    with pytest.raises(ValueError):
        simple8b.Section.read(pa.BufferReader(s[:-1] + b"?"))


def test_token_files(spark, corpus, tmp_path):
    rows = [*corpus, (None, "null id")]
    files = simple8b.write_token_files(frame(spark, rows), WORD, "bare", 1, folder=f"file://{tmp_path}/ids")
    got = [tuple(r) for r in simple8b.read_token_files(files).withColumn("ids", F.crc32("ids")).collect()]
    t, at, want = reference(WORD), 0, []
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert simple8b.read_token_files(simple8b.write_token_files(frame(spark, rows).limit(0), WORD, "bare", 1)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 9), max_size=20))
def test_patterns_take_everything(histogram):
    patterns = packing.pack_lengths(histogram, 64)
    got: dict[int, int] = {}
    for p in patterns:
        assert p.bins > 0 and sum(n * c for n, c in p.lengths) <= 64
        for n, c in p.lengths:
            got[n] = got.get(n, 0) + c * p.bins
    assert got == histogram
    total = sum(n * c for n, c in histogram.items())
    assert sum(p.bins for p in patterns) <= 2 * -(-total // 64) + 1


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 3), min_size=1, max_size=7))
def test_the_fullest_bin_is_found(counts):
    import itertools

    seed = max(counts)
    sums = {seed + sum(n * c for n, c in zip(counts, cs, strict=True)) for cs in itertools.product(*[range(counts[n] - (n == seed) + 1) for n in counts])}
    assert sum(n * c for n, c in packing.fullest(counts, seed, 20)) == max(s for s in sums if s <= 20)


def check_packing(pieces, texts, size):
    """Pieces hold each document's ids once, and sequences are gapless and fit."""
    t = reference(BYTE)
    want = sorted(tuple([*t.encode(x or "", add_special_tokens=False).ids, 0]) for _, x in texts)
    docs: dict = {}
    for r in pieces:
        docs.setdefault(r["doc_id"], []).append(r)
    by_id: dict = {}
    for i, x in texts:
        by_id.setdefault(i, []).append([*t.encode(x or "", add_special_tokens=False).ids, 0])
    for i, ids in by_id.items():
        expected = []
        for x in ids:
            short = len(x) % size
            cuts = [0, *range(short or size, len(x), size), len(x)]
            expected += [(n, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in docs[i]) == sorted(expected)
    bins: dict = {}
    for r in pieces:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) <= size
    return len(bins), -(-sum(map(len, want)) // size)


def test_packing(spark, corpus):
    rows = [*corpus, (None, "null id")]
    out = packing.pack_documents(frame(spark, rows).repartition(3), BYTE, size=256, keep_ids=True)
    used, bound = check_packing(out.collect(), rows, 256)
    assert used <= 1.05 * bound + 1
    seqs = packing.sequences(out).collect()
    assert len(seqs) == used and max(len(s["ids"]) for s in seqs) <= 256
    assert packing.pack_documents(frame(spark, rows).limit(0), BYTE).count() == 0


def test_archives(spark, tmp_path):
    big = "<p>" + "é" * 100
    rows = [(5, "https://a/\r\nX: y", big), (3, "https://b/", big), (4, None, big), (9, "u", "small"), (8, "u", "small"), (7, "u", None), (6, "u", ""), (None, "u", big), (3, "again", big), (20, "u", "x" * 100), (21, "u", "x" * 99), (22, "u", "x" * 99)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    files = warc.write_archives(pages.repartition(2), folder=f"file://{tmp_path}/w")
    got = warc.read_archives(files)
    full = {(r["page_id"], r["payload_digest"]): r for r in got.collect()}
    assert sorted(map(repr, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())) == sorted(
        repr(r) for r in spark.createDataFrame(
            [(i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if h == big and i != 3 else "response", 3 if h == big and i != 3 else None) for i, _, h in rows],
            "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long",
        ).collect()
    )
    digest = hashlib.sha256(big.encode()).hexdigest()
    assert bytes(full[3, digest]["payload"]).decode() == big and full[5, digest]["payload"] is None and full[5, digest]["url"] == "https://a/%0D%0AX: y"
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_archive_frames_stand_alone(tmp_path):
    import struct

    import pyarrow as pa
    import zstandard

    path = str(tmp_path / "a.warc.zst")
    w = warc.ArchiveWriter(pa.OSFile(path, "wb"), "1970-01-01T00:00:00Z")
    for i in range(3000):
        w.add(warc.make_record(i, f"https://x/{i}", (f"<html>{i} " + "common words here " * 60).encode(), hashlib.sha256((f"<html>{i} " + "common words here " * 60).encode()).hexdigest(), None, w.date))
    w.close()
    data = open(path, "rb").read()
    magic, n = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and zstandard.get_frame_parameters(data[8 + n :]).dict_id == zstandard.ZstdCompressionDict(data[8 : 8 + n]).dict_id() != 0
    records = [warc.parse_record(r) for r in warc.read_records(pa.OSFile(path))]
    assert records[0]["record_type"] == "warcinfo" and [r["page_id"] for r in records[1:]] == list(range(3000))
    with pytest.raises(ValueError):
        list(warc.read_records(pa.BufferReader(data[:-20])))


ODD = ["a", "B", "s", "S", "'", "’", "re", "ll", "J", "I", "İ", "\u030c", "\u0307", "\u0338", "\u0323", "K", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "1", "²", ",", ".", "<", "|", "<|endoftext|>", "</w>", "é", "ß", "漢", "😀", "\u200d", "\x00", "\x85"]


@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", "bare"), ("byte_bpe_50k.json", "spaced")])
def test_chunks_give_the_ids_of_whole_texts(name, kind):
    random = np.random.default_rng(5)
    texts = ["".join(random.choice(ODD, random.integers(0, 14))) for _ in range(4000)]
    library = reference(P.path(name))
    ids, at = chunk_tokenizer(P.path(name), kind).encode(*text_bytes(pa.array(texts, pa.large_string())))
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert e.ids == ids[at[i] : at[i + 1]].tolist(), texts[i]


def test_simple8b_of_many_shapes():
    random = np.random.default_rng(3)
    for n in (0, 1, 5, 255, 256, 257, 1000):
        for most in (1, 2, 5, 20, 64):
            w = random.integers(0, most + 1, n)
            v = np.where(w > 0, np.uint64(1) << np.minimum(w, 63).astype(np.uint64), np.uint64(0))
            v[: n // 3] = 0
            words, first, escapes = simple8b.encode(v)
            assert (simple8b.decode(words, first, escapes, n) == v).all()
            assert len(words) <= n and len(first) == -(-n // 256) + 1
