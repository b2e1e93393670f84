"""The pipeline against the same stages in plain Python, and every query against its SQL."""

from __future__ import annotations

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import line_quality, queries
from siltstone.llm.store import written

from .conftest import frame
from .test_dedup import brute_substring, near
from .test_filters import brute_clean, brute_contamination, item_words
from .test_formats import check_packing

DATA = "/root/testdata/sf0.001"


def test_stages_equal_plain_python(spark, corpus, tmp_path):
    texts = dict(corpus)
    rows = sorted(texts.items())
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    bench = [(0, " ".join(texts[15].split()[:30])), (1, " ".join(texts[102].split()[50:65]))]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    now = brute_clean([(i, t, "s") for i, t in rows], line_quality.MAX_DOCS_PER_LINE)
    assert any(t != texts[i] for i, t in now.items())
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    after = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), "t")
        after.append(docs)
    assert {r["doc_id"]: r["text"] for r in after[0].collect()} == now

    parent = {i: i for i in now}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in now:
        for b in now:
            if a < b and near(now[a], now[b]):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    now = {i: t for i, t in now.items() if root(i) == i}
    assert {r["doc_id"]: r["text"] for r in after[1].collect()} == now

    kept = {i: k for i, _, _, k in brute_substring(list(now.items())) if k}
    got = {r["doc_id"]: r for r in after[2].collect()}
    assert {i: " ".join(x.decode() for x in r["text"].encode().split()) for i, r in got.items()} == kept
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())

    before = {i: r["text"] for i, r in got.items()}
    hits = {r[0]: r for r in brute_contamination(list(before.items()), bench)}
    got = {r["doc_id"]: r["text"] for r in after[3].collect()}
    assert any(r[-1] for r in hits.values())
    for i, t in before.items():
        if not hits[i][-1]:
            assert got[i] == t
        else:
            assert len(item_words(got.get(i, ""))) == hits[i][1] - hits[i][2]
    used, bound = check_packing(after[4].collect(), list(got.items()), 2048)
    assert used <= bound + 1
    assert after[3].columns == docs_columns(spark, tmp_path)
    total = corpus_pipeline.run(spark, str(tmp_path))
    order = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(repr, total.select(order).collect())) == sorted(map(repr, after[4].select(order).collect()))


def docs_columns(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").columns


def test_near_stage_keeps_one_of_repeated_ids(spark):
    rng = random.Random(1)
    t = " ".join(str(rng.random()) for _ in range(30))
    docs = frame(spark, [(1, t), (1, t), (2, t), (None, t), (None, t)]).withColumn("class_id", F.lit(1))
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(repr(r["doc_id"]) for r in got.collect()) == ["1", "None", "None"] and got.columns == docs.columns


def test_near_stage_keeps_different_texts_of_one_id(spark):
    rng = random.Random(2)
    a, b, c = (" ".join(str(rng.random()) for _ in range(60)) for _ in range(3))
    docs = frame(spark, [(1, a), (1, b), (1, c), (1, a), (2, b + " x"), (0, c), (None, a), (3, None), (3, None)]).withColumn("_row", F.lit("clash"))
    got = corpus_pipeline.near_dedup(spark, docs.repartition(3), "")
    assert sorted((repr(r["doc_id"]), r["text"]) for r in got.collect() if r["text"]) == sorted([("1", a), ("1", b), ("0", c), ("None", a)])
    assert got.where("text IS NULL").count() == 2 and got.columns == docs.columns
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_names():
    assert [n for n in queries.queries() if n.startswith("op")] == sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert {int(n[2:].split("_")[0]) for n in queries.queries()} == set(range(1, 14))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    df = queries.queries()[name](spark, DATA)
    sql = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in sql.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, sql.fetchall()))
