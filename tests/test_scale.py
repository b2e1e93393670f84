"""Sizes at which a plan that copies lists or puts a group into one task fails."""

from __future__ import annotations

import random
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from siltstone.functions import rounding
from siltstone.operators import checks, text_units


def test_many_cues_in_one_text(spark):
    body = "\n\n".join(f"{i}\n00:00:{i % 60:02d},000 --> x\n\n{i}\nline {i}\nmore\n\nnot shown" for i in range(32_000))
    docs = spark.createDataFrame([(body,)], "t string")
    begin = time.time()
    got = docs.select(text_units.srt_cues(F.col("t")).alias("c")).first()["c"]
    assert len(got) == 32_000 and tuple(got[31_999]) == ("00:00:19,000", "line 31999 more")
    assert time.time() - begin < 60


def test_cues_of_odd_texts(spark):
    def cues(f, t):
        return spark.createDataFrame([(t,)], "t string").select(f(F.col("t")).alias("c")).first()["c"]

    for f in (text_units.srt_cues, text_units.vtt_cues):
        assert cues(f, "") == [] and cues(f, "no timing\n\n") == [] and cues(f, None) is None
        assert cues(f, "a --> b") == [] and [tuple(c) for c in cues(f, "a --> b\nx\nc --> d\r\n y \n")] == [("a", "x"), ("c", "y")]
    assert cues(text_units.srt_cues, "a --> b\n\n7\n\nx\n8\ny\n\nz") and [tuple(c) for c in cues(text_units.srt_cues, "a --> b\n\n7\n\nx\n8\ny\n\nz")] == [("a", "x y")]
    assert cues(text_units.vtt_cues, "a --> b\n\nx") == []


def plain_batches(sizes, max_chars, max_items):
    out, chars, items, batch = [], 0, 0, 0
    for n in sizes:
        if items and (chars + n > max_chars or items >= max_items):
            batch, chars, items = batch + 1, 0, 0
        chars, items = chars + n, items + 1
        out.append(batch)
    return out


def test_batches_of_one_large_group_are_in_many_tasks(spark):
    rng = np.random.default_rng(4)
    sizes = rng.integers(0, 3000, 200_000)
    rows = spark.createDataFrame(pd.DataFrame({"g": "one", "o": np.arange(len(sizes)), "n": sizes}))
    got = text_units.batches(rows, "g", "o", "n").withColumn("part", F.spark_partition_id())
    got = got.select("o", "batch", "part").toPandas().sort_values("o")
    assert got["batch"].tolist() == plain_batches(sizes.tolist(), 8000, 20)
    assert got.groupby("part").size().max() < len(sizes) / 2


def test_batches_of_many_groups(spark):
    rng = random.Random(8)
    rows = [(g, o, rng.choice([0, 1, 5, 9, 30, None])) for g, many in [(None, 7), ("", 3), ("null", 5), ("a", 4000), ("b", 1), ("c", 900), ("d", 40)] for o in range(many)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "g string, o long, n long")
    for max_chars, max_items in ((20, 3), (1000, 4), (10, 1000), (0, 1)):
        got = text_units.batches(docs, "g", "o", "n", max_chars, max_items).collect()
        assert len(got) == len(rows)
        for g in {r[0] for r in rows}:
            mine = sorted((r["o"], r["batch"], r["n"] or 0) for r in got if r["g"] == g)
            assert [b for _, b, _ in mine] == plain_batches([n for _, _, n in mine], max_chars, max_items)
    assert text_units.batches(docs.limit(0), "g", "o", "n").count() == 0


def test_rounding_equals_python(spark):
    rng = np.random.default_rng(6)
    whole = rng.integers(-(10**9), 10**9, 250_000)
    near = (whole + 0.5) / 100  # near ties
    values = np.concatenate([near, np.nextafter(near, 0), whole / 8, rng.normal(0, 1e4, 250_000), [2.675, 0.5, 1.5, -0.5, 0.125, 1e300, -1e-300, 0.0]])
    frame = spark.createDataFrame(pd.DataFrame({"x": values}))
    got = frame.select("x", *[rounding.half_even(F.col("x"), d).alias(f"r{d}") for d in (0, 2, 4)]).toPandas()
    for d in (0, 2, 4):
        assert got[f"r{d}"].tolist() == [round(x, d) for x in got["x"].tolist()]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "x double").select(rounding.half_even(F.col("x"), 2).alias("r"))
    assert [repr(r["r"]) for r in odd.collect()] == ["nan", "inf", "None"]


def test_last_values_of_a_long_list(spark):
    n = 32_000
    rows = spark.createDataFrame([([f"k{i % 9000}" for i in range(n)], [str(i) for i in range(n)])], "k array<string>, v array<string>")
    begin = time.time()
    got = rows.select(checks.last_values(F.col("k"), F.col("v")).alias("m")).first()["m"]
    assert got == {f"k{i % 9000}": str(i) for i in range(n)}
    assert time.time() - begin < 60
