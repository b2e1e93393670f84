"""Memory of Python workers, measured in processes of their own."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[2]

DECONTAMINATION = """
import random, resource
import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T
from siltstone.llm import decontaminate as D

rng = random.Random(3)
words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(50_000)]
state = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("_hits", T.BinaryType()), T.StructField("_items", T.ArrayType(T.StringType()))])
arrow, final = to_arrow_schema(state), to_arrow_schema(T.StructType([*state.fields[:2], *D.RESULT.fields]))
planted = " ".join(words[:12])

def batches():
    for b in range(16):
        texts = [" ".join(rng.choices(words, k=500)) for _ in range(320)]
        texts[7] += " " + planted
        yield pa.RecordBatch.from_arrays([pa.array(range(320), pa.int64()), pa.array(texts), pa.nulls(320, pa.binary()), pa.nulls(320, pa.list_(pa.string()))], schema=arrow)

def anonymous():
    with open("/proc/self/status") as f:
        return next(int(x.split()[1]) for x in f if x.startswith("RssAnon")) / 1024

phrases = D.Phrases([("q", planted)], 10)
for _ in batches():
    pass
before, peak = anonymous(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
rows = D._finish(D._pass(batches(), "text", phrases, arrow), "text", final, True)
try:
    from siltstone.llm.words import lean
    rows = lean(rows)
except ImportError:
    pass
hit = sum(sum(r.column("n_hit").to_pylist()) for r in rows)
del rows
print(hit, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024 - peak, anonymous() - before)
"""


@pytest.mark.skipif(not Path("/proc/self/status").exists(), reason="reads Linux's figures")
def test_a_worker_of_decontamination_stays_small():
    """At its peak it takes a small multiple of a slice, and in the end keeps little."""
    run = subprocess.run([sys.executable, "-c", DECONTAMINATION], cwd=REPO, capture_output=True, text=True, check=True)
    hit, peak, kept = map(float, run.stdout.split())
    assert hit == 16 * 12
    assert peak < 100
    assert kept < 60
