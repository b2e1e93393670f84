"""Every query runs on the smallest tables, and agrees with its SQL."""

from __future__ import annotations

import glob
import os

import pytest

from siltstone.plans import catalog
from siltstone.streaming import ingest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(columns: list[str], data: list) -> list[str]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([x[i] for i in order]) for x in data)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    got = df.collect()
    if name not in catalog.oracle_sql():
        assert got
        return
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in got]) == rows(columns, want.fetchall())


def test_streams(spark, tmp_path):
    events = spark.readStream.schema(spark.read.parquet(f"{DATA}/events.parquet").schema).parquet(f"{DATA}/event[s].parquet")

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    first = run(ingest.first_seen(events, "user_id", "ts", "60 days"), "first")
    assert first.count() == first.select("user_id").distinct().count() > 0
    counts = run(ingest.windowed_counts(events, "ts", "event_type"), "counts", "complete")
    assert counts.selectExpr("sum(n)").first()[0] == spark.read.parquet(f"{DATA}/events.parquet").count()
    docs = spark.readStream.schema(spark.read.parquet(f"{DATA}/documents.parquet").schema).parquet(f"{DATA}/document[s].parquet")
    got = run(ingest.running_batches(docs, "source", "doc_id", "n_chars"), "batches")
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(got.columns, [tuple(r) for r in catalog.queries()["slot_batches"](spark, DATA).select(*got.columns).collect()])
