"""The sink of texts: what is committed is read back, what fails or is run twice leaves nothing."""

from __future__ import annotations

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.sources import textfiles


def seen(folder):
    return sorted(f for root, _, names in os.walk(folder) for f in names if "_temporary" not in root and not f.startswith("."))


def test_texts_come_back(spark, tmp_path):
    rows = [(f"n{i}.md", t, "clash") for i, t in enumerate(["", None, "ä\n漢\r\n", "x" * 3_000_000, *map(str, range(200))])]
    df = spark.createDataFrame(rows, "title string, body string, name string").repartition(7)
    textfiles.write_texts(df, f"file://{tmp_path}/out", "title", "body")
    got = {r["name"]: r["text"] for r in textfiles.read_texts(spark, f"file://{tmp_path}/out").collect()}
    assert got == {a: b for a, b, _ in rows if b} and seen(tmp_path / "out") == sorted(a for a, _, _ in rows)  # Spark passes over empty files
    assert not (tmp_path / "out/_temporary").exists() or not os.listdir(tmp_path / "out/_temporary")
    textfiles.write_texts(spark.createDataFrame([("more.md", "1")], textfiles.SCHEMA), str(tmp_path / "out"))
    assert len(seen(tmp_path / "out")) == len(rows) + 1  # earlier files stay
    textfiles.write_texts(df.limit(0), str(tmp_path / "none"), "title", "body")
    assert not seen(tmp_path / "none")


def test_tasks_that_read_grow_with_those_that_write(spark, tmp_path):
    """Not with the files, of which a task of Spark's own reader gets 32 at most."""
    rows = spark.range(3000).select(F.concat(F.lit("n"), "id").alias("name"), F.col("id").cast("string").alias("text")).coalesce(2)
    textfiles.write_texts(rows, f"file://{tmp_path}/out")
    got = textfiles.read_texts(spark, f"file://{tmp_path}/out")
    assert got.rdd.getNumPartitions() <= 2 * textfiles.READERS
    assert {(r["name"], r["text"]) for r in got.collect()} == {(f"n{i}", str(i)) for i in range(3000)} and got.count() == 3000
    assert textfiles.read_texts(spark, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("bad", ["a/b", "..", "", None, "_x", "n3"])
def test_a_failing_task_leaves_no_file(spark, tmp_path, bad):
    good = spark.range(40).select(F.concat(F.lit("n"), "id").alias("name"), F.lit("t").alias("text"))
    rows = good.unionByName(spark.createDataFrame([(bad, "t")], textfiles.SCHEMA)).coalesce(1)
    with pytest.raises(Exception, match="not the name|two rows"):
        textfiles.write_texts(rows, str(tmp_path / "out"))
    assert not seen(tmp_path / "out")
    for root, _, names in os.walk(tmp_path):
        assert not names, root


def test_only_committed_attempts_are_seen(tmp_path):
    writer = textfiles.TextFilesWriter(str(tmp_path / "out"))
    batch = pa.RecordBatch.from_pydict({"name": ["a", "b"], "text": ["1", None]})

    def broken():
        yield batch
        raise OSError("executor lost")

    with pytest.raises(OSError):
        writer.write(broken())
    first, again = writer.write(iter([batch])), writer.write(iter([batch]))  # a speculative copy
    assert first.folder != again.folder and not seen(tmp_path / "out")
    writer.commit([again, None])
    assert seen(tmp_path / "out") == ["a", "b"]
    assert not list((tmp_path / "out/_temporary").iterdir())


def test_overwriting_is_refused(spark, tmp_path):
    textfiles.write_texts(spark.createDataFrame([("a", "1")], textfiles.SCHEMA), str(tmp_path))
    with pytest.raises(Exception, match="only appends"):
        spark.createDataFrame([("a", "2")], textfiles.SCHEMA).write.format("textfiles").mode("overwrite").save(str(tmp_path))
    assert seen(tmp_path) == ["a"]
