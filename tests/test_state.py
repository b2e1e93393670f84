"""State of running batches ends with the watermark."""

from __future__ import annotations

from siltstone.streaming import ingest


def test_groups_are_forgotten_behind_the_watermark(spark, tmp_path):
    def drop(n, rows):
        spark.createDataFrame(rows, "g string, o int, n int, ts timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))

    from datetime import datetime as at

    folder, checkpoint = str(tmp_path / "in/*"), str(tmp_path / "state")
    drop(0, [(g, o, 6, at(2024, 1, 1, 0, o)) for g in "ab" for o in range(3)])
    stream = spark.readStream.schema("g string, o int, n int, ts timestamp_ntz").parquet(folder)
    batches = ingest.running_batches(stream, "g", "o", "n", max_chars=12, time="ts", delay="30 minutes")

    def run():
        q = batches.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]

    assert run()[-1] == 2
    drop(1, [("a", 3, 6, at(2024, 1, 1, 0, 20))])  # goes on where it was
    assert run()[-1] == 2
    drop(2, [("c", 0, 6, at(2024, 1, 1, 9, 0))])  # both groups are behind the watermark now
    assert run()[-1] == 1
    drop(3, [("a", 4, 6, at(2024, 1, 1, 9, 10)), ("b", 9, 6, at(2024, 1, 1, 0, 3))])  # a begins anew, b's row is late
    assert run()[-1] == 2
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("g", "o", "batch").collect())
    assert got == [("a", 0, 0), ("a", 1, 0), ("a", 2, 1), ("a", 3, 1), ("a", 4, 0), ("b", 0, 0), ("b", 1, 0), ("b", 2, 1), ("c", 0, 0)]
