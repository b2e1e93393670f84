"""Streaming extensions: file-drop ingest, first-wins deduplication and running batches (STR-X1 to STR-X3)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.markdown import statistics


def dropped_documents(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Documents of Parquet files as they are dropped in a folder, with their statistics; stateless."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return stream.withColumn("stats", statistics(F.col("text")))


def _timed(stream: DataFrame, time: str) -> DataFrame:
    """With the event time as a timestamp, which watermarks ask for."""
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def first_seen(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed, so state is bounded."""
    return _timed(stream, time).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, group: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Counts per tumbling window and group; rows later than the delay are left out."""
    return _timed(stream, time).withWatermark(time, delay).groupBy(F.window(time, width), group).agg(F.count("*").alias("n"))


def running_batches(stream: DataFrame, group: str, order: str, size: str, max_chars: int = 8000, max_items: int = 20, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The greedy batches of slots, continued from one micro-batch to the next; state is four numbers a group.

    With an event time, a group is forgotten once the watermark, ``delay`` behind
    the newest row, has passed the group's newest row, so state is bounded by the
    groups of that span; rows behind the watermark are left out, as in any windowed
    stream, and a group that comes back begins at batch 0. Without one, state is
    kept for ever. A null size counts as 0; a group with null times only ends as
    soon as the watermark moves.
    """
    names = [group, order, size]
    types = dict(stream.dtypes)
    schema = ",".join(f"{n} {types[n]}" for n in names) + ",batch bigint"
    rows = stream.select(*names)
    if time is not None:
        timed = _timed(stream, time).withWatermark(time, delay)
        rows = timed.select(*names, *([] if time in names else [time]), F.unix_millis(time).alias("_ms"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        chars, items, batch, last = state.get if state.exists else (0, 0, 0, 0)
        found = pd.concat(list(frames)).sort_values(order)
        out = []
        for n in found[size].fillna(0):
            if items and (chars + n > max_chars or items >= max_items):
                chars, items, batch = 0, 0, batch + 1
            chars, items = chars + int(n), items + 1
            out.append(batch)
        if time is not None:
            newest = found["_ms"].max()
            last = max(last, 0 if pd.isna(newest) else int(newest))
        state.update((chars, items, batch, last))
        if time is not None:
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))
        yield found[names].assign(batch=out)

    timeout = GroupStateTimeout.NoTimeout if time is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy(group).applyInPandasWithState(step, schema, "chars long, items long, batch long, last long", "append", timeout)
