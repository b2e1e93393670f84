"""Importance resampling towards a target distribution, by hashed n-grams.

Features of a text are its runs of 1 to ``n`` words, hashed to buckets. A bucket's
gain is the logarithm of its share in the target over its share in the corpus, a
document's weight the mean gain of its features, and the documents drawn are
those with the highest weights after Gumbel noise that is fixed by their ids.

Texts are very uneven in length, so long ones are cut into chunks at word
boundaries. A chunk owns the features that start at its first ``size`` words and
carries the n - 1 words after them, so each feature is counted once. Chunks of
long texts are dealt out on their own; counts and weights are summed by document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import scratch, ship_code, shuffle_partitions, written
from .words import LOWER, NOT_ALNUM, find_words, sliced, text_bytes

N, BUCKETS, LEAST_WORDS, PERCENT, SEED = 2, 10_000, 20, 25, 7
#: Words whose features a chunk owns.
CHUNK = 4096
#: Texts of more characters are cut into chunks.
LONG = 32_768
#: Scores that are summed up together before single scores are.
COARSE = 64

CUT = T.StructType([T.StructField("row", T.LongType()), T.StructField("text", T.StringType()), T.StructField("own", T.IntegerType())])
COUNTED = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("row", "n_words", "n_features")] + [T.StructField("buckets", T.BinaryType())]
)


def _words(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts: lower-cased bytes, starts and ends, and the first word of each text."""
    buf, offsets = text_bytes(column)
    w = find_words(LOWER[buf], offsets, NOT_ALNUM)
    return w.buf, w.starts, w.ends, w.first


def _cut(batches: Iterator[pa.RecordBatch], n: int, size: int) -> Iterator[pa.RecordBatch]:
    """Chunks of long texts: the bytes from a chunk's first word to the last one that it carries."""
    for t in sliced(batches):
        buf, starts, ends, first = _words(t.column("text"))
        rows = t.column("row").to_pylist()
        for d, row in enumerate(rows):
            for lo in range(int(first[d]), max(int(first[d + 1]), int(first[d]) + 1), size):
                hi = min(lo + size, int(first[d + 1]))
                last = min(hi + n - 1, int(first[d + 1]))
                body = buf[starts[lo] : ends[last - 1]].tobytes().decode("utf-8") if last > lo else ""
                yield pa.RecordBatch.from_pydict({"row": pa.array([row], pa.int64()), "text": pa.array([body]), "own": pa.array([hi - lo], pa.int32())})


def buckets_of(words: list[bytes], own: int, n: int, buckets: int) -> list[int]:
    """The bucket of each run of 1 to n words that starts at one of the first ``own`` words."""
    crc, out = zlib.crc32, []
    for k in range(1, n + 1):
        # The checksum goes on from that of the words before, so a run isn't joined first.
        if k == 1:
            sums = [crc(w) for w in words]
        else:
            sums = [crc(w, crc(b" ", s)) for w, s in zip(words[k - 1 :], sums[: len(words) - k + 1], strict=True)]
        out += [s % buckets for s in sums[:own]]
    return out


def _count(batches: Iterator[pa.RecordBatch], n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for t in sliced(batches):
        buf, starts, ends, first = _words(t.column("text"))
        raw = buf.tobytes()
        own = t.column("own").to_numpy()
        word = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        out = []
        for d in range(t.num_rows):
            mine = word[first[d] : first[d + 1]]
            here = len(mine) if own[d] < 0 else int(own[d])
            out.append((here, np.array(buckets_of(mine, here, n, buckets), "<u4")))
        yield pa.RecordBatch.from_pydict(
            {
                "row": t.column("row").combine_chunks(),
                "n_words": pa.array([w for w, _ in out], pa.int64()),
                "n_features": pa.array([len(b) for _, b in out], pa.int64()),
                "buckets": pa.array([b.tobytes() for _, b in out], pa.binary()),
            }
        )


def _counted(texts: DataFrame, n: int, buckets: int, size: int, long: int) -> DataFrame:
    """Rows (row, n_words, n_features, buckets) of the chunks of texts (row, text), written."""
    spark = texts.sparkSession
    is_long = F.coalesce(F.length("text") > long, F.lit(False))
    short = texts.where(~is_long).select("row", F.coalesce("text", F.lit("")).alias("text"), F.lit(-1).alias("own"))
    cut = texts.where(is_long).mapInArrow(lambda b: _cut(b, n, size), CUT)
    chunks = short.unionByName(cut.repartition(shuffle_partitions(spark)))
    return written(chunks.mapInArrow(lambda b: _count(b, n, buckets), COUNTED), "buckets")


def _histogram(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """How often each bucket occurs in the rows of a task: one row a bucket, so what is shuffled doesn't grow with the texts."""
    total = np.zeros(buckets, np.int64)
    for b in batches:
        for x in b.column(b.schema.get_field_index("buckets")):
            total += np.bincount(np.frombuffer(x.as_buffer(), "<u4"), minlength=buckets)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})


def _histogram_of(counted: DataFrame, name: str, buckets: int) -> DataFrame:
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])
    parts = counted.select("buckets").mapInArrow(lambda b: _histogram(b, buckets), schema)
    return parts.groupBy("bucket").agg(F.sum("n").alias(name))


def gains(spark: SparkSession, corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket in thousandths, from the counted chunks of both tables. ``buckets`` numbers come to the driver."""
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(_histogram_of(corpus, "s", buckets), "bucket", "left").join(_histogram_of(target, "t", buckets), "bucket", "left")
    rows = both.na.fill(0).toPandas().sort_values("bucket")
    s, t = rows["s"].to_numpy(np.float64), rows["t"].to_numpy(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _weigh(batches: Iterator[pa.RecordBatch], gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        total = [int(gain[np.frombuffer(x.as_buffer(), "<u4")].sum()) for x in b.column(b.schema.get_field_index("buckets"))]
        kept = {c: b.column(b.schema.get_field_index(c)) for c in ("row", "n_words", "n_features")}
        yield pa.RecordBatch.from_pydict(kept | {"gain": pa.array(total, pa.int64())})


def ranked(scored: DataFrame, n_drawn: int) -> DataFrame:
    """The rows with a column rank: 1 to ``n_drawn`` by score from high to low, ties to smaller doc_id; null for the others.

    Rows of one score are numbered among themselves, behind the number of rows
    with a higher score. Such numbers are sums over the distinct scores, first of
    64 together, so no task sorts all rows.
    """
    coarse = F.floor(F.col("score") / COARSE)
    sizes = scored.where("eligible").groupBy("score").agg(F.count("*").alias("size")).withColumn("coarse", coarse)
    groups = sizes.groupBy("coarse").agg(F.sum("size").alias("size"))
    before = groups.select("coarse", (F.sum("size").over(Window.orderBy(F.desc("coarse"))) - F.col("size")).alias("above"))
    within = Window.partitionBy("coarse").orderBy(F.desc("score"))
    sizes = sizes.withColumn("higher", F.sum("size").over(within) - F.col("size")).join(before, "coarse")
    sizes = sizes.select("score", (F.col("above") + F.col("higher")).alias("above")).where(F.col("above") < n_drawn)
    near = scored.join(sizes, "score", "left")
    place = Window.partitionBy("score", "eligible").orderBy("doc_id", "n_features", "row")
    rank = F.col("above") + F.row_number().over(place)
    return near.withColumn("rank", F.when(F.col("eligible") & (rank <= n_drawn), rank))


def resample(
    docs: DataFrame,
    target: DataFrame,
    n: int = N,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
    text: str = "text",
    doc_id: str = "doc_id",
    target_text: str = "text",
    chunk: int = CHUNK,
    long: int = LONG,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_features, weight, score, rank (all long).

    Words are lower-cased (A-Z) runs of ASCII letters, digits and other than ASCII
    characters. ``rank`` numbers the ``percent`` of the rows with at least
    ``least_words`` words that are drawn; it is null for the others. A null or
    empty text has no features and weight 0. A row without an id has the noise of
    an empty id. Rows with one id are rows of their own, in the order of their
    features. An empty table gives an empty result; with an empty target every
    gain is that of counts of 0. Only the columns named are read, so names of
    others don't matter.
    """
    spark = docs.sparkSession
    ship_code(spark)
    with scratch() as keep:
        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        corpus = _counted(rows.select("row", "text"), n, buckets, chunk, long)
        aim = _counted(target.select(F.monotonically_increasing_id().alias("row"), F.col(target_text).alias("text")), n, buckets, chunk, long)
        gain = gains(spark, corpus, aim, buckets)
        schema = T.StructType([T.StructField(c, T.LongType()) for c in ("row", "n_words", "n_features", "gain")])
        parts = corpus.mapInArrow(lambda b: _weigh(b, gain), schema)
        sums = parts.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")))
        # Whole numbers throughout: a mean in doubles could round up to the next one.
        floored = F.expr("(gain - pmod(gain, n_features)) DIV n_features")
        sums = sums.select("row", "n_words", "n_features", F.when(F.col("n_features") > 0, floored).otherwise(0).alias("weight"))
        digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
        h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
        noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
        scored = rows.select("row", "doc_id").join(sums, "row").withColumn("score", F.col("weight") + noise)
        scored = written(scored.withColumn("eligible", F.col("n_words") >= least_words), "scored")
        n_drawn = percent * scored.where("eligible").count() // 100
        out = written(ranked(scored, n_drawn).select("doc_id", "n_words", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank")), "resampled")
        keep.append(out)
    return out
