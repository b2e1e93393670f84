"""Intermediate tables in the shared folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import tempfile
import uuid

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .. import session

_OWN: dict[str, str] = {}
_MADE: list[tuple[object, str]] = []
#: Paths made in the innermost ``scratch`` of this thread.
_SCOPE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scope", default=None)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it. Only where that is unset and all runs on
    one machine (tests) a folder of our own is made; on a cluster each executor
    would write to its own disk, so that is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors of {master} share")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN[key] = "file://" + tempfile.mkdtemp(prefix="siltstone-")
    return _OWN[key]


#: Bytes of an Arrow batch at most; the JVM and the Python worker each hold a few at a time.
ARROW_BYTES = 2 << 20


def ship_code(spark: SparkSession) -> None:
    """Make the session ready for our Python functions.

    The package is sent to the workers once an application, so that it needn't be
    installed on them, and the session's limit on the size of Arrow batches is
    lowered to ``ARROW_BYTES`` if it is higher.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(limit, str(64 << 20)).rstrip("bB")) > ARROW_BYTES:
        spark.conf.set(limit, str(ARROW_BYTES))
    session.ship_code(spark)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it is removed when Python ends."""
    path = f"{shared_root(spark)}/siltstone/{uuid.uuid4().hex}-{name}"
    _MADE.append((spark, path))
    if (scope := _SCOPE.get()) is not None:
        scope.append(path)
    return path


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    This cuts the lineage without tying rows to one executor: the files outlive
    any executor, and a lost task rereads them.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


@contextlib.contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Within, tables may be written freely; at the end only those put on the list stay.

    For operators that finish their work before they return, so that what they
    needed on the way doesn't take up the shared folder. What other threads write
    meanwhile is theirs; what is kept belongs to the scope around, if any.
    """
    outer, made = _SCOPE.get(), []
    token = _SCOPE.set(made)
    keep: list[DataFrame] = []
    try:
        yield keep
    finally:
        _SCOPE.reset(token)
    kept = {df._written_to for df in keep}
    gone = [path for path in made if path not in kept]
    for path in gone:
        spark = next(s for s, p in _MADE if p == path)
        remove(spark, path)
    _MADE[:] = [x for x in _MADE if x[1] not in gone]
    if outer is not None:
        outer.extend(kept & set(made))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of ours through Spark's file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@atexit.register
def _tidy() -> None:
    for spark, path in _MADE:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone already
            return
