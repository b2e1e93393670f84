"""Session settings that the operators count on."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def session(name: str = "siltstone", master: str | None = None, **more: str) -> SparkSession:
    """A session with our settings; ``more`` (dots as double underscores) adds to them."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The application's folder that driver and executors share.

    ``spark.checkpoint.dir`` names where it is. Only where that is unset and all
    runs on one machine (tests) a folder of our own is made; otherwise it is an
    error.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors of {context.master} share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="siltstone-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as it is in the files of a checkpoint in the shared folder, with the same partitions, so that it is the same wherever it is read again."""
    shared_folder(df.sparkSession)
    ship_code(df.sparkSession)
    return df.checkpoint()


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the Python workers once an application, so that it needn't be installed on them."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    bundle = Path(tempfile.mkdtemp(prefix="siltstone-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(bundle, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    spark.sparkContext.addPyFile(str(bundle))
    _SHIPPED.add(app)
