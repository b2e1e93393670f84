"""Shared by the query modules: tables, and inputs derived from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def div(a: Column, b: int) -> Column:
    """Whole-number division."""
    return F.floor(a / b).cast("bigint")
