"""All queries of the library (the optional training subpackage has its own) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_code
from . import assets, coords, pages, power, shapes, texts
from .base import Query

_MODULES = (coords, power, texts, pages, shapes, assets)


def _shipped(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_code(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {name: _shipped(f) for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items() if name in m.QUERIES}
