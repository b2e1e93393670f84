"""Running sums within groups of any size: no group has to fit into a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def sums_before(rows: DataFrame, keys: list[str], order: list[str], **weights: Column) -> DataFrame:
    """``rows`` with, per named weight (a bigint), its sum over the rows of the group that come before.

    Rows are dealt by ranges of keys and order and kept in files, so a large group
    is in many tasks. Each task sums its own rows; what the tasks before hold of a
    group is one number a group and task. Rows that are equal in keys and order are
    in any order and in one task. Null keys are a group.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*rows.columns, *[w.cast("bigint").alias(f"_w_{n}") for n, w in weights.items()]).repartitionByRange(parts, *keys, *order)
    kept = checkpointed(dealt.select("*", F.spark_partition_id().alias("_part")))
    here = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = kept.withColumns({n: F.coalesce(F.sum(f"_w_{n}").over(here), F.lit(0)) for n in weights})
    totals = kept.groupBy("_part", *keys).agg(*[F.sum(f"_w_{n}").alias(f"_w_{n}") for n in weights])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    entries = totals.select("_part", *[F.col(k).alias(f"_k_{k}") for k in keys], *[F.coalesce(F.sum(f"_w_{n}").over(earlier), F.lit(0)).alias(f"_e_{n}") for n in weights])
    same = inside["_part"] == entries["_part"]
    for k in keys:
        same = same & inside[k].eqNullSafe(entries[f"_k_{k}"])
    return inside.join(entries, same).select(*rows.columns, *[(F.col(n) + F.col(f"_e_{n}")).alias(n) for n in weights])
