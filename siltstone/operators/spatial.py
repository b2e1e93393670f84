"""Boxes of a page that meet, found by cells instead of by all pairs of the page (JOIN-10, JOIN-11, AGG-06, JOIN-20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shapes import RECT, rect
from ..session import checkpointed

#: The smallest cells are 2 ** LOWEST wide.
LOWEST = -10
#: Rows of boxes in cells that a task is given, about.
TASK_ROWS = 1 << 18


def is_finite(box: Column) -> Column:
    """Whether all four sides are numbers; null counts as none."""
    sides = [F.abs(box[s]) < float("inf") for s in RECT]
    return F.coalesce(sides[0] & sides[1] & sides[2] & sides[3], F.lit(False))


def _level(box: Column) -> Column:
    """Cells of 2 ** level are at least as wide as the box, so it lies in at most two of them each way."""
    side = F.greatest(F.abs(box["x1"] - box["x0"]), F.abs(box["y1"] - box["y0"]))
    return F.greatest(F.ceil(F.log2(side)).cast("int"), F.lit(LOWEST))


def _levels(rows: DataFrame, box: str) -> dict[int, int]:
    """The levels that occur, at most as many as there are exponents of doubles, and the rows of each."""
    return {r[0]: r[1] for r in rows.where(is_finite(F.col(box))).groupBy(_level(F.col(box))).count().collect()}


def _cell(x: Column, level: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), level))


def _placed(rows: DataFrame, box: str, own: str, levels: list[int]) -> DataFrame:
    """A row per cell of the box, at its own level and at each larger one of ``levels``."""
    b, m = F.col(box), F.col("_m")
    up = F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), lambda x: x > F.col(own))
    out = rows.where(is_finite(b)).withColumn(own, _level(b)).withColumn("_m", F.explode(F.concat(F.array(own), up)))
    for c, lo, hi in (("_cx", "x0", "x1"), ("_cy", "y0", "y1")):
        out = out.withColumn(c, F.explode(F.sequence(_cell(F.least(b[lo], b[hi]), m), _cell(F.greatest(b[lo], b[hi]), m))))
    return out


def _placed_rows(own: dict[int, int], levels: dict[int, int]) -> int:
    """About how many rows ``_placed`` makes: up to four cells at a box's own level, mostly one or two at larger ones."""
    return sum(n * (4 + 2 * sum(x > level for x in levels)) for level, n in own.items())


def dealt(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """``rows`` in so many tasks by the columns ``by``, or as Spark likes where one is enough.

    Spark joins small partitions by their compressed bytes, and boxes compress so
    well that one task would get all of a large table.
    """
    return rows if n <= 1 else rows.repartition(max(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)


def meeting(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, levels: dict[int, int] | None = None) -> DataFrame:
    """Rows of left with those of right that have equal keys and whose boxes ``a`` and ``b`` meet or touch; each pair once.

    Columns of left and right other than keys must have different names. Cells of
    a box's size keep their numbers small whatever the sizes: a box is entered in
    its cells, and in those of the larger levels of the other side (``levels``
    with their rows, if known to be those of both). A pair is
    judged at the level of its larger box and belongs to the cell that the first
    corner of what they share is in. Boxes with a side that is null, NaN or
    infinite meet nothing; sides in the wrong order are swapped for this. Cells
    are dealt out by their number, so a task has about as many of them for any input.
    """
    of_l, of_r = (_levels(left, a), _levels(right, b)) if levels is None else (levels, levels)
    l, r = _placed(left, a, "_la", sorted(of_r)), _placed(right, b, "_lb", sorted(of_l))
    cell = [*keys, "_m", "_cx", "_cy"]
    n = -(-(_placed_rows(of_l, of_r) + _placed_rows(of_r, of_l)) // TASK_ROWS)
    if n > 1:
        l, r = dealt(l, n, *cell).hint("merge"), dealt(r, n, *cell)
    A, B, m = F.col(a), F.col(b), F.col("_m")
    meet = m == F.greatest("_la", "_lb")
    for c, lo, hi in (("_cx", "x0", "x1"), ("_cy", "y0", "y1")):
        first = F.greatest(F.least(A[lo], A[hi]), F.least(B[lo], B[hi]))
        meet = meet & (first <= F.least(F.greatest(A[lo], A[hi]), F.greatest(B[lo], B[hi]))) & (_cell(first, m) == F.col(c))
    return l.join(r, cell).where(meet).drop("_m", "_cx", "_cy", "_la", "_lb")


def _around(*by: str) -> list[Column]:
    return [f(s).alias(s) for f, s in zip((F.min, F.min, F.max, F.max), by, strict=True)]


def _anchor(lo: str, hi: str, gap: float) -> Column:
    """A point of a grid that the side, with a bit under half a gap around it, holds, and the grid's width.

    The grid is the widest of a power of two for which there must be one.
    """
    extent = F.col(hi) - F.col(lo) + 0.98 * gap
    width = F.pow(F.lit(2.0), F.floor(F.log2(extent)))
    point = F.ceil((F.col(lo) - 0.49 * gap) / width) * width
    there = (extent > 0) & (F.greatest(F.abs(lo), F.abs(hi)) < 1e15) & (width > 1e-9)
    return F.struct(F.when(there, width).alias("w"), F.when(there, point).otherwise(F.col(lo)).alias("p"), F.when(~there, F.col(hi)).alias("q"))


def clusters(rects: DataFrame, keys: list[str], gap: float = 6.0) -> DataFrame:
    """Regions of rectangles that are within a gap of each other on a page: keys, x0, y0, x1, y1 (JOIN-20).

    Regions grow by what is within a gap of them, other regions included, until
    none is near another, so the order of rows doesn't matter. Rounds of two steps:
    boxes that hold the same point of a grid become one, however many they are, by
    one aggregate; then each box joins the one near it with the smallest hash,
    which takes a share of all boxes away, also of long chains. Boxes with a side
    that is null, NaN or infinite are regions of their own; equal ones are one.
    Null keys are a page. Rounds are kept in the checkpoint folder.
    """
    flat = rects.select(F.struct(*keys).alias("_page"), *[F.col(f"bbox.{s}").cast("double").alias(s) for s in RECT]).distinct()
    flat = checkpointed(flat)
    box = F.struct(*RECT)
    odd = flat.where(~is_finite(box))
    now = flat.where(is_finite(box)).select("_page", *[f(a, b).alias(s) for f, a, b, s in ((F.least, "x0", "x1", "x0"), (F.least, "y0", "y1", "y0"), (F.greatest, "x0", "x1", "x1"), (F.greatest, "y0", "y1", "y1"))])
    count, turn = now.count(), 0
    while count:
        held = now.groupBy("_page", _anchor("x0", "x1", gap).alias("_ax"), _anchor("y0", "y1", gap).alias("_ay")).agg(*_around(*RECT))
        held = checkpointed(held.select("_page", *RECT)).withColumn("_id", F.monotonically_increasing_id())
        slack = gap + 1e-6 * (1 + gap)
        a = held.select("_page", "_id", rect(F.col("x0") - slack, F.col("y0") - slack, F.col("x1") + slack, F.col("y1") + slack).alias("_wide"), F.struct(*RECT).alias("_a"))
        b = held.select("_page", F.struct(F.xxhash64("_id", F.lit(turn)).alias("h"), "_id").alias("_other"), F.struct(*RECT).alias("_b"))
        levels = {r[0]: r[1] for r in a.select(F.explode(F.array(_level(F.col("_wide")), _level(F.col("_a")))).alias("level")).groupBy("level").count().collect()}
        A, B = F.col("_a"), F.col("_b")
        near = (B["x0"] - gap <= A["x1"]) & (A["x0"] - gap <= B["x1"]) & (B["y0"] - gap <= A["y1"]) & (A["y0"] - gap <= B["y1"])
        chosen = meeting(a, b, ["_page"], "_wide", "_b", levels).where(near).groupBy("_page", "_id", "_a").agg(F.min("_other").alias("_to"))
        now = checkpointed(chosen.groupBy("_page", "_to").agg(*_around(*(f"_a.{s}" for s in RECT))).toDF("_page", "_to", *RECT).select("_page", *RECT))
        before, count, turn = count, now.count(), turn + 1
        if count == before:
            break
    return now.unionByName(odd).select("_page.*", *RECT)
