"""Vector shapes as pixels of a region at a resolution (SNK-42): scanlines, crossings in pairs, topmost shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markdown import once

POINTS_PER_INCH = 72.0


def pixel_size(region: Column, dpi: float) -> tuple[Column, Column]:
    """Width and height in pixels of a rectangle in points; the last pixel may stand over."""
    scale = dpi / POINTS_PER_INCH
    return tuple(F.greatest(F.ceil((region[b] - region[a]) * F.lit(scale)), F.lit(0)).cast("int") for a, b in (("x0", "x1"), ("y0", "y1")))


def _edges(ring: Column, region: Column, scale: float) -> Column:
    """The sides of a closed ring in pixels of the region, from each point to the next and from the last to the first."""
    sound = F.filter(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    points = F.transform(sound, lambda p: F.struct(((p["x"] - region["x0"]) * F.lit(scale)).alias("x"), ((p["y"] - region["y0"]) * F.lit(scale)).alias("y")))

    def side(p: Column, q: Column) -> Column:
        return F.struct(p["x"].alias("x"), p["y"].alias("y"), q["x"].alias("u"), q["y"].alias("v"))

    return once(points, lambda a: F.transform(a, lambda p, i: side(p, F.get(a, (i + 1) % F.size(a)))))


def filled_runs(shapes: DataFrame, keys: list[str], dpi: float) -> DataFrame:
    """Runs of pixels inside each shape: the keys, ``row``, and pixels ``x0`` up to but not ``x1``.

    shapes have ``ring`` (array of x, y in points, closed by itself) and
    ``region`` (x0, y0, x1, y1 in points), outside of which nothing is painted.
    A pixel is inside if its centre is, by the even-odd rule; of centres on an
    edge those on left and upper ones are. Rows of the same keys are rings of one
    shape, so a ring within another is a hole and a repeated row cancels the first.
    Points with a null or NaN are left out; null, empty and flat rings and empty
    regions give no runs. Other columns are dropped.

    Each side of a ring gives one crossing a scanline within the region, wherever
    it is read; only crossings travel, by shape and scanline, so a shape with very
    many sides is in as many groups as it has rows.
    """
    width, height = pixel_size(F.col("region"), dpi)
    sides = shapes.select(*keys, width.alias("_w"), height.alias("_h"), F.explode(_edges(F.col("ring"), F.col("region"), dpi / POINTS_PER_INCH)).alias("_s")).select(*keys, "_w", "_h", "_s.*")
    top, bottom = F.ceil(F.least("y", "v") - 0.5), F.ceil(F.greatest("y", "v") - 0.5)
    spans = sides.withColumns({"_top": F.greatest(top, F.lit(0)).cast("int"), "_end": F.least(bottom, F.col("_h")).cast("int")}).where("_top < _end")
    at = F.col("x") + (F.col("row") + 0.5 - F.col("y")) * (F.col("u") - F.col("x")) / (F.col("v") - F.col("y"))
    crossings = spans.withColumn("row", F.explode(F.sequence("_top", F.col("_end") - 1))).select(*keys, "_w", "row", at.alias("_at"))
    line = Window.partitionBy(*keys, "row").orderBy("_at")
    pairs = crossings.withColumns({"_n": F.row_number().over(line), "_to": F.lead("_at").over(line)}).where("_n % 2 = 1")
    x0, x1 = F.greatest(F.ceil(F.col("_at") - 0.5), F.lit(0)), F.least(F.ceil(F.col("_to") - 0.5), F.col("_w"))
    return pairs.select(*keys, "row", x0.cast("int").alias("x0"), x1.cast("int").alias("x1")).where("x0 < x1")


def painted(runs: DataFrame, page: list[str], order: str) -> DataFrame:
    """The topmost shape of each pixel that any covers: ``page``, ``row``, ``x`` and the ``order`` of that shape.

    Shapes are painted in ascending ``order`` (null first). Of a pixel's shapes each
    task keeps only the last, so what travels is at most the pixels that it covers.
    """
    pixels = runs.select(*page, "row", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"), order)
    return pixels.groupBy(*page, "row", "x").agg(F.max(order).alias(order))
