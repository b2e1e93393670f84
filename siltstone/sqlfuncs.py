"""The pure column functions as SQL functions of a session, so they stay visible to the optimizer."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .functions import geo
from .sources import html_tree, readers


def _register_pair(spark: SparkSession, name: str, source: str, target: str) -> None:
    """A temporary SQL function that returns a struct of lon and lat."""
    lon, lat = geo.convert(F.col("lon"), F.col("lat"), source, target)
    body = f"named_struct('lon', {_sql(spark, lon)}, 'lat', {_sql(spark, lat)})"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(lon DOUBLE, lat DOUBLE) RETURNS STRUCT<lon: DOUBLE, lat: DOUBLE> RETURN {body}")


def _sql(spark: SparkSession, column: Column) -> str:
    """The SQL text of a column, resolved against columns lon and lat."""
    frame = spark.createDataFrame([], "lon double, lat double").select(column.alias("x"))
    return frame._jdf.queryExecution().analyzed().expressions().head().child().sql()


def register(spark: SparkSession) -> None:
    """coord conversions, ``cp``, ``overlap_ratio`` as SQL expressions; HTML and formula readers as Arrow functions."""
    for a, b in geo.CONVERSIONS:
        _register_pair(spark, f"{a}_to_{b}", a, b)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION cp(wind DOUBLE, power DOUBLE, rho DOUBLE, diameter DOUBLE) RETURNS DOUBLE RETURN CASE WHEN wind > 0 THEN power / (0.5 * rho * wind * wind * wind * pi() * diameter * diameter / 4 / 1000) END")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION overlap_ratio(ax0 DOUBLE, ay0 DOUBLE, ax1 DOUBLE, ay1 DOUBLE, bx0 DOUBLE, by0 DOUBLE, bx1 DOUBLE, by1 DOUBLE) RETURNS DOUBLE "
        "RETURN CASE WHEN ax1 > ax0 AND ay1 > ay0 THEN greatest(0, least(ax1, bx1) - greatest(ax0, bx0)) * greatest(0, least(ay1, by1) - greatest(ay0, by0)) / ((ax1 - ax0) * (ay1 - ay0)) ELSE 0 END"
    )
    for name, f in (("html_to_text", html_tree.html_to_text), ("html_to_markdown", html_tree.html_to_markdown), ("html_main_content", html_tree.html_main_content), ("omml_to_latex", readers.omml_to_latex)):
        spark.udf.register(name, f)
