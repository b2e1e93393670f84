"""Power-curve queries: quantity as wind, a hundredth of the price as power, parts as curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import windpower
from ..functions.rounding import half_even
from ..operators import power
from .base import Query, table

RHO, DIAMETER = 1.02, 220.0


def curves(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select("l_partkey", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ord"), (F.col("l_quantity") - 1).alias("wind"), (F.col("l_extendedprice") / 100).alias("power"))


def cp_points(spark: SparkSession, d: str) -> DataFrame:
    p = power.curve_points(curves(spark, d), RHO, DIAMETER)
    return p.select("l_partkey", "ord", "wind", "power", F.round("theoretical_power_kw", 6).alias("theoretical_power_kw"), F.round("cp", 9).alias("cp"))


def _summary(spark: SparkSession, d: str) -> DataFrame:
    return power.curve_summary(power.curve_points(curves(spark, d), RHO, DIAMETER), "l_partkey", "ord")


def cp_summary_by_part(spark: SparkSession, d: str) -> DataFrame:
    s = _summary(spark, d)
    return s.select("l_partkey", "row_count", F.round("cp_max", 9).alias("cp_max"), "cp_max_wind_speed_ms", "cp_max_power_kw", F.round("cp_max_theoretical_power_kw", 6).alias("cp_max_theoretical_power_kw"), "cp_above_betz_count")


def cp_betz_gate(spark: SparkSession, d: str) -> DataFrame:
    return power.physical(_summary(spark, d)).select("l_partkey", "row_count")


def curve_line_parse(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_linenumber")
    line = F.when(k % 4 == 0, F.lit("V(m/s)  P(kW)")).when(k % 4 == 1, F.concat_ws(" ", F.format_string("%.1f", "l_quantity"), F.lit("1,234.5"), F.format_string("%.2f", "l_discount"))).when(k % 4 == 2, F.concat_ws(",", F.format_string("%.0f", "l_quantity"), F.format_string("%.2f", "l_tax"))).otherwise(F.format_string("%.0f", "l_quantity"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", windpower.curve_line(line).alias("c"))
    return rows.where("c IS NOT NULL").select("l_orderkey", "l_linenumber", F.col("c.wind").alias("wind"), F.col("c.power").alias("power"), F.col("c.ct").alias("ct"))


def cp_parameter_gate(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.concat(F.lit("curve\n"), F.when(k % 3 == 0, "model: ").otherwise("type "), F.lit("G5000-"), (100 + k % 150).cast("string"), F.lit(" kW"))
    rho, diameter = 0.4 + (k % 13) / 10.0, (20 + k % 350).cast("double")
    hint = windpower.model_diameter(text)
    return table(spark, d, "part").select("p_partkey", hint.alias("hint"), windpower.parameter_error(rho, diameter, hint).alias("error"))


def cp_report(spark: SparkSession, d: str) -> DataFrame:
    return power.csv_lines(power.curve_points(curves(spark, d), RHO, DIAMETER), "l_partkey", "ord", digits=5)


def rounded_prices(spark: SparkSession, d: str) -> DataFrame:
    """Prices rounded by their exact binary values: eighths have true ties, discounted ones near ties."""
    price = F.col("l_extendedprice")
    near = half_even(price * (1 - F.col("l_discount")), 2)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", near.alias("discounted"), half_even(F.floor(price) / 8, 2).alias("eighth"), half_even(price / 1000, 4).alias("thousandth"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (cp_points, cp_summary_by_part, cp_betz_gate, curve_line_parse, cp_parameter_gate, cp_report, rounded_prices)}
_P = """SELECT l_partkey, l_orderkey * 100 + l_linenumber AS ord, l_quantity - 1 AS wind, l_extendedprice / 100 AS power,
  0.5 * 1.02::DOUBLE * (l_quantity - 1) * (l_quantity - 1) * (l_quantity - 1) * (pi() * 220.0::DOUBLE * 220.0::DOUBLE / 4) / 1000 AS pw FROM lineitem WHERE l_quantity > 1"""
_S = f"""SELECT l_partkey, count(*) AS row_count, round(max(power / pw), 9) AS cp_max, arg_max(wind, (power / pw, -ord)) AS cp_max_wind_speed_ms,
  arg_max(power, (power / pw, -ord)) AS cp_max_power_kw, round(arg_max(pw, (power / pw, -ord)), 6) AS cp_max_theoretical_power_kw,
  count(*) FILTER (WHERE power / pw > 0.593) AS cp_above_betz_count FROM ({_P}) GROUP BY l_partkey"""
SQL = {
    "cp_points": f"SELECT l_partkey, ord, wind, power, round(pw, 6) AS theoretical_power_kw, round(power / pw, 9) AS cp FROM ({_P})",
    "cp_summary_by_part": _S,
    "cp_betz_gate": f"SELECT l_partkey, row_count FROM ({_S}) WHERE cp_above_betz_count = 0",
    "curve_line_parse": """SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linenumber % 4 = 1 THEN printf('%.1f', l_quantity)::DOUBLE ELSE printf('%.0f', l_quantity)::DOUBLE END AS wind,
  CASE WHEN l_linenumber % 4 = 1 THEN 1234.5::DOUBLE ELSE printf('%.2f', l_tax)::DOUBLE END AS power,
  CASE WHEN l_linenumber % 4 = 1 THEN printf('%.2f', l_discount)::DOUBLE END AS ct
FROM lineitem WHERE l_linenumber % 4 IN (1, 2)""",
    "cp_parameter_gate": """SELECT p_partkey, hint, CASE WHEN NOT rho BETWEEN 0.5 AND 1.5 THEN 'density' WHEN NOT dia BETWEEN 30 AND 350 THEN 'diameter'
  WHEN abs(dia - hint) > greatest(10.0, hint * 0.1) THEN 'model' END AS error
FROM (SELECT p_partkey, (100 + p_partkey % 150)::DOUBLE AS hint, 0.4::DOUBLE + (p_partkey % 13) / 10.0::DOUBLE AS rho, (20 + p_partkey % 350)::DOUBLE AS dia FROM part)""",
    "rounded_prices": """SELECT l_orderkey, l_linenumber, format('{:.2f}', l_extendedprice * (1 - l_discount))::DOUBLE AS discounted,
  format('{:.2f}', floor(l_extendedprice) / 8)::DOUBLE AS eighth, format('{:.4f}', l_extendedprice / 1000)::DOUBLE AS thousandth FROM lineitem""",
    "cp_report": f"""WITH t AS (SELECT l_partkey, ord, wind::VARCHAR || ',' || power::VARCHAR || printf(',%.5f,%.5f', pw, power / pw) AS line FROM ({_P}))
SELECT l_partkey, 'wind_speed_ms,power_kw,theoretical_power_kw,cp' || chr(10) || string_agg(line, chr(10) ORDER BY ord, line) AS csv FROM t GROUP BY l_partkey""",
}
