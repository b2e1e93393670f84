"""Coordinate queries. Points come from order keys: longitude 70 to 140, latitude 2 to 55, inside and outside the box."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from .base import Query, table


def points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", (70 + (k % 7000) / 100.0).alias("lon"), (2 + (k % 5300) / 100.0).alias("lat"))


def _conversion(source: str, target: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        lon, lat = geo.convert(F.col("lon"), F.col("lat"), source, target)
        return points(spark, d).select("o_orderkey", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))

    return run


def dispatch(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in (" GPS ", "高德", "09", "nowhere")])
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select("c_custkey", (73 + k % 60).cast("double").alias("lon"), (4 + k % 49).cast("double").alias("lat"), F.get(names, (k % 4).cast("int")).alias("source"), F.get(names, (F.floor(k / 4) % 3).cast("int")).alias("target"))
    lon, lat = geo.convert_by_columns(F.col("lon"), F.col("lat"), F.col("source"), F.col("target"))
    return rows.select("c_custkey", geo.system_key_column(F.col("source")).alias("source_key"), geo.system_key_column(F.col("target")).alias("target_key"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


def point_tokens(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    token = F.concat(F.when(k % 5 == 0, "x").otherwise(""), (100 + k % 20).cast("string"), F.get(F.array(F.lit(","), F.lit("，"), F.lit("  "), F.lit(" , ")), (k % 4).cast("int")), (k % 50).cast("string"), F.when(k % 7 == 0, ",1").otherwise(""))
    lon, lat = geo.parse_point(token)
    return table(spark, d, "customer").select("c_custkey", lon.alias("lon"), lat.alias("lat"))


_POINTS = "SELECT o_orderkey, 70 + (o_orderkey % 7000) / 100.0::DOUBLE AS lon, 2 + (o_orderkey % 5300) / 100.0::DOUBLE AS lat FROM orders"


def _shift(source: str) -> str:
    """SQL for the columns of ``source`` with the shift in degrees as e and n."""
    x, y = "(lon - 105.0)", "(lat - 35.0)"
    waves = f"(20.0*sin(6.0*{x}*pi()) + 20.0*sin(2.0*{x}*pi()))*2.0/3.0"
    east = f"300.0 + {x} + 2.0*{y} + 0.1*{x}*{x} + 0.1*{x}*{y} + 0.1*sqrt(abs({x})) + {waves} + (20.0*sin({x}*pi()) + 40.0*sin({x}/3.0*pi()))*2.0/3.0 + (150.0*sin({x}/12.0*pi()) + 300.0*sin({x}/30.0*pi()))*2.0/3.0"
    north = f"-100.0 + 2.0*{x} + 3.0*{y} + 0.2*{y}*{y} + 0.1*{x}*{y} + 0.2*sqrt(abs({x})) + {waves} + (20.0*sin({y}*pi()) + 40.0*sin({y}/3.0*pi()))*2.0/3.0 + (160.0*sin({y}/12.0*pi()) + 320.0*sin({y}*pi()/30.0))*2.0/3.0"
    inside = "lon BETWEEN 73.66 AND 135.05 AND lat BETWEEN 3.86 AND 53.55"
    w = "(1 - 0.00669342162296594323*sin(lat*pi()/180)*sin(lat*pi()/180))"
    return (
        f"SELECT *, CASE WHEN {inside} THEN ({east})*180.0/(6378245.0/sqrt({w})*cos(lat*pi()/180)*pi()) ELSE 0 END AS e, "
        f"CASE WHEN {inside} THEN ({north})*180.0/((6378245.0*(1-0.00669342162296594323))/({w}*sqrt({w}))*pi()) ELSE 0 END AS n FROM ({source})"
    )


def _to_gcj(s: str) -> str:
    return f"SELECT * EXCLUDE (lon, lat, e, n), lon + e AS lon, lat + n AS lat FROM ({_shift(s)})"


def _to_wgs(s: str) -> str:
    return f"SELECT * EXCLUDE (lon, lat, e, n), lon - e AS lon, lat - n AS lat FROM ({_shift(s)})"


def _to_bd(s: str) -> str:
    a = "pi()*3000.0/180.0"
    inner = f"SELECT *, sqrt(lon*lon + lat*lat) + 0.00002*sin(lat*{a}) AS r, atan2(lat, lon) + 0.000003*cos(lon*{a}) AS t FROM ({s})"
    return f"SELECT * EXCLUDE (lon, lat, r, t), r*cos(t) + 0.0065 AS lon, r*sin(t) + 0.006 AS lat FROM ({inner})"


def _from_bd(s: str) -> str:
    a = "pi()*3000.0/180.0"
    moved = f"SELECT * EXCLUDE (lon, lat), lon - 0.0065 AS x, lat - 0.006 AS y FROM ({s})"
    inner = f"SELECT *, sqrt(x*x + y*y) - 0.00002*sin(y*{a}) AS r, atan2(y, x) - 0.000003*cos(x*{a}) AS t FROM ({moved})"
    return f"SELECT * EXCLUDE (x, y, r, t), r*cos(t) AS lon, r*sin(t) AS lat FROM ({inner})"


_STEPS = {
    ("wgs84", "gcj02"): _to_gcj,
    ("gcj02", "wgs84"): _to_wgs,
    ("gcj02", "bd09"): _to_bd,
    ("bd09", "gcj02"): _from_bd,
    ("wgs84", "bd09"): lambda s: _to_bd(_to_gcj(s)),
    ("bd09", "wgs84"): lambda s: _to_wgs(_from_bd(s)),
}

QUERIES: dict[str, Query] = {f"coord_{a}_to_{b}": _conversion(a, b) for a, b in _STEPS} | {"coord_dispatch": dispatch, "coord_point_tokens": point_tokens}
SQL = {f"coord_{a}_to_{b}": f"SELECT o_orderkey, round(lon, 6) AS lon, round(lat, 6) AS lat FROM ({f(_POINTS)})" for (a, b), f in _STEPS.items()}
_SYSTEMS = "CASE ({}) WHEN 0 THEN 'wgs84' WHEN 1 THEN 'gcj02' WHEN 2 THEN 'bd09' END"
_CUSTOMERS = f"SELECT c_custkey, (73 + c_custkey % 60)::DOUBLE AS lon, (4 + c_custkey % 49)::DOUBLE AS lat, {_SYSTEMS.format('c_custkey % 4')} AS source_key, {_SYSTEMS.format('(c_custkey // 4) % 3')} AS target_key FROM customer"
_CASES = " UNION ALL ".join(
    [f"SELECT c_custkey, source_key, target_key, round(lon, 6) AS lon, round(lat, 6) AS lat FROM ({_CUSTOMERS}) WHERE source_key = target_key",
     f"SELECT c_custkey, source_key, target_key, NULL::DOUBLE AS lon, NULL::DOUBLE AS lat FROM ({_CUSTOMERS}) WHERE source_key IS NULL OR target_key IS NULL"]
    + [f"SELECT c_custkey, source_key, target_key, round(lon, 6) AS lon, round(lat, 6) AS lat FROM ({f(f'''SELECT * FROM ({_CUSTOMERS}) WHERE source_key = '{a}' AND target_key = '{b}' ''')})" for (a, b), f in _STEPS.items()]
)
SQL["coord_dispatch"] = _CASES
SQL["coord_point_tokens"] = """
SELECT c_custkey, CASE WHEN ok THEN (100 + c_custkey % 20)::DOUBLE END AS lon, CASE WHEN ok THEN (c_custkey % 50)::DOUBLE END AS lat
FROM (SELECT c_custkey, c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AS ok FROM customer)
"""
