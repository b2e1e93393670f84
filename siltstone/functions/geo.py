"""Coordinate systems used in China: WGS84, GCJ02 and BD09 (MTH-01 to MTH-10, FLT-01, JOIN-01).

Every conversion takes two double columns, longitude first, and returns two.
They are plain expressions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the systems: Krasovsky ellipsoid, the box that is shifted, and BD09's own shift.
SEMI_MAJOR, ECCENTRICITY2 = 6378245.0, 0.00669342162296594323
BOX = {"lon": (73.66, 135.05), "lat": (3.86, 53.55)}
BD_ANGLE = math.pi * 3000.0 / 180.0
BD_LON, BD_LAT, BD_RADIUS, BD_TURN = 0.0065, 0.006, 0.00002, 0.000003
#: Weights of 1, x, y, square, x*y and sqrt|x|, then (amplitude, frequency) of the sine waves over x or y.
EAST = ((300.0, 1.0, 2.0, 0.1, 0.1, 0.1), "x", (("x", 20.0, 6.0), ("x", 20.0, 2.0), ("x", 20.0, 1.0), ("x", 40.0, 1 / 3), ("x", 150.0, 1 / 12), ("x", 300.0, 1 / 30)))
NORTH = ((-100.0, 2.0, 3.0, 0.2, 0.1, 0.2), "y", (("x", 20.0, 6.0), ("x", 20.0, 2.0), ("y", 20.0, 1.0), ("y", 40.0, 1 / 3), ("y", 160.0, 1 / 12), ("y", 320.0, 1 / 30)))

#: Names by which the systems are known.
ALIASES = {
    "wgs84": ("wgs84", "wgs", "gps", "84"),
    "gcj02": ("gcj02", "gcj", "gaode", "amap", "高德", "google", "tencent", "腾讯", "火星", "02"),
    "bd09": ("bd09", "bd", "baidu", "百度", "09"),
}

Point = tuple[Column, Column]


def in_box(lon: Column, lat: Column) -> Column:
    """Whether a point is in the shifted region, its edges included."""
    return lon.between(*BOX["lon"]) & lat.between(*BOX["lat"])


def _metres(form: tuple, x: Column, y: Column) -> Column:
    """The shift in metres at a point given relative to 105 E, 35 N."""
    (c0, cx, cy, c2, cxy, croot), squared, waves = form
    at = {"x": x, "y": y}
    total = F.lit(c0) + cx * x + cy * y + c2 * at[squared] * at[squared] + cxy * x * y + croot * F.sqrt(F.abs(x))
    for axis, amplitude, frequency in waves:
        total = total + F.sin(at[axis] * F.lit(frequency * math.pi)) * F.lit(amplitude * 2.0 / 3.0)
    return total


def shift(lon: Column, lat: Column) -> Point:
    """Degrees by which GCJ02 moves a point, zero outside the box."""
    x, y = lon - 105.0, lat - 35.0
    phi = F.radians(lat)
    w2 = 1 - ECCENTRICITY2 * F.pow(F.sin(phi), 2)
    north = F.degrees(_metres(NORTH, x, y) / (SEMI_MAJOR * (1 - ECCENTRICITY2) / (w2 * F.sqrt(w2))))
    east = F.degrees(_metres(EAST, x, y) / (SEMI_MAJOR / F.sqrt(w2) * F.cos(phi)))
    inside = in_box(lon, lat)
    return F.when(inside, east).otherwise(0.0), F.when(inside, north).otherwise(0.0)


def wgs84_to_gcj02(lon: Column, lat: Column) -> Point:
    east, north = shift(lon, lat)
    return lon + east, lat + north


def gcj02_to_wgs84(lon: Column, lat: Column) -> Point:
    """The usual one-step inverse: the shift at the shifted place is taken back (a few metres off at worst)."""
    east, north = shift(lon, lat)
    return lon - east, lat - north


def gcj02_to_bd09(lon: Column, lat: Column) -> Point:
    r = F.hypot(lon, lat) + BD_RADIUS * F.sin(lat * BD_ANGLE)
    a = F.atan2(lat, lon) + BD_TURN * F.cos(lon * BD_ANGLE)
    return r * F.cos(a) + BD_LON, r * F.sin(a) + BD_LAT


def bd09_to_gcj02(lon: Column, lat: Column) -> Point:
    x, y = lon - BD_LON, lat - BD_LAT
    r = F.hypot(x, y) - BD_RADIUS * F.sin(y * BD_ANGLE)
    a = F.atan2(y, x) - BD_TURN * F.cos(x * BD_ANGLE)
    return r * F.cos(a), r * F.sin(a)


def wgs84_to_bd09(lon: Column, lat: Column) -> Point:
    return gcj02_to_bd09(*wgs84_to_gcj02(lon, lat))


def bd09_to_wgs84(lon: Column, lat: Column) -> Point:
    return gcj02_to_wgs84(*bd09_to_gcj02(lon, lat))


CONVERSIONS: dict[tuple[str, str], Callable[[Column, Column], Point]] = {
    ("wgs84", "gcj02"): wgs84_to_gcj02,
    ("gcj02", "wgs84"): gcj02_to_wgs84,
    ("gcj02", "bd09"): gcj02_to_bd09,
    ("bd09", "gcj02"): bd09_to_gcj02,
    ("wgs84", "bd09"): wgs84_to_bd09,
    ("bd09", "wgs84"): bd09_to_wgs84,
}


def system_key(name: str) -> str:
    """The canonical name of a system; ValueError for an unknown one."""
    wanted = name.strip().lower()
    for key, names in ALIASES.items():
        if wanted in names:
            return key
    raise ValueError(f"unknown coordinate system: {name!r}")


def system_key_column(name: Column) -> Column:
    """The same for a column; null where the name is unknown."""
    table = F.create_map(*[F.lit(x) for key, names in ALIASES.items() for n in names for x in (n, key)])
    return F.try_element_at(table, F.lower(F.trim(name)))


def convert(lon: Column, lat: Column, source: str, target: str) -> Point:
    """Between two systems known when the query is planned; the same system changes nothing."""
    a, b = system_key(source), system_key(target)
    return (lon, lat) if a == b else CONVERSIONS[a, b](lon, lat)


def convert_by_columns(lon: Column, lat: Column, source: Column, target: Column) -> Point:
    """Between systems named in columns; null where a name is unknown."""
    a, b = system_key_column(source), system_key_column(target)
    out = [F.when(a == b, lon), F.when(a == b, lat)]
    for (s, t), f in CONVERSIONS.items():
        point = f(lon, lat)
        out = [o.when((a == s) & (b == t), p) for o, p in zip(out, point, strict=True)]
    return out[0], out[1]


def parse_point(token: Column, lat_first: bool = False) -> Point:
    """Two numbers parted by commas (ASCII or full width) or white space; null if there aren't exactly two."""
    parts = F.split(F.trim(F.regexp_replace(token, r"[,，\s]+", " ")), " ")
    a, b = (F.when(F.size(parts) == 2, F.get(parts, F.lit(i)).try_cast("double")) for i in (0, 1))
    good = a.isNotNull() & b.isNotNull()
    a, b = F.when(good, a), F.when(good, b)
    return (b, a) if lat_first else (a, b)
