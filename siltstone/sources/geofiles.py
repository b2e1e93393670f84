"""Coordinate files rewritten whole: CSV, TSV, GeoJSON, GPX and KML (SRC-02 to SRC-10, FLT-02, FLT-03).

A file is one row, because what surrounds the coordinates must stay as it is; a
point that can't be converted stays too and is counted as an error (D6 mended).
"""

from __future__ import annotations

import csv
import io
import json
import re
import math
import xml.etree.ElementTree as ET
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import geo

Transform = Callable[[float, float], tuple[float, float]]
#: Names of coordinate columns.
LON_NAMES = ("lon", "lng", "long", "longitude", "经度", "x")
LAT_NAMES = ("lat", "latitude", "纬度", "y")


def _metres(form: tuple, x: float, y: float) -> float:
    (c0, cx, cy, c2, cxy, croot), squared, waves = form
    at = {"x": x, "y": y}
    out = c0 + cx * x + cy * y + c2 * at[squared] ** 2 + cxy * x * y + croot * math.sqrt(abs(x))
    return out + sum(a * 2 / 3 * math.sin(at[axis] * f * math.pi) for axis, a, f in waves)


def _shift(lon: float, lat: float) -> tuple[float, float]:
    if not (geo.BOX["lon"][0] <= lon <= geo.BOX["lon"][1] and geo.BOX["lat"][0] <= lat <= geo.BOX["lat"][1]):
        return 0.0, 0.0
    w2 = 1 - geo.ECCENTRICITY2 * math.sin(math.radians(lat)) ** 2
    east = _metres(geo.EAST, lon - 105, lat - 35) / (geo.SEMI_MAJOR / math.sqrt(w2) * math.cos(math.radians(lat)))
    north = _metres(geo.NORTH, lon - 105, lat - 35) / (geo.SEMI_MAJOR * (1 - geo.ECCENTRICITY2) / w2**1.5)
    return math.degrees(east), math.degrees(north)


def _to_bd(lon: float, lat: float) -> tuple[float, float]:
    r, a = math.hypot(lon, lat) + geo.BD_RADIUS * math.sin(lat * geo.BD_ANGLE), math.atan2(lat, lon) + geo.BD_TURN * math.cos(lon * geo.BD_ANGLE)
    return r * math.cos(a) + geo.BD_LON, r * math.sin(a) + geo.BD_LAT


def _from_bd(lon: float, lat: float) -> tuple[float, float]:
    x, y = lon - geo.BD_LON, lat - geo.BD_LAT
    r, a = math.hypot(x, y) - geo.BD_RADIUS * math.sin(y * geo.BD_ANGLE), math.atan2(y, x) - geo.BD_TURN * math.cos(x * geo.BD_ANGLE)
    return r * math.cos(a), r * math.sin(a)


def transform(source: str, target: str, digits: int = 6) -> Transform:
    """Plain-Python conversion of one point by way of GCJ02, rounded."""
    a, b = geo.system_key(source), geo.system_key(target)

    def run(lon: float, lat: float) -> tuple[float, float]:
        if a == b:
            return lon, lat
        if a == "wgs84":
            e, n = _shift(lon, lat)
            lon, lat = lon + e, lat + n
        elif a == "bd09":
            lon, lat = _from_bd(lon, lat)
        if b == "wgs84":
            e, n = _shift(lon, lat)
            lon, lat = lon - e, lat - n
        elif b == "bd09":
            lon, lat = _to_bd(lon, lat)
        return round(lon, digits), round(lat, digits)

    return run


def column_index(spec: str | None, header: list[str], names: tuple[str, ...]) -> int:
    """A column by number, by name, or by the usual names; ValueError without one."""
    if spec is not None and spec.strip().isdigit():
        return int(spec)
    low = [h.strip().lower() for h in header]
    wanted = (spec.strip().lower(),) if spec is not None else names
    for n in wanted:
        if n in low:
            return low.index(n)
    raise ValueError(f"no column of {wanted} in {header}")


class Counter:
    def __init__(self, f: Transform) -> None:
        self.f, self.points, self.errors = f, 0, 0

    def __call__(self, lon: str | float, lat: str | float) -> tuple[float, float] | None:
        try:
            out = self.f(float(lon), float(lat))
        except (TypeError, ValueError):
            self.errors += 1
            return None
        self.points += 1
        return out


def rewrite_table(text: str, f: Counter, delimiter: str, lon: str | None = None, lat: str | None = None) -> str:
    rows = list(csv.reader(io.StringIO(text), delimiter=delimiter))
    if not rows:
        return text
    i, j = column_index(lon, rows[0], LON_NAMES), column_index(lat, rows[0], LAT_NAMES)
    for row in rows[1:]:
        if len(row) > max(i, j) and row[i].strip() and (p := f(row[i], row[j])):
            row[i], row[j] = str(p[0]), str(p[1])
    out = io.StringIO()
    csv.writer(out, delimiter=delimiter, lineterminator="\n").writerows(rows)
    return out.getvalue()


def rewrite_geojson(text: str, f: Counter) -> str:
    def positions(node: object) -> object:
        if isinstance(node, list) and len(node) >= 2 and all(isinstance(x, int | float) and not isinstance(x, bool) for x in node[:2]):
            p = f(node[0], node[1])
            return [*p, *node[2:]] if p else node
        return [positions(x) for x in node] if isinstance(node, list) else node

    def visit(node: object) -> object:
        if isinstance(node, dict):
            return {k: positions(v) if k == "coordinates" else visit(v) for k, v in node.items()}
        return [visit(x) for x in node] if isinstance(node, list) else node

    return json.dumps(visit(json.loads(text)), ensure_ascii=False)


def _keep_prefixes(text: str) -> None:
    for _, (prefix, uri) in ET.iterparse(io.StringIO(text), events=("start-ns",)):
        if not prefix.startswith("ns"):
            ET.register_namespace(prefix, uri)


def _xml(root: ET.Element) -> str:
    return '<?xml version="1.0" encoding="UTF-8"?>\n' + ET.tostring(root, encoding="unicode")


def rewrite_gpx(text: str, f: Counter) -> str:
    _keep_prefixes(text)
    root = ET.fromstring(text)
    for e in root.iter():
        if "lat" in e.attrib and "lon" in e.attrib and (p := f(e.attrib["lon"], e.attrib["lat"])):
            e.attrib["lon"], e.attrib["lat"] = str(p[0]), str(p[1])
    return _xml(root)


def rewrite_kml(text: str, f: Counter) -> str:
    def moved(t: str) -> str:
        parts = t.split(",")
        p = f(parts[0], parts[1]) if len(parts) >= 2 else None
        return ",".join([str(p[0]), str(p[1]), *parts[2:]]) if p else t

    _keep_prefixes(text)
    root = ET.fromstring(text)
    for e in root.iter():
        if e.tag.rpartition("}")[2] == "coordinates" and e.text:
            e.text = re.sub(r"\S+", lambda m: moved(m[0]), e.text)  # line breaks between tuples stay
    return _xml(root)


def rewrite(text: str, fmt: str, source: str, target: str, digits: int = 6, lon: str | None = None, lat: str | None = None) -> tuple[str, int, int]:
    """The file's text with its points converted, how many were, and how many couldn't be."""
    f = Counter(transform(source, target, digits))
    if fmt in ("csv", "tsv"):
        out = rewrite_table(text, f, "," if fmt == "csv" else "\t", lon, lat)
    else:
        out = {"geojson": rewrite_geojson, "gpx": rewrite_gpx, "kml": rewrite_kml}[fmt](text, f)
    return out, f.points, f.errors


def rewritten(text: Column, fmt: Column, source: str, target: str, digits: int = 6) -> Column:
    """Struct text, points, errors, error for a column of whole files; a broken file keeps its text."""

    @F.pandas_udf("text string, points long, errors long, error string")
    def run(t: pd.Series, k: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(t, k, strict=True):
            try:
                out.append((*rewrite(x, y, source, target, digits), None))
            except Exception as e:
                out.append((x, 0, 0, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["text", "points", "errors", "error"])

    return run(text, fmt)


_NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"


def geojson_points(text: Column) -> Column:
    """Longitudes and latitudes of all positions of a GeoJSON text, in order, without Python.

    Geometries of any kind and depth count, in features, collections or by
    themselves: what ``coordinates`` holds is brackets, numbers and commas, and a
    position is a bracket with two numbers behind it.
    """
    trees = F.regexp_extract_all(text, F.lit(r'"coordinates"\s*:\s*(\[[-+\[\]\d\s,.eE]*\])'), 1)
    found = F.flatten(F.transform(trees, lambda t: F.regexp_extract_all(t, F.lit(rf"\[\s*({_NUMBER}\s*,\s*{_NUMBER})"), 1)))
    return F.transform(found, lambda p: F.struct(*[F.trim(F.get(F.split(p, r"\s*,\s*"), F.lit(i))).try_cast("double").alias(n) for i, n in enumerate(("lon", "lat"))]))


def gpx_points(text: Column) -> Column:
    """The same for any elements of a GPX text with both attributes."""
    lon, lat = (F.xpath(text, F.lit(f"//*[@lat and @lon]/@{a}")) for a in ("lon", "lat"))
    return F.zip_with(lon, lat, lambda x, y: F.struct(x.try_cast("double").alias("lon"), y.try_cast("double").alias("lat")))


def kml_points(text: Column) -> Column:
    """The same for the coordinate tuples of a KML text."""
    tuples = F.filter(F.split(F.array_join(F.xpath(text, F.lit('//*[local-name()="coordinates"]/text()')), " "), r"\s+"), lambda t: t != "")
    return F.transform(tuples, lambda t: F.struct(F.get(F.split(t, ","), F.lit(0)).try_cast("double").alias("lon"), F.get(F.split(t, ","), F.lit(1)).try_cast("double").alias("lat")))
