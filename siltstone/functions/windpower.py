"""Wind-turbine power curves: parsing, power coefficients and plausibility (SRC-12/13, MTH-11, FLT-04 to FLT-07)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The limit of a power coefficient, and the ranges that parameters are expected in.
BETZ = 0.593
DENSITY, DIAMETER = (0.5, 1.5), (30.0, 350.0)
HINT_RATIO, HINT_METRES = 0.10, 10.0
NUMBER = r"[-+]?(?:\d[\d,]*(?:\.\d+)?|\.\d+)(?:[eE][-+]?\d+)?"
MODEL = r"\b[A-Za-z]+\d{3,6}[-_](\d{2,3})\b"


def theoretical_kw(wind: Column, rho: float | Column, diameter: float | Column) -> Column:
    """Power of the wind through the rotor, in kW."""
    area = math.pi * diameter * diameter / 4 if isinstance(diameter, float) else F.pi() * diameter * diameter / 4
    return 0.5 * rho * wind * wind * wind * area / 1000


def cp(wind: Column, power: Column, rho: float | Column, diameter: float | Column) -> Column:
    """Power coefficient; null where the wind isn't positive."""
    return F.when(wind > 0, power / theoretical_kw(wind, rho, diameter))


def number(raw: Column) -> Column:
    """A number whose thousands may be parted by commas."""
    return F.replace(raw, F.lit(",")).try_cast("double")


def curve_line(line: Column) -> Column:
    """Struct wind, power, ct of a line that begins with a number; null for other lines.

    A comma parts columns unless it stands among digits like one of thousands
    while the line also has white space between numbers.
    """
    text = F.trim(line)
    spaced = F.regexp_count(text, F.lit(r"\d[ \t;|]+[-+.\d]")) > 0
    ready = F.when(spaced, text).otherwise(F.replace(text, F.lit(","), F.lit(" ")))
    found = F.regexp_extract_all(ready, F.lit(NUMBER), 0)
    good = text.rlike(r"^[-+]?\.?\d") & (F.size(found) >= 2)
    return F.when(good, F.struct(number(F.get(found, F.lit(0))).alias("wind"), number(F.get(found, F.lit(1))).alias("power"), number(F.get(found, F.lit(2))).alias("ct")))


def model_diameter(text: Column) -> Column:
    """Rotor diameter that a model name tells, looked for first in lines that speak of a model."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: x.contains("机型") | F.lower(x).contains("model"))
    hints = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, MODEL, 1)), lambda x: x != "")
    anywhere = F.regexp_extract(text, MODEL, 1)
    return F.coalesce(F.get(hints, F.lit(0)), F.nullif(anywhere, F.lit(""))).cast("double")


def parameter_error(rho: Column, diameter: Column, hint: Column) -> Column:
    """A code for the first implausible parameter, or null."""
    off = F.abs(diameter - hint) > F.greatest(F.lit(HINT_METRES), hint * HINT_RATIO)
    return F.when(~rho.between(*DENSITY), "density").when(~diameter.between(*DIAMETER), "diameter").when(off, "model")
