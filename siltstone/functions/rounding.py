"""Numbers as text and rounding that follow Python's rules where Spark's differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .markdown import once


def half_even(value: Column, digits: int) -> Column:
    """A double rounded to decimal places as Python's round does it: by its exact value, ties to even.

    2.675 is a little less than that in binary, so it becomes 2.67. The product
    with the power of ten is split into a double and the rest that it leaves out
    (Dekker's product), and that rest decides where the double alone is a tie.
    Exact as long as the product is below 2 ** 52; numbers beyond, infinities and
    NaN stay as they are. ``digits`` is 0 to 22.
    """
    scale = 10.0**digits
    high = 134217729.0 * scale - (134217729.0 * scale - scale)
    low = scale - high

    def rounded(x: Column) -> Column:
        product = x * scale
        c = x * 134217729.0
        x_high = c - (c - x)
        x_low = x - x_high
        rest = ((x_high * high - product) + x_high * low + x_low * high) + x_low * low
        whole = F.rint(product)
        part = product - whole
        up = F.when((part == 0.5) & (rest > 0), 1.0).when((part == -0.5) & (rest < 0), -1.0).otherwise(0.0)
        return F.when(F.abs(product) < 2.0**52, F.when(up == 0, whole).otherwise(whole + up) / scale).otherwise(x)

    return once(value.cast("double"), rounded)


def general(value: Column) -> Column:
    """A double as ``%g`` gives it: six significant digits, no trailing zeros, an exponent outside 1e-5 to 1e6.

    Formatting costs most here: whole numbers of up to six digits need none, others
    are formatted once to learn the exponent and once with as many places as it asks for.
    """

    def formatted(sci: Column) -> Column:
        def placed(exponent: Column) -> Column:
            plain = F.lit(None).cast("string")
            for e in range(-4, 6):
                plain = F.when(exponent == e, F.format_string(f"%.{5 - e}f", value)).otherwise(plain)
            mantissa = F.regexp_replace(F.regexp_extract(sci, r"^(.*)e", 1), r"\.?0+$", "")
            trimmed = once(plain, lambda p: F.when(p.contains("."), F.regexp_replace(p, r"\.?0+$", "")).otherwise(p))
            return F.when(exponent.between(-4, 5), trimmed).otherwise(F.concat(mantissa, F.regexp_extract(sci, r"(e[-+]\d+)$", 1)))

        return once(F.regexp_extract(sci, r"e([-+]\d+)$", 1).cast("int"), placed)

    whole = (F.rint(value) == value) & (F.abs(value) < 1e6)
    finite = F.when(F.abs(value) < float("inf"), once(F.format_string("%.5e", value), formatted)).when(F.isnan(value), "nan").otherwise(F.when(value > 0, "inf").otherwise("-inf"))
    return F.when(whole, value.cast("bigint").cast("string")).when(value.isNotNull(), finite)


def file_size(n: Column) -> Column:
    """Bytes for people: B, KB and MB without decimals, GB with one (SNK-40)."""
    return (
        F.when(n < 1024, F.concat(F.format_string("%.0f", n.cast("double")), F.lit(" B")))
        .when(n < 1024**2, F.concat(F.format_string("%.0f", F.bround(n / 1024, 0)), F.lit(" KB")))
        .when(n < 1024**3, F.concat(F.format_string("%.0f", F.bround(n / 1024**2, 0)), F.lit(" MB")))
        .otherwise(F.concat(F.format_string("%.1f", n / 1024**3), F.lit(" GB")))
    )
