"""Rectangles, images, colours and lengths (MTH-12 to 18, FLT-09 to 15, FLT-20/21, FLT-28 to 32, AGG-09)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import half_even

#: What makes an image worth keeping.
MIN_SIDE, MIN_AREA, MIN_BYTES, MIN_PAGE_SHARE, MAX_ASPECT, LOW_BYTES, LOW_AREA = 100, 30000, 2048, 0.05, 12, 0.08, 500000
#: Units of length in English Metric Units, and colours by name.
EMU = {"in": 914400.0, "cm": 360000.0, "mm": 36000.0, "pt": 12700.0, "px": 9525.0}
COLOURS = {"white": (255, 255, 255), "black": (0, 0, 0)}
RECT = ("x0", "y0", "x1", "y1")


def rect(*sides: Column) -> Column:
    return F.struct(*[s.cast("double").alias(n) for s, n in zip(sides, RECT, strict=True)])


def area(r: Column) -> Column:
    return F.greatest(r["x1"] - r["x0"], F.lit(0.0)) * F.greatest(r["y1"] - r["y0"], F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    return rect(F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]))


def overlap(a: Column, b: Column) -> Column:
    """The share of a that b covers; 0 for an empty a (MTH-13)."""
    return F.when(area(a) > 0, area(intersection(a, b)) / area(a)).otherwise(0.0)


def clip(a: Column, page: Column) -> Column:
    return intersection(a, page)


def widen(a: Column, by: float | Column, page: Column) -> Column:
    return clip(rect(a["x0"] - by, a["y0"] - by, a["x1"] + by, a["y1"] + by), page)


def contained(inner: Column, outer: Column, share: float = 0.9) -> Column:
    return overlap(inner, outer) >= share


def early_image_checks(width: Column, height: Column, size: Column) -> Column:
    """What is asked before copies are looked for."""
    return (F.least(width, height) >= MIN_SIDE) & (width * height >= MIN_AREA) & (size >= MIN_BYTES)


def late_image_checks(width: Column, height: Column, size: Column, page: tuple[Column, Column] | None = None, drawn: tuple[Column, Column] | None = None) -> Column:
    """What is asked after copies are gone: share of the page, aspect, and bytes per pixel."""
    ok = (F.greatest(width, height) / F.greatest(F.least(width, height), F.lit(1)) <= MAX_ASPECT) & ~((size / (width * height) < LOW_BYTES) & (width * height < LOW_AREA))
    if page and drawn:
        small = (page[0] > 0) & (page[1] > 0) & (F.try_divide(drawn[0], page[0]) < MIN_PAGE_SHARE) & (F.try_divide(drawn[1], page[1]) < MIN_PAGE_SHARE)
        ok = ok & ~F.coalesce(small, F.lit(False))
    return ok


def is_red(r: Column, g: Column, b: Column) -> Column:
    """Whether a pixel belongs to a red mark (FLT-28)."""
    return (r >= 120) & (g <= 120) & (b <= 120) & (r - F.greatest(g, b) >= 40)


def is_white(colour: Column) -> Column:
    """Whether the first three parts of a colour are all nearly 1; null isn't white (FLT-20)."""
    return F.coalesce(F.forall(F.slice(colour, 1, 3), lambda c: c >= 0.98), F.lit(False))


def is_background(fill: Column, stroke: Column) -> Column:
    return is_white(fill) & stroke.isNull()


def parse_colour(value: Column) -> Column:
    """Array of red, green, blue for ``#rrggbb`` or a known name; null otherwise (MTH-18)."""
    s = F.lower(F.trim(value))
    hexes = F.array(*[F.conv(F.substring(s, 2 + 2 * i, 2), 16, 10).cast("int") for i in range(3)])
    out = F.when(s.rlike("^#[0-9a-f]{6}$"), hexes)
    for name, rgb in COLOURS.items():
        out = out.when(s == name, F.array(*[F.lit(c) for c in rgb]))
    return out


def length_emu(css: Column) -> Column:
    """A CSS length in EMU, rounded; null if it can't be read (MTH-12)."""
    form = r"^\s*([0-9]+(?:\.[0-9]+)?|\.[0-9]+)\s*(in|cm|mm|pt|px)\s*$"
    value = F.nullif(F.regexp_extract(F.lower(css), form, 1), F.lit("")).cast("double")
    unit = F.try_element_at(F.create_map(*[F.lit(x) for kv in EMU.items() for x in kv]), F.regexp_extract(F.lower(css), form, 2))
    return F.bround(value * unit, 0).cast("long")


def vml_size(style: Column) -> Column:
    """Struct width, height in EMU from a style attribute (MTH-14)."""
    pairs = F.transform(F.split(style, ";"), lambda p: F.struct(F.lower(F.trim(F.substring_index(p, ":", 1))).alias("k"), F.trim(F.regexp_extract(p, ":(.*)$", 1)).alias("v")))

    def of(name: str) -> Column:
        return length_emu(F.get(F.transform(F.filter(pairs, lambda p: p["k"] == name), lambda p: p["v"]), F.lit(0)))

    return F.struct(of("width").alias("width"), of("height").alias("height"))


def clamp_box(box: Column, width: Column, height: Column, padding: Column) -> Column:
    """A pixel box widened by a padding and kept inside the image (FLT-29)."""
    zero = F.lit(0)
    return F.array(
        F.greatest(zero, F.get(box, F.lit(0)) - padding), F.greatest(zero, F.get(box, F.lit(1)) - padding),
        F.least(width, F.get(box, F.lit(2)) + padding), F.least(height, F.get(box, F.lit(3)) + padding),
    )


#: The least width, height and area of a drawing worth keeping, in points.
VECTOR_SIDES, VECTOR_AREA = (72, 36), 3000


def keep_vector(r: Column, page: Column, tables: Column, images: Column, filtered: bool = False) -> Column:
    """Whether a drawing's rectangle is large enough and over no table or image of two arrays (FLT-15)."""
    w, h = r["x1"] - r["x0"], r["y1"] - r["y0"]
    ok = (w >= VECTOR_SIDES[0]) & (h >= VECTOR_SIDES[1]) & (w * h >= VECTOR_AREA)
    for covers in (tables, images):
        ok = ok & ~F.exists(covers, lambda c: overlap(r, c) > 0.6)
    if filtered:
        pw, ph = (F.greatest(page[b] - page[a], F.lit(1.0)) for a, b in (("x0", "x1"), ("y0", "y1")))
        ok = ok & ~((w / pw < 0.08) & (h / ph < 0.08))
    return ok


def text_dominant(lines: Column, r: Column, page: Column) -> Column:
    """Whether a wide and high rectangle with six text lines or more is only lines behind text (FLT-16)."""
    w, h = ((r[b] - r[a]) / F.greatest(page[b] - page[a], F.lit(1.0)) for a, b in (("x0", "x1"), ("y0", "y1")))
    return (lines >= 6) & (w > 0.55) & (h > 0.12)


def image_kept(width: Column, height: Column, size: Column, drawn: Column, page: Column) -> Column:
    """Both checks of a page's image by its pixels, bytes and the rectangle it is drawn in (FLT-12); copies are left to the caller."""
    sides = lambda r: (r["x1"] - r["x0"], r["y1"] - r["y0"])
    return early_image_checks(width, height, size) & late_image_checks(width, height, size, sides(page), sides(drawn))


def picture_kept(width: Column, height: Column, size: Column, drawn: tuple[Column, Column], slide: tuple[Column, Column]) -> Column:
    """The same for a slide's picture, by its bytes alone where its pixels can't be read (FLT-13)."""
    known = early_image_checks(width, height, size) & late_image_checks(width, height, size, slide, drawn)
    return F.when(width.isNull() | height.isNull(), size >= MIN_BYTES).otherwise(known)


def ratio(width: Column, height: Column) -> Column:
    """Width by height with six digits; null unless both are positive (MTH-15)."""
    return F.when((width > 0) & (height > 0), half_even(width / height, 6))


def inches(emu: Column) -> Column:
    return F.when(emu != 0, half_even(emu / EMU["in"], 4))


def safe_position(value: Column) -> Column:
    """A whole number, 0 for what isn't one (MTH-17)."""
    return F.coalesce(value.cast("string").try_cast("bigint"), F.lit(0).cast("bigint"))
