"""Conversion profiles and point lists as text (SNK-01, SNK-26 to SNK-28)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .markdown import statistics
from .names import asset_folder, base_name, markdown_path, profile_path, source_type, suffix
from .rounding import half_even

SCHEMA = "markdown-conversion.conversion_profile.v1"


def profile(path: Column, size: Column, text: Column, warnings: Column | None = None) -> Column:
    """Struct of a source, what is written for it, the statistics of its Markdown, and warnings; one row a document."""
    target = markdown_path(path)
    return F.struct(
        F.lit(SCHEMA).alias("schema"),
        F.struct(path.alias("path"), base_name(path).alias("name"), suffix(path).alias("suffix"), source_type(path).alias("type"), size.alias("size_bytes")).alias("source"),
        F.struct(target.alias("markdown"), asset_folder(target).alias("assets"), profile_path(target).alias("profile")).alias("outputs"),
        statistics(text).alias("markdown"),
        (F.array().cast("array<string>") if warnings is None else warnings).alias("warnings"),
    )


def result(path: Column, markdown: Column, converter: Column, kind: Column, assets: Column, manifest: Column, profile_: Column, warnings: Column | None = None) -> Column:
    """Struct of what a conversion has made; empty strings for what there isn't (SNK-28)."""
    def text(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    return F.struct(
        path.alias("input"), markdown.alias("markdown"), text(assets).alias("asset_dir"), text(manifest).alias("image_manifest"), text(profile_).alias("conversion_profile"), text(profile_).alias("source_profile"),
        converter.alias("converter"), kind.alias("conversion_type"), (F.array().cast("array<string>") if warnings is None else warnings).alias("warnings"),
    )


def write_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, nulls included: one table of profiles or manifests instead of a file each (SNK-27, SNK-37)."""
    rows.write.option("ignoreNullFields", "false").json(path)


def point_text(lon: Column, lat: Column, fmt: str = "text", digits: int = 6, lat_first: bool = False) -> Column:
    """A point as ``lon,lat`` (text and csv) or as JSON; null for a missing point."""
    a, b = (half_even(x, digits) for x in ((lat, lon) if lat_first else (lon, lat)))
    if fmt == "json":
        return F.when(lon.isNotNull() & lat.isNotNull(), F.to_json(F.struct(half_even(lon, digits).alias("lon"), half_even(lat, digits).alias("lat"))))
    if fmt not in ("text", "csv"):
        raise ValueError(f"no format {fmt!r}")
    return F.when(a.isNotNull() & b.isNotNull(), F.format_string(f"%.{digits}f,%.{digits}f", a, b))
