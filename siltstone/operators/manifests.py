"""Image manifests of documents and slides (SNK-29 to SNK-34, SET-06, FLT-33)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names, shapes
from ..sources import html_tree


def image_options(no_images: bool = False, filter_images: bool = False) -> None:
    """Leaving images out and filtering them exclude each other (FLT-33)."""
    if no_images and filter_images:
        raise ValueError("no_images and filter_images exclude each other")


def references(documents: DataFrame, doc: str = "doc", text: str = "text", folder: str = "folder") -> DataFrame:
    """Per document and file of its asset folder the places that refer to it: (doc, name, occurrences).

    A place is its number among the references of the document, and the reference.
    """
    pattern = F.concat(F.regexp_replace(folder, r"([\\.\[\](){}+*?^$|])", r"\\$1"), F.lit(r"/[^)\s>]+"))
    found = documents.select(doc, F.posexplode(F.regexp_extract_all(F.col(text), pattern, F.lit(0))).alias("i", "ref"))
    name = F.regexp_extract(F.url_decode(F.replace("ref", F.lit("+"), F.lit("%2B"))), r"([^/]*)$", 1)
    place = F.struct((F.col("i") + 1).alias("occurrence_index"), F.col("ref").alias("source_ref"))
    return found.groupBy(doc, name.alias("name")).agg(F.sort_array(F.collect_list(place)).alias("occurrences"))


def image_manifest(files: DataFrame, documents: DataFrame, kind: str, doc: str = "doc") -> DataFrame:
    """Manifest rows of the images of each document (SNK-29, SNK-30).

    files (doc, name, width, height); documents (doc, text, folder). Files that
    aren't images are left out; the others are numbered by name. A file that no
    text refers to counts as used once.
    """
    ext = names.normal_suffix(names.suffix(F.col("name")))
    images = files.withColumn("source_ext", ext).where(F.col("source_ext").isin(*names.IMAGE_SUFFIXES))
    images = images.withColumn("index", F.row_number().over(Window.partitionBy(doc).orderBy("name")))
    vector = names.is_office_vector(F.col("source_ext"))
    part = shapes.ratio(F.col("width"), F.col("height"))
    none = F.array().cast("array<struct<occurrence_index:int,source_ref:string>>")
    out = images.join(references(documents, doc), [doc, "name"], "left")
    return out.select(
        doc, "index", F.col("name").alias("filename"), names.base_name(F.col("name")).alias("original_filename"), F.when(vector, "office_vector").otherwise("bitmap").alias("asset_kind"),
        (~vector).alias("svg_renderable"), F.lit(True).alias("pptx_native_supported"), F.lit(kind).alias("source_kind"), "source_ext", F.col("width").alias("pixel_width"),
        F.col("height").alias("pixel_height"), part.alias("pixel_ratio"), part.alias("display_ratio"), F.greatest(F.coalesce(F.size("occurrences"), F.lit(0)), F.lit(1)).alias("usage_count"), F.coalesce("occurrences", none).alias("occurrences"),
    )


def picture_place(slide: Column, name: Column, left: Column, top: Column, width: Column, height: Column) -> Column:
    """Struct of one place of a slide's picture, lengths in EMU and inches (SNK-33)."""
    return F.struct(
        slide.alias("slide_index"), name.alias("shape_name"), left.alias("display_left_emu"), top.alias("display_top_emu"), width.alias("display_width_emu"), height.alias("display_height_emu"),
        shapes.inches(width).alias("display_width_in"), shapes.inches(height).alias("display_height_in"), shapes.ratio(width, height).alias("display_ratio"),
    )


def picture_manifest(pictures: DataFrame, doc: str = "doc") -> DataFrame:
    """One row per document and different picture, with all its places (SNK-32, SNK-34, SNK-35).

    pictures (doc, ord, slide, shape, hash, ext, content_type, pixel_width,
    pixel_height, left, top, width, height). Equal hashes are one asset, numbered
    and named by where it comes first.
    """
    place = picture_place(*[F.col(c) for c in ("slide", "shape", "left", "top", "width", "height")])
    ext = names.normal_suffix(F.col("ext"))
    once = pictures.groupBy(doc, "hash").agg(
        F.min("ord").alias("ord"), F.count("*").alias("usage_count"), F.transform(F.sort_array(F.collect_list(F.struct("ord", place.alias("p")))), lambda x: x["p"]).alias("occurrences"),
        *[F.min_by(c, "ord").alias(n) for c, n in ((ext, "source_ext"), ("content_type", "content_type"), ("pixel_width", "pixel_width"), ("pixel_height", "pixel_height"), ("slide", "_slide"))],
    )
    once = once.withColumn("index", F.row_number().over(Window.partitionBy(doc).orderBy("ord")))
    vector = names.is_office_vector(F.col("source_ext"))
    return once.select(
        doc, "index", F.concat(F.lit("slide_"), F.lpad(F.col("_slide").cast("string"), 3, "0"), F.lit("_image_"), F.lpad(F.col("index").cast("string"), 3, "0"), "source_ext").alias("filename"),
        F.when(vector, "office_vector").otherwise("bitmap").alias("asset_kind"), (~vector).alias("svg_renderable"), F.lit(True).alias("pptx_native_supported"), F.lit("pptx_picture").alias("source_kind"), "source_ext",
        "content_type", "pixel_width", "pixel_height", shapes.ratio(F.col("pixel_width"), F.col("pixel_height")).alias("pixel_ratio"), "usage_count", "occurrences",
    )


def mask_files(items: DataFrame, file: str = "file") -> DataFrame:
    """The different files that masks are needed for, sorted (SET-06)."""
    return items.select(file).where(F.col(file).isNotNull()).distinct().orderBy(file)


def placed_images(pages: DataFrame, files: DataFrame, into: str, web: bool = False, drop: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pages whose images point to a folder of kept files, and the rows of these files (HTM-07, HTM-09, HTM-11).

    pages (page, folder, html), page being unique; files (path) that exist, URLs
    of downloaded ones among them. Of an image in a data URI, or whose path is
    among the files, the source becomes ``into``/name; others stay, or go with
    ``drop``. Rows of files: page, place, name, path, data (of data URIs). A null
    page text stays null; other columns of pages stay.
    """
    place = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in html_tree.PLACE.items()]))

    @F.pandas_udf(place)
    def found(html: pd.Series, folder: pd.Series) -> pd.Series:
        return pd.Series([html_tree.image_places(h or "", f or "", web) for h, f in zip(html, folder, strict=True)], dtype=object)

    @F.pandas_udf(T.StringType())
    def put(html: pd.Series, places: pd.Series, sources: pd.Series) -> pd.Series:
        maps = ({} if p is None else dict(zip(p, s, strict=True)) for p, s in zip(places, sources, strict=True))
        return pd.Series([None if h is None else html_tree.rewritten_images(h, m, web, drop) for h, m in zip(html, maps, strict=True)], dtype=object)

    seen = pages.select("page", F.explode(found("html", "folder")).alias("p")).select("page", "p.*")
    inline = seen.where("kind = 'data' AND data IS NOT NULL")
    kept = inline.unionByName(seen.where("kind <> 'data'").join(files.select("path").distinct(), "path", "left_semi"))
    kept = kept.select("page", "place", "name", "path", "data")
    # A page's own images, in two arrays of equal order.
    own = kept.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("place", F.concat(F.lit(into + "/"), "name").alias("source")))).alias("_kept"))
    out = pages.join(own, "page", "left").withColumn("html", put("html", F.col("_kept.place"), F.col("_kept.source")))
    return out.select(*pages.columns), kept
