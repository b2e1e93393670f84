"""Slots of many documents: ids in order, and translated documents; mended packages (WIN-09, JOIN-03, JOIN-06, JOIN-19, SRC-31)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import office


def slot_ids(slots: DataFrame, book: str, document: str, place: str) -> DataFrame:
    """``slot_id`` t000001, t000002 ... within each book, over its documents in order.

    Counts per document give the offsets, so no task has to number a whole book's
    slots on its own.
    """
    counts = slots.groupBy(book, document).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(book).orderBy(document).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(book, document, F.coalesce(before, F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy(book, document).orderBy(place))
    return slots.withColumn("_nth", nth).join(offsets, [book, document]).withColumn("slot_id", F.format_string("t%06d", F.col("_before") + F.col("_nth"))).drop("_before", "_nth")


def translated_documents(documents: DataFrame, slots: DataFrame, key: str = "document") -> DataFrame:
    """Documents (key, xml) with their translated slots (key, path, attribute, tags, translation) put back.

    A document that can't be rebuilt keeps its text and tells the error.
    """
    types = dict(documents.dtypes)

    def rebuild(docs: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        rows = [{**r, "path": list(r["path"]), "tags": list(r["tags"])} for r in own.to_dict("records") if r["translation"] is not None]
        for d in docs.itertuples(index=False):
            try:
                out.append((getattr(d, key), office.apply_slots(d.xml, rows), None))
            except Exception as e:
                out.append((getattr(d, key), d.xml, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=[key, "xml", "error"])

    left, right = documents.select(key, "xml").groupBy(key), slots.select(key, "path", "attribute", "tags", "translation").groupBy(key)
    return left.cogroup(right).applyInPandas(rebuild, f"{key} {types[key]}, xml string, error string")


@F.pandas_udf(T.StructType([T.StructField("content", T.BinaryType()), T.StructField("removed", T.ArrayType(T.StringType()))]))
def sane_package(content: pd.Series) -> pd.DataFrame:
    """An EPUB without manifest items whose files are missing, and their hrefs (see ``office.sane_epub``); null stays null."""
    return pd.DataFrame([(None, None) if c is None else office.sane_epub(bytes(c)) for c in content], columns=["content", "removed"])
