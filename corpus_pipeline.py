"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet to the shared folder and gives what it reads back to the next one. All
stages but the last return the columns of documents, with ``n_chars`` following
the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.decontaminate import find_contamination
from siltstone.llm.line_quality import WORD, clean_documents
from siltstone.llm.order_minhash import near_duplicates
from siltstone.llm.packing import pack_documents
from siltstone.llm.queries import table, tokenizer
from siltstone.llm.store import written
from siltstone.llm.substring import remove_repeats


def _shaped(rows: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``; texts without words go, and n_chars is that of the text."""
    rows = rows.where(F.col("text").rlike(WORD))
    if "n_chars" in like.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return rows.select(*like.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; lines that too many documents of a source share are cut from the others."""
    return clean_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays; rows without an id stay.

    Where an id occurs more than once, a row is a document of its own: of rows
    with the same id the first in the table as it was read stands for its class,
    and rows of one id whose texts aren't near-duplicates all stay.
    """
    if not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count():
        classes = written(near_duplicates(docs).select("doc_id", "class_id"), "near-classes")
        return docs.join(classes.where("doc_id <> class_id").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    row = "_row" + "_" * max(map(len, docs.columns))  # no column is named so
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-rows")
    known = rows.where("doc_id IS NOT NULL")
    classes = near_duplicates(known.select(row, "text"), doc_id=row).select(F.col("doc_id").alias(row), "class_id")
    classes = written(known.select(row, "doc_id").join(classes, row), "near-classes")
    first = classes.groupBy("class_id").agg(F.min(F.struct("doc_id", row)).alias("first")).select(F.col(f"first.{row}").alias(row))
    gone = classes.select(row).join(first, row, "left_anti")
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that a document with a smaller id has are cut; documents without words left go."""
    return _shaped(remove_repeats(docs, rejoin=False), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark phrases are cut; documents without words left go."""
    return _shaped(find_contamination(docs, table(spark, sf_dir, "benchmark"), cut=True), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    return pack_documents(docs, tokenizer("byte_bpe_50k.json"), "spaced", end=0, size=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("substring deduplication", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: SQL can't express tokenizing and packing; the tests compare with a version in plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
