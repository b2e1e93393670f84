"""Files as DataFrames: one task reads whole files through Spark's own listing, then a parser makes rows of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import markdown, names
from ..operators import text_units
from . import office

CELLS = "path string, sheet string, state string, row int, col int, value string, kind string"
MERGES = "path string, sheet string, row0 int, col0 int, row1 int, col1 int"
SHAPES = "path string, slide int, ord int, kind string, top long, left long, text string"
SLOTS = "path string, slot_id string, document string, place array<int>, attribute string, source string, tags array<string>"


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, content and length of the files of a folder, one level deep."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content", "length")


def parsed(rows: DataFrame, parser: Callable[[bytes], Iterator[dict]], schema: str, errors: bool = False) -> DataFrame:
    """Rows that a parser makes of each file's content.

    A file that can't be read gives none; with ``errors`` it gives one row with
    its path and the reason in a column ``error``, which is null in all others.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    if errors:
        names, schema = [*names, "error"], f"{schema}, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    out = [{**r, "path": path} for r in parser(bytes(content))]
                except Exception as e:
                    if not errors:
                        continue
                    out = [{"path": path, "error": f"{type(e).__name__}: {e}"}]
                yield pd.DataFrame(out, columns=names).astype(object)

    return rows.select("path", "content").mapInPandas(run, schema)


def xlsx_cells(spark: SparkSession, path: str, errors: bool = False) -> DataFrame:
    return parsed(files(spark, path, "*.xls[xm]"), office.xlsx_cells, CELLS, errors)


def xlsx_merges(spark: SparkSession, path: str, errors: bool = False) -> DataFrame:
    return parsed(files(spark, path, "*.xls[xm]"), office.xlsx_merges, MERGES, errors)


def pptx_shapes(spark: SparkSession, path: str, errors: bool = False) -> DataFrame:
    return parsed(files(spark, path, "*.p[po][tst][xm]"), office.pptx_shapes, SHAPES, errors)


def epub_slots(spark: SparkSession, path: str, errors: bool = False) -> DataFrame:
    def rows(content: bytes) -> Iterator[dict]:
        for s in office.epub_slots(content):
            yield {**{k: v for k, v in s.items() if k != "path"}, "place": s["path"]}

    return parsed(files(spark, path, "*.epub"), rows, SLOTS, errors)


CONVERTERS: dict[str, Callable[[bytes], str]] = {
    ".docx": office.docx_to_markdown,
    ".epub": office.epub_to_markdown,
    ".ipynb": lambda b: office.ipynb_to_markdown(b.decode("utf-8-sig")),
    ".html": lambda b: office.html_tree.to_markdown(b.decode("utf-8", "replace")),
    ".htm": lambda b: office.html_tree.to_markdown(b.decode("utf-8", "replace")),
    ".md": lambda b: b.decode("utf-8-sig"),
    ".markdown": lambda b: b.decode("utf-8-sig"),
    ".txt": lambda b: b.decode("utf-8-sig"),
    ".text": lambda b: b.decode("utf-8-sig"),
}


#: Converters that need the file's name, too.
NAMED = {f".{x}": office.pptx_to_markdown for x in ("pptx", "pptm", "ppsx", "ppsm", "potx", "potm")}


@F.pandas_udf(T.StructType([T.StructField("markdown", T.StringType()), T.StructField("error", T.StringType())]))
def to_markdown(path: pd.Series, content: pd.Series) -> pd.DataFrame:
    out = []
    for p, c in zip(path, content, strict=True):
        suffix = "." + p.rpartition(".")[2].lower()
        try:
            out.append((NAMED[suffix](bytes(c), p.rpartition("/")[2]) if suffix in NAMED else CONVERTERS[suffix](bytes(c)), None))
        except KeyError:
            out.append((None, f"no reader for {suffix}"))
        except Exception as e:
            out.append((None, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(out, columns=["markdown", "error"])


def documents(spark: SparkSession, path: str) -> DataFrame:
    """path, markdown and error of a folder's documents; formats without a reader here give an error row."""
    return files(spark, path).withColumn("m", to_markdown("path", "content")).select("path", "m.markdown", "m.error")


def subtitles(spark: SparkSession, path: str, raw: bool = False, chapters: bool = False) -> DataFrame:
    """Subtitle files of a folder as Markdown: path and markdown (SRC-51, SNK-20).

    Flat: one text per file, titled by its stem. With ``chapters``, the folder's
    folders are chapters: one text per folder, its files as sections in natural
    order. Files and folders without captions give none.
    """
    found = files(spark, f"{path}/*" if chapters else path).where(names.source_type(F.col("path")) == "subtitle")
    text, kind = decoded("content"), names.suffix(F.col("path"))
    rows = found.select("path", text.alias("text"), kind.alias("kind"))
    cues = F.when(F.col("kind") == ".srt", text_units.srt_cues(F.col("text"))).when(F.col("kind") == ".vtt", text_units.vtt_cues(F.col("text"))).otherwise(text_units.ass_cues(F.col("text")))
    rows = rows.select("path", names.stem(F.col("path")).alias("stem"), text_units.transcript(cues, raw).alias("body")).where("body <> ''")
    if not chapters:
        return rows.select("path", markdown.titled(F.col("stem"), F.col("body")).alias("markdown"))
    rows = rows.withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    part = F.struct(names.natural_key(names.base_name(F.col("path"))).alias("k"), F.concat(F.lit("## "), "stem", F.lit("\n\n"), "body", F.lit("\n\n")).alias("t"))
    joined = rows.groupBy("folder").agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["t"]), "").alias("t"))
    return joined.select(F.col("folder").alias("path"), F.concat(F.lit("# "), names.base_name(F.col("folder")), F.lit("\n\n"), "t").alias("markdown"))


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def image_size(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([office.image_size(bytes(c)) or (None, None) if c is not None else (None, None) for c in content], columns=["width", "height"]).astype("Int32")


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    return content.map(lambda c: None if c is None else office.decode_subtitle(bytes(c)))


@F.pandas_udf(T.StringType())
def omml_to_latex(xml: pd.Series) -> pd.Series:
    return xml.map(lambda x: None if x is None else office.omml_to_latex(x))


def translations(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSON translations: file, line (as read), id, translation, and an error for what isn't one (SRC-43)."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.input_file_name().alias("file"), F.col("value").alias("line"))
    parsed_ = F.from_json("line", "id string, source string, translation string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    error = F.when(F.col("r._corrupt").isNotNull(), "not JSON").when(F.col("r.id").isNull(), "no id").when(F.col("r.translation").isNull(), "no translation")
    return lines.withColumn("r", parsed_).select("file", "line", "r.id", "r.translation", error.alias("error"))


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """JSON files whole: path, config (null unless the root is an object) and error (SRC-44 to SRC-46)."""
    text = files(spark, path).select("path", F.decode("content", "utf-8").alias("text"))
    v = F.try_parse_json("text")
    whole = text.withColumns({"_v": v, "_kind": F.schema_of_variant(v)})
    good = F.col("_kind").startswith("OBJECT")
    return whole.select("path", F.when(good, F.col("text")).alias("config"), F.when(F.col("_v").isNull(), "not JSON").when(~good, "not an object").alias("error"))
