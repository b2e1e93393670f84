"""Quality rules: lines that many documents of a host share, and depleted documents.

Only built-in functions run here. Everything within a text (words, repeated
three-word windows, lines) is computed inside its row with array functions that
sort or hash, so no text is shuffled; between documents only line hashes travel.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import scratch, written

SEPARATORS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: A line that more than this many different documents of a host hold is boilerplate, however large the host.
MAX_DOCS_PER_LINE = 5
#: A document that keeps less than this share of its words is rejected.
MIN_KEPT_SHARE = 0.5

_INDEX_BITS = 24


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _same(a: Column, b: Column) -> Column:
    return F.shiftrightunsigned(a, _INDEX_BITS) == F.shiftrightunsigned(b, _INDEX_BITS)


def repeated_window_words(words: Column) -> Column:
    """Words in three-word windows that are found twice or more in the array, first ones included.

    Windows become 64-bit hashes. Longs that hold 40 bits of a hash above the
    position are sorted, so equal windows are neighbours; neighbours are then
    compared by the whole hash. An array of 2**24 words or more is sorted as
    structs instead. Linear memory, n log n time.
    """
    mask = (1 << _INDEX_BITS) - 1

    def packed(h: Column) -> Column:
        keys = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("bigint"))))

        def at(x: Column) -> Column:
            return x.bitwiseAND(F.lit(mask)).cast("int")

        def equal(h: Column, x: Column, y: Column) -> Column:
            return F.when(_same(x, y), F.get(h, at(x)) == F.get(h, at(y))).otherwise(False)

        return bound(
            keys,
            lambda s: F.transform(
                F.filter(s, lambda x, i: equal(h, x, F.get(s, i + 1)) | ((i > 0) & equal(h, x, F.get(s, F.greatest(i - 1, F.lit(0)))))),
                at,
            ),
        )

    def structs(h: Column) -> Column:
        keys = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return bound(
            keys,
            lambda s: F.transform(
                F.filter(
                    s,
                    lambda x, i: F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))
                    | F.coalesce((i > 0) & (x["h"] == F.get(s, F.greatest(i - 1, F.lit(0)))["h"]), F.lit(False)),
                ),
                lambda x: x["i"],
            ),
        )

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def count(w: Column) -> Column:
        hashes = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        found = bound(hashes, lambda h: F.when(F.size(h) < (1 << _INDEX_BITS), packed(h)).otherwise(structs(h)))
        return bound(F.sort_array(found), covered)

    return F.coalesce(count(words), F.lit(0).cast("bigint"))


def text_measures(text: Column) -> Column:
    """A struct of the base measures of one text and of its lines that have a word.

    ``lines``: of each such line a 64-bit hash of its words, lower-cased and
    joined by one space, and the number of its words.
    """
    t = F.coalesce(text, F.lit(""))

    def measures(lines: Column) -> Column:
        return F.struct(
            F.size(lines).alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
            F.transform(lines, line_hash).alias("lines"),
        )

    return bound(
        F.regexp_extract_all(t, F.lit(WORD), 0),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.translate(t, SEPARATORS, "")).cast("bigint").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
            repeated_window_words(w).alias("n_repeat_words"),
            measures(F.filter(F.split(t, "\n", -1), lambda line: line.rlike(WORD))).alias("by_line"),
        ),
    )


def line_hash(line: Column) -> Column:
    """A struct of the hash of a line's normal form and of its number of words."""
    return bound(
        F.regexp_extract_all(line, F.lit(WORD), 0),
        lambda w: F.struct(F.xxhash64(F.lower(F.array_join(w, " "))).alias("hash"), F.size(w).alias("words")),
    )


def _host(host: Column) -> Column:
    return F.xxhash64(F.coalesce(host.cast("string"), F.lit("\0")))


def _content(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


_MEASURES = ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_dup_lines", "n_removed_words", "base_failed", "depleted", "kept")


def measured(docs: DataFrame, text: str = "text", host: str = "source", order: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """A written table: one row per document, with a stable ``_row``, its measures and its lines."""
    keep = [c for c in dict.fromkeys([*(carry or []), order]) if c not in _MEASURES and not c.startswith("_")]
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        *keep,
        _host(F.col(host)).alias("_host"),
        _content(F.col(text)).alias("_content"),
        text_measures(F.col(text)).alias("_m"),
    )
    plain = ["n_words", "word_chars", "n_symbols", "n_repeat_words"]
    return written(
        rows.select(
            "_row", *keep, "_host", "_content", *[F.col(f"_m.{c}").alias(c) for c in plain], F.col("_m.by_line.n_dup_lines").alias("n_dup_lines"),
            F.transform(F.col("_m.by_line.lines"), lambda x: F.struct(F.xxhash64(F.col("_host"), x["hash"]).alias("line"), x["words"].alias("words"))).alias("_lines"),
        ),
        "line-measures",
    )


def frequent_lines(table: DataFrame, order: str = "doc_id", max_docs: int = MAX_DOCS_PER_LINE, min_share: float = 0.0) -> DataFrame:
    """Lines that more than ``max_docs`` different documents of a host hold, with the smallest id among these.

    Documents are different if their ids are; each row without an id counts. With
    ``min_share``, a line must also be in more than that share of the host's
    documents (an option, off by default, as it leaves more the larger a host is).
    """
    who = [F.col(order).alias("_id"), F.when(F.col(order).isNull(), F.col("_row")).alias("_nobody")]
    lines = table.select(F.explode(F.array_distinct(F.col("_lines.line"))).alias("line"), "_host", *who)
    by_doc = lines.groupBy("line", "_id", "_nobody").agg(F.min("_host").alias("_host"))
    often = by_doc.groupBy("line").agg(F.count("*").alias("docs"), F.min("_id").alias("first"), F.min("_host").alias("_host")).where(F.col("docs") > max_docs)
    if min_share > 0:
        hosts = table.select("_host", *who).distinct().groupBy("_host").agg(F.count("*").alias("of"))
        often = often.join(hosts, "_host").where(F.col("docs") > min_share * F.col("of"))
    return often.select("line", "docs", "first")


def removable_lines(table: DataFrame, order: str = "doc_id", max_docs: int = MAX_DOCS_PER_LINE) -> DataFrame:
    """One row per document and line to remove: ``_row``, ``line`` and the words it takes.

    The document with the smallest id keeps the line.
    """
    lines = table.select("_row", F.col(order).alias("_id"), F.explode("_lines").alias("x"))
    hit = _hits(lines.select("_row", "_id", F.col("x.line").alias("line"), F.col("x.words").alias("words")), table, order, max_docs)
    return hit.groupBy("_row", "line").agg(F.sum("words").alias("words"))


def _hits(lines: DataFrame, table: DataFrame, order: str, max_docs: int) -> DataFrame:
    """Those of ``lines`` that are to be removed from their document."""
    common = written(frequent_lines(table, order, max_docs), "frequent-lines")
    return lines.join(common, "line").where(~F.col("_id").eqNullSafe(F.col("first")))


def _cut_places(table: DataFrame, order: str, max_docs: int) -> DataFrame:
    """Per document with lines to remove: ``n`` words that go, ``_cut`` the places of the lines among its lines with a word."""
    lines = table.select("_row", F.col(order).alias("_id"), F.posexplode("_lines").alias("_at", "x"))
    hit = _hits(lines.select("_row", "_id", "_at", F.col("x.line").alias("line"), F.col("x.words").alias("words")), table, order, max_docs)
    return hit.groupBy("_row").agg(F.sum("words").alias("n"), F.collect_list("_at").alias("_cut"))


def without_lines(text: Column, cut: Column) -> Column:
    """``text`` without the lines at the places ``cut`` (from 0, of the lines with a word), in time linear in its lines."""

    def left(lines: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(lines) - 1)
        gone = bound(F.filter(every, lambda i: F.get(lines, i).rlike(WORD)), lambda worded: F.transform(cut, lambda j: F.get(worded, j)))
        return F.transform(F.array_except(every, gone), lambda i: F.get(lines, i))

    return F.array_join(bound(F.split(text, "\n", -1), left), "\n")


def judge_documents(
    docs: DataFrame, text: str = "text", host: str = "source", order: str = "doc_id", max_docs: int = MAX_DOCS_PER_LINE, min_share: float = MIN_KEPT_SHARE, carry: list[str] | None = None
) -> DataFrame:
    """Per document its measures, ``n_removed_words``, ``base_failed``, ``depleted`` and ``kept``.

    base_failed: fewer than 50 words, or over half of the words in repeated
    three-word windows. depleted: removing the host's boilerplate lines (see
    ``frequent_lines``) leaves less than ``min_share`` of the words. A null text
    is as an empty one (it fails the base rule); a null host is a host of its own;
    a null id never is the one that keeps a line while others have one. Rows that
    share an id are one document for the count, and are judged each by itself.
    An empty table gives an empty result. Of ``carry``, columns named like a
    result or with a leading underscore are left out.
    """
    table = measured(docs, text, host, order, carry)
    removed = removable_lines(table, order, max_docs).groupBy("_row").agg(F.sum("words").alias("n_removed_words"))
    out = table.drop("_lines", "_content", "_host").join(removed, "_row", "left")
    out = out.withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("bigint"))
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    out = out.withColumn("depleted", (F.col("n_words") - F.col("n_removed_words")) < min_share * F.col("n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def clean_documents(docs: DataFrame, text: str = "text", host: str = "source", order: str = "doc_id", max_docs: int = MAX_DOCS_PER_LINE, min_share: float = MIN_KEPT_SHARE) -> DataFrame:
    """The documents that are kept, without their removable lines, with the columns of ``docs``.

    A column ``n_chars`` is set to the length of the text that is left. Nulls are
    treated as in ``judge_documents``, so a row with a null text goes; of the
    documents that hold a line, the one with the smallest id keeps it, with all
    rows of that id. Repeated rows stay, and so do columns of any name.
    """
    name = {c: f"_{i}_" for i, c in enumerate(docs.columns)}
    flat = docs.select(*[F.col(c).alias(name[c]) for c in docs.columns])
    with scratch() as keep:
        table = measured(docs.select(*dict.fromkeys([text, host, order])), text, host, order)
        drop = _cut_places(table, order, max_docs)
        judged = table.select("_row", F.col(order).alias("_id"), "_host", "_content", "n_words", "n_repeat_words").join(drop, "_row", "left")
        left = F.col("n_words") - F.coalesce("n", F.lit(0))
        good = (F.col("n_words") >= 50) & (100 * F.col("n_repeat_words") <= 50 * F.col("n_words")) & (left >= min_share * F.col("n_words"))
        # Rows of one id, host and text are judged alike, so one of them stands for all.
        ok = written(judged.where(good).dropDuplicates(["_id", "_host", "_content"]).select("_id", "_host", "_content", "_cut"), "kept-documents")
        keep.append(ok)
    host_hash, content = _host(F.col(name[host])), _content(F.col(name[text]))
    ok = ok.withColumnsRenamed({"_host": "_h", "_content": "_c"})
    out = flat.join(ok, F.col(name[order]).eqNullSafe(F.col("_id")) & (host_hash == F.col("_h")) & (content == F.col("_c")))
    cut = F.when(F.col("_cut").isNull(), F.col(name[text])).otherwise(without_lines(F.col(name[text]), F.col("_cut")))
    out = out.withColumn(name[text], cut)
    if "n_chars" in name:
        out = out.withColumn(name["n_chars"], F.when(F.col("_cut").isNull(), F.col(name["n_chars"])).otherwise(F.length(name[text])).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(name[c]).alias(c) for c in docs.columns])
