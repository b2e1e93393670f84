"""Subtitles, study cards, batches and copies (SRC-16 to 18, SNK-19, WIN-01, WIN-08, TXT-26, TXT-40, AGG-08, AGG-16)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markdown import once
from ..session import checkpointed


def _cues(content: Column, drop_numbers: bool) -> Column:
    """Cues of SRT or VTT lines: what stands between a timing line and the next blank or timing line.

    The numbers of the timing lines cut the line array into islands, each of which
    is sliced once, so time grows with the lines. In SRT blank lines right after
    the timing are skipped and captions of digits alone are dropped (D17).
    """

    def text(body: Column) -> Column:
        shown = once(body, lambda b: F.slice(b, F.greatest(F.array_position(F.transform(b, lambda x: x != ""), F.lit(True)), F.lit(1)).cast("int"), F.greatest(F.size(b), F.lit(0)))) if drop_numbers else body
        return once(shown, lambda b: once(F.array_position(b, "").cast("int"), lambda e: F.slice(b, F.lit(1), F.when(e == 0, F.size(b)).otherwise(e - 1))))

    def cue(lines: Column, at: Column, end: Column) -> Column:
        body = F.transform(F.slice(lines, at + 1, end - at - 1), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
        if drop_numbers:
            body = F.filter(body, lambda x: ~x.rlike(r"^\d+$"))
        return F.struct(F.trim(F.substring_index(F.element_at(lines, at), "-->", 1)).alias("start"), text(body).alias("text"))

    def cut(lines: Column) -> Column:
        timings = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.element_at(lines, i).contains("-->"))
        cues = once(timings, lambda t: F.transform(t, lambda at, k: cue(lines, at, F.coalesce(F.get(t, k + 1), F.size(lines) + 1))))
        return F.transform(F.filter(cues, lambda c: F.size(c["text"]) > 0), lambda c: F.struct(c["start"].alias("start"), F.array_join(c["text"], " ").alias("text")))

    return once(F.split(content, "\r?\n", -1), cut)


def srt_cues(content: Column) -> Column:
    """Array of (start, text) of a SubRip text."""
    return _cues(content, True)


def vtt_cues(content: Column) -> Column:
    """The same for WebVTT. The header is skipped up to its first blank or timing line, so no cue is lost (D3 mended)."""
    return _cues(content, False)


def ass_cues(content: Column) -> Column:
    """The same for the Dialogue lines of an ASS text's events."""
    events = F.regexp_extract(content, r"(?is)(?:^|\n)\s*\[events\]\s*\n(.*?)(?=\n\s*\[|\z)", 1)
    lines = F.filter(F.transform(F.split(events, "\r?\n", -1), lambda x: F.trim(x)), lambda x: F.lower(x).startswith("dialogue:"))
    fields = F.filter(F.transform(lines, lambda x: F.split(x, ",", 10)), lambda f: F.size(f) == 10)

    def clean(t: Column) -> Column:
        t = F.regexp_replace(F.regexp_replace(t, r"\{[^}]*\}", ""), r"\\[Nn]", " ")
        return F.trim(F.regexp_replace(t, r"\s+", " "))

    cues = F.transform(fields, lambda f: F.struct(F.trim(F.get(f, F.lit(1))).alias("start"), clean(F.get(f, F.lit(9))).alias("text")))
    return F.filter(cues, lambda c: c["text"] != "")


def transcript(cues: Column, raw: bool = False, every: int = 50) -> Column:
    """Cues as text: one line each with an anchor before every 50th, or all in one line."""
    if raw:
        return F.array_join(F.transform(cues, lambda c: c["text"]), " ")

    def line(c: Column, i: Column) -> Column:
        stamp = F.when(c["start"] != "", F.concat(F.lit(" <!-- "), c["start"], F.lit(" -->"))).otherwise("")
        number = F.floor(i / every).cast("int") + 1
        anchor = F.concat(F.when(i > 0, "\n").otherwise(""), F.lit("<!-- Block "), number.cast("string"), F.lit(" -->"), stamp, F.lit("\n\n"))
        return F.concat(F.when(i % every == 0, anchor).otherwise(""), c["text"])

    return F.array_join(F.transform(cues, line), "\n")


def cards(content: Column) -> Column:
    """Array of (question, answer) from blocks that ``---`` parts."""
    form = r"(?s)\*\*Q\*\*:\s*(.*?)\s*\n\*\*A\*\*:\s*(.*)"
    blocks = F.filter(F.split(content, "\n---", -1), lambda b: b.rlike(form))
    return F.transform(blocks, lambda b: F.struct(F.trim(F.regexp_extract(b, form, 1)).alias("question"), F.regexp_replace(F.regexp_extract(b, form, 2), r"^\s+|\s+$", "").alias("answer")))


RULE = r"^\s*\|[\s\-:|]+\|\s*$"


def tables_as_bullets(text: Column) -> Column:
    """Markdown tables as lists of ``**header**: cell`` (TXT-26); a fold over the lines."""
    return once(F.split(text, "\n", -1), _bullets)


def _bullets(lines: Column) -> Column:
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("head"), F.lit(0).alias("i"), F.lit(False).alias("rule"))

    def cells(x: Column) -> Column:
        return F.transform(F.split(F.regexp_replace(F.trim(x), r"^\|+|\|+$", ""), r"\|", -1), lambda c: F.trim(c))

    def step(acc: Column, line: Column) -> Column:
        i = acc["i"] + 1
        after = F.coalesce(F.get(lines, i), F.lit(""))
        begins = line.contains("|") & after.rlike(RULE) & ~acc["rule"]
        row = (F.size(acc["head"]) > 0) & line.contains("|") & ~line.rlike(RULE)
        pairs = F.zip_with(acc["head"], cells(line), lambda h, c: F.when(F.coalesce(c, F.lit("")) != "", F.when(F.coalesce(h, F.lit("")) != "", F.concat(F.lit("**"), h, F.lit("**: "), c)).otherwise(c)))
        pairs = F.filter(F.slice(pairs, F.lit(1), F.size(acc["head"])), lambda p: p.isNotNull())
        bullet = F.when(F.size(pairs) > 0, F.array_append(acc["out"], F.concat(F.lit("- "), F.array_join(pairs, ", ")))).otherwise(acc["out"])
        none = F.array().cast("array<string>")

        def state(out: Column, head: Column, rule: Column) -> Column:
            return F.struct(out.alias("out"), head.alias("head"), i.alias("i"), rule.alias("rule"))

        return (
            F.when(acc["rule"], state(acc["out"], acc["head"], F.lit(False)))
            .when(row, state(bullet, acc["head"], F.lit(False)))
            .when(begins, state(acc["out"], cells(line), F.lit(True)))
            .otherwise(state(F.array_append(acc["out"], line), none, F.lit(False)))
        )

    return F.array_join(F.aggregate(lines, zero, step, lambda acc: acc["out"]), "\n")


class _Batch:
    """Batches of one group, row by row: a new one begins where the characters or the items would exceed a limit."""

    def __init__(self, max_chars: int, max_items: int, chars: int = 0, items: int = 0, batch: int = 0) -> None:
        self.max_chars, self.max_items = max_chars, max_items
        self.chars, self.items, self.batch = chars, items, batch

    def add(self, size: int) -> int:
        if self.items and (self.chars + size > self.max_chars or self.items >= self.max_items):
            self.chars, self.items, self.batch = 0, 0, self.batch + 1
        self.chars, self.items = self.chars + size, self.items + 1
        return self.batch

    @property
    def state(self) -> tuple[int, int, int]:
        return self.chars, self.items, self.batch


#: What a task says of its rows: the first and last group, whether they are one, the sizes that its first group begins
#: with, the state (characters, items, batch) at the end of the first group if a batch begins at each of these rows,
#: and that at the end of the last group if it begins here.
_SUMMARY = "part int, first string, last string, one boolean, head array<bigint>, ends array<array<bigint>>, tail array<bigint>"


def _summaries(frames: Iterator[pd.DataFrame], max_chars: int, max_items: int) -> Iterator[pd.DataFrame]:
    part, first, last, head = None, None, None, []
    runs: dict[int, _Batch] = {}  # batches that begin at a row of the head; those that meet go on as one
    same: list[int] = []
    tail = _Batch(max_chars, max_items)
    for f in frames:
        for p, g, n in zip(f["_part"], f["_key"], f["_size"], strict=True):
            if part is None:
                part, first, last = p, g, g
            if g != last:
                last, tail = g, _Batch(max_chars, max_items)
            tail.add(n)
            if g == first:
                if len(head) < max_items:
                    head.append(n)
                    same.append(len(head) - 1)
                    runs[len(head) - 1] = _Batch(max_chars, max_items)
                for r in runs.values():
                    r.add(n)
    if part is not None:
        ends = [list(runs[i].state) for i in same]
        yield pd.DataFrame({"part": [part], "first": [first], "last": [last], "one": [first == last], "head": [head], "ends": [ends], "tail": [list(tail.state)]})


def _entries(summaries: list, max_chars: int, max_items: int) -> dict[int, tuple[int, int, int]]:
    """The state that each task's first group is in where its rows begin, from the tasks before."""
    out, before, key = {}, (0, 0, 0), None
    for s in sorted(summaries, key=lambda s: s["part"]):
        now = _Batch(max_chars, max_items, *(before if key == s["first"] else (0, 0, 0)))
        out[s["part"]] = now.state
        for i, n in enumerate(s["head"]):
            old, fresh = now.batch, not now.items
            if now.add(n) != old or fresh:  # a batch begins here, so all that follows is known
                chars, items, more = s["ends"][i]
                now = _Batch(max_chars, max_items, chars, items, now.batch + more)
                break
        before, key = (now.state if s["one"] else tuple(s["tail"])), s["last"]
    return out


def batches(slots: DataFrame, group: str, order: str, size: str, max_chars: int = 8000, max_items: int = 20) -> DataFrame:
    """The rows with ``batch`` (from 0): a new one begins where the characters or the items would exceed a limit (WIN-01).

    The sum starts afresh with each batch, which no window frame expresses. Rows
    are dealt by ranges of group and order, so a large group is in many tasks. Each
    task first says how its first group would go on from any row at which a batch
    can begin, which is one of the first ``max_items``; a few numbers a task come
    to the driver, which follows them from task to task. Then every task numbers
    its rows from the state that it begins in. A null group is a group of its own,
    a null size counts 0; rows of equal order are in any order.
    """
    names = slots.columns
    schema = f"{slots.schema.simpleString()[7:-1]},batch:bigint"
    spark = slots.sparkSession
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("null"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = slots.repartitionByRange(parts, group, order).sortWithinPartitions(group, order)
    kept = checkpointed(dealt.select(*names, F.spark_partition_id().alias("_part"), key.alias("_key"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("_size")))
    summaries = kept.select("_part", "_key", "_size").mapInPandas(lambda f: _summaries(f, max_chars, max_items), _SUMMARY).collect()
    begin = _entries(summaries, max_chars, max_items)

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, at = None, None
        for f in frames:
            out = []
            for p, g, n in zip(f["_part"], f["_key"], f["_size"], strict=True):
                if g != at:
                    now = _Batch(max_chars, max_items, *(begin[p] if at is None else (0, 0, 0)))
                    at = g
                out.append(now.add(n))
            f["batch"] = out
            yield f[[*names, "batch"]]

    return kept.mapInPandas(number, schema)


def first_of_copies(rows: DataFrame, content: str, order: str) -> DataFrame:
    """Of rows with equal content the first in order (AGG-08); nulls are equal to each other.

    Only hashes and orders are aggregated, and the rows meet the result by both,
    so a content that very many rows have isn't dealt to one task. Copies that
    share the smallest order all stay.
    """
    hashed = rows.withColumn("_h", F.coalesce(F.sha2(F.col(content), 256), F.lit("")))
    first = hashed.groupBy("_h").agg(F.min(order).alias(order))
    return hashed.join(first, ["_h", order], "left_semi").drop("_h").select(*rows.columns)


def distinct_in_order(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with the place of their first occurrence (AGG-16)."""
    return rows.groupBy(value).agg(F.min(order).alias(order))


def runs_merged(rows: DataFrame, group: str, order: str, key: str, text: str, sep: str = "") -> DataFrame:
    """Neighbouring rows with an equal key become one, their texts joined (WIN-07)."""
    w = Window.partitionBy(group).orderBy(order)
    fresh = (~F.col(key).eqNullSafe(F.lag(key).over(w))) | (F.row_number().over(w) == 1)
    marked = rows.withColumn("_run", F.sum(fresh.cast("int")).over(w))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), sep)
    return marked.groupBy(group, "_run").agg(F.first(key).alias(key), joined.alias(text)).withColumnRenamed("_run", "run")
