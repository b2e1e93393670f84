"""Page layout on rows of spans, lines, rectangles and cells.

(AGG-04 to 07, AGG-10/11, JOIN-10/11/13/14/20, ORD-02/04/05/07, SNK-09/10/13/14, WIN-02 to 04.)
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markdown import is_sentence_end, is_structural_label, once
from ..functions.shapes import area, clip, contained, overlap, rect, widen
from .spatial import TASK_ROWS, clusters, dealt, meeting


def dominant(rows: DataFrame, group: str, value: str, weight: Column) -> DataFrame:
    """Per group the value with the largest total weight, the smallest value of a tie (AGG-04)."""
    totals = rows.groupBy(group, value).agg(F.sum(weight).cast("bigint").alias("w"))
    return totals.groupBy(group).agg(F.min_by(value, F.struct((-F.col("w")).alias("w"), F.col(value))).alias(value), F.max("w").alias("weight"))


def font_sizes(spans: DataFrame, doc: str = "doc") -> DataFrame:
    """Per document body, h1, h2, h3: the size most text has (the smallest of a tie), and the three largest that exceed it by over 1."""
    sized = spans.where(F.trim("text") != "").select(doc, F.bround("size", 1).alias("size"), F.length(F.trim("text")).alias("n"))
    totals = sized.groupBy(doc, "size").agg(F.sum("n").alias("n"))
    body = totals.groupBy(doc).agg(F.max_by("size", F.struct("n", (-F.col("size")).alias("s"))).alias("body"), F.sort_array(F.collect_set("size"), asc=False).alias("sizes"))
    larger = F.filter("sizes", lambda s: s > F.col("body") + 1)
    return body.select(doc, "body", *[F.get(larger, F.lit(i)).alias(f"h{i + 1}") for i in range(3)])


def repeated_zone_texts(lines: DataFrame, share: float = 0.6, sample: int = 20, edge: float = 0.15) -> DataFrame:
    """Texts at the top or bottom of more than a share of the sampled pages (AGG-07, ORD-07).

    lines (doc, page, y0, y1, height, text). The first and last 20 pages of a
    longer document are looked at; occurrences count, not pages (D15).
    """
    pages = lines.groupBy("doc").agg((F.max("page") + 1).alias("pages"))
    seen = lines.join(pages, "doc").where((F.col("page") < sample) | (F.col("page") >= F.col("pages") - sample))
    zone = F.when(F.col("y1") <= F.col("height") * edge, "header").when(F.col("y0") >= F.col("height") * (1 - edge), "footer")
    looked = F.least(F.col("pages"), F.lit(2 * sample))
    counted = seen.withColumn("zone", zone).where("zone IS NOT NULL AND trim(text) <> ''").groupBy("doc", "zone", F.trim("text").alias("text"), looked.alias("looked")).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > share * F.col("looked")).select("doc", "zone", "text", "n")


def reading_order(bbox: Column, bucket: float = 8.0) -> Column:
    """Struct to sort by: centre in rows of 8 points, then the left edge (ORD-02)."""
    return F.struct((F.bround((bbox["y0"] + bbox["y1"]) / 2 / bucket, 0) * bucket).alias("sort_y"), bbox["x0"].alias("x0"))


def uncovered(texts: DataFrame, covers: DataFrame, keys: list[str], ident: str, share: float = 0.6) -> DataFrame:
    """Texts that no cover on their page overlaps by more than a share (0 or more); both have ``bbox`` (JOIN-10)."""
    hit = _overlapping(texts.select(*keys, ident, F.col("bbox").alias("_of")), covers.select(*keys, F.col("bbox").alias("_by")), keys, "_of", "_by", share)
    n = -(-texts.count() // TASK_ROWS)
    return dealt(texts, n, ident).join(dealt(hit.select(ident), n, ident).distinct(), ident, "left_anti")


def lines_within(rects: DataFrame, lines: DataFrame, keys: list[str], ident: str, share: float = 0.5) -> DataFrame:
    """Per rectangle how many lines of its page it covers by more than a share (0 or more) (AGG-06)."""
    hit = _overlapping(rects.select(*keys, ident, F.col("bbox").alias("_by")), lines.select(*keys, F.col("bbox").alias("_of")), keys, "_of", "_by", share)
    n = -(-rects.count() // TASK_ROWS)
    return dealt(rects, n, ident).join(dealt(hit.select(ident), n, ident).groupBy(ident).agg(F.count("*").alias("lines")), ident, "left").withColumn("lines", F.coalesce("lines", F.lit(0)))


def _overlapping(left: DataFrame, right: DataFrame, keys: list[str], of: str, by: str, share: float) -> DataFrame:
    """Pairs in which box ``by`` covers more than a share of box ``of``."""
    if share < 0:
        raise ValueError("what overlaps by less than nothing is every pair of a page")
    a, b = (of, by) if of in left.columns else (by, of)
    return meeting(left, right, keys, a, b).where(overlap(F.col(of), F.col(by)) > share)


#: How much of a region a background must hold, and how often its area it may have.
BACKGROUND_HOLDS, BACKGROUND_AREAS = 0.95, 1.9


def captioned_figures(
    captions: DataFrame, drawings: DataFrame, page: Column, up: float = 380.0, aside: float = 90.0, least: float = 40.0, backgrounds: DataFrame | None = None
) -> DataFrame:
    """Per caption (doc, page, caption, bbox) the region of the drawings above it (JOIN-11).

    The first of the backgrounds (doc, page, ord, bbox) that holds the region and
    isn't much larger takes its place.
    """
    c, d = F.col("bbox"), F.col("d")
    gap = F.greatest(c["x0"] - d["x1"], d["x0"] - c["x1"], F.lit(0.0))
    around = rect(c["x0"] - aside - 1, c["y0"] - up - 1, c["x1"] + aside + 1, c["y0"] + 1)  # 1: the exact limits are asked below
    near = meeting(captions.select("doc", "page", "caption", "bbox", around.alias("_around")), drawings.select("doc", "page", F.col("bbox").alias("d")), ["doc", "page"], "_around", "d")
    near = near.where((gap <= aside) & (d["y0"] <= c["y0"]) & (c["y0"] - d["y1"] <= up))
    union = near.groupBy("doc", "page", "caption", "bbox").agg(rect(F.min("d.x0"), F.min("d.y0"), F.max("d.x1"), F.max("d.y1")).alias("all"))
    if backgrounds is not None:
        behind = backgrounds.select("doc", "page", "ord", clip(F.col("bbox"), page).alias("back"))
        fits = contained(F.col("all"), F.col("back"), BACKGROUND_HOLDS) & (area(F.col("back")) <= area(F.col("all")) * BACKGROUND_AREAS)
        first = meeting(union, behind, ["doc", "page"], "all", "back").where(fits).groupBy("doc", "page", "caption").agg(F.min_by("back", "ord").alias("back"))
        union = union.join(first, ["doc", "page", "caption"], "left").withColumn("all", F.coalesce("back", "all"))
    grown = widen(F.col("all"), 10.0, page)
    cut = rect(grown["x0"], grown["y0"], grown["x1"], F.least(grown["y1"], c["y0"] - 2))
    return union.select("doc", "page", "caption", cut.alias("figure")).where((F.col("figure.x1") - F.col("figure.x0") >= least) & (F.col("figure.y1") - F.col("figure.y0") >= least))


def figure_regions(captions: DataFrame, drawings: DataFrame, page: Column, gap: float = 6.0, backgrounds: DataFrame | None = None) -> DataFrame:
    """Rows doc, page, x0, y0, x1, y1, kind: the captioned figures of pages that have any, the clusters of drawings of the others (JOIN-20).

    Backgrounds are drawings too where clusters are made.
    """
    sides = ("x0", "y0", "x1", "y1")
    found = captioned_figures(captions, drawings, page, backgrounds=backgrounds).select("doc", "page", *[F.col(f"figure.{s}").cast("double").alias(s) for s in sides])
    if backgrounds is not None:
        drawings = drawings.select("doc", "page", "bbox").unionByName(backgrounds.select("doc", "page", "bbox"))
    rest = drawings.join(found.select("doc", "page").distinct(), ["doc", "page"], "left_anti")
    return found.withColumn("kind", F.lit("captioned")).unionByName(clusters(rest, ["doc", "page"], gap).withColumn("kind", F.lit("cluster")))


def paragraphs(lines: DataFrame, keys: list[str], order: str, text: str = "text") -> DataFrame:
    """Wrapped lines joined to paragraphs (WIN-03, WIN-04): rows keys, para, text.

    A line goes on the one before unless that ends a sentence, either is a
    heading or list item (columns is_heading, is_list), or it begins a labelled
    field. Between CJK characters lines join without a space.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(text).over(w)
    special = F.col("is_heading") | F.col("is_list")
    fresh = before.isNull() | special | F.coalesce(F.lag(special).over(w), F.lit(False)) | is_structural_label(F.col(text)) | is_sentence_end(before)
    cjk = r"[㐀-鿿]"
    tight = before.rlike(rf"{cjk}(?:\*\*)?\s*$") & F.col(text).rlike(rf"^\s*(?:\*\*)?{cjk}")
    bold = before.rlike(r"\*\*\s*$") & F.col(text).rlike(r"^\s*\*\*")
    marked = lines.withColumns({"_fresh": fresh, "_tight": F.coalesce(tight, F.lit(False)), "_bold": F.coalesce(bold, F.lit(False))})
    marked = marked.withColumn("para", F.sum(F.col("_fresh").cast("int")).over(w))
    parts = F.sort_array(F.collect_list(F.struct(order, F.trim(text).alias("t"), "_tight", "_bold")))

    def add(acc: Column, p: Column) -> Column:
        joined = F.concat(F.regexp_replace(acc, r"\*\*$", ""), F.when(p["_tight"], "").otherwise(" "), F.regexp_replace(p["t"], r"^\*\*", ""))
        plain = F.concat(acc, F.when(p["_tight"], "").otherwise(" "), p["t"])
        return F.when(acc == "", p["t"]).when(p["t"] == "", acc).when(p["_bold"], joined).otherwise(plain)

    return marked.groupBy(*keys, "para").agg(F.aggregate(parts, F.lit(""), add).alias(text))


def merged_headings(elements: DataFrame, keys: list[str], order: str, text: str = "text", room: int = 60, short: int = 40) -> DataFrame:
    """Neighbouring headings of a level become one while the title is under 60 and the next at most 40 characters (WIN-02).

    elements have ``level`` (0: no heading). What fits depends on the title so
    far, so a task folds its sorted rows as they stream past.
    """
    names = [*keys, order, "level", text]
    schema = elements.select(*names).schema

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for f in frames:
            out = []
            for row in f[names].itertuples(index=False):
                row = list(row)
                level, title = row[-2], row[-1]
                if held and row[: len(keys)] == held[: len(keys)] and level > 0 and level == held[-2] and len(held[-1]) < room and len(title) <= short:
                    held[-1] += " " + title
                    continue
                if held:
                    out.append(held)
                held = row
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame([held], columns=names)

    return elements.select(*names).repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(fold, schema)


def grid_bounds(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Per sheet the first and last row and column with content (AGG-11)."""
    full = cells.where(F.coalesce(F.trim("value"), F.lit("")) != "")
    return full.groupBy(*keys).agg(F.min("row").alias("row0"), F.min("col").alias("col0"), F.max("row").alias("row1"), F.max("col").alias("col1"))


def spread_merged(cells: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (keys, row, col, value, kind) in which empty places of a merged range take its first value (JOIN-13, JOIN-14)."""
    first = cells.where(F.coalesce(F.trim("value"), F.lit("")) != "")
    tops = ranges.join(first.withColumnsRenamed({"row": "row0", "col": "col0"}), [*keys, "row0", "col0"])
    places = tops.select(*keys, "value", "kind", "row1", "col0", "col1", F.explode(F.sequence("row0", "row1")).alias("row")).select(*keys, "row", F.explode(F.sequence("col0", "col1")).alias("col"), F.col("value").alias("mv"), F.col("kind").alias("mk"))
    both = cells.join(places, [*keys, "row", "col"], "full_outer")
    empty = F.coalesce(F.trim("value"), F.lit("")) == ""
    return both.select(*keys, "row", "col", F.when(empty, F.coalesce("mv", "value")).otherwise(F.col("value")).alias("value"), F.when(empty, F.coalesce("mk", "kind")).otherwise(F.col("kind")).alias("kind"))


def pipe_table(cells: DataFrame, keys: list[str], max_rows: int = 0, max_cols: int = 0) -> DataFrame:
    """One Markdown table per sheet from cells (keys, row, col, value, kind) (SNK-09/10, ORD-04/05).

    Rows and columns beyond the limits go (0: no limit; ``table_limits`` tells where);
    empty cells at the ends of rows go and rows are padded again. A column is right-aligned
    if all its cells below the first row that have content are numbers. Of several
    values for one place the largest is shown. One shuffle brings a sheet's cells
    with content together in order; each then adds itself and what is empty
    between it and the one before. Sheets without content have no table.
    """
    place = F.struct("row", "col", "value", (F.coalesce(F.col("kind") == "number", F.lit(False))).alias("number"))
    sheet = cells.where(F.coalesce(F.trim("value"), F.lit("")) != "").groupBy(*keys).agg(F.min("row").alias("_row0"), F.min("col").alias("_col0"), F.sort_array(F.collect_list(place)).alias("_cells"))
    row0, col0 = F.col("_row0"), F.col("_col0")

    def shown(x: Column) -> Column:
        return (x["row"] < row0 + max_rows if max_rows else F.lit(True)) & (x["col"] < col0 + max_cols if max_cols else F.lit(True))

    def single(c: Column) -> Column:
        later = lambda x, i: F.struct(F.get(c, i + 1)["row"], F.get(c, i + 1)["col"]).eqNullSafe(F.struct(x["row"], x["col"]))
        return F.filter(c, lambda x, i: ~later(x, i))

    def table(c: Column) -> Column:
        below = F.filter(c, lambda x: x["row"] > row0)
        right = F.array_sort(F.array_except(F.transform(below, lambda x: x["col"]), F.transform(F.filter(below, lambda x: ~x["number"]), lambda x: x["col"])))
        last = F.array_max(F.transform(c, lambda x: x["col"]))
        return once(F.struct(right.alias("right"), last.alias("last"), F.element_at(c, -1).alias("end")), lambda t: once(_rule(t["right"], col0, t["last"]), lambda rule: _body(c, t["last"], t["end"], rule, row0, col0)))

    return sheet.withColumn("_cells", F.filter("_cells", shown)).where(F.size("_cells") > 0).select(*keys, once(once(F.col("_cells"), single), table).alias("markdown"))


def _times(text: str | Column, n: Column) -> Column:
    return F.repeat(F.lit(text) if isinstance(text, str) else text, n.cast("int"))


def _rule(right: Column, first: Column, last: Column) -> Column:
    """The line below the head: right-aligned columns in order, each after the plain ones between it and the one before."""
    marks = F.transform(right, lambda c, i: F.concat(_times(" --- |", c - F.coalesce(F.get(right, i - 1), first - 1) - 1), F.lit(" ---: |")))
    return F.concat(F.lit("|"), F.array_join(marks, ""), _times(" --- |", last - F.coalesce(F.get(right, F.size(right) - 1), first - 1)))


def _body(cells: Column, last: Column, end: Column, rule: Column, row0: Column, col0: Column) -> Column:
    """Lines of the cells, which are in order and one a place, with the rule after the first line."""
    blank = F.concat(F.lit("|"), _times("  |", last - col0 + 1), F.lit("\n"))

    def ended(row: Column, col: Column) -> Column:
        return F.concat(_times("  |", last - col), F.when(row == row0, F.concat(F.lit("\n"), rule)).otherwise(""))

    def add(x: Column, i: Column) -> Column:
        row, col = F.coalesce(F.get(cells, i - 1)["row"], row0), F.coalesce(F.get(cells, i - 1)["col"], col0 - 1)
        fresh = F.concat(ended(row, col), F.lit("\n"), _times(blank, x["row"] - row - 1), F.lit("|"), _times("  |", x["col"] - col0))
        return F.concat(F.when(x["row"] == row, _times("  |", x["col"] - col - 1)).otherwise(fresh), F.lit(" "), x["value"], F.lit(" |"))

    return F.concat(F.lit("|"), F.array_join(F.transform(cells, add), ""), ended(end["row"], end["col"]))


def table_limits(cells: DataFrame, keys: list[str], max_rows: int = 0, max_cols: int = 0) -> DataFrame:
    """Per sheet rows_cut and cols_cut: whether the limits of ``pipe_table`` leave rows or columns out (ORD-04)."""
    b = grid_bounds(cells, keys)
    rows, cols = F.col("row1") - F.col("row0") + 1, F.col("col1") - F.col("col0") + 1
    return b.select(*keys, (F.lit(max_rows > 0) & (rows > max_rows)).alias("rows_cut"), (F.lit(max_cols > 0) & (cols > max_cols)).alias("cols_cut"))


def table_shape(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Per table rows, columns, filled cells, density, share of distinct texts, and whether it is a real table (AGG-05, FLT-14)."""
    filled = F.when(F.trim("value") != "", F.trim("value"))
    s = cells.groupBy(*keys).agg(F.countDistinct("row").alias("n_rows"), F.max(F.col("col") + 1).cast("bigint").alias("n_cols"), F.count(filled).alias("filled"), F.countDistinct(filled).alias("different"))
    s = s.withColumns({"density": F.col("filled") / F.greatest(F.col("n_rows") * F.col("n_cols"), F.lit(1)), "unique_ratio": F.coalesce(F.try_divide(F.col("different"), F.col("filled")), F.lit(0.0))})
    real = (F.least("n_rows", "n_cols") >= 2) & (F.col("filled") >= 4) & (F.col("density") >= 0.30)
    real = real & ~((F.col("n_cols") >= 12) & (F.col("density") < 0.45))
    real = real & ~((F.col("n_rows") >= 8) & (F.col("n_cols") >= 8) & (F.col("density") < 0.55) & (F.col("unique_ratio") < 0.85))
    return s.withColumn("is_table", real)


def chart_table(points: DataFrame, chart: str, category: str, series: str, value: str, names: list[str]) -> DataFrame:
    """Chart data as rows: one per category with a column per series, whole numbers without a point (SNK-14/15).

    Of several values for one place the smallest is shown.
    """
    wide = points.groupBy(chart, category).pivot(series, names).agg(F.min(value))
    shown = [F.when(F.col(n).isNull(), "").when(F.col(n) == F.floor(F.col(n)), F.floor(F.col(n)).cast("string")).otherwise(F.col(n).cast("string")).alias(n) for n in names]
    return wide.select(chart, category, *shown)


def ring_medians(pixels: DataFrame, keys: list[str], ring: int = 6) -> DataFrame:
    """Per image the median colour of a ring around a box, cut to whole numbers; white without pixels (AGG-10).

    pixels (keys, x, y, r, g, b, box array<int>).
    """
    x0, y0, x1, y1 = (F.get("box", F.lit(i)) for i in range(4))
    outer = F.col("x").between(x0 - ring, x1 + ring - 1) & F.col("y").between(y0 - ring, y1 + ring - 1)
    inner = F.col("x").between(x0, x1 - 1) & F.col("y").between(y0, y1 - 1)
    border = outer & ~inner
    return pixels.groupBy(*keys).agg(*[F.coalesce(F.percentile(F.when(border, F.col(c)), 0.5).cast("int"), F.lit(255)).alias(c) for c in "rgb"])


def filled_boxes(pixels: DataFrame, fills: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Pixels with the boxes of their image painted over in order; fills (keys, order, box array<int>, r, g, b) (SNK-41).

    Where boxes overlap the last one shows. The boxes of an image are few; they
    travel to its pixels as one array.
    """
    boxes = fills.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, "box", *"rgb"))).alias("_fills"))

    def covers(f: Column) -> Column:
        x0, y0, x1, y1 = (F.get(f["box"], F.lit(i)) for i in range(4))
        return F.col("x").between(x0, x1 - 1) & F.col("y").between(y0, y1 - 1)

    painted = pixels.join(boxes, keys, "left").withColumn("_top", F.try_element_at(F.filter("_fills", covers), F.lit(-1)))
    return painted.select(*keys, "x", "y", *[F.coalesce(F.col(f"_top.{c}"), F.col(c)).alias(c) for c in "rgb"])


def page_markdown(elements: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The Markdown of each page from its elements in order: keys, markdown (WIN-06).

    elements: kind (heading, list, code, table, image or text) and content. Code
    lines next to each other become one fenced block, items of a list stand on
    neighbouring lines, everything else is a paragraph. A fold over the elements
    of a page inside its row.
    """
    none, text = F.array().cast("array<string>"), "array<string>"
    rows = F.sort_array(F.collect_list(F.struct(order, "kind", "content")))
    zero = F.struct(F.lit("").alias("out"), F.lit(False).alias("list"), none.cast(text).alias("code"))

    def flushed(acc: Column) -> Column:
        block = F.concat(F.lit("```\n"), F.array_join(acc["code"], "\n"), F.lit("\n```\n\n"))
        return F.concat(acc["out"], F.when(F.size(acc["code"]) > 0, block).otherwise(""))

    def step(acc: Column, e: Column) -> Column:
        gap = F.when(acc["list"], "\n").otherwise("")
        code = F.struct(F.concat(acc["out"], gap).alias("out"), F.lit(False).alias("list"), F.array_append(acc["code"], e["content"]).alias("code"))
        item = F.struct(F.concat(flushed(acc), e["content"], F.lit("\n")).alias("out"), F.lit(True).alias("list"), none.alias("code"))
        other = F.struct(F.concat(flushed(acc), gap, e["content"], F.lit("\n\n")).alias("out"), F.lit(False).alias("list"), none.alias("code"))
        return F.when(e["kind"] == "code", code).when(e["kind"] == "list", item).otherwise(other)

    return elements.groupBy(*keys).agg(F.aggregate(rows, zero, step, flushed).alias("markdown"))
