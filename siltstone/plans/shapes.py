"""Image, rectangle, table and layout queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown, rounding, shapes
from ..operators import layout, raster
from .base import Query, table


def _images(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", (50 + k * 37 % 1500).cast("int").alias("w"), (60 + k * 53 % 900).cast("int").alias("h"), (500 + k * 7919 % 90000).alias("n"), (k % 900).alias("hash"))


def image_filter(spark: SparkSession, d: str) -> DataFrame:
    """Early checks, first of each hash, then late checks (D13 kept)."""
    w, h, n = (F.col(c) for c in ("w", "h", "n"))
    early = _images(spark, d).where(shapes.early_image_checks(w, h, n))
    first = early.groupBy("hash").agg(F.min("p_partkey").alias("p_partkey")).select("p_partkey")
    page = (F.lit(600.0), F.lit(800.0))
    return early.join(first, "p_partkey").where(shapes.late_image_checks(w, h, n, page, (w / 20, h / 30))).select("p_partkey")


def _rgb(k: Column) -> list[Column]:
    return [(k * m % 256).cast("int") for m in (37, 59, 83)]


def red_mask(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(shapes.is_red(*_rgb(k))).alias("red"), F.count("*").alias("pixels"))


def border_median(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_partkey")
    px = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") % 40).cast("int").alias("x"), (k % 30).cast("int").alias("y"), *[c.alias(n) for c, n in zip(_rgb(k), "rgb", strict=True)], F.array(F.lit(10), F.lit(10), F.lit(30), F.lit(20)).alias("box"))
    return layout.ring_medians(px, ["l_suppkey"])


def filled_boxes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_partkey")
    px = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") % 40).cast("int").alias("x"), (k % 30).cast("int").alias("y"), *[c.alias(n) for c, n in zip(_rgb(k), "rgb", strict=True)])
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    first = s.select("l_suppkey", F.lit(1).alias("ord"), F.array(F.lit(5), F.lit(5), F.lit(25), F.lit(15)).alias("box"), F.lit(255).alias("r"), F.lit(0).alias("g"), F.lit(128).alias("b"))
    second = s.where("l_suppkey % 3 > 0").select("l_suppkey", F.lit(2).alias("ord"), F.array(F.lit(15), F.lit(10), F.lit(35), F.lit(20)).alias("box"), F.lit(1).alias("r"), (F.col("l_suppkey") % 256).cast("int").alias("g"), F.lit(7).alias("b"))
    fills = second.unionByName(first)
    return layout.filled_boxes(px, fills, ["l_suppkey"]).groupBy("l_suppkey").agg(*[F.sum(c).cast("bigint").alias(c) for c in "rgb"])


def boxes(spark: SparkSession, d: str, name: str, key: str, m: int) -> DataFrame:
    k = F.col(key)
    x, y = (k * m % 500).cast("double"), (k * (m + 4) % 700).cast("double")
    return table(spark, d, name).select(F.floor(k / 40).alias("page"), k.alias("id"), shapes.rect(x, y, x + 40 + k % 60, y + 30 + k % 50).alias("bbox"))


def rect_overlap(spark: SparkSession, d: str) -> DataFrame:
    return layout.uncovered(boxes(spark, d, "customer", "c_custkey", 13), boxes(spark, d, "part", "p_partkey", 17), ["page"], "id", 0.3).select("id")


def lines_in_rects(spark: SparkSession, d: str) -> DataFrame:
    return layout.lines_within(boxes(spark, d, "customer", "c_custkey", 13), boxes(spark, d, "part", "p_partkey", 17), ["page"], "id", 0.3).select("id", "lines")


def _figures(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, Column]:
    captions = boxes(spark, d, "supplier", "s_suppkey", 29).select(F.lit(1).alias("doc"), "page", F.col("id").alias("caption"), "bbox")
    drawings = boxes(spark, d, "customer", "c_custkey", 13).select(F.lit(1).alias("doc"), "page", "bbox")
    return captions, drawings, shapes.rect(F.lit(0), F.lit(0), F.lit(600), F.lit(800))


def captioned_figures(spark: SparkSession, d: str) -> DataFrame:
    return layout.captioned_figures(*_figures(spark, d)).select("page", "caption", "figure.*")


def figure_regions(spark: SparkSession, d: str) -> DataFrame:
    return layout.figure_regions(*_figures(spark, d)).drop("doc")


def vector_regions(spark: SparkSession, d: str) -> DataFrame:
    """Five-pointed shapes of a page, filled at 36 dpi within a region: the pixels of each, and those of them that stay visible."""
    k = F.col("c_custkey")
    ring = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct((k * 13 % 450 + (k * 7 + i * 37) % 61).cast("double").alias("x"), (k * 17 % 560 + (k * 11 + i * 53) % 47 / 4).cast("double").alias("y")))
    region = shapes.rect(F.lit(50), F.lit(60), F.lit(400), F.lit(501))
    drawn = table(spark, d, "customer").select(F.floor(k / 40).alias("page"), k.alias("id"), ring.alias("ring"), region.alias("region"))
    runs = raster.filled_runs(drawn, ["page", "id"], 36)
    inside = runs.groupBy("id").agg(F.sum(F.col("x1") - F.col("x0")).alias("pixels"), F.countDistinct("row").alias("rows"))
    seen = raster.painted(runs, ["page"], "id").groupBy("id").agg(F.count("*").alias("visible"), F.sum("x").alias("sum_x"), F.sum("row").alias("sum_y"))
    return inside.join(seen, "id", "left").select("id", "pixels", "rows", F.coalesce("visible", F.lit(0)).alias("visible"), "sum_x", "sum_y")


def reading_order(spark: SparkSession, d: str) -> DataFrame:
    o = layout.reading_order(F.col("bbox"))
    return boxes(spark, d, "part", "p_partkey", 17).select("id", o["sort_y"].alias("sort_y"), o["x0"].alias("x0"))


def font_levels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey") + F.col("l_linenumber")
    text = F.concat(F.lit("Heading "), k.cast("string"), F.when(k % 5 == 0, ".").otherwise(""))
    spans = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), (9 + F.when(k % 10 < 7, 1).otherwise(k % 10)).cast("double").alias("size"), text.alias("text"), F.when(k % 2 == 0, 16).otherwise(0).alias("flags"))
    sizes = layout.font_sizes(spans)
    level = markdown.heading_level(F.col("size"), F.col("body"), F.col("h1"), F.col("h2"), F.col("h3"), F.col("text"), F.col("flags"))
    return spans.join(sizes, "doc").groupBy("doc", "body", "h1", "h2", "h3").agg(*[F.count_if(level == i).alias(f"n{i}") for i in range(4)])


def zone_texts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_linenumber")
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc"), (F.col("l_orderkey") % 60).cast("int").alias("page"), (F.when(k % 2 == 0, 10.0).otherwise(760.0)).alias("y0"), (F.when(k % 2 == 0, 20.0).otherwise(780.0)).alias("y1"), F.lit(800.0).alias("height"), F.concat(F.lit(" H"), (F.col("l_partkey") % 3).cast("string")).alias("text"))
    return layout.repeated_zone_texts(lines).select("doc", "zone", "text", "n")


def heading_merge(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_linenumber")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("l_returnflag"))
    rows = lines.select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "A", 2).otherwise(0).alias("level"), F.concat(F.lit("T"), k.cast("string")).alias("text"))
    return layout.merged_headings(rows, ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber", "level", "text")


def pipe_table(spark: SparkSession, d: str) -> DataFrame:
    """An order is a sheet, its lines are rows."""
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("row")).agg(F.max("l_returnflag").alias("flag"), F.max("l_partkey").alias("part"))
    cells = n.select("sheet", "row", F.lit(1).alias("col"), F.col("flag").alias("value"), F.lit("text").alias("kind")).unionByName(
        n.select("sheet", "row", F.lit(2).alias("col"), F.col("part").cast("string").alias("value"), F.lit("number").alias("kind"))
    )
    return layout.pipe_table(cells, ["sheet"])


def merged_cells(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    cells = table(spark, d, "customer").select(F.col("c_nationkey").alias("sheet"), (k % 40).cast("int").alias("row"), (F.floor(k / 40) % 10).cast("int").alias("col"), F.when(k % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("value"), F.lit("text").alias("kind")).groupBy("sheet", "row", "col").agg(F.max("value").alias("value"), F.max("kind").alias("kind"))
    ranges = table(spark, d, "nation").select(F.col("n_nationkey").alias("sheet"), F.lit(0).alias("row0"), F.lit(1).alias("col0"), F.lit(39).alias("row1"), F.lit(3).alias("col1"))
    full = layout.spread_merged(cells, ranges, ["sheet"])
    return full.groupBy("sheet").agg(F.count("*").alias("cells"), F.count_if(F.trim("value") != "").alias("filled"))


def table_shape(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey")
    cells = table(spark, d, "lineitem").select("l_suppkey", (k % 12).alias("row"), (F.col("l_linenumber") + k % 9).cast("int").alias("col"), F.when(F.col("l_partkey") % 3 == 0, " ").otherwise(F.col("l_returnflag")).alias("value")).groupBy("l_suppkey", "row", "col").agg(F.max("value").alias("value"))
    s = layout.table_shape(cells, ["l_suppkey"])
    return s.select("l_suppkey", "n_rows", "n_cols", "filled", F.round("density", 9).alias("density"), F.round("unique_ratio", 9).alias("unique_ratio"), "is_table")


def chart_pivot(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("user_id") % 3).cast("int").alias("u")).agg(F.count("*").cast("double").alias("v"))
    points = e.select(F.lit("events").alias("chart"), "day", F.concat(F.lit("s"), F.col("u").cast("string")).alias("series"), F.when(F.col("u") == 1, F.col("v") + 0.5).otherwise(F.col("v")).alias("v"))
    return layout.chart_table(points, "chart", "day", "series", "v", ["s0", "s1", "s2"])


def lengths(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    unit = F.get(F.array(*[F.lit(u) for u in ("in", "cm", "mm", "pt", "px", "em")]), (k % 6).cast("int"))
    size = shapes.vml_size(F.concat(F.lit("position:absolute; Width:"), (k % 40).cast("string"), F.lit(".5"), unit, F.lit(";height: "), (k % 30).cast("string"), F.lit("pt")))
    return table(spark, d, "part").select("p_partkey", size["width"].alias("width"), size["height"].alias("height"))


def colours(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    value = F.when(k % 3 == 0, F.concat(F.lit("#"), F.lpad(F.lower(F.hex(k * 7919 % 16777216)), 6, "0"))).when(k % 3 == 1, " White ").otherwise("none")
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(shapes.parse_colour(value), lambda c: c.cast("string")), ",").alias("rgb"))


def file_sizes(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey") * F.col("o_orderkey") * 7 + F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", rounding.file_size(n).alias("size"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        image_filter, red_mask, border_median, filled_boxes, rect_overlap, lines_in_rects, captioned_figures, figure_regions, vector_regions, reading_order, font_levels, zone_texts, heading_merge,
        pipe_table, merged_cells, table_shape, chart_pivot, lengths, colours, file_sizes,
    )
}


def sql_boxes(name: str, key: str, m: int) -> str:
    return f"SELECT {key} // 40 AS page, {key} AS id, ({key}*{m} % 500)::DOUBLE AS x0, ({key}*{m + 4} % 700)::DOUBLE AS y0, ({key}*{m} % 500 + 40 + {key} % 60)::DOUBLE AS x1, ({key}*{m + 4} % 700 + 30 + {key} % 50)::DOUBLE AS y1 FROM {name}"


_PAIRS = f"""a AS ({sql_boxes('customer', 'c_custkey', 13)}), b AS ({sql_boxes('part', 'p_partkey', 17)}),
p AS (SELECT a.id, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i,
  (a.x1 - a.x0) * (a.y1 - a.y0) AS sa, (b.x1 - b.x0) * (b.y1 - b.y0) AS sb FROM a JOIN b USING (page))"""
_CAPTIONED = f"""c AS ({sql_boxes('supplier', 's_suppkey', 29)}), d AS ({sql_boxes('customer', 'c_custkey', 13)}),
u AS (SELECT c.page, c.id AS caption, c.y0 AS cy, min(d.x0) AS a0, min(d.y0) AS b0, max(d.x1) AS a1, max(d.y1) AS b1 FROM c JOIN d USING (page)
  WHERE greatest(c.x0 - d.x1, d.x0 - c.x1, 0) <= 90 AND d.y0 <= c.y0 AND c.y0 - d.y1 <= 380 GROUP BY ALL),
f AS (SELECT page, caption, greatest(a0 - 10, 0) AS x0, greatest(b0 - 10, 0) AS y0, least(a1 + 10, 600) AS x1, least(least(b1 + 10, 800), cy - 2) AS y1 FROM u)"""
_CAPTIONED_ROWS = """SELECT page, caption, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM f WHERE x1 - x0 >= 40 AND y1 - y0 >= 40"""
_PX = "SELECT l_suppkey, (l_orderkey % 40)::INT AS x, (l_partkey % 30)::INT AS y, (l_partkey*37 % 256)::INT AS r, (l_partkey*59 % 256)::INT AS g, (l_partkey*83 % 256)::INT AS b FROM lineitem"
SQL = {
    "image_filter": """
WITH i AS (SELECT p_partkey, 50 + p_partkey*37 % 1500 AS w, 60 + p_partkey*53 % 900 AS h, 500 + p_partkey*7919 % 90000 AS n, p_partkey % 900 AS hash FROM part),
e AS (SELECT * FROM i WHERE least(w, h) >= 100 AND w*h >= 30000 AND n >= 2048),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY hash ORDER BY p_partkey) = 1)
SELECT p_partkey FROM f WHERE greatest(w, h)::DOUBLE / least(w, h) <= 12 AND NOT (n::DOUBLE / (w*h) < 0.08 AND w*h < 500000) AND NOT (w / 20.0::DOUBLE / 600 < 0.05 AND h / 30.0::DOUBLE / 800 < 0.05)""",
    "red_mask": """SELECT l_suppkey, count(*) FILTER (WHERE r >= 120 AND g <= 120 AND b <= 120 AND r - greatest(g, b) >= 40) AS red, count(*) AS pixels
FROM (SELECT l_suppkey, k*37 % 256 AS r, k*59 % 256 AS g, k*83 % 256 AS b FROM (SELECT l_suppkey, l_orderkey*7 + l_linenumber AS k FROM lineitem)) GROUP BY l_suppkey""",
    "border_median": f"""SELECT l_suppkey, coalesce(trunc(quantile_cont(r::DOUBLE, 0.5) FILTER (WHERE e))::INT, 255) AS r, coalesce(trunc(quantile_cont(g::DOUBLE, 0.5) FILTER (WHERE e))::INT, 255) AS g, coalesce(trunc(quantile_cont(b::DOUBLE, 0.5) FILTER (WHERE e))::INT, 255) AS b
FROM (SELECT *, x BETWEEN 4 AND 35 AND y BETWEEN 4 AND 25 AND NOT (x BETWEEN 10 AND 29 AND y BETWEEN 10 AND 19) AS e FROM ({_PX})) GROUP BY l_suppkey""",
    "filled_boxes": f"""SELECT l_suppkey, sum(CASE f WHEN 2 THEN 1 WHEN 1 THEN 255 ELSE r END)::BIGINT AS r, sum(CASE f WHEN 2 THEN l_suppkey % 256 WHEN 1 THEN 0 ELSE g END)::BIGINT AS g, sum(CASE f WHEN 2 THEN 7 WHEN 1 THEN 128 ELSE b END)::BIGINT AS b
FROM (SELECT *, CASE WHEN l_suppkey % 3 > 0 AND x BETWEEN 15 AND 34 AND y BETWEEN 10 AND 19 THEN 2 WHEN x BETWEEN 5 AND 24 AND y BETWEEN 5 AND 14 THEN 1 END AS f FROM ({_PX})) GROUP BY l_suppkey""",
    "rect_overlap": f"WITH {_PAIRS} SELECT id FROM a WHERE id NOT IN (SELECT id FROM p WHERE i / sa > 0.3)",
    "lines_in_rects": f"WITH {_PAIRS} SELECT a.id, coalesce(n, 0) AS lines FROM a LEFT JOIN (SELECT id, count(*) AS n FROM p WHERE i / sb > 0.3 GROUP BY id) USING (id)",
    "captioned_figures": f"WITH {_CAPTIONED} {_CAPTIONED_ROWS}",
    # A page has at most 40 boxes, so 40 rounds in which each takes in all that is near it are enough.
    "figure_regions": f"""
WITH RECURSIVE {_CAPTIONED}, k AS ({_CAPTIONED_ROWS}),
g AS (SELECT 0 AS n, page, id, x0, y0, x1, y1 FROM d WHERE page NOT IN (SELECT page FROM k)
  UNION ALL SELECT a.n + 1, a.page, a.id, min(b.x0), min(b.y0), max(b.x1), max(b.y1) FROM g a JOIN g b
    ON a.page = b.page AND b.x0 - 6 <= a.x1 AND a.x0 - 6 <= b.x1 AND b.y0 - 6 <= a.y1 AND a.y0 - 6 <= b.y1 WHERE a.n < 40 GROUP BY a.n, a.page, a.id)
SELECT page, x0, y0, x1, y1, 'captioned' AS kind FROM k UNION ALL SELECT DISTINCT page, x0, y0, x1, y1, 'cluster' FROM g WHERE n = 40""",
    # Every pixel of the region against every side: inside where an odd number of sides cross its row at or before its centre.
    "vector_regions": """
WITH i AS (SELECT unnest(range(5)) AS i), p AS (SELECT c_custkey AS id, c_custkey // 40 AS page, i, (c_custkey*13 % 450 + (c_custkey*7 + i*37) % 61)::DOUBLE AS px, (c_custkey*17 % 560 + ((c_custkey*11 + i*53) % 47) / 4.0::DOUBLE) AS py FROM customer, i),
s AS (SELECT a.id, a.page, (a.px - 50) * 0.5::DOUBLE AS x, (a.py - 60) * 0.5::DOUBLE AS y, (b.px - 50) * 0.5::DOUBLE AS u, (b.py - 60) * 0.5::DOUBLE AS v FROM p a JOIN p b ON a.id = b.id AND b.i = (a.i + 1) % 5),
box AS (SELECT id, greatest(floor(min(x))::INT - 1, 0) AS l, least(ceil(max(x))::INT + 1, 174) AS r, greatest(floor(min(y))::INT - 1, 0) AS t, least(ceil(max(y))::INT + 1, 220) AS b FROM s GROUP BY id),
g AS (SELECT id, x, unnest(range(t, b + 1)) AS y FROM (SELECT id, t, b, unnest(range(l, r + 1)) AS x FROM box)),
f AS (SELECT s.id, s.page, g.x, g.y FROM g JOIN s USING (id)
  WHERE (s.y <= g.y + 0.5::DOUBLE) <> (s.v <= g.y + 0.5::DOUBLE) AND s.x + (g.y + 0.5::DOUBLE - s.y) * (s.u - s.x) / (s.v - s.y) <= g.x + 0.5::DOUBLE GROUP BY ALL HAVING count(*) % 2 = 1),
o AS (SELECT *, max(id) OVER (PARTITION BY page, x, y) AS top FROM f)
SELECT id, count(*) AS pixels, count(DISTINCT y) AS rows, count(*) FILTER (WHERE id = top) AS visible, (sum(x) FILTER (WHERE id = top))::BIGINT AS sum_x, (sum(y) FILTER (WHERE id = top))::BIGINT AS sum_y FROM o GROUP BY id""",
    "reading_order": f"SELECT id, round_even((y0 + y1) / 2 / 8, 0) * 8 AS sort_y, x0 FROM ({sql_boxes('part', 'p_partkey', 17)})",
    "font_levels": """
WITH s AS (SELECT l_suppkey AS doc, (9 + CASE WHEN k % 10 < 7 THEN 1 ELSE k % 10 END)::DOUBLE AS size, 'Heading ' || k || CASE WHEN k % 5 = 0 THEN '.' ELSE '' END AS text, k % 2 = 0 AS bold
  FROM (SELECT l_suppkey, l_orderkey + l_linenumber AS k FROM lineitem)),
t AS (SELECT doc, size, sum(length(text)) AS n FROM s GROUP BY ALL), b AS (SELECT doc, arg_max(size, n) AS body FROM t GROUP BY doc),
l AS (SELECT doc, body, list_filter(list_sort(list(DISTINCT size), 'DESC'), lambda x: x > body + 1) AS z FROM t JOIN b USING (doc) GROUP BY doc, body),
v AS (SELECT l.doc, body, z[1] AS h1, z[2] AS h2, z[3] AS h3, text, bold, size, CASE WHEN size >= z[1] - 0.5 THEN 1 WHEN size >= z[2] - 0.5 THEN 2 WHEN size >= z[3] - 0.5 THEN 3 ELSE 0 END AS lv FROM s JOIN l USING (doc)),
w AS (SELECT *, CASE WHEN lv > 0 AND (ends_with(text, '.') OR (NOT bold AND lv >= 2 AND size < body + 2)) THEN 0 ELSE lv END AS f FROM v)
SELECT doc, body, h1, h2, h3, count(*) FILTER (WHERE f = 0) AS n0, count(*) FILTER (WHERE f = 1) AS n1, count(*) FILTER (WHERE f = 2) AS n2, count(*) FILTER (WHERE f = 3) AS n3 FROM w GROUP BY doc, body, h1, h2, h3""",
    "zone_texts": """
WITH l AS (SELECT l_suppkey AS doc, l_orderkey % 60 AS page, CASE WHEN l_linenumber % 2 = 0 THEN 'header' ELSE 'footer' END AS zone, 'H' || (l_partkey % 3) AS text FROM lineitem),
n AS (SELECT doc, max(page) + 1 AS pages FROM l GROUP BY doc),
c AS (SELECT doc, zone, text, least(pages, 40) AS seen, count(*) AS n FROM l JOIN n USING (doc) WHERE page < 20 OR page >= pages - 20 GROUP BY ALL)
SELECT doc, zone, text, n FROM c WHERE n > 0.6 * seen""",
    "heading_merge": """
WITH h AS (SELECT l_orderkey, l_linenumber, CASE max(l_returnflag) WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 0 END AS level, 'T' || l_linenumber AS text FROM lineitem GROUP BY l_orderkey, l_linenumber),
g AS (SELECT *, CASE WHEN level > 0 AND level = lag(level) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) THEN 0 ELSE 1 END AS fresh FROM h),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS run FROM g)
SELECT l_orderkey, min(l_linenumber) AS l_linenumber, min(level) AS level, string_agg(text, ' ' ORDER BY l_linenumber) AS text FROM r GROUP BY l_orderkey, run""",
    "merged_cells": """
WITH c AS (SELECT c_nationkey AS sheet, c_custkey % 40 AS row, (c_custkey // 40) % 10 AS col, max(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END) AS value FROM customer GROUP BY 1, 2, 3),
m AS (SELECT sheet FROM c WHERE row = 0 AND col = 1 AND value <> ''),
p AS (SELECT sheet, r AS row, k AS col FROM m, range(0, 40) t(r), range(1, 4) u(k))
SELECT sheet, count(*) AS cells, count(*) FILTER (WHERE coalesce(value, '') <> '' OR pc IS NOT NULL) AS filled
FROM (SELECT coalesce(c.sheet, p.sheet) AS sheet, value, p.col AS pc FROM c FULL JOIN p ON c.sheet = p.sheet AND c.row = p.row AND c.col = p.col) GROUP BY sheet""",
    "table_shape": """
WITH c AS (SELECT l_suppkey, l_orderkey % 12 AS row, l_linenumber + l_orderkey % 9 AS col, max(CASE WHEN l_partkey % 3 = 0 THEN ' ' ELSE l_returnflag END) AS value FROM lineitem GROUP BY 1, 2, 3),
s AS (SELECT l_suppkey, count(DISTINCT row) AS n_rows, max(col + 1)::BIGINT AS n_cols, count(*) FILTER (WHERE trim(value) <> '') AS filled, count(DISTINCT trim(value)) FILTER (WHERE trim(value) <> '') AS diff FROM c GROUP BY l_suppkey),
q AS (SELECT *, filled::DOUBLE / greatest(n_rows * n_cols, 1) AS dn, coalesce(diff::DOUBLE / nullif(filled, 0), 0) AS ur FROM s)
SELECT l_suppkey, n_rows, n_cols, filled, round(dn, 9) AS density, round(ur, 9) AS unique_ratio, least(n_rows, n_cols) >= 2 AND filled >= 4 AND dn >= 0.30 AND NOT (n_cols >= 12 AND dn < 0.45) AND NOT (n_rows >= 8 AND n_cols >= 8 AND dn < 0.55 AND ur < 0.85) AS is_table FROM q""",
    "chart_pivot": """
WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, user_id % 3 AS u, count(*) AS v FROM events GROUP BY 1, 2)
SELECT 'events' AS chart, day, coalesce(max(v::VARCHAR) FILTER (WHERE u = 0), '') AS s0, coalesce(max((v + 0.5)::VARCHAR) FILTER (WHERE u = 1), '') AS s1, coalesce(max(v::VARCHAR) FILTER (WHERE u = 2), '') AS s2 FROM e GROUP BY day""",
    "lengths": """SELECT p_partkey, round_even((p_partkey % 40 + 0.5::DOUBLE) * CASE p_partkey % 6 WHEN 0 THEN 914400 WHEN 1 THEN 360000 WHEN 2 THEN 36000 WHEN 3 THEN 12700 WHEN 4 THEN 9525 END, 0)::BIGINT AS width, (p_partkey % 30) * 12700 AS height FROM part""",
    "colours": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN ((p_partkey*7919 % 16777216) // 65536) || ',' || ((p_partkey*7919 % 65536) // 256) || ',' || (p_partkey*7919 % 256) WHEN 1 THEN '255,255,255' END AS rgb FROM part""",
    "file_sizes": """SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN round_even(n / 1024.0::DOUBLE, 0)::BIGINT || ' KB' WHEN n < 1073741824 THEN round_even(n / 1048576.0::DOUBLE, 0)::BIGINT || ' MB'
  ELSE printf('%.1f GB', n / 1073741824.0::DOUBLE) END AS size FROM (SELECT o_orderkey, o_orderkey*o_orderkey*7 + o_orderkey AS n FROM orders)""",
    "pipe_table": """
WITH n AS (SELECT l_orderkey AS sheet, l_linenumber AS row, max(l_returnflag) AS flag, max(l_partkey) AS part FROM lineitem GROUP BY 1, 2),
w AS (SELECT *, row - lag(row) OVER o AS gap, count(*) OVER (PARTITION BY sheet) AS rows FROM n WINDOW o AS (PARTITION BY sheet ORDER BY row))
SELECT sheet, string_agg(CASE WHEN gap IS NULL THEN '' ELSE repeat('|  |  |' || chr(10), (gap - 1)::INT) END || '| ' || flag || ' | ' || part || ' |'
  || CASE WHEN gap IS NULL THEN chr(10) || CASE WHEN rows > 1 THEN '| --- | ---: |' ELSE '| --- | --- |' END ELSE '' END, chr(10) ORDER BY row) AS markdown FROM w GROUP BY sheet""",
}
