"""Queries of manifests, links, fields, page Markdown, drawings and report forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions import names, shapes
from ..operators import checks, layout, manifests, power
from . import pages, texts
from .base import Query, div, table
from .power import DIAMETER, RHO, curves
from .shapes import boxes, sql_boxes


def md_named_images(spark: SparkSession, d: str) -> DataFrame:
    return texts.marked_up(spark, d).select("doc_id", md.strip_named_images(F.col("text"), F.array(F.lit("y.jpg"), F.lit("z.png"))).alias("text"))


def md_links(spark: SparkSession, d: str) -> DataFrame:
    target = F.concat(F.lit(" "), F.col("url"), F.lit("?q=a b(c)%é~#x "))
    return table(spark, d, "pages").select("page_id", md.link(F.lit("a [b]"), target).alias("link"))


def tsv_fields(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat(F.col("html"), F.lit("\n<pre><code>x\n\ty</code></pre>\r\nend\n"))
    return table(spark, d, "pages").select("page_id", md.tsv_field(html).alias("field"))


def titled_texts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    vectors = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("b.wmf"), F.lit("a.emf"))).otherwise(F.array(F.lit("c.emf")))
    text = md.with_vectors(F.concat("text", F.when(k % 2 == 0, " ![](f/a.emf)\n").otherwise("\n")), F.lit("f"), vectors)
    return table(spark, d, "documents").select("doc_id", md.titled(F.col("source"), text).alias("text"))


def image_manifest(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    ext = F.get(F.array(F.lit(".PNG"), F.lit(".emf"), F.lit(".txt")), (k % 3).cast("int"))
    files = table(spark, d, "part").select(div(k, 10).alias("doc"), F.concat(F.lit("img_"), F.lpad(k.cast("string"), 9, "0"), ext).alias("name"), (k % 7 * 100).cast("int").alias("width"), (50 + k % 5).cast("int").alias("height"))
    first = F.lpad((F.col("doc") * 10).cast("string"), 9, "0")
    text = F.concat(F.lit("see ![](a.b_files/img_"), first, F.lit(".PNG) or ![x](a.b_files/img_"), first, F.lit(".emf), (a.b_files/img%5F"), first, F.lit(".emf) axb_files/img_"), first, F.lit(".emf"))
    documents = files.select("doc").distinct().select("doc", text.alias("text"), F.lit("a.b_files").alias("folder"))
    m = manifests.image_manifest(files, documents, "docx")
    return m.select("doc", "index", "filename", "asset_kind", "source_ext", "pixel_ratio", "usage_count", F.to_json("occurrences").alias("occurrences"))


def picture_manifest(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("ord")).agg(F.max("l_partkey").alias("k"))
    k = F.col("k")
    rows = li.select(
        "doc", "ord", F.col("ord").alias("slide"), F.concat(F.lit("Picture "), F.col("ord").cast("string")).alias("shape"), (k % 3).cast("string").alias("hash"), F.when(k % 3 == 2, "emf").otherwise("jpe").alias("ext"),
        F.lit("image/x").alias("content_type"), (100 + k % 3).cast("int").alias("pixel_width"), F.lit(50).alias("pixel_height"), F.lit(0).alias("left"), F.lit(0).alias("top"), (k * 914).cast("bigint").alias("width"), F.lit(914400).cast("bigint").alias("height"),
    )
    m = manifests.picture_manifest(rows)
    places = F.transform("occurrences", lambda o: F.concat(o["slide_index"].cast("string"), F.lit(":"), F.when(o["display_width_in"].isNotNull(), F.format_string("%.4f", o["display_width_in"])).otherwise("")))
    return m.select("doc", "index", "filename", "asset_kind", "pixel_ratio", "usage_count", F.array_join(places, ",").alias("places"))


def page_markdown(spark: SparkSession, d: str) -> DataFrame:
    nth = F.col("nth")
    kind = F.when(nth % 7 == 0, "heading").when(nth % 11 == 5, "list").when(nth % 5 >= 3, "code").when(nth % 4 == 1, "list").otherwise("text")
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("nth", "content"))
    return layout.page_markdown(lines.withColumn("kind", kind), ["doc_id"], "nth")


def vector_rects(spark: SparkSession, d: str) -> DataFrame:
    """Drawings over no table and no image of their page, and whether text lines dominate them."""
    drawings = boxes(spark, d, "customer", "c_custkey", 13)
    lines = layout.lines_within(drawings, boxes(spark, d, "part", "p_partkey", 17), ["page"], "id", 0.3).select("id", "lines")
    tables, images = (boxes(spark, d, n, k, m).groupBy("page").agg(F.collect_list("bbox").alias(c)) for n, k, m, c in (("part", "p_partkey", 17, "tables"), ("supplier", "s_suppkey", 29, "images")))
    none = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    rows = drawings.join(tables, "page", "left").join(images, "page", "left").join(lines, "id")
    page = shapes.rect(F.lit(0), F.lit(0), F.lit(120), F.lit(800))
    keep = shapes.keep_vector(F.col("bbox"), page, F.coalesce("tables", none), F.coalesce("images", none), filtered=True)
    return rows.select("id", keep.alias("keep"), shapes.text_dominant(F.col("lines") + 4, F.col("bbox"), shapes.rect(F.lit(0), F.lit(0), F.lit(120), F.lit(500))).alias("text_dominant"))


def image_rules(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    w, h, n = (50 + k * 37 % 1500).cast("int"), (60 + k * 53 % 900).cast("int"), 500 + k * 7919 % 90000
    drawn, page = shapes.rect(F.lit(0), F.lit(0), w / 20, h / 30), shapes.rect(F.lit(0), F.lit(0), F.lit(600), F.lit(800))
    unread = F.when(k % 4 > 0, w)
    return table(spark, d, "part").select("p_partkey", shapes.image_kept(w, h, n, drawn, page).alias("in_page"), shapes.picture_kept(unread, h, n, (w / 20, h / 30), (F.lit(600), F.lit(800))).alias("in_slide"))


def measures(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    ext = F.get(F.array(F.lit(""), F.lit("JPE"), F.lit(".PNG"), F.lit("Gif")), (k % 4).cast("int"))
    raw = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, "12x")
    return table(spark, d, "part").select("p_partkey", names.normal_suffix(ext).alias("suffix"), shapes.inches(k * 1000).alias("inches"), shapes.ratio(k, k % 7).alias("ratio"), shapes.safe_position(raw).alias("position"))


def part_paths(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    target = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("../media/img%20"), k, F.lit("+1.png"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("/word/./x/"), k)).otherwise(F.concat(F.lit("media/a/../"), k))
    hashes = F.create_map(F.concat(F.lit("word/media/"), k), F.lit("hash"))
    return table(spark, d, "part").select("p_partkey", names.part_path(target).alias("path"), names.target_hash(hashes, target).alias("hash"))


def output_formats(spark: SparkSession, d: str) -> DataFrame:
    return pages.paths(spark, d).select("id", power.output_format(F.col("path"), F.when(F.length("path") % 4 == 0, "csv")).alias("format"))


def mask_files(spark: SparkSession, d: str) -> DataFrame:
    return manifests.mask_files(table(spark, d, "documents").select(F.col("source").alias("file")))


def slot_accept(spark: SparkSession, d: str) -> DataFrame:
    return checks.accepted(*texts.slots(spark, d))


def cp_json(spark: SparkSession, d: str) -> DataFrame:
    report = power.json_report(power.curve_points(curves(spark, d), RHO, DIAMETER), "l_partkey", "ord")
    r = F.from_json("json", "summary struct<row_count:bigint,cp_max:double,cp_max_ct:double>, points array<struct<wind_speed_ms:double,power_kw:double,ct:double,theoretical_power_kw:double,cp:double>>")
    rows = report.select("l_partkey", r.alias("r"))
    point = F.posexplode("r.points").alias("nth", "p")
    rows = rows.select("l_partkey", F.col("r.summary.row_count").alias("row_count"), F.round("r.summary.cp_max", 9).alias("cp_max"), point)
    return rows.select("l_partkey", "row_count", "cp_max", "nth", F.col("p.wind_speed_ms").alias("wind"), F.col("p.power_kw").alias("power"), F.round("p.cp", 9).alias("cp"))


def cp_full_report(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: numbers as ``%g``; the tests have a plain version."""
    return power.full_report(power.curve_points(curves(spark, d), RHO, DIAMETER), "l_partkey", "ord", RHO, DIAMETER)


def workbook_room(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("wind"))
    return power.beyond_workbook(li, "l_suppkey")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        md_named_images, md_links, tsv_fields, titled_texts, image_manifest, picture_manifest, page_markdown, vector_rects, image_rules, measures, part_paths, output_formats, mask_files, slot_accept,
        cp_json, cp_full_report, workbook_room,
    )
}

_ENCODED = "url_encode(url || '?q=a b(c)%é~#x')"
for _c in md.TARGET_SAFE:
    _ENCODED = f"replace({_ENCODED}, '%{ord(_c):02X}', '{_c * 2 if _c == chr(39) else _c}')"
_IN = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
SQL = {
    "md_named_images": rf"SELECT doc_id, regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> '![only](y.jpg)'), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g') AS text FROM ({texts.MARKED_UP})",
    "md_links": rf"SELECT page_id, '[a \[b\]](' || {_ENCODED} || ')' AS link FROM pages",
    "tsv_fields": r"""SELECT page_id, regexp_replace(replace(regexp_replace(html, '\r\n|\r|\n', ' ', 'g') || ' <pre><code>x<br>' || chr(9) || 'y</code></pre> end', chr(9), '    '), '^\s+|\s+$', '', 'g') AS field FROM pages""",
    "titled_texts": r"""
WITH t AS (SELECT doc_id, source, text || CASE WHEN doc_id % 2 = 0 THEN ' ![](f/a.emf)' ELSE '' END || chr(10) AS x, CASE doc_id % 3 WHEN 0 THEN [] WHEN 2 THEN ['![Office vector 1](f/c.emf)']
  ELSE CASE WHEN doc_id % 2 = 0 THEN ['![Office vector 2](f/b.wmf)'] ELSE ['![Office vector 1](f/a.emf)', '![Office vector 2](f/b.wmf)'] END END AS v FROM documents)
SELECT doc_id, '# ' || source || chr(10) || chr(10) || CASE WHEN len(v) = 0 THEN x ELSE regexp_replace(x, '\s+$', '') || chr(10) || chr(10) || '## Extracted Office Vector Assets' || chr(10) || chr(10) || array_to_string(v, chr(10) || chr(10)) || chr(10) END || chr(10) AS text FROM t""",
    "image_manifest": """
WITH f AS (SELECT p_partkey AS k, p_partkey // 10 AS doc, 'img_' || lpad(p_partkey::VARCHAR, 9, '0') || ['.PNG', '.emf', '.txt'][p_partkey % 3 + 1] AS name FROM part),
i AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY name) AS index, k % 10 = 0 AS first, 'a.b_files/img_' || lpad(k::VARCHAR, 9, '0') AS ref FROM f WHERE k % 3 < 2)
SELECT doc, index::INT AS index, name AS filename, CASE WHEN k % 3 = 1 THEN 'office_vector' ELSE 'bitmap' END AS asset_kind, CASE WHEN k % 3 = 1 THEN '.emf' ELSE '.png' END AS source_ext,
  CASE WHEN k % 7 > 0 THEN round((k % 7 * 100) / (50 + k % 5)::DOUBLE, 6) END AS pixel_ratio, CASE WHEN first AND k % 3 = 1 THEN 2 ELSE 1 END AS usage_count,
  CASE WHEN NOT first THEN '[]' WHEN k % 3 = 0 THEN '[{"occurrence_index":1,"source_ref":"' || ref || '.PNG"}]'
    ELSE '[{"occurrence_index":2,"source_ref":"' || ref || '.emf"},{"occurrence_index":3,"source_ref":"' || replace(ref, 'img_', 'img%5F') || '.emf"}]' END AS occurrences FROM i""",
    "picture_manifest": """
WITH l AS (SELECT l_orderkey AS doc, l_linenumber AS ord, max(l_partkey) AS k FROM lineitem GROUP BY 1, 2),
g AS (SELECT doc, k % 3 AS h, min(ord) AS ord, count(*) AS n, string_agg(ord || ':' || CASE WHEN k > 0 THEN printf('%.4f', round_even(k * 914 / 914400.0::DOUBLE, 4)) ELSE '' END, ',' ORDER BY ord) AS places FROM l GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY ord) AS index FROM g)
SELECT doc, index::INT AS index, 'slide_' || lpad(ord::VARCHAR, 3, '0') || '_image_' || lpad(index::VARCHAR, 3, '0') || CASE WHEN h = 2 THEN '.emf' ELSE '.jpg' END AS filename, CASE WHEN h = 2 THEN 'office_vector' ELSE 'bitmap' END AS asset_kind,
  round((100 + h) / 50.0::DOUBLE, 6) AS pixel_ratio, n AS usage_count, places FROM r""",
    "page_markdown": """
WITH x AS (SELECT doc_id, j - 1 AS nth, l[j] AS t FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS j FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
k AS (SELECT *, CASE WHEN nth % 7 = 0 THEN 'heading' WHEN nth % 11 = 5 THEN 'list' WHEN nth % 5 >= 3 THEN 'code' WHEN nth % 4 = 1 THEN 'list' ELSE 'text' END AS kind FROM x),
n AS (SELECT *, coalesce(lag(kind) OVER w, '') AS p, coalesce(lead(kind) OVER w, '') AS q FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY nth))
SELECT doc_id, string_agg(CASE WHEN p = 'list' AND kind <> 'list' THEN chr(10) ELSE '' END || CASE WHEN kind = 'code' THEN CASE WHEN p <> 'code' THEN '```' || chr(10) ELSE '' END || t || chr(10) || CASE WHEN q <> 'code' THEN '```' || chr(10) || chr(10) ELSE '' END
  WHEN kind = 'list' THEN t || chr(10) ELSE t || chr(10) || chr(10) END, '' ORDER BY nth) AS markdown FROM n GROUP BY doc_id""",
    "vector_rects": f"""
WITH a AS ({sql_boxes('customer', 'c_custkey', 13)}), t AS ({sql_boxes('part', 'p_partkey', 17)}), i AS ({sql_boxes('supplier', 's_suppkey', 29)}),
b AS (SELECT page, x0, y0, x1, y1, true AS is_table FROM t UNION ALL SELECT page, x0, y0, x1, y1, false FROM i),
p AS (SELECT a.id, count(*) FILTER (WHERE {_IN} > 0.6 * (a.x1 - a.x0) * (a.y1 - a.y0)) AS covers, count(*) FILTER (WHERE is_table AND {_IN} / ((b.x1 - b.x0) * (b.y1 - b.y0)) > 0.3) AS lines FROM a JOIN b USING (page) GROUP BY a.id),
s AS (SELECT a.id, a.x1 - a.x0 AS w, a.y1 - a.y0 AS h, coalesce(covers, 0) AS covers, coalesce(lines, 0) AS lines FROM a LEFT JOIN p USING (id))
SELECT id, w >= 72 AND h >= 36 AND w * h >= 3000 AND covers = 0 AND NOT (w / 120 < 0.08 AND h / 800 < 0.08) AS keep, lines + 4 >= 6 AND w / 120 > 0.55 AND h / 500 > 0.12 AS text_dominant FROM s""",
    "image_rules": """
WITH i AS (SELECT p_partkey, 50 + p_partkey*37 % 1500 AS w, 60 + p_partkey*53 % 900 AS h, 500 + p_partkey*7919 % 90000 AS n FROM part),
k AS (SELECT *, least(w, h) >= 100 AND w*h >= 30000 AND n >= 2048 AND greatest(w, h)::DOUBLE / least(w, h) <= 12 AND NOT (n::DOUBLE / (w*h) < 0.08 AND w*h < 500000) AND NOT (w / 20.0::DOUBLE / 600 < 0.05 AND h / 30.0::DOUBLE / 800 < 0.05) AS ok FROM i)
SELECT p_partkey, ok AS in_page, CASE WHEN p_partkey % 4 = 0 THEN n >= 2048 ELSE ok END AS in_slide FROM k""",
    "measures": """SELECT p_partkey, ['.bin', '.jpg', '.png', '.gif'][p_partkey % 4 + 1] AS suffix, CASE WHEN p_partkey > 0 THEN round_even(p_partkey * 1000 / 914400.0::DOUBLE, 4) END AS inches,
  CASE WHEN p_partkey % 7 > 0 THEN round_even(p_partkey / (p_partkey % 7)::DOUBLE, 6) END AS ratio, CASE WHEN p_partkey % 3 = 0 THEN p_partkey ELSE 0 END AS position FROM part""",
    "part_paths": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'media/img ' || p_partkey || '+1.png' WHEN 1 THEN 'word/x/' || p_partkey ELSE 'word/media/' || p_partkey END AS path,
  CASE WHEN p_partkey % 3 = 2 THEN 'hash' END AS hash FROM part""",
    "output_formats": f"""
WITH p AS (SELECT id, stem || ext AS path, CASE WHEN ext = '.json' THEN 'json' ELSE 'markdown' END AS f FROM ({pages.PATHS})
  UNION ALL SELECT 'u' || page_id, url, CASE WHEN regexp_matches(lower(url), '[^/.][^/]*\\.csv$') THEN 'csv' WHEN regexp_matches(lower(url), '[^/.][^/]*\\.json$') THEN 'json' ELSE 'markdown' END FROM pages)
SELECT id, CASE WHEN length(path) % 4 = 0 THEN 'csv' ELSE f END AS format FROM p""".replace("\\\\", "\\"),
    "mask_files": "SELECT DISTINCT source AS file FROM documents WHERE source IS NOT NULL",
    "slot_accept": f"{texts.TRANSLATED} SELECT id, translation FROM tr WHERE id IN (SELECT doc_id FROM documents) AND trim(translation) <> '' AND translation <> '[t:1] [t:0]'",
    "cp_json": """
WITH p AS (SELECT l_partkey, l_orderkey * 100 + l_linenumber AS ord, l_quantity - 1 AS wind, l_extendedprice / 100 AS power,
  0.5 * 1.02::DOUBLE * (l_quantity - 1) * (l_quantity - 1) * (l_quantity - 1) * (pi() * 220.0::DOUBLE * 220.0::DOUBLE / 4) / 1000 AS pw FROM lineitem WHERE l_quantity > 1)
SELECT l_partkey, count(*) OVER (PARTITION BY l_partkey) AS row_count, round(max(power / pw) OVER (PARTITION BY l_partkey), 9) AS cp_max,
  (row_number() OVER (PARTITION BY l_partkey ORDER BY ord, wind, power) - 1)::INT AS nth, wind, power, round(power / pw, 9) AS cp FROM p""",
    "workbook_room": "SELECT l_suppkey, count(*) AS rows FROM lineitem GROUP BY l_suppkey HAVING count(*) > 100",
}
