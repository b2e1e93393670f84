"""Web page, naming and route queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, profiles
from ..operators import checks
from ..operators.free_names import unique_names
from ..sources import html_tree
from .base import Query, table
from .texts import stats_sql


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")


def html_title(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", names.clean_title(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"))


def html_strip(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("html")
    for tag in ("head", "style", "script", "noscript"):
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "")
    return pages(spark, d).select("page_id", F.length(text).alias("chars"), F.md5(text).alias("digest"))


def html_link_count(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", F.regexp_count("html", F.lit(r"(?i)<a\s[^>]*href=")).alias("links"))


def html_meta_dates(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts")
    url = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("https://x.org/"), F.date_format(ts, "yyyyMM"), F.lit("/t20_1.html"))).otherwise(F.concat(F.lit("https://x.org/a/"), F.date_format(ts, "yyyy-MM-dd"), F.lit(".html")))
    return table(spark, d, "events").select("event_id", names.url_date(url).alias("date"))


def safe_filename(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", names.safe_name(F.col("text")).alias("name"))


def url_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return pages(spark, d).select("page_id", names.is_url(u).alias("is_url"), names.url_host(u).alias("host"), names.url_path(u).alias("path"), names.suffix(names.url_path(u)).alias("suffix"))


def paths(spark: SparkSession, d: str) -> DataFrame:
    ends = ".pdf .SRT .xlsx .pptx .docx .md .txt .json .png .epub .ipynb .log".split()
    k = F.col("p_partkey")
    name = F.concat(F.lit("in/"), F.when(k % 31 == 0, ".").otherwise(""), F.lit("part_"), k.cast("string"), F.get(F.array(*[F.lit(e) for e in ends]), (k % 12).cast("int")))
    return table(spark, d, "part").select(F.concat(F.lit("p"), k.cast("string")).alias("id"), name.alias("path")).unionByName(pages(spark, d).select(F.concat(F.lit("u"), F.col("page_id").cast("string")).alias("id"), F.col("url").alias("path")))


def route_detect(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return paths(spark, d).select("id", names.source_type(p).alias("kind"), names.is_directory_item(p).alias("taken"), names.route(p, F.when(F.length(p) % 5 == 0, "sub").otherwise("auto")).alias("route"), names.coordinate_format(p, F.lit(None).cast("string")).alias("coordinates"))


def output_names(spark: SparkSession, d: str) -> DataFrame:
    p = names.markdown_path(F.col("path"))
    return paths(spark, d).select("id", p.alias("markdown"), names.asset_folder(p).alias("assets"), names.profile_path(p).alias("profile"))


def page_names(spark: SparkSession, d: str) -> DataFrame:
    """Names by the pages' titles; every second page does without, and every tenth without a URL, too."""
    k = F.col("page_id")
    title = F.when(k % 2 == 0, "").otherwise(names.clean_title(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)))
    return pages(spark, d).select("page_id", names.page_name(title, F.when(k % 10 == 0, "").otherwise(F.col("url")), k).alias("name"))


def image_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    url = F.concat(F.lit("https://x.org/i/"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("pic "), k.cast("string"))), F.get(F.array(F.lit(""), F.lit(".png"), F.lit(".jpeg?v=2"), F.lit(".toolong")), (k % 4).cast("int")))
    kind = F.get(F.array(F.lit("image/webp; q=1"), F.lit("image/gif"), F.lit("text/plain")), (k % 3).cast("int"))
    return table(spark, d, "part").select("p_partkey", names.image_name(url, k, kind).alias("name"))


def natural_order(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.concat(F.lit("Ch"), (k % 120).cast("string"), F.lit("-"), (k % 7).cast("string"), F.lit(".srt"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(names.natural_key(name), "|").alias("sort_key"))


def unique_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = pages(spark, d).select("page_id", F.substring_index(names.url_host(F.col("url")), ".", -1).alias("folder"), F.substring_index(names.url_host(F.col("url")), ".", 1).alias("stem"))
    return unique_names(rows, "folder", "stem", "page_id").select("page_id", "folder", "name")


def free_names(spark: SparkSession, d: str) -> DataFrame:
    """Stems that are numbered forms of other stems, which compete with them for names."""
    k = F.col("doc_id")
    stem = F.when(k % 3 == 0, "doc").when(k % 3 == 1, F.concat(F.lit("doc_"), (2 + k % 40).cast("string"))).otherwise(F.concat(F.lit("doc_2_"), (k % 10).cast("string")))
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("folder"), stem.alias("stem"))
    return unique_names(rows, "folder", "stem", "doc_id").select("doc_id", "folder", "name")


def asset_refs(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "part").select(F.concat(F.lit("img_"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("name"))
    refs = table(spark, d, "documents").select(F.concat(F.lit("img_"), F.floor(F.col("doc_id") / 4).cast("string"), F.lit(".png")).alias("name"), F.col("doc_id").alias("ord"))
    uses = checks.asset_uses(files, refs)
    return uses.select("name", "usage_count", F.array_join(F.transform("occurrences", lambda x: x.cast("string")), ",").alias("places"))


def unlisted_assets(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "part").select(F.concat(F.lit("img_"), F.col("p_partkey").cast("string")).alias("name"))
    manifest = table(spark, d, "documents").select(F.concat(F.lit("img_"), F.col("doc_id").cast("string")).alias("name"))
    return checks.unlisted(files, manifest)


def spine_documents(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    spine = li.select(F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("i"), (F.col("l_partkey") % 50).cast("string")).alias("idref"))
    items = li.select(F.col("l_orderkey").alias("book"), F.concat(F.lit("i"), (F.col("l_partkey") % 50).cast("string")).alias("id"), F.concat(F.lit("t/"), (F.col("l_partkey") % 50).cast("string"), F.lit(".xhtml")).alias("href")).where(F.col("l_partkey") % 3 != 0).distinct()
    return checks.spine_documents(spine, items)


def first_candidates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    tried = F.array(*[F.concat(F.lit(p), (k % m).cast("string")) for p, m in (("a/", 97), ("b/", 89), ("c/", 83))])
    have = table(spark, d, "supplier").select(F.concat(F.when(F.col("s_suppkey") % 2 == 0, "b/").otherwise("c/"), F.col("s_suppkey").cast("string")).alias("path"))
    return checks.first_candidate(table(spark, d, "customer").select("c_custkey", tried.alias("tried")), have, "c_custkey", "tried").select("c_custkey", "found")


def batch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "failed").otherwise("skipped")
    return checks.outcomes(table(spark, d, "orders").select("o_orderpriority", status.alias("status")), "o_orderpriority")


def merged_options(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    base = F.create_map(F.lit("size"), F.lit("12"), F.lit("fill"), F.lit("white"))
    own = F.when(k % 2 == 0, F.create_map(F.lit("fill"), k.cast("string"))).otherwise(F.create_map(F.lit("text"), F.lit("x")))
    m = checks.merged_options(base, own)
    return table(spark, d, "part").select("p_partkey", *[F.try_element_at(m, F.lit(n)).alias(n) for n in ("size", "fill", "text")])


def meta_map(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_shipdate"))).alias("x"))
    m = checks.last_values(F.col("x.l_returnflag"), F.col("x.l_linenumber"))
    return rows.select("l_orderkey", *[F.try_element_at(m, F.lit(f)).alias(f"last_{f.lower()}") for f in "ANR"])


def conversion_profiles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("in/doc_"), F.col("doc_id").cast("string"), F.lit(".html")).alias("path"), F.concat("text", F.lit("\n# T\n\n[a](b)\n")).alias("text"), "n_chars")
    return rows.select("doc_id", F.to_json(profiles.profile(F.col("path"), F.col("n_chars"), F.col("text"))).alias("profile"))


def point_lines(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    lon, lat = 100 + k / 8.0, 30 + k / 16.0
    return table(spark, d, "customer").select("c_custkey", profiles.point_text(lon, lat, "text", 4).alias("text"), profiles.point_text(lon, lat, "csv", 2, True).alias("csv"))


def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", html_tree.html_to_text("html").alias("text"))


def html_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", html_tree.html_to_markdown("html").alias("markdown"))


def html_main_content(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", html_tree.html_main_content("html").alias("markdown"))


def html_metadata(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).withColumn("m", html_tree.html_metadata("html", "url")).select("page_id", "m.*")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        html_title, html_strip, html_link_count, html_meta_dates, safe_filename, url_parts, route_detect, output_names, page_names, image_names, natural_order, unique_paths, free_names,
        asset_refs, unlisted_assets, spine_documents, first_candidates, batch_outcomes, merged_options, meta_map, conversion_profiles, point_lines, html_to_text, html_to_markdown, html_main_content, html_metadata,
    )
}

_SAFE = r"left(regexp_replace(regexp_replace(regexp_replace({}, '\s+', '_', 'g'), '[^\x{{4e00}}-\x{{9fa5}}a-zA-Z0-9_]', '', 'g'), '_+', '_', 'g'), 80)"
PATHS = """SELECT 'p' || p_partkey AS id, 'in/' || CASE WHEN p_partkey % 31 = 0 THEN '.' ELSE '' END || 'part_' || p_partkey AS stem,
  ['.pdf', '.SRT', '.xlsx', '.pptx', '.docx', '.md', '.txt', '.json', '.png', '.epub', '.ipynb', '.log'][p_partkey % 12 + 1] AS ext, p_partkey AS k FROM part"""
_HOST = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"
_PATH = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
SQL = {
    "html_title": r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[-_|].*?(政府|门户|网站|委员会).*$', '')) AS title FROM pages",
    "html_strip": r"""SELECT page_id, length(t)::INT AS chars, md5(t) AS digest FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<head\b[^>]*>.*?</head>', '', 'g'), '(?is)<style\b[^>]*>.*?</style>', '', 'g'), '(?is)<script\b[^>]*>.*?</script>', '', 'g'), '(?is)<noscript\b[^>]*>.*?</noscript>', '', 'g') AS t FROM pages)""",
    "html_link_count": r"SELECT page_id, len(regexp_extract_all(html, '(?i)<a\s[^>]*href='))::INT AS links FROM pages",
    "html_meta_dates": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m') ELSE strftime(ts, '%Y-%m-%d') END AS date FROM events",
    "safe_filename": f"SELECT doc_id, {_SAFE.format('text')} AS name FROM documents",
    "url_parts": rf"SELECT page_id, regexp_matches(url, '^https?://[^/?#]+') AS is_url, {_HOST} AS host, {_PATH} AS path, lower(regexp_extract(regexp_extract({_PATH}, '([^/]*)$', 1), '^.+(\.[^.]+)$', 1)) AS suffix FROM pages",
    "route_detect": f"""
WITH p AS (SELECT id, stem || ext AS path, CASE WHEN k % 31 = 0 THEN false ELSE ext NOT IN ('.json', '.log', '.png') END AS taken,
    CASE k % 12 WHEN 0 THEN 'pdf' WHEN 1 THEN 'subtitle' WHEN 2 THEN 'excel' WHEN 3 THEN 'pptx' WHEN 4 THEN 'doc' WHEN 5 THEN 'markdown' WHEN 6 THEN 'text'
      WHEN 9 THEN 'doc' WHEN 10 THEN 'doc' ELSE 'unknown' END AS kind, CASE WHEN k % 12 = 7 THEN 'geojson' END AS coordinates FROM ({PATHS})),
u AS (SELECT 'u' || page_id AS id, url AS path, {_PATH} AS up FROM pages),
a AS (SELECT id, path, taken, kind, coordinates FROM p UNION ALL SELECT id, path, false, CASE WHEN lower(up) LIKE '%_.pdf' THEN 'pdf' ELSE 'web' END, NULL FROM u)
SELECT id, kind, taken, CASE WHEN length(path) % 5 = 0 THEN 'subtitle' ELSE kind END AS route, coordinates FROM a""",
    "output_names": rf"""
WITH u AS (SELECT 'u' || page_id AS id, regexp_extract(url, '^(.*/)?[^/]*$', 1) AS dir, regexp_extract(url, '([^/]*)$', 1) AS base FROM pages),
s AS (SELECT id, stem FROM ({PATHS}) UNION ALL SELECT id, dir || CASE WHEN regexp_matches(base, '^.+\.[^.]+$') THEN regexp_extract(base, '^(.+)\.[^.]+$', 1) ELSE base END FROM u)
SELECT id, stem || '.md' AS markdown, stem || '_files' AS assets, stem || '.conversion_profile.json' AS profile FROM s""",
    "page_names": rf"""
WITH p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '' ELSE trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[-_|].*?(政府|门户|网站|委员会).*$', '')) END AS title, CASE WHEN page_id % 10 = 0 THEN '' ELSE url END AS url FROM pages)
SELECT page_id, coalesce(nullif({_SAFE.format('title')}, ''), nullif({_SAFE.format(f'''{_HOST} || CASE WHEN trim({_PATH}, '/') <> '' THEN '_' || trim({_PATH}, '/') ELSE '' END''')}, ''), 'untitled_' || page_id) AS name FROM p""",
    "image_names": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'image_' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.webp' WHEN 1 THEN '.gif' ELSE '.jpg' END
  WHEN 1 THEN 'pic_' || p_partkey || '.png' WHEN 2 THEN 'pic_' || p_partkey || '.jpeg' ELSE 'pic_' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.webp' WHEN 1 THEN '.gif' ELSE '.jpg' END END AS name FROM part""",
    "natural_order": "SELECT c_custkey, 'ch|' || lpad((c_custkey % 120)::VARCHAR, 20, '0') || '|-|' || lpad((c_custkey % 7)::VARCHAR, 20, '0') || '|.srt' AS sort_key FROM customer",
    "unique_paths": f"""SELECT page_id, folder, stem || CASE WHEN n = 1 THEN '' ELSE '_' || n END || '.md' AS name FROM (
  SELECT page_id, folder, stem, row_number() OVER (PARTITION BY folder, stem ORDER BY page_id) AS n FROM (
    SELECT page_id, string_split({_HOST}, '.')[-1] AS folder, string_split({_HOST}, '.')[1] AS stem FROM pages))""",
    "free_names": """
WITH RECURSIVE d AS (SELECT doc_id, source AS folder, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i,
  CASE doc_id % 3 WHEN 0 THEN 'doc' WHEN 1 THEN 'doc_' || (2 + doc_id % 40) ELSE 'doc_2_' || (doc_id % 10) END AS stem FROM documents),
g(folder, i, used, doc_id, name) AS (
  SELECT DISTINCT folder, 0::BIGINT, []::VARCHAR[], NULL::BIGINT, NULL::VARCHAR FROM d
  UNION ALL SELECT folder, i, list_append(used, name), doc_id, name FROM (
    SELECT d.folder, d.i, g.used, d.doc_id, list_filter(list_transform(range(1, len(g.used) + 2), lambda n: d.stem || CASE WHEN n = 1 THEN '' ELSE '_' || n END), lambda x: NOT list_contains(g.used, x))[1] AS name
    FROM g JOIN d ON d.folder IS NOT DISTINCT FROM g.folder AND d.i = g.i + 1))
SELECT doc_id, folder, name || '.md' AS name FROM g WHERE i > 0""",
    "asset_refs": """
WITH r AS (SELECT 'img_' || (doc_id // 4) || '.png' AS name, doc_id FROM documents),
u AS (SELECT name, count(*) AS n, array_to_string(list(doc_id ORDER BY doc_id), ',') AS p FROM r GROUP BY name)
SELECT 'img_' || p_partkey || '.png' AS name, coalesce(n, 0) AS usage_count, coalesce(p, '') AS places FROM part LEFT JOIN u ON u.name = 'img_' || p_partkey || '.png'""",
    "unlisted_assets": "SELECT 'img_' || p_partkey AS name FROM part WHERE p_partkey NOT IN (SELECT doc_id FROM documents)",
    "spine_documents": "SELECT l_orderkey AS book, 't/' || (l_partkey % 50) || '.xhtml' AS href, min(l_linenumber) AS ord FROM lineitem WHERE (l_orderkey, l_partkey % 50) IN (SELECT (l_orderkey, l_partkey % 50) FROM lineitem WHERE l_partkey % 3 <> 0) GROUP BY 1, 2",
    "first_candidates": """
WITH h AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'b/' ELSE 'c/' END || s_suppkey AS path FROM supplier)
SELECT c_custkey, CASE WHEN 'a/' || (c_custkey % 97) IN (SELECT path FROM h) THEN 'a/' || (c_custkey % 97) WHEN 'b/' || (c_custkey % 89) IN (SELECT path FROM h) THEN 'b/' || (c_custkey % 89)
  WHEN 'c/' || (c_custkey % 83) IN (SELECT path FROM h) THEN 'c/' || (c_custkey % 83) END AS found FROM customer""",
    "batch_outcomes": """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS success, count(*) FILTER (WHERE o_orderstatus = 'O') AS failed,
  count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS skipped FROM orders GROUP BY o_orderpriority""",
    "merged_options": "SELECT p_partkey, '12' AS size, CASE WHEN p_partkey % 2 = 0 THEN p_partkey::VARCHAR ELSE 'white' END AS fill, CASE WHEN p_partkey % 2 = 1 THEN 'x' END AS text FROM part",
    "conversion_profiles": """SELECT doc_id, '{"schema":"markdown-conversion.conversion_profile.v1","source":{"path":"in/doc_' || doc_id || '.html","name":"doc_' || doc_id || '.html","suffix":".html","type":"doc","size_bytes":' || n_chars
  || '},"outputs":{"markdown":"in/doc_' || doc_id || '.md","assets":"in/doc_' || doc_id || '_files","profile":"in/doc_' || doc_id || '.conversion_profile.json"},"markdown":{"line_count":' || line_count || ',"char_count":' || char_count || ',"heading_count":' || heading_count || ',"table_count":' || table_count || ',"image_ref_count":' || image_ref_count || ',"link_count":' || link_count || '},"warnings":[]}' AS profile
FROM documents JOIN (""" + stats_sql("SELECT doc_id, text || chr(10) || '# T' || chr(10) || chr(10) || '[a](b)' || chr(10) AS text FROM documents") + ") USING (doc_id)",
    "point_lines": "SELECT c_custkey, printf('%.4f,%.4f', 100 + c_custkey / 8.0::DOUBLE, 30 + c_custkey / 16.0::DOUBLE) AS text, printf('%.2f,%.2f', round_even(30 + c_custkey / 16.0::DOUBLE, 2), round_even(100 + c_custkey / 8.0::DOUBLE, 2)) AS csv FROM customer",
    "meta_map": """SELECT l_orderkey, max(l_linenumber) FILTER (WHERE l_returnflag = 'A') AS last_a, max(l_linenumber) FILTER (WHERE l_returnflag = 'N') AS last_n,
  max(l_linenumber) FILTER (WHERE l_returnflag = 'R') AS last_r FROM lineitem GROUP BY l_orderkey""",
}
