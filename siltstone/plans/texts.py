"""Markdown, subtitle, card and batch queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..operators import checks, layout, text_units
from ..session import shared_folder
from ..sources import textfiles
from .base import Query, table


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def marked_up(spark: SparkSession, d: str) -> DataFrame:
    """Documents with Markdown of every kind put around their whole texts."""
    k, w = F.col("doc_id"), F.col("text")
    text = F.concat(
        F.when(k % 2 == 0, "# Title\n").otherwise(""), w, F.lit("\n\n\n"), F.when(k % 3 == 0, "![a](x/pic.png?v=1) and [b](u)\n").otherwise("| a | b |\n|---|---|\n| 1 | 2 |\n"),
        F.when(k % 5 == 0, "![only](y.jpg)\n").otherwise("  tail  \n"), F.lit("[c](d)"),
    )
    return docs(spark, d).select("doc_id", text.alias("text"))


def md_stats(spark: SparkSession, d: str) -> DataFrame:
    s = md.statistics(F.col("text"))
    return marked_up(spark, d).unionByName(docs(spark, d).select((-F.col("doc_id") - 1).alias("doc_id"), "text")).select("doc_id", s.alias("s")).select("doc_id", "s.*")


def md_line_runs(spark: SparkSession, d: str) -> DataFrame:
    flags = F.transform(F.split("text", "\n", -1), lambda x: x.endswith("."))
    return docs(spark, d).select("doc_id", md.runs(flags).alias("runs"))


def md_blank_collapse(spark: SparkSession, d: str) -> DataFrame:
    return marked_up(spark, d).select("doc_id", md.collapse_blank(F.col("text")).alias("text"))


def md_strip_images(spark: SparkSession, d: str) -> DataFrame:
    return marked_up(spark, d).select("doc_id", md.strip_images(F.col("text")).alias("text"), F.array_join(md.image_names(F.col("text")), ",").alias("images"))


def repeat_first_lines(spark: SparkSession, d: str) -> DataFrame:
    line = F.substring_index("text", "\n", 1)
    total = docs(spark, d).groupBy("source").agg(F.count("*").alias("total"))
    found = docs(spark, d).groupBy("source", line.alias("line")).agg(F.count("*").alias("n"))
    return found.join(total, "source").where(F.col("n") > 0.01 * F.col("total")).select("source", "line", "n")


def dominant_source(spark: SparkSession, d: str) -> DataFrame:
    return layout.dominant(docs(spark, d), "lang", "source", F.length("text"))


def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return text_units.first_of_copies(docs(spark, d).select("doc_id", "text"), "text", "doc_id").select("doc_id")


def slot_batches(spark: SparkSession, d: str) -> DataFrame:
    return text_units.batches(docs(spark, d).select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars")


def slots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = docs(spark, d).select(F.col("doc_id").alias("id"), (F.col("doc_id") % 3).cast("int").alias("tags"))
    k = F.col("doc_id")
    text = F.when(k % 11 == 0, " ").when(k % 3 == 0, "plain").when(k % 3 == 1, "a [t:0] b").otherwise(F.when(k % 7 == 0, "[t:1] [t:0]").otherwise("[t:0] x [t:1]"))
    own = table(spark, d, "labels").select("doc_id", text.alias("translation"))
    more = own.where(k % 13 == 0).unionByName(own.where(k % 17 == 0).select((k + 10_000_000).alias("doc_id"), "translation"))
    return rows, own.unionByName(more).withColumnRenamed("doc_id", "id")


def slot_check(spark: SparkSession, d: str) -> DataFrame:
    return checks.translation_errors(*slots(spark, d))


def slot_missing(spark: SparkSession, d: str) -> DataFrame:
    return checks.missing(*slots(spark, d)).select("id")


def slot_apply(spark: SparkSession, d: str) -> DataFrame:
    rows, translations = slots(spark, d)
    return checks.apply_translations(rows.withColumn("source", F.lit("source")), translations).select("id", "translation")


def slot_completeness(spark: SparkSession, d: str) -> DataFrame:
    out = checks.completeness(*slots(spark, d))
    return out.select("total", "translated", "missing", F.array_join(F.transform("first_missing", lambda x: x.cast("string")), ",").alias("first_missing"))


def translatable_text(spark: SparkSession, d: str) -> DataFrame:
    """All texts, and cases of every kind that isn't translatable with negative ids."""
    cases = spark.createDataFrame([(-1, " 12 -- 3 "), (-2, "https://x.org/a"), (-3, "me@x.org"), (-4, "  "), (-5, "x 1")], "doc_id long, text string")
    return docs(spark, d).select("doc_id", "text").unionByName(cases).select("doc_id", md.is_translatable(F.col("text")).alias("translatable"))


def _srt(spark: SparkSession, d: str) -> DataFrame:
    turn = F.format_string("%02d:00:%02d,000", (F.col("turn") % 100).cast("int"), (F.col("turn") % 60).cast("int"))
    cue = F.concat(F.col("turn").cast("string"), F.lit("\n"), turn, F.lit(" --> 99:00:00,000\n"), F.regexp_replace("text", r"\s+", " "), F.lit("\n7\n"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", cue.alias("cue")))).alias("c"))
    return rows.select("conv_id", F.array_join(F.transform("c", lambda x: x["cue"]), "\n").alias("srt"))


def srt_cues(spark: SparkSession, d: str) -> DataFrame:
    return _srt(spark, d).select("conv_id", F.posexplode(text_units.srt_cues(F.col("srt"))).alias("nth", "c")).select("conv_id", "nth", F.col("c.start").alias("start"), F.col("c.text").alias("text"))


def block_anchors(spark: SparkSession, d: str) -> DataFrame:
    return _srt(spark, d).select("conv_id", text_units.transcript(text_units.srt_cues(F.col("srt")), every=2).alias("transcript"))


def vtt_cues(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("WEBVTT\nKind: captions\n\n"), F.col("srt"))
    cues = _srt(spark, d).select("conv_id", F.posexplode(text_units.vtt_cues(body)).alias("nth", "c"))
    return cues.select("conv_id", "nth", F.col("c.start").alias("start"), F.col("c.text").alias("text"))


def ass_cues(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("Dialogue: 0,0:00:0"), (F.col("turn") % 10).cast("string"), F.lit(".00,0:00:09.00,Default,,0,0,0,,{\\i1}"), F.col("role"), F.lit(",\\N "), F.regexp_replace("text", r"\s+", " "))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))).alias("c"))
    text = F.concat(F.lit("[Script Info]\nTitle: x\n\n[Events]\nFormat: a\n"), F.array_join(F.transform("c", lambda x: x["l"]), "\n"), F.lit("\n[Fonts]\nDialogue: no"))
    cues = rows.select("conv_id", F.posexplode(text_units.ass_cues(text)).alias("nth", "c"))
    return cues.select("conv_id", "nth", F.col("c.start").alias("start"), F.col("c.text").alias("text"))


def qa_cards(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    line = F.when(F.col("role") == "user", F.concat(F.lit("\n---\n**Q**: "), F.regexp_replace("text", r"\s+", " "))).when(F.col("role") == "assistant", F.concat(F.lit("\n**A**: "), F.regexp_replace("text", r"\s+", " "))).otherwise("")
    deck = c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "").alias("deck"))
    cards = deck.select("conv_id", F.posexplode(text_units.cards(F.col("deck"))).alias("nth", "c"))
    return cards.select("conv_id", "nth", F.col("c.question").alias("question"), F.col("c.answer").alias("answer"))


def list_items(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    lead = F.get(F.array(*[F.lit(x) for x in ("• ", "- ", "* ", "12) ", "3、", "")]), (k % 6).cast("int"))
    item = md.list_item(F.concat(lead, F.col("text")))
    return docs(spark, d).select("doc_id", item.alias("i")).select("doc_id", "i.is_list", "i.kind", "i.content")


def page_footers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    tail = F.when(k % 3 == 0, " November 2025 8").when(k % 3 == 1, " 2025年11月 12  ").otherwise(" end 2025 8")
    return docs(spark, d).select("doc_id", md.without_page_footer(F.concat("text", tail)).alias("text"))


def emphasis_runs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    t = md.merge_emphasis(F.concat(md.emphasis(F.col("text"), (k % 32).cast("int")), md.emphasis(F.lit("two"), (k % 32).cast("int"))))
    return docs(spark, d).select("doc_id", t.alias("text"))


def paragraph_merge(spark: SparkSession, d: str) -> DataFrame:
    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("nth", "text")).withColumns({"is_heading": F.col("nth") % 7 == 0, "is_list": F.col("nth") % 11 == 5})
    return layout.paragraphs(lines, ["doc_id"], "nth").select("doc_id", "para", "text")


def written_texts(spark: SparkSession, d: str) -> DataFrame:
    """All documents as titled Markdown files in the shared folder, and what is read back from them."""
    k = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    docs = table(spark, d, "documents").select(F.concat(k, F.lit("-"), F.monotonically_increasing_id(), F.lit(".md")).alias("name"), md.titled(k, F.coalesce("text", F.lit(""))).alias("text"))
    folder = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    textfiles.write_texts(docs, folder)
    number = F.regexp_extract("name", r"^(\d*)-", 1).try_cast("bigint")
    return textfiles.read_texts(spark, folder).select(number.alias("doc_id"), F.length("text").alias("chars"), F.sha2("text", 256).alias("digest"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        md_stats, md_line_runs, md_blank_collapse, md_strip_images, repeat_first_lines, dominant_source, dedup_first, slot_batches, slot_check, slot_missing, slot_apply,
        slot_completeness, translatable_text, srt_cues, block_anchors, vtt_cues, ass_cues, qa_cards, list_items, page_footers, emphasis_runs, paragraph_merge, written_texts,
    )
}

_NL = "chr(10)"
MARKED_UP = """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '# Title' || chr(10) ELSE '' END || text || chr(10) || chr(10) || chr(10)
  || CASE WHEN doc_id % 3 = 0 THEN '![a](x/pic.png?v=1) and [b](u)' || chr(10) ELSE '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |' || chr(10) END
  || CASE WHEN doc_id % 5 = 0 THEN '![only](y.jpg)' || chr(10) ELSE '  tail  ' || chr(10) END || '[c](d)' AS text FROM documents"""
_LABELS = """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN ' ' WHEN doc_id % 3 = 0 THEN 'plain' WHEN doc_id % 3 = 1 THEN 'a [t:0] b'
  WHEN doc_id % 7 = 0 THEN '[t:1] [t:0]' ELSE '[t:0] x [t:1]' END AS translation FROM labels"""
TRANSLATED = f"""WITH own AS ({_LABELS}), tr AS (SELECT doc_id AS id, translation FROM own UNION ALL SELECT doc_id, translation FROM own WHERE doc_id % 13 = 0
  UNION ALL SELECT doc_id + 10000000, translation FROM own WHERE doc_id % 17 = 0)"""
_CUES = """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS nth,
  printf('%02d:00:%02d,000', (turn % 100)::INT, (turn % 60)::INT) AS start, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations"""


def stats_sql(rows: str) -> str:
    """The statistics of rows (doc_id, text) in SQL."""
    return rf"""
WITH t AS ({rows}),
s AS (SELECT doc_id, text, string_split(CASE WHEN ends_with(text, {_NL}) THEN left(text, length(text) - 1) ELSE text END, {_NL}) AS l FROM t),
x AS (SELECT doc_id, j, (starts_with(trim(l[j]), '|') AND ends_with(trim(l[j]), '|')) OR regexp_matches(trim(l[j]), '^\|?\s*:?-{{3,}}:?\s*(\|\s*:?-{{3,}}:?\s*)+\|?$') AS f FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS j FROM s)),
r AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, f, lag(f, 1, false) OVER (PARTITION BY doc_id ORDER BY j) AS p FROM x) WHERE f AND NOT p GROUP BY doc_id)
SELECT s.doc_id, CASE WHEN text = '' THEN 0 ELSE len(l)::INT END AS line_count, length(text)::INT AS char_count,
  len(list_filter(l, lambda y: regexp_matches(y, '^#{{1,6}}\s+')))::INT AS heading_count, coalesce(r.n, 0)::INT AS table_count,
  len(regexp_extract_all(text, '!\[[^\]]*\]\([^)]+\)'))::INT AS image_ref_count,
  len(regexp_extract_all(text, '(?:^|[^!])\[[^\]]+\]\([^)]+\)'))::INT AS link_count
FROM s LEFT JOIN r USING (doc_id)"""


SQL = {
    "written_texts": f"SELECT doc_id, length(t) AS chars, sha256(t) AS digest FROM (SELECT doc_id, '# ' || coalesce(doc_id::VARCHAR, '') || {_NL} || {_NL} || coalesce(text, '') || {_NL} AS t FROM documents)",
    "md_stats": stats_sql(f"{MARKED_UP} UNION ALL SELECT -doc_id - 1, text FROM documents"),
    "md_line_runs": f"""
WITH x AS (SELECT doc_id, j, ends_with(l[j], '.') AS f FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS j FROM (SELECT doc_id, string_split(text, {_NL}) AS l FROM documents)))
SELECT doc_id, (count(*) FILTER (WHERE f AND NOT p))::INT AS runs FROM (SELECT doc_id, f, lag(f, 1, false) OVER (PARTITION BY doc_id ORDER BY j) AS p FROM x) GROUP BY doc_id""",
    "md_blank_collapse": rf"""
WITH x AS (SELECT doc_id, j, regexp_replace(l[j], '\s+$', '') AS y FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS j FROM (SELECT doc_id, string_split(text, {_NL}) AS l FROM ({MARKED_UP})))),
k AS (SELECT doc_id, j, y, lag(y) OVER (PARTITION BY doc_id ORDER BY j) AS p FROM x)
SELECT doc_id, string_agg(y, {_NL} ORDER BY j) AS text FROM k WHERE y <> '' OR p IS NULL OR p <> '' GROUP BY doc_id""",
    "md_strip_images": rf"""
WITH x AS (SELECT doc_id, j, l[j] AS y, regexp_replace(l[j], '!\[[^\]]*\]\([^)]+\)', '', 'g') AS z FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS j FROM (SELECT doc_id, string_split(text, {_NL}) AS l FROM ({MARKED_UP})))),
k AS (SELECT doc_id, regexp_replace(string_agg(z, {_NL} ORDER BY j), '\n{{3,}}', {_NL} || {_NL}, 'g') AS text FROM x WHERE NOT (y <> z AND trim(z) = '') GROUP BY doc_id)
SELECT doc_id, text, array_to_string(list_filter([CASE WHEN doc_id % 3 = 0 THEN 'pic.png' END, CASE WHEN doc_id % 5 = 0 THEN 'y.jpg' END], lambda y: y IS NOT NULL), ',') AS images FROM k""",
    "repeat_first_lines": f"""
WITH l AS (SELECT source, string_split(text, {_NL})[1] AS line FROM documents), t AS (SELECT source, count(*) AS total FROM documents GROUP BY source)
SELECT source, line, n FROM (SELECT source, line, count(*) AS n FROM l GROUP BY source, line) JOIN t USING (source) WHERE n > 0.01 * total""",
    "dominant_source": """
WITH t AS (SELECT lang, source, sum(length(text))::BIGINT AS w FROM documents GROUP BY lang, source)
SELECT lang, arg_min(source, (-w, source)) AS source, max(w) AS weight FROM t GROUP BY lang""",
    "dedup_first": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
    "slot_batches": """
WITH RECURSIVE r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
f AS (SELECT source, doc_id, n_chars, i, 0::BIGINT AS batch, n_chars AS c, 1 AS k FROM r WHERE i = 1
  UNION ALL SELECT r.source, r.doc_id, r.n_chars, r.i,
    CASE WHEN f.c + r.n_chars > 8000 OR f.k >= 20 THEN f.batch + 1 ELSE f.batch END,
    CASE WHEN f.c + r.n_chars > 8000 OR f.k >= 20 THEN r.n_chars ELSE f.c + r.n_chars END,
    CASE WHEN f.c + r.n_chars > 8000 OR f.k >= 20 THEN 1 ELSE f.k + 1 END FROM f JOIN r ON r.source = f.source AND r.i = f.i + 1)
SELECT source, doc_id, n_chars, batch FROM f""",
    "slot_check": f"""{TRANSLATED}
SELECT DISTINCT id, 'unknown' AS error FROM tr WHERE id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT id, 'duplicate' FROM tr GROUP BY id HAVING count(*) > 1
UNION ALL SELECT DISTINCT id, 'blank' FROM tr WHERE trim(translation) = '' AND id IN (SELECT doc_id FROM documents)
UNION ALL SELECT DISTINCT id, 'placeholders' FROM tr WHERE translation = '[t:1] [t:0]' AND id IN (SELECT doc_id FROM documents)""",
    "slot_missing": f"{TRANSLATED} SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT id FROM tr)",
    "slot_apply": f"{TRANSLATED} SELECT doc_id AS id, coalesce((SELECT min(translation) FROM tr WHERE tr.id = doc_id), 'source') AS translation FROM documents",
    "slot_completeness": f"""{TRANSLATED}, m AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT id FROM tr))
SELECT (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM documents) - (SELECT count(*) FROM m) AS translated, (SELECT count(*) FROM m) AS missing,
  (SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM m ORDER BY doc_id LIMIT 20)) AS first_missing""",
    "translatable_text": r"""
SELECT doc_id, s <> '' AND NOT regexp_matches(s, '^[^\pL]+$') AND NOT regexp_matches(s, '^(?:https?://\S+|[\pL\pN_.-]+@[\pL\pN_.-]+)$') AS translatable
FROM (SELECT doc_id, trim(coalesce(text, '')) AS s FROM documents UNION ALL SELECT * FROM (VALUES (-1, '12 -- 3'), (-2, 'https://x.org/a'), (-3, 'me@x.org'), (-4, ''), (-5, 'x 1')))""",
    "srt_cues": f"SELECT conv_id, nth::INT AS nth, start, text FROM ({_CUES}) WHERE text <> ''".replace("\\\\", "\\"),
    "block_anchors": f"""SELECT conv_id, string_agg(CASE WHEN nth % 2 = 0 THEN CASE WHEN nth > 0 THEN {_NL} ELSE '' END || '<!-- Block ' || (nth // 2 + 1)::VARCHAR || ' --> <!-- ' || start || ' -->' || {_NL} || {_NL} ELSE '' END || text, {_NL} ORDER BY nth) AS transcript
FROM ({_CUES}) GROUP BY conv_id""".replace("\\\\", "\\"),
    "vtt_cues": f"SELECT conv_id, nth::INT AS nth, start, text || ' 7' AS text FROM ({_CUES})".replace("\\\\", "\\"),  # numbers are text here
    "ass_cues": "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS nth, '0:00:0' || (turn % 10)::VARCHAR || '.00' AS start, trim(regexp_replace(regexp_replace(role || ',  ' || regexp_replace(text, '\\\\s+', ' ', 'g'), '\\\\{[^}]*\\\\}', '', 'g'), '\\\\s+', ' ', 'g')) AS text FROM conversations".replace("\\\\", "\\"),
    "qa_cards": r"""
WITH c AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations),
n AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS r2, lead(t) OVER (PARTITION BY conv_id ORDER BY turn) AS t2 FROM c)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS nth, t AS question, t2 AS answer FROM n WHERE role = 'user' AND r2 = 'assistant'""",
    "list_items": rf"""
WITH t AS (SELECT doc_id, trim(['• ', '- ', '* ', '12) ', '3、', ''][doc_id % 6 + 1] || text) AS s FROM documents),
k AS (SELECT *, regexp_matches(s, '^(?:[•●○◦▪▸►]\s*|[-–—]\s+|\*\s+)') AS ul, regexp_matches(s, '^(\d+)[.、)]\s*') AS ol FROM t)
SELECT doc_id, ul OR ol AS is_list, CASE WHEN ul THEN 'ul' WHEN ol THEN 'ol' END AS kind,
  CASE WHEN ul THEN '- ' || regexp_replace(s, '^(?:[•●○◦▪▸►]\s*|[-–—]\s+|\*\s+)', '') WHEN ol THEN regexp_replace(s, '^(\d+)[.、)]\s*', '\1. ') ELSE s END AS content FROM k""",
    "page_footers": r"""
SELECT doc_id, rtrim(regexp_replace(regexp_replace(text || [' November 2025 8', ' 2025年11月 12  ', ' end 2025 8'][doc_id % 3 + 1],
  '(?i)\s*(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}\s+\d{1,3}\s*$', ''), '\s*\d{4}年\d{1,2}月\s+\d{1,3}\s*$', '')) AS text FROM documents""",
    "emphasis_runs": r"""
WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS s, CASE WHEN doc_id & 16 <> 0 THEN '**' ELSE '' END || CASE WHEN doc_id & 2 <> 0 THEN '*' ELSE '' END AS m FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(CASE WHEN s = '' THEN '' ELSE m || s || m END || m || 'two' || m, '\*{6}', ' ', 'g'), '\*{4}', ' ', 'g') AS text FROM t""",
    "paragraph_merge": rf"""
WITH x AS (SELECT doc_id, j - 1 AS nth, l[j] AS t FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS j FROM (SELECT doc_id, string_split(text, {_NL}) AS l FROM documents))),
p AS (SELECT *, lag(t) OVER w AS b, nth % 7 = 0 OR nth % 11 = 5 AS sp, coalesce(lag(nth % 7 = 0 OR nth % 11 = 5) OVER w, false) AS bsp FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY nth)),
g AS (SELECT *, b IS NULL OR sp OR bsp OR trim(b) = '' OR regexp_matches(b, '[.。!！?？:：;；]\s*$') AS fresh FROM p),
q AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY nth) AS para FROM g),
SELECT doc_id, para::BIGINT AS para, coalesce(string_agg(nullif(trim(t), ''), ' ' ORDER BY nth), '') AS text FROM q GROUP BY doc_id, para""",
}
