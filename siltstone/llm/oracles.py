"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_W = r"[^\x20\x09-\x0D]+"

OP7 = r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rhost, rpath, rverdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
blocked(bhost) AS (VALUES ('adult-x.example.com'), ('ads-track.example.com'), ('casino-win.example.net'),
  ('cheap-pills.example.net'), ('free-bets.example.net'), ('spam-farm.example.org')),
fit AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS rverdict
  FROM parts, rules
  WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id),
listed AS (SELECT DISTINCT page_id FROM parts, blocked WHERE host = bhost OR ends_with(host, '.' || bhost))
SELECT page_id, host, path, rule,
       coalesce(rverdict, CASE WHEN listed.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fit USING (page_id) LEFT JOIN listed USING (page_id)
"""

OP1 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM win) WHERE first < doc_id),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM d),
marked AS (
  SELECT word.doc_id, j, x, coalesce(j - max(hit.i) OVER (PARTITION BY word.doc_id ORDER BY j) < 50, false) AS gone
  FROM word LEFT JOIN hit ON word.doc_id = hit.doc_id AND word.j = hit.i),
kept AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY j) FILTER (WHERE NOT gone), '') AS t
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP2 = r"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

_ITEM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP9 = rf"""
WITH d AS (SELECT doc_id, {_ITEM} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM} AS w FROM benchmark),
phrase AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM phrase),
win AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes)),
hit AS (SELECT doc_id, win.k, i, item FROM win JOIN phrase ON win.g = phrase.g AND win.k = phrase.k),
words AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
reps AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) AS t(j) GROUP BY doc_id),
raw AS (
  SELECT doc_id, source, text, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
         lower(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ')) AS norm
  FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d)),
lines AS (SELECT * FROM raw WHERE words > 0),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY doc_id),
common AS (SELECT source, norm, min(doc_id) AS first FROM lines GROUP BY source, norm HAVING count(DISTINCT doc_id) > 5),
cut AS (
  SELECT doc_id, sum(words) AS n FROM lines JOIN common USING (source, norm) WHERE doc_id <> first GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(cut.n, 0) AS BIGINT) AS n_removed_words
  FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN reps USING (doc_id) LEFT JOIN cut USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND (n_words - n_removed_words) >= 0.5 * n_words AS kept
FROM m
"""

#: Checksum of the column ``x`` (CRC-32, four bits a step). The remainders of the 16 values of four bits.
_CRC = r"""xor(list_reduce(list_prepend(4294967295::UBIGINT,
    list_transform(range(0, 2 * strlen(x)), lambda i: (instr('0123456789ABCDEF', substr(hex(encode(x)), (xor(i, 1) + 1)::BIGINT, 1)) - 1)::UBIGINT)),
    lambda s, b: xor(s >> 4, ([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
      3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::UBIGINT[])[((xor(s, b) & 15) + 1)::BIGINT])), 4294967295::UBIGINT)"""

OP12 = rf"""
WITH d AS (SELECT doc_id, {_ITEM} AS w FROM documents),
b AS (SELECT {_ITEM} AS w FROM benchmark),
df AS (
  SELECT doc_id, x, count(*) AS c FROM (
    SELECT doc_id, unnest(w) AS x FROM d UNION ALL
    SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS x FROM d)
  GROUP BY doc_id, x),
bf AS (
  SELECT x, count(*) AS c FROM (
    SELECT unnest(w) AS x FROM b UNION ALL
    SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS x FROM b)
  GROUP BY x),
sums AS (SELECT x, {_CRC} % 10000 AS k FROM (SELECT x FROM df UNION SELECT x FROM bf)),
s AS (SELECT k, sum(c) AS s FROM df JOIN sums USING (x) GROUP BY k),
t AS (SELECT k, sum(c) AS t FROM bf JOIN sums USING (x) GROUP BY k),
gain AS (
  SELECT k, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT sum(c) FROM df)::DOUBLE + 10000)
           / ((s::DOUBLE + 1) * ((SELECT coalesce(sum(c), 0) FROM bf)::DOUBLE + 10000))))::BIGINT AS g
  FROM s LEFT JOIN t USING (k)),
weights AS (SELECT doc_id, sum(c)::BIGINT AS n, floor(sum(c * g)::DOUBLE / sum(c)::DOUBLE)::BIGINT AS weight FROM df JOIN sums USING (x) JOIN gain USING (k) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[1:8])::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, (25 * count(*) OVER ()) // 100 AS drawn FROM scored WHERE n_words >= 20)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""

OP13 = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w
  FROM documents),
sums AS (SELECT w, {_CRC} AS h FROM (SELECT w, doc_id || ':' || w AS x FROM runs WHERE length(w) >= 7)),
words AS (
  SELECT word, count(*) AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN left(w, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word FROM sums)
  WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
gone AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM gone a JOIN gone b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION
  SELECT a.word, a.n, b.word, b.n FROM gone a JOIN words b ON a.rest = b.word UNION
  SELECT b.word, b.n, a.word, a.n FROM gone a JOIN words b ON a.rest = b.word),
best AS (SELECT word, n, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n FROM near GROUP BY word, n),
forms AS (SELECT word, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n, n_near FROM best),
path AS (
  SELECT word, form AS stop, 1 AS step FROM forms WHERE form IS NOT NULL UNION ALL
  SELECT path.word, forms.form, step + 1 FROM path JOIN forms ON path.stop = forms.word WHERE forms.form IS NOT NULL),
ends AS (SELECT word, arg_max(stop, step) AS root FROM path GROUP BY word)
SELECT words.word, form, coalesce(root, words.word) AS root, n, coalesce(n_near, 0) AS n_near, form_n
FROM words LEFT JOIN forms USING (word) LEFT JOIN ends USING (word)
"""

OP11 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
ranked AS (
  SELECT doc_id, g, n, row_number() OVER (PARTITION BY doc_id ORDER BY df, g) AS place
  FROM (SELECT doc_id, g, count(*) OVER (PARTITION BY g) AS df FROM shingles) JOIN sizes USING (doc_id)),
prefix AS (SELECT doc_id, g, n FROM ranked WHERE 100 * (place - 1) <= 15 * n),
pairs AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb
  FROM prefix a JOIN prefix b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
links AS (
  SELECT a, b FROM (SELECT a, b, na, nb, count(*) AS m FROM pairs JOIN shingles x ON x.doc_id = a JOIN shingles y ON y.doc_id = b AND x.g = y.g GROUP BY a, b, na, nb)
  WHERE 100 * m >= 85 * (na + nb - m)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT ends.b, reach.c FROM reach JOIN ends ON reach.a = ends.a)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(c) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""

SQL: dict[str, str] = {"op11_jaccard_components": OP11, "op12_importance_resampling": OP12, "op13_spelling_variants": OP13, "op1_substring_dedup": OP1, "op2_warc": OP2, "op9_decontamination": OP9, "op7_url_cascade": OP7, "op10_line_quality": OP10}
