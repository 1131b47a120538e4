"""Registered queries of this folder and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlake.llm import ann, bpe, htmltext, licenses, linededup, mixing, neardup, quality, repair, sharding, spelling, toxicity, winnow
from packlake.llm.common import held_out, table
from packlake.llm.twins import CRC_TABLE, crc32

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
RANKS = "byte_bpe_multi_50k.tiktoken"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer(name: str) -> tuple[bytes, str]:
    """Rank file and splitting pattern of a public tokenizer."""
    return bpe.load_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def _scored(docs: DataFrame, score, threshold: float) -> DataFrame:
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), *tokenizer(RANKS))


@query
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


@query
def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprints(table(spark, sf_dir, "documents"))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _scored(docs, toxicity.score(F.col("text"), model), 0.5)


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deletions(table(spark, sf_dir, "documents"))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _scored(docs, quality.score(F.col("text"), model), 0.3)


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


@query
def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair.repair(conversations, repair.damaged(conversations))


@query
def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


SQL["op1_mixing"] = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, source IS NULL AS no_source, coalesce(source, '') AS src, coalesce(text, '') AS t,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
sources AS (
  SELECT no_source, src, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY no_source, src) AS place
  FROM sized GROUP BY no_source, src),
weighed AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources),
-- the common level: each round fills the sources whose limit lies below it
levels AS (
  SELECT 0 AS n, CAST(0 AS DOUBLE) AS level, -1 AS full_before
  UNION ALL
  SELECT n + 1,
         ((SELECT sum(source_size) FROM weighed) - (SELECT coalesce(sum(source_size * 3), 0) FROM weighed WHERE source_size * 3 <= level * weight))
           / (SELECT CAST(sum(weight) AS DOUBLE) FROM weighed WHERE source_size * 3 > level * weight),
         (SELECT count(*) FROM weighed WHERE source_size * 3 <= level * weight)
  FROM levels
  WHERE (SELECT count(*) FROM weighed WHERE source_size * 3 <= level * weight) <> full_before
    AND EXISTS (SELECT 1 FROM weighed WHERE source_size * 3 > level * weight)),
goal AS (SELECT arg_max(level, n) AS level FROM levels),
targets AS (
  SELECT no_source, src, source_size, least(CAST(source_size * 3 AS DOUBLE), level * CAST(weight AS DOUBLE)) AS target
  FROM weighed, goal),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.no_source, s.src ORDER BY s.k, s.doc_id, s.size, md5(s.t)
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.no_source = t.no_source AND s.src = t.src)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + least(greatest(budget % source_size - before, 0), size) END AS BIGINT) AS taken
FROM placed
"""


SQL["op3_near_duplicates"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM words WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT u, v FROM shared JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v WHERE 100 * c >= 85 * (a.n + b.n - c)),
reached AS (
  SELECT doc_id AS id, doc_id AS other FROM documents
  UNION
  SELECT links.v, reached.other FROM reached JOIN links ON links.u = reached.id),
groups AS (SELECT id, min(other) AS component_id FROM reached GROUP BY id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, g.component_id, d.doc_id = g.component_id AS kept
FROM documents d JOIN groups g ON g.id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

SQL["op5_winnowing"] = r"""
WITH ordered AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(coalesce(text, ''))) AS place, count(*) OVER () AS n
  FROM documents),
changed AS (
  SELECT a.place, a.doc_id, a.t, substr(a.t, 1, length(a.t) - length(a.t) // 2) || substr(b.t, 1, length(a.t) // 2) AS e, b.t AS next
  FROM ordered a JOIN ordered b ON b.place = a.place % a.n + 1),
texts AS (SELECT t AS x FROM changed UNION SELECT e FROM changed UNION SELECT next FROM changed),
hashed AS (
  SELECT x, list_transform(regexp_extract_all(x, '[^\x20\x09-\x0D]{1,8}'), lambda w: ('0x' || substr(md5(w), 1, 7))::BIGINT) AS h FROM texts),
grams AS (
  SELECT x, CASE WHEN len(h) = 0 THEN []::BIGINT[]
    WHEN len(h) < 4 THEN [list_reduce(list_prepend(0::BIGINT, h), lambda a, v: (a * 1000003 + v) % 2147483647)]
    ELSE list_transform(range(1, len(h) - 2), lambda i:
      (((h[i] * 1000003 + h[i + 1]) % 2147483647 * 1000003 + h[i + 2]) % 2147483647 * 1000003 + h[i + 3]) % 2147483647) END AS g
  FROM hashed),
entries AS (SELECT x, list_transform(g, lambda v, i: v * 4294967296 + 4294967296 - i) AS k FROM grams),
windows AS (
  SELECT x, CASE WHEN len(k) = 0 THEN []::BIGINT[] WHEN len(k) < 8 THEN [list_min(k)]
    ELSE list_transform(range(1, len(k) - 6), lambda i: list_min(k[i:i + 7])) END AS m
  FROM entries),
picked AS (SELECT x, list_filter(m, lambda v, i: i = 1 OR v <> m[i - 1]) AS p FROM windows),
prints AS (
  SELECT x, array_to_string(list_transform(p, lambda v: concat(4294967295 - v % 4294967296, ':', lower(to_hex(v // 4294967296)))), ',') AS f,
         list_distinct(list_transform(p, lambda v: v // 4294967296)) AS s
  FROM picked)
SELECT c.doc_id, length(c.t)::BIGINT AS n_chars, sha256(c.e) AS edited_sha256, a.f AS fingerprint, b.f AS edited_fingerprint,
       CASE WHEN len(a.s) + len(b.s) = 0 THEN 1.0::DOUBLE
         ELSE len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) END AS near_edited,
       CASE WHEN len(a.s) + len(d.s) = 0 THEN 1.0::DOUBLE
         ELSE len(list_intersect(a.s, d.s))::DOUBLE / (len(a.s) + len(d.s) - len(list_intersect(a.s, d.s))) END AS near_next
FROM changed c JOIN prints a ON a.x = c.t JOIN prints b ON b.x = c.e JOIN prints d ON d.x = c.next
"""

SQL["op7_line_dedup"] = r"""
WITH texts AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text <> ''),
counted AS (SELECT *, list_transform(ls, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) AS ws FROM texts),
lines AS (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM counted),
-- the shortest passages of 50 words that begin, and that end, at each line
spans AS (
  SELECT doc_id, ls, i AS s, list_filter(range(i, len(ls) + 1), lambda j: list_sum(ws[i:j]) >= 50)[1] AS e FROM lines
  UNION ALL
  SELECT doc_id, ls, list_filter(range(1, i + 1), lambda j: list_sum(ws[j:i]) >= 50)[-1], i FROM lines),
runs AS (SELECT DISTINCT doc_id, s, e, array_to_string(ls[s:e], chr(10)) AS run FROM spans WHERE s IS NOT NULL AND e IS NOT NULL),
copies AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM copies),
cut AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_deleted, string_agg(l.ls[l.i], chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS kept
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_deleted, 0)::BIGINT AS n_deleted,
       CASE WHEN c.doc_id IS NULL THEN d.text ELSE coalesce(c.kept, '') END AS text
FROM documents d LEFT JOIN cut c ON c.doc_id = d.doc_id
"""

SQL["op11_conversation_repair"] = rf"""
WITH RECURSIVE {CRC_TABLE},
source AS (
  SELECT conv_id, turn, coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, conv_id IS NULL AS no_conv, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS chance
  FROM conversations, crc_table),
damaged AS (
  SELECT conv, no_conv, turn, CASE chance WHEN 4 THEN 'user' ELSE role END AS role,
         CASE chance WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE chance WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM source),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY no_conv, conv ORDER BY turn NULLS FIRST, role, text, copy) AS place,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS tail FROM damaged),
marked AS (
  SELECT *, CASE WHEN tail = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY no_conv, conv, role, text ORDER BY place) > 1 THEN 'duplicate'
                 WHEN right(tail, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         left(role, 1) AS initial,
         lag(left(role, 1)) OVER (PARTITION BY no_conv, conv ORDER BY place) || left(role, 1) AS pair
  FROM placed),
facts AS (
  SELECT no_conv, conv, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM marked GROUP BY no_conv, conv),
-- cheapest edits that leave nothing, s, ...u, ...a; 'far' is out of reach
paths AS (
  SELECT no_conv, conv, 0::BIGINT AS place, {{'c': 0::BIGINT, 'a': '', 'o': ''}} AS e, {{'c': 1000000::BIGINT, 'a': '', 'o': ''}} AS s,
         {{'c': 2::BIGINT, 'a': 'I', 'o': 'u'}} AS u, {{'c': 4::BIGINT, 'a': 'II', 'o': 'ua'}} AS p
  FROM facts
  UNION ALL
  SELECT no_conv, conv, place, e, s, u1, list_min([p0, {{'c': u1.c + 2, 'a': u1.a || 'I', 'o': u1.o || 'a'}}]) FROM (
    SELECT *, list_min([u0, {{'c': open.c + 2, 'a': open.a || 'I', 'o': open.o || 'u'}}]) AS u1 FROM (
      SELECT *, list_min([e, s, p0]) AS open FROM (
        SELECT no_conv, conv, place, {{'c': e.c + 3, 'a': e.a || 'D', 'o': e.o || '-'}} AS e,
               list_min([{{'c': s.c + 3, 'a': s.a || 'D', 'o': s.o || '-'}}, {{'c': e.c + CASE WHEN stays AND initial = 's' THEN more ELSE 1000000 END, 'a': e.a || 'K', 'o': e.o || 's'}}]) AS s,
               list_min([{{'c': u.c + 3, 'a': u.a || 'D', 'o': u.o || '-'}}, {{'c': before.c + CASE WHEN stays AND initial = 'u' THEN more ELSE 1000000 END, 'a': before.a || 'K', 'o': before.o || 'u'}},
                         {{'c': before.c + CASE WHEN stays THEN 2 + more ELSE 1000000 END, 'a': before.a || 'R', 'o': before.o || 'u'}}]) AS u0,
               list_min([{{'c': p.c + 3, 'a': p.a || 'D', 'o': p.o || '-'}}, {{'c': u.c + CASE WHEN stays AND initial = 'a' THEN more ELSE 1000000 END, 'a': u.a || 'K', 'o': u.o || 'a'}},
                         {{'c': u.c + CASE WHEN stays THEN 2 + more ELSE 1000000 END, 'a': u.a || 'R', 'o': u.o || 'a'}}]) AS p0
        FROM (
          SELECT w.*, m.initial, m.fault NOT IN ('blank', 'duplicate') AS stays, CASE m.fault WHEN 'truncated' THEN 1 ELSE 0 END AS more, m.place AS new_place, list_min([w.e, w.s, w.p]) AS before
          FROM paths w JOIN marked m ON m.no_conv = w.no_conv AND m.conv = w.conv AND m.place = w.place + 1) AS met(no_conv, conv, old_place, e, s, u, p, initial, stays, more, place, before))))),
best AS (
  SELECT w.no_conv, w.conv, list_min([w.e, w.p]) AS way FROM paths w JOIN facts f ON f.no_conv = w.no_conv AND f.conv = w.conv AND f.n = w.place),
edits AS (
  SELECT no_conv, conv, i, substr(way.a, i, 1) AS edit, substr(way.o, i, 1) AS role_to, length(replace(substr(way.a, 1, i), 'I', '')) AS place
  FROM (SELECT *, unnest(range(1, length(way.a) + 1)) AS i FROM best)),
texts AS (
  SELECT x.no_conv, x.conv, string_agg(CASE WHEN edit = 'K' THEN m.role WHEN role_to = 'u' THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE m.text END, chr(10) ORDER BY i) AS repaired
  FROM edits x LEFT JOIN marked m ON m.no_conv = x.no_conv AND m.conv = x.conv AND m.place = x.place AND edit <> 'I'
  WHERE edit <> 'D' GROUP BY x.no_conv, x.conv)
SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(way.c, 0)::BIGINT AS cost, coalesce(way.a, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv, no_conv FROM source) d
LEFT JOIN facts f ON f.no_conv = d.no_conv AND f.conv = d.conv
LEFT JOIN best b ON b.no_conv = d.no_conv AND b.conv = d.conv
LEFT JOIN texts t ON t.no_conv = d.no_conv AND t.conv = d.conv
"""

SQL["op13_spelling_variants"] = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents)),
counted AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY id, run),
hashed AS (SELECT run, n, {crc32("concat(id, ':', run)")} AS h FROM counted, crc_table),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
-- every word with one code point left out
less AS MATERIALIZED (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
counts AS (SELECT word, count(*) AS n_near FROM near GROUP BY word),
best AS (SELECT word, other, n FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, other) = 1),
forms AS MATERIALIZED (
  SELECT w.word, w.n, c.n_near, CASE WHEN b.n >= 2 * w.n THEN b.other END AS form, CASE WHEN b.n >= 2 * w.n THEN b.n END AS form_n
  FROM words w LEFT JOIN counts c ON c.word = w.word LEFT JOIN best b ON b.word = w.word),
chain AS (
  SELECT word, word AS place, 0 AS step FROM forms
  UNION ALL
  SELECT c.word, f.form, c.step + 1 FROM chain c JOIN forms f ON f.word = c.place WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(place, step) AS root FROM chain GROUP BY word)
SELECT f.word, f.form, r.root, f.n, coalesce(f.n_near, 0)::BIGINT AS n_near, f.form_n::BIGINT AS form_n FROM forms f JOIN roots r ON r.word = f.word
"""
