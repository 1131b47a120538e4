"""SQL twins of the derived tables, and helpers shared by the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlake import fixed
from packlake.functions import redact
from packlake.operators import scan
from packlake.plans import pack
from packlake.sources import tables
from packlake.spec import PackSpec

BINARY = "UTF8_BINARY"
BUDGET = 15_000
SPEC = PackSpec(collation=BINARY)
SMALL = PackSpec(collation=BINARY, max_tokens=BUDGET)

# ------------------------------------------------------------------ SQL views

PATH_SQL = """concat(lang,'/shard_',doc_id % 7,'/doc_',doc_id,
    case doc_id % 8 when 0 then '.md' when 1 then '.py' when 2 then '.ts' when 3 then '.go'
      when 4 then '.sql' when 5 then '.html' when 6 then '.json' else '.txt' end)"""

FILES = f"""files AS (
  SELECT source AS pack_id, {PATH_SQL} AS path, doc_id, strlen(text)::BIGINT AS size_bytes, text AS content
  FROM documents
  UNION ALL
  SELECT DISTINCT source, 'package.json', NULL::BIGINT, 40::BIGINT, '{tables.MANIFEST_TEXT}' FROM documents)"""

LINES = """lines AS (
  SELECT pack_id, path, (i - 1)::INT AS i, ls[i] AS line
  FROM (SELECT pack_id, path, string_split(content, chr(10)) AS ls,
          unnest(generate_series(1, len(string_split(content, chr(10))))) AS i FROM files))"""

SRC = """src_lines AS (
  SELECT pack_id, path, i,
    CASE i % 6 WHEN 0 THEN concat('import ', substr(line, 1, 20)) WHEN 1 THEN concat('# ', line) WHEN 2 THEN ''
      WHEN 3 THEN concat('def f', i, '():') ELSE concat('    ', line) END AS line
  FROM lines WHERE path LIKE '%.py')"""

TOUCHES = """touches AS (
  SELECT e.event_id AS commit_id, e.ts, f.pack_id, f.path FROM events e JOIN files f ON f.doc_id = e.user_id
  UNION ALL
  SELECT e.event_id, e.ts, f.pack_id, f.path FROM events e JOIN files f ON f.doc_id = (e.user_id * 7 + 1) % 200)"""

COMMITS = """commits AS (
  SELECT d.source AS pack_id, md5(e.event_id::VARCHAR) AS hash, e.ts,
    concat(e.event_type, ' #', e.event_id) AS subject
  FROM events e JOIN documents d ON d.doc_id = e.user_id)"""

CHANGED = f"""changed AS (
  SELECT DISTINCT pack_id, path FROM touches WHERE commit_id IN
    (SELECT event_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '{tables.CHANGED_SINCE}')
  UNION
  SELECT f.pack_id, f.path FROM files f JOIN labels l ON f.doc_id = l.doc_id WHERE l.toxic = 1)"""

PRETOKEN = r"len(regexp_extract_all({0}, '[A-Za-z0-9]+|[^A-Za-z0-9\s]'))::BIGINT"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def redacted_sql(column: str) -> str:
    out = column
    for rule in redact.RULES:
        replacement = rule.replacement.replace("$", "\\")
        out = f"regexp_replace({out}, {_quoted(rule.pattern)}, {_quoted(replacement)}, 'g')"
    return out


def redactions_sql(source: str, column: str) -> list[str]:
    """Views r0..rn applying one rule each, with a running hit count ``hits``."""
    views = [f"r0 AS (SELECT *, {column} AS t, 0::BIGINT AS hits FROM {source})"]
    for i, rule in enumerate(redact.RULES):
        pattern, replacement = _quoted(rule.pattern), _quoted(rule.replacement.replace("$", "\\"))
        views.append(
            f"r{i + 1} AS (SELECT * REPLACE (regexp_replace(t, {pattern}, {replacement}, 'g') AS t, "
            f"hits + len(regexp_extract_all(t, {pattern})) AS hits) FROM r{i})"
        )
    return views


def stats_sql(max_bytes: int) -> str:
    tokens = PRETOKEN.format(redacted_sql("content"))
    return f"""stats AS (
  SELECT pack_id, path, size_bytes, content <> '' AND size_bytes <= {max_bytes} AS has_content,
    size_bytes > {max_bytes} AS is_oversized,
    CASE WHEN content <> '' AND size_bytes <= {max_bytes} THEN {tokens} ELSE 0 END AS tokens
  FROM files)"""


STATS = stats_sql(fixed.DEFAULT_MAX_FILE_BYTES)
STATS_SMALL = stats_sql(SMALL.max_file_bytes)

DIRS = """prefixes AS (
  SELECT pack_id, path, tokens, string_split(path, '/') AS seg FROM stats),
dirs AS (
  SELECT pack_id, dir, sum(tokens)::BIGINT AS tokens, (CASE WHEN dir = '' THEN 0 ELSE len(string_split(dir, '/')) END)::INT AS depth
  FROM (SELECT pack_id, tokens, unnest(list_transform(generate_series(1, len(seg) - 1), lambda n: array_to_string(seg[1:n], '/'))) AS dir
        FROM prefixes WHERE tokens > 0
        UNION ALL SELECT pack_id, tokens, '' FROM prefixes) GROUP BY ALL)"""

OMITTED = f"""walked AS (
  SELECT *, has_content AND path <> 'package.json' AS eligible,
    sum(tokens) OVER (PARTITION BY pack_id) AS total FROM stats),
budgeted AS (
  SELECT *, eligible AND total - coalesce(sum(CASE WHEN eligible THEN tokens ELSE 0 END) OVER
      (PARTITION BY pack_id ORDER BY tokens DESC, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > {BUDGET} AS is_omitted
  FROM walked)"""

# A corpus with generated, hidden and credential-shaped names, and rule files.
RULE_FILES = [
    (".gitignore", "# generated\n*.json\n!package.json\n\n  fr/shard_1/  \n/de/**/doc_1*\n"),
    (f".{fixed.BRAND}ignore", "doc_2?.txt\r\n"),
    ("en/.gitignore", "!*.json\nshard_2/\n"),
    ("es/shard_3/.gitignore", "*.py\n!doc_1*.py\n# end"),
    ("node_modules/x/.gitignore", "*\n"),
]
_RULE_VALUES = ", ".join("('" + p + "', '" + c.replace("\n", "'||chr(10)||'").replace("\r", "'||chr(13)||'") + "')" for p, c in RULE_FILES)

MIXED = f"""mixed AS (
  SELECT pack_id, CASE doc_id % 16 WHEN 0 THEN 'node_modules/' || path WHEN 1 THEN path || '.map'
      WHEN 2 THEN 'pkg/dist/' || path WHEN 3 THEN 'dist/' || path WHEN 4 THEN 'conf/' || doc_id || '/.env'
      WHEN 5 THEN 'keys/doc_' || doc_id || '.pem' WHEN 6 THEN 'assets/doc_' || doc_id || '.css'
      WHEN 7 THEN 'img/doc_' || doc_id || '.svg'
      WHEN 9 THEN replace(path, '/doc_' || doc_id || '.py', '/DOC_' || doc_id || '.PY')
      WHEN 14 THEN replace(path, '/doc_' || doc_id || '.json', '/Doc_' || doc_id || '.JSON') ELSE path END AS path, content
  FROM files
  UNION ALL
  SELECT s.source, v.p, v.c FROM (SELECT DISTINCT source FROM documents) s, (VALUES {_RULE_VALUES}) v(p, c))"""

# A manifest per document: both maps, one map, none, text that is no JSON.
MANIFESTS = """manifests AS (
  SELECT source AS pack_id, lang || '/m' || doc_id || '/package.json' AS path, CASE doc_id % 5
    WHEN 0 THEN '{"dependencies":{"react":"1","lib' || doc_id % 11 || '":"2"}}'
    WHEN 1 THEN '{"devDependencies":{"vitest":"1"},"dependencies":{"koa":"2","vitest":"3"}}'
    WHEN 2 THEN '{"dependencies":{"react"' WHEN 3 THEN '{"name":"n' || doc_id || '"}' ELSE '' END AS content FROM documents),
declared AS (
  SELECT pack_id, path, unnest(json_keys(content, '$.dependencies')) AS dependency FROM manifests WHERE json_valid(content)
  UNION ALL
  SELECT pack_id, path, unnest(json_keys(content, '$.devDependencies')) FROM manifests WHERE json_valid(content))"""

DEFAULT_EXCLUDED_SQL = r"""(regexp_matches({0}, '^(node_modules|\.git|dist|build|coverage|\.next|\.nuxt|\.venv|__pycache__)/.')
  OR {0} IN ('package-lock.json','yarn.lock','pnpm-lock.yaml','bun.lockb','Cargo.lock','poetry.lock','uv.lock','composer.lock',
    'Gemfile.lock','context.md','codebase.md','digest.txt','context.xml','codebase.xml')
  OR regexp_matches({0}, '\.(min\.js|min\.css|map|svg|png|jpg|jpeg|gif|ico|woff|woff2|ttf|otf|eot|pdf|zip|gz|tar)$')
  OR regexp_matches({0}, '(^|/)\.DS_Store$') OR regexp_matches({0}, '^packlake-[^/]*\.(md|xml|json|txt)$'))"""

# The rule files above, read as predicates by hand; rules ignore case.
ROOT_VERDICT_SQL = r"""(CASE WHEN starts_with(lower(path), 'fr/shard_1/') THEN true
    WHEN regexp_matches(lower(path), '(^|/)doc_2[^/]\.txt$') THEN true
    WHEN regexp_matches(lower(path), '^de/(.*/)?doc_1[^/]*$') THEN true
    WHEN regexp_matches(lower(path), '(^|/)package\.json$') THEN false
    WHEN regexp_matches(lower(path), '\.json$') THEN true ELSE false END)"""
CASCADE_SQL = rf"""(CASE
    WHEN starts_with(lower(path), 'es/shard_3/') AND regexp_matches(lower(path), '/doc_1[^/]*\.py$') THEN false
    WHEN starts_with(lower(path), 'es/shard_3/') AND regexp_matches(lower(path), '\.py$') THEN true
    WHEN starts_with(lower(path), 'en/shard_2/') OR regexp_matches(lower(path), '^en/.*/shard_2/') THEN true
    WHEN starts_with(lower(path), 'en/') AND lower(path) LIKE '%.json' THEN false
    ELSE {ROOT_VERDICT_SQL} END)"""

SUSPICIOUS_SQL = r"regexp_matches(path, '(^|/)\.env$|\.pem$')"


# ------------------------------------------------------------- Spark helpers


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tables.files(spark, sf_dir)
    path, doc = F.col("path"), F.col("doc_id")
    number = doc.cast("string")
    renamed = (
        F.when(doc % 16 == 0, F.concat(F.lit("node_modules/"), path))
        .when(doc % 16 == 1, F.concat(path, F.lit(".map")))
        .when(doc % 16 == 2, F.concat(F.lit("pkg/dist/"), path))
        .when(doc % 16 == 3, F.concat(F.lit("dist/"), path))
        .when(doc % 16 == 4, F.concat(F.lit("conf/"), number, F.lit("/.env")))
        .when(doc % 16 == 5, F.concat(F.lit("keys/doc_"), number, F.lit(".pem")))
        .when(doc % 16 == 6, F.concat(F.lit("assets/doc_"), number, F.lit(".css")))
        .when(doc % 16 == 7, F.concat(F.lit("img/doc_"), number, F.lit(".svg")))
        .when(doc % 16 == 9, F.replace(path, F.concat(F.lit("/doc_"), number, F.lit(".py")), F.concat(F.lit("/DOC_"), number, F.lit(".PY"))))
        .when(doc % 16 == 14, F.replace(path, F.concat(F.lit("/doc_"), number, F.lit(".json")), F.concat(F.lit("/Doc_"), number, F.lit(".JSON"))))
        .otherwise(path)
    )
    rules = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(c).alias("content")) for p, c in RULE_FILES])
    extra = tables.manifests(spark, sf_dir).select("pack_id", F.inline(rules))
    both = files.select("pack_id", renamed.alias("path"), "content").unionByName(extra)
    return both.withColumn("size_bytes", F.octet_length("content").cast("bigint"))


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda n: (F.col("doc_id") % n).cast("string")
    content = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit('{"dependencies":{"react":"1","lib'), number(11), F.lit('":"2"}}')))
        .when(F.col("doc_id") % 5 == 1, F.lit('{"devDependencies":{"vitest":"1"},"dependencies":{"koa":"2","vitest":"3"}}'))
        .when(F.col("doc_id") % 5 == 2, F.lit('{"dependencies":{"react"'))
        .when(F.col("doc_id") % 5 == 3, F.concat(F.lit('{"name":"n'), F.col("doc_id").cast("string"), F.lit('"}')))
        .otherwise(F.lit(""))
    )
    path = F.concat("lang", F.lit("/m"), F.col("doc_id").cast("string"), F.lit("/package.json"))
    return tables.documents(spark, sf_dir, "doc_id", "lang", "source").select(F.col("source").alias("pack_id"), path.alias("path"), content.alias("content"))


def flagged(spark: SparkSession, sf_dir: str, max_bytes: int = fixed.DEFAULT_MAX_FILE_BYTES) -> DataFrame:
    return scan.add_flags(tables.files(spark, sf_dir), max_bytes)


def stats(spark: SparkSession, sf_dir: str, spec: PackSpec = SPEC) -> DataFrame:
    """Narrow token facts of the files view."""
    return pack.counted(flagged(spark, sf_dir, spec.max_file_bytes), spec).select(
        "pack_id", "path", "size_bytes", "tokens", "has_content", "is_binary", "is_oversized", "is_omitted"
    )


def plan(spark: SparkSession, sf_dir: str, spec: PackSpec = SMALL, **history: DataFrame) -> pack.Pack:
    return pack.pack(tables.files(spark, sf_dir).drop("doc_id"), spec, **history)
