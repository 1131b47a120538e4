"""Rendered documents and questions asked of them."""

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from catalog import views as v
from catalog.registry import query, with_views
from catalog.scalars import EXT_SQL, _case
from packlake import fixed
from packlake.functions import redact
from packlake.operators.spread import top_rows
from packlake.plans import pack, render, store
from packlake.session import checkpoint_dir, materialize
from packlake.sources import tables

VOLUME = 65_536
TASK = "Review the parts that changed last."
SPEC = replace(v.SMALL, log_commits=5, task=TASK, recipe="review", persona="arch")

# ------------------------------------------------------------------- SQL of a pack

N = "chr(10)"
FINAL = f"""final AS (
  SELECT b.pack_id, b.path, b.size_bytes, b.is_oversized, b.is_omitted, b.has_content AND NOT b.is_omitted AS shown,
    CASE WHEN b.is_omitted THEN 0 ELSE b.tokens END AS tokens, r.t AS body,
    CASE WHEN b.has_content AND NOT b.is_omitted THEN r.hits ELSE 0 END AS hits,
    CASE WHEN b.is_oversized THEN '(file >100KB, contents skipped)' WHEN b.is_omitted THEN '(omitted to fit token budget)' ELSE '(no content)' END AS note
  FROM budgeted b JOIN r{len(redact.RULES)} r USING (pack_id, path))"""

PROMPT = fixed.RECIPES["review"][1].replace("'", "''").replace("\n", "'||chr(10)||'")
TASK_SQL = f"'{TASK}'||{N}||{N}||'{PROMPT}'"

HEADER = f"""header AS (
  SELECT pack_id, count(*) AS total_files, sum(tokens)::BIGINT AS total_tokens, sum(hits)::BIGINT AS redactions,
    concat_ws({N}, '{fixed.PERSONA_HEADERS["architect"]}', 'Root: ' || pack_id, concat('Total Files: ', count(*)), concat('Total Tokens: ', sum(tokens)::BIGINT),
      'Tech Stack: Koa, React', 'Task Status: Pending (See end of file)',
      CASE WHEN sum(hits) > 0 THEN concat('Safety: ', sum(hits)::BIGINT, ' secrets were detected and automatically redacted.')
        ELSE 'Safety: No secrets were detected. Manual review is still recommended.' END) AS header
  FROM final GROUP BY pack_id)"""

TREE = """nodes AS (
  SELECT DISTINCT pack_id, array_to_string(seg[1:n], '/') AS node, array_to_string(seg[1:n-1], '/') AS parent, seg[n] AS name, n AS depth,
    CASE WHEN n < len(seg) THEN '' WHEN is_oversized THEN ' [skipped >100KB]' WHEN is_omitted THEN ' [omitted: token budget]' ELSE '' END AS suffix
  FROM (SELECT pack_id, string_split(path, '/') AS seg, is_oversized, is_omitted, unnest(generate_series(1, len(string_split(path, '/')))) AS n FROM final)),
lasts AS (SELECT pack_id, parent, max(name) AS last_name FROM nodes GROUP BY ALL),
indents AS (
  SELECT n.pack_id, n.node, string_agg(CASE WHEN a.name = l.last_name THEN '    ' ELSE '│   ' END, '' ORDER BY a.depth) AS indent
  FROM nodes n JOIN nodes a ON a.pack_id = n.pack_id AND a.depth < n.depth AND starts_with(n.node, a.node || '/')
  JOIN lasts l ON l.pack_id = a.pack_id AND l.parent = a.parent GROUP BY ALL),
tree AS (
  SELECT n.pack_id, n.node, concat(coalesce(i.indent, ''), CASE WHEN n.name = l.last_name THEN '└── ' ELSE '├── ' END, n.name, n.suffix) AS line
  FROM nodes n JOIN lasts l USING (pack_id, parent) LEFT JOIN indents i USING (pack_id, node))"""

LOG = """log AS (
  SELECT pack_id, string_agg(concat(substr(hash, 1, 7), ' ', strftime(ts, '%Y-%m-%d'), ' ', subject), chr(10) ORDER BY rn) AS body
  FROM (SELECT *, row_number() OVER (PARTITION BY pack_id ORDER BY ts DESC, hash DESC) AS rn FROM commits) WHERE rn <= 5 GROUP BY 1)"""

BASE = (
    v.FILES,
    v.STATS_SMALL,
    v.OMITTED,
    *v.redactions_sql("files", "content"),
    FINAL,
    HEADER,
    TREE,
    v.COMMITS,
    LOG,
)

SLUG = "regexp_replace(lower(path), '[^a-z0-9]+', '', 'g')"
MARKDOWN = f"""sections AS (
  SELECT pack_id, 0 AS section, '' AS entry, '```' AS text FROM header
  UNION ALL SELECT pack_id, 1, node, line FROM tree
  UNION ALL SELECT pack_id, 2, '', concat('```', {N}, {N}, '## Table of Contents', {N}) FROM header
  UNION ALL SELECT pack_id, 3, path, concat('- [', path, '](#', {SLUG}, ')') FROM final WHERE shown
  UNION ALL SELECT pack_id, 4, '', concat({N}, '```', {N}, header, {N}, '```', {N}) FROM header
  UNION ALL SELECT pack_id, 5, path, CASE
      WHEN shown THEN concat('## ', path, ' {{#', {SLUG}, '}}', {N}, {N}, '```', coalesce({_case(fixed.FENCE_LANGUAGE, EXT_SQL)}, ''), {N}, body, {N}, '```', {N})
      ELSE concat('## ', path, ' {{#', {SLUG}, '}}', {N}, {N}, note, {N}) END FROM final
  UNION ALL SELECT pack_id, 6, '', concat('## Recent Commits', {N}, {N}, '```', {N}, body, {N}, '```', {N}) FROM log
  UNION ALL SELECT pack_id, 8, '', concat('## User Task / Instructions', {N}, {N}, '```', {N}, {TASK_SQL}, {N}, '```', {N}) FROM header)"""


def _xml_sql(column: str) -> str:
    return (
        f"replace(replace(replace(replace(replace({column}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
        "'\"', '&quot;'), '''', '&apos;')"
    )


XML = f"""sections AS (
  SELECT pack_id, 0 AS section, '' AS entry, concat('<packlake>', {N}, '<tree><![CDATA[') AS text FROM header
  UNION ALL SELECT pack_id, 1, node, line FROM tree
  UNION ALL SELECT pack_id, 2, '', concat_ws({N}, ']]></tree>', '<metadata><![CDATA[', header, ']]></metadata>', '<task><![CDATA[', {TASK_SQL}, ']]></task>') FROM header
  UNION ALL SELECT pack_id, 5, path, concat('<file path="', {_xml_sql('path')}, '">', {_xml_sql('CASE WHEN shown THEN body ELSE note END')}, '</file>') FROM final
  UNION ALL SELECT pack_id, 6, '', concat_ws({N}, '<gitLog><![CDATA[', body, ']]></gitLog>') FROM log
  UNION ALL SELECT pack_id, 9, '', '</packlake>' FROM header)"""

SEP = "=" * 48
PLAIN = f"""sections AS (
  SELECT pack_id, 0 AS section, '' AS entry, concat_ws({N}, '{SEP}', 'PACKLAKE CONTEXT', '{SEP}', header, '', '{SEP}', 'DIRECTORY STRUCTURE', '{SEP}') AS text FROM header
  UNION ALL SELECT pack_id, 1, node, line FROM tree
  UNION ALL SELECT pack_id, 2, '', '' FROM header
  UNION ALL SELECT pack_id, 5, path, concat_ws({N}, '{SEP}', 'File: ' || path, '{SEP}', CASE WHEN shown THEN body ELSE note END, '') FROM final
  UNION ALL SELECT pack_id, 6, '', concat_ws({N}, '{SEP}', 'RECENT COMMITS', '{SEP}', body, '') FROM log
  UNION ALL SELECT pack_id, 8, '', concat_ws({N}, '{SEP}', 'USER TASK / INSTRUCTIONS', '{SEP}', {TASK_SQL}, '') FROM header)"""

SECTION_ORDER = "section, CASE WHEN section = 1 THEN string_split(entry, '/') ELSE [entry] END"
DOC_LINES = f"""pack_lines AS (
  SELECT pack_id, i AS line_no, ls[i] AS text FROM (
    SELECT pack_id, ls, unnest(generate_series(1, len(ls))) AS i FROM (
      SELECT pack_id, string_split(string_agg(text, chr(10) ORDER BY {SECTION_ORDER}), chr(10)) AS ls FROM sections GROUP BY 1)))"""
COUNTS = "counts AS (SELECT pack_id, max(line_no)::BIGINT AS line_count FROM pack_lines GROUP BY 1)"


# ------------------------------------------------------------------------- renderers


def _plan(spark, sf_dir, fmt="markdown"):
    return v.plan(spark, sf_dir, replace(SPEC, format=fmt), commits=tables.commits(spark, sf_dir))


def _sections(spark, sf_dir, fmt):
    return render.sections(_plan(spark, sf_dir, fmt)).select("pack_id", "section", "entry", "text")


@query("k1_markdown", with_views("SELECT * FROM sections", *BASE, MARKDOWN))
def k1(spark, sf_dir):
    return _sections(spark, sf_dir, "markdown")


@query("k2_xml", with_views("SELECT * FROM sections", *BASE, XML))
def k2(spark, sf_dir):
    return _sections(spark, sf_dir, "xml")


@query("k3_plain", with_views("SELECT * FROM sections", *BASE, PLAIN))
def k3(spark, sf_dir):
    return _sections(spark, sf_dir, "plain")


@query(
    "k4_json_records",
    with_views(
        "SELECT pack_id, path, tokens::BIGINT AS tokens, is_oversized AS oversized, is_omitted AS omitted, CASE WHEN shown THEN body END AS content FROM final",
        *BASE,
    ),
)
def k4(spark, sf_dir):
    records = render.sections(_plan(spark, sf_dir, "json")).filter(F.col("section") == render.FILES)
    parsed = F.from_json(
        "text", "path STRING, tokens BIGINT, oversized BOOLEAN, omitted BOOLEAN, content STRING"
    )
    return records.select("pack_id", parsed.alias("r")).select("pack_id", "r.*")


@query(
    "k4_json_documents",
    with_views(
        f"""SELECT pack_id, 'metadata' AS kind, pack_id AS root, total_files, total_tokens, redactions, 'Koa,React' AS stack, 'architect' AS persona,
             '{fixed.BRAND}' AS generator, NULL::VARCHAR AS line, NULL::VARCHAR AS path, NULL::BIGINT AS tokens, NULL::BOOLEAN AS oversized,
             NULL::BOOLEAN AS omitted, NULL::VARCHAR AS content, NULL::VARCHAR AS task, NULL::VARCHAR AS log FROM header
           UNION ALL BY NAME SELECT pack_id, 'tree' AS kind, line FROM tree
           UNION ALL BY NAME SELECT pack_id, 'file' AS kind, path, tokens::BIGINT AS tokens, is_oversized AS oversized, is_omitted AS omitted,
             CASE WHEN shown THEN body END AS content FROM final
           UNION ALL BY NAME SELECT pack_id, 'closing' AS kind, {TASK_SQL} AS task, body AS log FROM header LEFT JOIN log USING (pack_id)""",
        *BASE,
    ),
)
def k4_documents(spark, sf_dir):
    """Every value of the nested documents, read back from their volumes; no pack is gathered."""
    rows = render.json_rows(render.json_documents(_plan(spark, sf_dir, "json"), VOLUME))
    shapes = {
        "metadata": "root STRING, totalFiles BIGINT, totalTokens BIGINT, techStack ARRAY<STRING>, persona STRING, redactedSecrets BIGINT, generator STRING",
        "file": "path STRING, tokens BIGINT, oversized BOOLEAN, omitted BOOLEAN, content STRING",
        "closing": "task STRING, gitLog STRING",
    }
    kind = F.col("kind")
    parsed = rows.withColumns({f"_{k}": F.from_json(F.when(kind == k, F.col("value")), shape) for k, shape in shapes.items()})
    return parsed.select(
        "pack_id",
        "kind",
        "_metadata.root",
        F.col("_metadata.totalFiles").alias("total_files"),
        F.col("_metadata.totalTokens").alias("total_tokens"),
        F.col("_metadata.redactedSecrets").alias("redactions"),
        F.array_join("_metadata.techStack", ",").alias("stack"),
        "_metadata.persona",
        "_metadata.generator",
        F.when(kind == "tree", F.col("value")).alias("line"),
        "_file.path",
        "_file.tokens",
        "_file.oversized",
        "_file.omitted",
        "_file.content",
        "_closing.task",
        F.col("_closing.gitLog").alias("log"),
    )


@query("k5_tree_lines", with_views("SELECT pack_id, node, line FROM tree", *BASE))
def k5(spark, sf_dir):
    return render.tree_only(_plan(spark, sf_dir)).select("pack_id", "node", "line")


@query(
    "w4_last_child",
    with_views(
        "SELECT n.pack_id, n.node, n.name = l.last_name AS is_last FROM nodes n JOIN lasts l USING (pack_id, parent)", *BASE
    ),
)
def w4(spark, sf_dir):
    lines = render.tree_only(_plan(spark, sf_dir))
    return lines.select("pack_id", "node", F.contains("line", F.lit("└── ")).alias("is_last"))


@query(
    "k6_tree_only",
    with_views("SELECT pack_id, string_agg(line, chr(10) ORDER BY string_split(node, '/')) || chr(10) AS tree FROM tree GROUP BY 1", *BASE),
)
def k6(spark, sf_dir):
    return render.tree_volumes(_plan(spark, sf_dir)).select("pack_id", F.concat("document", F.lit("\n")).alias("tree"))


@query("k7_header", with_views("SELECT pack_id, header FROM header", *BASE))
def k7(spark, sf_dir):
    plan = _plan(spark, sf_dir)
    return pack.header(plan.totals, plan.spec).select("pack_id", "header")


@query("k9_closing_sections", with_views("SELECT pack_id, section, text FROM sections WHERE section >= 6", *BASE, MARKDOWN))
def k9(spark, sf_dir):
    return _sections(spark, sf_dir, "markdown").filter(F.col("section") >= render.LOG).drop("entry")


DIFFS = """pieces AS (
  SELECT pack_id, path, 0 AS part, concat('--- a/', path, chr(10), '+++ /dev/null') AS diff FROM files WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
  UNION ALL
  SELECT pack_id, path, 1, concat('@@ -1,', len(string_split(content, chr(10))), ' +0,0 @@', chr(10), '-', replace(content, chr(10), chr(10) || '-'))
  FROM files WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
fences AS (
  SELECT pack_id, repeat('`', max(coalesce(list_max(list_transform(regexp_extract_all(diff, '`{3,}'), lambda x: len(x))) + 1, 3))::INT) AS fence FROM pieces GROUP BY 1)"""


@query(
    "k9_diff_sections",
    with_views(
        f"""SELECT pack_id, 'start' AS entry, concat('## Git Diff (uncommitted changes)', {N}, {N}, fence, 'diff') AS text FROM fences
            UNION ALL SELECT pack_id, concat(path, '#', lpad(part::VARCHAR, 19, '0')), diff FROM pieces
            UNION ALL SELECT pack_id, 'stop', concat(fence, {N}) FROM fences""",
        v.FILES,
        DIFFS,
    ),
)
def k9_diffs(spark, sf_dir):
    plan = v.plan(spark, sf_dir, v.SPEC, diffs=tables.diffs(spark, sf_dir))
    return render.sections(plan).filter(F.col("section") == render.DIFF).select("pack_id", "entry", "text")


@query(
    "k4_json_diffs",
    with_views(
        """SELECT * FROM (SELECT pack_id, unnest(string_split(diff, chr(10))) AS line FROM pieces) WHERE line <> ''""",
        v.FILES,
        DIFFS,
    ),
)
def k4_diffs(spark, sf_dir):
    """Lines of the diff in the nested documents, read back from their volumes."""
    plan = v.plan(spark, sf_dir, replace(v.SPEC, format="json"), diffs=tables.diffs(spark, sf_dir))
    rows = render.json_rows(render.json_documents(plan, VOLUME))
    return rows.filter("kind = 'diff'").select("pack_id", F.col("value").alias("line"))


AUDIT = fixed.RECIPES["audit"][1].replace("'", "''").replace("\n", "'||chr(10)||'")


@query(
    "k7_header_choices",
    with_views(
        f"""SELECT pack_id, concat_ws({N},
               CASE kind WHEN 0 THEN '{fixed.PERSONA_HEADERS["security"]}' WHEN 1 THEN '{fixed.PERSONA_HEADERS["refactor"]}' ELSE '{fixed.PERSONA_HEADERS["architect"]}' END,
               'Root: ' || pack_id, concat('Total Files: ', total_files), concat('Total Tokens: ', total_tokens), 'Tech Stack: Koa, React',
               CASE WHEN kind IN (2, 4) THEN 'Task Status: Pending (See end of file)' END, safety) AS header,
             CASE kind WHEN 2 THEN '{AUDIT}' WHEN 4 THEN 'Look at ' || pack_id END AS task
           FROM (SELECT *, ascii(right(pack_id, 1)) % 5 AS kind, string_split(header, {N})[-1] AS safety FROM header)""",
        *BASE,
    ),
)
def k7_choices(spark, sf_dir):
    """Packs with a persona, a recipe or a task of their own; the others follow the spec."""
    choices = tables.choices(spark, sf_dir)
    plan = v.plan(spark, sf_dir, replace(v.SMALL, persona="arch"), packs=choices)
    return pack.header(plan.totals, plan.spec, choices).select("pack_id", "header", F.col("task_body").alias("task"))


@query(
    "k8_text_sink",
    with_views(
        "SELECT pack_id, text AS line, count(*) AS n FROM pack_lines GROUP BY ALL", *BASE, PLAIN, DOC_LINES
    ),
)
def k8(spark, sf_dir):
    """Written as text files per pack below the shared folder, and read back."""
    folder = f"{checkpoint_dir(spark)}/k8_text_sink-{uuid.uuid4().hex}"
    render.write_text(_plan(spark, sf_dir, "plain"), folder)
    lines = spark.read.schema("value string, pack_id string").option("lineSep", "\n").text(folder)
    return lines.groupBy("pack_id", F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "a10_assembled_volumes",
    with_views(
        f"""SELECT pack_id, volume, string_agg(text, chr(10) ORDER BY {SECTION_ORDER}) AS document FROM (
              SELECT *, ((sum(strlen(text) + 1) OVER (PARTITION BY pack_id ORDER BY {SECTION_ORDER} ROWS UNBOUNDED PRECEDING) - strlen(text) - 1) // {VOLUME})::BIGINT AS volume
              FROM sections) GROUP BY pack_id, volume""",
        *BASE,
        PLAIN,
    ),
)
def a10(spark, sf_dir):
    return render.volumes(_plan(spark, sf_dir, "plain"), VOLUME)


@query("a11_pack_line_count", with_views("SELECT * FROM counts", *BASE, MARKDOWN, DOC_LINES, COUNTS))
def a11(spark, sf_dir):
    return store.line_counts(_plan(spark, sf_dir))


# --------------------------------------------------------------------------- queries


def _lines(spark, sf_dir):
    """Numbered lines, written once as a store would."""
    return materialize(store.number_lines(_plan(spark, sf_dir)))


@query("k10_pack_lines", with_views("SELECT pack_id, line_no, text FROM pack_lines", *BASE, MARKDOWN, DOC_LINES))
def k10(spark, sf_dir):
    return _lines(spark, sf_dir)


@query(
    "w2_line_numbers",
    with_views(
        "SELECT pack_id, path, i + 1 AS line_no, line FROM lines", v.FILES, v.LINES
    ),
)
def w2(spark, sf_dir):
    return tables.lines(spark, sf_dir).select("pack_id", "path", (F.col("i") + 1).alias("line_no"), "line")


@query(
    "o13_page_lines",
    with_views("SELECT pack_id, line_no, text FROM pack_lines WHERE line_no BETWEEN 101 AND 160", *BASE, MARKDOWN, DOC_LINES),
)
def o13(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return store.read_page(lines.select("pack_id").distinct(), lines, 101, 60)


@query(
    "q1_page_headers",
    with_views(
        """SELECT pack_id, concat('[', pack_id, '] lines 301-', 300 + shown, ' of ', line_count,
             CASE WHEN 300 + shown < line_count THEN concat(' (continue with startLine: ', 301 + shown, ')') ELSE ' (end of pack)' END) AS header
           FROM (SELECT *, greatest(0, least(200, line_count - 300)) AS shown FROM counts)""",
        *BASE,
        MARKDOWN,
        DOC_LINES,
        COUNTS,
    ),
)
def q1(spark, sf_dir):
    return store.page_headers(store.line_counts(_plan(spark, sf_dir)), 301, 200)


PATTERN = "en th|^## "
HITS = f"""hits AS (
  SELECT pack_id, line_no, row_number() OVER (PARTITION BY pack_id ORDER BY line_no)::INT AS match_no
  FROM pack_lines WHERE regexp_matches(text, '{PATTERN}') QUALIFY match_no <= 200)"""


GREP_SQL = with_views(
    """SELECT h.pack_id, h.match_no, l.line_no, concat(l.line_no, CASE WHEN l.line_no = h.line_no THEN ': ' ELSE '- ' END, l.text) AS line
       FROM hits h JOIN pack_lines l ON l.pack_id = h.pack_id AND l.line_no BETWEEN h.line_no - 2 AND h.line_no + 2
       UNION ALL SELECT pack_id, match_no, NULL, '--' FROM hits""",
    *BASE,
    MARKDOWN,
    DOC_LINES,
    HITS,
)


@query("q2_grep", GREP_SQL)
def q2(spark, sf_dir):
    return store.grep_text(store.grep(_lines(spark, sf_dir), PATTERN, context=2), context=2)


@query("q2_grep_indexed", GREP_SQL)
def q2_indexed(spark, sf_dir):
    """The same search through a trigram index of the stored lines."""
    folder = f"{checkpoint_dir(spark)}/q2_grep_indexed-{uuid.uuid4().hex}"
    store.save(_plan(spark, sf_dir), folder, indexed=True)
    _, lines = store.load(spark, folder)
    return store.grep_text(store.grep(lines, PATTERN, context=2, index=store.load_index(spark, folder)), context=2)


@query(
    "q2_grep_headers",
    with_views(
        f"""SELECT c.pack_id, CASE WHEN count(h.line_no) = 0 THEN concat('No matches for /{PATTERN}/ in [', c.pack_id, '].')
             ELSE concat(count(h.line_no), CASE WHEN count(h.line_no) = 200 THEN '+' ELSE '' END, ' match(es) for /{PATTERN}/ in [', c.pack_id, ']:') END AS header
           FROM counts c LEFT JOIN hits h USING (pack_id) GROUP BY c.pack_id""",
        *BASE,
        MARKDOWN,
        DOC_LINES,
        COUNTS,
        HITS,
    ),
)
def q2_headers(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return store.grep_headers(lines.select("pack_id").distinct(), store.grep(lines, PATTERN), PATTERN)


FILE_HITS = r"""ranked AS (
  SELECT pack_id, path, i + 1 AS line_no, line, row_number() OVER (PARTITION BY pack_id ORDER BY path, i)::INT AS match_no
  FROM lines WHERE regexp_matches(line, '(?i)token|license'))"""


@query(
    "o10_first_matches",
    with_views("SELECT pack_id, path, line_no, match_no FROM ranked WHERE match_no <= 3", v.FILES, v.LINES, FILE_HITS),
)
def o10(spark, sf_dir):
    lines = tables.lines(spark, sf_dir).withColumnRenamed("line", "text")
    hits = lines.filter(store.line_predicate(spark, "token|license", ignore_case=True))
    first = top_rows(hits, ["pack_id"], [F.col("path").asc(), F.col("i").asc()], 3, "match_no")
    return first.select("pack_id", "path", (F.col("i") + 1).alias("line_no"), "match_no")


@query(
    "j8_grep_context",
    with_views(
        """SELECT h.pack_id, h.match_no, l.line_no, l.line_no = h.line_no AS is_match, l.text
           FROM hits h JOIN pack_lines l ON l.pack_id = h.pack_id AND l.line_no BETWEEN h.line_no - 1 AND h.line_no + 1""",
        *BASE,
        MARKDOWN,
        DOC_LINES,
        HITS,
    ),
)
def j8(spark, sf_dir):
    return store.grep(_lines(spark, sf_dir), PATTERN, context=1)


@query(
    "j9_find_pack",
    with_views("SELECT pack_id, total_files, total_tokens FROM header WHERE pack_id = 'src3'", *BASE),
)
def j9(spark, sf_dir):
    plan = v.plan(spark, sf_dir, replace(SPEC, log_commits=None))
    return store.find(plan.totals, "src3").select("pack_id", "total_files", "total_tokens")


@query(
    "o12_omitted_preview",
    with_views(
        """SELECT pack_id, count(*) AS n, string_agg(path, ', ' ORDER BY path) FILTER (WHERE rn <= 5) || CASE WHEN count(*) > 5 THEN ', …' ELSE '' END AS names
           FROM (SELECT pack_id, path, row_number() OVER (PARTITION BY pack_id ORDER BY path) AS rn FROM budgeted WHERE is_omitted) GROUP BY 1""",
        v.FILES,
        v.STATS_SMALL,
        v.OMITTED,
    ),
)
def o12(spark, sf_dir):
    return store.preview(v.plan(spark, sf_dir).omitted, 5)


@query(
    "q3_pack_summary",
    with_views(
        r"""SELECT h.pack_id, h.total_files, h.total_tokens, c.line_count,
             (SELECT string_agg(concat(tokens, chr(9), path), chr(10) ORDER BY rn) FROM (SELECT *, row_number() OVER (PARTITION BY pack_id ORDER BY tokens DESC, path) AS rn FROM final) x
              WHERE x.pack_id = h.pack_id AND rn <= 10) AS top_files,
             (SELECT count(*) FROM final x WHERE x.pack_id = h.pack_id AND is_omitted) AS omitted,
             (SELECT string_agg(path, ', ' ORDER BY path) FILTER (WHERE rn <= 10) || CASE WHEN count(*) > 10 THEN ', …' ELSE '' END
              FROM (SELECT *, row_number() OVER (PARTITION BY pack_id ORDER BY path) AS rn FROM final WHERE is_omitted) x WHERE x.pack_id = h.pack_id) AS omitted_names,
             (SELECT count(*) FROM credentials x WHERE x.pack_id = h.pack_id) AS suspicious,
             (SELECT string_agg(path, ', ' ORDER BY path) FILTER (WHERE rn <= 10) || CASE WHEN count(*) > 10 THEN ', …' ELSE '' END
              FROM (SELECT *, row_number() OVER (PARTITION BY pack_id ORDER BY path) AS rn FROM credentials) x WHERE x.pack_id = h.pack_id) AS suspicious_names
           FROM header h JOIN counts c USING (pack_id)""",
        "credentials AS (SELECT source AS pack_id, concat('deploy/doc_', doc_id, '.pem') AS path FROM documents WHERE doc_id % 9 = 4)",
        *BASE,
        MARKDOWN,
        DOC_LINES,
        COUNTS,
    ),
)
def q3(spark, sf_dir):
    """Files that look like credentials are reported, not packed: the documents are those of the other queries."""
    files = tables.files(spark, sf_dir).drop("doc_id").unionByName(tables.credentials(spark, sf_dir))
    plan = pack.pack(files, SPEC, commits=tables.commits(spark, sf_dir))
    rows = store.summary(plan, store.line_counts(plan))
    return rows.withColumn("top_files", F.array_join("top_files", "\n"))
