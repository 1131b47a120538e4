"""Row-local functions (P1-P28) over whole texts."""

from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalog import views as v
from catalog.registry import query, with_views
from packlake import fixed
from packlake.functions import paths, redact, shape, text, tokens
from packlake.operators import bpe, lookups, rollup, scan
from packlake.plans import pack
from packlake.session import materialize
from packlake.sources import tables
from packlake.spec import PackSpec

# Secrets of every family, planted by doc_id; digests alone must stay.
PLANTED = """planted AS (
  SELECT doc_id, concat(text, chr(10), CASE doc_id % 16
    WHEN 0 THEN 'key=sk-' || md5(text) WHEN 1 THEN 'x ghp_' || md5(text) || 'abcd y'
    WHEN 2 THEN 'glpat-' || md5(text) WHEN 3 THEN 'xoxb-' || md5(text)
    WHEN 4 THEN 'sk_live_' || md5(text) WHEN 5 THEN 'npm_' || md5(text) || 'abcd'
    WHEN 6 THEN 'hf_' || md5(text) WHEN 7 THEN 'SG.' || md5(text) || '.' || md5(text)
    WHEN 8 THEN 'sid SK' || md5(text) || ' end' WHEN 9 THEN 'AKIA' || upper(substr(md5(text), 1, 16))
    WHEN 10 THEN 'eyJ' || md5(text) || '.eyJ' || md5(text) || '.' || md5(text)
    WHEN 11 THEN '-----BEGIN RSA PRIVATE KEY-----' || chr(10) || md5(text) || chr(10) || '-----END RSA PRIVATE KEY-----'
    WHEN 12 THEN 'apiKey = "' || md5(text) || '"' WHEN 13 THEN 'db_password: ''' || md5(text) || ''''
    WHEN 14 THEN '"integrity": "sha512-' || md5(text) || '"' ELSE md5(text) END) AS content
  FROM documents)"""


def _planted(spark, sf_dir):
    digest = F.md5("text")
    forms = [
        F.concat(F.lit("key=sk-"), digest),
        F.concat(F.lit("x ghp_"), digest, F.lit("abcd y")),
        F.concat(F.lit("glpat-"), digest),
        F.concat(F.lit("xoxb-"), digest),
        F.concat(F.lit("sk_live_"), digest),
        F.concat(F.lit("npm_"), digest, F.lit("abcd")),
        F.concat(F.lit("hf_"), digest),
        F.concat(F.lit("SG."), digest, F.lit("."), digest),
        F.concat(F.lit("sid SK"), digest, F.lit(" end")),
        F.concat(F.lit("AKIA"), F.upper(F.substring(digest, 1, 16))),
        F.concat(F.lit("eyJ"), digest, F.lit(".eyJ"), digest, F.lit("."), digest),
        F.concat(
            F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), digest, F.lit("\n-----END RSA PRIVATE KEY-----")
        ),
        F.concat(F.lit('apiKey = "'), digest, F.lit('"')),
        F.concat(F.lit("db_password: '"), digest, F.lit("'")),
        F.concat(F.lit('"integrity": "sha512-'), digest, F.lit('"')),
        digest,
    ]
    chosen = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        chosen = F.when(F.col("doc_id") % 16 == i, form).otherwise(chosen)
    docs = tables.documents(spark, sf_dir, "doc_id", "text")
    return docs.select("doc_id", F.concat("text", F.lit("\n"), chosen).alias("content"))


@query("p1_redact", with_views(f"SELECT doc_id, {v.redacted_sql('content')} AS content FROM planted", PLANTED))
def p1(spark, sf_dir):
    return _planted(spark, sf_dir).select("doc_id", redact.redacted(F.col("content")).alias("content"))


@query(
    "p2_redaction_count",
    with_views(
        f"SELECT doc_id, hits AS redactions FROM r{len(redact.RULES)}", PLANTED, *v.redactions_sql("planted", "content")
    ),
)
def p2(spark, sf_dir):
    return redact.redact(_planted(spark, sf_dir)).select("doc_id", "redactions")


@query("p3_tokens_pretoken", f"SELECT doc_id, {v.PRETOKEN.format('text')} AS tokens_est FROM documents")
def p3_pretoken(spark, sf_dir):
    docs = tables.documents(spark, sf_dir, "doc_id", "text")
    return docs.select("doc_id", tokens.count_tokens(F.col("text")).alias("tokens_est"))


@query("p3_tokens_chars4", "SELECT doc_id, ceil(length(text) / 4)::BIGINT AS tokens_est FROM documents")
def p3_chars4(spark, sf_dir):
    docs = tables.documents(spark, sf_dir, "doc_id", "text")
    return docs.select("doc_id", tokens.count_tokens(F.col("text"), "chars4").alias("tokens_est"))


@query(
    "p3_tokens_bpe",
    r"""WITH letters AS (SELECT string_split(text, '') AS cs FROM documents),
       pairs AS (SELECT pair, count(*) AS n
                 FROM (SELECT unnest(list_transform(generate_series(1, len(cs) - 1), lambda i: cs[i] || cs[i + 1])) AS pair FROM letters)
                 WHERE regexp_full_match(pair, '[a-z]{2}') GROUP BY 1),
       ranked AS (SELECT list(pair ORDER BY n DESC, pair) AS ps FROM pairs),
       -- a contraction is a piece of its own: what follows it is cut off
       cut AS (SELECT doc_id, text, regexp_replace(text, '([\p{L}\p{N}\n]|^)''(s|d|m|t|ll|ve|re)', '\1''\2' || chr(1), 'g') AS t FROM documents)
       -- only letter pairs are merged, the most frequent first, and nothing is merged twice
       SELECT doc_id, (strlen(text) - length(t) + length(list_reduce(ps, lambda acc, p: replace(acc, p, chr(2)), t)))::BIGINT AS tokens
       FROM cut, ranked""",
)
def p3_bpe(spark, sf_dir):
    """Ranks: single bytes, then letter pairs by frequency."""
    docs = tables.documents(spark, sf_dir, "doc_id", "text")
    pairs = (
        docs.select(F.explode(F.regexp_extract_all("text", F.lit("(?=([a-z]{2}))"), F.lit(1))).alias("pair"))
        .groupBy("pair")
        .agg(F.count(F.lit(1)).alias("n"))
    )  # at most 26 * 26 rows
    place = F.row_number().over(Window.orderBy(F.col("n").desc(), "pair"))
    ranks = pairs.select(F.encode("pair", "UTF-8").alias("token"), (place + 255).alias("rank"))
    single = spark.range(256).select(
        F.unhex(F.lpad(F.hex("id"), 2, "0")).alias("token"), F.col("id").cast("int").alias("rank")
    )
    files = docs.select("doc_id", F.col("text").alias("content"))
    return bpe.count_bpe(files, materialize(single.unionByName(ranks)), "cl100k_base", keys=("doc_id",))


@query(
    "p4_line_numbers",
    """SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)),
         lambda l, i: concat(lpad(i::VARCHAR, length(len(string_split(text, chr(10)))::VARCHAR)::INT, ' '), ': ', l)), chr(10)) AS content
       FROM documents""",
)
def p4(spark, sf_dir):
    docs = tables.documents(spark, sf_dir, "doc_id", "text")
    return docs.select("doc_id", text.add_line_numbers(F.col("text")).alias("content"))


@query(
    "p5_fence",
    """WITH f AS (SELECT doc_id, concat(repeat('`', (doc_id % 7)::INT), chr(10), text, repeat('`', (doc_id % 5)::INT)) AS c FROM documents)
       SELECT doc_id, repeat('`', greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(c, '`{3,}'), lambda r: length(r))), 0))::INT) AS fence FROM f""",
)
def p5(spark, sf_dir):
    docs = tables.documents(spark, sf_dir, "doc_id", "text")
    ticks = lambda n: F.repeat(F.lit("`"), (F.col("doc_id") % n).cast("int"))
    return docs.withColumn("c", F.concat(ticks(7), F.lit("\n"), "text", ticks(5))).select(
        "doc_id", text.fence_for(F.col("c")).alias("fence")
    )


def _case(table: dict[str, str], subject: str) -> str:
    return f"CASE {subject} " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in table.items()) + " END"


EXT_SQL = r"lower(regexp_extract(path, '[^/]+(\.[^./]*)$', 1))"


@query(
    "p6_fence_language",
    with_views(f"SELECT pack_id, path, {_case(fixed.FENCE_LANGUAGE, EXT_SQL)} AS lang FROM mixed", v.FILES, v.MIXED),
)
def p6(spark, sf_dir):
    return v.mixed(spark, sf_dir).select("pack_id", "path", text.fence_language(F.col("path")).alias("lang"))


@query(
    "p7_extension",
    with_views(
        """SELECT pack_id, path, CASE WHEN path LIKE '%ignore' OR path LIKE '%.env' THEN ''
             ELSE '.' || lower(list_last(string_split(path, '.'))) END AS ext FROM mixed""",
        v.FILES,
        v.MIXED,
    ),
)
def p7(spark, sf_dir):
    return v.mixed(spark, sf_dir).select("pack_id", "path", paths.extension(F.col("path")).alias("ext"))


@query(
    "p8_xml_escape",
    """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS html
       FROM pages""",
)
def p8(spark, sf_dir):
    return tables.table(spark, sf_dir, "pages").select("page_id", text.xml_escape(F.col("html")).alias("html"))


@query(
    "p9_heading_slug",
    with_views("SELECT pack_id, path, regexp_replace(lower(path), '[^a-z0-9]+', '', 'g') AS slug FROM mixed", v.FILES, v.MIXED),
)
def p9(spark, sf_dir):
    return v.mixed(spark, sf_dir).select("pack_id", "path", text.heading_slug(F.col("path")).alias("slug"))


NOTE_FLAGS = "doc_id % 13 = 0 AS b, doc_id % 13 <> 0 AND size_bytes > 10240 AS o, doc_id % 5 = 0 AS d"


def _noted(spark, sf_dir):
    binary = F.coalesce(F.col("doc_id") % 13 == 0, F.lit(False))
    return tables.files(spark, sf_dir).select(
        "pack_id",
        "path",
        binary.alias("b"),
        (~binary & (F.col("size_bytes") > 10_240)).alias("o"),
        F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False)).alias("d"),
    )


@query(
    "p10_unavailable_note",
    with_views(
        f"""SELECT pack_id, path, CASE WHEN b THEN '(binary file, contents not included)' WHEN o THEN '(file >10KB, contents skipped)'
          WHEN d THEN '(omitted to fit token budget)' ELSE '(no content)' END AS note FROM (SELECT *, {NOTE_FLAGS} FROM files)""",
        v.FILES,
    ),
)
def p10(spark, sf_dir):
    note = text.unavailable_note(F.col("b"), F.col("o"), F.col("d"), 10)
    return _noted(spark, sf_dir).select("pack_id", "path", note.alias("note"))


@query(
    "p11_tree_suffix",
    with_views(
        f"""SELECT pack_id, path, CASE WHEN b THEN ' [binary]' WHEN o THEN ' [skipped >10KB]'
          WHEN d THEN ' [omitted: token budget]' ELSE '' END AS suffix FROM (SELECT *, {NOTE_FLAGS} FROM files)""",
        v.FILES,
    ),
)
def p11(spark, sf_dir):
    suffix = text.tree_suffix(F.col("b"), F.col("o"), F.col("d"), 10)
    return _noted(spark, sf_dir).select("pack_id", "path", suffix.alias("suffix"))


@query(
    "p13_safety_line",
    with_views(
        f"""SELECT doc_id, CASE WHEN hits > 0 THEN concat('Safety: ', hits, ' secrets were detected and automatically redacted.')
          ELSE 'Safety: No secrets were detected. Manual review is still recommended.' END AS line FROM r{len(redact.RULES)}""",
        PLANTED,
        *v.redactions_sql("planted", "content"),
    ),
)
def p13(spark, sf_dir):
    return redact.redact(_planted(spark, sf_dir)).select("doc_id", text.safety_line(F.col("redactions")).alias("line"))


# ------------------------------------------------------------------------ shaping

# Code-like text for the comment strippers: every line gets a comment of some sort.
STYLED = """styled AS (
  SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l, i:
    CASE i % 5 WHEN 1 THEN '# ' || l WHEN 2 THEN '  -- ' || l WHEN 3 THEN '' WHEN 4 THEN '/* ' || l || ' */ x' ELSE l END) AS ls
  FROM documents)"""


def _styled(spark, sf_dir):
    styled = F.transform(
        text.lines(F.col("text")),
        lambda line, i: F.when((i + 1) % 5 == 1, F.concat(F.lit("# "), line))
        .when((i + 1) % 5 == 2, F.concat(F.lit("  -- "), line))
        .when((i + 1) % 5 == 3, F.lit(""))
        .when((i + 1) % 5 == 4, F.concat(F.lit("/* "), line, F.lit(" */ x")))
        .otherwise(line),
    )
    docs = tables.documents(spark, sf_dir, "doc_id", "text")
    return docs.select("doc_id", F.array_join(styled, "\n").alias("content"))


# The same segmentation in a regex subset without possessive quantifiers.
C_SEGMENTS_SQL = (
    r'''"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*["\n]?|''[^''\\\n]*(?:\\[\s\S][^''\\\n]*)*[''\n]?'''
    r'''|`[^`\\]*(?:\\[\s\S][^`\\]*)*`?|//[^\n]*|/\*[\s\S]*?(?:\*/|\z)|[^"''`/]+|[\s\S]'''
)


def strip_c_sql(content: str) -> str:
    bare = (
        f"array_to_string(list_transform(regexp_extract_all({content}, '{C_SEGMENTS_SQL}'), lambda s: CASE "
        "WHEN starts_with(s, '//') THEN '' WHEN starts_with(s, '/*') THEN regexp_replace(s, '[^\n]+', '', 'g') ELSE s END), '')"
    )
    return (
        f"array_to_string(list_transform(list_filter(list_zip(string_split({bare}, chr(10)), string_split({content}, chr(10))), "
        r"lambda p: regexp_matches(p[1], '\S') OR NOT regexp_matches(p[2], '\S')), lambda p: p[1]), chr(10))"
    )


@query(
    "p14_strip_by_extension",
    with_views(
        rf"""SELECT pack_id, path, CASE
          WHEN path LIKE '%.py' THEN array_to_string(list_filter(string_split(content, chr(10)), lambda l: NOT regexp_matches(l, '^\s*#')), chr(10))
          WHEN path LIKE '%.sql' THEN array_to_string(list_filter(string_split(content, chr(10)), lambda l: NOT regexp_matches(l, '^\s*--')), chr(10))
          WHEN path LIKE '%.html' OR path LIKE '%.md' THEN regexp_replace(content, '<!--[\s\S]*?-->', '', 'g')
          WHEN path LIKE '%.ts' OR path LIKE '%.go' THEN {strip_c_sql('content')}
          ELSE content END AS content
        FROM (SELECT pack_id, path, concat('# a // z', chr(10), content, chr(10), '-- b', chr(10), '<!-- c -->', chr(10), 'x <!-- d --> y') AS content
              FROM files)""",
        v.FILES,
    ),
)
def p14(spark, sf_dir):
    dressed = F.concat(F.lit("# a // z\n"), "content", F.lit("\n-- b\n<!-- c -->\nx <!-- d --> y"))
    return tables.files(spark, sf_dir).withColumn("content", dressed).select(
        "pack_id", "path", shape.strip_comments(F.col("path"), F.col("content")).alias("content")
    )


QUOTED = """quoted AS (
  SELECT doc_id, concat(array_to_string(ls, chr(10)), chr(10), 'const u = "http://x/*y*/"; // tail', chr(10), '/* open', chr(10),
    array_to_string(ls, chr(10))) AS content FROM styled)"""


@query(
    "p14a_strip_c_comments",
    with_views(f"SELECT doc_id, {strip_c_sql('content')} AS content FROM quoted", STYLED, QUOTED),
)
def p14a(spark, sf_dir):
    quoted = F.concat("content", F.lit('\nconst u = "http://x/*y*/"; // tail\n/* open\n'), "content")
    return _styled(spark, sf_dir).withColumn("content", quoted).select(
        "doc_id", shape.strip_c_comments(F.col("content")).alias("content")
    )


@query(
    "p14b_strip_hash_comments",
    with_views(
        r"SELECT doc_id, array_to_string(list_filter(ls, lambda l: NOT regexp_matches(l, '^\s*#')), chr(10)) AS content FROM styled",
        STYLED,
    ),
)
def p14b(spark, sf_dir):
    return _styled(spark, sf_dir).select("doc_id", shape.strip_hash_comments(F.col("content")).alias("content"))


@query(
    "p14c_strip_html_comments",
    """WITH c AS (SELECT page_id, concat(html, chr(10), '<!-- a', chr(10), page_id, ' -->tail<!--') AS html FROM pages)
       SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '<!--[\\s\\S]*?(?:-->|\\z)|[^<]+|<'), lambda s:
         CASE WHEN NOT starts_with(s, '<!--') THEN s WHEN ends_with(s, '-->') AND length(s) > 6
           THEN regexp_replace(s, '[^\\n]+', '', 'g') ELSE '' END), '') AS html FROM c""",
)
def p14c(spark, sf_dir):
    tail = F.concat("html", F.lit("\n<!-- a\n"), F.col("page_id").cast("string"), F.lit(" -->tail<!--"))
    pages = tables.table(spark, sf_dir, "pages").withColumn("html", tail)
    return pages.select("page_id", shape.strip_html_comments(F.col("html")).alias("html"))


@query(
    "p14c_strip_css_comments",
    with_views(
        r"SELECT doc_id, regexp_replace(array_to_string(ls, chr(10)), '/\*[^\n]*?\*/', '', 'g') AS content FROM styled", STYLED
    ),
)
def p14c_css(spark, sf_dir):
    return _styled(spark, sf_dir).select("doc_id", shape.strip_css_comments(F.col("content")).alias("content"))


@query(
    "p14d_strip_dash_comments",
    with_views(
        r"SELECT doc_id, array_to_string(list_filter(ls, lambda l: NOT regexp_matches(l, '^\s*--')), chr(10)) AS content FROM styled",
        STYLED,
    ),
)
def p14d(spark, sf_dir):
    return _styled(spark, sf_dir).select("doc_id", shape.strip_dash_comments(F.col("content")).alias("content"))


@query(
    "p15_remove_blank_lines",
    with_views(
        r"SELECT doc_id, array_to_string(list_filter(ls, lambda l: regexp_matches(l, '\S')), chr(10)) AS content FROM styled",
        STYLED,
    ),
)
def p15(spark, sf_dir):
    return _styled(spark, sf_dir).select("doc_id", shape.remove_blank_lines(F.col("content")).alias("content"))


SKELETON = r"""marked AS (
  SELECT pack_id, path, i, line, regexp_matches(line, '^\s*(import\s|from\s.+\simport\s|def\s|class\s|@|if\s+__name__)') AS kept
  FROM src_lines WHERE regexp_matches(line, '\S')),
runs AS (SELECT *, lag(kept, 1, true) OVER (PARTITION BY pack_id, path ORDER BY i) AS after_kept FROM marked),
skeletons AS (
  SELECT pack_id, path, string_agg(CASE WHEN kept THEN regexp_replace(line, '\{\s*$', '{ /* … */ }') ELSE '    ...' END, chr(10) ORDER BY i) AS content
  FROM runs WHERE kept OR after_kept GROUP BY pack_id, path)"""


@query(
    "p16_signatures",
    with_views("SELECT pack_id, path, content FROM skeletons", v.FILES, v.LINES, v.SRC, SKELETON),
)
def p16(spark, sf_dir):
    return tables.source_like(spark, sf_dir).select(
        "pack_id", "path", shape.signatures(F.col("path"), F.col("content")).alias("content")
    )


# Which lines stay is known from how the file was made.
BRACE_SKELETON = """brace_lines AS (
  SELECT pack_id, path, i, i % 6 IN (0, 1, 3) AS kept,
    CASE i % 6 WHEN 0 THEN concat('import ', substr(line, 1, 20)) WHEN 1 THEN concat('export function f', i, '(a) { /* … */ }')
      WHEN 3 THEN concat('  method', i, '(x: string): number { /* … */ }') ELSE '  // …' END AS shown
  FROM lines WHERE regexp_matches(path, '\\.(ts|go)$') AND i % 6 <> 2),
brace_runs AS (SELECT *, lag(kept, 1, true) OVER (PARTITION BY pack_id, path ORDER BY i) AS after_kept FROM brace_lines)"""


@query(
    "p16_brace_signatures",
    with_views(
        "SELECT pack_id, path, string_agg(shown, chr(10) ORDER BY i) AS content, count(*) FILTER (WHERE NOT kept) AS runs "
        "FROM brace_runs WHERE kept OR after_kept GROUP BY pack_id, path",
        v.FILES,
        v.LINES,
        BRACE_SKELETON,
    ),
)
def p16_braces(spark, sf_dir):
    skeleton = tables.brace_source_like(spark, sf_dir).select(
        "pack_id", "path", shape.signatures(F.col("path"), F.col("content")).alias("content")
    )
    marks = F.filter(text.lines(F.col("content")), lambda line: line == F.lit(fixed.ELIDED_OTHER))
    return skeleton.withColumn("runs", F.size(marks).cast("bigint"))


@query(
    "w3_elided_runs",
    with_views(
        "SELECT pack_id, path, count(*) FILTER (WHERE NOT kept AND after_kept) AS runs FROM runs GROUP BY ALL",
        v.FILES,
        v.LINES,
        v.SRC,
        SKELETON,
    ),
)
def w3(spark, sf_dir):
    skeleton = shape.signatures(F.col("path"), F.col("content"))
    marks = F.filter(text.lines(skeleton), lambda line: line == F.lit(fixed.ELIDED_PYTHON))
    return tables.source_like(spark, sf_dir).select("pack_id", "path", F.size(marks).cast("bigint").alias("runs"))


STRIPPED_SRC = r"""stripped AS (
  SELECT pack_id, path, string_agg(line, chr(10) ORDER BY i) AS content FROM src_lines
  WHERE NOT regexp_matches(line, '^\s*#') AND regexp_matches(line, '\S') GROUP BY ALL)"""


@query(
    "p17_shape",
    with_views(
        "SELECT s.pack_id, s.path, s.content AS compressed, t.content AS stripped FROM skeletons s JOIN stripped t USING (pack_id, path)",
        v.FILES,
        v.LINES,
        v.SRC,
        SKELETON,
        STRIPPED_SRC,
    ),
)
def p17(spark, sf_dir):
    path, content = F.col("path"), F.col("content")
    return tables.source_like(spark, sf_dir).select(
        "pack_id",
        "path",
        shape.shape(path, content, compress=True, comments=True, blank_lines=True).alias("compressed"),
        shape.shape(path, content, comments=True, blank_lines=True).alias("stripped"),
    )


@query(
    "p18_remote_names",
    r"""WITH u AS (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN regexp_extract(url, '//([^/]*)', 1) || '/repo_' || page_id
            WHEN 1 THEN url || '.git' ELSE url END AS ref FROM pages),
         c AS (SELECT *, regexp_replace(regexp_replace(ref, '\.git$', ''), '/+$', '') AS bare FROM u)
       SELECT page_id, CASE WHEN regexp_matches(ref, '^[\w.-]+/[\w.-]+$') THEN 'https://github.com/' || ref || '.git' ELSE ref END AS url,
         CASE WHEN list_last(string_split(bare, '/')) = '' THEN 'remote'
           ELSE regexp_replace(list_last(string_split(bare, '/')), '[^\w.-]+', '-', 'g') END AS name FROM c""",
)
def p18(spark, sf_dir):
    ref = (
        F.when(
            F.col("page_id") % 3 == 0,
            F.concat(F.regexp_extract("url", "//([^/]*)", 1), F.lit("/repo_"), F.col("page_id").cast("string")),
        )
        .when(F.col("page_id") % 3 == 1, F.concat("url", F.lit(".git")))
        .otherwise(F.col("url"))
    )
    return tables.table(spark, sf_dir, "pages").select(
        "page_id", paths.remote_url(ref).alias("url"), paths.remote_name(ref).alias("name")
    )


@query(
    "p19_output_name",
    """SELECT DISTINCT source AS pack_id, concat('packlake-', source, CASE lang WHEN 'en' THEN '.xml' WHEN 'fr' THEN '.json'
         WHEN 'de' THEN '.txt' ELSE '.md' END) AS name FROM documents""",
)
def p19(spark, sf_dir):
    fmt = (
        F.when(F.col("lang") == "en", "xml").when(F.col("lang") == "fr", "JSON").when(F.col("lang") == "de", "plain").otherwise("markdown")
    )
    docs = tables.table(spark, sf_dir, "documents").select("source", "lang").distinct()
    return docs.select(F.col("source").alias("pack_id"), text.output_name(fmt, F.col("source")).alias("name")).distinct()


@query(
    "p20_hog_share",
    with_views(
        """SELECT pack_id, path, 100.0 * tokens / total AS percent, CASE WHEN 100.0 * tokens / total > 20 THEN 'red'
             WHEN 100.0 * tokens / total > 10 THEN 'yellow' ELSE 'plain' END AS band
           FROM (SELECT *, sum(tokens) OVER (PARTITION BY pack_id) AS total,
                   row_number() OVER (PARTITION BY pack_id ORDER BY tokens DESC, path) AS rn FROM stats WHERE tokens > 0) WHERE rn <= 5""",
        v.FILES,
        v.STATS_SMALL,
    ),
)
def p20(spark, sf_dir):
    plan = v.plan(spark, sf_dir, PackSpec(collation=v.BINARY))
    return pack.hogs(plan).select("pack_id", F.col("entry").alias("path"), "percent", "band")


@query(
    "p22_task_preview",
    """SELECT conv_id, turn, CASE WHEN NOT regexp_matches(text, '\\S') THEN '(none)' WHEN length(text) > 40 THEN substr(text, 1, 37) || '...' ELSE text END AS preview
       FROM conversations""".replace("\\\\", "\\"),
)
def p22(spark, sf_dir):
    return tables.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.task_preview(F.col("text")).alias("preview")
    )


SAVINGS_SQL = with_views(
    """SELECT pack_id, before AS chars_before, after AS chars_after, files AS compressed_files, floor((before - after) / before * 100 + 0.5)::BIGINT AS saved_percent
       FROM (SELECT o.pack_id, sum(length(o.content))::BIGINT AS before, sum(length(s.content))::BIGINT AS after, count(*) AS files
             FROM (SELECT pack_id, path, string_agg(line, chr(10) ORDER BY i) AS content FROM src_lines GROUP BY ALL) o
             JOIN skeletons s USING (pack_id, path) GROUP BY 1)""",
    v.FILES,
    v.LINES,
    v.SRC,
    SKELETON,
)


@query("p24_shaping_savings", SAVINGS_SQL)
def p24(spark, sf_dir):
    files = scan.add_flags(tables.source_like(spark, sf_dir)).filter(scan.has_content())
    skeleton = shape.signatures(F.col("path"), F.col("content"))
    sizes = files.select(
        "pack_id",
        F.length("content").alias("chars_before"),
        F.length(F.coalesce(skeleton, F.col("content"))).alias("chars_after"),
        skeleton.isNotNull().alias("is_compressed"),
    )
    return rollup.shaping_savings(sizes)


@query("a8_pack_savings", SAVINGS_SQL)
def a8_savings(spark, sf_dir):
    """The same out of a plan that compresses."""
    files = tables.source_like(spark, sf_dir).select("pack_id", "path", "size_bytes", "content")
    return pack.pack(files, replace(v.SPEC, compress=True)).savings


@query(
    "p25_ancestors",
    with_views(
        """SELECT pack_id, path, array_to_string(list_transform(generate_series(1, len(string_split(path, '/')) - 1),
             lambda n: array_to_string(string_split(path, '/')[1:n], '/')), '|') AS dirs, (len(string_split(path, '/')))::INT AS depth FROM mixed""",
        v.FILES,
        v.MIXED,
    ),
)
def p25(spark, sf_dir):
    path = F.col("path")
    return v.mixed(spark, sf_dir).select(
        "pack_id", "path", F.array_join(paths.ancestors(path), "|").alias("dirs"), paths.depth(path).alias("depth")
    )


RECIPE_SQL = "(VALUES " + ", ".join(
    "('" + n + "', '" + p.replace("'", "''").replace("\n", "'||chr(10)||'") + "')" for n, (_, p) in fixed.RECIPES.items()
) + ") r(name, prompt)"


@query(
    "p26_compose_task",
    f"""SELECT conv_id, turn, concat_ws(chr(10) || chr(10), CASE WHEN turn % 2 = 0 THEN text END, prompt) AS task
        FROM conversations LEFT JOIN {RECIPE_SQL} ON r.name = CASE conv_id % 3 WHEN 0 THEN 'review' WHEN 1 THEN 'audit' END""",
)
def p26(spark, sf_dir):
    turns = tables.table(spark, sf_dir, "conversations")
    name = F.when(F.col("conv_id") % 3 == 0, "Review").when(F.col("conv_id") % 3 == 1, "AUDIT")
    own = F.when(F.col("turn") % 2 == 0, F.col("text"))
    task = F.coalesce(text.compose_task(own, lookups.recipe_prompt(name)), F.lit(""))
    return turns.select("conv_id", "turn", task.alias("task"))


@query(
    "p27_commit_line",
    "SELECT event_id, concat(substr(md5(event_id::VARCHAR), 1, 7), ' ', strftime(ts, '%Y-%m-%d'), ' ', event_type) AS line FROM events",
)
def p27(spark, sf_dir):
    events = tables.table(spark, sf_dir, "events")
    digest = F.substring(F.md5(F.col("event_id").cast("string")), 1, 7)
    return events.select("event_id", text.commit_line(digest, F.col("ts"), F.col("event_type")).alias("line"))


@query(
    "p28_normalize_path",
    with_views("SELECT pack_id, replace(path, '/', chr(92)) AS raw, path FROM mixed", v.FILES, v.MIXED),
)
def p28(spark, sf_dir):
    raw = F.replace("path", F.lit("/"), F.lit("\\"))
    return v.mixed(spark, sf_dir).select("pack_id", raw.alias("raw"), paths.normalize(raw).alias("path"))
