"""Scans, sources and filters."""

from pyspark.sql import functions as F

from catalog import views as v
from catalog.registry import query, with_views
from packlake import fixed
from packlake.functions import text
from packlake.operators import history, ignore, scan, stack
from packlake.plans import pack, store
from packlake.sources import corpus, tables
from packlake.session import materialize
from packlake.spec import PackSpec


@query("s1_corpus_scan", with_views("SELECT pack_id, path, size_bytes FROM files", v.FILES))
def s1(spark, sf_dir):
    rows = tables.files(spark, sf_dir).select("pack_id", "path", "content")
    return corpus.from_table(rows).select("pack_id", "path", "size_bytes")


@query(
    "s2_scan_paths",
    with_views(
        "SELECT pack_id, path FROM files WHERE starts_with(path, 'en/') OR starts_with(path, 'fr/shard_1/') "
        "OR path = 'package.json'",
        v.FILES,
    ),
)
def s2(spark, sf_dir):
    return scan.restrict(
        tables.files(spark, sf_dir), ["en/", "./fr/shard_1", "es/../package.json"]
    ).select("pack_id", "path")


SCAN_ENTRIES = "entries AS (SELECT DISTINCT source AS pack_id, concat(lang, '/shard_', doc_id % 9) AS entry FROM documents)"


def _scan_entries(spark, sf_dir):
    return (
        tables.table(spark, sf_dir, "documents")
        .select(
            F.col("source").alias("pack_id"),
            F.concat("lang", F.lit("/shard_"), (F.col("doc_id") % 9).cast("string")).alias("entry"),
        )
        .distinct()
    )


@query(
    "s2_missing_scan_paths",
    with_views(
        "SELECT pack_id, entry FROM entries e WHERE NOT EXISTS (SELECT 1 FROM files f "
        "WHERE f.pack_id = e.pack_id AND (f.path = e.entry OR starts_with(f.path, e.entry || '/')))",
        v.FILES,
        SCAN_ENTRIES,
    ),
)
def s2_missing(spark, sf_dir):
    return scan.missing_scan_paths(tables.files(spark, sf_dir), _scan_entries(spark, sf_dir))


@query(
    "s3_path_list",
    with_views(
        "SELECT f.pack_id, f.path FROM files f JOIN labels l ON f.doc_id = l.doc_id WHERE l.quality = 1 "
        "AND l.doc_id % 3 <> 0",
        v.FILES,
    ),
)
def s3(spark, sf_dir):
    files = tables.files(spark, sf_dir)
    labels = tables.table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    listed = files.select("doc_id", "pack_id", "path").join(labels, "doc_id")
    raw = F.when(F.col("doc_id") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "path", F.lit("\r")))
    entries = listed.select("pack_id", text.trim(raw).alias("entry")).filter("entry <> ''")
    return scan.restrict_by_table(files, entries).select("pack_id", "path")


RULE_LINES = r"""rl AS (
  SELECT pack_id, path, trim(l, ' ' || chr(13)) AS pattern
  FROM (SELECT pack_id, path, unnest(string_split(content, chr(10))) AS l FROM mixed
        WHERE path = '.gitignore' OR path LIKE '%/.gitignore' OR path = '.packlakeignore')
  WHERE trim(l, ' ' || chr(13)) <> '' AND NOT starts_with(trim(l, ' ' || chr(13)), '#'))"""


@query(
    "s4_root_rules",
    with_views(
        "SELECT pack_id, pattern, count(*) AS n FROM rl WHERE path NOT LIKE '%/%' GROUP BY ALL",
        v.FILES,
        v.MIXED,
        RULE_LINES,
    ),
)
def s4(spark, sf_dir):
    lines = ignore.rule_lines(v.mixed(spark, sf_dir)).filter("base = ''")
    return lines.groupBy("pack_id", "pattern").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s5_nested_rules",
    with_views(
        "SELECT pack_id, replace(path, '/.gitignore', '') AS base, pattern, "
        "len(string_split(path, '/'))::INT - 1 AS depth FROM rl WHERE path LIKE '%/%' AND NOT starts_with(path, 'node_modules/')",
        v.FILES,
        v.MIXED,
        RULE_LINES,
    ),
)
def s5(spark, sf_dir):
    lines = ignore.rule_lines(v.mixed(spark, sf_dir)).filter("base <> ''")
    return lines.select("pack_id", "base", "pattern", "depth")


@query(
    "s6_bounded_read",
    with_views(
        "SELECT pack_id, path, size_bytes, CASE WHEN size_bytes <= 10240 THEN md5(content) END AS digest FROM files",
        v.FILES,
    ),
)
def s6(spark, sf_dir):
    return v.flagged(spark, sf_dir, 10_240).select(
        "pack_id", "path", "size_bytes", F.md5("content").alias("digest")
    )


@query(
    "s7_decode_text",
    """SELECT page_id, md5(t) AS digest, length(t) AS n
       FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN chr(65533) || html ELSE html END AS t FROM pages)""",
)
def s7(spark, sf_dir):
    """A byte that is no UTF-8 becomes the replacement character."""
    encoded = F.encode("html", "UTF-8")
    damaged = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(b"\xff"), encoded)).otherwise(encoded)
    raw = tables.table(spark, sf_dir, "pages").select("page_id", damaged.alias("raw"))
    return raw.select(
        "page_id", F.md5(corpus.decode()).alias("digest"), F.length(corpus.decode()).cast("bigint").alias("n")
    )


@query(
    "s8_manifest_read",
    with_views(
        "SELECT DISTINCT pack_id, path, dependency FROM declared",
        v.MANIFESTS,
    ),
)
def s8(spark, sf_dir):
    return v.manifests(spark, sf_dir).select(
        "pack_id", "path", F.explode(stack.dependency_names(F.col("content"))).alias("dependency")
    )


@query(
    "s9_touches",
    with_views("SELECT pack_id, path, count(*) AS n FROM touches GROUP BY ALL", v.FILES, v.TOUCHES),
)
def s9(spark, sf_dir):
    return tables.touches(spark, sf_dir).groupBy("pack_id", "path").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s10_commit_log",
    with_views(
        "SELECT pack_id, rn AS commit_no, concat(substr(hash, 1, 7), ' ', strftime(ts, '%Y-%m-%d'), ' ', subject) AS line "
        "FROM (SELECT *, row_number() OVER (PARTITION BY pack_id ORDER BY ts DESC, hash DESC)::INT AS rn FROM commits) WHERE rn <= 20",
        v.COMMITS,
    ),
)
def s10(spark, sf_dir):
    return history.commit_log(tables.commits(spark, sf_dir))


# ---------------------------------------------------------------------- filters


@query(
    "f1_default_excludes",
    with_views(
        f"SELECT pack_id, path FROM mixed WHERE NOT {v.DEFAULT_EXCLUDED_SQL.format('path')}", v.FILES, v.MIXED
    ),
)
def f1(spark, sf_dir):
    return v.mixed(spark, sf_dir).filter(~ignore.is_default_excluded(F.col("path"))).select("pack_id", "path")


@query(
    "f2_root_rules",
    with_views(f"SELECT pack_id, path, {v.ROOT_VERDICT_SQL} AS ignored FROM mixed", v.FILES, v.MIXED),
)
def f2(spark, sf_dir):
    rules = ["*.json", "!package.json", "doc_2?.txt", "fr/shard_1/", "/de/**/doc_1*"]
    return v.mixed(spark, sf_dir).select(
        "pack_id", "path", ignore.ignored_by_rules(F.col("path"), rules).alias("ignored")
    )


def _rejected(spark, sf_dir, excludes=None):
    mixed = v.mixed(spark, sf_dir)
    return ignore.ignored_paths(mixed, materialize(ignore.rule_sets(ignore.rule_lines(mixed))), excludes)


@query(
    "f3_rule_cascade",
    with_views(f"SELECT pack_id, path FROM mixed WHERE {v.CASCADE_SQL}", v.FILES, v.MIXED),
)
def f3(spark, sf_dir):
    return _rejected(spark, sf_dir)


F4_SQL = rf"""(CASE
    WHEN starts_with(lower(path), 'es/shard_3/') AND regexp_matches(lower(path), '/doc_1[^/]*\.py$') THEN false
    WHEN starts_with(lower(path), 'es/shard_3/') AND regexp_matches(lower(path), '\.py$') THEN true
    WHEN starts_with(lower(path), 'en/shard_2/') OR regexp_matches(lower(path), '^en/.*/shard_2/') THEN true
    WHEN starts_with(lower(path), 'en/') AND lower(path) LIKE '%.json' THEN false
    WHEN starts_with(lower(path), 'fr/shard_1/') THEN true
    WHEN regexp_matches(lower(path), '(^|/)doc_1[^/]*\.json$') THEN false
    WHEN regexp_matches(lower(path), '\.(py|go)$') THEN true
    ELSE {v.ROOT_VERDICT_SQL} END)"""


@query(
    "f4_excludes_with_rescue",
    with_views(f"SELECT pack_id, path FROM mixed WHERE {F4_SQL}", v.FILES, v.MIXED),
)
def f4(spark, sf_dir):
    return _rejected(spark, sf_dir, ["**/*.py", "*.go", "!doc_1*.json"])


@query(
    "j3_paths_by_rules",
    with_views(
        f"SELECT pack_id, count(*) AS paths, count(*) FILTER (WHERE {v.CASCADE_SQL}) AS ignored FROM mixed GROUP BY pack_id",
        v.FILES,
        v.MIXED,
    ),
)
def j3(spark, sf_dir):
    mixed = v.mixed(spark, sf_dir)
    rejected = _rejected(spark, sf_dir).withColumn("hit", F.lit(1))
    return (
        mixed.select("pack_id", "path")
        .join(rejected, ["pack_id", "path"], "left")
        .groupBy("pack_id")
        .agg(F.count(F.lit(1)).alias("paths"), F.count("hit").alias("ignored"))
    )


SELECTED = rf"""selected AS (
  SELECT pack_id, path, NOT {v.DEFAULT_EXCLUDED_SQL.format('path')} AS is_candidate,
    (NOT {v.DEFAULT_EXCLUDED_SQL.format('path')} AND NOT {v.CASCADE_SQL})
      OR regexp_matches(path, '^node_modules/.*\.(ts|go|md)$') OR regexp_matches(path, '\.env$') AS is_selected,
    {v.SUSPICIOUS_SQL} AS is_suspicious FROM mixed)"""
INCLUDE_SPEC = PackSpec(includes=["node_modules/**/*.{ts,go,md}", "**/*.env"])


@query("f5_force_include", with_views("SELECT pack_id, path FROM selected WHERE is_selected", v.FILES, v.MIXED, SELECTED))
def f5(spark, sf_dir):
    return scan.select_files(v.mixed(spark, sf_dir), INCLUDE_SPEC).filter("is_selected").select("pack_id", "path")


GROUP_SPEC = PackSpec(includes=["node_modules/**/!(*[02468]).@(ts|go|md)", "**/+(doc_|[13579]).json", "**/doc_{10..19}*.env"])


@query(
    "f5_group_includes",
    with_views(
        rf"""SELECT pack_id, path FROM mixed WHERE (NOT {v.DEFAULT_EXCLUDED_SQL.format('path')} AND NOT {v.CASCADE_SQL})
             OR (regexp_matches(path, '^node_modules/(.*/)?[^/]*\.(ts|go|md)$') AND NOT regexp_matches(path, '[02468]\.(ts|go|md)$'))
             OR regexp_matches(path, '(^|/)(doc_|[13579])+\.json$') OR regexp_matches(path, '(^|/)doc_1[0-9][^/]*\.env$')""",
        v.FILES,
        v.MIXED,
    ),
)
def f5_groups(spark, sf_dir):
    """Includes with negated, chosen and repeated groups and a range."""
    return scan.select_files(v.mixed(spark, sf_dir), GROUP_SPEC).filter("is_selected").select("pack_id", "path")


@query("u1_include_union", with_views("SELECT pack_id, count(DISTINCT path) AS files FROM selected WHERE is_selected GROUP BY 1", v.FILES, v.MIXED, SELECTED))
def u1(spark, sf_dir):
    picked = scan.select_files(v.mixed(spark, sf_dir), INCLUDE_SPEC).filter("is_selected")
    return picked.groupBy("pack_id").agg(F.count(F.lit(1)).alias("files"))


@query("f6_suspicious_paths", with_views("SELECT pack_id, path FROM selected WHERE is_selected AND is_suspicious", v.FILES, v.MIXED, SELECTED))
def f6(spark, sf_dir):
    return scan.suspicious(scan.select_files(v.mixed(spark, sf_dir), INCLUDE_SPEC))


@query(
    "a6_prune_counts",
    with_views(
        "SELECT pack_id, count(*) FILTER (WHERE is_candidate) AS total_entries, "
        "count(*) FILTER (WHERE is_candidate) - count(*) FILTER (WHERE is_selected) AS ignored_entries, "
        "count(*) FILTER (WHERE is_selected AND is_suspicious) AS suspicious_entries FROM selected GROUP BY pack_id",
        v.FILES,
        v.MIXED,
        SELECTED,
    ),
)
def a6(spark, sf_dir):
    return scan.prune_counts(scan.select_files(v.mixed(spark, sf_dir), INCLUDE_SPEC))


@query(
    "pack_prunes_excluded",
    with_views(
        f"""SELECT m.pack_id, m.path, CASE WHEN content <> '' AND strlen(content) <= {fixed.DEFAULT_MAX_FILE_BYTES}
              THEN {v.PRETOKEN.format(v.redacted_sql('content'))} ELSE 0 END AS tokens
            FROM mixed m JOIN selected s USING (pack_id, path) WHERE is_candidate OR is_selected""",
        v.FILES,
        v.MIXED,
        SELECTED,
    ),
)
def pack_prunes_excluded(spark, sf_dir):
    """Only paths within reach are ever counted."""
    return pack.pack(v.mixed(spark, sf_dir), INCLUDE_SPEC).selection.select("pack_id", "path", "tokens")


@query(
    "f7_binary_flag",
    with_views(
        "SELECT pack_id, path, is_binary, NOT is_binary AND size_bytes > 10240 AS is_oversized FROM flagged",
        v.FILES,
        # two odd bytes make a short text binary, but not a long one
        """flagged AS (SELECT *, coalesce(CASE WHEN doc_id % 13 = 0 THEN true WHEN doc_id % 17 = 0 THEN strlen(content) + 2 < 20
                       ELSE doc_id % 19 = 0 END, false) AS is_binary FROM files)""",
    ),
)
def f7(spark, sf_dir):
    raw = F.encode("content", "UTF-8")
    damaged = (
        F.when(F.col("doc_id") % 13 == 0, F.concat(raw, F.lit(b"\x00tail")))
        .when(F.col("doc_id") % 17 == 0, F.concat(F.lit(b"\xff\xfe"), raw))
        .when(F.col("doc_id") % 19 == 0, F.concat(F.lit(b"\xff" * 300), raw))
        .otherwise(raw)
    )
    files = tables.files(spark, sf_dir).withColumn("raw", damaged)
    return scan.add_flags(files, 10_240).select("pack_id", "path", "is_binary", "is_oversized")


@query(
    "f8_oversized_flag",
    with_views("SELECT pack_id, path, size_bytes, size_bytes > 10240 AS is_oversized FROM files", v.FILES),
)
def f8(spark, sf_dir):
    return v.flagged(spark, sf_dir, 10_240).select("pack_id", "path", "size_bytes", "is_oversized")


@query(
    "f9_lite_mode",
    with_views(
        r"SELECT pack_id, path FROM mixed WHERE lower(path) LIKE '%/package.json' OR lower(path) = 'package.json' OR NOT "
        r"regexp_matches(lower(path), '\.(css|scss|sass|less|json|svg|png|jpg|jpeg|ico|ttf|otf|woff|woff2)$')",
        v.FILES,
        v.MIXED,
    ),
)
def f9(spark, sf_dir):
    rules = PackSpec(lite=True).root_rules()
    return v.mixed(spark, sf_dir).filter(~ignore.ignored_by_rules(F.col("path"), rules)).select("pack_id", "path")


@query(
    "f10_changed_only",
    with_views(
        "SELECT f.pack_id, f.path, f.size_bytes FROM files f JOIN changed c USING (pack_id, path)",
        v.FILES,
        v.TOUCHES,
        v.CHANGED,
    ),
)
def f10(spark, sf_dir):
    changed = history.changed_set(*tables.changed_sources(spark, sf_dir))
    return history.only_changed(tables.files(spark, sf_dir), changed).select("pack_id", "path", "size_bytes")


@query(
    "f11_own_output",
    with_views("SELECT pack_id, path FROM files WHERE path <> 'en/shard_0/doc_21.html'", v.FILES),
)
def f11(spark, sf_dir):
    rules = PackSpec(own_output="en/shard_0/doc_21.html").root_rules()
    return tables.files(spark, sf_dir).filter(~ignore.ignored_by_rules(F.col("path"), rules)).select("pack_id", "path")


@query(
    "f12_has_content",
    with_views("SELECT pack_id, path, content <> '' AND size_bytes <= 10240 AS has_content FROM files", v.FILES),
)
def f12(spark, sf_dir):
    return v.flagged(spark, sf_dir, 10_240).select("pack_id", "path", scan.has_content().alias("has_content"))


@query(
    "f13_files_with_tokens",
    with_views("SELECT pack_id, path, tokens FROM stats WHERE tokens > 0", v.FILES, v.STATS_SMALL),
)
def f13(spark, sf_dir):
    return v.stats(spark, sf_dir, v.SMALL).filter("tokens > 0").select("pack_id", "path", "tokens")


@query(
    "f14_line_predicate",
    with_views(
        r"""SELECT pack_id, path, i, line FROM lines WHERE regexp_matches(line, '(?i)token\s*=\s*"[0-9a-f]+"|license')""",
        v.FILES,
        v.LINES,
    ),
)
def f14(spark, sf_dir):
    test = store.line_predicate(spark, r"""token\s*=\s*"[0-9a-f]+"|license""", ignore_case=True)
    return tables.lines(spark, sf_dir).withColumnRenamed("line", "text").filter(test).withColumnRenamed("text", "line")


@query(
    "u3_distinct_scan_paths",
    with_views(
        "SELECT pack_id, count(*) AS files FROM files WHERE starts_with(path, 'en/') GROUP BY 1", v.FILES
    ),
)
def u3(spark, sf_dir):
    files = tables.files(spark, sf_dir)
    overlapping = files.select("pack_id").distinct().select(
        "pack_id", F.explode(F.array(F.lit("en"), F.lit("en/shard_1"), F.lit("en/shard_2"))).alias("entry")
    )
    return scan.restrict_by_table(files, overlapping).groupBy("pack_id").agg(F.count(F.lit(1)).alias("files"))
