"""Joins, aggregates, windows, orders and set operations."""

from pyspark.sql import functions as F

from catalog import views as v
from catalog.registry import query, with_views
from packlake import fixed
from packlake.functions import redact, shape, text
from packlake.operators import budget, history, lookups, order, rollup, scan, stack
from packlake.operators.spread import top_rows
from packlake.plans import pack
from packlake.session import materialize
from packlake.sources import tables
from packlake.spec import PackSpec


# ------------------------------------------------------------------------ flagship


@query(
    "flagship_budget_hogs",
    with_views(
        f"""SELECT h.pack_id, h.rank, h.path, h.tokens, h.is_omitted, d.tokens AS dir_tokens, t.total::BIGINT AS total_tokens, t.omitted AS omitted_files
        FROM (SELECT pack_id, path, tokens, is_omitted, row_number() OVER (PARTITION BY pack_id ORDER BY tokens DESC, path)::INT AS rank
              FROM budgeted WHERE tokens > 0) h
        JOIN dirs d ON d.pack_id = h.pack_id AND d.dir = CASE WHEN contains(h.path, '/') THEN string_split(h.path, '/')[1] ELSE '' END
        JOIN (SELECT pack_id, sum(tokens) FILTER (WHERE NOT is_omitted) AS total, count(*) FILTER (WHERE is_omitted) AS omitted
              FROM budgeted GROUP BY 1) t ON t.pack_id = h.pack_id
        WHERE h.rank <= 5""",
        v.FILES,
        v.STATS_SMALL,
        v.DIRS,
        v.OMITTED,
    ),
)
def flagship(spark, sf_dir):
    """Token budget per source, with the five heaviest files and their top directories."""
    stats = materialize(v.stats(spark, sf_dir, v.SMALL))
    marked = budget.mark_omitted(stats, v.BUDGET, order.order_keys("path", v.BINARY))
    totals = marked.groupBy("pack_id").agg(
        F.sum(F.when(~F.col("is_omitted"), F.col("tokens"))).cast("bigint").alias("total_tokens"),
        F.count_if("is_omitted").alias("omitted_files"),
    )
    top = top_rows(
        marked.filter("tokens > 0").select("pack_id", "path", "tokens", "is_omitted"),
        ["pack_id"],
        [F.col("tokens").desc(), F.col("path").asc()],
        5,
        "rank",
    ).withColumn(
        "dir", F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise(F.lit(""))
    )
    dirs = rollup.directory_tokens(stats).select("pack_id", "dir", F.col("tokens").alias("dir_tokens"))
    return top.join(dirs, ["pack_id", "dir"]).join(totals, "pack_id").drop("dir")


# --------------------------------------------------------------------------- joins


@query(
    "j1_changed_semi_join",
    with_views(
        "SELECT pack_id, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM files WHERE (pack_id, path) IN (SELECT (pack_id, path) FROM changed) GROUP BY 1",
        v.FILES,
        v.TOUCHES,
        v.CHANGED,
    ),
)
def j1(spark, sf_dir):
    changed = history.changed_set(*tables.changed_sources(spark, sf_dir))
    picked = history.only_changed(tables.files(spark, sf_dir).select("pack_id", "path", "size_bytes"), changed)
    return picked.groupBy("pack_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size_bytes").cast("bigint").alias("bytes")
    )


CHURN = f"""newest AS (
  SELECT pack_id, commit_id FROM (SELECT pack_id, commit_id, row_number() OVER (PARTITION BY pack_id ORDER BY max(ts) DESC, commit_id DESC) AS rn
    FROM touches GROUP BY pack_id, commit_id) WHERE rn <= {fixed.DEFAULT_CHURN_COMMITS}),
churn AS (SELECT pack_id, path, count(*) AS churn FROM touches SEMI JOIN newest USING (pack_id, commit_id) GROUP BY ALL)"""


@query("a5_churn", with_views("SELECT pack_id, path, churn FROM churn", v.FILES, v.TOUCHES, CHURN))
def a5(spark, sf_dir):
    return history.churn(tables.touches(spark, sf_dir))


@query(
    "j2_files_with_churn",
    with_views(
        "SELECT pack_id, path, coalesce(churn, 0) AS churn FROM files LEFT JOIN churn USING (pack_id, path)",
        v.FILES,
        v.TOUCHES,
        CHURN,
    ),
)
def j2(spark, sf_dir):
    files = tables.files(spark, sf_dir).select("pack_id", "path")
    return history.with_churn(files, history.churn(tables.touches(spark, sf_dir)))


WINDOWS_SQL = "(VALUES " + ", ".join(f"('{n}', {w}::BIGINT)" for n, w in fixed.MODEL_WINDOWS) + ') w(label, "window")'


@query(
    "j4_window_fit",
    with_views(
        f"""SELECT pack_id, label, total_tokens, "window", floor(total_tokens / "window" * 100 + 0.5)::BIGINT AS percent,
             CASE WHEN total_tokens > "window" THEN 'does not fit' WHEN total_tokens / "window" > 0.7 THEN 'tight' ELSE 'fits' END AS verdict
           FROM (SELECT pack_id, sum(tokens)::BIGINT AS total_tokens FROM stats GROUP BY 1), {WINDOWS_SQL}""",
        v.FILES,
        v.STATS_SMALL,
    ),
)
def j4(spark, sf_dir):
    totals = rollup.pack_totals(v.stats(spark, sf_dir, v.SMALL))
    return rollup.fit_report(totals).drop("bar", "filled")


@query(
    "p21_fit_bars",
    with_views(
        f"""SELECT pack_id, label, least(20, floor(total_tokens / "window" * 20 + 0.5))::INT AS filled,
             repeat('█', least(20, floor(total_tokens / "window" * 20 + 0.5))::INT) || repeat('░', 20 - least(20, floor(total_tokens / "window" * 20 + 0.5))::INT) AS bar
           FROM (SELECT pack_id, sum(tokens)::BIGINT AS total_tokens FROM stats GROUP BY 1), {WINDOWS_SQL}""",
        v.FILES,
        v.STATS_SMALL,
    ),
)
def p21(spark, sf_dir):
    totals = rollup.pack_totals(v.stats(spark, sf_dir, v.SMALL))
    return rollup.fit_report(totals).select("pack_id", "label", "filled", "bar")


@query(
    "p23_token_severity",
    with_views(
        "SELECT pack_id, total_tokens, CASE WHEN total_tokens < 50000 THEN 'green' WHEN total_tokens <= 100000 THEN 'yellow' ELSE 'red' END AS severity, "
        "total_tokens > 50000 AS over_warning FROM (SELECT pack_id, sum(tokens)::BIGINT AS total_tokens FROM stats GROUP BY 1)",
        v.FILES,
        v.STATS,
    ),
)
def p23(spark, sf_dir):
    total = F.col("total_tokens")
    return rollup.pack_totals(v.stats(spark, sf_dir)).select(
        "pack_id",
        "total_tokens",
        text.token_severity(total).alias("severity"),
        (total > fixed.TOKEN_BUDGET_WARNING).alias("over_warning"),
    )


@query(
    "j5_tokens_by_path",
    with_views("SELECT pack_id, path, size_bytes, has_content, tokens FROM stats", v.FILES, v.STATS),
)
def j5(spark, sf_dir):
    return v.stats(spark, sf_dir).select("pack_id", "path", "size_bytes", "has_content", "tokens")


RECIPE_TITLES = "(VALUES " + ", ".join(f"('{n}', '{t}')" for n, (t, _) in fixed.RECIPES.items()) + ") r(name, title)"


@query(
    "j7_recipe_lookup",
    f"""SELECT source AS pack_id, count(*) AS documents, title FROM (SELECT source, (['review','test','refactor','onboard','document','audit'])[substr(source, 4)::INT % 6 + 1] AS n FROM documents)
        JOIN {RECIPE_TITLES} ON r.name = n GROUP BY ALL""",
)
def j7(spark, sf_dir):
    names = F.array(*[F.lit(n.upper()) for n in fixed.RECIPES])
    name = F.element_at(names, (F.substring("source", 4, 9).cast("int") % 6 + 1))
    return (
        tables.table(spark, sf_dir, "documents")
        .select(F.col("source").alias("pack_id"), lookups.recipe_title(name).alias("title"))
        .groupBy("pack_id", "title")
        .agg(F.count(F.lit(1)).alias("documents"))
    )


PERSONA_SQL = "(VALUES " + ", ".join(
    f"('{fixed.PERSONA_SLUGS[n]}', '{h}')" for n, h in fixed.PERSONA_HEADERS.items()
) + ") p(slug, header)"


@query(
    "p12_persona_header",
    f"""SELECT DISTINCT d.source AS pack_id, header FROM documents d JOIN {PERSONA_SQL}
        ON p.slug = (['arch','sec','ref'])[substr(d.source, 4)::INT % 3 + 1]""",
)
def p12(spark, sf_dir):
    names = F.array(F.lit("Arch"), F.lit("security"), F.lit("REF"))
    name = F.element_at(names, F.substring("source", 4, 9).cast("int") % 3 + 1)
    docs = tables.table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("pack_id"), lookups.persona_header(name).alias("header")).distinct()


SNAPSHOT = """old AS (SELECT pack_id, path, content FROM files WHERE coalesce(doc_id % 10, 0) <> 1),
new AS (SELECT pack_id, path, CASE WHEN doc_id % 10 = 3 THEN upper(content) ELSE content END AS content FROM files WHERE coalesce(doc_id % 10, 0) <> 2)"""


@query(
    "j10_snapshot_diff",
    with_views(
        """SELECT pack_id, path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted'
             WHEN o.content = n.content THEN 'same' ELSE 'modified' END AS status FROM old o FULL JOIN new n USING (pack_id, path)""",
        v.FILES,
        SNAPSHOT,
    ),
)
def j10(spark, sf_dir):
    files = tables.files(spark, sf_dir)
    digit = F.coalesce(F.col("doc_id") % 10, F.lit(0))
    edited = F.when(digit == 3, F.upper("content")).otherwise(F.col("content"))
    new = files.filter(digit != 2).withColumn("content", edited)
    return history.snapshot_diff(files.filter(digit != 1), new.withColumn("size_bytes", F.octet_length("content").cast("bigint")))


# ---------------------------------------------------------------------- aggregates


@query(
    "a1_total_tokens",
    with_views("SELECT pack_id, sum(tokens)::BIGINT AS total_tokens FROM stats GROUP BY 1", v.FILES, v.STATS),
)
def a1(spark, sf_dir):
    return rollup.pack_totals(v.stats(spark, sf_dir)).select("pack_id", "total_tokens")


@query("a2_directory_rollup", with_views("SELECT pack_id, dir, tokens, depth FROM dirs", v.FILES, v.STATS, v.DIRS))
def a2(spark, sf_dir):
    return rollup.directory_tokens(v.stats(spark, sf_dir))


@query(
    "a3_total_redactions",
    with_views(
        "SELECT pack_id, sum(hits)::BIGINT AS redactions FROM " + f"r{len(redact.RULES)}" + " GROUP BY 1", v.FILES, *v.redactions_sql("files", "content")
    ),
)
def a3(spark, sf_dir):
    files = redact.redact(tables.files(spark, sf_dir).select("pack_id", "content"))
    return files.groupBy("pack_id").agg(F.sum("redactions").cast("bigint").alias("redactions"))


STACK_FILES = """manifests AS (
  SELECT pack_id, path, content FROM files
  UNION ALL
  SELECT pack_id, regexp_replace(path, '[^/]*$', '') || CASE doc_id % 40 WHEN 0 THEN 'package.json' WHEN 1 THEN 'go.mod' WHEN 2 THEN 'Cargo.toml'
      WHEN 3 THEN 'requirements.txt' WHEN 4 THEN 'package.json' ELSE 'x.txt' END,
    CASE doc_id % 40 WHEN 0 THEN '{"devDependencies":{"fastify":"^4","left-pad":"1"}}' WHEN 4 THEN '{"dependencies": {"vue"' ELSE '' END
  FROM files WHERE doc_id IS NOT NULL),
techs AS (
  SELECT DISTINCT pack_id, CASE WHEN path = 'package.json' THEN unnest(['React', 'Koa']) WHEN path LIKE '%/package.json' AND content LIKE '%fastify%' THEN 'Fastify'
    WHEN path LIKE '%/go.mod' THEN 'Go' WHEN path LIKE '%/Cargo.toml' THEN 'Rust' WHEN path LIKE '%/requirements.txt' THEN 'Python' END AS tech FROM manifests)"""


@query(
    "a4_tech_stack",
    with_views(
        "SELECT pack_id, string_agg(tech, ',' ORDER BY tech) AS tech_stack FROM techs WHERE tech IS NOT NULL GROUP BY 1", v.FILES, STACK_FILES
    ),
)
def a4(spark, sf_dir):
    files = tables.files(spark, sf_dir)
    kind = F.col("doc_id") % 40
    name = (
        F.when(kind.isin(0, 4), "package.json").when(kind == 1, "go.mod").when(kind == 2, "Cargo.toml").when(kind == 3, "requirements.txt").otherwise("x.txt")
    )
    body = (
        F.when(kind == 0, '{"devDependencies":{"fastify":"^4","left-pad":"1"}}')
        .when(kind == 4, '{"dependencies": {"vue"')
        .otherwise("")
    )
    extra = files.filter("doc_id IS NOT NULL").select(
        "pack_id", F.concat(F.regexp_replace("path", "[^/]*$", ""), name).alias("path"), body.alias("content")
    )
    both = files.select("pack_id", "path", "content").unionByName(extra)
    return stack.tech_stack(both).select("pack_id", F.array_join("tech_stack", ",").alias("tech_stack"))


@query(
    "u4_merged_dependencies",
    with_views(
        "SELECT pack_id, dependency AS dep, count(DISTINCT path) AS manifests FROM declared GROUP BY ALL",
        v.MANIFESTS,
    ),
)
def u4(spark, sf_dir):
    deps = v.manifests(spark, sf_dir).select("pack_id", F.explode(stack.dependency_names(F.col("content"))).alias("dep"))
    return deps.groupBy("pack_id", "dep").agg(F.count(F.lit(1)).alias("manifests"))


@query(
    "a7_file_counts",
    with_views(
        "SELECT pack_id, count(*) AS total_files, count(*) FILTER (WHERE is_oversized) AS oversized FROM stats GROUP BY 1",
        v.FILES,
        v.stats_sql(10_240),
    ),
)
def a7(spark, sf_dir):
    return v.flagged(spark, sf_dir, 10_240).groupBy("pack_id").agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if("is_oversized").alias("oversized")
    )


@query(
    "a9_auto_depth",
    with_views(
        "SELECT pack_id, coalesce(min(depth) FILTER (WHERE dir <> '' AND tokens > 0), 1)::INT AS hog_depth FROM dirs GROUP BY 1",
        v.FILES,
        v.STATS,
        v.DIRS,
    ),
)
def a9(spark, sf_dir):
    return rollup.auto_depth(rollup.directory_tokens(v.stats(spark, sf_dir)))


@query(
    "a12_name_width",
    with_views("SELECT pack_id, max(length(tokens::VARCHAR))::BIGINT AS pad, max(length(path))::BIGINT AS width FROM stats GROUP BY 1", v.FILES, v.STATS),
)
def a12(spark, sf_dir):
    stats = v.stats(spark, sf_dir)
    return stats.groupBy("pack_id").agg(
        F.max(F.length(F.col("tokens").cast("string"))).cast("bigint").alias("pad"),
        F.max(F.length("path")).cast("bigint").alias("width"),
    )


# ------------------------------------------------------------------------- windows


@query(
    "w1_token_budget",
    with_views("SELECT pack_id, path, tokens, is_omitted FROM budgeted", v.FILES, v.STATS_SMALL, v.OMITTED),
)
def w1(spark, sf_dir):
    stats = materialize(v.stats(spark, sf_dir, v.SMALL))
    marked = budget.mark_omitted(stats, v.BUDGET, order.order_keys("path", v.BINARY))
    return marked.select("pack_id", "path", "tokens", "is_omitted")


@query(
    "w1_byte_budget",
    with_views(
        """SELECT pack_id, path, path <> 'package.json' AND total - coalesce(sum(CASE WHEN path <> 'package.json' THEN size_bytes END) OVER (PARTITION BY pack_id
             ORDER BY size_bytes DESC, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 60000 AS is_omitted
           FROM (SELECT *, sum(size_bytes) OVER (PARTITION BY pack_id) AS total FROM files)""",
        v.FILES,
    ),
)
def w1_bytes(spark, sf_dir):
    sizes = materialize(
        tables.files(spark, sf_dir).select("pack_id", "path", "size_bytes", F.lit(True).alias("has_content"))
    )
    marked = budget.mark_omitted(sizes, 60_000, order.order_keys("path", v.BINARY), weight="size_bytes")
    return marked.select("pack_id", "path", "is_omitted")


@query(
    "q4_budget_report",
    with_views("SELECT pack_id, path, tokens AS tokens_before FROM budgeted WHERE is_omitted", v.FILES, v.STATS_SMALL, v.OMITTED),
)
def q4(spark, sf_dir):
    return v.plan(spark, sf_dir).omitted


@query(
    "j6_budget_by_path",
    with_views(
        "SELECT pack_id, path, is_omitted, has_content AND NOT is_omitted AS has_content FROM budgeted", v.FILES, v.STATS_SMALL, v.OMITTED
    ),
)
def j6(spark, sf_dir):
    return v.plan(spark, sf_dir).files.select("pack_id", "path", "is_omitted", "has_content")


def _ordinal_sql(keys: str) -> str:
    return f"SELECT pack_id, path, row_number() OVER (PARTITION BY pack_id ORDER BY {keys}) AS ordinal FROM files LEFT JOIN churn USING (pack_id, path)"


def _ordinals(spark, sf_dir, keys, churn=False):
    files = tables.files(spark, sf_dir).select("pack_id", "path", "size_bytes")
    if churn:
        files = history.with_churn(files, history.churn(tables.touches(spark, sf_dir)))
    return order.with_ordinal(files, keys).select("pack_id", "path", "ordinal")


_ORDER_VIEWS = (v.FILES, v.TOUCHES, CHURN)


@query("w5_output_ordinal", with_views(_ordinal_sql("path"), *_ORDER_VIEWS))
def w5(spark, sf_dir):
    return _ordinals(spark, sf_dir, order.order_keys("path", v.BINARY))


@query("o1_locale_path_order", with_views(_ordinal_sql("icu_sort_key(path, 'und'), path"), *_ORDER_VIEWS))
def o1(spark, sf_dir):
    return _ordinals(spark, sf_dir, order.order_keys("path"))


@query("o2_manifest_first", with_views(_ordinal_sql("path <> 'package.json', path"), *_ORDER_VIEWS))
def o2(spark, sf_dir):
    return _ordinals(spark, sf_dir, order.manifest_first(v.BINARY))


@query("o3_churn_order", with_views(_ordinal_sql("coalesce(churn, 0), path"), *_ORDER_VIEWS))
def o3(spark, sf_dir):
    return _ordinals(spark, sf_dir, order.order_keys("churn", v.BINARY), churn=True)


@query("o4_size_order", with_views(_ordinal_sql("size_bytes, path"), *_ORDER_VIEWS))
def o4(spark, sf_dir):
    return _ordinals(spark, sf_dir, order.order_keys("size", v.BINARY))


# -------------------------------------------------------------------- hogs and top-k


def _hog_sql(source: str, k: int, section: int) -> str:
    return (
        f"SELECT pack_id, {section} AS section, rank, entry, tokens FROM (SELECT pack_id, entry, tokens, "
        f"row_number() OVER (PARTITION BY pack_id ORDER BY tokens DESC, entry)::INT AS rank FROM ({source})) WHERE rank <= {k}"
    )


FILE_ENTRIES = "SELECT pack_id, path AS entry, tokens FROM stats WHERE tokens > 0"


def _dir_entries(depth: str) -> str:
    return f"SELECT d.pack_id, dir || '/' AS entry, tokens FROM dirs d WHERE dir <> '' AND tokens > 0 AND depth = {depth}"


AUTO = "(SELECT min(depth) FROM dirs a WHERE a.pack_id = d.pack_id AND a.dir <> '' AND a.tokens > 0)"
_HOG_VIEWS = (v.FILES, v.STATS, v.DIRS)


@query("o5_file_hogs", with_views(_hog_sql(FILE_ENTRIES, 5, 0), *_HOG_VIEWS))
def o5(spark, sf_dir):
    return rollup.file_hogs(v.stats(spark, sf_dir))


@query("o6_directory_hogs", with_views(_hog_sql(_dir_entries("2"), 5, 1), *_HOG_VIEWS))
def o6(spark, sf_dir):
    return rollup.directory_hogs(rollup.directory_tokens(v.stats(spark, sf_dir)), 2)


@query(
    "o7_auto_hogs",
    with_views(f"{_hog_sql(FILE_ENTRIES, 3, 0)} UNION ALL {_hog_sql(_dir_entries(AUTO), 2, 1)}", *_HOG_VIEWS),
)
def o7(spark, sf_dir):
    return rollup.auto_hogs(materialize(v.stats(spark, sf_dir)))


@query(
    "o8_summary_top_files",
    with_views(_hog_sql("SELECT pack_id, path AS entry, tokens FROM stats", 10, 0).replace("0 AS section, ", ""), v.FILES, v.STATS_SMALL),
)
def o8(spark, sf_dir):
    stats = v.stats(spark, sf_dir, v.SMALL).select("pack_id", F.col("path").alias("entry"), "tokens")
    return top_rows(stats, ["pack_id"], [F.col("tokens").desc(), F.col("entry").asc()], 10, "rank")


@query(
    "o9_dry_run",
    with_views("SELECT pack_id, path, CASE WHEN is_omitted THEN 0 ELSE tokens END AS tokens FROM budgeted", v.FILES, v.STATS_SMALL, v.OMITTED),
)
def o9(spark, sf_dir):
    return pack.dry_run(v.plan(spark, sf_dir))


@query(
    "o11_recent_commits",
    with_views(
        "SELECT pack_id, hash, commit_no FROM (SELECT *, row_number() OVER (PARTITION BY pack_id ORDER BY ts DESC, hash DESC)::INT AS commit_no FROM commits) WHERE commit_no <= 20",
        v.COMMITS,
    ),
)
def o11(spark, sf_dir):
    newest = history.recent_commits(tables.commits(spark, sf_dir), fixed.DEFAULT_LOG_COMMITS, key="hash")
    return newest.select("pack_id", "hash", "commit_no")


@query("u2_changed_set", with_views("SELECT pack_id, path FROM changed", v.FILES, v.TOUCHES, v.CHANGED))
def u2(spark, sf_dir):
    return history.changed_set(*tables.changed_sources(spark, sf_dir))


@query(
    "a8_shaping_chars",
    with_views(
        r"""SELECT pack_id, sum(length(content))::BIGINT AS chars_before, sum(length(array_to_string(list_filter(string_split(content, chr(10)),
              lambda l: regexp_matches(l, '\S')), chr(10))))::BIGINT AS chars_after
            FROM (SELECT pack_id, replace(content, '. ', '.' || chr(10) || ' ' || chr(10)) AS content FROM files WHERE size_bytes <= 102400 AND content <> '') GROUP BY 1""",
        v.FILES,
    ),
)
def a8(spark, sf_dir):
    files = v.flagged(spark, sf_dir).filter(scan.has_content())
    loose = F.replace("content", F.lit(". "), F.lit(".\n \n"))
    sizes = files.select(
        "pack_id",
        F.length(loose).alias("chars_before"),
        F.length(shape.remove_blank_lines(loose)).alias("chars_after"),
        F.lit(False).alias("is_compressed"),
    )
    return rollup.shaping_savings(sizes).select("pack_id", "chars_before", "chars_after")
