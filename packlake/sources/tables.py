"""Derived tables: the given parquet tables seen as corpora with history.

``documents.source`` plays the pack, a derived path plays the file name.  The
same views are written in SQL in the catalog, so results can be compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from packlake.functions import text

# Extension by doc_id % 8.
EXTENSIONS = [".md", ".py", ".ts", ".go", ".sql", ".html", ".json", ".txt"]
MANIFEST_TEXT = '{"dependencies":{"react":"1","koa":"2"}}'
CHANGED_SINCE = "2024-01-30 00:00:00"


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the footers once per path."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*columns)


def document_path():
    ext = F.element_at(
        F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % 8 + 1).cast("int")
    )
    return F.concat(
        "lang",
        F.lit("/shard_"),
        (F.col("doc_id") % 7).cast("string"),
        F.lit("/doc_"),
        F.col("doc_id").cast("string"),
        ext,
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per document plus a root manifest per source."""
    docs = documents(spark, sf_dir, "doc_id", "lang", "source", "text")
    body = docs.select(
        F.col("source").alias("pack_id"),
        document_path().alias("path"),
        "doc_id",
        F.octet_length("text").cast("bigint").alias("size_bytes"),
        F.col("text").alias("content"),
    )
    return body.unionByName(manifests(spark, sf_dir))


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "documents")
        .select(F.col("source").alias("pack_id"))
        .distinct()
        .select(
            "pack_id",
            F.lit("package.json").alias("path"),
            F.lit(None).cast("bigint").alias("doc_id"),
            F.lit(40).cast("bigint").alias("size_bytes"),
            F.lit(MANIFEST_TEXT).alias("content"),
        )
    )


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits touch the file of their user and one other file."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    named = docs.select("doc_id", F.col("source").alias("pack_id"), document_path().alias("path"))
    first = events.withColumn("doc_id", F.col("user_id"))
    second = events.withColumn("doc_id", (F.col("user_id") * 7 + 1) % 200)
    return (
        first.unionByName(second)
        .join(named, "doc_id")
        .select(F.col("event_id").alias("commit_id"), "ts", "pack_id", "path")
    )


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pack_id, path, part, diff): the removal of every toxic document, its file header and its one hunk apart."""
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    docs = documents(spark, sf_dir, "doc_id", "lang", "source", "text").join(toxic, "doc_id", "left_semi")
    head = F.concat(F.lit("--- a/"), document_path(), F.lit("\n+++ /dev/null"))
    n = (F.regexp_count("text", F.lit("\n")) + 1).cast("string")
    hunk = F.concat(F.lit("@@ -1,"), n, F.lit(" +0,0 @@\n-"), F.replace("text", F.lit("\n"), F.lit("\n-")))
    pieces = F.posexplode(F.array(head, hunk)).alias("part", "diff")
    return docs.select(F.col("source").alias("pack_id"), document_path().alias("path"), pieces)


def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pack_id, persona, recipe, task): choices of single packs, by the last letter of their name."""
    kind = F.ascii(F.right("source", F.lit(1))) % 5
    return table(spark, sf_dir, "documents").select("source").distinct().select(
        F.col("source").alias("pack_id"),
        F.when(kind == 0, "SEC").when(kind == 1, "refactor").alias("persona"),
        F.when(kind == 2, "Audit").alias("recipe"),
        F.when(kind == 3, " \t").when(kind == 4, F.concat(F.lit("Look at "), "source")).alias("task"),
    )


def credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credential-shaped files, one for every ninth document, with its text."""
    docs = documents(spark, sf_dir, "doc_id", "source", "text").filter("doc_id % 9 = 4")
    path = F.concat(F.lit("deploy/doc_"), F.col("doc_id").cast("string"), F.lit(".pem"))
    return docs.select(
        F.col("source").alias("pack_id"), path.alias("path"), F.octet_length("text").cast("bigint").alias("size_bytes"), F.col("text").alias("content")
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit per event in the pack of its user's document."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("user_id"), F.col("source").alias("pack_id")
    )
    return events.join(docs, "user_id").select(
        "pack_id",
        F.md5(F.col("event_id").cast("string")).alias("hash"),
        "ts",
        F.concat("event_type", F.lit(" #"), F.col("event_id").cast("string")).alias("subject"),
    )


def changed_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(pack_id, path) of recent error commits, and of toxic documents."""
    recent = (
        table(spark, sf_dir, "events")
        .filter((F.col("event_type") == "error") & (F.col("ts") >= F.lit(CHANGED_SINCE).cast("timestamp")))
        .select(F.col("event_id").alias("commit_id"))
    )
    diff = touches(spark, sf_dir).join(recent, "commit_id", "left_semi").select("pack_id", "path")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    untracked = docs.join(toxic, "doc_id", "left_semi").select(
        F.col("source").alias("pack_id"), document_path().alias("path")
    )
    return diff, untracked


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines of every file."""
    return files(spark, sf_dir).select(
        "pack_id", "path", F.posexplode(text.lines(F.col("content"))).alias("i", "line")
    )


def source_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python-looking files: the lines of ``.py`` files recast by line number."""
    shaped = F.transform(
        text.lines(F.col("content")),
        lambda line, i: F.when(i % 6 == 0, F.concat(F.lit("import "), F.substring(line, 1, 20)))
        .when(i % 6 == 1, F.concat(F.lit("# "), line))
        .when(i % 6 == 2, F.lit(""))
        .when(i % 6 == 3, F.concat(F.lit("def f"), i.cast("string"), F.lit("():")))
        .otherwise(F.concat(F.lit("    "), line)),
    )
    return (
        files(spark, sf_dir)
        .filter(F.endswith("path", F.lit(".py")))
        .withColumn("content", F.array_join(shaped, "\n"))
        .withColumn("size_bytes", F.octet_length("content").cast("bigint"))
    )


def brace_source_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in a language with braces: the lines of ``.ts`` and ``.go`` files recast by line number."""
    number = lambda i: i.cast("string")
    shaped = F.transform(
        text.lines(F.col("content")),
        lambda line, i: F.when(i % 6 == 0, F.concat(F.lit("import "), F.substring(line, 1, 20)))
        .when(i % 6 == 1, F.concat(F.lit("export function f"), number(i), F.lit("(a) {")))
        .when(i % 6 == 2, F.lit(""))
        .when(i % 6 == 3, F.concat(F.lit("  method"), number(i), F.lit("(x: string): number {")))
        .when(i % 6 == 4, F.concat(F.lit("    return "), F.substring(line, 1, 10), F.lit(";")))
        .otherwise(F.concat(F.lit("    // "), line)),
    )
    return (
        files(spark, sf_dir)
        .filter(F.rlike("path", F.lit("\\.(ts|go)$")))
        .withColumn("content", F.array_join(shaped, "\n"))
        .withColumn("size_bytes", F.octet_length("content").cast("bigint"))
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as HTML files, one pack per host."""
    raw = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return raw.select(
        F.parse_url("url", F.lit("HOST")).alias("pack_id"),
        F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.octet_length("html").cast("bigint").alias("size_bytes"),
        F.col("html").alias("content"),
    )
