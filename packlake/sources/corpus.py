"""Corpus sources: tables of files, directories, path lists."""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packlake.functions import paths, text


def from_table(
    rows: DataFrame, pack_id: str = "pack_id", path: str = "path", content: str = "content"
) -> DataFrame:
    """Any table with a pack, a path and text becomes a ``files`` table."""
    return rows.select(
        F.col(pack_id).alias("pack_id"),
        paths.normalize(F.col(path)).alias("path"),
        F.octet_length(content).cast("bigint").alias("size_bytes"),
        F.col(content).alias("content"),
    )


def decode(raw: str = "raw"):
    """Lenient UTF-8 decoding of bytes."""
    return F.make_valid_utf8(F.col(raw).cast("string"))


def root_path(root: str) -> str:
    """Path of a directory without its scheme and authority; a bare path is made absolute."""
    found = re.match(r"[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", root)
    return (root[found.end() :] if found else os.path.abspath(root)).rstrip("/")


def relative_path(file: Column, root: str) -> Column:
    """Path of a listed file below ``root``; the listing may name it with any scheme and authority."""
    bare = F.regexp_replace(file, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    return F.regexp_replace(bare, "^" + _quote(root_path(root)) + "/", "")


def _quote(literal: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "/_" else c for c in literal)


def from_directory(
    spark: SparkSession, root: str, pack_id: str, max_bytes: int
) -> DataFrame:
    """Files below a directory of a shared file system.

    The size limit is a pushed filter, so oversized bytes are never read; such
    files are listed from their length alone.  Spark's own listing hides names
    that start with a dot or underscore; add :func:`from_path_list` for those.
    """
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    )
    small = listed.filter(F.col("length") <= max_bytes).select(
        F.col("path").alias("file"), F.col("length").alias("size_bytes"), F.col("content").alias("raw")
    )
    large = listed.filter(F.col("length") > max_bytes).select(
        F.col("path").alias("file"),
        F.col("length").alias("size_bytes"),
        F.lit(None).cast("binary").alias("raw"),
    )
    return small.unionByName(large).select(
        F.lit(pack_id).alias("pack_id"), relative_path(F.col("file"), root).alias("path"), "size_bytes", "raw"
    )


def _read_files(batches: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Read the files named in ``file``; larger ones are reported without bytes."""
    for batch in batches:
        sizes, bodies = [], []
        for name in batch.column("file").to_pylist():
            size = os.path.getsize(name)
            sizes.append(size)
            if size > max_bytes:
                bodies.append(None)
                continue
            with open(name, "rb") as handle:
                bodies.append(handle.read())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("pack_id"),
                batch.column("path"),
                pa.array(sizes, pa.int64()),
                pa.array(bodies, pa.binary()),
            ],
            names=["pack_id", "path", "size_bytes", "raw"],
        )


def from_path_list(
    listing: DataFrame, root: str, max_bytes: int, files_per_task: int = 256
) -> DataFrame:
    """Read listed files, hidden ones included, from a mounted file system.

    ``listing`` has pack_id and path relative to ``root``.  Reading is spread
    over tasks of about ``files_per_task`` files.
    """
    tasks = max(1, math.ceil(listing.count() / files_per_task))
    prefix = os.path.abspath(root) + "/"
    named = listing.select("pack_id", "path", F.concat(F.lit(prefix), F.col("path")).alias("file"))
    return named.repartition(tasks, "pack_id", "path").mapInArrow(
        lambda batches: _read_files(batches, max_bytes),
        "pack_id string, path string, size_bytes bigint, raw binary",
    )


def path_list(spark: SparkSession, file: str, nul_separated: bool = False) -> DataFrame:
    """Paths from a text file, one per line or NUL separated; blanks dropped (S3)."""
    reader = spark.read.option("lineSep", "\u0000") if nul_separated else spark.read
    entries = (
        reader.text(file)
        .select(text.trim(F.col("value")).alias("entry"))
        .filter(F.col("entry") != F.lit(""))
    )
    if entries.isEmpty():
        raise ValueError("no paths were read")
    return entries
