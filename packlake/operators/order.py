"""Output orders of a pack (O1-O4) and ordinals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlake import fixed
from packlake.operators.spread import running


def path_key(column: str = "path", collation: str = "UNICODE") -> Column:
    """Locale-aware by default; ``UTF8_BINARY`` compares code points."""
    return F.col(column) if collation == "UTF8_BINARY" else F.collate(column, collation)


def order_keys(sort: str = "path", collation: str = "UNICODE") -> list[Column]:
    """Ascending keys; most-edited or largest files come last."""
    first = {"path": [], "churn": [F.coalesce("churn", F.lit(0))], "size": [F.col("size_bytes")]}[sort]
    keys = [*first, path_key("path", collation)]
    return keys if collation == "UTF8_BINARY" else [*keys, F.col("path")]


def manifest_first(collation: str = "UNICODE") -> list[Column]:
    """Scan order: the root manifest, then paths (O2)."""
    return [F.col("path") != F.lit(fixed.MANIFEST), *order_keys("path", collation)]


def with_ordinal(files: DataFrame, keys: list[Column], name: str = "ordinal") -> DataFrame:
    """1-based position inside the pack without gathering the pack.

    Pass a narrow table: the ordered rows are written once.
    """
    return running(files, ["pack_id"], [k.asc() for k in keys], {}, number=name)


def ordered(files: DataFrame, keys: list[Column]) -> DataFrame:
    """Globally sorted by pack and key; a range sort, so hot packs are split."""
    return files.orderBy(F.col("pack_id"), *keys)
