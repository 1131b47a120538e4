"""Column functions over slash-separated relative paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(path: Column) -> Column:
    """Use ``/`` as the only separator."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Directory part without trailing slash; empty for top-level paths."""
    return F.when(
        F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")
    ).otherwise(F.lit(""))


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; a leading dot does not start one."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def segments(path: Column) -> Column:
    """Non-empty path segments."""
    return F.filter(F.split(path, "/"), lambda s: s != F.lit(""))


def ancestors(path: Column) -> Column:
    """All proper directory prefixes, shallowest first; empty array at top level (P25)."""
    seg = segments(path)
    return F.when(
        F.size(seg) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(seg) - 1),
            lambda n: F.array_join(F.slice(seg, F.lit(1), n), "/"),
        ),
    ).otherwise(F.array().cast("array<string>"))


def depth(path: Column) -> Column:
    """Number of segments; 0 for the root."""
    return F.when(path == F.lit(""), F.lit(0)).otherwise(F.size(segments(path)))


def remote_url(ref: Column) -> Column:
    """``owner/name`` becomes a clone URL, anything else is kept."""
    return F.when(
        F.rlike(ref, F.lit(r"\A[\w.-]+/[\w.-]+\z")),
        F.concat(F.lit("https://github.com/"), ref, F.lit(".git")),
    ).otherwise(ref)


def remote_name(ref: Column) -> Column:
    """Last URL segment with unusual characters replaced; never empty."""
    bare = F.regexp_replace(F.regexp_replace(ref, r"\.git\z", ""), r"/+\z", "")
    name = F.regexp_replace(F.substring_index(bare, "/", -1), r"[^\w.-]+", "-")
    return F.when(name == F.lit(""), F.lit("remote")).otherwise(name)
