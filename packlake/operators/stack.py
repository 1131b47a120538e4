"""Technology stack of a pack from its manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlake import fixed
from packlake.functions import paths

MANIFEST_SCHEMA = "dependencies MAP<STRING,STRING>, devDependencies MAP<STRING,STRING>"


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for item in table.items() for x in item])


def dependency_names(content: Column) -> Column:
    """Keys of both dependency maps; empty for invalid JSON."""
    parsed = F.from_json(content, MANIFEST_SCHEMA)
    none = F.array().cast("array<string>")
    return F.array_union(
        F.coalesce(F.map_keys(parsed["dependencies"]), none),
        F.coalesce(F.map_keys(parsed["devDependencies"]), none),
    )


def file_technologies(path: Column, content: Column) -> Column:
    """Technologies one file stands for: by its name, or by its dependencies."""
    name = paths.basename(path)
    by_name = F.try_element_at(_lookup(fixed.FILENAME_TECH), name)
    by_dependency = F.filter(
        F.transform(
            dependency_names(content),
            lambda d: F.try_element_at(_lookup(fixed.DEPENDENCY_TECH), d),
        ),
        lambda t: t.isNotNull(),
    )
    return F.when(name == F.lit(fixed.MANIFEST), by_dependency).when(
        by_name.isNotNull(), F.array(by_name)
    )


def tech_stack(files: DataFrame) -> DataFrame:
    """Sorted distinct technologies per pack; at most 22 values each.

    Reads unredacted text of manifests only.  Packs without any are absent.
    """
    names = [fixed.MANIFEST, *fixed.FILENAME_TECH]
    found = files.filter(paths.basename(F.col("path")).isin(names)).select(
        "pack_id", file_technologies(F.col("path"), F.col("content")).alias("techs")
    )
    return gather(found)


def gather(found: DataFrame) -> DataFrame:
    """Distinct sorted union of the ``techs`` arrays of each pack; combined map-side."""
    return (
        found.select("pack_id", F.explode("techs").alias("tech"))
        .groupBy("pack_id")
        .agg(F.sort_array(F.collect_set("tech")).alias("tech_stack"))
    )
