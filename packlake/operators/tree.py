"""Directory tree lines (K5, W4) without recursion.

Every path prefix is a node.  Directories are few compared with files, so the
branch prefix is worked out per directory and then joined to its children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlake.functions import paths, text
from packlake.operators.spread import join_per_pack


def tree_nodes(files: DataFrame, max_kb: int) -> DataFrame:
    """Distinct nodes: pack_id, node, parent, name, depth, label."""
    clean = F.array_join(paths.segments(F.col("path")), "/")
    suffix = text.tree_suffix(F.col("is_binary"), F.col("is_oversized"), F.col("is_omitted"), max_kb)
    directory = F.transform(
        paths.ancestors(F.col("path")), lambda d: F.struct(d.alias("node"), F.lit("").alias("suffix"))
    )
    leaf = F.array(F.struct(clean.alias("node"), suffix.alias("suffix")))
    return (
        files.select("pack_id", F.inline(F.concat(directory, leaf)))
        .groupBy("pack_id", "node")
        .agg(F.max("suffix").alias("suffix"))
        .select(
            "pack_id",
            "node",
            paths.dirname(F.col("node")).alias("parent"),
            paths.basename(F.col("node")).alias("name"),
            paths.depth(F.col("node")).alias("depth"),
            F.concat(paths.basename(F.col("node")), F.col("suffix")).alias("label"),
        )
    )


def _name_key(name: Column, collation: str) -> Column:
    return name if collation == "UTF8_BINARY" else F.collate(name, collation)


def tree_lines(files: DataFrame, max_kb: int = 100, collation: str = "UNICODE") -> DataFrame:
    """Rows (pack_id, node, tree_key, line); ordered by tree_key they print the tree."""
    nodes = tree_nodes(files, max_kb)
    if collation == "UTF8_BINARY":
        last_name = F.max("name")
    else:
        last_name = F.max_by("name", F.struct(_name_key(F.col("name"), collation), F.col("name")))
    last = nodes.groupBy("pack_id", "parent").agg(last_name.alias("last_name"))

    # Indentation a directory hands to its children: one piece per ancestor level.
    directories = last.select("pack_id", F.col("parent").alias("dir")).filter("dir <> ''")
    ancestry = directories.select(
        "pack_id",
        "dir",
        F.explode(F.concat(paths.ancestors(F.col("dir")), F.array("dir"))).alias("step"),
    ).select(
        "pack_id",
        "dir",
        paths.dirname(F.col("step")).alias("parent"),
        paths.basename(F.col("step")).alias("name"),
        paths.depth(F.col("step")).alias("level"),
    )
    indents = (
        join_per_pack(ancestry, last, ["pack_id", "parent"], "inner", spread_by="dir")
        .groupBy("pack_id", "dir")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "level",
                        F.when(F.col("name") == F.col("last_name"), "    ").otherwise("│   ").alias("piece"),
                    )
                )
            ).alias("pieces")
        )
        .select(
            "pack_id",
            F.col("dir").alias("parent"),
            F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("indent"),
        )
    )
    parents = last.join(indents, ["pack_id", "parent"], "left")
    branch = F.when(F.col("name") == F.col("last_name"), "└── ").otherwise("├── ")
    return join_per_pack(nodes, parents, ["pack_id", "parent"], "inner", spread_by="node").select(
        "pack_id",
        "node",
        F.transform(F.split("node", "/"), lambda s: _name_key(s, collation)).alias("tree_key"),
        F.concat(F.coalesce("indent", F.lit("")), branch, F.col("label")).alias("line"),
    )
