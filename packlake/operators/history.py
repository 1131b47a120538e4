"""Change history: churn, recent commits, changed sets, snapshot differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlake import fixed
from packlake.functions import text
from packlake.operators.spread import join_per_pack, top_rows


def recent_commits(commits: DataFrame, n: int, key: str = "commit_id") -> DataFrame:
    """Newest ``n`` commits per pack, numbered from the newest."""
    return top_rows(commits, ["pack_id"], [F.col("ts").desc(), F.col(key).desc()], n, "commit_no")


def commit_log(commits: DataFrame, n: int = fixed.DEFAULT_LOG_COMMITS) -> DataFrame:
    """Log lines of the newest commits."""
    return recent_commits(commits, n, key="hash").select(
        "pack_id",
        "commit_no",
        text.commit_line(F.substring("hash", 1, 7), F.col("ts"), F.col("subject")).alias("line"),
    )


def churn(touches: DataFrame, n: int = fixed.DEFAULT_CHURN_COMMITS) -> DataFrame:
    """Touches per path over the newest ``n`` commits of each pack."""
    commits = touches.groupBy("pack_id", "commit_id").agg(F.max("ts").alias("ts"))
    newest = recent_commits(commits, n).select("pack_id", "commit_id")
    return (
        join_per_pack(touches, newest, ["pack_id", "commit_id"], "left_semi")
        .groupBy("pack_id", "path")
        .agg(F.count(F.lit(1)).alias("churn"))
    )


def with_churn(files: DataFrame, counts: DataFrame) -> DataFrame:
    """Add ``churn``, 0 for untouched files."""
    return files.join(counts, ["pack_id", "path"], "left").withColumn(
        "churn", F.coalesce("churn", F.lit(0).cast("bigint"))
    )


def changed_set(diff: DataFrame, untracked: DataFrame) -> DataFrame:
    """Distinct trimmed paths of both sources, blanks dropped."""
    return (
        diff.select("pack_id", "path")
        .unionByName(untracked.select("pack_id", "path"))
        .withColumn("path", text.trim(F.col("path")))
        .filter(F.col("path") != F.lit(""))
        .distinct()
    )


def only_changed(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Files of the change set; deleted paths fall out."""
    return files.join(changed, ["pack_id", "path"], "left_semi")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """added / deleted / modified / same per path between two snapshots.

    Only keys and digests are shuffled, never the text.
    """

    def digest(df: DataFrame, tag: str) -> DataFrame:
        return df.select(
            "pack_id",
            "path",
            F.struct("size_bytes", F.sha2(F.coalesce("content", F.lit("")), 256).alias("sha")).alias(tag),
        )

    return (
        digest(old, "old")
        .join(digest(new, "new"), ["pack_id", "path"], "full_outer")
        .select(
            "pack_id",
            "path",
            F.when(F.col("old").isNull(), "added")
            .when(F.col("new").isNull(), "deleted")
            .when(F.col("old") == F.col("new"), "same")
            .otherwise("modified")
            .alias("status"),
        )
    )
