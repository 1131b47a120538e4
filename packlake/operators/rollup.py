"""Token totals, directory roll-up, hog reports and the window-fit report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packlake import fixed
from packlake.functions import paths, text
from packlake.operators.spread import join_per_pack, top_rows


def pack_totals(stats: DataFrame) -> DataFrame:
    """Files and tokens per pack (A1, A7); combined map-side."""
    return stats.groupBy("pack_id").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.sum("tokens").cast("bigint").alias("total_tokens"),
    )


def directory_tokens(stats: DataFrame) -> DataFrame:
    """Tokens of every ancestor directory; ``""`` is the pack total (A2)."""
    dirs = F.concat(
        F.array(F.lit("")),
        F.when(F.col("tokens") > 0, paths.ancestors(F.col("path"))).otherwise(
            F.array().cast("array<string>")
        ),
    )
    return (
        stats.select("pack_id", "tokens", F.explode(dirs).alias("dir"))
        .groupBy("pack_id", "dir")
        .agg(F.sum("tokens").cast("bigint").alias("tokens"))
        .withColumn("depth", paths.depth(F.col("dir")))
    )


def _hogs(entries: DataFrame, k: int, section: int) -> DataFrame:
    order = [F.col("tokens").desc(), F.col("entry").asc()]
    return top_rows(entries, ["pack_id"], order, k, "rank").select(
        "pack_id", F.lit(section).alias("section"), "rank", "entry", "tokens"
    )


def file_hogs(stats: DataFrame, k: int = 5) -> DataFrame:
    """Heaviest files with tokens."""
    entries = stats.filter("tokens > 0").select("pack_id", F.col("path").alias("entry"), "tokens")
    return _hogs(entries, k, 0)


def directory_hogs(dirs: DataFrame, depth: int | Column, k: int = 5) -> DataFrame:
    """Heaviest directories at one depth."""
    at_depth = dirs.filter((F.col("dir") != F.lit("")) & (F.col("tokens") > 0) & (F.col("depth") == depth))
    entries = at_depth.select("pack_id", F.concat("dir", F.lit("/")).alias("entry"), "tokens")
    return _hogs(entries, k, 1)


def auto_depth(dirs: DataFrame) -> DataFrame:
    """Shallowest depth that has tokens, 1 when there is none."""
    return dirs.groupBy("pack_id").agg(
        F.coalesce(
            F.min(F.when((F.col("dir") != F.lit("")) & (F.col("tokens") > 0), F.col("depth"))), F.lit(1)
        ).alias("hog_depth")
    )


def auto_hogs(stats: DataFrame, files: int = 3, directories: int = 2) -> DataFrame:
    """Top files, then top directories at the automatic depth."""
    dirs = directory_tokens(stats)
    located = join_per_pack(dirs, auto_depth(dirs), ["pack_id"], "inner", spread_by="dir")
    return file_hogs(stats, files).unionByName(
        directory_hogs(located, F.col("hog_depth"), directories)
    )


def with_share(hogs: DataFrame, totals: DataFrame) -> DataFrame:
    """Percent of the pack and its band (P20); ``hogs`` has at most k rows per pack."""
    return (
        hogs.join(totals.select("pack_id", "total_tokens"), "pack_id")
        .withColumn("percent", text.share_percent(F.col("tokens"), F.col("total_tokens")))
        .withColumn("band", text.share_band(F.col("percent")))
    )


def model_windows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.MODEL_WINDOWS, "label string, window bigint")


def fit_report(totals: DataFrame) -> DataFrame:
    """How each pack fits each context window (J4, P21); five rows per pack."""
    windows = F.array(
        *[F.struct(F.lit(n).alias("label"), F.lit(w).cast("bigint").alias("window")) for n, w in fixed.MODEL_WINDOWS]
    )
    ratio = F.col("total_tokens") / F.col("window")
    return (
        totals.select("pack_id", "total_tokens", F.inline(windows))
        .withColumn("percent", F.round(ratio * 100).cast("bigint"))
        .withColumn("filled", F.least(F.lit(20), F.round(ratio * 20).cast("int")))
        .withColumn(
            "bar",
            F.concat(F.repeat(F.lit("█"), F.col("filled")), F.repeat(F.lit("░"), 20 - F.col("filled"))),
        )
        .withColumn(
            "verdict",
            F.when(ratio > 1, "does not fit").when(ratio > 0.7, "tight").otherwise("fits"),
        )
    )


def shaping_savings(before_after: DataFrame) -> DataFrame:
    """Characters before and after shaping, percent saved, files compressed."""
    return (
        before_after.groupBy("pack_id")
        .agg(
            F.sum("chars_before").cast("bigint").alias("chars_before"),
            F.sum("chars_after").cast("bigint").alias("chars_after"),
            F.count_if("is_compressed").alias("compressed_files"),
        )
        .withColumn(
            "saved_percent",
            F.when(
                F.col("chars_before") > 0,
                F.floor(
                    (F.col("chars_before") - F.col("chars_after")) / F.col("chars_before") * 100 + F.lit(0.5)
                ),
            ).cast("bigint"),
        )
    )
