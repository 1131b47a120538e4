"""Shared pieces: table access, label splits, bounded samples, logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE_WORD = r"[^\x20\x09-\x0D]+"


BATCH_ROWS = 500


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches cut to ``BATCH_ROWS`` rows: texts are long, and a Python worker holds a batch whole."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id's decimal text, modulo 5, is 0.  A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def bounded(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A broadcast hint for a written, narrow table of at most ``rows`` rows; larger ones are joined by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, y, text) of at most ``per_class`` training rows of either label.

    Ids are taken in the order of a hash, so the sample is the same at every run,
    and of rows that repeat an id one, by a hash of its text.  Held-out rows, null
    labels and null ids never enter it.
    """
    known = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .distinct()
    )
    parts = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    # the limits above bound what is broadcast
    wanted = F.broadcast(parts[0].unionByName(parts[1]))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(wanted, "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))  # each map task sends one row an id
    return rows.groupBy("doc_id", "y").agg(one.alias("row")).select("doc_id", "y", "row.text")


def label_counts(labels: DataFrame, label: str) -> tuple[int, int]:
    """Training rows of label 0 and of label 1 over all labels."""
    y = F.col(label).cast("int")
    row = (
        labels.filter(y.isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .agg(F.count(F.when(y == 0, 1)).alias("n0"), F.count(F.when(y == 1, 1)).alias("n1"))
        .first()
    )
    return row.n0, row.n1


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: float, ridge: float = 0.1) -> dict:
    """Weighted ridge logistic regression by Newton steps; classes are weighted to ``prior``."""
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread == 0] = 1.0
    a = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    keep = np.eye(a.shape[1]) * ridge
    keep[-1, -1] = 1e-6
    beta = np.zeros(a.shape[1])
    for _ in range(50):
        p = sigmoid(a @ beta)
        gradient = a.T @ (weight * (y - p)) - keep @ beta
        hessian = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + keep
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return {"mean": mean, "spread": spread, "beta": beta}


def predict_logistic(model: dict, x: np.ndarray) -> np.ndarray:
    return sigmoid((x - model["mean"]) / model["spread"] @ model["beta"][:-1] + model["beta"][-1])
