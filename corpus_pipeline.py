"""A training corpus from raw documents, in stages that are written and read again in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlake.llm import bpe, common, linededup, mixing, neardup, quality
from packlake.llm.queries import RANKS, tokenizer
from packlake.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
QUALITY = 0.3

# A classifier and a byte-pair encoder cannot be said in SQL; tests hold the stages against plain loops.
ORACLE_SQL = None


def _documents(docs: DataFrame) -> DataFrame:
    return common.small_batches(docs).select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold; the model is fitted on the training labels of these documents."""
    own = _documents(docs)
    model = quality.fit(own, common.table(spark, sf_dir, "labels"))
    return own.select("*", quality.score(F.col("text"), model).alias("_score")).filter(F.col("_score") >= QUALITY).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of repeated line runs; a document that was all copies goes."""
    return linededup.deduplicated(_documents(docs)).select(*COLUMNS)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return neardup.kept_documents(_documents(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the numbers the mix takes them."""
    return mixing.mixed_documents(_documents(docs))


def encode_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes, one row per document of the mix."""
    return bpe.round_trip(_documents(docs), *tokenizer(RANKS))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("minhash near-dedup", minhash_near_dedup),
    ("mixing sources", mix_sources),
    ("byte-level bpe", encode_decode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written below the shared folder before the next."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
