"""Line dedup by a suffix array over line ids (op7).

A document is a sequence of line ids.  The suffixes of all sequences are sorted
by distributed prefix doubling: a suffix's rank by its first 2k lines is the
rank of the pair (rank of its first k lines, rank of the k lines behind them).
Ranks come from a range sort of the distinct pairs and prefix sums of how many
suffixes hold each.  A suffix whose rank is unique has no repeat of that length
and leaves the sort, so a round costs only what still repeats.

Suffixes that agree in their first ``m`` lines are an interval of the array
whose longest common prefixes reach ``m``.  The first ``m`` lines of a suffix
are named by two overlapping ranks of power-of-two length, so the interval of
any length is one group.  Only the first occurrence of an interval is kept.

A run counts as a passage if it has at least ``MIN_WORDS`` words.  A maximal
repeated run is the union of its shortest passages: those that begin at each of
its lines and those that end at each of them.  So only these are looked up, and
the doubling ends at the longest of them.

Shorter runs are passages too where they are common: in the pipeline, those of
at least ``COMMON_WORDS`` words whose interval holds ``COMMON_TIMES`` suffixes
or more.  op7 has the first rule only, as its SQL twin.

A line is deleted if it lies in a passage that occurs earlier, in the order of
(doc_id, line).  Occurrences may lie in one
document and may overlap.  Lines are compared exactly, by 128-bit hashes.

Defined cases: a null text stays null, an empty one empty; rows without an id
come first; rows with equal id and text are one document and share the result;
documents with one id and different texts are told apart by their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlake.llm.common import bounded
from packlake.operators.spread import running
from packlake.session import materialize

MIN_WORDS = 50
COMMON_WORDS, COMMON_TIMES = 5, 20  # shorter runs, in the pipeline
DOC = ["d", "tie"]


def _keyed(docs: DataFrame) -> list:
    first = F.lit(-(2**63)).cast("bigint")  # rows without an id come before all others
    return [F.coalesce(F.col("doc_id").cast("bigint"), first).alias("d"), F.xxhash64("text").alias("tie")]


def _shortest(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines of the shortest passage that begins, and that ends, at each line; 0 where there is none."""
    sums = np.concatenate([[0], np.cumsum(words)])
    n = np.arange(len(words))
    stop = np.searchsorted(sums, sums[:-1] + least)
    start = np.searchsorted(sums, sums[1:] - least, side="right") - 1
    return np.where(stop <= len(words), stop - n, 0), np.where(start >= 0, n + 1 - start, 0)


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """(d, tie, pos, h1, h2, begins, ends) per line."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for d, tie, text in zip(batch["d"], batch["tie"], batch["text"]):
                lines = text.encode("utf-8", "replace").split(b"\n")
                begins, ends = _shortest(np.fromiter((len(x.split()) for x in lines), np.int64, len(lines)), least)
                raw = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), dtype=np.int64).reshape(-1, 2)
                n = len(lines)
                parts.append((np.full(n, d), np.full(n, tie), np.arange(n), raw[:, 0], raw[:, 1], begins, ends))
            if parts:
                yield pd.DataFrame(dict(zip(("d", "tie", "pos", "h1", "h2", "begins", "ends"), map(np.concatenate, zip(*parts)))))

    schema = "d bigint, tie bigint, pos bigint, h1 bigint, h2 bigint, begins bigint, ends bigint"
    return docs.filter("text IS NOT NULL AND text <> ''").select(*_keyed(docs), "text").mapInPandas(work, schema)


def _ranked(suffixes: DataFrame, names: list[str], times: int) -> DataFrame:
    """Suffixes whose ``names`` at least ``times`` suffixes have, with their rank in the order of ``names``."""
    groups = suffixes.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= times)
    ranks = running(groups, [], [F.col(c) for c in names], {"rank": "_n"})
    return suffixes.join(ranks.drop("_n"), names).drop(*names)


def repeated_runs(docs: DataFrame, least: int = MIN_WORDS, times: int = 2) -> DataFrame:
    """(d, tie, start, lines): shortest passages of ``least`` words that occur earlier, and at least ``times`` times in all."""
    lines = materialize(_lines(docs, least))
    twice = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= times).select("h1", "h2")
    repeated = materialize(lines.join(twice, ["h1", "h2"]).dropDuplicates([*DOC, "pos"]))
    first = materialize(_ranked(repeated, ["h1", "h2"], times))
    windows = (
        first.filter("begins > 0").select(*DOC, F.col("pos").alias("start"), F.col("begins").alias("lines"))
        .unionByName(first.filter("ends > 0").select(*DOC, (F.col("pos") - F.col("ends") + 1).alias("start"), F.col("ends").alias("lines")))
        .distinct()
        .withColumn("level", F.floor(F.log2(F.col("lines") + F.lit(0.5))).cast("int"))
    )
    windows = materialize(windows)
    highest = windows.agg(F.max("level")).first()[0]
    if highest is None:
        return windows.drop("level")
    level = first.select(*DOC, "pos", "rank")
    ranks = level.withColumn("level", F.lit(0))
    for k in range(highest):
        behind = level.select(*DOC, (F.col("pos") - 2**k).alias("pos"), F.col("rank").alias("behind"))
        level = materialize(_ranked(level.withColumnRenamed("rank", "before").join(behind, [*DOC, "pos"]), ["before", "behind"], times))
        ranks = ranks.unionByName(level.withColumn("level", F.lit(k + 1)))
    span = F.pow(F.lit(2.0), F.col("level")).cast("bigint")
    at = lambda name, rank: ranks.withColumnsRenamed({"pos": name, "rank": rank})
    named = (
        windows.withColumn("second", F.col("start") + F.col("lines") - span)
        .join(at("start", "rank_1"), [*DOC, "level", "start"])
        .join(at("second", "rank_2"), [*DOC, "level", "second"])
        .select(*DOC, "start", "lines", "rank_1", "rank_2")
    )
    named = materialize(named)
    interval = ["lines", "rank_1", "rank_2"]
    earliest = named.groupBy(*interval).agg(F.min(F.struct(*DOC, "start")).alias("earliest"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= times)
    return named.join(earliest, interval).filter(F.struct(*DOC, "start") != F.col("earliest")).select(*DOC, "start", "lines")


def _cut(docs: DataFrame, least: int, common: tuple[int, int] | None = None) -> DataFrame:
    """(_row, n_lines, n_deleted, text): each row as it was, and its text without the copies."""
    runs = repeated_runs(docs, least)
    if common:
        runs = runs.unionByName(repeated_runs(docs, *common))
    # a document's runs are at most two a rule for each of its lines
    gone = materialize(runs.groupBy(*DOC).agg(F.collect_list(F.struct("start", "lines")).alias("runs")))

    @F.pandas_udf("struct<n_deleted:bigint,text:string>")
    def cut(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        out = []
        for text, own in zip(texts, runs):
            if own is None or text is None:
                out.append((0, text))
                continue
            lines = text.split("\n")
            change = np.zeros(len(lines) + 1, dtype=np.int64)
            for run in own:
                change[run["start"]] += 1
                change[run["start"] + run["lines"]] -= 1
            deleted = np.cumsum(change[:-1]) > 0
            out.append((int(deleted.sum()), "\n".join(x for x, d in zip(lines, deleted) if not d)))
        return pd.DataFrame(out, columns=["n_deleted", "text"])

    columns = [F.col(c) for c in docs.columns]
    keyed = docs.select(F.struct(*columns).alias("_row"), *_keyed(docs), F.col("text").alias("_text"))
    met = keyed.join(bounded(gone), DOC, "left")
    n_lines = F.when(F.col("_text").isNull() | (F.col("_text") == ""), 0).otherwise(F.length("_text") - F.length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1)
    made = met.filter("runs IS NOT NULL").select("_row", n_lines.cast("bigint").alias("n_lines"), cut("_text", "runs").alias("made"))
    same = met.filter("runs IS NULL").select("_row", n_lines.cast("bigint").alias("n_lines"), F.lit(0).cast("bigint").alias("n_deleted"), F.col("_text").alias("text"))
    return made.select("_row", "n_lines", "made.n_deleted", "made.text").unionByName(same)


def deletions(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_deleted, text) per row."""
    return _cut(docs, least).select("_row.doc_id", "n_lines", "n_deleted", "text")


def deduplicated(docs: DataFrame, least: int = MIN_WORDS, common: tuple[int, int] | None = (COMMON_WORDS, COMMON_TIMES)) -> DataFrame:
    """Rows with the columns of ``docs`` (and new ``text`` and ``n_chars``); rows that lost their last word are gone."""
    cut = _cut(docs, least, common).filter((F.col("n_deleted") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    columns = {c: F.col(f"_row.{c}") for c in docs.columns}
    columns["text"] = F.col("text")
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_deleted") > 0, F.length("text").cast("bigint")).otherwise(columns["n_chars"])
    return cut.select(*[c.alias(name) for name, c in columns.items()])
