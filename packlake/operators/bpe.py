"""Exact byte-pair token counts for a given rank table (P3, ``bpe`` mode).

Text is cut into pieces by a native regex and counted where it is read: a task
merges the distinct pieces of an Arrow batch, keeps a bounded number of merged
lengths for its next batches, and hands on one number per row, so that pieces are
never shuffled.  Pieces that are a single token already need no merging.

Merged lengths can be kept in a table between runs, so that a piece is merged once
for all corpora counted with the same ranks.  Pieces then meet that table, which has
no bound, in a join, and are counted per (file, piece) for it.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packlake.operators.spread import join_per_pack
from packlake.session import materialize

# The piece patterns of the two encodings; @ stands for white space.
_WHITE = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_PATTERNS = {
    "cl100k_base": (
        r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^@\p{L}\p{N}]++[\r\n]*+"
        r"|[@]++\z|[@]*[\r\n]|[@]+(?![^@])|[@]"
    ),
    "o200k_base": (
        r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?"
        r"|[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?"
        r"|\p{N}{1,3}| ?[^@\p{L}\p{N}]+[\r\n/]*|[@]*[\r\n]+|[@]+(?![^@])|[@]+"
    ),
}
PATTERNS = {name: pattern.replace("@", _WHITE) for name, pattern in _PATTERNS.items()}
REMEMBERED = 1 << 18  # merged lengths a task keeps between batches, the last used ones
REMEMBERED_BYTES = 64  # of longer pieces none is kept, so that what is kept has a bound


def load_ranks(spark: SparkSession, path: str) -> DataFrame:
    """Rank file: one ``base64-token rank`` per line."""
    parts = F.split("value", " ")
    return (
        spark.read.text(path)
        .filter("value <> ''")
        .select(F.unbase64(parts[0]).alias("token"), parts[1].cast("int").alias("rank"))
    )


def merged_length(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Number of tokens after merging the lowest-ranked neighbours until none is known.

    A heap over neighbours in a linked list keeps long pieces at n log n.
    """
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that starts at i
    previous = list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (rank := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n - 1):
        offer(i)
    parts = n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] == n or end[end[i]] != stop:
            continue  # one of the two parts has changed since
        gone = end[i]
        alive[gone] = False
        end[i] = stop
        if stop < n:
            previous[stop] = i
        parts -= 1
        offer(i)
        if previous[i] >= 0:
            offer(previous[i])
    return parts


def row_tokens(pieces: pa.ListArray, length: Callable[[bytes], int]) -> np.ndarray:
    """Tokens of every row of ``pieces``; ``length`` is asked once per distinct piece of the batch."""
    coded = pieces.flatten().cast(pa.binary()).dictionary_encode()
    lengths = np.fromiter(map(length, coded.dictionary.to_pylist()), "int64", len(coded.dictionary))
    before = np.concatenate([[0], np.cumsum(lengths[coded.indices.to_numpy()])])
    ends = np.cumsum(pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False))
    return np.diff(before[ends], prepend=0)


def tokens_in_place(pieces: Column, table: Broadcast, remembered: int = REMEMBERED) -> Column:
    """Tokens of an array of pieces under the ranks of ``table``, merged by the task that reads them."""

    @F.arrow_udf("bigint")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = table.value
        kept = lru_cache(remembered)(lambda piece: merged_length(piece, known))

        def length(piece: bytes) -> int:
            if piece in known:
                return 1
            return kept(piece) if len(piece) <= REMEMBERED_BYTES else merged_length(piece, known)

        for batch in batches:
            yield pa.array(row_tokens(batch, length), "int64")

    return counted(pieces)


def ranks_id(ranks: DataFrame) -> str:
    """Name of a rank table: its size and a hash that does not depend on the order of its rows."""
    row = ranks.agg(
        F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("token", "rank")), F.lit(0)), F.coalesce(F.bit_xor(F.crc32("token") * (F.col("rank") + 1)), F.lit(0))
    ).first()
    return "-".join(f"{v & (2**64 - 1):x}" for v in row)


def kept_lengths(spark: SparkSession, path: str, ranks: str) -> DataFrame:
    """(piece, merged) kept below ``path`` for a rank table; a piece that two runs added at once counts once."""
    folder = f"{path}/ranks={ranks}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    schema = "piece string, merged bigint"
    rows = spark.read.schema(schema).parquet(folder) if found else spark.createDataFrame([], schema)
    return rows.groupBy("piece").agg(F.min("merged").alias("merged"))


def _keep_lengths(unknown: DataFrame, lengths, path: str, ranks: str) -> DataFrame:
    """Merge the pieces not met before, append them to the table, and return the table."""
    spark = unknown.sparkSession
    fresh = unknown.join(kept_lengths(spark, path, ranks), "piece", "left_anti")
    fresh.withColumn("merged", lengths("piece")).write.mode("append").parquet(f"{path}/ranks={ranks}")
    return kept_lengths(spark, path, ranks)


def _counted_with_table(pieces: DataFrame, ranks: DataFrame, table: Broadcast, keys: tuple[str, ...], path: str) -> DataFrame:
    """(keys, tokens) per distinct piece of a file, by the merged lengths kept below ``path``."""

    @F.pandas_udf("bigint")
    def lengths(pieces: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = table.value
        for batch in pieces:
            yield batch.map(lambda p: merged_length(p.encode(), known)).astype("int64")

    per_file = pieces.groupBy(*keys, "piece").agg(F.count(F.lit(1)).alias("n"))
    per_file = materialize(per_file)  # read by the job that keeps new pieces and by the result
    # tokens that are valid text; adaptive execution broadcasts them if they turn out small
    single = ranks.filter(F.is_valid_utf8(F.col("token").cast("string"))).select(
        F.col("token").cast("string").alias("piece"), F.lit(1).cast("bigint").alias("one")
    )
    marked = per_file.join(single, "piece", "left")
    unknown = marked.filter("one IS NULL").select("piece").distinct()
    unknown = _keep_lengths(unknown, lengths, path, ranks_id(ranks))
    return marked.filter("one IS NOT NULL").select(*keys, F.col("n").alias("tokens")).unionByName(
        join_per_pack(marked.filter("one IS NULL"), unknown, ["piece"], "inner", spread_by=keys[-1]).select(
            *keys, (F.col("n") * F.col("merged")).alias("tokens")
        )
    )


def count_bpe(
    files: DataFrame,
    ranks: DataFrame,
    encoding: str = "o200k_base",
    keys: tuple[str, ...] = ("pack_id", "path"),
    pieces_path: str | None = None,
) -> DataFrame:
    """(keys, tokens) for every row with ``content``; empty text has 0 tokens.

    ``pieces_path`` names a folder that keeps merged lengths between runs, one
    table per rank table: pieces found there are not merged again.
    """
    spark = files.sparkSession
    rows = ranks.collect()  # one vocabulary: it does not grow with the corpus
    table = spark.sparkContext.broadcast({bytes(r.token): r.rank for r in rows})

    pieces = F.regexp_extract_all("content", F.lit(PATTERNS[encoding]), F.lit(0))
    if pieces_path is None:
        counted = files.select(*keys, tokens_in_place(pieces, table).alias("tokens"))
    else:
        counted = _counted_with_table(files.select(*keys, F.explode(pieces).alias("piece")), ranks, table, keys, pieces_path)
    sums = counted.groupBy(*keys).agg(F.sum("tokens").cast("bigint").alias("tokens"))
    return (
        files.select(*keys)
        .join(sums, list(keys), "left")
        .withColumn("tokens", F.coalesce("tokens", F.lit(0).cast("bigint")))
    )
