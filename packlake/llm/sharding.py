"""Sharding by a two-pass external shuffle (op12).

First pass: every record is scattered into one of many buckets by a seeded hash
of its id and text.  There are so many buckets that one holds about ``BUCKET_ROWS``
rows or ``BUCKET_BYTES`` of them, whichever is less.  Second pass: each bucket is
sorted by hash, shuffled by Fisher and Yates with a generator seeded by the
bucket, and written.  Buckets in order of their number, each in its shuffled
order, are one random order of all records.

The shards are equal stretches of that order, so the law is ``rows``: counts
differ by one at most.  Offsets come from the buckets' counts; no task sees more
than a bucket.

Rows that agree in id and text have one hash.  A bucket that such rows crowd
(over twice its share) is cut into parts by the rows' place in the input;
elsewhere the order depends on the seed and the rows alone.  Equal texts with
different ids scatter like any others.

Defined cases: a null text has size 1 (no bytes, plus 1) and the checksum of the
empty text; null ids scatter by their text; repeated rows get a slot each; with
fewer rows than shards some shards stay empty; an empty table gives an empty
result; :func:`assign` looks at doc_id and text only, :func:`write` takes every
column along.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from packlake.operators.spread import running
from packlake.session import materialize

SHARDS, SEED = 16, "shard"
BUCKET_ROWS, BUCKET_BYTES = 8192, 32 * 2**20


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def text_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def record_key(seed: str) -> Column:
    """Seeded hash of a record; equal for rows of equal id and text."""
    return F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def fisher_yates(n: int, seed: str) -> list[int]:
    """A seeded random order of 0 .. n - 1."""
    order, pick = list(range(n)), random.Random(seed)
    for last in range(n - 1, 0, -1):
        other = pick.randrange(last + 1)
        order[last], order[other] = order[other], order[last]
    return order


def _permuted(rows: DataFrame, seed: str, bucket_rows: int, bucket_bytes: int) -> DataFrame:
    """``rows`` (with _key and _bytes) in written buckets: _bucket, _part and the place _at in it."""
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("_bytes").alias("bytes")).first()
    buckets = max(1, -(-totals.n // bucket_rows), -(-(totals["bytes"] or 0) // bucket_bytes))
    scattered = rows.withColumn("_bucket", F.pmod(F.xxhash64("_key", F.lit(seed)), F.lit(buckets)))
    share = max(1, -(-totals.n // buckets))
    crowded = materialize(scattered.groupBy("_bucket").count().filter(F.col("count") > 2 * max(share, 64)).select("_bucket", F.ceil(F.col("count") / share).alias("_parts")))
    split = scattered.withColumn("_row", F.monotonically_increasing_id()).join(crowded, "_bucket", "left")
    split = split.withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("_row"), F.col("_parts"))).cast("bigint")).drop("_row", "_parts")

    def shuffle(bucket: pa.Table) -> pa.Table:
        own = bucket.sort_by("_key")
        order = fisher_yates(own.num_rows, f"{seed}:{own['_bucket'][0]}:{own['_part'][0]}")
        return own.take(order).append_column("_at", pa.array(range(own.num_rows), pa.int64()))

    schema = StructType([*split.schema.fields]).add("_at", LongType())
    return materialize(split.groupBy("_bucket", "_part").applyInArrow(shuffle, schema))


def _sharded(rows: DataFrame, shards: int, seed: str, bucket_rows: int, bucket_bytes: int) -> DataFrame:
    """``rows`` with shard and slot, without _key and _bytes."""
    permuted = _permuted(rows, seed, bucket_rows, bucket_bytes)
    counted = materialize(permuted.groupBy("_bucket", "_part").agg(F.count(F.lit(1)).alias("_n")))
    total = counted.agg(F.sum("_n")).first()[0] or 0
    offsets = materialize(running(counted, [], [F.col("_bucket"), F.col("_part")], {"_before": "_n"}).drop("_n"))
    short, longer = max(1, total // shards), total % shards  # the first shards hold one row more
    place, turn = F.col("_before") + F.col("_at"), longer * (total // shards + 1)
    within = lambda part, width: F.struct(F.floor(part / width).alias("shard"), F.pmod(part, F.lit(width)).alias("slot"))
    late = within(place - turn, short)
    at = F.when(place < turn, within(place, total // shards + 1)).otherwise(F.struct((late["shard"] + longer).alias("shard"), late["slot"].alias("slot")))
    out = permuted.join(offsets, ["_bucket", "_part"]).withColumn("_to", at)
    return out.withColumns({"shard": F.col("_to.shard").cast("int"), "slot": F.col("_to.slot").cast("bigint")}).drop("_bucket", "_part", "_at", "_before", "_key", "_bytes", "_to")


def assign(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row; texts stay where they are."""
    text = F.col("text").cast("string")
    narrow = materialize(docs.select("doc_id", text_size(text).alias("size"), text_crc(text).alias("text_crc32"), record_key(seed).alias("_key")))
    out = _sharded(narrow.withColumn("_bytes", F.lit(0).cast("bigint")), shards, seed, bucket_rows, BUCKET_BYTES)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write(docs: DataFrame, path: str, shards: int = SHARDS, seed: str = SEED, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write the shuffled documents, with every column and their slot, below ``path/shard=k``.

    Texts move through one exchange, into their buckets.  Files of a shard are
    sorted by slot.  Columns of ``docs`` may have any name; the record is written
    as a struct ``row`` beside ``slot``.
    """
    record = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    keyed = docs.select(record, record_key(seed).alias("_key"), text_size(F.col("text").cast("string")).alias("_bytes"))
    placed = _sharded(keyed, shards, seed, bucket_rows, bucket_bytes)
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
