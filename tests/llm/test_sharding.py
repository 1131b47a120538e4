"""Shards: equal counts, gapless slots, one seeded order, and files that hold every row."""

from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import functions as F

from packlake.llm import sharding


def checked(rows, n, shards=16):
    assert len(rows) == n
    counts = Counter(r.shard for r in rows)
    assert all(0 <= s < shards for s in counts)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for shard, size in counts.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(size))
    return {(r.shard, r.slot): r.doc_id for r in rows}


def test_against_a_plain_loop(spark, documents):
    """Hashes come from Spark, all else from a loop over buckets."""
    docs = documents([(d, f"text {d % 7}") for d in range(500)])
    found = checked(sharding.assign(docs, bucket_rows=32).collect(), 500)
    keys = docs.select("doc_id", sharding.record_key(sharding.SEED).alias("k")).withColumn("b", F.pmod(F.xxhash64("k", F.lit(sharding.SEED)), F.lit(16))).collect()
    order = []
    for bucket in range(16):
        own = sorted((r for r in keys if r.b == bucket), key=lambda r: r.k)
        order += [own[i].doc_id for i in sharding.fisher_yates(len(own), f"{sharding.SEED}:{bucket}:0")]
    assert [found[k] for k in sorted(found)] == order
    assert sorted(order) == list(range(500)) and order != list(range(500))


def test_same_order_for_any_layout(documents):
    docs = documents([(d, f"text {d % 7}") for d in range(400)])
    one, other = (checked(sharding.assign(df, bucket_rows=50).collect(), 400) for df in (docs.repartition(7), docs.coalesce(1)))
    assert one == other
    assert one != checked(sharding.assign(docs, seed="another", bucket_rows=50).collect(), 400)


def test_odd_rows(clashing):
    rows = [(1, None), (None, "a"), (None, "a"), (None, None), (2, ""), (3, "é" * 10), (3, "é" * 10), (4, "z" * 1_000_000)]
    found = sharding.assign(clashing(rows)).collect()
    checked(found, len(rows))
    expected = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", None) for d, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in found) == expected
    assert sharding.assign(clashing(rows).filter("false")).count() == 0
    checked(sharding.assign(clashing(rows), shards=3).collect(), len(rows), 3)


def test_equal_rows_do_not_crowd_a_bucket(documents):
    docs = documents([(None, "same")] * 3000 + [(d, "other") for d in range(1000)])
    rows = docs.select(F.lit(0).cast("bigint").alias("_bytes"), sharding.record_key("x").alias("_key"))
    buckets = sharding._permuted(rows, "x", 200, 2**20).groupBy("_bucket", "_part").count().collect()
    assert sum(b["count"] for b in buckets) == 4000 and max(b["count"] for b in buckets) < 600
    checked(sharding.assign(docs, bucket_rows=200).collect(), 4000)


def test_written_shards(spark, clashing, tmp_path):
    rows = [(d, None if d % 9 == 0 else f"text {d}\n" * (d % 5)) for d in range(300)] + [(7, "twice"), (7, "twice")]
    docs = clashing(rows)
    sharding.write(docs, str(tmp_path / "out"), shards=4, bucket_rows=40)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select("row.*").columns == docs.columns
    found = back.select("shard", "slot", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text")).collect()
    checked(found, len(rows), 4)
    assert Counter((r.doc_id, r.text) for r in found) == Counter(rows)
