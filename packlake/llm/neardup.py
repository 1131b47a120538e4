"""MinHash near-duplicates with HyperMinHash registers (op3).

A document is the set of its five-word shingles.  Each of ``REGISTERS`` buckets
keeps the minimum of its own permutation of the shingles, compressed to the
count of leading zeros and ten mantissa bits.  (A permutation per bucket, not
one shared out over the buckets, leaves no bucket of a short document empty.)
Bands of ``ROWS`` registers make candidates, an estimate of the Jaccard
similarity corrected for colliding registers thins them out, and the rest is
verified on the full sets.

Documents with equal sets form one class first, so exact copies cost one row.
Candidates of a band bucket are not paired off:

1. Every class is compared with the bucket's smallest class.  A group of near
   copies becomes one component this way, in as many comparisons as members.
2. Only buckets that still hold several components go on.  In small ones the
   classes of different components are compared.  The classes of all larger ones
   meet in an exact prefix join instead: shingles are ordered by how many of
   these classes hold them, rarest first, and two sets that are similar enough
   must share one of their first ``n - ceil(t n) + 1`` shingles, for a threshold t.

So no bucket is cut or skipped, and pairs inside a component are never listed.
The threshold is a parameter: 0.85 in op3, 0.80 in the stage of the pipeline.  A
pair at 0.85 agrees in some band with probability 1 - 2e-8, one at 0.80 with
1 - 3e-6; they pass the estimate with 1 - 1e-9 and 1 - 1e-8; pairs above the
threshold do both more surely.

Defined cases: texts without words have the empty set and stay alone; fewer
than five words are one shingle; rows of one doc_id count as one document; rows
without an id take no part, keep a null component and are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packlake.llm.common import bounded
from packlake.llm.components import components
from packlake.session import materialize

WORDS = 5
REGISTERS, ROWS = 96, 4
BANDS = REGISTERS // ROWS
MANTISSA = 10
COLLISION = 0.1695 * 2.0**-MANTISSA  # chance that unequal minima share a register
LEAST = (85, 100)  # intersection to union, op3
STAGE_LEAST = (80, 100)  # the same in the pipeline
MARGIN = 0.25  # an estimate may lie this far below the threshold
SMALL_BUCKET = 40
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class _WordHashes(dict):
    """64-bit hashes of the words met so far; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def shingles(text: str, hashes: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    words = text.encode("utf-8", "replace").translate(LOWER).split()  # bytes split at [\x20\x09-\x0D]+
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(len(h), WORDS)
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    odd = rng.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd[:, None], rng.integers(0, 2**63, REGISTERS, dtype=np.uint64)[:, None]


def registers(own: np.ndarray, permutations: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """HyperMinHash registers of a set: leading zeros above ten mantissa bits, 16 bits each."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    odd, shift = permutations
    for k in range(0, len(own), 2048):
        h = (own[None, k : k + 2048] ^ shift) * odd
        np.minimum(least, (h ^ (h >> np.uint64(31))).min(axis=1), out=least)
    mantissa, exponent = np.frexp(np.maximum(least, np.uint64(1)).astype(np.float64))
    zeros = (64 - exponent).clip(0, 63).astype(np.uint16)
    return (zeros << np.uint16(MANTISSA)) | ((mantissa * 2 - 1) * 2**MANTISSA).astype(np.uint16)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n, digest, bands, regs): set size, digest of the set, band values and registers."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, permutations = _WordHashes(), _permutations()
        band = np.arange(BANDS, dtype=np.uint64)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                own = shingles(text, hashes)
                if not len(own):
                    rows.append((0, None, None, None))
                    continue
                regs = registers(own, permutations)
                value = band.copy()
                for column in regs.reshape(BANDS, ROWS).T:
                    value = _mix(value * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
                digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                rows.append((len(own), digest, value.view(np.int64), regs.astype(np.int32)))
            out = pd.DataFrame(rows, columns=["n", "digest", "bands", "regs"], dtype=object)
            out["n"] = out["n"].astype("int64")
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return (
        docs.filter("doc_id IS NOT NULL")
        .select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .mapInPandas(work, "doc_id bigint, n bigint, digest binary, bands array<bigint>, regs array<int>")
    )


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, own): the full shingle set of each of ``ids``; other texts are read but not kept."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for batch in batches:
            own = [shingles(t, hashes).view(np.int64) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "own": own})

    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(bounded(ids), "id", "left_semi").mapInPandas(work, "id bigint, own array<bigint>")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) of class ids whose full sets are similar enough."""
    side = lambda name: classes.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("regs").alias(f"r_{name}"))
    equal = F.size(F.filter(F.zip_with("r_u", "r_v", lambda a, b: a == b), lambda x: x))
    estimate = (equal / F.lit(float(REGISTERS)) - COLLISION) / (1 - COLLISION)
    a, b = least
    sizes = (F.least("n_u", "n_v") * b >= F.greatest("n_u", "n_v") * a)  # a larger difference rules the pair out
    likely = materialize(
        bounded(pairs).join(side("u"), "u").join(side("v"), "v").filter(sizes).filter(estimate >= a / b - MARGIN).select("u", "v", "n_u", "n_v").distinct()
    )
    ids = materialize(likely.select(F.col("u").alias("id")).union(likely.select("v")).distinct())
    sets = materialize(_sets(docs, ids))
    both = likely.join(sets.withColumnsRenamed({"id": "u", "own": "own_u"}), "u").join(sets.withColumnsRenamed({"id": "v", "own": "own_v"}), "v")
    shared = F.size(F.array_intersect("own_u", "own_v"))
    return materialize(both.filter(shared * b >= (F.size("own_u") + F.size("own_v") - shared) * a).select("u", "v").distinct())


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of buckets (``key``) that hold more than one component, with the bucket's size."""
    buckets = (
        rows.groupBy("key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("rows"))
        .filter("low <> high")
        .select("key", "rows")
    )
    return rows.join(buckets, "key")


def _across(rows: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Pairs (u, v) of a bucket's classes that lie in different components and can still be similar.

    ``place`` is the shared shingle's place in the order of each set's shingles.
    The first shared one leaves at most the shingles behind it to share, in
    both sets; pairs whose bound stays below the overlap they need are left out.
    """
    one, other = (
        rows.select("key", F.col("id").alias(x), F.col("component").alias(f"c_{x}"), F.col("n").alias(f"n_{x}"), F.col("place").alias(f"p_{x}")) for x in "uv"
    )
    a, b = least
    bound = F.least(F.col("n_u") - F.col("p_u"), F.col("n_v") - F.col("p_v")) + 1
    needed = bound * (a + b) >= (F.col("n_u") + F.col("n_v")) * a
    return one.join(other, "key").filter((F.col("u") < F.col("v")) & (F.col("c_u") != F.col("c_v")) & needed).select("u", "v").distinct()


def _prefixes(docs: DataFrame, ids: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(key, id, n, place, component): the rarest shingles of each class, as many as the prefix bound needs."""
    sets = materialize(_sets(docs, ids.select("id")).dropDuplicates(["id"]))
    each = sets.select("id", F.size("own").alias("n"), F.explode("own").alias("key"))
    held = each.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    a, b = least
    prefix = F.col("n") - F.ceil(F.col("n") * a / F.lit(b) - 1e-9) + 1
    own = Window.partitionBy("id")
    ranked = (
        each.join(held, "key")
        .withColumn("lone", F.col("n") - F.count(F.lit(1)).over(own))  # shingles that no other class holds come first
        .withColumn("place", F.row_number().over(own.orderBy("held", "key")) + F.col("lone"))
    )
    return ranked.filter(F.col("place") <= prefix).select("key", "id", "n", "place").join(bounded(ids), "id")


def components_of(docs: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row with an id; sets of a similarity of at least ``least`` are linked."""
    facts = materialize(sketches(docs))
    known = facts.filter("n > 0")
    first = materialize(known.groupBy("digest").agg(F.min("doc_id").alias("id")))
    classes = materialize(
        known.join(first.withColumnRenamed("id", "doc_id"), ["digest", "doc_id"]).dropDuplicates(["digest"]).select(F.col("doc_id").alias("id"), "n", "bands", "regs")
    )
    # several texts under one id: one node
    same = known.join(first, "digest").select(F.col("doc_id").alias("u"), F.col("id").alias("v")).filter("u <> v")
    banded = classes.select("id", F.posexplode("bands").alias("band", "value"))
    shared = banded.groupBy("value").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("value")
    rows = materialize(banded.join(shared, "value").select(F.col("value").alias("key"), "id"))
    lead = rows.groupBy("key").agg(F.min("id").alias("u"))
    links = _verified(docs, classes, materialize(rows.join(lead, "key").select("u", F.col("id").alias("v")).filter("u <> v").distinct()), least)
    labels = materialize(components(links)).withColumnsRenamed({"node": "id"})
    labelled = rows.join(bounded(labels), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = materialize(_mixed(labelled))
    large = materialize(mixed.filter(F.col("rows") > SMALL_BUCKET).select("id", "component").distinct())
    little = mixed.filter(F.col("rows") <= SMALL_BUCKET).join(classes.select("id", "n"), "id").withColumn("place", F.lit(1))
    pairs = _across(little, least).unionByName(_across(_mixed(_prefixes(docs, large, least)), least))
    links = links.unionByName(_verified(docs, classes, materialize(pairs.distinct()), least))
    found = materialize(components(links.unionByName(same)))
    return (
        facts.select("doc_id", F.col("n").alias("n_shingles"))
        .join(bounded(found.withColumnRenamed("node", "doc_id")), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row; the smallest id of a group is kept."""
    found = components_of(docs).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    none = F.lit(None).cast("bigint")
    nameless = docs.filter("doc_id IS NULL").select(none.alias("doc_id"), none.alias("n_shingles"), none.alias("component_id"), F.lit(True).alias("kept"))
    return found.unionByName(nameless)


def kept_documents(docs: DataFrame, least: tuple[int, int] = STAGE_LEAST) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group, all documents without words, and rows without an id.

    Of rows that share an id and have words the one with the smallest digest of
    its text stays.
    """
    found = materialize(components_of(docs, least))
    gone = materialize(found.filter("doc_id <> component_id").select("doc_id").distinct())
    often = materialize(found.filter("n_shingles > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("doc_id"))
    columns = [F.col(c) for c in docs.columns]
    keyed = docs.select(F.struct(*columns).alias("_row"), F.col("doc_id").cast("bigint").alias("doc_id"))
    kept = keyed.join(bounded(gone), "doc_id", "left_anti")
    once = kept.join(bounded(often), "doc_id", "left_anti").select("_row")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.md5(F.coalesce("_row.text", F.lit("")).cast("binary"))))
    first = kept.join(bounded(often), "doc_id", "left_semi").withColumn("_place", place).filter("_place = 1").select("_row")
    return once.unionByName(first).select("_row.*")
