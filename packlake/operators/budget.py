"""Token budget: drop the heaviest files until a pack fits.

Walking files from the heaviest down and stopping once the rest fits is a
threshold on the token count, plus a threshold on the output order among files
that tie at the boundary.  Both are found from a histogram, so the decision is
one row per pack and no pack is ever gathered:

1. find the weight at the boundary digit by digit: a histogram per pack over one
   digit of ``RADIX_BITS`` bits, combined map-side, tells the bucket in which the
   walk stops, and the next digit looks only inside it.  A histogram has at most
   ``2**RADIX_BITS`` rows a pack, however many different weights the pack has;
2. drop all files above the boundary weight, and at it as many as still needed;
3. only the files tying at the boundary are ranked, with the range-split
   :func:`packlake.operators.spread.running`.

Weights are whole numbers from 0 up.  Token counts of size-limited files need
one or two digits, byte counts two to four.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packlake import fixed
from packlake.operators.spread import join_per_pack, running
from packlake.session import materialize

RADIX_BITS = 12


def is_eligible() -> Column:
    """The root manifest and files without text are never dropped."""
    return F.col("has_content") & (F.col("path") != F.lit(fixed.MANIFEST))


def _histogram(inside: DataFrame) -> DataFrame:
    """Files and mass per pack and bucket: at most ``2**RADIX_BITS`` rows a pack."""
    return inside.groupBy("pack_id", "at").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("mass"), F.first("base").alias("base")
    )


def _digit(weights: DataFrame, excess: DataFrame, known: DataFrame | None, shift: int) -> DataFrame:
    """One row per over-budget pack: bucket ``at`` of the boundary, its count ``n``, and the mass ``before`` it.

    ``known`` is the result for the digits above.  Buckets are walked from the
    heaviest; the last one that is entered before the excess is gone has the
    boundary.
    """
    bucket = F.shiftright("w", shift)
    if known is None:
        inside, base = weights, F.lit(0)
    else:
        above = F.shiftright("w", shift + RADIX_BITS)
        upper = known.select("pack_id", F.col("at").alias("up"), F.col("before").alias("base"))
        inside = join_per_pack(weights.withColumn("up", above), upper, ["pack_id", "up"], how="inner")
        base = F.col("base")
    hist = _histogram(inside.withColumns({"at": bucket, "base": base}))
    heavier = Window.partitionBy("pack_id").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, -1)
    walked = hist.withColumn("before", F.col("base") + F.coalesce(F.sum("mass").over(heavier), F.lit(0)))
    entered = walked.join(excess, "pack_id").filter("excess > before")
    return entered.groupBy("pack_id").agg(
        F.min_by(F.struct("at", "n", "before", "excess"), "at").alias("last")
    ).select("pack_id", "last.*")


def cuts(stats: DataFrame, max_tokens: int, weight: str = "tokens") -> DataFrame:
    """Per over-budget pack: drop all at or above ``floor``; drop ``tie_count`` files at ``tie``.

    A null ``tie`` means that no weight is dropped in part.  Reads ``stats`` once
    per digit and once before, so callers pass a materialised table.
    """
    w = F.col(weight).cast("bigint")
    totals = stats.groupBy("pack_id").agg(F.sum(w).alias("total"), F.max(F.when(is_eligible(), w)).alias("most"))
    over = materialize(
        totals.filter((F.col("total") > max_tokens) & F.col("most").isNotNull()).withColumn("excess", F.col("total") - max_tokens)
    )
    most = over.agg(F.max("most")).first()[0] or 0
    excess = over.select("pack_id", "excess")
    weights = stats.filter(is_eligible() & w.isNotNull()).select("pack_id", "path", w.alias("w"))
    weights = join_per_pack(weights, excess.select("pack_id"), ["pack_id"], how="left_semi")
    digits = max(1, -(-int(most).bit_length() // RADIX_BITS))
    found = None
    for k in reversed(range(digits)):
        found = _digit(weights, excess, found, k * RADIX_BITS)
    needed = F.ceil((F.col("excess") - F.col("before")) / F.col("at"))
    dropped = F.when(F.col("at") > 0, F.least("n", needed)).otherwise(F.col("n"))
    full = F.col("m") == F.col("n")
    return found.withColumn("m", dropped).select(
        "pack_id",
        F.when(full, F.col("at")).otherwise(F.col("at") + 1).alias("floor"),
        F.when(~full, F.col("at")).alias("tie"),
        F.when(~full, F.col("m")).alias("tie_count"),
    )


def mark_omitted(
    stats: DataFrame, max_tokens: int, order: list[Column], weight: str = "tokens"
) -> DataFrame:
    """Add ``is_omitted`` to a narrow table of pack_id, path, weight, has_content.

    ``order`` is the (ascending) output order; ties at the boundary are dropped
    from its start, as a stable sort by weight would.  Callers pass a
    materialised table, because it is read several times.
    """
    decided = materialize(cuts(stats, max_tokens, weight))
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    split = decided.filter("tie IS NOT NULL").select("pack_id", "tie", "tie_count")
    at_tie = join_per_pack(
        stats.filter(is_eligible()).select("pack_id", "path", F.col(weight).alias("tie"), key.alias("key")),
        split,
        ["pack_id", "tie"],
        how="inner",
    )
    last = (
        running(at_tie, ["pack_id"], [F.col("key").asc()], {}, number="nth")
        .filter("nth = tie_count")
        .select("pack_id", F.col("key").alias("tie_key"))
    )
    limits = decided.select("pack_id", "floor", "tie").join(last, "pack_id", "left")
    return _apply(stats, limits, weight, key)


def _apply(stats: DataFrame, limits: DataFrame, weight: str, key: Column) -> DataFrame:
    """Compare every file with the two thresholds of its pack."""
    w = F.col(weight)
    over = (w >= F.col("floor")) | ((w == F.col("tie")) & (key <= F.col("tie_key")))
    return (
        join_per_pack(stats.drop("is_omitted"), limits, ["pack_id"])
        .withColumn("is_omitted", F.coalesce(is_eligible() & over, F.lit(False)))
        .drop("floor", "tie", "tie_count", "tie_key")
    )
