"""Mixing sources to target weights (op1).

Every document gets a hash-random key.  Documents are range-sorted by source
and key, distributed prefix sums of their sizes are formed inside each source,
and the running sum is cut at the source's exact budget.  A budget beyond the
source's own size repeats the source: whole epochs first, then the cut.

Targets: the sources in code point order, null last, carry the given weights in
turn and share the sum of all sizes.  A target stops at ``most_epochs`` times
its source's size; the excess goes to the others by weight until none is above.

Nothing is kept per source on the driver but two sums a round: a source's
target is the smaller of its limit and (common level x weight), and the level
is found by re-sharing what the full sources leave.

Defined cases: a null or wordless text has size 0 and takes 0; an empty table
gives an empty result; repeated rows are mixed as rows of their own; ties of
the key fall to the id, the size and the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlake.llm.common import SPACE_WORD, bounded
from packlake.operators.spread import running
from packlake.session import materialize

WEIGHTS = (5, 2, 1)
SEED = "mix"


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD + "+")), F.lit(0)).cast("bigint")  # possessive: no backtracking


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = 3) -> DataFrame:
    """(no_source, src, source_size, target) from one row of (no_source, src, source_size) per source."""
    ranked = running(sources, [], [F.col("no_source"), F.col("src")], {}, number="_place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_place") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = materialize(ranked.withColumn("weight", weight.cast("bigint")))
    limit = F.col("source_size") * most_epochs
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:  # each round fills at least one more source, or ends
        row = weighed.agg(
            F.sum(F.when(limit <= level * F.col("weight"), limit).otherwise(0)).alias("filled"),
            F.sum(F.when(limit <= level * F.col("weight"), 0).otherwise(F.col("weight"))).alias("open"),
            F.count(F.when(limit <= level * F.col("weight"), 1)).alias("full"),
        ).first()
        if row.full == full or not row.open:
            break
        full, level = row.full, (total - row.filled) / row.open
    share = F.least(limit.cast("double"), F.lit(level) * F.col("weight").cast("double"))
    return weighed.select("no_source", "src", "source_size", share.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, cut, taken) per document.

    ``epochs`` whole copies of the document are taken, and ``cut`` words of one
    more; ``taken`` is their sum.
    """
    text, source = F.coalesce("text", F.lit("")), F.col("source")
    narrow = materialize(
        docs.select(
            "doc_id",
            source.isNull().alias("no_source"),
            F.coalesce(source, F.lit("")).alias("src"),
            size_in_words(text).alias("size"),
            F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")).alias("key"),
            F.md5(text.cast("binary")).alias("tie"),
        )
    )
    by = ["no_source", "src"]
    wanted = materialize(targets(narrow.groupBy(*by).agg(F.sum("size").alias("source_size")), weights, most_epochs))
    order = [F.col("key"), F.col("doc_id"), F.col("size"), F.col("tie")]
    placed = running(narrow, by, order, {"before": "size"})
    budget = F.round("target").cast("bigint")
    rest = F.when(F.col("source_size") > 0, F.pmod(budget, F.col("source_size"))).otherwise(0)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("bigint")
    cut = F.least(F.greatest(rest - F.col("before"), F.lit(0).cast("bigint")), F.col("size"))
    return (
        placed.join(bounded(wanted), by)
        .withColumns({"epochs": epochs, "cut": cut})
        .select(
            "doc_id",
            F.when(~F.col("no_source"), F.col("src")).alias("source"),
            "size",
            "source_size",
            "target",
            "epochs",
            "cut",
            (F.col("epochs") * F.col("size") + F.col("cut")).alias("taken"),
            "tie",
        )
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = 3) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``; a document taken twice stands there twice.

    Documents stay whole here: the one at the budget is taken if at least half
    of it lies below.  A document of size 0 stays once.
    """
    plan = mix(docs, weights, most_epochs)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("epochs") + F.when(F.col("cut") * 2 >= F.col("size"), 1).otherwise(0))
    counted = (
        plan.select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_no_id"), F.col("tie").alias("_tie"), F.coalesce("source", F.lit("")).alias("_src"), copies.alias("_copies"))
        .groupBy("_id", "_no_id", "_tie", "_src")
        .agg(F.sum("_copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    )
    counted = materialize(counted)
    columns = [F.col(c) for c in docs.columns]
    keyed = docs.select(
        F.struct(*columns).alias("_row"),
        F.coalesce("doc_id", F.lit(0)).alias("_id"),
        F.col("doc_id").isNull().alias("_no_id"),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("_tie"),
        F.coalesce("source", F.lit("")).alias("_src"),
    )
    joined = keyed.join(bounded(counted), ["_id", "_no_id", "_tie", "_src"])
    # rows of one id, source and text share their copies; those that differ elsewhere get their part, rounded up
    single = joined.filter("_rows = 1").select("_row", F.col("_copies").cast("int").alias("_n"))
    part = F.ceil(F.first("_copies") * F.count(F.lit(1)) / F.first("_rows")).cast("int")
    equal = joined.filter("_rows > 1").groupBy("_row").agg(part.alias("_n"))
    repeated = single.unionByName(equal).filter("_n > 0")
    return repeated.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("_n")))).select("_row.*")
