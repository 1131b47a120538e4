"""Joins and running totals that survive one huge group.

A pack may hold a third of all rows, so nothing here gathers a pack in a task.

* :func:`join_per_pack` joins wide rows to one-row-per-pack facts.  The hot
  pack's rows are split over ``SALTS`` join keys.
* :func:`running` numbers and sums rows inside groups by cutting the ordered
  data into ranges, summing per range, and adding range offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packlake.session import materialize

SALTS = 32
BUCKETS = 64


def join_per_pack(
    rows: DataFrame,
    facts: DataFrame,
    on: list[str],
    how: str = "left",
    spread_by: str = "path",
) -> DataFrame:
    """Join many ``rows`` to ``facts`` that hold few rows per key.

    Adaptive execution still broadcasts ``facts`` when its measured size allows
    it; otherwise each key is split into ``SALTS`` parts by a hash of
    ``spread_by`` and ``facts`` is repeated once per part.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
    repeated = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def running(
    rows: DataFrame,
    by: list[str],
    order: list[Column],
    sums: dict[str, str],
    number: str | None = None,
) -> DataFrame:
    """Exclusive running sums and a 1-based row number inside each group.

    ``sums`` maps new column names to the columns added up.  Rows are range
    partitioned by group and order, written once so that every branch sees the
    same ranges, then summed per (group, range).  A range never holds more than
    one shuffle partition, a group never more than the number of ranges.
    """
    ordered = [F.col(c).asc() for c in by] + order
    ranged = materialize(
        rows.repartitionByRange(*ordered).withColumn("_range", F.spark_partition_id())
    )
    totals = ranged.groupBy(*by, "_range").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(src).alias(f"_sum_{dst}") for dst, src in sums.items()],
    )
    earlier = (
        Window.partitionBy(*by)
        .orderBy("_range")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *by,
        "_range",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        *[
            F.coalesce(F.sum(f"_sum_{dst}").over(earlier), F.lit(0)).alias(f"_before_{dst}")
            for dst in sums
        ],
    )
    inside = Window.partitionBy(*by, "_range").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(offsets, [*by, "_range"], "inner")
    added = {
        dst: F.col(f"_before_{dst}") + F.coalesce(F.sum(src).over(before), F.lit(0))
        for dst, src in sums.items()
    }
    if number:
        added[number] = F.col("_rows_before") + F.row_number().over(inside)
    return out.withColumns(added).drop(
        "_range", "_rows_before", *[f"_before_{dst}" for dst in sums]
    )


def top_rows(rows: DataFrame, by: list[str], order: list[Column], k: int, number: str) -> DataFrame:
    """First ``k`` rows per group, in two steps.

    Every map task cuts its share of a group to ``k`` rows; these are ranked in
    ``BUCKETS`` parts first, so that a group spread over very many tasks does not
    send all their rows to one.
    """
    part = F.pmod(F.monotonically_increasing_id(), F.lit(BUCKETS))
    first = Window.partitionBy(*by, "_part").orderBy(*order)
    cut = rows.withColumn("_part", part).withColumn("_nth", F.row_number().over(first)).filter(F.col("_nth") <= k)
    window = Window.partitionBy(*by).orderBy(*order)
    return cut.drop("_part", "_nth").withColumn(number, F.row_number().over(window)).filter(F.col(number) <= k)
