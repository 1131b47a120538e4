"""Connected components of a link table, by stars.

Rounds of large-star and small-star (Kiveris et al., 2014): each node's
neighbours are hung on the smallest node of its neighbourhood, first the larger
ones, then the smaller ones, until every component is one star.  A round is
two aggregates and two joins; nothing comes to the driver but a count, and no
neighbourhood is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlake.session import materialize


def _hang(edges: DataFrame, smaller_only: bool) -> DataFrame:
    """Edges (u, v) to edges (v, smallest of u's neighbourhood)."""
    both = edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).filter("a <> b")
    if not smaller_only:
        both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    heads = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("head"))
    moved = both.join(heads, "a")
    if smaller_only:
        hung = moved.select(F.col("b").alias("u"), F.col("head").alias("v")).unionByName(heads.select(F.col("a").alias("u"), F.col("head").alias("v")))
    else:
        hung = moved.filter("b > a").select(F.col("b").alias("u"), F.col("head").alias("v"))
    return hung.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (u, v); the component is its smallest node."""
    edges = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        edges = materialize(_hang(_hang(edges, False), True))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
