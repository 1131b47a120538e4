"""The boundary of a budget is found digit by digit."""

import random

import pytest
from pyspark.sql import functions as F

from packlake.operators import budget, order
from tests.test_loops import budget_loop

SCHEMA = "pack_id string, path string, tokens bigint, has_content boolean"


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_wide_weights_equal_the_loop(spark, monkeypatch, bits):
    monkeypatch.setattr(budget, "RADIX_BITS", bits)
    rng, packs, rows = random.Random(bits), {}, []
    top = 200 if bits == 1 else 2**40
    for p in range(12):
        files = [("package.json", rng.randrange(top), True)]
        files += [(f"f{i:02}", rng.choice([0, 7, 7, top - 1, rng.randrange(top)]), rng.random() < 0.9) for i in range(rng.randrange(25))]
        packs[f"p{p}"] = sorted((n, w if has else 0, has) for n, w, has in files)
        rows += [(f"p{p}", *f) for f in packs[f"p{p}"]]
    df = spark.createDataFrame(rows, SCHEMA)
    for limit in (0, top, 4 * top):
        got = {p: set() for p in packs}
        for r in budget.mark_omitted(df, limit, order.order_keys("path", "UTF8_BINARY")).filter("is_omitted").collect():
            got[r.pack_id].add(r.path)
        assert got == {p: budget_loop(files, limit) for p, files in packs.items()}


def test_histograms_stay_small_however_many_weights(spark, monkeypatch):
    sizes, plain = [], budget._histogram

    def spied(inside):
        hist = plain(inside)
        sizes.append(hist.groupBy("pack_id").count().agg(F.max("count")).first()[0])
        return hist

    monkeypatch.setattr(budget, "_histogram", spied)
    n, factor = 1_000_000, 1009
    w = (F.col("id") * 7919 % n + 1) * factor
    rows = spark.range(n).select(
        F.lit("hot").alias("pack_id"), F.format_string("f%07d", "id").alias("path"), w.alias("tokens"), F.lit(True).alias("has_content")
    )
    limit = factor * (n // 2) * (n // 2 + 1) // 2  # the lighter half fits exactly
    marked = budget.mark_omitted(rows, limit, order.order_keys("path", "UTF8_BINARY"))
    kept = marked.filter("NOT is_omitted").agg(F.count(F.lit(1)), F.max("tokens"), F.sum("tokens")).first()
    assert tuple(kept) == (n // 2, factor * (n // 2), limit)
    assert len(sizes) == 3 and max(sizes) <= 2**budget.RADIX_BITS


def test_no_pack_over_budget(spark):
    df = spark.createDataFrame([("p", "a", 3, True), ("q", "package.json", 9, True), ("q", "b", 0, False)], SCHEMA)
    for limit, table in ((5, df), (5, df.limit(0)), (100, df)):
        assert budget.mark_omitted(table, limit, order.order_keys("path", "UTF8_BINARY")).filter("is_omitted").count() == 0
