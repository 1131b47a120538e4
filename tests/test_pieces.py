"""Merged lengths of pieces are kept between runs."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packlake.operators import bpe
from packlake.plans import pack
from packlake.spec import PackSpec


@pytest.fixture(scope="module")
def ranks(spark):
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"cd", b"abcd", b" ab", b"xy"]
    return spark.createDataFrame([(t, i) for i, t in enumerate(tokens)], "token binary, rank int")


def counts(files, ranks, folder=None):
    return {r.path: r.tokens for r in bpe.count_bpe(files, ranks, pieces_path=folder).collect()}


def kept(spark, folder, ranks):
    return {r.piece: r.merged for r in bpe.kept_lengths(spark, folder, bpe.ranks_id(ranks)).collect()}


def test_second_run_merges_no_piece(spark, corpus, ranks, tmp_path):
    folder = str(tmp_path / "pieces")
    first = corpus({"a": "abcdab xyz abab", "b": "", "c": "é abcdab abcdab\n"})
    plain = counts(first, ranks)
    assert counts(first, ranks, folder) == plain
    table = kept(spark, folder, ranks)
    assert table["abcdab"] == 2 and "ab" not in table  # single tokens need no merging
    # what the table says is taken as it is, so nothing is merged again
    path = f"{folder}/ranks={bpe.ranks_id(ranks)}"
    spark.createDataFrame([(p, 100) for p in table], "piece string, merged bigint").write.mode("overwrite").parquet(path)
    second = counts(corpus({"a": "abcdab", "d": "abcdab zzz"}), ranks, folder)
    assert second == {"a": 100, "d": 104}
    now = kept(spark, folder, ranks)
    assert set(now) - set(table) == {" zzz"} and now["abcdab"] == 100


def test_tables_of_other_ranks_are_apart(spark, corpus, ranks, tmp_path):
    folder = str(tmp_path / "pieces")
    fewer = ranks.filter("rank < 257")
    files = corpus({"a": "abcdabcd"})
    assert counts(files, ranks, folder) == {"a": 2} and counts(files, fewer, folder) == {"a": 6}
    assert bpe.ranks_id(ranks) == bpe.ranks_id(ranks.repartition(3)) != bpe.ranks_id(fewer)
    assert kept(spark, folder, ranks) != kept(spark, folder, fewer)


def test_repeated_rows_and_empty_tables(spark, corpus, ranks, tmp_path):
    folder = str(tmp_path / "pieces")
    assert counts(corpus({"a": "ab"}).limit(0), ranks, folder) == {}
    path = f"{folder}/ranks={bpe.ranks_id(ranks)}"
    spark.createDataFrame([("abcdab", 2), ("abcdab", 2)], "piece string, merged bigint").write.mode("append").parquet(path)
    assert counts(corpus({"a": "abcdab"}), ranks, folder) == {"a": 2}


def test_packs_take_the_table(corpus, ranks, tmp_path):
    files, spec = corpus({"a.md": "abcdab xyz\n", "b.md": "abcdab"}), PackSpec(token_mode="bpe")
    plain = pack.pack(files, spec, ranks=ranks).totals.collect()
    for _ in range(2):
        assert pack.pack(files, spec, ranks=ranks, pieces_path=str(tmp_path / "pieces")).totals.collect() == plain


def plain_counts(texts, ranks):
    """By a loop over the pieces of each text; these texts are cut at blanks alone."""
    known = {bytes(r.token): r.rank for r in ranks.collect()}
    return [sum(1 if p in known else bpe.merged_length(p, known) for p in re.findall(rb" ?[a-z]+", (t or "").encode())) for t in texts]


def test_pieces_are_not_shuffled(spark, corpus, ranks):
    """What is exchanged is a number per row: it does not grow with the texts."""
    out = bpe.count_bpe(corpus({"a": "abcdab xy", "b": None, "c": ""}), ranks)
    exchanged = re.findall(r"Exchange \w+\(([^)]*)", out._jdf.queryExecution().executedPlan().toString())
    assert exchanged and not any("piece" in keys for keys in exchanged)
    assert {r.path: r.tokens for r in out.collect()} == {"a": 4, "b": 0, "c": 0}


def test_counts_in_place_over_batches_and_forgotten_pieces(spark, ranks):
    rng = random.Random(3)
    texts = [None if i % 17 == 0 else " ".join("".join(rng.choice(["ab", "cd", "xy", "q"]) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(40))) for i in range(300)]
    texts += ["abcdq" * 30, "abcdq" * 30 + " xy"]  # longer than what is kept
    files = spark.createDataFrame(list(enumerate(texts)), "path int, content string").repartition(3)
    expected = dict(enumerate(plain_counts(texts, ranks)))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    table = spark.sparkContext.broadcast({bytes(r.token): r.rank for r in ranks.collect()})
    try:
        for batch in ("7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            assert {r.path: r.tokens for r in bpe.count_bpe(files, ranks, keys=("path",)).collect()} == expected
            pieces = F.regexp_extract_all("content", F.lit(bpe.PATTERNS["o200k_base"]), F.lit(0))
            few = files.select("path", bpe.tokens_in_place(pieces, table, remembered=5).alias("n"))  # null arrays too
            assert {r.path: r.n for r in few.collect()} == expected
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_each_distinct_piece_of_a_batch_is_asked_once():
    asked = []
    rows = pa.array([["ab", "é", "ab"], None, [], ["é"], ["ab", "z"]], pa.list_(pa.string())).slice(1)
    assert bpe.row_tokens(rows, lambda p: asked.append(p) or len(p)).tolist() == [0, 0, 2, 3]
    assert sorted(asked) == [b"ab", b"z", "é".encode()]


def test_rows_that_repeat_a_key_and_null_keys(spark, ranks, tmp_path):
    """Rows of one key count together, as with kept pieces; a null key meets nothing."""
    rows = [("a", "abcdab"), ("a", "xyz"), ("b", None), (None, "abcd"), (None, "ab")]
    files = spark.createDataFrame(rows, "path string, content string").repartition(3)
    for folder in (None, str(tmp_path / "pieces")):
        got = bpe.count_bpe(files, ranks, keys=("path",), pieces_path=folder).collect()
        assert sorted((str(r.path), r.tokens) for r in got) == [("None", 0), ("None", 0), ("a", 4), ("a", 4), ("b", 0)]
