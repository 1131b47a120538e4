"""Packs that arrive in pieces on a stream equal packs planned at once."""

import os

import pytest
from pyspark.sql import functions as F

from packlake.operators import rollup
from packlake.plans import pack
from packlake.spec import PackSpec
from packlake.streaming import packs

SCHEMA = "pack_id string, path string, size_bytes bigint, content string"
SPEC = PackSpec(max_tokens=150, collation="UTF8_BINARY", remove_comments=True)


def file(name, content, pack_id="p"):
    return (pack_id, name, len(content.encode()), content)


ONE = [file(f"src/m{k}.py", f"# note {k}\n" + "value = other + 1\n" * k) for k in range(1, 9)] + [file("draft.txt", "old words")]
TWO = [file(".gitignore", "*.log\n!keep.log\n"), file("a/b.log", "gone"), file("a/keep.log", "kept line"), file("draft.txt", "new and longer words")]
THREE = [file("package.json", '{"name": "x"}'), file("README.md", "read me " * 30), ("p", None, None, None)]
OTHER = [file("x.md", "never closed", "open"), (None, "lost.md", 1, "x")]
EMPTY = [("empty", None, None, None)]


class Source:
    """A folder a stream reads file by file, in the order they were put there."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, folder, 0
        (folder / "in").mkdir()
        self.rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder / "in"))

    def put(self, *batches):
        import json

        for batch in batches:
            target = self.folder / "in" / f"{self.n}.json"
            target.write_text("\n".join(json.dumps(dict(zip(("pack_id", "path", "size_bytes", "content"), r))) for r in batch))
            os.utime(target, (1_700_000_000 + self.n, 1_700_000_000 + self.n))
            self.n += 1

    def run(self):
        query = packs.pack_stream(self.rows, SPEC, str(self.folder / "out"), str(self.folder / "cp"))
        assert query.awaitTermination(240)

    def rows_of(self, name, *columns):
        return sorted(map(tuple, packs.results(self.spark, str(self.folder / "out"), name).select(*columns).collect()))


def expected(spark, batches):
    files = {}
    for batch in batches:
        files |= {(r[0], r[1]): r for r in batch if r[1] is not None and r[0] == "p"}
    plan = pack.pack(spark.createDataFrame(list(files.values()), SCHEMA), SPEC)
    return plan, rollup.directory_tokens(plan.stats)


FILE = ["pack_id", "path", "tokens", "redactions", "is_omitted"]
DIR = ["pack_id", "dir", "tokens", "depth"]


def check(source, spark, batches):
    plan, dirs = expected(spark, batches)
    assert source.rows_of("stats", *FILE) == sorted(map(tuple, plan.stats.select(FILE).collect()))
    assert source.rows_of("directories", *DIR) == sorted(map(tuple, dirs.select(DIR).collect()))
    assert source.rows_of("totals", "pack_id", "total_tokens") == sorted(map(tuple, plan.totals.select("pack_id", "total_tokens").collect()))


def test_pack_in_pieces_with_a_repeated_batch(spark, tmp_path):
    source = Source(spark, tmp_path)
    source.put(ONE, OTHER, TWO, TWO)
    source.run()
    assert not (tmp_path / "out" / "closed").exists()  # nothing is complete yet
    source.put(THREE + EMPTY)
    source.run()
    assert source.rows_of("stats", "path")
    check(source, spark, [ONE, TWO, THREE])
    late = [file("late.md", "one more " * 5), file("src/m8.py", "x = 1\n"), ("p", None, None, None)]
    source.put(late)
    source.run()
    check(source, spark, [ONE, TWO, THREE, late])
    # a batch that is run again after a failure writes the same results
    before = source.rows_of("stats", *FILE)
    schema = spark.read.parquet(str(tmp_path / "out" / "facts")).schema
    for batch in (4, 5):
        packs._close(spark, SPEC, str(tmp_path / "out"), batch, schema)
    assert source.rows_of("stats", *FILE) == before


def test_what_a_stream_cannot_do(spark, tmp_path):
    with pytest.raises(ValueError):
        packs.pack_stream(spark.readStream.format("rate").load(), PackSpec(token_mode="bpe"), str(tmp_path), str(tmp_path))


def test_last_arrival_counts(spark):
    rows = spark.createDataFrame([("p", "a", 1, 5, 7), ("p", "a", 2, 5, 7), ("p", "a", 2, 5, 9), ("p", "b", 0, 1, 1)], "pack_id string, path string, batch int, size_bytes bigint, digest bigint")
    found = packs._latest(rows).select("path", "batch", "digest").orderBy("path").collect()
    assert [tuple(r) for r in found] == [("a", 2, 9), ("b", 0, 1)]
    assert packs._latest(rows.filter(F.lit(False))).count() == 0
