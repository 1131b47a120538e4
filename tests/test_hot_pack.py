"""One pack that holds every document: nothing may depend on packs being small."""

import pytest
from pyspark.sql import functions as F

from packlake.operators import scan
from packlake.plans import pack, render, store
from packlake.sources import tables
from packlake.spec import PackSpec
from tests.test_loops import budget_loop

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def hot(spark):
    files = tables.files(spark, SF_DIR).filter("doc_id IS NOT NULL")
    return files.select(
        F.lit("hot").alias("pack_id"),
        F.concat("pack_id", F.lit("/"), "path").alias("path"),
        "size_bytes",
        "content",
    )


def test_budget_of_one_pack_equals_the_loop(hot):
    plain = pack.pack(hot, PackSpec(collation="UTF8_BINARY")).stats.collect()
    rows = sorted((r.path, r.tokens, r.has_content) for r in plain)
    limit = sum(t for _, t, _ in rows) // 3
    cut = pack.pack(hot, PackSpec(collation="UTF8_BINARY", max_tokens=limit))
    assert {r.path for r in cut.omitted.collect()} == budget_loop(rows, limit)
    assert cut.totals.first().total_tokens <= limit


def test_lines_of_one_pack_are_numbered_without_gaps(hot):
    plan = pack.pack(hot, PackSpec())
    lines = [(r.line_no, r.text) for r in store.number_lines(plan).orderBy("line_no").collect()]
    assert [n for n, _ in lines] == list(range(1, len(lines) + 1))
    parts = render.volumes(plan, 4096).orderBy("volume").collect()
    assert len(parts) > 10
    assert "\n".join(r.document for r in parts).split("\n") == [t for _, t in lines]
    assert store.line_counts(plan).first().line_count == len(lines)


def test_tree_of_one_pack_nests(hot):
    lines = render.tree_only(pack.pack(hot, PackSpec(collation="UTF8_BINARY"))).orderBy("tree_key").collect()
    stack, last = [], {}
    for row in lines:
        last[row.node.rpartition("/")[0]] = row.node
    for row in lines:
        parts = row.node.split("/")
        indent = "".join(
            "    " if last["/".join(parts[:i])] == "/".join(parts[: i + 1]) else "│   " for i in range(len(parts) - 1)
        )
        branch = "└── " if last["/".join(parts[:-1])] == row.node else "├── "
        assert row.line == indent + branch + parts[-1]
        stack.append(row.node)
    assert [n.split("/") for n in stack] == sorted(n.split("/") for n in stack)


def test_selection_of_one_pack_keeps_every_file(hot):
    selected = scan.select_files(hot, PackSpec(excludes=["*.json", "!doc_1*.json"]))
    got = {r.path for r in scan.kept(selected).collect()}
    paths = {r.path for r in hot.select("path").collect()}
    assert got == {p for p in paths if not p.endswith(".json") or p.rpartition("/")[2].startswith("doc_1")}
