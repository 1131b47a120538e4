"""The trigram index: what a regex needs, and that a search with it finds the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from packlake.plans import grams, pack, store
from packlake.spec import PackSpec


@pytest.mark.parametrize(
    "pattern, wanted",
    [
        ("Budget", [{"bud", "udg", "dge", "get"}]),
        ("en th|^## ", [{"en ", "n t", " th"}, {"## "}]),
        ("colou?r_map", [{"col", "olo", "r_m", "_ma", "map"}]),
        ("go+al", [{"oal"}]),
        ("loo+king", [{"loo", "oki", "kin", "ing"}]),
        (r"a\.b\.c", [{"a.b", ".b.", "b.c"}]),
        (r"(?:read|write)File", [{"rea", "ead", "fil", "ile"}, {"wri", "rit", "ite", "fil", "ile"}]),
        (r"key[0-9]{2}=true", [{"key", "=tr", "tru", "rue"}]),
        ("(abc){2,3}", [{"abc"}]),
        ("(abc)?def", [{"def"}]),
        ("x{3}yz", [{"xyz"}]),
        ("(?i)select", None),
        ("(?=abc)abc", None),
        (r"\Qabc.def\E", None),
        ("[a[bc]]def", None),
        (r"(abc)\1", None),
        ("ab|cdef", None),
        ("", None),
        (".*", None),
    ],
)
def test_needed(pattern, wanted):
    found = grams.needed(pattern)
    assert found == (wanted and [frozenset(w) for w in wanted])


def text(seed, n):
    pick = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "x.y", "ÄÖÜ", "😀tail", "zz", "", "if (a)", "\t"]
    return "\n".join(" ".join(pick.choice(words) for _ in range(pick.randrange(6))) for _ in range(n))


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    rows = [(f"p{k % 3}", f"d/f{k}.md", 1, text(k, 700)) for k in range(12)]
    rows += [("p1", "d/rare.md", 1, text(99, 900) + "\nthe Needle-in-hay\n" + text(98, 900)), ("p2", "empty.md", 0, "")]
    files = spark.createDataFrame(rows, "pack_id string, path string, size_bytes bigint, content string")
    folder = str(tmp_path_factory.mktemp("store"))
    store.save(pack.pack(files, PackSpec(collation="UTF8_BINARY")), folder, indexed=True)
    return store.load(spark, folder)[1].cache(), store.load_index(spark, folder).cache()


def test_index_equals_a_loop(saved):
    lines, index = saved
    wanted = set()
    for row in lines.collect():
        low = row.text.translate(grams.LOWER)
        wanted |= {(low[i : i + 3], row.pack_id, (row.line_no - 1) // grams.BLOCK_LINES) for i in range(len(low) - 2)}
    found = [tuple(r) for r in index.collect()]
    assert len(found) == len(set(found)) and set(found) == wanted


@pytest.mark.parametrize("few", [0, 256])
@pytest.mark.parametrize(
    "pattern, ignore_case",
    [("needle-in", True), ("needle-in", False), ("Needle", False), (r"alpha (?:Beta|x\.y)", False), ("^Beta$|ÄÖÜ$", False), ("😀tail", False), ("nowhere", False), ("z+", False), (r"IF \(a", True)],
)
def test_same_rows_with_and_without(saved, monkeypatch, pattern, ignore_case, few):
    monkeypatch.setattr(grams, "PUSHED_BLOCKS", few)
    lines, index = saved
    plain = store.grep(lines, pattern, ignore_case, context=3, limit=40)
    quick = store.grep(lines, pattern, ignore_case, context=3, limit=40, index=index)
    key = ["pack_id", "match_no", "line_no", "is_match", "text"]
    assert sorted(plain.select(key).collect()) == sorted(quick.select(key).collect())


def test_rare_literal_reads_one_block(saved):
    lines, index = saved
    seen = grams.narrowed(lines, index, "Needle-in-hay")
    assert 0 < seen.count() <= grams.BLOCK_LINES < lines.count() / 5
    assert grams.narrowed(lines, index, "(?s)Needle") is lines
    assert grams.narrowed(lines, index, "unheard of").count() == 0


def test_tiny_and_missing_lines(spark):
    lines = spark.createDataFrame([("p", 1, "ab"), ("p", 2, None), ("p", 3, ""), ("p", 4, "a\rb"), ("q", 1, "y" * 200_000)], "pack_id string, line_no bigint, text string")
    assert sorted(map(tuple, grams.build(lines).collect())) == [("a\rb", "p", 0), ("yyy", "q", 0)]
    assert grams.build(lines.limit(0)).count() == 0
    assert lines.filter(F.col("text").isNull()).count() == 1
