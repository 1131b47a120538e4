"""Parts of a pack that come as rows: pieces of diffs, choices of single packs, lengths before and after shaping."""

import json

import pytest
from pyspark.sql import functions as F

from packlake.plans import pack, render
from packlake.spec import PackSpec

FILES = {("p", "a.py"): "# one\n\ndef f():\n    return 1\n", ("p", "b.txt"): "x\n\n\ny", ("q", "c.md"): "text", ("r", "empty.txt"): ""}
PIECES = [
    ("p", "b.txt", 1, "@@ -1 +1 @@\n-````\n+\"quoted\" \\ back"),
    ("p", "b.txt", 0, "--- a/b.txt\n+++ b/b.txt"),
    ("p", "a.py", 10, "@@ -9 +9 @@\n-z"),
    ("p", "a.py", 2, "@@ -1 +1 @@\n-y"),
    ("p", "a.py", 1, " \n"),
    ("p", None, None, "first"),
    ("q", "c.md", 0, None),
]
ORDERED = ["first", PIECES[3][3], PIECES[2][3], PIECES[1][3], PIECES[0][3]]


@pytest.fixture
def diffs(spark):
    return spark.createDataFrame(PIECES, "pack_id string, path string, part int, diff string")


def document(plan, pack_id):
    rows = [r for r in render.sections(plan).collect() if r.pack_id == pack_id]
    return "\n".join(r.text for r in sorted(rows, key=lambda r: (r.section, r["rank"], list(r["key"]), r.entry)))


def test_pieces_of_a_diff_stand_in_order_behind_one_fence(corpus, diffs):
    plan = pack.pack(corpus(FILES), PackSpec(collation="UTF8_BINARY"), diffs=diffs)
    wanted = "\n".join(["## Git Diff (uncommitted changes)", "", "`````diff", *ORDERED, "`````", ""])
    assert document(plan, "p").endswith(wanted)
    assert "Git Diff" not in document(plan, "q") + document(plan, "r")


@pytest.mark.parametrize("form, before, after", [("xml", "<gitDiff><![CDATA[", "]]></gitDiff>"), ("plain", "GIT DIFF (uncommitted changes)\n" + render.SEPARATOR, "")])
def test_pieces_of_a_diff_in_other_forms(corpus, diffs, form, before, after):
    plan = pack.pack(corpus(FILES), PackSpec(format=form, collation="UTF8_BINARY"), diffs=diffs)
    assert "\n".join([before, *ORDERED, after]) in document(plan, "p")
    assert before not in document(plan, "q")


def test_nested_json_holds_a_diff_as_one_string_cut_anywhere(corpus, diffs):
    plan = pack.pack(corpus(FILES), PackSpec(format="json", collation="UTF8_BINARY"), diffs=diffs)
    for size in (1, 40, 1 << 20):
        volumes = render.json_documents(plan, size)
        docs = {}
        for r in sorted(volumes.collect(), key=lambda r: (r.pack_id, r.volume)):
            docs[r.pack_id] = docs.get(r.pack_id, "") + r.document
        diff = json.loads(docs["p"])["gitDiff"]
        assert diff == "\n".join(ORDERED)
        assert json.loads(docs["q"])["gitDiff"] is None
        rows = render.json_rows(volumes).collect()
        lines = sorted(r.value for r in rows if r.kind == "diff")
        assert lines == sorted(line for line in diff.split("\n") if line)
        trees = {p: sorted(line for line in json.loads(d)["tree"].split("\n") if line) for p, d in docs.items()}
        assert trees == {p: sorted(r.value for r in rows if r.kind == "tree" and r.pack_id == p) for p in docs}


def test_packs_choose_for_themselves(spark, corpus):
    own = spark.createDataFrame([("p", "SEC", None, "Mine"), ("q", None, "Audit", None)], "pack_id string, persona string, recipe string, task string")
    spec = PackSpec(format="json", persona="arch", task="Shared", collation="UTF8_BINARY")
    plan = pack.pack(corpus(FILES), spec, packs=own)
    found = {r.pack_id: json.loads(r.document) for r in render.json_documents(plan).collect()}
    assert {p: d["metadata"]["persona"] for p, d in found.items()} == {"p": "security", "q": "architect", "r": "architect"}
    assert found["p"]["task"] == "Mine" and found["r"]["task"] == "Shared"
    assert found["q"]["task"].startswith("Shared\n\n") and len(found["q"]["task"]) > 20


@pytest.mark.parametrize("column", ["persona", "recipe"])
def test_unknown_choices_are_errors(spark, corpus, column):
    own = spark.createDataFrame([("p", "nobody")], f"pack_id string, {column} string")
    with pytest.raises(ValueError, match="nobody"):
        pack.pack(corpus(FILES), PackSpec(), packs=own)


def test_savings_count_every_text_before_the_budget(corpus):
    spec = PackSpec(compress=True, remove_blank_lines=True, max_tokens=1)
    saved = {r.pack_id: r.asDict() for r in pack.pack(corpus(FILES), spec).savings.collect()}
    before = len(FILES[("p", "a.py")]) + len(FILES[("p", "b.txt")])
    assert saved["p"]["chars_before"] == before and saved["p"]["compressed_files"] == 1
    assert saved["p"]["chars_after"] < before
    assert saved["p"]["saved_percent"] == int((before - saved["p"]["chars_after"]) / before * 100 + 0.5)
    assert (saved["q"]["chars_before"], saved["q"]["saved_percent"], saved["q"]["compressed_files"]) == (4, 0, 0)
    assert pack.pack(corpus(FILES), PackSpec()).savings.collect() == []
