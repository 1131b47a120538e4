"""Offsets come from facts: they equal what rendering gives, and texts are rendered once per sink."""

import random

import pytest
from pyspark.sql import functions as F

from packlake.plans import pack, render, store
from packlake.spec import PackSpec

PIECES = ["a", "é", "\n", "\n\n", "`", "```", "````\n", "&", "<b>", '"', "'", "\\", "\t", "\r\n", "中", "😀", " = 1", "\u0001", "]]>"]


def texts(seed):
    pick = random.Random(seed)
    files = {(f"p{k % 2}", f"d{k % 3}/f {k}.{pick.choice(['py', 'md', 'txt', 'json'])}"): "".join(pick.choice(PIECES) for _ in range(pick.randrange(60))) for k in range(24)}
    return files | {("p0", "zero.bin"): "x\x00y", ("p1", "empty.txt"): "", ("p2", "only.txt"): "one", ("p1", "big.txt"): "b\n" * 1500, ("p1", "long.md"): "line\n" * 1100}


def joined(rows, separator="\n"):
    """Sections in document order, with the lines and bytes that stand before each."""
    out, lines, size = [], 0, 0
    for r in sorted(rows, key=lambda r: (r.section, r["rank"], list(r["key"]), r.entry)):
        out.append((r.section, r.entry, lines, size))
        lines += r.text.count("\n") + 1
        size += len(r.text.encode()) + len(separator)
    return out


@pytest.mark.parametrize("form", ["markdown", "xml", "plain", "json"])
@pytest.mark.parametrize("numbers", [False, True])
def test_offsets_equal_rendered_ones(corpus, form, numbers):
    spec = PackSpec(format=form, line_numbers=numbers, collation="UTF8_BINARY", max_file_kb=3, max_tokens=900, task="Do it.\nNow.")
    plan = pack.pack(corpus(texts(form)), spec)
    rows = render.located(plan).collect()
    for name in ("p0", "p1", "p2"):
        own = [r for r in rows if r.pack_id == name]
        found = [(r.section, r.entry, r.line_offset, r.byte_offset) for r in own]
        assert sorted(found, key=lambda f: f[3]) == joined(own)


def test_nested_json_offsets(corpus):
    plan = pack.pack(corpus(texts(9)), PackSpec(format="json", line_numbers=True, collation="UTF8_BINARY"))
    rows = render.located(plan, render.json_sections, "").collect()
    own = [r for r in rows if r.pack_id == "p0"]
    assert sorted(r.byte_offset for r in own) == [size for *_, size in joined(own, "")]


def test_each_sink_renders_a_text_once(spark, corpus, tmp_path):
    files = corpus({(f"p{k % 3}", f"f{k}.md"): f"text {k}\n" * (k % 7 + 1) for k in range(60)})
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(content):
        seen.add(1)
        return content

    source = files.withColumn("content", counted.asNondeterministic()("content"))
    plan = pack.pack(source, PackSpec(collation="UTF8_BINARY"))
    for sink in (lambda: store.save(plan, str(tmp_path / "store")), lambda: render.write_text(plan, str(tmp_path / "text")), lambda: render.volumes(plan).count()):
        before = seen.value
        sink()
        assert seen.value - before == 60
    before = seen.value
    store.line_counts(plan).collect()
    assert seen.value == before


def test_saved_lines_are_sorted_and_whole(spark, corpus, tmp_path):
    plan = pack.pack(corpus(texts(3)), PackSpec(collation="UTF8_BINARY"))
    store.save(plan, str(tmp_path / "s"))
    packs, lines = store.load(spark, str(tmp_path / "s"))
    parts = lines.select(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"), "pack_id", "line_no").orderBy("f", "i").collect()
    assert [(r.pack_id, r.line_no) for r in parts] == sorted((r.pack_id, r.line_no) for r in parts)
    count = {r.pack_id: r.line_count for r in packs.collect()}
    for name, n in count.items():
        assert sorted(r.line_no for r in parts if r.pack_id == name) == list(range(1, n + 1))
