"""Whole packs: order of steps, documents, stores, sources, streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from packlake.plans import pack, render, store
from packlake.sources import corpus as sources
from packlake.spec import PackSpec

WORDY = "export class Ledger {\n" + "".join(f"  entry{k}(cents: number) {{\n    this.rows.push([{k}, cents]);\n    return this;\n  }}\n" for k in range(12)) + "}\n"
WORDY = WORDY.replace("return this;", "return this;\n" + "    this.check(1, 2, 3, 4, 5, 6, 7, 8);\n" * 20)


def document(plan, **kw):
    rows = render.volumes(plan, **kw).orderBy("pack_id", "volume").collect()
    return "\n".join(r.document for r in rows)


def test_shaping_runs_before_the_budget(corpus):
    """A file whose bodies alone are over the budget stays, as its skeleton is not."""
    files = corpus({"books/ledger.ts": WORDY, "books/index.ts": 'export { Ledger } from "./ledger";\n'})
    whole = pack.pack(files, PackSpec()).totals.first().total_tokens
    skeleton = pack.pack(files, PackSpec(compress=True)).totals.first().total_tokens
    limit = (whole + skeleton) // 2
    packed = pack.pack(files, PackSpec(compress=True, max_tokens=limit))
    assert skeleton < limit < whole and packed.omitted.count() == 0
    assert packed.totals.first().total_tokens == skeleton
    assert "export class Ledger" in document(packed) and "this.check" not in document(packed)
    assert pack.pack(files, PackSpec(max_tokens=limit)).omitted.count() == 1


def test_budget_drops_the_heaviest_but_never_the_manifest(corpus):
    files = corpus(
        {"package.json": '{"name": "x"}', "huge.ts": "// f\n" + "const data = 'abcdefgh';\n" * 400, "small.ts": "export const ok = true;\n"}
    )
    packed = pack.pack(files, PackSpec(max_tokens=300))
    assert {r.path for r in packed.omitted.collect()} == {"huge.ts"}
    text = document(packed)
    assert "(omitted to fit token budget)" in text and "huge.ts [omitted: token budget]" in text
    assert "Total Files: 3" in text
    only = pack.pack(files, PackSpec(max_tokens=1))
    assert {r.path for r in only.omitted.collect()} == {"huge.ts", "small.ts"}


def test_stack_reads_workspace_manifests(corpus):
    files = corpus(
        {
            "package.json": '{"name":"root","private":true}',
            "packages/web/package.json": '{"dependencies":{"react":"^18.0.0"}}',
            "packages/api/package.json": '{"devDependencies":{"fastify":"^4.0.0"}}',
            "packages/bad/package.json": "{nope",
            "services/worker/go.mod": "module x\n",
            "crates/core/Cargo.toml": "[package]\n",
        }
    )
    line = next(x for x in document(pack.pack(files, PackSpec())).split("\n") if x.startswith("Tech Stack:"))
    assert line == "Tech Stack: Fastify, Go, React, Rust"


def test_markdown_layout(corpus):
    files = corpus({"src/a.ts": "one\ntwo", "b.md": "```js\nx\n```", "empty.txt": ""})
    spec = PackSpec(line_numbers=True, task="Do it", persona="ref")
    diffs = files.select("pack_id").distinct().withColumn("diff", F.lit("--- a\n+++ b"))
    text = document(pack.pack(files, spec, diffs=diffs))
    assert text == "\n".join(
        [
            "```", "├── b.md", "├── empty.txt", "└── src", "    └── a.ts", "```", "", "## Table of Contents", "",
            "- [b.md](#bmd)", "- [src/a.ts](#srcats)", "", "```",
            "You are a Clean Code Expert. Suggest ways to reduce complexity and improve readability.",
            "Root: p", "Total Files: 3", "Total Tokens: 10", "Task Status: Pending (See end of file)",
            "Safety: No secrets were detected. Manual review is still recommended.", "```", "",
            "## b.md {#bmd}", "", "````md", "1: ```js", "2: x", "3: ```", "````", "",
            "## empty.txt {#emptytxt}", "", "(no content)", "",
            "## src/a.ts {#srcats}", "", "```ts", "1: one", "2: two", "```", "",
            "## Git Diff (uncommitted changes)", "", "```diff", "--- a", "+++ b", "```", "",
            "## User Task / Instructions", "", "```", "Do it", "```", "",
        ]
    )


def test_oversized_note_names_the_limit(corpus):
    files = corpus({"big.txt": "x" * 50_000})
    text = document(pack.pack(files, PackSpec(max_file_kb=42)))
    assert "big.txt [skipped >42KB]" in text and "(file >42KB, contents skipped)" in text


def test_plain_xml_and_redaction_off(corpus):
    files = corpus({"a.txt": "hello <b> sk-abcdefghijklmnop123456"})
    plain = document(pack.pack(files, PackSpec(format="plain")))
    assert "File: a.txt" in plain and "DIRECTORY STRUCTURE" in plain and "[REDACTED_SECRET]" in plain
    assert "Safety: 1 secrets were detected" in plain
    xml = document(pack.pack(files, PackSpec(format="xml", redact=False)))
    assert '<file path="a.txt">hello &lt;b&gt; sk-abcdefghijklmnop123456</file>' in xml
    assert "Secret redaction was DISABLED" in xml


def test_json_document(corpus):
    files = corpus({"src/index.ts": "export const x = 1;\n"})
    plan = pack.pack(files, PackSpec(format="json", task="Review this"))
    parsed = json.loads(render.json_documents(plan).first().document)
    assert parsed["metadata"]["totalFiles"] == 1
    assert parsed["metadata"]["totalTokens"] == plan.totals.first().total_tokens
    assert parsed["files"][0]["path"] == "src/index.ts" and parsed["task"] == "Review this"
    assert "index.ts" in parsed["tree"]
    pieces = render.json_documents(plan, max_bytes=10).orderBy("volume").collect()
    assert len(pieces) > 3 and json.loads("".join(p.document for p in pieces)) == parsed
    assert "".join(p.document for p in pieces) == json.dumps(parsed, indent=2, ensure_ascii=False)
    records = [json.loads(r.text) for r in render.sections(plan).orderBy(*render.SECTION_ORDER).collect()]
    assert [r["type"] for r in records] == ["metadata", "tree", "tree", "file", "task"]


@pytest.mark.parametrize("sort, expected", [("path", ["a", "B", "c"]), ("size", ["c", "B", "a"]), ("churn", ["B", "c", "a"])])
def test_output_orders(corpus, spark, sort, expected):
    files = corpus({"a": "123", "B": "12", "c": "1"})
    touches = spark.createDataFrame([(1, "p", "a"), (2, "p", "a"), (1, "p", "c")], "commit_id bigint, pack_id string, path string")
    plan = pack.pack(files, PackSpec(sort=sort), touches=touches.withColumn("ts", F.lit("2024-01-01").cast("timestamp")))
    titles = [x for x in document(plan).split("\n") if x.startswith("## ") and "{" in x]
    assert [t.split()[1] for t in titles] == expected


def test_locale_order_of_the_tree(corpus):
    files = corpus({p: "x" for p in ["_x", "a", "A", "a.b", "b", "B"]})
    lines = render.tree_only(pack.pack(files, PackSpec())).orderBy("tree_key").collect()
    assert [r.node for r in lines] == ["_x", "a", "A", "a.b", "b", "B"]
    assert lines[-1].line.startswith("└── ") and lines[0].line.startswith("├── ")


def test_volumes_of_any_size_join_to_the_same_document(corpus):
    plan = pack.pack(corpus({f"f{i}.txt": f"text {i}\n" * i for i in range(12)}), PackSpec())
    assert document(plan) == document(plan, max_bytes=100)


def test_store_read_and_grep(corpus, spark, tmp_path):
    files = corpus(
        {
            "package.json": '{"name":"demo","dependencies":{"express":"^4.0.0"}}',
            "src/index.ts": 'export function greet(name: string) {\n  return "hello " + name;\n}\n',
            ".env": "SECRET=hunter2\n",
        }
    )
    plan = pack.pack(files, PackSpec())
    assert [r.path for r in plan.suspicious.collect()] == [".env"]
    store.save(plan, str(tmp_path / "store"))
    packs, lines = store.load(spark, str(tmp_path / "store"))
    row = store.find(packs, "p").first()
    assert row.total_files == 2
    text = document(plan)
    stored = [r.text for r in lines.orderBy("line_no").collect()]
    assert stored == text.split("\n") and row.line_count == len(stored)
    page = store.read_page(packs, lines, 3, 2).orderBy("line_no").collect()
    assert [r.text for r in page] == stored[2:4]
    assert store.page_headers(packs, 1, 200).first().header == f"[p] lines 1-{len(stored)} of {len(stored)} (end of pack)"
    assert "(continue with startLine: 3)" in store.page_headers(packs, 1, 2).first().header
    assert store.page_headers(packs, 999, 5).first().header == f"[p] lines 999-998 of {len(stored)} (end of pack)"
    found = store.grep(lines, 'RETURN "hello', ignore_case=True, context=1)
    shown = store.grep_text(found, 1).orderBy("match_no", F.col("line_no").asc_nulls_last()).collect()
    hit = stored.index('  return "hello " + name;') + 1
    assert [r.line for r in shown] == [
        f"{hit - 1}- export function greet(name: string) {{", f'{hit}:   return "hello " + name;', f"{hit + 1}- }}", "--",
    ]
    assert store.grep_headers(packs, found, "x").first().header == "1 match(es) for /x/ in [p]:"
    assert store.grep(lines, "no such text").count() == 0
    assert store.grep(lines, ".", limit=None).count() == lines.filter("text <> ''").count()
    for bad in (lambda: store.read_page(packs, lines, 1, 2001), lambda: store.page_headers(packs, 0), lambda: store.grep(lines, "x", context=11)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError, match="Invalid regular expression"):
        store.grep(lines, "([unclosed")
    with pytest.raises(KeyError, match="unknown pack"):
        store.find(packs, "nope")
    summary = store.summary(plan, packs.select("pack_id", "line_count")).first()
    assert summary.suspicious == 1 and summary.suspicious_names == ".env"
    assert [t.split("\t")[1] for t in summary.top_files] == ["package.json", "src/index.ts"]


def test_written_text_is_in_document_order(corpus, spark, tmp_path):
    plan = pack.pack(corpus({f"f{i:02}.txt": f"text {i}" for i in range(30)}), PackSpec())
    out = tmp_path / "text"
    render.write_text(plan, str(out))
    parts = sorted((out / "pack_id=p").glob("part-*"))
    assert "".join(p.read_text() for p in parts).rstrip("\n") == document(plan).rstrip("\n")


def test_directory_source(spark, tmp_path):
    root = tmp_path / "repo"
    for name, body in {"a/b.ts": b"x", ".hidden/c": b"\x00\x01", "big.txt": b"y" * 100, "_u.py": b"z", "a/\xc3\xa9.md".encode("latin1").decode("utf8"): b"q"}.items():
        target = root / name
        os.makedirs(target.parent, exist_ok=True)
        target.write_bytes(body)
    listed = {r.path: r for r in sources.from_directory(spark, str(root), "p", 50).collect()}
    assert {"a/b.ts", "big.txt"} <= set(listed) and listed["big.txt"].raw is None and listed["big.txt"].size_bytes == 100
    names = [str(p.relative_to(root)) for p in root.rglob("*") if p.is_file()]
    listing = spark.createDataFrame([("p", n) for n in names], "pack_id string, path string")
    read = sources.from_path_list(listing, str(root), 50)
    plan = pack.pack(read, PackSpec(max_file_kb=1))
    got = {r.path: (r.is_binary, r.has_content) for r in plan.stats.collect()}
    assert got["_u.py"] == (False, True) and got[".hidden/c"] == (True, False) and len(got) == 5
    # files above the read limit of the source come without bytes and count as oversized only by their size
    assert "big.txt" in got


def test_size_filter_reaches_the_scan(spark, tmp_path):
    (tmp_path / "x.txt").write_text("x")
    plan = sources.from_directory(spark, str(tmp_path), "p", 10)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,10)" in plan


def test_path_list(spark, tmp_path):
    lines, nul, none = tmp_path / "l", tmp_path / "n", tmp_path / "e"
    lines.write_text(" a.ts\n\nb.ts \n")
    nul.write_bytes(b"a.ts\0b c.ts\0")
    none.write_text("\n \n")
    assert {r.entry for r in sources.path_list(spark, str(lines)).collect()} == {"a.ts", "b.ts"}
    assert {r.entry for r in sources.path_list(spark, str(nul), nul_separated=True).collect()} == {"a.ts", "b c.ts"}
    with pytest.raises(ValueError, match="no paths"):
        sources.path_list(spark, str(none))


def test_bpe_mode_counts_redacted_text(corpus, spark):
    ranks = spark.createDataFrame([(bytearray([b]), b) for b in range(256)], "token binary, rank int")
    files = corpus({"a.txt": "abc", "k.txt": "sk-abcdefghijklmnop123456"})
    plan = pack.pack(files, PackSpec(token_mode="bpe"), ranks=ranks)
    assert {r.path: r.tokens for r in plan.stats.collect()} == {"a.txt": 3, "k.txt": len("[REDACTED_SECRET]")}


@pytest.mark.parametrize(
    "options", [{"sort": "x"}, {"format": "pdf"}, {"persona": "poet"}, {"recipe": "cake"}, {"max_tokens": 0}, {"token_mode": "x"}]
)
def test_bad_options(options):
    with pytest.raises(ValueError):
        PackSpec(**options)


def test_missing_scan_path_is_an_error(corpus):
    files = corpus({"a/b.ts": "1", "c.ts": "2"})
    with pytest.raises(ValueError, match='Path "nope" does not exist'):
        pack.pack(files, PackSpec(scan_paths=["a", "nope"]))
    assert [r.path for r in pack.pack(files, PackSpec(scan_paths=["a"])).stats.collect()] == ["a/b.ts"]


def test_json_document_carries_history(corpus, spark):
    files = corpus({"a.ts": "1"})
    packs = files.select("pack_id").distinct()
    commits = packs.select(
        "pack_id", F.lit("abcdef0123").alias("hash"), F.lit("2024-05-06").cast("timestamp").alias("ts"), F.lit("fix").alias("subject")
    )
    plan = pack.pack(files, PackSpec(format="json", log_commits=3), commits=commits, diffs=packs.withColumn("diff", F.lit("+x")))
    parsed = json.loads(render.json_documents(plan).first().document)
    assert (parsed["gitDiff"], parsed["gitLog"], parsed["task"]) == ("+x", "abcdef0 2024-05-06 fix", None)


def test_missing_history_is_an_error(corpus):
    with pytest.raises(ValueError, match="changed"):
        pack.pack(corpus({"a": "1"}), PackSpec(changed_only=True))


def test_facts_of_a_stream_equal_the_batch(corpus, spark, tmp_path):
    from packlake.streaming.rows import append_facts

    files = corpus({"a.py": "# c\nx = 1\n", "b.txt": 'token = "0123456789abcdef"', "c.txt": ""})
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    files.write.parquet(source)
    stream = spark.readStream.schema(files.schema).parquet(source)
    spec = PackSpec(remove_comments=True)
    append_facts(stream, spec, out, str(tmp_path / "cp")).awaitTermination(60)
    stored = {tuple(r) for r in spark.read.parquet(out).select("path", "tokens", "redactions").collect()}
    assert stored == {tuple(r) for r in pack.facts(files, spec).select("path", "tokens", "redactions").collect()}
    assert len(stored) == 3


@pytest.mark.parametrize(
    "root, file",
    [
        ("s3a://bucket/code", "s3a://bucket/code/src/a.ts"), ("hdfs://nn:8020/code/", "hdfs://nn:8020/code/src/a.ts"), ("/code", "file:/code/src/a.ts"),
        ("file:///code", "file:///code/src/a.ts"), ("file:/a b/c+d", "file:/a b/c+d/src/a.ts"), ("s3a://bucket/", "s3a://bucket/src/a.ts"),
    ],
)
def test_paths_below_any_root(evaluate, root, file):
    assert evaluate(lambda f: sources.relative_path(f, root), file) == "src/a.ts"


def test_nested_json_is_read_back_from_volumes_of_any_size(corpus):
    names = ['a "b".md', "dir/c\\d.txt", "dir/├── e.md", "z.md"]
    files = corpus({("p", n): f'{n}\n"x": {{\n    {{\n    }}\n\\ é' for n in names} | {("q", "one.md"): ""})
    plan = pack.pack(files, PackSpec(format="json", collation="UTF8_BINARY", task='Say "hi".\n  ],\n'))
    whole = {r.pack_id: json.loads(r.document) for r in render.json_documents(plan).collect()}
    for size in (1, 150, 10_000):
        found = render.json_rows(render.json_documents(plan, size)).collect()
        for name, doc in whole.items():
            own = [(r.kind, r.value) for r in found if r.pack_id == name]
            assert [json.loads(v) for k, v in own if k == "metadata"] == [doc["metadata"]]
            assert sorted(v for k, v in own if k == "tree") == sorted(doc["tree"].split("\n"))
            files = [json.loads(v) for k, v in own if k == "file"]
            assert sorted(files, key=lambda f: f["path"]) == sorted(doc["files"], key=lambda f: f["path"])
            assert [json.loads(v)["task"] for k, v in own if k == "closing"] == [doc["task"]]
