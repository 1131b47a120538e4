"""Ignore rules, scan paths, flags and history on literal corpora."""

import random

import pytest
from pyspark.sql import functions as F

from packlake.operators import history, ignore, scan
from packlake.plans import pack
from packlake.spec import PackSpec


def kept(files, **options):
    selected = scan.select_files(files, PackSpec(**options))
    return {r.path for r in scan.kept(selected).select("path").collect()}


def test_root_rule_file(corpus):
    files = corpus({".gitignore": "secret.txt\n", "secret.txt": "x", "keep.txt": "x"})
    assert kept(files) == {".gitignore", "keep.txt"}


def test_nested_rule_file_covers_only_its_directory(corpus):
    files = corpus({"pkg/.gitignore": "generated.ts", "pkg/generated.ts": "", "pkg/source.ts": "", "generated.ts": ""})
    assert kept(files) == {"pkg/.gitignore", "pkg/source.ts", "generated.ts"}


def test_own_rule_file(corpus):
    assert "notes.txt" not in kept(corpus({".packlakeignore": "notes.txt", "notes.txt": "", "a.ts": ""}))
    assert "notes.txt" not in kept(corpus({".llmignore": "notes.txt", "notes.txt": "", "a.ts": ""}))


def test_negation(corpus):
    files = corpus({".gitignore": "*.log\n!important.log", "debug.log": "", "important.log": ""})
    assert kept(files) == {".gitignore", "important.log"}


def test_nested_negation_rescues(corpus):
    files = corpus(
        {".gitignore": "*.snap", "pkg/.gitignore": "!golden.snap", "pkg/golden.snap": "", "pkg/other.snap": "", "root.snap": ""}
    )
    assert kept(files) == {".gitignore", "pkg/.gitignore", "pkg/golden.snap"}


def test_deeper_level_wins(corpus):
    files = corpus(
        {"a/.gitignore": "*.tmp", "a/b/.gitignore": "!keep.tmp", "a/b/keep.tmp": "", "a/b/no.tmp": "", "a/keep.tmp": ""}
    )
    assert kept(files) == {"a/.gitignore", "a/b/.gitignore", "a/b/keep.tmp"}


def test_nested_rescue_of_a_user_exclude(corpus):
    files = corpus({"p/.gitignore": "!x.md", "p/x.md": "", "x.md": ""})
    assert kept(files, excludes=["*.md"]) == {"p/.gitignore", "p/x.md"}


def test_default_excludes(corpus):
    files = corpus({"package-lock.json": "", "node_modules/dep/index.js": "", "index.js": "", "a/node_modules/x.js": ""})
    assert kept(files) == {"index.js", "a/node_modules/x.js"}


def test_includes_beat_all_but_credentials(corpus):
    files = corpus({"dist/types.d.ts": "", "dist/app.js": "", "dist/.env": "", "a.ts": ""})
    assert kept(files, includes=["dist/*.ts", "dist/.env"]) == {"dist/types.d.ts", "a.ts"}


def test_packs_do_not_share_rules(corpus):
    files = corpus({("p", ".gitignore"): "a.txt", ("p", "a.txt"): "", ("q", "a.txt"): ""})
    selected = scan.kept(scan.select_files(files, PackSpec()))
    assert {(r.pack_id, r.path) for r in selected.collect()} == {("p", ".gitignore"), ("q", "a.txt")}


def test_lite_mode_keeps_the_manifest(corpus):
    files = corpus({"a.css": "", "data.json": "", "package.json": "{}", "x/package.json": "{}", "a.ts": ""})
    assert kept(files, lite=True) == {"package.json", "x/package.json", "a.ts"}


@pytest.mark.parametrize(
    "pattern, path, hit",
    [
        ("foo", "a/foo", True), ("foo", "a/foo/b", True), ("/foo", "a/foo", False), ("foo/", "foo", False),
        ("foo/", "foo/x", True), ("a/**/z", "a/z", True), ("a/**/z", "a/b/c/z", True), ("**/z", "z", True),
        ("a/**", "a/b/c", True), ("a/*", "a/b", True), ("*.t?t", "x.txt", True), ("[a-c].md", "b.md", True),
        ("[!a-c].md", "b.md", False), (r"\#x", "#x", True), ("# x", "# x", False), ("a/b", "x/a/b", False),
        ("x.y", "xzy", False), ("(1)+", "(1)+", True), ("*", ".hidden", True), ("a b", "a b", True),
    ],
)
def test_rule_dialect(evaluate, pattern, path, hit):
    assert evaluate(lambda p: ignore.ignored_by_rules(p, [pattern]), path) is hit


def test_rules_below_an_ignored_directory_stay_ignored(evaluate):
    assert evaluate(lambda p: ignore.ignored_by_rules(p, ["d/", "!d/keep"]), "d/keep") is True
    assert evaluate(lambda p: ignore.ignored_by_rules(p, ["d/*", "!d/keep"]), "d/keep") is False


@pytest.mark.parametrize(
    "pattern, path, hit",
    [
        ("*.md", "README.MD", True), ("SRC/", "src/x", True), ("[z-a].md", "b.md", False), ("[!z-a].md", "b.md", True), ("[^].md", "^.md", True),
        ("[a-].md", "-.md", True), (r"[\d].md", "d.md", True), (r"[\d].md", "1.md", False), ("[&&].md", "&.md", True), ("a\\", "a\\", True),
        ("*a*a*b", "xaxab", True), ("*a*a*b", "xab", False), ("a*?c", "abc", True), ("[+-9]x", "/x", False), ("*.tar.*z", "a.tar.b.tar.gz", True),
    ],
)
def test_rules_are_untrusted_text(evaluate, pattern, path, hit):
    assert evaluate(lambda p: ignore.ignored_by_rules(p, [pattern]), path) is hit


def test_any_rule_line_is_a_valid_pattern(spark, corpus):
    rng = random.Random(1)
    lines = ["".join(rng.choice("ab*?[]!^-\\{},/.()+$&|# \t~é") for _ in range(rng.randint(1, 12))) for _ in range(400)]
    lines.append("*a" * 40 + "b")
    files = corpus({".gitignore": "\n".join(lines), "a" * 200: "x", "b/c.md": "y", "keep": "z"})
    sets = ignore.rule_sets(ignore.rule_lines(files))
    assert ignore.ignored_paths(files, sets).count() >= 0
    packed = pack.pack(corpus({("p", ".gitignore"): "[z-a].md\n*.log", ("p", "b.md"): "x", ("q", "A.LOG"): "y", ("p", "A.LOG"): "y"}), PackSpec())
    assert {(r.pack_id, r.path) for r in packed.stats.collect()} == {("p", ".gitignore"), ("p", "b.md"), ("q", "A.LOG")}


def test_excluded_files_are_neither_counted_nor_read(corpus):
    files = corpus({f"node_modules/m{i}/x.js": "one two three" for i in range(20)})
    plan = pack.pack(files, PackSpec())
    assert plan.selection.count() == plan.stats.count() == plan.files.count() == 0
    reached = files.filter(scan.reachable(PackSpec()))
    logical = pack.facts(reached, PackSpec())._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in logical and logical.index("regexp") < logical.index("Filter")  # the path test stands below the counting


@pytest.mark.parametrize(
    "glob, path, hit",
    [
        ("**/*.test.ts", "a.test.ts", True), ("**/*.test.ts", "x/y/a.test.ts", True), ("*.ts", "x/a.ts", False),
        ("a/{b,c}/*.md", "a/c/x.md", True), ("a/{b,c}/*.md", "a/d/x.md", False), ("dist/**", "dist/a/b", True),
        ("dist/**", "dist", False), ("a?c", "abc", True), ("./a.ts", "a.ts", True),
    ],
)
def test_glob_dialect(evaluate, glob, path, hit):
    assert evaluate(lambda p: ignore.matches_any(p, [glob]), path) is hit


def test_scan_paths(corpus):
    files = corpus({"a/one.ts": "", "b/two.ts": "", "c.ts": "", "ab/x.ts": ""})
    assert kept(files, scan_paths=["a", "./c.ts"]) == {"a/one.ts", "c.ts"}
    with pytest.raises(ValueError, match="outside the project root"):
        scan.clean_scan_paths(["a/../../b"])


def test_missing_scan_paths(corpus, spark):
    files = corpus({"a/one.ts": ""})
    wanted = spark.createDataFrame([("p", "a"), ("p", "nope"), ("p", "")], "pack_id string, entry string")
    assert [r.entry for r in scan.missing_scan_paths(files, wanted).collect()] == ["nope"]


def test_oversized_and_binary_flags(corpus, spark):
    files = corpus({"big": "x" * 2048, "tiny": "tiny", "edge": "x" * 1024})
    flags = {r.path: (r.is_oversized, r.content) for r in scan.add_flags(files, 1024).collect()}
    assert flags == {"big": (True, None), "tiny": (False, "tiny"), "edge": (False, "x" * 1024)}
    raw = spark.createDataFrame(
        [("p", "nul", 3000, bytearray(b"a\x00" * 1500)), ("p", "bad", 2, bytearray(b"\xff\xfe")), ("p", "ok", 4, bytearray("é😀"[:2].encode()[:6]))],
        "pack_id string, path string, size_bytes bigint, raw binary",
    )
    flags = {r.path: (r.is_binary, r.is_oversized, r.content) for r in scan.add_flags(raw, 1024).collect()}
    assert flags == {"nul": (True, False, None), "bad": (True, False, None), "ok": (False, False, "é😀")}


def test_history(spark, corpus):
    touches = spark.createDataFrame(
        [(1, "2024-01-01 00:00:00", "p", "a.txt"), (1, "2024-01-01 00:00:00", "p", "b.txt"), (2, "2024-01-02 00:00:00", "p", "a.txt")],
        "commit_id bigint, ts string, pack_id string, path string",
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    assert {(r.path, r.churn) for r in history.churn(touches).collect()} == {("a.txt", 2), ("b.txt", 1)}
    assert {(r.path, r.churn) for r in history.churn(touches, 1).collect()} == {("a.txt", 1)}
    diff = spark.createDataFrame([("p", "b.txt"), ("p", " "), ("p", "gone.txt")], "pack_id string, path string")
    new = spark.createDataFrame([("p", "new.txt "), ("p", "b.txt")], "pack_id string, path string")
    changed = history.changed_set(diff, new)
    files = corpus({"a.txt": "", "b.txt": "", "new.txt": ""})
    assert {r.path for r in history.only_changed(files, changed).collect()} == {"b.txt", "new.txt"}


def test_snapshot_diff(corpus):
    old = corpus({"a": "1", "b": "2", "c": "3"})
    new = corpus({"b": "2", "c": "4", "d": "5"})
    got = {r.path: r.status for r in history.snapshot_diff(old, new).collect()}
    assert got == {"a": "deleted", "b": "same", "c": "modified", "d": "added"}


def test_files_below_ignored_directories_are_not_tested(corpus):
    """A closed directory decides for its files, unless a deeper rule file may rescue them."""
    files = corpus(
        {
            ".gitignore": "made/\n*.log\n",
            "made/a/b/x.py": "",
            "made/a/keep/.gitignore": "!y.py\n",
            "made/a/keep/y.py": "",
            "made/a/keep/z.py": "",
            "src/x.py": "",
            "src/sub/.gitignore": "gen/\n!z.log\n",
            "src/sub/gen/x.py": "",
            "src/sub/gen/z.log": "",
            "src/sub/z.log": "",
            ("other", "made/x.py"): "",
        }
    )
    sets = ignore.rule_sets(ignore.rule_lines(files))
    state = ignore.directories(files, sets)
    levels = {(r.path, r.base) for r in ignore.open_levels(files, state).collect()}
    assert ("made/a/b/x.py", None) in levels and ("src/sub/gen/x.py", None) in levels
    assert {b for p, b in levels if p == "made/a/keep/y.py"} == {"made/a/keep"}
    assert {b for p, b in levels if p == "src/sub/z.log"} == {"", "src/sub"}
    assert not any(p == "made/x.py" for p, _ in levels)
    found = {r.path for r in ignore.ignored_paths(files, sets).collect()}
    # rule files are files too: the one below build has no rule for itself, so its directory decides
    assert found == {"made/a/b/x.py", "made/a/keep/.gitignore", "made/a/keep/z.py", "src/sub/gen/x.py", "src/sub/gen/z.log"}


def test_tagged_regex_takes_the_last_match(spark):
    from pyspark.sql import functions as F

    lines = ["*.py", "!a.py", "A.PY", "# no", "!x/", "\x01IN", "[z-a]"]
    rules = [r for r in map(ignore.rule_body, lines) if r]
    regex = ignore.tagged(F.array(*[F.struct(F.lit(b).alias("body"), F.lit(n).alias("negated")) for b, n in rules]))
    for path, tag in {"a.py": "I", "b.py": "I", "x/": "N", "q/x/": "N", "x": "", "IN": "", "\x01IN": "I", "a.py\x01IN": ""}.items():
        assert spark.range(1).select(ignore._tag(F.lit(path), regex).alias("t")).first().t == tag, path
