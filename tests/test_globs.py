"""Extended globs: a table of the dialect, and random ones against a backtracking matcher."""

import random
import re
import time

import pytest

from packlake.operators import globs, ignore, scan
from packlake.spec import PackSpec


@pytest.mark.parametrize(
    "glob, yes, no",
    [
        ("src/@(a|b).ts", ["src/a.ts", "src/b.ts"], ["src/.ts", "src/ab.ts", "src/@(a|b).ts"]),
        ("src/?(a|b).ts", ["src/a.ts", "src/.ts"], ["src/ab.ts", "src/c.ts"]),
        ("src/*(a|b).ts", ["src/.ts", "src/abba.ts"], ["src/abc.ts", "src/a/b.ts"]),
        ("src/+(a|b).ts", ["src/a.ts", "src/abba.ts"], ["src/.ts"]),
        ("src/!(a|b).ts", ["src/c.ts", "src/ab.ts", "src/.ts"], ["src/a.ts", "src/b.ts", "src/x/c.ts"]),
        ("**/!(*.test).ts", ["a.ts", "x/y/b.ts"], ["a.test.ts", "x/b.test.ts"]),
        ("**/@(lib|src)/**", ["lib/a", "x/src/b/c"], ["libs/a", "x/src"]),
        ("@(a|b/@(c|d)).x", ["a.x", "b/c.x", "b/d.x"], ["b/a.x", "b.x"]),
        ("+([0-9]).md", ["1.md", "2026.md"], [".md", "1a.md"]),
        ("{a,{b,c}d}@(1|2)", ["a1", "bd2", "cd1"], ["b1", "d2"]),
        ("x{1..3}.@(md)", ["x1.md", "x3.md"], ["x4.md", "x.md"]),
        ("@(a|b", ["@(a|b"], ["a"]),
        (r"\@(a)", ["@(a)"], ["a"]),
        ("log{01..10..3}.txt", ["log01.txt", "log04.txt", "log10.txt"], ["log1.txt", "log02.txt"]),
        ("{c..a}/x", ["a/x", "b/x", "c/x"], ["d/x"]),
        ("{a..3}", ["{a..3}"], ["a"]),
        ("{1..1}.c", ["1.c"], ["{1..1}.c"]),
        ("**/{a,b{1..2}}.py", ["a.py", "z/b1.py", "b2.py"], ["b3.py", "b.py"]),
    ],
)
def test_dialect(spark, glob, yes, no):
    rows = spark.createDataFrame([(p,) for p in [*yes, *no, None]], "path string")
    found = {r.path for r in rows.filter(ignore.matches_any(rows.path, [glob])).collect()}
    assert found == set(yes)


def backtrack(nodes, path, at, done):
    """Try everything, one choice after the other."""
    if not nodes:
        return done(at)
    node, rest = nodes[0], nodes[1:]
    on = lambda j: backtrack(rest, path, j, done)
    stop = re.compile(r"[^/]*").match(path, at).end()
    if node[0] == "star":
        return any(on(j) for j in range(at + node[1], stop + 1))
    if node[0] != "group":
        return at < len(path) and globs._fits(node, path[at]) and on(at + 1)
    _, mark, options = node
    if mark == "!":
        whole = lambda j: any(backtrack(o, path, at, lambda e: e == j) for o in options)
        return any(not whole(j) and on(j) for j in range(at, stop + 1))
    once = [*rest] if mark in "@?" else [("group", "*", options), *rest]
    if mark in "?*" and on(at):
        return True
    for option in options:
        # a repeated group goes on only if it has consumed something, but may end the first time with nothing
        step = lambda e: backtrack(once if e > at else rest, path, e, done)
        if backtrack(option, path, at, step):
            return True
    return False


def random_glob(pick, depth=0):
    out = ""
    for _ in range(pick.randrange(1, 4)):
        if depth < 2 and pick.random() < 0.45:
            out += pick.choice("@?*+!") + "(" + "|".join(random_glob(pick, depth + 1) for _ in range(pick.randrange(1, 3))) + ")"
        else:
            out += pick.choice(["a", "b", "*", "?", "[ab]", "[!a]", "c", ""])
    return out


def test_random_globs_equal_a_backtracking_matcher():
    pick, tried = random.Random(17), 0
    while tried < 1500:
        nodes = globs.tree(random_glob(pick))
        if nodes is None:
            continue
        tried += 1
        for _ in range(6):
            path = "".join(pick.choice("abc/") if pick.random() < 0.1 else pick.choice("abc") for _ in range(pick.randrange(7)))
            assert globs.matches(nodes, path) == backtrack(nodes, path, 0, lambda e: e == len(path)), (nodes, path)


@pytest.mark.parametrize("glob", ["*(*(a|aa)|*(a*))b", "+(a*|*a|*(a))c", "!(*(a|aa)b)c", "*(+(a)+(a)|?(a)*)/z"])
def test_no_glob_is_catastrophic(glob):
    start = time.time()
    assert not globs.matches(globs.tree(glob), "a" * 250)
    assert time.time() - start < 3


def test_ranges_are_bounded():
    with pytest.raises(ValueError):
        globs.with_ranges_listed("{1..999999999}")


def test_includes_with_groups_bring_files_back(corpus):
    files = corpus({n: "x" for n in ("node_modules/a.ts", "node_modules/b.ts", "node_modules/c.ts", "src/m.ts")})
    kept = scan.kept(scan.select_files(files, PackSpec(includes=["node_modules/@(a|b).ts"])))
    assert {r.path for r in kept.collect()} == {"node_modules/a.ts", "node_modules/b.ts", "src/m.ts"}
