"""The directory source against a plain walk, and what becomes of its files in a pack."""

import os

import pytest

from packlake.operators import scan
from packlake.plans import pack
from packlake.sources import roots
from packlake.spec import PackSpec

FILES = {
    "one": {"a/b.ts": b"x", "a/.hidden/c": b"\x00\x01", ".gitignore": b"*.log\n", "z.log": b"gone", "_u.py": b"z = 1", "a/é.md": "é".encode() * 40, "node_modules/q/x.js": b"no", "a/node_modules/y.js": b"no", "nul.dat": b"\x00" * 300_000, "big.txt": b"y" * 300_000},
    "two": {"deep/" * 12 + "end.py": b"pass", "src/.gitignore": b"gen/\n", "src/gen/x.py": b"", "src/main.py": b"print(1)\n"},
    "three": {},
}


@pytest.fixture
def tree(tmp_path):
    found = {}
    for name, files in FILES.items():
        base = tmp_path / f"root of {name}"
        base.mkdir()
        for path, body in files.items():
            target = base / path
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(body)
        found[name] = str(base)
    os.symlink(found["one"], os.path.join(found["two"], "loop"))
    os.symlink(os.path.join(found["one"], "_u.py"), os.path.join(found["two"], "link.py"))
    return found


def walked(tree, limit):
    for name, base in tree.items():
        for folder, _, files in os.walk(base):
            for file in files:
                full = os.path.join(folder, file)
                path = os.path.relpath(full, base)
                if not os.path.islink(full) and not path.startswith("node_modules/"):
                    body = open(full, "rb").read()
                    yield name, path, len(body), body[:512], body if len(body) <= limit else None


@pytest.mark.parametrize("units", [4096, 4, 1])
def test_equals_a_walk(spark, tree, monkeypatch, units):
    monkeypatch.setattr(roots, "UNITS", units)
    read = roots.from_roots(spark, tree, PackSpec(max_file_kb=100))
    key = lambda r: r[:2]
    assert sorted(((r.pack_id, r.path, r.size_bytes, bytes(r["head"]), None if r.raw is None else bytes(r.raw)) for r in read.collect()), key=key) == sorted(walked(tree, 102_400), key=key)


def test_work_is_bounded_and_cut_small(tree):
    reader = roots.Reader({"roots": '[["two", "%s"]]' % tree["two"], "max_bytes": "10"})
    parts = reader.partitions()
    assert sum(len(p.pieces) for p in parts) == 15 and len(parts) == 15  # one piece per directory
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 4


def test_pack_of_directories(spark, tree):
    spec = PackSpec(max_file_kb=100)
    plan = pack.pack(roots.from_roots(spark, tree, spec), spec)
    stats = {(r.pack_id, r.path): (r.is_binary, r.is_oversized, r.has_content) for r in plan.stats.collect()}
    assert stats[("one", "nul.dat")] == (True, False, False) and stats[("one", "big.txt")] == (False, True, False)
    assert stats[("one", "a/.hidden/c")] == (True, False, False) and stats[("one", "a/é.md")] == (False, False, True)
    assert ("one", "z.log") not in stats and ("two", "src/gen/x.py") not in stats and ("two", "src/main.py") in stats
    assert {p for p, _ in stats} == {"one", "two"}


def test_forced_paths_are_listed(spark, tree):
    spec = PackSpec(includes=["node_modules/q/*.js"])
    kept = scan.kept(scan.select_files(scan.add_flags(roots.from_roots(spark, tree, spec)), spec))
    assert ("one", "node_modules/q/x.js") in {(r.pack_id, r.path) for r in kept.select("pack_id", "path").collect()}


def test_prune_needs_whole_subtrees(tree):
    with pytest.raises(ValueError):
        roots.Reader({"roots": "[]", "max_bytes": "1", "prune": '["*.map"]'})
