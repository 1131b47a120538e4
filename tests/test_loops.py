"""Declarative operators against plain loops written from their description."""

import random

from pyspark.sql import functions as F

from packlake.functions import shape
from packlake.operators import bpe, budget, order
from packlake.operators.spread import running


def strip_c_loop(source: str) -> str:
    """Walk characters, remembering which quote is open."""
    out, i, quote = [], 0, None
    while i < len(source):
        ch, pair = source[i], source[i : i + 2]
        if quote:
            if ch == "\\":
                out.append(pair)
                i += 2
                continue
            if ch == quote or (ch == "\n" and quote != "`"):
                quote = None
            out.append(ch)
            i += 1
        elif pair == "//":
            while i < len(source) and source[i] != "\n":
                i += 1
        elif pair == "/*":
            stop = source.find("*/", i + 2)
            stop = len(source) if stop < 0 else stop + 2
            out.append("\n" * source[i:stop].count("\n"))
            i = stop
        else:
            quote = ch if ch in "\"'`" else None
            out.append(ch)
            i += 1
    now, was = "".join(out).split("\n"), source.split("\n")
    return "\n".join(n for n, w in zip(now, was) if n.strip() or not w.strip())


def test_c_comment_stripping_equals_the_loop(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab/*\\\"'`\n ") for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
    got = {r.i: r.v for r in df.select("i", shape.strip_c_comments(F.col("c")).alias("v")).collect()}
    bad = [(t, got[i], strip_c_loop(t)) for i, t in enumerate(texts) if got[i] != strip_c_loop(t)]
    assert not bad, bad[:3]


def test_elided_runs_equal_the_loop(spark):
    rng = random.Random(11)
    pool = ["import x", "def f():", "", "  ", "y = 1", "@d", "class A {"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(2000)]

    def loop(source):
        out, body = [], False
        for line in source.split("\n"):
            if not line.strip():
                continue
            if line.startswith(("import", "def", "@", "class")):
                if body:
                    out.append("    ...")
                body = False
                out.append(line[:-1] + "{ /* … */ }" if line.endswith("{") else line)
            else:
                body = True
        if body:
            out.append("    ...")
        return "\n".join(out) or None

    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
    got = {r.i: r.v for r in df.select("i", shape.signatures(F.lit("a.py"), F.col("c")).alias("v")).collect()}
    assert all(got[i] == loop(t) for i, t in enumerate(texts))


def budget_loop(rows, limit):
    """Heaviest first, stable; the manifest and files without text are skipped."""
    left, gone = sum(t for _, t, _ in rows), set()
    for path, tokens, has in sorted(rows, key=lambda r: -r[1]):
        if left <= limit:
            break
        if path != "package.json" and has:
            gone.add(path)
            left -= tokens
    return gone


def test_budget_equals_the_loop_with_many_ties(spark):
    rng = random.Random(3)
    packs, rows = {}, []
    for p in range(60):
        files = [("package.json", rng.randint(0, 9), True)]
        files += [(f"f{i:03}", rng.choice([0, 1, 1, 5, 5, 5, 40]), rng.random() < 0.9) for i in range(rng.randint(0, 30))]
        files = sorted((n, t if has else 0, has) for n, t, has in files)
        packs[f"p{p}"] = files
        rows += [(f"p{p}", *f) for f in files]
    df = spark.createDataFrame(rows, "pack_id string, path string, tokens bigint, has_content boolean")
    for limit in (1, 30, 60, 100_000):
        marked = budget.mark_omitted(df, limit, order.order_keys("path", "UTF8_BINARY")).collect()
        got = {}
        for r in marked:
            got.setdefault(r.pack_id, set())
            if r.is_omitted:
                got[r.pack_id].add(r.path)
        assert len(marked) == len(rows)
        assert got == {p: budget_loop(files, limit) for p, files in packs.items()}


def test_budget_ties_follow_the_output_order(spark):
    rows = [("p", n, 10, size, True) for n, size in (("a", 3), ("b", 2), ("c", 1))]
    df = spark.createDataFrame(rows, "pack_id string, path string, tokens bigint, size_bytes bigint, has_content boolean")
    marked = budget.mark_omitted(df, 10, order.order_keys("size"))
    assert {r.path for r in marked.collect() if r.is_omitted} == {"c", "b"}


def test_running_sums_split_a_hot_group(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.8 else f"g{rng.randint(0, 5)}", i, rng.randint(1, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(5)
    got = {
        (r.g, r.k): (r.nth, r.before)
        for r in running(df, ["g"], [F.col("k").desc()], {"before": "v"}, number="nth").collect()
    }
    seen = {}
    for g, k, v in sorted(rows, key=lambda r: (r[0], -r[1])):
        n, total = seen.get(g, (0, 0))
        assert got[(g, k)] == (n + 1, total)
        seen[g] = (n + 1, total + v)
    assert len(got) == len(rows)


def test_bpe_counts_equal_a_reference_encoder(spark):
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)}
    for word in (b"th", b"he", b"the", b" t", b" the", b"in", b"ing", b"aa", b"aaaa", b"\xc3\xa9", b"  ", b"qu", b"que"):
        ranks[word] = len(ranks)
    patterns = __import__("tiktoken_ext.openai_public", fromlist=["x"])
    rng = random.Random(2)
    texts = ["".join(rng.choice(["the", "THE", " ", "aaaa", "a", "é", "ing", "\n", "12345", "'s", "!?", "  ", "日本", " "]) for _ in range(30)) for _ in range(200)]
    texts += ["", "a" * 5000]
    import inspect
    import re

    source = inspect.getsource(patterns.cl100k_base)
    pattern = re.search(r'"pat_str": r"""(.*?)"""', source).group(1)
    encoder = tiktoken.Encoding("tiny", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rank_table = spark.createDataFrame([(bytearray(k), v) for k, v in ranks.items()], "token binary, rank int")
    files = spark.createDataFrame([("p", str(i), t) for i, t in enumerate(texts)], "pack_id string, path string, content string")
    got = {int(r.path): r.tokens for r in bpe.count_bpe(files, rank_table, "cl100k_base").collect()}
    assert got == {i: len(encoder.encode_ordinary(t)) for i, t in enumerate(texts)}
    newer = "|".join(re.findall(r'r"""(.*?)"""', inspect.getsource(patterns.o200k_base)))
    encoder = tiktoken.Encoding("tiny2", pat_str=newer, mergeable_ranks=ranks, special_tokens={})
    got = {int(r.path): r.tokens for r in bpe.count_bpe(files, rank_table, "o200k_base").collect()}
    assert got == {i: len(encoder.encode_ordinary(t)) for i, t in enumerate(texts)}


def test_long_lines_do_not_exhaust_the_stack(spark):
    """Every whole-text regex on 200 kB without a line break."""
    from packlake.functions import redact, tokens

    texts = [
        '"' + "x" * 200_000 + '"', "/*" + "y" * 200_000, "'" + "\\'" * 100_000, "<!--" + "-" * 200_000,
        "a" * 200_000, "  " + "public " * 30_000 + "f(" + "a, " * 30_000 + ") {", "\u0000" * 1000, "." * 200_000,
        "key" * 60_000 + ' = "' + "v" * 100_000 + '"', "-----BEGIN PRIVATE KEY-----" + "A" * 200_000,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    c = F.col("c")
    ext = ["a.ts", "a.py", "a.html", "a.css", "a.sql"]
    columns = [F.length(shape.strip_comments(F.lit(e), c)).alias(f"s{i}") for i, e in enumerate(ext)]
    columns += [F.length(shape.signatures(F.lit(e), c)).alias(f"g{i}") for i, e in enumerate(ext[:2])]
    columns += [F.length(redact.redacted(c)).alias("r"), tokens.pretoken(c).alias("t")]
    columns += [F.size(F.regexp_extract_all(c, F.lit(p), F.lit(0))).alias(n) for n, p in bpe.PATTERNS.items()]
    assert df.select(*columns).count() == len(texts)
    assert len(df.select(*columns).collect()) == len(texts)
