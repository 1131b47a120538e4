"""Line dedup, near duplicates, mixing, byte pairs, fingerprints and licenses against plain loops."""

from __future__ import annotations

import hashlib
import random
import re
import time
from itertools import combinations
from re import _constants, _parser

import public_tokenizers
import pytest
import tiktoken

from packlake.llm import bpe, licenses, linededup, mixing, neardup, winnow
from packlake.llm.queries import RANKS, tokenizer

VOCABULARY = [f"w{k}" for k in range(400)]


def text_of(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def odd_rows():
    """Null and empty texts and ids, ties, repeated rows, a long text."""
    rng = random.Random(3)
    long = "\n".join(text_of(rng, 60) for _ in range(400))
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "no id"), (None, None), (6, long), (7, long), (8, "Ünïcödé ©　日本 😀"), (9, "\n\n\n"),
    ]


def plain_lines(rows, least=50):
    """Deleted lines by trying every run."""
    order = sorted({(-(2**63) if d is None else d, t) for d, t in rows if t}, key=lambda r: (r[0], 0))
    seen, out = set(), {}
    for d, t in order:
        lines = t.split("\n")
        gone = [False] * len(lines)
        for s in range(len(lines)):
            own, words = [], 0
            for e in range(s, len(lines)):
                words += len(lines[e].encode().split())
                if words >= least:
                    run = tuple(lines[s : e + 1])
                    if run in seen:
                        gone[s : e + 1] = [True] * (e + 1 - s)
                    own.append(run)
            seen.update(own)
        out[d, t] = "\n".join(x for x, g in zip(lines, gone) if not g)
    return out


def test_line_dedup(documents):
    rng = random.Random(5)
    passages = [[text_of(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 6))] for _ in range(6)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(1, 5)):
            part = rng.choice(passages)
            cut = rng.randint(0, len(part) - 1)
            lines += part[cut:] if rng.random() < 0.6 else [text_of(rng, rng.randint(0, 20))]
        rows.append((d, "\n".join(lines)))
    got = {r.doc_id: r.text for r in linededup.deletions(documents(rows)).collect()}
    assert got == {d: plain_lines(rows)[d, t] if t else t for d, t in rows}


def test_line_dedup_stage_drops_common_short_lines(documents):
    """A short line that stands in many texts stays in the first only; rarer and very short ones stay, and op7 keeps them all."""
    rng = random.Random(6)
    common, pair, rare, little = "read more about this on our site today", ["all of this is free", "for you and yours"], "this line is not very common at all", "see also"
    rows = []
    for d in range(linededup.COMMON_TIMES + 5):
        own = [text_of(rng, 12), common, text_of(rng, 12), *pair, text_of(rng, 12), little, text_of(rng, 12)]
        rows.append((d, "\n".join(own + [rare] * (d < linededup.COMMON_TIMES - 1))))
    gone = {common, *pair}
    expected = {d: t if d == 0 else "\n".join(x for x in t.split("\n") if x not in gone) for d, t in rows}
    assert {r.doc_id: r.text for r in linededup.deduplicated(documents(rows)).collect()} == expected
    assert all(r.n_deleted == 0 for r in linededup.deletions(documents(rows)).collect())


def test_line_dedup_odd_rows(clashing):
    rng = random.Random(6)
    line = text_of(rng, 55)
    rows = [(1, None), (2, ""), (3, line), (4, f"a\n{line}\nb"), (5, line), (5, line), (None, "x"), (6, "\n".join([line] * 4))]
    out = linededup.deletions(clashing(rows)).collect()
    assert sorted((r.doc_id or 0, r.text or "", r.n_deleted) for r in out) == sorted(
        [(1, "", 0), (2, "", 0), (3, line, 0), (4, "a\nb", 1), (5, "", 1), (5, "", 1), (0, "x", 0), (6, "", 4)]
    )
    docs = clashing(rows)
    kept = linededup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.n_chars) for r in kept.collect() if r.text) == [(0, 1), (3, len(line)), (4, 3)]
    assert linededup.deletions(docs.filter("false")).count() == 0


def plain_sets(rows):
    out = {}
    for d, t in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub(r"[A-Z]+", lambda m: m[0].lower(), t or "")) if w]
        out[d] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    return out


def plain_components(sets):
    component = {d: d for d in sets}

    def find(x):
        while component[x] != x:
            x = component[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            component[y] = x
    return {d: find(d) for d in sets}


def test_near_duplicates(documents):
    rng = random.Random(7)
    rows, n = [], 0
    for _ in range(12):
        base = text_of(rng, rng.randint(1, 300)).split()
        for _ in range(rng.randint(1, 15)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(own) // 60, len(own) // 20])):
                own[rng.randrange(len(own))] = rng.choice(VOCABULARY)
            rows.append((n, " ".join(own).title() if rng.random() < 0.3 else "  ".join(own)))
            n += 1
    sets = plain_sets(rows)
    expected = plain_components(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(documents(rows)).collect()}
    assert got == {d: (len(sets[d]), expected[d], expected[d] == d) for d in sets}


def test_near_duplicates_of_a_crowd(documents, monkeypatch):
    """Hundreds of texts around one text, some alike and some not: the prefix join finds every link."""
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 5)
    rng = random.Random(8)
    base = text_of(rng, 200).split()
    rows = []
    for d in range(150):
        own = list(base)
        for _ in range(rng.choice([1, 3, 4, 6, 9])):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        rows.append((d, " ".join(own)))
    expected = plain_components(plain_sets(rows))
    assert len(set(expected.values())) > 5
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(documents(rows)).collect()} == expected


@pytest.mark.parametrize("small", [neardup.SMALL_BUCKET, 2])
def test_near_duplicate_stage_links_from_80(documents, monkeypatch, small):
    """Of pairs between 0.80 and 0.85 the stage keeps one text, op3 both; a crowd meets in the prefix join."""
    monkeypatch.setattr(neardup, "SMALL_BUCKET", small)
    rng = random.Random(12)
    shared, rows, lone = [f"s{k}" for k in range(60)], [], set()
    for d in range(0, 80, 2):
        # k changed words, far apart, change 5 k of 296 shingles: 0.84 for 5, 0.82 for 6, 0.78 for 7
        base, k = shared + [f"a{d}x{rng.randrange(10**6)}" for _ in range(240)], rng.choice([5, 6, 7])
        other = [f"b{d}" if 70 <= i and i % 20 == 10 and (i - 70) // 20 < k else w for i, w in enumerate(base)]
        rows += [(d, " ".join(base)), (d + 1, " ".join(other))]
        lone |= {d + 1} if k == 7 else set()
    sets = plain_sets(rows)
    alike = [len(sets[d] & sets[d + 1]) / len(sets[d] | sets[d + 1]) for d in range(0, 80, 2)]
    assert all(x < 0.85 for x in alike) and {d + 1 for d, x in zip(range(0, 80, 2), alike) if x < 0.8} == lone and 5 < len(lone) < 35
    docs = documents(rows)
    assert sorted(r.doc_id for r in neardup.kept_documents(docs).collect()) == sorted({d for d, _ in rows if d % 2 == 0} | lone)
    assert neardup.near_duplicates(docs).filter("kept").count() == len(rows)


def test_near_duplicates_odd_rows(clashing):
    docs = clashing(odd_rows())
    got = sorted(((r.doc_id or 0), r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect() if r.doc_id != 6 and r.doc_id != 7)
    assert got == [
        (0, None, None, True), (0, None, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False), (8, 1, 8, True), (9, 0, 9, True),
    ]
    kept = neardup.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 6, 8, 9]
    assert neardup.near_duplicates(docs.filter("false")).count() == 0
    again = clashing([(1, "a b"), (1, "a b"), (2, ""), (2, ""), (3, "c d"), (4, "c d"), (None, "a b")])
    assert sorted(r.doc_id or 0 for r in neardup.kept_documents(again).collect()) == [0, 1, 2, 2, 3]


def plain_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mixing(documents):
    rng = random.Random(9)
    rows = [(d, text_of(rng, rng.randint(0, 40)), rng.choice(["a", "b", "é", "Z", None, "tiny"] + ["big"] * 6)) for d in range(300)] + [(1000, "only one", "few")]
    out = mixing.mix(documents(rows)).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    targets = plain_targets(sizes)
    taken = {}
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - targets[s]) <= 0.5 for s in targets)
    again = mixing.mix(documents(rows[::-1])).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)


def test_mixing_odd_rows(clashing):
    docs = clashing([r + ("s" if k % 2 else None,) for k, r in enumerate(odd_rows())])
    out = mixing.mix(docs).collect()
    assert len(out) == len(odd_rows()) and all(r.taken == 0 for r in out if not r.size)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert mixing.mix(docs.filter("false")).count() == 0
    assert mixing.mixed_documents(docs.filter("false")).count() == 0


@pytest.fixture(scope="module")
def tokens():
    raw, pattern = tokenizer(RANKS)
    ranks = bpe.parse_ranks(raw)
    return raw, pattern, ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_pairs_tree(tokens):
    _, pattern, ranks, own = tokens
    tree = bpe.Tree(ranks, pattern, leaf=8)
    rng = random.Random(10)
    parts = ["a", "th", "ing", " ", "  ", "\n", "'s", "'ll", "1", "22", "é", "!", "***", "　", " ", "\x1c", "\x85", "日本", "😀", "\t", "ſ"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 90)))
        ids = tree.encode(text)
        assert ids == own.encode_ordinary(text)
        assert tree.decode(ids) == text.encode()
    for text in ["a" * 5000, "ththing" * 1500, " " * 5000, "x" + " " * 4000 + "y", "日本" * 1500]:
        assert tree.encode(text) == own.encode_ordinary(text)


def test_byte_pairs_no_pair_of_the_tree_is_skipped(tokens):
    """The proof of the joins rests on tokens that are the encoding of their own bytes."""
    _, _, ranks, own = tokens
    assert all(own._encode_single_piece(token) == [rank] for token, rank in ranks.items())


def test_byte_pairs_rows(tokens, clashing, spark):
    raw, pattern, _, own = tokens
    docs = clashing(odd_rows())
    out = bpe.round_trip(docs, raw, pattern).collect()

    def expected(d, t):
        ids = own.encode_ordinary(t or "")
        return (d or 0, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())

    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == sorted(expected(d, t) for d, t in odd_rows())
    assert bpe.round_trip(docs.filter("false"), raw, pattern).count() == 0
    coded = docs.select("text", bpe.encode(docs.text, spark, raw, pattern).alias("ids"))
    assert all((r.text or "").encode() == bytes(r.back) for r in coded.select("text", bpe.decode(coded.ids, spark, raw, pattern).alias("back")).collect())


def plain_fingerprint(text):
    tokens = re.findall(r"[^\x20\x09-\x0D]{1,8}", text)
    h = [int(hashlib.md5(t.encode()).hexdigest()[:7], 16) for t in tokens]

    def fold(values):
        out = 0
        for v in values:
            out = (out * winnow.BASE + v) % winnow.PRIME
        return out

    grams = [fold(h[k : k + winnow.GRAM]) for k in range(max(len(h) - winnow.GRAM + 1, 1 if h else 0))]
    out = []
    for k in range(max(len(grams) - winnow.WINDOW + 1, 1 if grams else 0)):
        window = grams[k : k + winnow.WINDOW]
        at = max(k + i for i, g in enumerate(window) if g == min(window))
        if at not in [p for p, _ in out]:
            out.append((at, grams[at]))
    return out


def plain_edits(rows):
    own = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    for k, (d, t) in enumerate(own):
        t, n = t or "", own[(k + 1) % len(own)][1] or ""
        tail = len(t) // 2
        yield d, t, t[: len(t) - tail] + n[:tail], n


def alike(a, b):
    a, b = ({h for _, h in x} for x in (a, b))
    return 1.0 if not a | b else len(a & b) / len(a | b)


def crowded_rows():
    """A third of the rows without an id, a third under one id, the rest around 2**62."""
    rng = random.Random(12)
    return [(rng.choice([None, 7, 2**62 + rng.randrange(40)]), text_of(rng, rng.randint(1, 12))) for _ in range(900)]


def test_crowded_ids_are_cut_into_blocks(documents, monkeypatch):
    monkeypatch.setattr(winnow, "BLOCK", 20)
    ids = documents(crowded_rows()).selectExpr("doc_id", "md5(cast(text AS binary)) AS tie")
    place, _ = winnow._blocks(ids)
    sizes = {(r.seg, r.sub): r["count"] for r in place(ids).groupBy("seg", "sub").count().collect()}
    assert max(sizes.values()) <= 3 * winnow.BLOCK and sum(sizes.values()) == 900
    order = sorted((r.doc_id is not None, r.doc_id or 0, r.tie, r.seg, r.sub) for r in place(ids).collect())
    assert [o[3:] for o in order] == sorted(o[3:] for o in order)


@pytest.mark.parametrize("which", ["odd", "sparse", "single", "crowded"])
def test_fingerprints(documents, which, monkeypatch):
    rng = random.Random(11)
    if which == "crowded":
        monkeypatch.setattr(winnow, "BLOCK", 20)
    sparse = [(rng.choice([d, d * 1000, -d, 2**62 + d]), rng.choice(["", "ab" * 40, text_of(rng, rng.randint(1, 60)), "same same same same same same same same same same same same"])) for d in range(120)]
    rows = {"odd": odd_rows(), "sparse": sparse, "single": [(5, "just one text here")], "crowded": crowded_rows()}[which]
    out = winnow.fingerprints(documents(rows)).collect()
    write = lambda f: ",".join(f"{p}:{h:x}" for p, h in f)
    expected = []
    for d, t, e, n in plain_edits(rows):
        f, g, h = map(plain_fingerprint, (t, e, n))
        expected.append((d or 0, len(t), hashlib.sha256(e.encode()).hexdigest(), write(f), write(g), round(alike(f, g), 9), round(alike(f, h), 9)))
    got = [(r.doc_id or 0, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in out]
    assert sorted(got) == sorted(expected)


def test_fingerprints_of_nothing(clashing):
    assert winnow.fingerprints(clashing(odd_rows()).filter("false")).count() == 0
    assert winnow.fingerprints(clashing(odd_rows())).count() == len(odd_rows())


def test_fingerprints_guarantee():
    """A run of GRAM + WINDOW - 1 shared tokens is always found."""
    rng = random.Random(12)
    for _ in range(200):
        shared = text_of(rng, winnow.GRAM + winnow.WINDOW - 1)
        a, b = (f"{text_of(rng, rng.randint(0, 30))} {shared} {text_of(rng, rng.randint(0, 30))}" for _ in range(2))
        assert alike(plain_fingerprint(a), plain_fingerprint(b)) > 0


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    base = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    normal = f" {' '.join(words)} "
    found = []
    for r in licenses.rules():
        for m in re.finditer(r["regex"], normal):
            start = len(normal[: m.start()].split())
            found.append((start, start + len(m[0].split()), r["priority"], r["score"], r["label"]))

    def beaten(h):
        return any(
            g[0] <= h[0] and g[1] >= h[1] and g[1] - g[0] > h[1] - h[0]
            or (g[0] < h[1] and h[0] < g[1] and not (h[0] <= g[0] and h[1] >= g[1] and h[1] - h[0] > g[1] - g[0]) and g[2] < h[2])
            for g in found
        )

    kept = [h for h in found if not beaten(h)]
    starts = [k for k, _ in base]
    labels = sorted({x for _, x in base})
    score = max([h[3] for h in kept] + [0.9] * bool(base), default=0.0)
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(labels), ",".join(sorted({h[4] for h in kept} | set(labels))), score)


def test_licenses(clashing):
    texts = [
        "Released under the MIT License. Released under the MIT License.",
        "Licensed under the Apache License, Version 2.0; see under THE mit-license",
        "This work is licensed under the GNU General Public License, version 3.",
        "cc by\nnc cc-by-nc-sa 4.0 license, CC BY 4.0 License", "SPDX-License-Identifier: BSD-3-Clause", "All rights reserved. Copyright (c) 2020 someone",
        "mit ohne lizenz", "under the mit", "ünder the mit license éunder the mit license", "the mozilla public license 2.0 and the lgpl license", "public domain? released into the public domain",
    ]
    rng = random.Random(13)
    pool = " ".join(texts).split()
    texts += [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    rows = list(enumerate(texts, 100)) + odd_rows()
    got = sorted((r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in licenses.scan(clashing(rows)).collect())
    assert [str(x) for x in got] == [str(x) for x in sorted((d or 0, *plain_scan(t)) for d, t in rows)]
    assert licenses.scan(clashing(rows).filter("false")).count() == 0
    assert len(licenses.rules()) > 300


def spellings(regex):
    """Every text that a rule's regex stands for."""

    def of(parsed):
        out = [""]
        for op, arg in parsed:
            if op is _constants.LITERAL:
                more = [chr(arg)]
            elif op is _constants.IN:
                more = [chr(c) for kind, x in arg for c in ([x] if kind is _constants.LITERAL else range(x[0], x[1] + 1))]
            elif op is _constants.MAX_REPEAT:
                more = [y for n in range(arg[0], arg[1] + 1) for y in ([""] if not n else of(list(arg[2]) * n))]
            elif op is _constants.BRANCH:
                more = [y for branch in arg[1] for y in of(branch)]
            elif op is _constants.SUBPATTERN:
                more = of(arg[3])
            else:
                assert op in (_constants.ASSERT, _constants.ASSERT_NOT)
                continue
            out = [a + b for a in out for b in more]
        return out

    return of(_parser.parse(regex))


def test_licenses_each_rule_alone(documents):
    """Nothing that a rule matches is kept from it: neither by the gate nor by its keyword."""
    texts = ["Licensed under AGPLv3", "FreeBSD license", "Licensed under GPL2", "mpl2 license", "Released\nunder Apache 2.0", "Distributed under the BSD 3-Clause", "Proprietary and confidential"]
    gate = re.compile(licenses.GATE)
    for rule in licenses.rules():
        every = sorted({" ".join(x.split()) for x in spellings(rule["regex"]) if re.search(rule["regex"], f" {x} ")}, key=lambda x: (len(x), x))
        assert every
        for text in every:
            assert gate.search(text.upper().replace(" ", "-\n")), text
            assert f" {rule['keyword']}" in f" {text}", (rule, text)
        texts += [every[0], every[-1].title(), every[len(every) // 2].upper()]
    for phrase in licenses.BASE:
        assert gate.search(phrase.replace(" ", " - "))
    rows = list(enumerate(texts))
    got = sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in licenses.scan(documents(rows)).collect())
    assert [str(x) for x in got] == [str((d, *plain_scan(t))) for d, t in rows]
    assert all(r[-2] and r[-1] > 0 for r in got)


def test_licenses_many_in_one_text(documents):
    """More detections than fit a block, overlapping over its borders, and at most five times the time for four times as many."""
    pick = random.Random(5)
    phrases = ["licensed under the apache license version 2.0", "under the mit license", "cc by nc sa 4.0 license", "gnu general public license", "x", "all rights reserved", "spdx license identifier mpl 2.0"]
    text = " ".join(pick.choice(phrases) for _ in range(700))
    rows = [(1, text, "s"), (2, "mit license " * 129, "s"), (3, "mit license " * 128, "s")]
    got = sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in licenses.scan(documents(rows)).collect())
    assert got == sorted((k, *plain_scan(t)) for k, t, _ in rows)
    found = {r.doc_id: [(d.start, d.stop, d.label) for d in r.detections] for r in licenses.scan(documents(rows)).collect()}
    assert found[2] == [(2 * k, 2 * k + 2, "mit") for k in range(129)]
    assert found[3] == found[2][:128]

    def seconds(n):
        start = time.time()
        licenses.scan(documents([(1, "Licensed under the MIT license, some words. " * n, "s")])).collect()
        return time.time() - start

    seconds(10)
    assert seconds(6400) <= 5 * seconds(1600) + 1
