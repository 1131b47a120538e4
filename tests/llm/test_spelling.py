"""Spelling variants against comparing all words, and its odd cases."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from packlake.llm import spelling


def brute(rows):
    capitals = {c: c + 32 for c in range(65, 91)}
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(capitals)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 5:
                n[word] += 1
    n = {w: c for w, c in n.items() if c >= 3}
    less = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            less[i, w[:i] + w[i + 1 :]].add(w)
    near = {w: set() for w in n}
    for (_, rest), own in less.items():
        for w in own:
            near[w] |= own - {w}
            if rest in n:
                near[w].add(rest)
                near[rest].add(w)
    best = {w: min(near[w], key=lambda o: (-n[o], o), default=None) for w in n}
    form = {w: b if b is not None and n[b] >= 2 * n[w] else None for w, b in best.items()}
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (w, form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def got(docs):
    return {r.word: tuple(r) for r in spelling.variants(docs).collect()}


def test_all_pairs(clashing, monkeypatch):
    pick = random.Random(3)
    stems = ["".join(pick.choice("abcdeé") for _ in range(pick.randrange(4, 9))) for _ in range(60)]
    words = []
    for stem in stems:
        for _ in range(12):
            i, w = pick.randrange(len(stem) + 1), stem
            w = pick.choice([w[:i] + w[i + 1 :], w[:i] + pick.choice("abÿ") + w[i:], w[:i] + "z" + w[i + 1 :], w, w.upper()])
            words += [w] * pick.choice([1, 3, 4, 8, 20])
    pick.shuffle(words)
    rows = [(d, " ".join(words[d::50])) for d in range(50)] + [(None, " ".join(stems * 3)), (60, None), (61, ""), (62, "1 2 ×÷ ××××××")]
    monkeypatch.setattr(spelling, "PART", 4)
    expected = brute(rows)
    assert sum(v[1] is not None for v in expected.values()) > 50 and any(expected[w][2] != v[1] for w, v in expected.items() if v[1])
    assert got(clashing(rows)) == expected


def test_long_runs(documents):
    """Runs of one letter have a key at every place; they are words like others."""
    runs = ["a" * 1500, "a" * 1499, "a" * 700 + "b" + "a" * 799, "ab" * 32, "ab" * 32 + "a", "ab" * 31 + "a"]
    rows = [(d, " ".join(runs + runs[:3] * (d % 3))) for d in range(5)]
    found = got(documents(rows))
    assert found == brute(rows)
    assert found["ab" * 32][4] == 2 and found["a" * 1500][4] == 2


def test_nothing(documents):
    assert got(documents([(1, None)])) == {}
    assert got(documents([]).filter("false")) == {}


def test_a_word_left_alone(documents):
    assert got(documents([(d, "Straße") for d in range(3)]))["straße"][1:] == (None, "straße", 3, 0, None)


@given(st.lists(st.integers(0, 40), min_size=3, max_size=9, unique=True), st.data())
@settings(max_examples=200, deadline=None)
def test_pivots_are_cheapest(places, data):
    places = sorted(places)
    weights = data.draw(st.lists(st.integers(0, 9), min_size=len(places), max_size=len(places)))
    cost = dict(zip(places, weights))
    best = min(cost[a] + cost[b] for a in places for b in places if b >= a + 2)
    a, b = spelling.pivots(places, weights)
    assert b >= a + 2 and cost[a] + cost[b] == best


@given(st.text("ab", min_size=5, max_size=9), st.integers(0, 9), st.sampled_from("abc"), st.sampled_from("rid"))
@settings(max_examples=300, deadline=None)
def test_keys_of_near_words_meet(word, at, letter, edit):
    at = min(at, len(word) - 1)
    other = {"r": word[:at] + letter + word[at + 1 :], "i": word[:at] + letter + word[at:], "d": word[:at] + word[at + 1 :]}[edit]
    if other == word or len(other) < 5:
        return
    grams = {w[i : i + 2] for w in (word, other) for i in range(len(w) - 1)}
    order = {g: (k, 1) for k, g in enumerate(sorted(grams))}
    (last_a, a), (last_b, b) = spelling.word_keys(word, order), spelling.word_keys(other, order)
    if last_a > last_b:
        a, b = b, a
    probes, found = [k[1:] for k in a if k[0] == 0], [k[1:] for k in b if k[0] == 1]
    assert any(
        p[0] == f[0] and (p[1] == f[1] or p[2] == (f[2] if p[3] is None else f[3])) for p in probes for f in found
    )
