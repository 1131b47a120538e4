"""Conversation repair against all edit sequences, and its odd cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from packlake.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def table(spark, rows, extra=""):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", *extra.split(", ")) if extra else df


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        chance = zlib.crc32(key.encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(chance, text)
        yield from [(conv, turn, "user" if chance == 4 else role, text)] * {0: 0, 3: 2}.get(chance, 1)


def cheapest(rows):
    """(cost, audit, kept lines) by trying all edits, cheapest first; rows are (role, text, fault)."""
    import heapq

    queue, seen = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, roles, lines = heapq.heappop(queue)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, lines
        if (at, audit, roles) in seen or not re.fullmatch("s?(ua)*u?", roles):
            continue
        seen.add((at, audit, roles))
        for r, name in (("u", "user"), ("a", "assistant")):
            if audit.count("I") <= len(rows) + 1:
                heapq.heappush(queue, (cost + 2, audit + "I", at, roles + r, (*lines, f"{name}:")))
            if at < len(rows) and rows[at][2] not in ("blank", "duplicate"):
                more = 2 + (rows[at][2] == "truncated")
                heapq.heappush(queue, (cost + more, audit + "R", at + 1, roles + r, (*lines, f"{name}:{rows[at][1]}")))
        if at < len(rows):
            heapq.heappush(queue, (cost + 3, audit + "D", at + 1, roles, lines))
            if rows[at][2] not in ("blank", "duplicate") and rows[at][0]:
                heapq.heappush(queue, (cost + (rows[at][2] == "truncated"), audit + "K", at + 1, roles + rows[at][0][:1], (*lines, f"{rows[at][0]}:{rows[at][1]}")))


def brute(ids, rows):
    out = {}
    for conv in ids:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, marked, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        for _, _, role, text in own:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            marked.append((role, text, fault))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, lines = cheapest(marked)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest)
    return out


def random_rows(seed, conversations, longest):
    pick = random.Random(seed)
    texts = ["Fine.", "Really?", "cut of", "", " \n", None, "No!", "Ça va.", "well "]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"]
    return [(c, pick.choice([None, *range(longest)]), pick.choice(roles), pick.choice(texts)) for c in [None, *range(conversations)] for _ in range(pick.randrange(longest + 1))]


def got(spark, rows, extra="", plant=True):
    df = table(spark, rows, extra)
    return {r.conv_id: tuple(r) for r in repair.repair(df, repair.damaged(df) if plant else df).collect()}


@pytest.mark.parametrize("segment", [256, 2])
def test_repair_is_cheapest(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = random_rows(segment, 40, 6)
    ids = {r[0] for r in rows}
    assert got(spark, rows, "1 AS place, 2 AS seg, 3 AS fault, 4 AS conv") == brute(ids, list(damage(rows)))


def test_conversation_that_vanishes(spark):
    conv = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert got(spark, [(conv, 0, "user", "Hi.")]) == {conv: (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_empty_table(spark):
    assert got(spark, []) == {}


def test_one_huge_conversation(spark, monkeypatch):
    """Segments give what one parse of all rows gives."""
    pick = random.Random(5)
    rows = [(7, t, pick.choice(["user", "assistant", "system"]), pick.choice([f"Text {t}.", f"text {t}", "Again."])) for t in range(3000)]
    monkeypatch.setattr(repair, "SEGMENT", 64)
    cut = got(spark, rows, plant=False)
    monkeypatch.setattr(repair, "SEGMENT", 10_000)
    assert cut == got(spark, rows, plant=False)
    assert len(cut[7][7]) >= 3000 and cut[7][3] > 100


def test_very_long_text(spark):
    rows = [(1, 0, "user", "x" * 2_000_000 + "."), (1, 1, "assistant", "." + " " * 500_000 + "y")]
    found = got(spark, rows, plant=False)[1]
    assert found[4] == 1 and found[6] == 1 and found[7] == "KK"
    assert found[8] == hashlib.sha256(f"user:{rows[0][3]}\nassistant:{rows[1][3]}".encode()).hexdigest()


def test_automaton_knows_the_grammar():
    automaton = repair.Automaton()
    for word in ("", "ua", "sua", "uaua", "suaua"):
        best = repair.joined(automaton, [repair.routes(automaton, tuple((c, 0) for c in word), True)])
        assert best == (0, "K" * len(word), word)
    assert repair.joined(automaton, [repair.routes(automaton, (("s", 0),), True)])[:2] == (3, "D")
