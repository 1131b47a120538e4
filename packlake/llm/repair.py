"""Conversation structure repair by generalised LR parsing (op11).

Roles follow a grammar over their initials: nothing, or an optional ``s`` and one
or more pairs ``ua``.  Its LR automaton is built here from the rules.  A
conversation is parsed with a graph-structured stack: the frontier holds one node
per stack top, a node points at the stack below it, and stacks share what lies
below.  Each row is kept, given another role, or deleted, and rows are inserted
between; every edit moves a stack on at its cost.  Equal stack tops are merged by
the smallest (cost, audit), the audit being the edits' initials so far.  That
is enough: the rest of a parse depends on the top alone, since the stacks below
equal tops allow the same continuations, and of two audits with equal cost
over the same rows neither begins with the other.

A conversation may hold a third of all rows.  It is numbered in ranges and cut
into segments of ``SEGMENT`` rows.  Each segment is parsed alone: the first from
the empty stack, later ones from every stack top a conversation can have there.
Segments give small tables top -> top of (cost, audit), which one pass per
conversation joins.  Only these tables come together, never the rows; the audit
itself is one value of the result and must fit a cell.  The digest reads the
repaired rows of a conversation in order as a stream, since SHA-256 cannot be
cut; rows are not held.

Faults: a row is *blank* without a character other than white space, else a
*duplicate* if an earlier row has its role and text, else *truncated* if its
last character other than white space is none of ``.!?``.  Blank rows and
duplicates must be deleted; a truncated row that stays costs 1 more.

Defined cases: null roles and texts are one space, null ids and turns too where
they are written out; rows without a conversation id are one conversation;
turns that are equal follow each other by role and text, nulls first; roles
count by their first character, so an unknown or empty role cannot be kept
unless it begins with s, u or a; a conversation without rows has zeros, an empty
audit and the digest of the empty string; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlake.operators.spread import running
from packlake.session import materialize

GRAMMAR = (("start", ("S",)), ("S", ()), ("S", ("P",)), ("S", ("s", "P")), ("P", ("P", "u", "a")), ("P", ("u", "a")))
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
CLEAN, BLANK, DUPLICATE, CUT_SHORT = 0, 1, 2, 3
SEGMENT = 256
SPACE = " \t\n\x0b\x0c\r"
EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()

State = frozenset  # of items (rule, place of the dot)
Stack = tuple  # (state number, stack below or None)


class Automaton:
    """LR(0) states of a grammar: shifts, moves over nonterminals, and the rules a state completes."""

    def __init__(self, grammar=GRAMMAR):
        self.grammar = grammar
        heads = {head for head, _ in grammar}

        def closed(items: set) -> State:
            items, todo = set(items), list(items)
            while todo:
                rule, dot = todo.pop()
                body = grammar[rule][1]
                new = {(k, 0) for k, (head, _) in enumerate(grammar) if dot < len(body) and head == body[dot]} - items
                items |= new
                todo += new
            return frozenset(items)

        states = [closed({(0, 0)})]
        self.moves: list[dict[str, int]] = []
        for state in states:  # grows meanwhile
            after: dict[str, set] = {}
            for rule, dot in sorted(state):
                body = grammar[rule][1]
                if dot < len(body):
                    after.setdefault(body[dot], set()).add((rule, dot + 1))
            row = {}
            for symbol, items in after.items():
                target = closed(items)
                if target not in states:
                    states.append(target)
                row[symbol] = states.index(target)
            self.moves.append(row)
        complete = [[rule for rule, dot in sorted(state) if dot == len(grammar[rule][1])] for state in states]
        self.accept = next(k for k, rules in enumerate(complete) if 0 in rules)
        self.reductions = [[(grammar[r][0], len(grammar[r][1])) for r in rules if r] for rules in complete]
        self.shifts = [{t: to for t, to in row.items() if t not in heads} for row in self.moves]
        # a stack for each top that a parse can have between two rows
        self.tops: dict[int, Stack] = {}
        todo: list[Stack] = [(0, None)]
        known: set[Stack] = set()  # finite, as the grammar recurs on the left
        while todo:
            for node in self.reduced(todo.pop()):
                if self.shifts[node[0]] and node not in known:
                    known.add(node)
                    self.tops.setdefault(node[0], node)
                    todo += [(to, node) for to in self.shifts[node[0]].values()]

    def reduced(self, stack: Stack) -> list[Stack]:
        """The stack and all that reductions make of it."""
        out, seen = [stack], {stack[0]}
        for node in out:  # grows meanwhile
            for head, size in self.reductions[node[0]]:
                below = node
                for _ in range(size):
                    below = below[1]
                state = self.moves[below[0]][head]
                if state not in seen:
                    seen.add(state)
                    out.append((state, below))
        return out

    def accepts(self, top: int) -> bool:
        return any(node[0] == self.accept for node in self.reduced(self.tops[top]))


class Frontier:
    """Stack tops with their best (cost, audit, roles) and the stack below."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.best: dict[int, tuple[int, str, str, Stack]] = {}
        self.todo: list[int] = []

    def offer(self, stack: Stack, cost: int, audit: str, roles: str) -> None:
        """Put the stack and its reductions in, merging equal tops by the smallest (cost, audit)."""
        for node in self.automaton.reduced(stack):
            if not self.automaton.shifts[node[0]]:
                continue
            known = self.best.get(node[0])
            if known is None or (cost, audit) < known[:2]:
                self.best[node[0]] = (cost, audit, roles, node)
                self.todo.append(node[0])

    def insert(self) -> Frontier:
        """Insert rows where that reaches a top at less."""
        while self.todo:
            cost, audit, roles, node = self.best[self.todo.pop()]
            for role, to in self.automaton.shifts[node[0]].items():
                if role in ROLES:
                    self.offer((to, node), cost + INSERT, audit + "I", roles + role)
        return self

    def row(self, initial: str, fault: int) -> Frontier:
        """The frontier after one more row."""
        after = Frontier(self.automaton)
        for cost, audit, roles, node in self.best.values():
            after.offer(node, cost + DELETE, audit + "D", roles + "-")
            if fault in (BLANK, DUPLICATE):
                continue
            stays = cost + (TRUNCATED if fault == CUT_SHORT else 0)
            for role, to in self.automaton.shifts[node[0]].items():
                if role == initial:
                    after.offer((to, node), stays, audit + "K", roles + role)
                if role in ROLES:
                    after.offer((to, node), stays + REROLE, audit + "R", roles + role)
        return after.insert()


def routes(automaton: Automaton, rows: tuple[tuple[str, int], ...], first: bool) -> list[tuple[int, int, int, str, str]]:
    """(top before, top after, cost, audit, roles) of the cheapest edits of ``rows`` (initial, fault)."""
    out = []
    for start, stack in sorted(automaton.tops.items()):
        if first and start:
            continue
        frontier = Frontier(automaton)
        frontier.offer(stack, 0, "", "")
        if first:
            frontier.insert()  # later segments begin where the one before has inserted
        for initial, fault in rows:
            frontier = frontier.row(initial, fault)
        out += [(start, end, cost, audit, roles) for end, (cost, audit, roles, _) in sorted(frontier.best.items())]
    return out


def joined(automaton: Automaton, segments: list[list[tuple[int, int, int, str, str]]]) -> tuple[int, str, str]:
    """(cost, audit, roles) of a whole conversation from the routes of its segments, in order."""
    frontier: dict[int, tuple[int, str, str]] = {0: (0, "", "")}
    for segment in segments:
        after: dict[int, tuple[int, str, str]] = {}
        for start, end, cost, audit, roles in segment:
            if start in frontier:
                before = frontier[start]
                new = (before[0] + cost, before[1] + audit, before[2] + roles)
                if end not in after or new[:2] < after[end][:2]:
                    after[end] = new
        frontier = after
    return min((best for top, best in frontier.items() if automaton.accepts(top)), key=lambda b: b[:2])


def edits_of(audit: str, roles: str) -> Iterator[tuple[int, int, str, str]]:
    """(place, nth, edit, role initial): the row an edit is for, or stands before; rows count from 1."""
    place = 1
    for nth, (edit, role) in enumerate(zip(audit, roles)):
        yield place, nth, edit, role
        place += edit != "I"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the faults that crc32 of ``conv_id:turn``, modulo 20, plants."""
    written = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    chance = F.crc32(F.concat(written[0], F.lit(":"), written[1]).cast("binary")) % 20
    role, text = F.col("role"), F.col("text")
    copies = F.when(F.col("chance") == 0, 0).when(F.col("chance") == 3, 2).otherwise(1)
    return (
        conversations.select("conv_id", "turn", written[2].alias("role"), written[3].alias("text"), chance.alias("chance"))
        .withColumn("role", F.when(F.col("chance") == 4, "user").otherwise(role))
        .withColumn("text", F.when(F.col("chance") == 1, "").when(F.col("chance") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text))
        .select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(1), copies)))
        .drop("col")
    )


CONV = ["no_conv", "conv"]


def _conversation() -> dict[str, Column]:
    return {"no_conv": F.col("conv_id").isNull(), "conv": F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))}


def faulty(rows: DataFrame) -> DataFrame:
    """(no_conv, conv, place, turn, role, text, initial, fault) per row, ``place`` counting from 1 in its conversation."""
    base = rows.select(*[c.alias(name) for name, c in _conversation().items()], F.col("turn").cast("bigint").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    placed = running(base, CONV, [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], {}, number="place")
    placed = materialize(placed.withColumn("mark", F.sha2(F.col("text").cast("binary"), 256)))
    same = [*CONV, "role", "mark"]
    firsts = materialize(placed.groupBy(*same).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies"))
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = (
        F.when(end == "", BLANK)
        .when(F.col("place") > F.col("first"), DUPLICATE)
        .when(~F.right(end, F.lit(1)).isin(".", "!", "?"), CUT_SHORT)
        .otherwise(CLEAN)
    )
    return placed.join(firsts, same, "left").select(*CONV, "place", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], values: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Neighbouring rows of equal keys, across batches."""
    key, own = None, []
    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in keys + values}
        for k, v in zip(zip(*[columns[c] for c in keys]), zip(*[columns[c] for c in values])):
            if k != key:
                if own:
                    yield key, own
                key, own = k, []
            own.append(v)
    if own:
        yield key, own


def _sorted_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, order)


ROUTES = "no_conv boolean, conv string, seg bigint, head string, tail string, illegal bigint, routes array<struct<start:int,end:int,cost:bigint,audit:string,roles:string>>"
VERDICT = "no_conv boolean, conv string, illegal bigint, cost bigint, audit string, roles string"
LEGAL = {"su", "ua", "au"}
OUT_ROWS = 200


def _emit(rows: Iterator[tuple], types: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    schema, out = pa.schema(types), []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for row in rows:
        out.append(row)
        if len(out) == OUT_ROWS:
            yield batch()
            out.clear()
    yield batch()


ROUTE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("roles", pa.string())])
KEY_TYPES = [("no_conv", pa.bool_()), ("conv", pa.string())]


def verdicts(rows: DataFrame) -> DataFrame:
    """(no_conv, conv, illegal, cost, audit, roles) per conversation of rows as :func:`faulty` gives them."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        solve = lru_cache(maxsize=4096)(lambda own, first: routes(automaton, own, first))

        def found() -> Iterator[tuple]:
            for (no_conv, conv, seg), own in _groups(batches, [*CONV, "seg"], ["initial", "fault"]):
                pairs = sum(a + b not in LEGAL for (a, _), (b, _) in zip(own, own[1:]))
                ways = [dict(zip(("start", "end", "cost", "audit", "roles"), way)) for way in solve(tuple(own), seg == 0)]
                yield no_conv, conv, seg, own[0][0], own[-1][0], pairs, ways

        yield from _emit(found(), [*KEY_TYPES, ("seg", pa.int64()), ("head", pa.string()), ("tail", pa.string()), ("illegal", pa.int64()), ("routes", pa.list_(ROUTE))])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()

        def found() -> Iterator[tuple]:
            for (no_conv, conv), own in _groups(batches, CONV, ["head", "tail", "illegal", "routes"]):
                pairs = sum(s[2] for s in own) + sum(a[1] + b[0] not in LEGAL for a, b in zip(own, own[1:]))
                cost, audit, roles = joined(automaton, [[tuple(way.values()) for way in s[3]] for s in own])
                yield no_conv, conv, pairs, cost, audit, roles

        yield from _emit(found(), [*KEY_TYPES, ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("roles", pa.string())])

    cut = rows.select(*CONV, F.floor((F.col("place") - 1) / SEGMENT).cast("bigint").alias("seg"), "place", "initial", "fault")
    segments = _sorted_by(cut, [*CONV, "seg"], "place").mapInArrow(parse, ROUTES)
    return _sorted_by(segments, CONV, "seg").mapInArrow(join, VERDICT)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(no_conv, conv, nth, edit, role, text): the rows after repair, from :func:`faulty` and :func:`verdicts`."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((no_conv, conv, *edit) for (no_conv, conv), own in _groups(batches, CONV, ["audit", "roles"]) for audit, roles in own for edit in edits_of(audit, roles) if edit[2] != "D")
        yield from _emit(rows, [*KEY_TYPES, ("place", pa.int64()), ("nth", pa.int64()), ("edit", pa.string()), ("to", pa.string())])

    edits = found.select(*CONV, "audit", "roles").mapInArrow(listed, "no_conv boolean, conv string, place bigint, nth bigint, edit string, to string")
    new_role = F.when(F.col("to") == "u", ROLES["u"]).otherwise(ROLES["a"])
    own = edits.filter("edit <> 'I'").join(rows.select(*CONV, "place", "role", "text"), [*CONV, "place"])
    kept = own.select(*CONV, "nth", "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(new_role).alias("role"), "text")
    return kept.unionByName(edits.filter("edit = 'I'").select(*CONV, "nth", "edit", new_role.alias("role"), F.lit("").alias("text")))


def digests(lines: DataFrame) -> DataFrame:
    """(no_conv, conv, repaired_sha256) of ``role:text``, newline-joined; each conversation is read as a stream."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            key, running_hash = None, None
            for batch in batches:
                for *k, role, text in zip(*[batch.column(c).to_pylist() for c in (*CONV, "role", "text")]):
                    if k != key:
                        if key is not None:
                            yield *key, running_hash.hexdigest()
                        key, running_hash = k, hashlib.sha256()
                    else:
                        running_hash.update(b"\n")
                    running_hash.update(f"{role}:{text}".encode())
            if key is not None:
                yield *key, running_hash.hexdigest()

        yield from _emit(found(), [*KEY_TYPES, ("repaired_sha256", pa.string())])

    return _sorted_by(lines, CONV, "nth").mapInArrow(digest, "no_conv boolean, conv string, repaired_sha256 string")


def repair(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per conversation of ``conversations``: faults, cost, audit and digest of the repair of ``rows``."""
    flagged = materialize(faulty(rows))
    found = materialize(verdicts(flagged))
    hashed = digests(repaired(flagged, found))
    count = lambda fault: F.count(F.when(F.col("fault") == fault, 1))
    facts = flagged.groupBy(*CONV).agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        count(BLANK).alias("blank"),
        count(DUPLICATE).alias("duplicate"),
        count(CUT_SHORT).alias("truncated"),
    )
    every = conversations.select("conv_id").distinct().withColumns(_conversation())
    joined_up = every.join(facts, CONV, "left").join(found.select(*CONV, "illegal", "cost", "audit"), CONV, "left").join(hashed, CONV, "left")
    zero = F.lit(0).cast("bigint")
    return joined_up.select(
        "conv_id",
        *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(EMPTY_DIGEST)).alias("repaired_sha256"),
    )
