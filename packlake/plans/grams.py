"""Trigram index over the lines of stored packs.

An index has one row (gram, pack_id, block) per three characters that occur in a
line of a block, ``BLOCK_LINES`` consecutive lines of a pack; ASCII capitals are
lower-cased, so one index serves both kinds of search.  Rows are sorted by all
three columns: a lookup of some grams reads the few row groups that hold them.

A regex tells which grams a matching line must have (:func:`needed`).  Blocks
that lack them cannot match and are not read; every line of the others is still
tested with the regex itself.  Where nothing follows from the regex all lines are
read.  An index only ever saves work: the rows found are the same.
"""

from __future__ import annotations

from itertools import product
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlake.session import materialize

BLOCK_LINES = 1024
PUSHED_BLOCKS = 256  # up to so many blocks are named in the scan's filter; more of them are joined
MOST_BRANCHES = 32
LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)


def _lower(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def block_of(line_no: Column | str) -> Column:
    number = F.col(line_no) if isinstance(line_no, str) else line_no
    return F.floor((number - 1) / BLOCK_LINES).cast("bigint")


def build(lines: DataFrame) -> DataFrame:
    """(gram, pack_id, block) of numbered lines, each once, sorted within range partitions.

    A line's grams are made distinct in its row and a block's in the task that
    reads it, before they are shuffled.  Lines without text, or shorter than
    three characters, have none.
    """
    grams = F.array_distinct(F.regexp_extract_all(_lower(F.col("text")), F.lit("(?s)(?=(...))."), F.lit(1)))
    found = lines.select(F.explode(grams).alias("gram"), "pack_id", block_of("line_no").alias("block")).distinct()
    order = ["gram", "pack_id", "block"]
    return found.repartitionByRange(*order).sortWithinPartitions(*order)


# ------------------------------------------------------- what a matching line must hold


class _Unsure(Exception):
    """The regex uses a construct from which nothing is concluded."""


class _Walk:
    """Literal runs of a regex, as a list of branches: a match has all runs of at least one of them.

    Everything that is not plainly a literal ends a run, and everything that
    could change the meaning of what follows (flags, look-around, quoting,
    references, class arithmetic) gives up.
    """

    CLASSES = "dDwWsShHvVRX"
    BOUNDS = "bBAzZG"
    CONTROLS = {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}

    def __init__(self, pattern: str):
        self.rest = pattern
        self.at = 0

    def peek(self) -> str:
        return self.rest[self.at : self.at + 1]

    def take(self) -> str:
        if self.at >= len(self.rest):
            raise _Unsure
        self.at += 1
        return self.rest[self.at - 1]

    def branches(self, depth: int = 0) -> list[frozenset[str]]:
        found = self.sequence(depth)
        while self.peek() == "|":
            self.take()
            found = found + self.sequence(depth)
        if len(found) > MOST_BRANCHES:
            return [frozenset()]
        return found

    def sequence(self, depth: int) -> list[frozenset[str]]:
        """Branches of what stands up to the next ``|`` or closing bracket."""
        runs, groups, run = [], [], ""
        while self.peek() not in ("", "|", ")"):
            kind, value = self.atom(depth)
            least, once = self.quantifier()
            if kind == "char" and once:
                run += value
                continue
            if kind == "char" and least > 0:
                runs.append(run + value)
                run = value
                continue
            runs.append(run)
            run = ""
            if kind == "group" and least > 0:
                groups.append(value)
        if self.peek() == ")" and depth == 0:
            raise _Unsure
        own = frozenset([*runs, run]) - {""}
        size = 1
        for options in groups:
            size *= len(options)
        if size > MOST_BRANCHES:
            return [own]
        return [own.union(*choice) for choice in product(*groups)]

    def atom(self, depth: int):
        c = self.take()
        if c == "(":
            if self.peek() == "?":
                self.take()
                if self.take() != ":":
                    raise _Unsure
            inside = self.branches(depth + 1)
            if self.take() != ")":
                raise _Unsure
            return "group", inside
        if c == "[":
            self.skip_class()
            return "other", None
        if c == "\\":
            return self.escape()
        if c in ".^$":
            return "other", None
        if c in "*+?{":
            raise _Unsure
        return "char", c

    def escape(self):
        c = self.take()
        if c in self.CONTROLS:
            return "char", self.CONTROLS[c]
        if c in self.CLASSES or c in self.BOUNDS:
            return "other", None
        if c in "pP":
            if self.take() == "{":
                while self.take() != "}":
                    pass
            return "other", None
        if c.isascii() and not c.isalnum():
            return "char", c
        raise _Unsure

    def skip_class(self) -> None:
        if self.peek() == "^":
            self.take()
        if self.peek() == "]":
            raise _Unsure
        while (c := self.take()) != "]":
            if c in "[&":
                raise _Unsure
            if c == "\\" and self.take() in "QE":
                raise _Unsure

    def quantifier(self) -> tuple[int, bool]:
        """(least repeats, whether the atom stands exactly once)."""
        c = self.peek()
        if c not in ("*", "+", "?", "{"):
            return 1, True
        self.take()
        least = 1 if c == "+" else 0
        if c == "{":
            digits = ""
            while (d := self.take()) != "}":
                digits += d
            low = digits.split(",")[0]
            if not low.isdigit():
                raise _Unsure
            least = int(low)
        if self.peek() in ("?", "+"):
            self.take()
        return least, False


def needed(pattern: str) -> list[frozenset[str]] | None:
    """Lower-cased grams by branch: a line that matches holds all of one branch.  None: nothing is known."""
    try:
        walk = _Walk(pattern)
        runs = walk.branches()
        if walk.at != len(pattern):
            return None
    except _Unsure:
        return None
    low = [{run.translate(LOWER) for run in branch} for branch in runs]
    grams = [frozenset(r[i : i + 3] for r in branch for i in range(len(r) - 2)) for branch in low]
    return grams if all(grams) else None


# ------------------------------------------------------------------------------ lookup


def blocks(index: DataFrame, pattern: str) -> DataFrame | None:
    """(pack_id, block) that may hold a match; None when the regex does not say."""
    branches = needed(pattern)
    if branches is None:
        return None
    held = (
        index.filter(F.col("gram").isin(sorted(frozenset().union(*branches))))
        .groupBy("pack_id", "block")
        .agg(F.collect_set("gram").alias("held"))
    )
    whole = F.lit(False)
    for branch in branches:
        wanted = F.array(*[F.lit(g) for g in sorted(branch)])
        whole = whole | (F.size(F.array_except(wanted, F.col("held"))) == 0)
    return held.filter(whole).select("pack_id", "block")


def narrowed(lines: DataFrame, index: DataFrame, pattern: str, context: int = 0) -> DataFrame:
    """The lines of blocks that may hold a match, and ``context`` lines around them.

    Few blocks become ranges of line numbers in the scan's filter, which prunes
    row groups of the sorted table; more of them are a semi-join.
    """
    found = blocks(index, pattern)
    if found is None:
        return lines
    found = materialize(found)
    few = found.limit(PUSHED_BLOCKS + 1).collect()
    if len(few) <= PUSHED_BLOCKS:
        keep = F.lit(False)
        for row in few:
            first = row.block * BLOCK_LINES + 1
            here = F.col("line_no").between(first - context, first + BLOCK_LINES - 1 + context)
            keep = keep | ((F.col("pack_id") == row.pack_id) & here)
        return lines.filter(keep)
    around = 1 if context else 0  # a context is shorter than a block
    near = found.select("pack_id", F.explode(F.sequence(F.col("block") - around, F.col("block") + around)).alias("_block"))
    return lines.withColumn("_block", block_of("line_no")).join(near, ["pack_id", "_block"], "left_semi").drop("_block")
