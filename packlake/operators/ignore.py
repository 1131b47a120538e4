"""Ignore rules: built-in globs, pack rule files, excludes and includes.

Two rule dialects exist.  *Globs* (built-in excludes, includes) test a whole
path.  *Ignore rules* (rule files, user excludes) are ordered, may be negated,
apply to directories as well, and cascade from the pack root downwards.

Rule files are rows of the corpus.  The rules of one directory become a single
regex, an alternation from the last rule to the first whose match ends at a
letter that tells ignored from rescued (:func:`tagged`).  Rows are sorted by rule
set before they are tested, so a set is compiled once per task.

Directories are decided before files.  For every distinct (pack, directory) and
every rule set above it, the way down from the set's directory is tested until an
ignored directory is met; that closes the set for all that lies below.  A file is
tested only against sets that are open in its directory and lie deeper than the
deepest closed one; without such sets its directory has decided.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packlake import fixed
from packlake.functions import paths, text
from packlake.operators import globs
from packlake.operators.spread import join_per_pack
from packlake.session import materialize

# ---------------------------------------------------------------- translation


def _set_regex(members: str, negated: bool) -> str:
    """A bracket set as code points; a reversed range holds nothing, an escape is its letter."""
    letters = [(m[1] or m[2], bool(m[1])) for m in re.finditer(r"\\(.)|(.)", members, re.S)]
    out, k = "", 0
    while k < len(letters):
        first = last = letters[k][0]
        if k + 2 < len(letters) and letters[k + 1] == ("-", False):
            last = letters[k + 2][0]
            k += 2
        k += 1
        if first <= last:
            out += rf"\x{{{ord(first):x}}}-\x{{{ord(last):x}}}"
    if negated:
        return f"[^/{out}]"
    return f"(?!/)[{out}]" if out else "(?!)"


def _segment_regex(glob: str, braces: bool) -> str:
    """Translate one path segment: ``*``, ``?``, ``[set]``, escapes, ``{a,b}``.

    What stands between two stars is matched where it first occurs and not
    tried again: a later place could not match more.
    """
    token = re.compile(r"\\(.)|(\*+)|(\?)|\[([!^]?)((?:\\.|[^\]\\])+)\]|([{},])|(.)", re.S)
    chunks, depth = [""], 0
    for m in token.finditer(glob):
        escaped, stars, single, negated, members, brace, plain = m.groups()
        if stars and not depth:
            chunks.append("")
        elif stars:
            chunks[-1] += "[^/]*"
        elif single:
            chunks[-1] += "[^/]"
        elif members:
            chunks[-1] += _set_regex(members, bool(negated))
        elif brace and braces and (brace == "{" or depth):
            chunks[-1] += {"{": "(?:", ",": "|", "}": ")"}[brace]
            depth += {"{": 1, ",": 0, "}": -1}[brace]
        else:
            chunks[-1] += re.escape(escaped or brace or plain or "")
    if depth:  # a brace that is never closed is a letter
        return _segment_regex(glob, braces=False)
    if len(chunks) == 1:
        return chunks[0]
    middle = "".join(f"(?>[^/]*?{c})" for c in chunks[1:-1])
    return f"{chunks[0]}{middle}[^/]*{chunks[-1]}"


def _path_regex(glob: str, braces: bool) -> str:
    """Join segments; a ``**`` segment spans any number of directories."""
    parts = glob.split("/")
    out = ""
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += ".+" if last else "(?:[^/]+/)*"
        elif part and not part.strip("*"):
            out += "[^/]+" + ("" if last else "/")
        else:
            out += _segment_regex(part, braces) + ("" if last else "/")
    return out


def glob_regex(glob: str) -> str:
    """Anchored regex for a glob over whole paths, dot files included."""
    return rf"\A{_path_regex(globs.with_ranges_listed(glob).removeprefix('./'), braces=True)}\z"


def rule_body(pattern: str) -> tuple[str, bool] | None:
    """Regex of one ignore-file line for a whole path, and its polarity; None for blanks and comments.

    It is tested without regard to case, against ``dir/`` for directories and
    ``dir/file`` for files.  A pattern without an inner slash matches at any depth.
    """
    line = pattern.strip()
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    if negated:
        line = line[1:]
    elif line.startswith(("\\!", "\\#")):
        line = line[1:]
    directory_only = line.endswith("/")
    line = line.rstrip("/") if directory_only else line
    if not line:
        return None
    start = "" if "/" in line else "(?:.*/)?"
    return f"{start}{_path_regex(line.removeprefix('/'), braces=False)}{'/' if directory_only else '/?'}", negated


def rule_regex(pattern: str) -> tuple[str, bool] | None:
    """Anchored regex and polarity of one ignore-file line; None for blanks and comments."""
    rule = rule_body(pattern)
    return rule and (rf"(?iu)\A{rule[0]}\z", rule[1])


RULE = T.StructType([T.StructField("body", T.StringType()), T.StructField("negated", T.BooleanType())])


@F.pandas_udf(RULE)
def rule_body_udf(pattern: pd.Series) -> pd.DataFrame:
    """Vectorised :func:`rule_body` for the (few) lines of rule files."""
    return pd.DataFrame([rule_body(p) or (None, None) for p in pattern], columns=["body", "negated"])


# ---------------------------------------------------------------------- globs


def matches_any(path: Column, patterns: list[str]) -> Column:
    """One alternation over all globs; evaluated in the scan stage.

    Globs with groups such as ``@(a|b)`` or ``!(a)`` are followed as trees
    (:mod:`packlake.operators.globs`), in Python, and only if there are any.
    """
    trees = [globs.tree(g) for g in patterns]
    plain = [glob_regex(g)[2:-2] for g, nodes in zip(patterns, trees) if nodes is None]
    grouped = [nodes for nodes in trees if nodes is not None]
    hit = F.rlike(path, F.lit(rf"\A(?:{'|'.join(plain)})\z")) if plain else F.lit(False)
    return hit | globs.matches_trees(path, grouped) if grouped else hit


def is_default_excluded(path: Column) -> Column:
    """Built-in excludes (F1)."""
    return matches_any(path, fixed.DEFAULT_EXCLUDES)


# --------------------------------------------------------------- rule sources


def rule_lines(files: DataFrame) -> DataFrame:
    """Rule rows found in the corpus.

    Root level: the three rule files at the pack root, weakest first.  Nested
    level: every deeper ``.gitignore``; ``base`` is its directory.
    """
    name = paths.basename(F.col("path"))
    base = paths.dirname(F.col("path"))
    at_root = F.col("path").isin(fixed.ROOT_RULE_FILES)
    nested = (name == F.lit(fixed.NESTED_RULE_FILE)) & (base != F.lit("")) & ~is_default_excluded(F.col("path"))
    priority = F.array_position(F.array(*[F.lit(n) for n in fixed.ROOT_RULE_FILES]), F.col("path"))
    return (
        files.filter(at_root | nested)
        .select(
            "pack_id",
            base.alias("base"),
            F.when(at_root, priority).otherwise(F.lit(0)).cast("int").alias("source"),
            F.posexplode(text.lines(F.col("content"))).alias("line_no", "line"),
        )
        .withColumn("pattern", text.trim(F.col("line")))
        .filter((F.col("pattern") != F.lit("")) & ~F.startswith(F.col("pattern"), F.lit("#")))
        .select(
            "pack_id", "base", paths.depth(F.col("base")).alias("depth"), "source", "line_no", "pattern"
        )
    )


IGNORED, RESCUED = "I", "N"
SIGNS = "\x01" + IGNORED + RESCUED


def _alternative(body, negated):
    """A rule's part of a tagged regex: its match ends before the letter of its polarity."""
    ignored = F.concat(F.lit("(?:"), body, F.lit(rf")\x01(?={IGNORED}{RESCUED}\z)"))
    rescued = F.concat(F.lit("(?:"), body, F.lit(rf")\x01{IGNORED}(?={RESCUED}\z)"))
    return F.when(negated, rescued).otherwise(ignored)


def tagged(rules: Column) -> Column:
    """One regex for an ordered array of (body, negated), the last rule tried first."""
    alternatives = F.transform(F.reverse(rules), lambda r: _alternative(r["body"], r["negated"]))
    return F.concat(F.lit(r"(?iu)\A(?:"), F.array_join(alternatives, "|"), F.lit(")(.)"))


def _tag(subject: Column, regex: Column) -> Column:
    """``IGNORED`` or ``RESCUED`` by the last rule that matches, empty when none does.

    The extracting function keeps the last regex compiled, unlike a plain match.
    """
    return F.coalesce(F.call_function("regexp_extract", F.concat(subject, F.lit(SIGNS)), regex, F.lit(1)), F.lit(""))


def rule_sets(lines: DataFrame) -> DataFrame:
    """(pack_id, base, depth, regex): one tagged regex per (pack, base), as long as the rule files of one directory."""
    translated = lines.withColumn("rule", rule_body_udf("pattern")).filter("rule.body IS NOT NULL")
    ordered = F.sort_array(F.collect_list(F.struct("source", "line_no", "rule.body", "rule.negated")))
    return translated.groupBy("pack_id", "base", "depth").agg(ordered.alias("rules")).select("pack_id", "base", "depth", tagged(F.col("rules")).alias("regex"))


# ------------------------------------------------------------------- verdicts


def _last_match_fixed(subject: Column, rules: list[tuple[str, bool]]) -> Column:
    """The same for rules known to the driver: literal regexes, last one first."""
    out = None
    for regex, negated in reversed(rules):
        test, value = F.rlike(subject, F.lit(regex)), F.lit(RESCUED if negated else IGNORED)
        out = F.when(test, value) if out is None else out.when(test, value)
    return F.lit("") if out is None else out.otherwise(F.lit(""))


def _level_verdict(subject: Column, decide) -> Column:
    """A path below an ignored directory is ignored; otherwise its own verdict."""
    under_ignored = F.exists(
        paths.ancestors(subject), lambda d: decide(F.concat(d, F.lit("/"))) == IGNORED
    )
    return F.when(under_ignored, F.lit(IGNORED)).otherwise(decide(subject))


def ignored_by_rules(path: Column, patterns: list[str]) -> Column:
    """Verdict of driver-side rules alone (F2, F4, F9, F11), one level."""
    compiled = [r for r in map(rule_regex, patterns) if r]
    if not compiled:
        return F.lit(False)
    return _level_verdict(path, lambda p: _last_match_fixed(p, compiled)) == IGNORED


def _decide(excludes: list[str]):
    """A test of a path below ``base``: its tag by the set's regex, or at the root by ``excludes``, which come last."""
    compiled = [r for r in map(rule_body, excludes) if r]
    rules = F.array(*[F.struct(F.lit(body).alias("body"), F.lit(negated).alias("negated")) for body, negated in compiled])

    def decide(subject: Column) -> Column:
        from_files = _tag(subject, F.col("regex"))
        if not compiled:
            return from_files
        extra = _tag(subject, tagged(rules))
        return F.when((F.col("base") == F.lit("")) & (extra != ""), extra).otherwise(from_files)

    return decide, bool(compiled)


def _below(path: Column) -> Column:
    """``path`` as seen from ``base``."""
    return F.when(F.col("base") == F.lit(""), path).when(path == F.col("base"), F.lit("")).otherwise(F.substring(path, F.char_length("base") + 2, F.char_length(path)))


def _with_sets(rows: DataFrame, sets: DataFrame, spread_by: str, everywhere: bool) -> DataFrame:
    """Rows (pack_id, base) with the regex of their set; the root stays without one if ``everywhere``."""
    met = join_per_pack(rows, sets.select("pack_id", "base", "regex"), ["pack_id", "base"], "left" if everywhere else "inner", spread_by)
    if everywhere:
        met = met.filter(F.col("regex").isNotNull() | (F.col("base") == F.lit("")))
    return met.sortWithinPartitions("pack_id", "base")


def directories(files: DataFrame, sets: DataFrame, excludes: list[str] | None = None) -> DataFrame:
    """(pack_id, dir, closed, open) per directory that holds files and has a rule set at or above it.

    ``closed`` is the depth of the deepest set that ignores the directory or one
    above it (null if none does), ``open`` lists the deeper sets (depth, base).
    """
    decide, extra = _decide(excludes or [])
    own = files.select("pack_id", paths.dirname(F.col("path")).alias("dir")).distinct()
    bases = F.array_distinct(F.concat(F.array(F.lit("")), paths.ancestors(F.col("dir")), F.array("dir")))
    ruled = _with_sets(own.select("pack_id", "dir", F.explode(bases).alias("base")), sets, "dir", extra)
    rest = _below(F.col("dir"))
    way = F.when(rest == "", F.array().cast("array<string>")).otherwise(F.concat(paths.ancestors(rest), F.array(rest)))
    depth = paths.depth(F.col("base"))
    judged = ruled.select("pack_id", "dir", "base", depth.alias("depth"), F.exists(way, lambda d: decide(F.concat(d, F.lit("/"))) == IGNORED).alias("shut"))
    at = judged.groupBy("pack_id", "dir").agg(
        F.max(F.when(F.col("shut"), F.col("depth"))).alias("closed"),
        F.collect_list(F.when(~F.col("shut"), F.struct("depth", "base"))).alias("open"),
    )
    deeper = F.filter("open", lambda o: F.col("closed").isNull() | (o["depth"] > F.col("closed")))
    return at.select("pack_id", "dir", "closed", deeper.alias("open"))


def open_levels(files: DataFrame, state: DataFrame) -> DataFrame:
    """(pack_id, path, closed, depth, base): the sets a file is still to be tested against.

    A file whose directory has decided has one row without a base.
    """
    named = files.select("pack_id", "path", paths.dirname(F.col("path")).alias("dir"))
    met = named.join(state, ["pack_id", "dir"]).filter(F.col("closed").isNotNull() | (F.size("open") > 0))
    return met.select("pack_id", "path", "closed", F.explode_outer("open").alias("level")).select("pack_id", "path", "closed", "level.depth", "level.base")


def ignored_paths(files: DataFrame, sets: DataFrame, excludes: list[str] | None = None) -> DataFrame:
    """Distinct (pack_id, path) rejected by the rule cascade.

    Levels fold from the root down: the deepest level with an opinion wins.
    ``excludes`` are root-level rules after those of the rule files.
    """
    decide, extra = _decide(excludes or [])
    # written: both branches below read it, and its size tells the planner whether it can be broadcast
    levels = open_levels(files, materialize(directories(files, sets, excludes)))
    decided = levels.filter(F.col("base").isNull()).select("pack_id", "path", F.lit(-1).alias("depth"), F.lit(IGNORED).alias("tag"))
    tested = _with_sets(levels.filter(F.col("base").isNotNull()), sets, "path", extra).select("pack_id", "path", "closed", "depth", decide(_below(F.col("path"))).alias("tag"))
    # a set without an opinion leaves the file to the closed one above it
    fallen = F.when(F.col("tag") != "", F.col("tag")).when(F.col("closed").isNotNull(), IGNORED)
    return (
        tested.select("pack_id", "path", F.when(F.col("tag") != "", F.col("depth")).otherwise(-1).alias("depth"), fallen.alias("tag"))
        .filter(F.col("tag").isNotNull())
        .groupBy("pack_id", "path")
        .agg(F.max_by("tag", "depth").alias("tag"))
        .filter(F.col("tag") == IGNORED)
        .select("pack_id", "path")
        .unionByName(decided.select("pack_id", "path"))
    )
