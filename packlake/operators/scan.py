"""Corpus selection: scan paths, force-includes, flags and prune counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlake import fixed
from packlake.functions import paths
from packlake.functions.redact import is_suspicious_path
from packlake.operators import ignore
from packlake.operators.spread import join_per_pack
from packlake.session import materialize
from packlake.spec import PackSpec


SNIFFED = 512  # leading bytes that decide whether a file is text


def clean_scan_paths(raw: list[str]) -> list[str]:
    """Normalise user scan paths; a path that leaves the root is an error."""
    out = []
    for entry in raw:
        parts: list[str] = []
        if entry.startswith("/"):
            raise ValueError(f'Path "{entry}" is outside the project root.')
        for part in entry.replace("\\", "/").split("/"):
            if part in ("", "."):
                continue
            if part == "..":
                if not parts:
                    raise ValueError(f'Path "{entry}" is outside the project root.')
                parts.pop()
            else:
                parts.append(part)
        out.append("/".join(parts))
    return out


def under_any(path: Column, scan_paths: list[str]) -> Column:
    """Path equals one of the entries or lies below it; pushes into the scan."""
    test = F.lit(False)
    for entry in scan_paths:
        if entry == "":
            return F.lit(True)
        test = test | (path == F.lit(entry)) | F.startswith(path, F.lit(entry + "/"))
    return test


def restrict(files: DataFrame, scan_paths: list[str]) -> DataFrame:
    """Keep files at or below the given paths."""
    return files.filter(under_any(F.col("path"), clean_scan_paths(scan_paths))) if scan_paths else files


def require_scan_paths(files: DataFrame, scan_paths: list[str]) -> None:
    """Fail for an entry that names no file or directory of any pack."""
    entries = clean_scan_paths(scan_paths)
    if not entries:
        return
    found = files.agg(
        *[F.max(under_any(F.col("path"), [e])).alias(f"e{i}") for i, e in enumerate(entries)]
    ).first()
    for raw, hit in zip(scan_paths, found):
        if not hit:
            raise ValueError(f'Path "{raw}" does not exist.')


def _prefixes(files: DataFrame) -> DataFrame:
    """(pack_id, path, entry) with every scan path a file answers to: itself, its directories, the root."""
    path = F.col("path")
    entries = F.concat(paths.ancestors(path), F.array(path, F.lit("")))
    return files.select("pack_id", "path", F.explode(entries).alias("entry"))


def missing_scan_paths(files: DataFrame, scan_paths: DataFrame) -> DataFrame:
    """Entries of a ``(pack_id, entry)`` table that name no file or directory."""
    known = _prefixes(files).select("pack_id", "entry").distinct()
    return scan_paths.join(known, ["pack_id", "entry"], "left_anti")


def restrict_by_table(files: DataFrame, scan_paths: DataFrame) -> DataFrame:
    """Per-pack scan paths (S2, S3): an equi semi-join on exploded prefixes.

    A directory entry meets all files below it, so the join is spread by path;
    a file that meets several overlapping entries is kept once (U3).
    """
    keys = (
        join_per_pack(_prefixes(files), scan_paths, ["pack_id", "entry"], "left_semi")
        .select("pack_id", "path")
        .distinct()
    )
    return files.join(keys, ["pack_id", "path"], "left_semi")


def reachable(spec: PackSpec) -> Column:
    """Paths that selection can still keep: in scan and not excluded, or force-included; row-local."""
    entries = clean_scan_paths(spec.scan_paths)
    in_scan = under_any(F.col("path"), entries) if entries else F.lit(True)
    return (in_scan & ~ignore.is_default_excluded(F.col("path"))) | ignore.matches_any(F.col("path"), spec.includes)


def select_files(files: DataFrame, spec: PackSpec, facts: DataFrame | None = None) -> DataFrame:
    """Mark every scanned file as kept, pruned or suspicious.

    Adds ``is_candidate`` (survives the built-in excludes), ``is_selected``
    (survives rules, or is force-included) and ``is_suspicious`` to ``facts``,
    a narrow table with a row per file, or to ``files`` itself.  The rule
    cascade works on paths only and meets the rows again on the unique
    (pack_id, path) key, which no hot pack can skew.  Paths that are out of reach
    (:func:`reachable`) are left out.
    """
    rows = files if facts is None else facts
    entries = clean_scan_paths(spec.scan_paths)
    in_scan = under_any(F.col("path"), entries) if entries else F.lit(True)
    included = ignore.matches_any(F.col("path"), spec.includes)
    candidate = in_scan & ~ignore.is_default_excluded(F.col("path"))
    lines = ignore.rule_lines(files)
    if entries:
        lines = lines.filter((F.col("base") == F.lit("")) | under_any(F.col("base"), entries))
    # written: its size tells the planner whether the rules can be broadcast
    sets = materialize(ignore.rule_sets(lines))
    reached = rows.filter(reachable(spec))
    below = ignore.ignored_paths(rows.filter(candidate), sets, spec.root_rules())
    marked = reached.join(
        below.withColumn("_rejected", F.lit(True)), ["pack_id", "path"], "left"
    ).withColumn("_rejected", F.col("_rejected").isNotNull())
    return (
        marked.withColumn("is_candidate", candidate)
        .withColumn("is_selected", (candidate & ~F.col("_rejected")) | included)
        .withColumn("is_suspicious", is_suspicious_path(F.col("path")))
        .drop("_rejected")
    )


def prune_counts(selected: DataFrame) -> DataFrame:
    """total_entries, ignored_entries (may be negative) and files per pack."""
    return selected.groupBy("pack_id").agg(
        F.count_if("is_candidate").alias("total_entries"),
        (F.count_if("is_candidate") - F.count_if("is_selected")).alias("ignored_entries"),
        F.count_if(F.col("is_selected") & F.col("is_suspicious")).alias("suspicious_entries"),
    )


def suspicious(selected: DataFrame) -> DataFrame:
    """Credential-shaped files, reported instead of packed."""
    return selected.filter("is_selected AND is_suspicious").select("pack_id", "path")


def kept(selected: DataFrame) -> DataFrame:
    return selected.filter("is_selected AND NOT is_suspicious").drop(
        "is_candidate", "is_selected", "is_suspicious"
    )


def add_flags(files: DataFrame, max_bytes: int = fixed.DEFAULT_MAX_FILE_BYTES) -> DataFrame:
    """is_binary, is_oversized, and null text for both.

    ``files`` has either ``raw`` bytes or decoded ``content``.  Bytes are binary
    if they hold a NUL, or if over a tenth of the first ``SNIFFED`` are control
    bytes or no UTF-8; other bytes are decoded leniently.  Binary wins over
    oversized.  A source that leaves large bodies out may bring the first bytes of
    every file as ``head``; for files without ``raw`` these decide.
    """
    if "raw" in files.columns:
        start = F.coalesce("head", "raw") if "head" in files.columns else F.col("raw")
        head = F.substring(start, 1, SNIFFED)
        odd = F.regexp_count(F.make_valid_utf8(head.cast("string")), F.lit("[\\x01-\\x06\\x0F-\\x1F\\x{FFFD}]"))
        # a broken last letter of a cut head is one odd sign in ``SNIFFED`` bytes
        binary = F.coalesce(F.contains(F.coalesce("raw", start), F.lit(b"\x00")) | (odd * 10 > F.octet_length(head)), F.lit(False))
        body = F.make_valid_utf8(F.col("raw").cast("string"))
    else:
        binary = F.coalesce(F.contains(F.col("content"), F.lit("\u0000")), F.lit(False))
        body = F.col("content")
    return (
        files.withColumn("is_binary", binary)
        .withColumn("is_oversized", ~F.col("is_binary") & (F.col("size_bytes") > max_bytes))
        .withColumn("content", F.when(~F.col("is_binary") & ~F.col("is_oversized"), body))
        .withColumn("is_omitted", F.lit(False))
        .drop("raw", "head")
    )


def has_content() -> Column:
    """Text that is present, non-empty and inlined."""
    return F.coalesce(
        (F.col("content") != F.lit("")) & ~F.col("is_binary") & ~F.col("is_oversized"), F.lit(False)
    )
