"""Stored packs and the questions asked of them.

A stored pack is two tables: ``packs`` (one row per pack) and ``pack_lines``
(pack_id, line_no, text), sorted by both so that reading a page prunes to a few
row groups.  A third, ``pack_grams``, is written on demand and lets a search skip
blocks of lines (:mod:`packlake.plans.grams`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlake import fixed
from packlake.functions import text
from packlake.operators.spread import running, top_rows
from packlake.plans import grams, render
from packlake.plans.pack import Pack


def _lines(placed: DataFrame) -> DataFrame:
    numbered = placed.select("pack_id", "line_offset", F.posexplode(text.lines(F.col("text"))).alias("_i", "text"))
    return numbered.select("pack_id", (F.col("line_offset") + F.col("_i") + 1).cast("bigint").alias("line_no"), "text")


def number_lines(plan: Pack) -> DataFrame:
    """(pack_id, line_no, text) of every document; numbers run through the pack."""
    return _lines(render.located(plan))


def line_counts(plan: Pack) -> DataFrame:
    """Lines per pack (A11), from facts alone; combined map-side."""
    return render.measures(plan).groupBy("pack_id").agg(F.sum("n_lines").cast("bigint").alias("line_count"))


def save(plan: Pack, path: str, indexed: bool = False) -> None:
    """Write ``packs`` and ``pack_lines`` below ``path`` (K10), and ``pack_grams`` if ``indexed``.

    Sections are moved and sorted whole; a section's lines follow each other, so
    the exploded rows are sorted too.  The index is made from the written lines,
    so nothing is rendered for it.
    """
    _lines(render.ordered(plan)).write.parquet(f"{path}/pack_lines")
    plan.totals.join(line_counts(plan), "pack_id").write.parquet(f"{path}/packs")
    if indexed:
        written = plan.totals.sparkSession.read.parquet(f"{path}/pack_lines")
        grams.build(written).write.parquet(f"{path}/pack_grams")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(packs, pack_lines) of a store."""
    return spark.read.parquet(f"{path}/packs"), spark.read.parquet(f"{path}/pack_lines")


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """The trigram index of a store that was saved with one."""
    return spark.read.parquet(f"{path}/pack_grams")


def find(packs: DataFrame, pack_id: str) -> DataFrame:
    """The row of one pack; an unknown id is an error naming some known ones."""
    found = packs.filter(F.col("pack_id") == pack_id)
    if found.isEmpty():
        known = [r.pack_id for r in packs.select("pack_id").orderBy("pack_id").limit(20).collect()]
        raise KeyError(f'unknown pack "{pack_id}"; known: {", ".join(known) or "none"}')
    return found


def _require_page(start: int, count: int) -> None:
    if start < 1 or not 1 <= count <= fixed.MAX_READ_LINES:
        raise ValueError(f"start is positive and count is from 1 to {fixed.MAX_READ_LINES}")


def read_page(
    packs: DataFrame, lines: DataFrame, start: int = 1, count: int = fixed.DEFAULT_READ_LINES
) -> DataFrame:
    """Lines ``[start, start + count)`` of every given pack."""
    _require_page(start, count)
    page = F.col("line_no").between(start, start + count - 1)
    return lines.filter(page).join(packs.select("pack_id"), "pack_id", "left_semi")


def page_headers(
    packs: DataFrame, start: int = 1, count: int = fixed.DEFAULT_READ_LINES
) -> DataFrame:
    """Header line of a page: range, total, and how to go on (Q1)."""
    _require_page(start, count)
    shown = F.greatest(F.lit(0), F.least(F.lit(count), F.col("line_count") - (start - 1)))
    last = F.lit(start - 1) + shown
    header = F.concat(
        F.lit("["),
        F.col("pack_id"),
        F.lit(f"] lines {start}-"),
        last.cast("string"),
        F.lit(" of "),
        F.col("line_count").cast("string"),
        F.when(
            last < F.col("line_count"),
            F.concat(F.lit(" (continue with startLine: "), (last + 1).cast("string"), F.lit(")")),
        ).otherwise(F.lit(" (end of pack)")),
    )
    return packs.select("pack_id", header.alias("header"))


def line_predicate(spark: SparkSession, pattern: str, ignore_case: bool = False):
    """Regex test of a line; an invalid pattern is an error up front."""
    flagged = f"(?i){pattern}" if ignore_case else pattern
    try:
        spark.range(1).select(F.rlike(F.lit(""), F.lit(flagged))).collect()
    except Exception as error:
        raise ValueError(f"Invalid regular expression: {pattern}") from error
    return F.rlike(F.col("text"), F.lit(flagged))


def grep(
    lines: DataFrame,
    pattern: str,
    ignore_case: bool = False,
    context: int = 0,
    limit: int | None = fixed.MAX_GREP_MATCHES,
    index: DataFrame | None = None,
) -> DataFrame:
    """First ``limit`` matches per pack, or all for None, with context lines.

    Rows are (pack_id, match_no, line_no, is_match, text).  Context windows that
    overlap repeat their lines, once per match.  ``index`` is the trigram index of
    these lines; it saves reading blocks without a match and changes no row.
    """
    if not 0 <= context <= fixed.MAX_GREP_CONTEXT or (limit is not None and limit < 1):
        raise ValueError(f"context is from 0 to {fixed.MAX_GREP_CONTEXT} and limit is positive")
    test = line_predicate(lines.sparkSession, pattern, ignore_case)
    if index is not None:
        lines = grams.narrowed(lines, index, pattern, context)
    found = lines.filter(test).select("pack_id", "line_no")  # ranks are found on keys alone, text comes after
    if limit is None:
        hits = running(found, ["pack_id"], [F.col("line_no").asc()], {}, number="match_no")
    else:
        hits = top_rows(found, ["pack_id"], [F.col("line_no").asc()], limit, "match_no")
    wanted = hits.select(
        "pack_id",
        "match_no",
        F.col("line_no").alias("hit"),
        F.explode(F.sequence(F.col("line_no") - context, F.col("line_no") + context)).alias("line_no"),
    )
    return lines.join(wanted, ["pack_id", "line_no"]).select(
        "pack_id", "match_no", "line_no", (F.col("line_no") == F.col("hit")).alias("is_match"), "text"
    )


def grep_text(found: DataFrame, context: int = 0) -> DataFrame:
    """Printable rows ``n: text`` / ``n- text``, with ``--`` after each block.

    A separator has no line number and sorts last inside its match.
    """
    row = F.struct(
        F.col("line_no"),
        F.concat(
            F.col("line_no").cast("string"),
            F.when(F.col("is_match"), F.lit(": ")).otherwise(F.lit("- ")),
            F.col("text"),
        ).alias("line"),
    )
    stop = F.struct(F.lit(None).cast("bigint").alias("line_no"), F.lit("--").alias("line"))
    rows = F.when(F.col("is_match") & F.lit(context > 0), F.array(row, stop)).otherwise(F.array(row))
    return found.select("pack_id", "match_no", F.inline(rows))


def grep_headers(
    packs: DataFrame, found: DataFrame, pattern: str, limit: int = fixed.MAX_GREP_MATCHES
) -> DataFrame:
    """Header line per pack: number of matches, ``+`` when the limit was reached."""
    counts = found.filter("is_match").groupBy("pack_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    tail = F.concat(F.lit(f"/{pattern}/ in ["), F.col("pack_id"), F.lit("]"))
    return (
        packs.select("pack_id")
        .join(counts, "pack_id", "left")
        .select(
            "pack_id",
            F.when(n == 0, F.concat(F.lit("No matches for "), tail, F.lit(".")))
            .otherwise(
                F.concat(
                    n.cast("string"),
                    F.when(n == limit, F.lit("+")).otherwise(F.lit("")),
                    F.lit(" match(es) for "),
                    tail,
                    F.lit(":"),
                )
            )
            .alias("header"),
        )
    )


def preview(names: DataFrame, k: int, column: str = "path") -> DataFrame:
    """First ``k`` names per pack, joined, with a mark when there are more."""
    counts = names.groupBy("pack_id").agg(F.count(F.lit(1)).alias("n"))
    first = (
        top_rows(names.select("pack_id", column), ["pack_id"], [F.col(column).asc()], k, "nth")
        .groupBy("pack_id")
        .agg(
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("nth", column))), lambda r: r[column]), ", "
            ).alias("names")
        )
    )
    return counts.join(first, "pack_id").select(
        "pack_id",
        "n",
        F.when(F.col("n") > k, F.concat("names", F.lit(", …"))).otherwise(F.col("names")).alias("names"),
    )


def summary(plan: Pack, line_count: DataFrame, top: int = 10) -> DataFrame:
    """Counts, heaviest files (zero-token ones included), omitted and suspicious."""
    heaviest = (
        top_rows(
            plan.stats.select("pack_id", "path", "tokens"),
            ["pack_id"],
            [F.col("tokens").desc(), F.col("path").asc()],
            top,
            "nth",
        )
        .groupBy("pack_id")
        .agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("nth", "tokens", "path"))),
                lambda r: F.concat(r["tokens"].cast("string"), F.lit("\t"), r["path"]),
            ).alias("top_files")
        )
    )
    dropped = preview(plan.stats.filter("is_omitted"), top).select(
        "pack_id", F.col("n").alias("omitted"), F.col("names").alias("omitted_names")
    )
    risky = preview(plan.suspicious, top).select(
        "pack_id", F.col("n").alias("suspicious"), F.col("names").alias("suspicious_names")
    )
    return (
        plan.totals.select("pack_id", "total_files", "total_tokens")
        .join(line_count, "pack_id")
        .join(heaviest, "pack_id", "left")
        .join(dropped, "pack_id", "left")
        .join(risky, "pack_id", "left")
        .na.fill(0, ["omitted", "suspicious"])
    )
