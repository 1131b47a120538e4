"""Column functions over file text: numbering, fences, escaping, notes, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packlake import fixed
from packlake.functions import paths

# Fixed value: the characters counted as white space, as members of a class.
SPACE_SET = (
    r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
SPACE = f"[{SPACE_SET}]"
NOT_SPACE = f"[^{SPACE_SET}]"


def spaced(pattern: str) -> str:
    r"""Widen ``\s`` to all Unicode white space and pin ``$`` to the very end."""
    return pattern.replace(r"\s", SPACE).replace("$", r"\z")


def lines(content: Column) -> Column:
    """Text split at line feeds; trailing empty lines are kept."""
    return F.split(content, "\n", -1)


def is_blank(line: Column) -> Column:
    return ~F.rlike(line, F.lit(NOT_SPACE))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}++|{SPACE}++\z", "")


def line_count(content: Column) -> Column:
    """1 + number of line feeds, without building an array."""
    return (
        F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1
    ).cast("bigint")


def add_line_numbers(content: Column) -> Column:
    """1-based numbers, left-padded to the width of the last one."""
    width = F.length(line_count(content).cast("string"))
    return F.array_join(
        F.transform(
            lines(content),
            lambda line, i: F.concat(
                F.lpad((i + 1).cast("string"), width, F.lit(" ")), F.lit(": "), line
            ),
        ),
        "\n",
    )


def fence_for(content: Column) -> Column:
    """A back-tick fence longer than any run of three or more inside (P5)."""
    runs = F.transform(F.regexp_extract_all(content, F.lit("(`{3,})"), F.lit(1)), F.length)
    return F.when(F.contains(content, F.lit("```")), F.repeat(F.lit("`"), F.array_max(runs) + 1)).otherwise(
        F.lit("```")
    )


def fence_language(path: Column) -> Column:
    """Fence tag for a path, null when the extension is unknown."""
    pairs = [F.lit(x) for item in fixed.FENCE_LANGUAGE.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), paths.extension(path))


def xml_escape(value: Column) -> Column:
    """Escape the five XML entities, ampersand first."""
    out = value
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def heading_slug(value: Column) -> Column:
    """Lower-case and keep only ``a-z0-9``."""
    return F.regexp_replace(F.lower(value), "[^a-z0-9]+", "")


def json_string(value: Column) -> Column:
    """A JSON string literal, or ``null``."""
    boxed = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNull(), F.lit("null")).otherwise(
        F.substring(boxed, F.lit(6), F.length(boxed) - 6)
    )


def unavailable_note(
    is_binary: Column, is_oversized: Column, is_omitted: Column, max_kb: int
) -> Column:
    """Why a file has no inlined text (P10)."""
    return (
        F.when(is_binary, F.lit("(binary file, contents not included)"))
        .when(is_oversized, F.lit(f"(file >{max_kb}KB, contents skipped)"))
        .when(is_omitted, F.lit("(omitted to fit token budget)"))
        .otherwise(F.lit("(no content)"))
    )


def tree_suffix(
    is_binary: Column, is_oversized: Column, is_omitted: Column, max_kb: int
) -> Column:
    """Suffix of a file's label in the directory tree."""
    return (
        F.when(is_binary, F.lit(" [binary]"))
        .when(is_oversized, F.lit(f" [skipped >{max_kb}KB]"))
        .when(is_omitted, F.lit(" [omitted: token budget]"))
        .otherwise(F.lit(""))
    )


def safety_line(redactions: Column, redact: bool = True) -> Column:
    """Header line about secret redaction."""
    if not redact:
        return F.lit(
            "Safety: Secret redaction was DISABLED (--no-redact). Review before sharing."
        )
    return F.when(
        redactions > 0,
        F.concat(
            F.lit("Safety: "),
            redactions.cast("string"),
            F.lit(" secrets were detected and automatically redacted."),
        ),
    ).otherwise(F.lit("Safety: No secrets were detected. Manual review is still recommended."))


def output_name(fmt: Column, slug: Column) -> Column:
    """Default file name of a rendered pack: brand, slug, extension."""
    pairs = [F.lit(x) for item in fixed.FORMAT_EXTENSION.items() for x in item]
    ext = F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(fmt)), F.lit(".md"))
    return F.concat(F.lit(f"{fixed.BRAND}-"), slug, ext)


def task_preview(task: Column) -> Column:
    """At most 40 characters of a task; longer ones end in dots."""
    return (
        F.when(task.isNull() | is_blank(task), F.lit("(none)"))
        .when(F.length(task) > 40, F.concat(F.substring(task, 1, 37), F.lit("...")))
        .otherwise(task)
    )


def token_severity(tokens: Column) -> Column:
    """green / yellow / red band of a pack's size."""
    return (
        F.when(tokens < fixed.TOKEN_BUDGET_WARNING, F.lit("green"))
        .when(tokens <= fixed.TOKEN_SEVERE, F.lit("yellow"))
        .otherwise(F.lit("red"))
    )


def share_percent(part: Column, total: Column) -> Column:
    """Percentage of the total, 0 when the total is not positive (P20)."""
    return F.when(total > 0, part / total * 100).otherwise(F.lit(0.0))


def share_band(percent: Column) -> Column:
    """Colour band of a percentage (P20)."""
    return (
        F.when(percent > 20, F.lit("red")).when(percent > 10, F.lit("yellow")).otherwise(F.lit("plain"))
    )


def compose_task(task: Column, recipe_prompt: Column) -> Column:
    """Own task first, recipe prompt after a blank line."""
    own = F.when(task == F.lit(""), None).otherwise(task)
    joined = F.concat_ws("\n\n", own, recipe_prompt)
    return F.when(joined == F.lit(""), None).otherwise(joined)


def commit_line(short_hash: Column, ts: Column, subject: Column) -> Column:
    """``hash date subject``."""
    return F.concat_ws(" ", short_hash, F.date_format(ts, "yyyy-MM-dd"), subject)
