"""Content shaping: comment stripping, blank-line removal, signature skeletons.

All of it is row-local higher-order and regex expressions, so a shaped corpus
costs one scan and no shuffle.  Regexes that walk whole files avoid alternation
under an unbounded quantifier, which would recurse once per character.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packlake import fixed
from packlake.functions import paths, text

# String literals, comments, plain runs; every character falls in one segment.
C_SEGMENTS = (
    r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+["\n]?+'
    r"|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+['\n]?+"
    r"|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`?+"
    r"|//[^\n]*+"
    r"|/\*[\s\S]*?(?:\*/|\z)"
    r"|[^\"'`/]++"
    r"|[\s\S]"
)
HTML_SEGMENTS = r"<!--[\s\S]*?(?:-->|\z)|[^<]++|<"
CSS_SEGMENTS = r"/\*[\s\S]*?(?:\*/|\z)|[^/]++|/"


def _segments(content: Column, pattern: str) -> Column:
    return F.regexp_extract_all(content, F.lit(pattern), F.lit(0))


def _only_newlines(segment: Column) -> Column:
    return F.regexp_replace(segment, "[^\n]++", "")


def strip_c_comments(content: Column) -> Column:
    """Drop ``//`` and ``/* */`` outside strings; drop lines that became blank."""
    bare = F.array_join(
        F.transform(
            _segments(content, C_SEGMENTS),
            lambda s: F.when(F.startswith(s, F.lit("//")), F.lit(""))
            .when(F.startswith(s, F.lit("/*")), _only_newlines(s))
            .otherwise(s),
        ),
        "",
    )
    pairs = F.arrays_zip(text.lines(bare).alias("now"), text.lines(content).alias("was"))
    kept = F.filter(pairs, lambda p: ~text.is_blank(p["now"]) | text.is_blank(p["was"]))
    stripped = F.array_join(F.transform(kept, lambda p: p["now"]), "\n")
    # without a slash there is nothing to strip and no line can become blank
    return F.when(F.contains(content, F.lit("/")), stripped).otherwise(content)


def strip_hash_comments(content: Column) -> Column:
    """Drop full-line ``#`` comments, keep a first-line shebang."""
    return F.array_join(
        F.filter(
            text.lines(content),
            lambda line, i: ~F.rlike(line, F.lit(rf"\A{text.SPACE}*+#"))
            | ((i == 0) & F.rlike(line, F.lit(rf"\A{text.SPACE}*+#!"))),
        ),
        "\n",
    )


def _strip_blocks(content: Column, pattern: str, opening: str, closing: str) -> Column:
    shortest = len(opening) + len(closing)
    return F.array_join(
        F.transform(
            _segments(content, pattern),
            lambda s: F.when(~F.startswith(s, F.lit(opening)), s)
            .when(F.endswith(s, F.lit(closing)) & (F.length(s) >= shortest), _only_newlines(s))
            .otherwise(F.lit("")),
        ),
        "",
    )


def strip_html_comments(content: Column) -> Column:
    """Drop ``<!-- -->`` keeping line feeds; an unclosed one drops the rest."""
    return F.when(
        F.contains(content, F.lit("<!--")), _strip_blocks(content, HTML_SEGMENTS, "<!--", "-->")
    ).otherwise(content)


def strip_css_comments(content: Column) -> Column:
    """Drop ``/* */`` keeping line feeds; an unclosed one drops the rest."""
    return F.when(
        F.contains(content, F.lit("/*")), _strip_blocks(content, CSS_SEGMENTS, "/*", "*/")
    ).otherwise(content)


def strip_dash_comments(content: Column) -> Column:
    """Drop full-line ``--`` comments (P14d)."""
    return F.array_join(
        F.filter(text.lines(content), lambda line: ~F.rlike(line, F.lit(rf"\A{text.SPACE}*+--"))),
        "\n",
    )


STRIPPERS = {
    "c": strip_c_comments,
    "hash": strip_hash_comments,
    "html": strip_html_comments,
    "css": strip_css_comments,
    "dash": strip_dash_comments,
}


def strip_comments(path: Column, content: Column) -> Column:
    """Strip comments in the style of the path's extension, else identity."""
    ext = paths.extension(path)
    out = None
    for style, extensions in fixed.COMMENT_EXTENSIONS.items():
        test, value = ext.isin(extensions), STRIPPERS[style](content)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(content)


def remove_blank_lines(content: Column) -> Column:
    """Drop lines made of white space only."""
    return F.array_join(F.filter(text.lines(content), lambda line: ~text.is_blank(line)), "\n")


# NUL stands for one elided line while runs are being merged; text that holds a
# NUL is binary and never reaches shaping.
_ELIDED = "\u0000"


def _skeleton(content: Column, keep, marker: str) -> Column:
    body = F.filter(text.lines(content), lambda line: ~text.is_blank(line))
    marked = F.transform(
        body,
        lambda line: F.when(
            keep(line),
            F.regexp_replace(line, text.spaced(r"\{\s*$"), fixed.ELIDED_BODY),
        ).otherwise(F.lit(_ELIDED)),
    )
    merged = F.regexp_replace(F.array_join(marked, "\n"), r"\x00(?:\n\x00)*+", marker)
    return F.when(merged != F.lit(""), merged)


def signatures(path: Column, content: Column) -> Column:
    """Structural lines only, runs of other lines become one marker.

    Null when the extension is unsupported or no line holds text.
    """
    ext = paths.extension(path)
    python = F.lit(text.spaced(fixed.SIGNATURE_PYTHON))
    other = F.lit(text.spaced(fixed.SIGNATURE_OTHER))
    method = F.lit(text.spaced(fixed.SIGNATURE_METHOD))
    return F.when(
        ext == F.lit(".py"),
        _skeleton(content, lambda line: F.rlike(line, python), fixed.ELIDED_PYTHON),
    ).when(
        ext.isin(fixed.SIGNATURE_EXTENSIONS),
        _skeleton(
            content,
            lambda line: F.rlike(line, other) | F.rlike(line, method),
            fixed.ELIDED_OTHER,
        ),
    )


def shape(
    path: Column,
    content: Column,
    compress: bool = False,
    comments: bool = False,
    blank_lines: bool = False,
) -> Column:
    """Skeleton if there is one, else strip comments, then blank lines."""
    out = content
    if comments:
        out = strip_comments(path, out)
    if blank_lines:
        out = remove_blank_lines(out)
    if compress:
        out = F.coalesce(signatures(path, content), out)
    return out
