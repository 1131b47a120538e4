"""Token counts.

``pretoken`` and ``chars4`` are native estimates.  ``bpe`` counts exactly for a
given rank file; see :mod:`packlake.operators.bpe`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pretoken(text: Column) -> Column:
    r"""Number of matches of ``[A-Za-z0-9]+|[^A-Za-z0-9\s]``.

    Written as the length of the text after every run is cut to its first
    character and white space is dropped: one pass, no array of matches.
    """
    squeezed = F.regexp_replace(text, r"(?<=[A-Za-z0-9])[A-Za-z0-9]++\s*+|\s++", "")
    return F.length(squeezed).cast("bigint")


def chars4(text: Column) -> Column:
    """One token per four characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("bigint")


MODES = {"pretoken": pretoken, "chars4": chars4}


def count_tokens(text: Column, mode: str = "pretoken") -> Column:
    if mode not in MODES:
        raise ValueError(f"unknown token mode {mode!r}; known: {', '.join(MODES)}")
    return F.coalesce(MODES[mode](text), F.lit(0).cast("bigint"))
