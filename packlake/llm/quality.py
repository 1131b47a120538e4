"""Quality classifier by compression (op8).

Two zstandard dictionaries are built from good and from bad labelled text.  A
text that resembles one side compresses better with that side's dictionary, so
the normalised difference of the two compressed sizes tells the sides apart.  A
logistic curve over that difference, the plain compressed size and the length,
fitted on labelled rows that no dictionary has seen, turns it into a
probability.

Only the fit uses a bounded sample: ``per_class`` rows of either label.  The curve
sees their whole texts.  A dictionary is trained on all of a text of up to
``pieces`` pieces of ``piece_chars``, and on that many pieces spread evenly from the
beginning to the end of a longer one.  Scoring compresses every whole text.

Defined cases: a null text is scored as an empty one; an empty text gets the
score of the features 0; with labels of one side only, every score is the share
of label 1; with no labels at all it is 0.5.  Equal texts get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlake.llm.common import fit_logistic, label_counts, labelled_sample, predict_logistic

LEVEL = 3


def _compressors(dictionaries: tuple[bytes, bytes]) -> list:
    made = [zstandard.ZstdCompressionDict(d) for d in dictionaries]
    return [zstandard.ZstdCompressor(level=LEVEL, dict_data=d) for d in made] + [zstandard.ZstdCompressor(level=LEVEL)]


def _features(text: str, compressors: list) -> tuple[float, ...]:
    raw = text.encode("utf-8", "replace")
    if not raw:
        return (0.0,) * 7
    bad, good, plain = (len(c.compress(raw)) for c in compressors)
    n = len(raw)
    difference, ratio, length = (bad - good) / max(bad, good), plain / n, np.log1p(n)
    return (difference, difference * abs(difference), ratio, ratio * ratio, length, difference * length, ratio * length)


def spread_pieces(text: Column, pieces: int, piece_chars: int) -> Column:
    """All of a text in pieces, or ``pieces`` of a longer one, from its first character to its last."""
    n = F.char_length(text)
    every = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(piece_chars))
    apart = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda k: F.floor(k * (n - piece_chars) / max(1, pieces - 1)).cast("int"))
    return F.transform(F.when(n <= pieces * piece_chars, every).otherwise(apart), lambda start: F.substring(text, start + 1, F.lit(piece_chars)))


def _dictionary(pieces: list[str], size: int) -> bytes:
    samples = [raw for raw in (p.encode("utf-8", "replace") for p in pieces) if raw]
    total = sum(map(len, samples))
    for wanted in (size, total // 4, total // 16):  # the trainer wants much more text than dictionary
        try:
            return zstandard.train_dictionary(min(size, wanted), samples).as_bytes()
        except (zstandard.ZstdError, ValueError, MemoryError):
            continue
    return b"".join(samples)[:size] or b"\0" * 8  # too little text: the text itself is the dictionary


def fit(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 4000,
    dictionary_bytes: int = 112_640,
    pieces: int = 3,
    piece_chars: int = 2048,
) -> dict:
    """The two dictionaries and the curve, from a bounded sample of training labels."""
    n0, n1 = label_counts(labels, "quality")
    prior = n1 / (n0 + n1) if n0 + n1 else 0.5
    sample = labelled_sample(docs, labels, "quality", per_class).withColumn("for_curve", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 1)
    # at most per_class rows of either side come to the driver, as the pieces the trainer reads
    cut = spread_pieces(F.col("text"), pieces, piece_chars)
    rows = sample.filter(~F.col("for_curve")).select("doc_id", "y", cut.alias("pieces")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.y, r.pieces))
    if not (any(r.y == 0 for r in rows) and any(r.y == 1 for r in rows)):
        return {"constant": prior}
    made = tuple(_dictionary([p for r in rows if r.y == y for p in r.pieces], dictionary_bytes) for y in (0, 1))

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compressors = _compressors(made)
        for texts in batches:
            yield pd.Series([list(_features(t, compressors)) for t in texts])

    curve = sample.filter("for_curve").select("doc_id", "y", features("text").alias("x")).collect()
    curve.sort(key=lambda r: (r.doc_id, r.y, r.x))
    y = np.array([r.y for r in curve], dtype=float)
    if len(set(y)) < 2:
        return {"constant": prior}
    return {"dictionaries": made, "curve": fit_logistic(np.array([r.x for r in curve]), y, prior)}


def score(text: Column, model: dict) -> Column:
    """Probability that the text is of label 1."""
    if "constant" in model:
        return F.lit(float(model["constant"]))

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compressors = _compressors(model["dictionaries"])
        for texts in batches:
            x = np.array([_features(t, compressors) for t in texts]).reshape(len(texts), 7)
            yield pd.Series(predict_logistic(model["curve"], x))

    return probability.asNondeterministic()(F.coalesce(text, F.lit("")))
