"""Document fingerprints by winnowing (op5), in DataFrame functions only.

A text is cut into tokens: words, longer ones in parts of ``TOKEN`` characters.
Every run of ``GRAM`` tokens gets a rolling hash, a polynomial over the token
hashes modulo a prime.  Of every ``WINDOW`` consecutive hashes the smallest is
chosen, the rightmost of equal ones, and kept with its position.  So two texts
that share ``GRAM + WINDOW - 1`` tokens in a row share a chosen hash.

A chosen entry is one number, hash x 2^32 + (2^32 - 1 - position): its minimum
is the smallest hash with the rightmost position.

The edited text takes its tail from the next document.  Documents meet their
successor in blocks of neighbouring ids, and each block borrows the first
document of the next one; the text is shuffled once.  Blocks come from
``SEGMENTS`` quantiles of the ids, each cut evenly into blocks of about
``BLOCK`` rows.  Rows without an id, and those of an id that fills a segment, are
a segment of their own, cut by a digest of the text.

Defined cases: a null text is an empty one; the empty text has an empty
fingerprint; fewer than ``GRAM`` tokens make one hash, fewer than ``WINDOW``
hashes one window; two empty fingerprints are alike (1), an empty and another
one are not (0); rows with equal ids follow each other by text; rows without an
id come first; a single document follows itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packlake.llm.common import bounded
from packlake.session import materialize

TOKEN, GRAM, WINDOW = 8, 4, 8
PRIME, BASE = 2**31 - 1, 1_000_003
LOW = 2**32 - 1
SEGMENTS, BLOCK = 64, 1024


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, computed once however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _later(values: Column, n: int, combine: Callable[[list[Column]], Column]) -> Column:
    """``combine`` over every run of ``n`` neighbours."""
    return F.transform(
        F.slice(values, 1, F.size(values) - (n - 1)), lambda x, i: combine([x, *[F.get(values, i + k) for k in range(1, n)]])
    )


def _rolling(hashes: list[Column]) -> Column:
    out = hashes[0]
    for h in hashes[1:]:
        out = (out * BASE + h) % PRIME
    return out


def chosen(text: Column) -> Column:
    """array<bigint> of chosen entries, in the order of the text."""
    empty = F.array().cast("array<bigint>")
    tokens = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]{1,%d}" % TOKEN), F.lit(0))
    hashed = F.transform(tokens, lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 7), 16, 10).cast("bigint"))

    def grams(h: Column) -> Column:
        short = F.array(F.aggregate(h, F.lit(0).cast("bigint"), lambda a, x: (a * BASE + x) % PRIME))
        return F.when(F.size(h) == 0, empty).when(F.size(h) < GRAM, short).otherwise(_later(h, GRAM, _rolling))

    def entries(g: Column) -> Column:
        return F.transform(g, lambda x, i: F.shiftleft(x, 32).bitwiseOR(F.lit(LOW) - i.cast("bigint")))

    def least(e: Column) -> Column:
        one = F.array(F.array_min(e))
        return F.when(F.size(e) == 0, empty).when(F.size(e) < WINDOW, one).otherwise(F.array_distinct(_later(e, WINDOW, lambda x: F.least(*x))))

    return _let(hashed, lambda h: _let(grams(h), lambda g: _let(entries(g), least)))


def written(entries: Column) -> Column:
    """position:hash, comma-joined."""
    each = F.transform(entries, lambda e: F.concat_ws(":", F.lit(LOW) - e.bitwiseAND(F.lit(LOW)), F.lower(F.hex(F.shiftright(e, 32)))))
    return F.array_join(each, ",")


def likeness(one: Column, other: Column) -> Column:
    """Jaccard similarity of the chosen hashes."""
    hashes = lambda e: F.array_distinct(F.transform(e, lambda x: F.shiftright(x, 32)))

    def share(a: Column, b: Column) -> Column:
        return _let(F.size(F.array_intersect(a, b)), lambda n: F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(n / (F.size(a) + F.size(b) - n)))

    return _let(hashes(one), lambda a: _let(hashes(other), lambda b: share(a, b)))


def _blocks(ids: DataFrame) -> tuple[Callable[[DataFrame], DataFrame], DataFrame]:
    """How to add a row's block (seg, sub), and the rows (doc_id, tie, to_seg, to_sub) that blocks borrow.

    A block is a function of id and tie alone, so that no row meets a table to
    find its own; only one row of each block is looked up, to be lent.
    """
    found = [min(int(c), 2**63 - 1) for c in ids.approxQuantile("doc_id", [k / SEGMENTS for k in range(1, SEGMENTS)], 0.002)]
    hot = {c for c, following in zip(found, found[1:]) if c == following}  # ids that fill a segment get one of their own
    cuts = sorted({*found, *[min(c + 1, 2**63 - 1) for c in hot]})
    bounds = F.array(*[F.lit(c).cast("bigint") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    segment = F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(bounds, lambda b: b <= F.col("doc_id"))))
    spans = {r.seg: r for r in ids.groupBy(segment.alias("seg")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).collect()}
    numbers = sorted(spans) or [0]  # 2 * SEGMENTS + 1 at most
    width = {k: ((r.high or 0) - (r.low or 0) + 1) * BLOCK / r.n for k, r in spans.items()} or {0: 1.0}
    low = {k: r.low or 0 for k, r in spans.items()} or {0: 0}
    pick = lambda values: F.element_at(F.create_map(*[F.lit(x) for k in numbers for x in (k, values[k])]), F.col("seg"))

    def place(rows: DataFrame) -> DataFrame:
        part = F.conv(F.substring("tie", 1, 7), 16, 10).cast("double") / 16**7  # rows of one id follow each other by tie
        exact = F.col("doc_id").cast("decimal(20,0)") - pick(low).cast("decimal(20,0)")  # doubles would mix up neighbours of large ids
        at = F.coalesce(exact.cast("double"), F.lit(0.0)) + part
        return rows.withColumn("seg", segment).withColumn("sub", F.floor(at / pick(width)).cast("bigint"))

    named = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "tie")
    heads = materialize(place(ids).groupBy("seg", "sub").agg(F.min(named).alias("head")))
    last = {r.seg: r["last"] for r in heads.groupBy("seg").agg(F.max("sub").alias("last")).collect()} or {0: 0}
    before = {k: numbers[i - 1] for i, k in enumerate(numbers)}  # the segment before, around the end
    previous = F.lag("sub").over(Window.partitionBy("seg").orderBy("sub"))
    borrowed = heads.select(
        F.col("head.doc_id").alias("doc_id"),
        F.col("head.tie").alias("tie"),
        F.when(previous.isNull(), pick(before)).otherwise(F.col("seg")).alias("to_seg"),
        F.when(previous.isNull(), pick({k: last[before[k]] for k in numbers})).otherwise(previous).alias("to_sub"),
    )
    return place, materialize(borrowed)


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, picked, next_text, next_picked) per row; the next document by ascending id, around the end."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.md5(text.cast("binary")).alias("tie"))
    place, borrowed = _blocks(materialize(base.select("doc_id", "tie")))
    key = {"_id": F.coalesce("doc_id", F.lit(0)), "_none": F.col("doc_id").isNull(), "_tie": F.col("tie")}
    lent = borrowed.withColumns(key).drop("doc_id", "tie")
    met = place(base.withColumns(key)).join(bounded(lent), list(key), "left")
    own = F.struct("seg", "sub", F.lit(0).alias("lent"))
    other = F.struct(F.col("to_seg").alias("seg"), F.col("to_sub").alias("sub"), F.lit(1).alias("lent"))
    to = F.when(F.col("to_seg").isNull(), F.array(own)).otherwise(F.array(own, other))
    spread = met.select("doc_id", "tie", "text", chosen(F.col("text")).alias("picked"), F.explode(to).alias("to")).select("doc_id", "tie", "text", "picked", "to.*")
    order = Window.partitionBy("seg", "sub").orderBy("lent", F.col("doc_id").asc_nulls_first(), "tie")
    paired = spread.withColumns({"next_text": F.lead("text").over(order), "next_picked": F.lead("picked").over(order)})
    return paired.filter("lent = 0").select("doc_id", "text", "picked", "next_text", "next_picked")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row."""
    n = F.char_length("text")
    tail = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - tail), F.substring(F.col("next_text"), F.lit(1), tail))
    changed = with_next(docs).withColumn("edited", edited)
    made = changed.select(
        "doc_id", n.cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "picked", "next_picked", chosen(F.col("edited")).alias("edited_picked")
    )
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(F.col("picked")).alias("fingerprint"),
        written(F.col("edited_picked")).alias("edited_fingerprint"),
        likeness(F.col("picked"), F.col("edited_picked")).alias("near_edited"),
        likeness(F.col("picked"), F.col("next_picked")).alias("near_next"),
    )
