"""Spelling variant grouping by pivotal grams (op13).

Words are the runs of letters of all texts, lower-cased (A-Z only), with their
number of occurrences n.  Two words are near if they differ by exactly one
inserted, deleted or replaced code point.  Near pairs are found without
comparing words with words:

* Bigrams get one global order, the rare ones first.  A word's *prefix* are its
  three first bigrams in that order, with every place where they stand (ties of
  the third included).
* Among the prefix, dynamic programming chooses two disjoint bigrams of least
  total frequency, the word's *pivots*.
* One edit destroys at most one of two disjoint pivots.  The surviving one
  stands in the other word too, and lies in that word's prefix if the prefix
  ends no earlier in the global order.  So each near pair is found by probing
  the pivots of the word whose prefix ends first against the other's prefix.
* Position limits are exact: an edit right of a pivot leaves all up to the
  pivot's end as it is, an edit left of it all from its start.  It is right of
  the first pivot, or else left of the second.  So the first pivot is probed
  with everything up to its end, the second with everything from its start, and
  with each of the three possible lengths.  The key is a 64-bit hash of these.
* Candidates are verified by their edit distance.  Before that, numbers made with
  the keys are compared: beyond the edit's side, two words agree in their last
  two code points or in all but these (first two, for edits on the left).

Keys that very many words share are split into parts of ``PART`` probing words.
Words over ``INLINE`` code points travel as hashes until they are verified, since
a long run of one letter has a key for every place.

``form`` is a word's near word of largest n, if that is at least twice its own;
forms are followed to the ``root`` by pointer doubling, at most log2 log2 n
rounds, since n doubles at each step.

Defined cases: null and empty texts have no runs; a null id counts as an empty
one in the hash; repeated rows count again; runs of any length are words; ties
of n fall to the smaller word in code-point order; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlake.session import materialize

LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT = 5, 3
TYPO_EVERY = 97
KEPT_WORDS = 100_000  # words a task remembers before it hands its counts on
PREFIX, INLINE, PART, ROWS = 3, 64, 1024, 10_000
MODULUS, BASE = 2**61 - 1, 1_000_003
COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
KEYS = pa.schema([("wid", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("last", pa.int32()), ("kind", pa.int32()), ("key", pa.int64()), ("far", pa.int32()), ("near", pa.int32()), ("nearer", pa.int32())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) sums of a task's rows, handed on whenever ``KEPT_WORDS`` words have come together."""
    runs = re.compile(f"[{LETTERS}]{{{LEAST_LENGTH},}}")
    capitals = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
    counts: Counter[str] = Counter()
    for batch in batches:
        for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
            head = zlib.crc32(f"{doc_id}:".encode())
            for run, n in Counter(runs.findall(text)).items():
                word = run.lower() if run.isascii() else run.translate(capitals)
                h = zlib.crc32(word.encode(), head)
                if h % TYPO_EVERY == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < LEAST_LENGTH:
                        continue
                counts[word] += n
            if len(counts) >= KEPT_WORDS:
                yield _batch(list(counts.items()), COUNTS)
                counts.clear()
    yield _batch(list(counts.items()), COUNTS)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words of ``LEAST_LENGTH`` code points or more that occur ``LEAST_COUNT`` times or more."""
    texts = docs.filter(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text"))
    counted = texts.mapInArrow(_count_runs, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def gram_order(words: DataFrame) -> dict[str, tuple[int, int]]:
    """Bigram -> (rank, number of words with it), the rarest first.

    The alphabet has 90 letters after lower-casing, so 8,100 rows at most come to the driver.
    """
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2))))
    counted = words.select(F.explode(grams).alias("gram")).groupBy("gram").count().collect()
    return {r.gram: (rank, r["count"]) for rank, r in enumerate(sorted(counted, key=lambda r: (r["count"], r.gram)))}


def pivots(places: list[int], weights: list[int]) -> tuple[int, int]:
    """Two of the ascending ``places``, two or more apart, of least total weight.

    One step per place: the best single gram that ends before it, and the best
    pair so far.  The leftmost of equal choices is taken.
    """
    single: tuple[int, int] | None = None
    pair: tuple[int, int, int] | None = None
    free = 0  # the next place to enter ``single``
    for place, weight in zip(places, weights):
        while places[free] <= place - 2:
            if single is None or weights[free] < single[0]:
                single = (weights[free], places[free])
            free += 1
        if single is not None and (pair is None or single[0] + weight < pair[0]):
            pair = (single[0] + weight, single[1], place)
    return pair[1], pair[2]


def word_keys(word: str, order: dict[str, tuple[int, int]]) -> tuple[int, list[tuple[int, int, int, int, int | None]]]:
    """The last rank of the word's prefix, and its keys (kind, key, far, near, nearer).

    Kind 0 is probed with, kind 1 is found by.  ``far`` stands for the two code
    points at the end the edit may be at, ``near`` for all others of the shorter
    word.  A found word may turn out the longer one, so it brings ``near`` for
    a partner of its length or more and ``nearer`` for a shorter one; a probe has
    None there unless it looks for a longer word.
    """
    length = len(word)
    grams = [order[word[i : i + 2]] for i in range(length - 1)]
    last = sorted(rank for rank, _ in grams)[PREFIX - 1]
    places = [i for i, (rank, _) in enumerate(grams) if rank <= last]
    first, second = pivots(places, [grams[i][1] for i in places])
    heads, tails = [0] * (length + 1), [0] * (length + 1)  # rolling hashes of all beginnings and ends
    for i, c in enumerate(word):
        heads[i + 1] = (heads[i] * BASE + ord(c) + 1) % MODULUS
    for i in range(length - 1, -1, -1):
        tails[i] = (tails[i + 1] * BASE + ord(word[i]) + 1) % MODULUS
    low = 2**31 - 1
    fars = (tails[length - 2] & low, heads[2] & low)
    nears = ((heads[length - 2] & low, heads[length - 3] & low), (tails[2] & low, tails[3] & low))

    def key(side: int, at: int, size: int) -> int:
        rest = heads[at + 2] if side == 0 else tails[at]
        return ((rest * BASE + size) * 2 + side) % MODULUS

    probes = [(0, key(side, at, length + more), fars[side], nears[side][more < 0], more if more > 0 else None) for side, at in ((0, first), (1, second)) for more in (-1, 0, 1)]
    return last, probes + [(1, key(side, at, length), fars[side], *nears[side]) for at in places for side in (0, 1)]


def _keyed(words: DataFrame, order: dict[str, tuple[int, int]], inline: bool) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for wid, word, n in zip(*[batch.column(c).to_pylist() for c in ("wid", "word", "n")]):
                last, keys = word_keys(word, order)
                for key in keys:
                    out.append((wid, word if inline else None, n, last, *key))
                    if len(out) >= ROWS:
                        yield _batch(out, KEYS)
                        out = []
        yield _batch(out, KEYS)

    return words.mapInArrow(rows, "wid bigint, word string, n bigint, last int, kind int, key bigint, far int, near int, nearer int")


def _links(words: DataFrame, order: dict[str, tuple[int, int]], inline: bool) -> DataFrame:
    """(a, n_a, b, n_b): each near pair among ``words`` (wid, word, n) once."""
    keyed = materialize(_keyed(words, order, inline))
    probes, index = keyed.filter("kind = 0"), keyed.filter("kind = 1")
    parts = F.ceil(F.count(F.lit(1)) / PART).cast("int")
    crowded = materialize(probes.groupBy("key").agg(parts.alias("parts")).filter("parts > 1"))
    carried = ("wid", "word", "n", "last", "far", "near", "nearer")
    probe = probes.join(crowded, "key", "left").select(
        "key",
        F.when(F.col("parts").isNull(), 0).otherwise(F.pmod("wid", F.col("parts"))).cast("int").alias("part"),
        *[F.col(c).alias(f"a_{c}") for c in carried],
    )
    found = index.join(crowded, "key", "left").select(
        "key",
        F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"),
        *[F.col(c).alias(f"b_{c}") for c in carried],
    )
    # a prefix that ends first probes the other; of two that end alike each probes the other
    met = (probe["key"] == found["key"]) & (probe["part"] == found["part"]) & (F.col("a_last") <= F.col("b_last"))
    met &= (F.col("a_far") == F.col("b_far")) | (F.col("a_near") == F.when(F.col("a_nearer").isNull(), F.col("b_near")).otherwise(F.col("b_nearer")))
    verified = F.levenshtein("a_word", "b_word", 1) == 1
    if inline:
        hits = probe.join(found, met & verified)
    else:
        text = words.select("wid", "word")
        hits = (
            probe.join(found, met & (F.col("a_wid") != F.col("b_wid")))
            .select("a_wid", "a_n", "b_wid", "b_n")
            .distinct()
            .join(text.select(F.col("wid").alias("a_wid"), F.col("word").alias("a_word")), "a_wid")
            .join(text.select(F.col("wid").alias("b_wid"), F.col("word").alias("b_word")), "b_wid")
            .filter(verified)
        )
    one, other = F.struct(F.col("a_word").alias("w"), F.col("a_n").alias("n")), F.struct(F.col("b_word").alias("w"), F.col("b_n").alias("n"))
    pair = hits.select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b"))
    return pair.select(F.col("a.w").alias("a"), F.col("a.n").alias("n_a"), F.col("b.w").alias("b"), F.col("b.n").alias("n_b")).distinct()


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each pair of near words of a written table (word, n), with a < b."""
    order = gram_order(words)
    numbered = words.select(F.xxhash64("word").alias("wid"), "word", "n")
    size = F.char_length("word")
    short = _links(numbered.filter(size <= INLINE), order, inline=True)
    long = numbered.filter(size >= INLINE)
    if long.limit(1).count() == 0:
        return short
    # two words of INLINE code points are in both
    return short.unionByName(_links(long, order, inline=False)).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form, by pointer doubling."""
    at = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = materialize(at.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        at = step.select("word", "root")
        if step.filter("moved").limit(1).count() == 0:
            return at


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word."""
    words = materialize(vocabulary(docs))
    pairs = materialize(near_pairs(words))
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("m"))
    )
    best = F.min(F.struct((-F.col("m")).alias("less"), "other"))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.first("n").alias("own"), best.alias("best"))
    taken = -F.col("best.less") >= 2 * F.col("own")
    near = materialize(near.select("word", "n_near", F.when(taken, F.col("best.other")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n")))
    roots = _roots(near.filter(F.col("form").isNotNull()))
    return (
        words.join(near, "word", "left")
        .join(roots, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")
    )
