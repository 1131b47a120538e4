"""Byte-level BPE by monoid tree reduction (op2).

A text is halved until its parts are short.  A leaf is encoded by the library.
Two neighbours are joined by encoding a window around their border anew:

* Between pieces of the splitting pattern the window runs from the last sure
  border of the left part to the first sure border of the right part.  A border
  is sure where white space follows anything else: every match of the pattern
  ends there, whatever surrounds it, and no match looks behind it.
* Inside one long piece without white space the window starts with one token on
  either side and grows until the two token pairs at its rims are stable.  A
  token sequence is the encoding of its bytes exactly if every neighbouring
  pair is the encoding of its own bytes, and all other pairs were stable before,
  so stable rims prove the joined sequence.

Joining is associative and the empty text is neutral, so the tree may have any
shape.  Decoding concatenates the bytes of the parts up the same tree.

Defined cases: a null text is an empty one; the empty text has no token.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cached_property

import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAF_CHARS = 8192
# White space as the splitting pattern understands it (Unicode White_Space).
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
BORDER = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")


def load_ranks(path: str) -> bytes:
    """The rank file as it is, read once on the driver; its size bounds what is broadcast."""
    with open(path, "rb") as file:
        return file.read()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line.strip())}


class Tree:
    """Encodes and decodes by halves."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF_CHARS):
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.ranks, self.leaf = ranks, leaf

    @cached_property
    def tokens(self) -> dict[int, bytes]:
        return {rank: token for token, rank in self.ranks.items()}

    @cached_property
    def _single(self) -> tiktoken.Encoding:
        """The same merges without a splitting pattern: one piece, whatever it holds."""
        return tiktoken.Encoding("piece", pat_str=r"(?s).+", mergeable_ranks=self.ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        if len(text) <= self.leaf:
            return self.encoding.encode_ordinary(text)
        half = len(text) // 2
        left, right = text[:half], text[half:]
        return self.join(left, self.encode(left), right, self.encode(right))

    def join(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        """Ids of ``left + right`` from the ids of both."""
        start, stop = self._last_border(left), self._first_border(right)
        window = left[start:] + right[:stop]
        if len(window) > 2 * self.leaf:
            return self._join_far(left, left_ids, right, right_ids, start, stop)
        kept_left = left_ids[: len(left_ids) - len(self.encoding.encode_ordinary(left[start:]))]
        kept_right = right_ids[len(self.encoding.encode_ordinary(right[:stop])) :]
        return kept_left + self.encoding.encode_ordinary(window) + kept_right

    def _last_border(self, text: str) -> int:
        span = 64
        while True:
            low = max(0, len(text) - span)
            found = [m.start() for m in BORDER.finditer(text, low)]
            found = [k for k in found if k > 0]
            if found:
                return found[-1]
            if not low:
                return 0
            span *= 4

    @staticmethod
    def _first_border(text: str) -> int:
        found = BORDER.search(text, 1)
        return found.start() if found else len(text)

    def _join_far(self, left: str, left_ids: list[int], right: str, right_ids: list[int], start: int, stop: int) -> list[int]:
        """The window is a long run without white space, or of white space only.

        Its pieces are found anew, but a piece that crosses the border is
        joined from tokens; all others are whole pieces of one of the parts.
        """
        ends = 0
        out: list[int] = []
        window, cut = left[start:] + right[:stop], len(left) - start
        for piece in re_pieces(self.encoding._pat_str, window):
            begins, ends = ends, ends + len(piece)
            if begins < cut < ends:
                a, b = piece[: cut - begins].encode(), piece[cut - begins :].encode()
                out += self.join_bytes(self.encode_bytes(a), self.encode_bytes(b))
            else:
                out += self.encode_bytes(piece.encode())
        kept_left = left_ids[: len(left_ids) - len(self.encoding.encode_ordinary(left[start:]))]
        kept_right = right_ids[len(self.encoding.encode_ordinary(right[:stop])) :]
        return kept_left + out + kept_right

    def encode_bytes(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        if not piece:
            return []
        if len(piece) <= self.leaf:
            return self.encoding._encode_single_piece(piece)
        half = len(piece) // 2
        return self.join_bytes(self.encode_bytes(piece[:half]), self.encode_bytes(piece[half:]))

    def join_bytes(self, left: list[int], right: list[int]) -> list[int]:
        """Join the ids of two halves of one piece: the window grows until its rims are stable."""
        if not left or not right:
            return left + right
        a = b = 1
        while True:
            middle = self.encoding._encode_single_piece(b"".join(self.tokens[t] for t in left[-a:] + right[:b]))
            rim_left = a >= len(left) or self._stable(left[-a - 1], middle[0])
            rim_right = b >= len(right) or self._stable(middle[-1], right[b])
            if rim_left and rim_right:
                return left[:-a] + middle + right[b:]
            a, b = (a if rim_left else min(2 * a, len(left))), (b if rim_right else min(2 * b, len(right)))

    def _stable(self, first: int, second: int) -> bool:
        return self.encoding._encode_single_piece(self.tokens[first] + self.tokens[second]) == [first, second]

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids; halves are concatenated."""
        if len(ids) <= self.leaf:
            return self.encoding.decode_bytes(ids)
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def re_pieces(pattern: str, text: str) -> list[str]:
    import regex

    return regex.findall(pattern, text)


def encode(text: Column, spark: SparkSession, ranks: bytes, pattern: str) -> Column:
    """array<int> of token ids of the whole text."""
    shared = spark.sparkContext.broadcast(ranks)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tree = Tree(parse_ranks(shared.value), pattern)
        for texts in batches:
            yield texts.map(tree.encode)

    return ids(F.coalesce(text, F.lit("")))


def decode(ids: Column, spark: SparkSession, ranks: bytes, pattern: str) -> Column:
    """Bytes of the ids."""
    shared = spark.sparkContext.broadcast(ranks)

    @F.pandas_udf("binary")
    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tree = Tree(parse_ranks(shared.value), pattern)
        for rows in batches:
            yield rows.map(lambda x: tree.decode(list(x)))

    return raw(ids)


def round_trip(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded and decoded, kept as digests."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tree = Tree(parse_ranks(shared.value), pattern)
        for texts in batches:
            rows = []
            for text in texts:
                ids = tree.encode(text)
                listed = ",".join(map(str, ids)).encode()
                rows.append((len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(tree.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digests(F.coalesce("text", F.lit(""))).alias("made")).select("doc_id", "made.*")
