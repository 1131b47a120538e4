"""Toxicity by a lexicon trie and Levenshtein automata (op6).

The lexicon holds insults whose weight, and words and word beginnings whose
presence, the training labels bear out.  It is kept as a trie.  A word of the
text is matched by running the Levenshtein automaton of the word along the
trie.  Each distinct word is matched once per task and remembered.

Every hit is weighed by its context window: quotation marks around it or a word
of reporting near it lower the weight, an address to a person raises it.  A
logistic curve over the summed evidence, fitted on training labels, gives the
score.

The fit reads a bounded sample (``per_class`` rows of either label, whole
texts); scoring reads every whole text.

Defined cases: a null text is an empty one and has no evidence; with labels of
one side only every score is the share of label 1, with none it is 0.5.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlake.llm.common import fit_logistic, label_counts, labelled_sample, predict_logistic

# Insults that labels may confirm, words of reporting, words of address.
SEEDS = (
    "idiot idiots stupid moron morons loser losers pathetic scum worthless trash clown clowns disgusting "
    "dumb imbecile jerk filth garbage vermin "
    "dummkopf idiotin abschaum widerlich trottel depp imbécile crétin ordure débile minable "
    "imbécil estúpido estúpida basura escoria patético inútil"
).split()
REPORTING = set("said says wrote writes quoted quote called quoting sagte schrieb zitat dit écrit citation dijo escribió cita".split())
ADDRESS = set("you your youre du dich dein ihr tu te toi vous tú usted eres he she they".split())
LEET = str.maketrans("013457@$", "oieastas")

WORD = re.compile(r"[\w@$]+")
QUOTES = "\"“”„«»‘’"
WINDOW = 6


class Lexicon:
    """A trie of whole words and of word beginnings, searched exactly and with a bounded edit distance.

    For the edit distance the Levenshtein automata of all entries run along the
    trie at once: a state is a set of (trie node, edits so far, letter awaited
    from an exchange of neighbours).  Transitions are worked out when first
    needed and kept, so that a word costs one table lookup a letter, and most
    words meet the empty state after a few letters.
    """

    def __init__(self, words: dict[str, float], beginnings: dict[str, float], spared: set[str]):
        self.below: list[dict[str, int]] = [{}]
        self.word: dict[int, tuple[float, int]] = {}  # weight, edits allowed
        self.start: dict[int, float] = {}
        self.most: list[int] = [0]  # edits allowed for any entry below the node
        for term, weight in words.items():
            self.word[self._add(term, self.limit(len(term)))] = (weight, self.limit(len(term)))
        for term, weight in beginnings.items():
            self.start[self._add(term, 0)] = weight
        self.spared = spared
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.first = self._state(self._skipped({(0, 0, "")}))

    def _add(self, term: str, edits: int) -> int:
        node = 0
        self.most[0] = max(self.most[0], edits)
        for letter in term:
            if letter not in self.below[node]:
                self.below[node][letter] = len(self.below)
                self.below.append({})
                self.most.append(0)
            node = self.below[node][letter]
            self.most[node] = max(self.most[node], edits)
        return node

    @staticmethod
    def limit(n: int) -> int:
        """Edits allowed for an entry of ``n`` letters."""
        return 0 if n < 5 else 1 if n < 9 else 2

    def exact(self, word: str) -> float:
        """Weight of the word or of its heaviest known beginning."""
        node, best = 0, 0.0
        for letter in word:
            node = self.below[node].get(letter)
            if node is None:
                return best
            best = max(best, self.start.get(node, 0.0))
        return max(best, self.word.get(node, (0.0, 0))[0])

    def _skipped(self, positions: set) -> frozenset:
        """The positions and those that follow by leaving out letters of an entry."""
        todo, out = list(positions), set(positions)
        while todo:
            node, edits, awaited = todo.pop()
            if not awaited:
                for child in self.below[node].values():
                    if edits < self.most[child] and (child, edits + 1, "") not in out:
                        out.add((child, edits + 1, ""))
                        todo.append((child, edits + 1, ""))
        return frozenset(out)

    def _state(self, positions: frozenset) -> int:
        if positions not in self.states:
            self.states[positions] = len(self.sets)
            self.sets.append(positions)
            self.moves.append({})
        return self.states[positions]

    def _move(self, state: int, letter: str) -> int:
        reached = set()
        for node, edits, awaited in self.sets[state]:
            if awaited:
                if letter == awaited:
                    reached.add((node, edits, ""))
                continue
            if edits < self.most[node]:
                reached.add((node, edits + 1, ""))  # a letter too many
            for own, child in self.below[node].items():
                if own == letter:
                    reached.add((child, edits, ""))
                elif edits < self.most[child]:
                    reached.add((child, edits + 1, ""))
                    grandchild = self.below[child].get(letter)
                    if grandchild is not None and edits < self.most[grandchild]:
                        reached.add((grandchild, edits + 1, own))
        to = self.moves[state][letter] = self._state(self._skipped({p for p in reached if p[1] <= self.most[p[0]]}))
        return to

    def near(self, word: str) -> tuple[float, int]:
        """Heaviest entry within its edit limit, and its distance; (0, 0) if there is none."""
        state = self.first
        for letter in word:
            to = self.moves[state].get(letter)
            state = self._move(state, letter) if to is None else to
            if not self.sets[state]:
                return 0.0, 0
        best = (0.0, 0)
        for node, edits, awaited in self.sets[state]:
            if not awaited and node in self.word and edits <= self.word[node][1]:
                best = max(best, (self.word[node][0] * (1 - 0.25 * edits), -edits))
        return best[0], -best[1]

    def weight(self, word: str) -> float:
        found = self.exact(word)
        if found:
            return found
        plain = word.translate(LEET) if not word.isalpha() and any(map(str.isalpha, word)) else word
        if plain != word and (found := self.exact(plain)):
            return 0.9 * found
        if word in self.spared or len(plain) < 4 or not plain.isalpha():
            return 0.0
        return self.near(plain)[0]


class Known(dict):
    """Weights of the words met so far; emptied when it has grown large."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = self.lexicon.weight(word)
        return value


def hits(text: str, known: Known) -> list[tuple[int, float, bool, bool]]:
    """(word position, weight, quoted, addressed) of every hit."""
    lowered = text.lower()
    words = WORD.findall(lowered)
    found = [k for k, w in enumerate(words) if known[w]]
    if not found:
        return []
    at = [m.start() for m in WORD.finditer(lowered)]
    out = []
    for k in found:
        around = words[max(0, k - WINDOW) : k] + words[k + 1 : k + 1 + WINDOW]
        end = at[k] + len(words[k])
        marks = lowered[max(0, at[k] - 60) : at[k]], lowered[end : end + 60]
        quoted = all(any(q in side for q in QUOTES) for side in marks) or any(w in REPORTING for w in around)
        out.append((k, known[words[k]], quoted, any(w in ADDRESS for w in around)))
    return out


def evidence(text: str, known: Known) -> tuple[float, float]:
    """Strongest hit, and the logarithm of all, both weighed by context."""
    weights = [w * (0.6 if quoted else 1.0) * (1.1 if addressed else 1.0) for _, w, quoted, addressed in hits(text, known)]
    return (max(weights, default=0.0), math.log1p(sum(weights)))


def _ratio(n: int, n_all: int, k: int, k_all: int) -> float:
    """Log-likelihood ratio of a term found in ``n`` of ``n_all`` and ``k`` of ``k_all`` texts."""
    p, a, b = (n + k) / (n_all + k_all), n / n_all, k / k_all
    part = lambda x, m, q: (x * math.log(q) if x else 0.0) + ((m - x) * math.log(1 - q) if m > x else 0.0)
    return 2 * (part(n, n_all, a) + part(k, k_all, b) - part(n, n_all, p) - part(k, k_all, p))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, least_ratio: float = 22.0, beginnings: tuple[int, ...] = (4, 5, 6)) -> dict:
    """Lexicon and curve from a bounded sample of training labels."""
    n0, n1 = label_counts(labels, "toxic")
    prior = n1 / (n0 + n1) if n0 + n1 else 0.5
    sample = labelled_sample(docs, labels, "toxic", per_class)

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each word and word beginning with the texts of label 1 that hold it and a count of those of label 0, per task."""
        marked: dict[tuple[int, str], list[int]] = defaultdict(list)
        unmarked: Counter = Counter()
        for batch in batches:
            for doc_id, y, text in zip(batch["doc_id"], batch["y"], batch["text"]):
                words = {w for w in WORD.findall(text.lower()) if w.isalpha()}
                found = [(0, w) for w in words] + [(n, s) for n in beginnings for s in {w[:n] for w in words if len(w) > n}]
                found.append((-1, ""))
                if y:
                    for term in found:
                        marked[term].append(doc_id)
                else:
                    unmarked.update(found)
        keys = list(marked.keys() | unmarked.keys())
        if not keys:
            return
        yield pd.DataFrame(
            {"n": [k[0] for k in keys], "term": [k[1] for k in keys], "texts": [marked.get(k, []) for k in keys], "n0": [unmarked[k] for k in keys]}
        )

    counted = (
        sample.mapInPandas(terms, "n int, term string, texts array<bigint>, n0 bigint")
        .groupBy("n", "term")
        .agg(F.array_sort(F.flatten(F.collect_list("texts"))).alias("texts"), F.sum("n0").alias("n0"))
        .filter((F.col("n") < 0) | (F.size("texts") >= 3) & (F.size("texts") > 8 * F.col("n0")))
        .collect()  # terms of a bounded sample that side with label 1
    )
    total = next((r for r in counted if r.n < 0), None)
    if total is None or not total.texts or not total.n0:
        return {"constant": prior}
    n_marked = len(total.texts)
    # Terms are taken one by one, each for the marked texts that no earlier one explains; so the
    # other words of a marked text, or of its copies, are not taken for insults.
    words = {s: 2.0 for s in SEEDS}
    starts: dict[str, float] = {}
    left = set(total.texts)
    queue = [(-_ratio(len(set(r.texts)), n_marked, r.n0, total.n0), r.n, r.term, r) for r in counted if r.n >= 0]
    heapq.heapify(queue)
    while queue:
        _, n, term, r = heapq.heappop(queue)
        own = left.intersection(r.texts)
        ratio = _ratio(len(own), n_marked, r.n0, total.n0) if len(own) / n_marked > r.n0 / total.n0 else 0.0
        if ratio < least_ratio:
            continue
        if queue and -queue[0][0] > ratio:
            heapq.heappush(queue, (-ratio, n, term, r))
            continue
        weight = min(4.0, math.log(((len(set(r.texts)) + 0.5) / (n_marked + 1)) / ((r.n0 + 0.5) / (total.n0 + 1))))
        (starts if n else words)[term] = weight
        left -= own

    def stray(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Words of unmarked texts that only the edit distance takes for an entry."""
        lexicon, seen = Lexicon(words, starts, set()), set()
        for batch in batches:
            for y, text in zip(batch["y"], batch["text"]):
                if y == 0:
                    seen.update(WORD.findall(text.lower()))
        yield pd.DataFrame({"word": pd.Series(sorted(w for w in seen if w.isalpha() and not lexicon.exact(w) and lexicon.weight(w)), dtype=object)})

    spared = {r.word for r in sample.select("y", "text").mapInPandas(stray, "word string").distinct().collect()}

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Known(Lexicon(words, starts, spared))
        for texts in batches:
            yield pd.Series([list(evidence(t, known)) for t in texts])

    rows = sample.select("doc_id", "y", features("text").alias("x")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.y, r.x))
    curve = fit_logistic(np.array([r.x for r in rows]), np.array([r.y for r in rows], dtype=float), prior)
    return {"words": words, "starts": starts, "spared": spared, "curve": curve}


def score(text: Column, model: dict) -> Column:
    """Probability that the text is of label 1."""
    if "constant" in model:
        return F.lit(float(model["constant"]))

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Known(Lexicon(model["words"], model["starts"], model["spared"]))
        for texts in batches:
            x = np.array([evidence(t, known) for t in texts]).reshape(len(texts), 2)
            yield pd.Series(predict_logistic(model["curve"], x))

    return probability.asNondeterministic()(F.coalesce(text, F.lit("")))
