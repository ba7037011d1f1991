"""Operator 11: toxicity by Levenshtein automata over a lexicon trie, and by the windows around what they find.

The lexicon is learnt: of the prefixes and whole words of a bounded labelled sample those are taken that label 1 has far
oftener than label 0. They make a trie; whole words may be met with errors, prefixes stand for all words that begin so.
A word of a text runs through the automaton of all words within the allowed distance of the trie's entries: its states
are sets of (trie node, errors), made when they are first met. Variants that texts of label 0 hold are no misspellings.

What is found weighs as its entry does, less for each error, less inside quotation marks and more beside other finds in
a window of words. The sums, their share of the text and the densest window give the score by a logistic curve.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import CACHE_ENTRIES, CHUNK_CHARS, bounded_sample, documents_of, held_out, texts_in, words_of

#: Bound of the labelled sample, documents a label, and of the lexicon learnt from it.
MAX_TRAIN_DOCS, MAX_TERMS = 3_000, 2_000
THRESHOLD = 0.5
#: Lengths of the prefixes that may become entries; how often one text counts an entry at most.
SHORTEST, LONGEST, SATURATED = 3, 14, 4
#: An entry has this likelihood ratio statistic, this many documents of label 1, and this ratio of its rates, at least.
MIN_GAIN, MIN_DOCS, MIN_RATIO = 30.0, 3, 3.0
#: Errors that a whole word may be met with, by its length from which they are allowed.
ERRORS = ((9, 2), (5, 1))
#: Factor for each error, factor inside quotation marks, words to either side that are a find's window, gain for each other find there (three at most).
PER_ERROR, QUOTED, WINDOW, BESIDE = 0.5, 0.25, 12, 0.25
#: Quotation marks further apart than so many words aren't a pair.
QUOTATION = 60
FEATURES = 5
#: Strength of the pull of the curve's weights to 0.
RIDGE = 0.3

_END = "\0"
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_OPENS, _CLOSES = "\"'“„«‹‘‚", "\"'”“»›’"
_BLANK = re.compile("[\x20\x09-\x0d]")


def normal(word: str) -> str:
    """Lower-cased, without signs at its ends; signs and digits inside stay, as they may stand for letters."""
    return _EDGES.sub("", word).lower()


def _parts(text: str, most: int = CHUNK_CHARS) -> Iterator[str]:
    at = 0
    while len(text) - at > most and (end := _BLANK.search(text, at + most)):
        yield text[at : end.start()]
        at = end.start()
    yield text[at:]


@dataclass(frozen=True)
class Entry:
    """A whole word, or a prefix that stands for all words that begin with it."""

    text: str
    whole: bool
    weight: float

    @property
    def errors(self) -> int:
        return next((k for length, k in ERRORS if len(self.text) >= length), 0) if self.whole else 0


class Automaton:
    """All words within the allowed distance of the entries of a trie, as states that are made when they are met.

    A state is a set of pairs (node, errors so far): the Levenshtein automaton of the word, walked over the trie.
    """

    def __init__(self, entries: list[Entry]):
        self.entries = entries
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.allowed = [0]
        for k, entry in enumerate(entries):
            node = 0
            for c in [*entry.text]:
                self.allowed[node] = max(self.allowed[node], entry.errors)
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.allowed.append(0)
                node = self.children[node][c]
            self.allowed[node] = max(self.allowed[node], entry.errors)
            self.ends[node].append(k)
        self._clear()

    def __reduce__(self):
        return Automaton, (self.entries,)

    def _clear(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.prefix: list[int | None] = []
        self.start = self._state({0: 0})

    def _state(self, least: dict[int, int]) -> int:
        """The state of these nodes with their errors, and of what is reached from them by leaving letters out; -1 if empty."""
        waiting = list(least.items())
        while waiting:
            node, errors = waiting.pop()
            if least[node] == errors:
                for child in self.children[node].values():
                    if errors < self.allowed[child] and least.get(child, 99) > errors + 1:
                        least[child] = errors + 1
                        waiting.append((child, errors + 1))
        if not least:
            return -1
        own = frozenset(least.items())
        if own not in self.states:
            self.states[own] = len(self.sets)
            self.sets.append(own)
            self.steps.append({})
            found = [k for node, errors in own if errors == 0 for k in self.ends[node] if not self.entries[k].whole]
            self.prefix.append(max(found, key=lambda k: self.entries[k].weight) if found else None)
        return self.states[own]

    def _step(self, state: int, c: str) -> int:
        least: dict[int, int] = {}

        def reach(node: int, errors: int) -> None:
            if errors <= self.allowed[node] and least.get(node, 99) > errors:
                least[node] = errors

        for node, errors in self.sets[state]:
            for letter, child in self.children[node].items():
                if letter == c:
                    if least.get(child, 99) > errors:
                        least[child] = errors
                else:
                    reach(child, errors + 1)
            reach(node, errors + 1)
        return self._state(least)

    def find(self, word: str) -> tuple[int, int] | None:
        """(entry, errors): the fewest errors first, then the heaviest entry; None if the word is within reach of none."""
        if len(self.sets) > CACHE_ENTRIES:
            self._clear()
        state, prefix = self.start, None
        for c in word:
            after = self.steps[state].get(c)
            if after is None:
                after = self.steps[state][c] = self._step(state, c)
            if after < 0:
                state = after
                break
            state = after
            if prefix is None and self.prefix[state] is not None:
                prefix = self.prefix[state]
        best = None if prefix is None else (0, -self.entries[prefix].weight, prefix)
        if state >= 0:
            for node, errors in self.sets[state]:
                for k in self.ends[node]:
                    if self.entries[k].whole and errors <= self.entries[k].errors:
                        own = (errors, -self.entries[k].weight, k)
                        best = own if best is None or own < best else best
        return None if best is None else (best[2], best[0])


@dataclass
class Lexicon:
    """Entries, and the variants of them that are words of their own."""

    entries: list[Entry]
    harmless: frozenset[str] = frozenset()
    curve: tuple[float, ...] = field(default=(0.0,) * FEATURES)
    prior: float = 0.5


class _Words(dict):
    """Word to what it means for the score: (entry, errors, opens a quotation, closes one), or None."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.automaton, self.harmless = Automaton(lexicon.entries), lexicon.harmless

    def __missing__(self, word: str):
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        plain = normal(word)
        found = self.automaton.find(plain) if plain else None
        if found is not None and found[1] and plain in self.harmless:
            found = None
        opens, closes = word[0] in _OPENS, word.rstrip(".,;:!?")[-1:] in _CLOSES and len(word.rstrip(".,;:!?")) > 0
        value = self[word] = (*(found or (None, 0)), opens, closes) if found or opens or closes else None
        return value


def finds_of(text: str | None, words: _Words) -> tuple[int, list[tuple[int, int, int, bool]]]:
    """The number of words, and (place, entry, errors, inside quotation marks) of each find."""
    n, marked = 0, []
    for part in _parts(text or ""):
        own = words_of(part)
        marked += [(n + i, m) for i, m in enumerate(map(words.__getitem__, own)) if m is not None]
        n += len(own)
    out, opened, waiting = [], None, []
    for at, (entry, errors, opens, closes) in marked:
        if opened is not None and at - opened > QUOTATION:
            out += [(*x, False) for x in waiting]
            opened, waiting = None, []
        if opens and opened is None:
            opened = at
        if entry is not None:
            if opened is None:
                out.append((at, entry, errors, False))
            else:
                waiting.append((at, entry, errors))
        if closes and opened is not None and (at > opened or not opens or len(waiting) > 0):
            out += [(*x, True) for x in waiting]
            opened, waiting = None, []
    out += [(*x, False) for x in waiting]
    return n, sorted(out)


def features(n: int, finds: list[tuple[int, int, int, bool]], entries: list[Entry]) -> np.ndarray:
    """What the curve weighs: 1, sum, densest window, share of the text, distinct entries."""
    if not finds:
        return np.array([1.0, 0, 0, 0, 0])
    at = np.array([x[0] for x in finds])
    weight = np.array([entries[k].weight * PER_ERROR**errors * (QUOTED if quoted else 1.0) for _, k, errors, quoted in finds])
    first, last = np.searchsorted(at, at - WINDOW), np.searchsorted(at, at + WINDOW, side="right")
    weight = weight * (1 + BESIDE * np.minimum(3, last - first - 1))
    sums = np.concatenate([[0], weight.cumsum()])
    total = float(weight.sum())
    return np.array([1.0, math.log1p(total), math.log1p(float((sums[last] - sums[first]).max())), math.log1p(1000 * total / max(n, 50)) / 3, math.log1p(len({x[1] for x in finds}))])


def _prefix_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(prefix, count and documents of label 1, of label 0); a whole word ends with a mark of its own."""
    counts: dict[str, list[int]] = {}

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([x[k] for x in counts.values()], pa.int64()) for k in range(4))], names=["term", "n1", "d1", "n0", "d0"])
        counts.clear()
        return out

    for batch in batches:
        labels = batch.column(1).to_pylist()
        for at, texts in texts_in(batch):
            for text, label in zip(texts, labels[at : at + len(texts)], strict=True):
                words: Counter[str] = Counter()
                for part in _parts(text or ""):
                    words.update(words_of(part))
                plain: Counter[str] = Counter()
                for w, n in words.items():
                    plain[normal(w)] += n
                own: Counter[str] = Counter()
                for w, n in plain.items():
                    w = w[:LONGEST] + (_END if len(w) <= LONGEST else "")
                    for k in range(SHORTEST, len(w) + 1):
                        own[w[:k]] += n
                at_label = 0 if label == 1 else 2
                for term, n in own.items():
                    row = counts.get(term)
                    if row is None:
                        row = counts[term] = [0, 0, 0, 0]
                    row[at_label] += min(n, SATURATED)
                    row[at_label + 1] += 1
                if len(counts) >= CACHE_ENTRIES:
                    yield rows()
    yield rows()


def choose_entries(rows: list[tuple[str, int, int, int, int]], n1: int, n0: int, most: int = MAX_TERMS) -> list[Entry]:
    """Entries of the highest gain, none of them a prefix of another one; of equal gain the longer one."""
    scored = []
    for term, a, docs, b, _ in rows:
        rate1, rate0 = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1)
        if docs < MIN_DOCS or rate1 < MIN_RATIO * rate0 or not term.strip(_END):
            continue
        share = (a + b) / (n1 + n0)
        gain = 2 * (a * math.log(a / (share * n1)) + (b * math.log(b / (share * n0)) if b else 0))
        if gain >= MIN_GAIN:
            scored.append((gain, term, math.log(rate1 / rate0)))
    scored.sort(key=lambda x: (-x[0], -len(x[1]), x[1]))
    taken: list[Entry] = []
    terms: set[str] = set()
    inner: set[str] = set()
    for _, term, weight in scored:
        if term in inner or any(term[:k] in terms for k in range(SHORTEST, len(term))):
            continue
        terms.add(term)
        inner.update(term[:k] for k in range(SHORTEST, len(term)))
        taken.append(Entry(term.rstrip(_END), term.endswith(_END), min(weight, 5.0)))
        if len(taken) >= most:
            break
    return taken


def _variants(entries: list[Entry]):
    """Words that are met with errors, of texts of label 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(Lexicon(entries))
        for batch in batches:
            found: set[str] = set()
            for _, texts in texts_in(batch):
                for text in texts:
                    for part in _parts(text or ""):
                        found.update(normal(w) for w in set(words_of(part)) if (m := words[w]) is not None and m[1])
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["word"])

    return run


def _featured(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(lexicon)
        for batch in batches:
            rows = [features(*finds_of(t, words), lexicon.entries).tobytes() for _, texts in texts_in(batch) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["doc_id", "label", "features"])

    return run


def fit_curve(x: np.ndarray, y: np.ndarray, counts: np.ndarray, ridge: float = RIDGE) -> tuple[float, ...]:
    """Logistic regression by Newton's method; the pull to 0 leaves the first weight alone."""
    pull = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (counts * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + pull, x.T @ (counts * (y - p)) - pull @ w)
        w = w + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def fit_lexicon(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_terms: int = MAX_TERMS) -> Lexicon:
    """Learns from labelled documents that aren't held out: at most ``max_docs`` of either label, those whose ids hash lowest.

    Null ids and labels teach nothing; an id with several labels has the rounded mean, a half up. The driver gets the terms
    that pass the bounds, the variants and FEATURES numbers for each document of the sample.
    """
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out("doc_id"))
    own = own.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    of_label = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    sample = bounded_sample(own.where("label = 1"), "doc_id", max_docs).unionAll(bounded_sample(own.where("label = 0"), "doc_id", max_docs))
    # At most 2 * max_docs rows of two numbers: the bound makes the broadcast safe.
    taught = documents_of(docs, id_col, text_col).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "label", "text").persist()
    try:
        n = {r["label"]: r["count"] for r in taught.groupBy("label").count().collect()}
        n1, n0 = n.get(1, 0), n.get(0, 0)
        if not n1 or not n0:
            return Lexicon([], prior=1.0 if n1 else 0.0 if n0 else 0.5)
        counts = taught.mapInArrow(_prefix_counts, "term string, n1 long, d1 long, n0 long, d0 long").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("n1", "d1", "n0", "d0")))
        likely = counts.where((F.col("d1") >= MIN_DOCS) & ((F.col("n1") + 0.5) / (n1 + 1) >= MIN_RATIO * (F.col("n0") + 0.5) / (n0 + 1)))
        likely = likely.orderBy(F.col("n1").desc(), "term").limit(100 * max_terms)
        entries = choose_entries([tuple(r) for r in likely.select("term", "n1", "d1", "n0", "d0").collect()], n1, n0, max_terms)
        if not entries:
            return Lexicon([], prior=of_label.get(1, 0) / max(1, sum(of_label.values())))
        clean = taught.where("label = 0").select("doc_id", "text").mapInArrow(_variants(entries), "word string").distinct()
        lexicon = Lexicon(entries, frozenset(r["word"] for r in clean.collect()))
        rows = taught.mapInArrow(_featured(lexicon), "doc_id long, label int, features binary").toArrow().sort_by("doc_id")
    finally:
        taught.unpersist()
    x = np.frombuffer(b"".join(rows["features"].to_pylist()), np.float64).reshape(-1, FEATURES)
    y = rows["label"].to_numpy().astype(float)
    weights = np.where(y == 1, of_label.get(1, 0) / n1, of_label.get(0, 0) / n0)
    lexicon.curve = fit_curve(x, y, weights * len(y) / weights.sum())
    return lexicon


def _scored(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, curve = _Words(lexicon), np.array(lexicon.curve)
        for batch in batches:
            scores, found = [], []
            for _, texts in texts_in(batch):
                for t in texts:
                    n, finds = finds_of(t, words)
                    found.append(len(finds))
                    scores.append(float(1 / (1 + np.exp(-np.clip(features(n, finds, lexicon.entries) @ curve, -30, 30)))) if lexicon.entries else lexicon.prior)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(found, pa.int64())], names=["doc_id", "score", "n_finds"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Returns doc_id, held_out, score, predicted (1 if score >= threshold) and n_finds, one row for each row.

    Null and empty texts and texts in which nothing is found get the score of no finds. Where no entry is learnt, all get
    the share of label 1 among the labelled documents, one half without labels. Very long texts are read whole, part by
    part. Repeated rows are scored each. A row without doc_id is scored too; it is not held out. Of equal labels the lowest
    id hash is sampled; of equal entries the longer one is taken. Other columns are not read, whatever their names. An
    empty table gives no rows.
    """
    lexicon = fit_lexicon(docs, labels, max_docs, id_col, text_col, label_col)
    scored = documents_of(docs, id_col, text_col).mapInArrow(_scored(lexicon), "doc_id long, score double, n_finds long")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "n_finds")
