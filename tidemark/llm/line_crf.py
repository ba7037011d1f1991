"""Operator 5: content and boilerplate lines by a linear-chain conditional random field.

Each line has a vector of shares and marks (symbols, capitals, separators, repetition, length). A chain over the
lines of a document with two states is trained by the exact gradient of its likelihood, on lines of a bounded
sample of labelled documents. Labels are of documents, states of lines: documents of label 1 are content throughout,
the states of lines of label 0 are latent and found by expectation-maximisation, from boilerplate throughout on. Chains
of one state would show no change of state: runs of boilerplate lines are joined into documents of label 1, and such
mixed chains teach with the others. Viterbi decoding marks the lines of every document, and the share of characters in content lines decides
whether the document stays. Base rules on words come first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import BLANKS, bounded_sample, documents_of, held_out, texts_in, words_of

#: Bounds of the labelled sample: documents a label, and lines of a training sequence (longer documents are cut into several).
MAX_TRAIN_DOCS = 1_000
CHAIN_LINES = 32
MIN_SHARE = 0.5
#: Lengths of the runs of boilerplate in mixed chains, taken in turn.
RUNS = (1, 1, 2, 1, 4)
#: Steps of ascent before and after each time that the latent states are found anew.
STEPS = (150, 50, 50)
#: Fixed values of the base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"

# Fixed order: the columns of line_features.
FEATURES = ("bias", "blank", "symbols", "capitals", "digits", "marks", "bars", "repeats", "few words", "words", "many words", "long words", "ends a sentence", "as an earlier line", "first", "distinct", "link", "commas")


def line_features(lines: list[str]) -> np.ndarray:
    """A row of FEATURES for each line of a document."""
    out = np.zeros((len(lines), len(FEATURES)))
    out[:, 0] = 1
    seen: set[str] = set()
    for i, line in enumerate(lines):
        words = words_of(line)
        n = len(words)
        if not n:
            out[i, 1] = 1
            continue
        chars = sum(map(len, words))
        low = line.lower()
        letters = sum(map(str.isupper, words))
        bars = words.count("|")
        row = out[i]
        row[2] = min(1.0, sum(map(line.count, SYMBOLS)) / 2 / n)
        row[3] = letters / n
        row[4] = sum(map(line.count, "0123456789")) / chars
        row[5] = min(1.0, (line.count("!") + line.count("?")) / 2 / n)
        row[6] = min(1.0, 3 * bars / n)
        row[7] = sum(map(eq, words, words[1:])) / n
        row[8] = n <= 3
        row[9] = min(n, 50) / 50
        row[10] = n > 50
        row[11] = min(1.0, chars / n / 20)
        row[12] = words[-1][-1] in ".!?:\"'"
        row[13] = line in seen
        row[14] = i == 0
        row[15] = len(set(words)) / n
        row[16] = "://" in low or "www." in low
        row[17] = min(1.0, 3 * line.count(",") / n)
        seen.add(line)
    return out


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Likeliest states (0 boilerplate, 1 content) of a chain: scores is lines x 2, moves from x to."""
    (m00, m01), (m10, m11) = moves.tolist()
    rows = scores.tolist()
    a, b = rows[0] if rows else (0.0, 0.0)
    back = []
    for s0, s1 in rows[1:]:
        x0, x1, y0, y1 = a + m00, b + m10, a + m01, b + m11
        back.append((x1 > x0, y1 >= y0))
        a, b = (x1 if x1 > x0 else x0) + s0, (y1 if y1 >= y0 else y0) + s1
    state = int(b >= a)
    out = np.empty(len(rows), np.int8)
    for i in range(len(rows) - 1, -1, -1):
        out[i] = state
        if i:
            state = int(back[i - 1][state])
    return out


@dataclass(frozen=True)
class LineModel:
    weights: np.ndarray  # FEATURES x 2
    moves: np.ndarray  # 2 x 2

    def states(self, lines: list[str]) -> np.ndarray:
        return viterbi(line_features(lines) @ self.weights, self.moves)


def _forward_backward(scores: np.ndarray, moves: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of states, of moves, and log partition sums of padded chains (chains x lines x 2); there marks real lines."""
    chains, size, _ = scores.shape
    alpha = np.zeros((chains, size, 2))
    beta = np.zeros((chains, size, 2))
    alpha[:, 0] = scores[:, 0]
    for t in range(1, size):
        step = np.logaddexp(alpha[:, t - 1, :1] + moves[0], alpha[:, t - 1, 1:] + moves[1]) + scores[:, t]
        alpha[:, t] = np.where(there[:, t, None], step, alpha[:, t - 1])
    for t in range(size - 2, -1, -1):
        ahead = scores[:, t + 1] + beta[:, t + 1]
        step = np.logaddexp(ahead[:, :1] + moves[:, 0], ahead[:, 1:] + moves[:, 1])
        beta[:, t] = np.where(there[:, t + 1, None], step, 0)
    total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    single = np.exp(alpha + beta - total[:, None, None]) * there[..., None]
    pair = np.exp(alpha[:, :-1, :, None] + moves + (scores[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None])
    return single, (pair * there[:, 1:, None, None]).sum((0, 1)), total


@dataclass(frozen=True)
class _Chains:
    """Padded chains with the state of each line; all their lines weigh the same."""

    features: np.ndarray  # chains x lines x FEATURES
    states: np.ndarray  # chains x lines x 2, one of two is 1 in real lines
    there: np.ndarray  # chains x lines
    weight: float

    @staticmethod
    def of(chains: list[tuple[np.ndarray, np.ndarray]], weight: float) -> _Chains:
        shape = len(chains), max(len(f) for f, _ in chains)
        features, states, there = np.zeros((*shape, len(FEATURES))), np.zeros((*shape, 2)), np.zeros(shape, bool)
        for i, (f, y) in enumerate(chains):
            features[i, : len(f)], there[i, : len(f)] = f, True
            states[i, np.arange(len(f)), y] = 1
        return _Chains(features, states, there, weight)


def likelihood(theta: np.ndarray, groups: list[_Chains], prior: float) -> tuple[float, np.ndarray]:
    """Mean log likelihood of a line, less the prior's share, and its slope; theta holds the weights, then the moves."""
    k = len(FEATURES)
    w, m = theta[: 2 * k].reshape(k, 2), theta[2 * k :].reshape(2, 2)
    value, slope_w, slope_m, lines = 0.0, np.zeros((k, 2)), np.zeros((2, 2)), 0.0
    for g in groups:
        scores = g.features @ w
        single, pair, total = _forward_backward(scores, m, g.there)
        moved = np.einsum("nta,ntb->ab", g.states[:, :-1], g.states[:, 1:])
        value += g.weight * ((scores * g.states).sum() + (moved * m).sum() - total.sum())
        slope_w += g.weight * np.einsum("ntk,nts->ks", g.features, g.states - single)
        slope_m += g.weight * (moved - pair)
        lines += g.weight * g.there.sum()
    return value / lines - prior / 2 * float(theta @ theta), np.concatenate([slope_w.ravel(), slope_m.ravel()]) / lines - prior * theta


def mixed_chains(content: list[np.ndarray], boilerplate: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each chain of content with a run of lines of one of boilerplate, at its start, inside or at its end in turn."""
    if not boilerplate:
        return []
    first = FEATURES.index("first")
    out = []
    for i, own in enumerate(content):
        other = boilerplate[i % len(boilerplate)]
        size = min(RUNS[i % len(RUNS)], len(other))
        start = (i * 7) % (len(other) - size + 1)
        at = (0, len(own) // 2, len(own), len(own) // 3, 2 * len(own) // 3)[i % 5]
        features = np.concatenate([own[:at], other[start : start + size], own[at:]])
        features[:, first] = 0
        features[0, first] = 1
        out.append((features, np.r_[np.ones(at, np.int64), np.zeros(size, np.int64), np.ones(len(own) - at, np.int64)]))
    return out


def fit_chains(chains: list[tuple[np.ndarray, int]], steps: tuple[int, ...] = STEPS, rate: float = 0.2, prior: float = 1e-4) -> LineModel:
    """Ascends the likelihood of the chains (features, label of their document) and of mixed ones made of them, with Adam.

    Between the rounds of steps the lines of label 0 get the states that Viterbi decoding finds; a chain in which it finds
    no boilerplate stays boilerplate throughout. Chains of content, of label 0 and mixed ones have equal weight together.
    """
    k = len(FEATURES)
    if not chains:
        weights = np.zeros((k, 2))
        weights[0] = 0.0, 1.0
        return LineModel(weights, np.zeros((2, 2)))
    content = [(f, np.ones(len(f), np.int64)) for f, y in chains if y]
    latent = [(f, np.zeros(len(f), np.int64)) for f, y in chains if not y]
    theta, first, second, done = np.zeros(2 * k + 4), 0.0, 0.0, 0
    for more in steps:
        model = LineModel(theta[: 2 * k].reshape(k, 2), theta[2 * k :].reshape(2, 2))
        if done:
            latent = [(f, found if (found := viterbi(f @ model.weights, model.moves).astype(np.int64)).min(initial=1) == 0 else np.zeros(len(f), np.int64)) for f, _ in latent]
        kinds = [content, latent, mixed_chains([f for f, _ in content], [own for f, y in latent if len(own := f[y == 0])])]
        groups = [_Chains.of(own, 1 / sum(len(f) for f, _ in own)) for own in kinds if own]
        for _ in range(more):
            done += 1
            slope = likelihood(theta, groups, prior)[1]
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
            theta = theta + rate * (first / (1 - 0.9**done)) / (np.sqrt(second / (1 - 0.999**done)) + 1e-8)
    return LineModel(theta[: 2 * k].reshape(k, 2), theta[2 * k :].reshape(2, 2))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of whole texts, a row for each chain: at most CHAIN_LINES lines that follow each other."""
    for batch in batches:
        for doc, label, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            features = line_features([x for x in (cell.as_py() or "").split("\n") if x.strip(BLANKS)]).astype(np.float32)
            blobs = [features[i : i + CHAIN_LINES].tobytes() for i in range(0, len(features), CHAIN_LINES)]
            n = len(blobs)
            yield pa.RecordBatch.from_arrays([pa.array([doc] * n, pa.int64()), pa.array([label] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(blobs, pa.binary())], names=["doc_id", "label", "chain", "rows"])


def fit_lines(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> LineModel:
    """Learns from labelled documents that aren't held out: at most ``max_docs`` of either label, those whose ids hash lowest.

    All lines with words teach, in chains of CHAIN_LINES: those of label 1 content, those of label 0 what is found in them.
    Null ids and labels teach nothing. Without labels every line is content.
    """
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out("doc_id"))
    own = own.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    sample = bounded_sample(own.where("label = 1"), "doc_id", max_docs).unionAll(bounded_sample(own.where("label = 0"), "doc_id", max_docs))
    # At most 2 * max_docs rows of two numbers: the bound makes the broadcast safe.
    taught = documents_of(docs, id_col, text_col).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = taught.mapInArrow(_featured, "doc_id long, label int, chain int, rows binary").toPandas().sort_values(["doc_id", "chain"])
    chains = [(np.frombuffer(b, np.float32).reshape(-1, len(FEATURES)).astype(float), int(y)) for b, y in zip(rows["rows"], rows["label"], strict=True)]
    return fit_chains(chains)


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; zeros for a null one."""
    if not text:
        return 0, 0, 0, 0, 0
    words = words_of(text)
    n = len(words)
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(BLANKS):
            seen.add(line)
    repeat = 0
    if n >= 3:
        names: dict[str, int] = {}
        ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
        if len(names) < 2_000_000:
            key = (ids[:-2] * len(names) + ids[1:-1]) * len(names) + ids[2:]
        else:  # two steps, so that the numbers stay below 2**63
            pairs = np.unique(ids[:-1] * len(names) + ids[1:], return_inverse=True)[1]
            key = pairs[:-1] * len(names) + ids[2:]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(n - 2, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        repeat = int(covered.sum())
    return n, sum(map(len, words)), symbols, dup, repeat


def content_share(text: str | None, model: LineModel) -> tuple[float, int, int]:
    """(share of characters in content lines, content lines, lines with words)."""
    lines = [x for x in (text or "").split("\n") if x.strip(BLANKS)]
    if not lines:
        return 0.0, 0, 0
    states = model.states(lines)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    return float(sizes[states == 1].sum() / sizes.sum()), int(states.sum()), len(lines)


def _ruled(model: LineModel, min_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in texts_in(batch):
                base = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 5)
                failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEAT_PERCENT * base[:, 0])
                shares = [content_share(t, model) for t in texts]
                kept = ~failed & (np.array([s[0] for s in shares]) >= min_share)
                columns = [pa.array(base[:, k]) for k in range(5)]
                columns += [pa.array(failed), pa.array(kept), pa.array([s[0] for s in shares], pa.float64()), pa.array([s[1] for s in shares], pa.int64()), pa.array([s[2] for s in shares], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *columns], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share", "n_content_lines", "n_word_lines"])

    return run


def rule_quality(docs: DataFrame, model: LineModel, min_share: float = MIN_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, the five base counts, base_failed, kept, content_share, n_content_lines, n_word_lines, one row for each row.

    Null and empty texts have no words, so they fail the base rules. Lines without words are neither state. Of equal
    scores, content wins. Very long texts are judged whole. Repeated rows and rows without id are judged each. Other
    columns are not read, whatever their names. An empty table gives no rows.
    """
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, n_content_lines long, n_word_lines long"
    return documents_of(docs, id_col, text_col).mapInArrow(_ruled(model, min_share), schema)
