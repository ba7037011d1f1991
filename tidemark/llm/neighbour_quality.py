"""Operator 2: quality by nearest-neighbour voting among labelled latent-semantic vectors.

Terms of a document are its words (hashed), hashed trigrams of character classes (letters by case, digits, each
punctuation mark), binned shares that describe repetition, and a term of its own for a text without words. TF-IDF
vectors of a bounded labelled sample give the latent space by truncated singular value decomposition. The labelled
vectors, of bounded count, go to all tasks; every document is projected, its cosine with every labelled vector is
computed in blocks, and the nearest vote with their similarity as weight, times the labelled documents that each of
the sample stands for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import WordHashes, bounded_sample, documents_of, held_out, texts_in, words_of

#: Bound of the labelled sample, documents a label.
MAX_TRAIN_DOCS = 1_500
DIM = 4_096
#: The terms in order: trigrams of classes, words, shares in ranges, and the last one for texts without words.
SHAPES, WORDS, SHARES = 1_984, 2_048, 63
#: Weight of the word terms beside the others, which are of unit length together.
WORD_WEIGHT = 0.5
RANK = 48
NEIGHBOURS = 25
POWER = 8.0
THRESHOLD = 0.3
BLOCK = 256
PART = 1_000_000
_BINS = 10


def _byte_classes() -> np.ndarray:
    table = np.zeros(256, np.int64)
    for i in range(256):
        c = chr(i)
        if i >= 128 or "a" <= c <= "z":
            table[i] = 0
        elif "A" <= c <= "Z":
            table[i] = 1
        elif "0" <= c <= "9":
            table[i] = 2
        elif c == " ":
            table[i] = 3
        elif c == "\n":
            table[i] = 4
        elif i < 32 or i == 127:
            table[i] = 5
        else:
            table[i] = 6 + "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~".index(c)
    return table


_CLASSES = _byte_classes()
_KINDS = int(_CLASSES.max()) + 1
_FOLD = ((np.arange(_KINDS**3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % SHAPES


def _bin(share: float) -> int:
    return min(_BINS - 1, int(share * _BINS))


def term_counts(text: str | None, hashes: WordHashes | None = None) -> np.ndarray:
    """Dampened counts of the DIM terms. Without words only the last term is set.

    A long text goes part by part; each part begins with the two bytes before it, so no trigram is lost or counted twice.
    """
    out = np.zeros(DIM)
    words = words_of(text)
    if not words:
        out[-1] = 1
        return out
    shapes, before = out[:SHAPES], np.empty(0, np.int64)
    for at in range(0, len(text), PART):
        kinds = np.concatenate([before, _CLASSES[np.frombuffer(text[at : at + PART].encode("utf-8", "surrogatepass"), np.uint8)]])
        if len(kinds) >= 3:
            shapes += np.bincount(_FOLD[(kinds[:-2] * _KINDS + kinds[1:-1]) * _KINDS + kinds[2:]], minlength=SHAPES)
        before = kinds[-2:]
    np.sqrt(shapes, out=shapes)
    shapes /= math.sqrt(shapes @ shapes) or 1.0
    own = out[SHAPES : SHAPES + WORDS]
    own += np.bincount((WordHashes() if hashes is None else hashes).array([w.lower() for w in words]) >> np.uint64(53), minlength=WORDS)
    np.sqrt(own, out=own)
    own *= WORD_WEIGHT / math.sqrt(own @ own)
    lines = [x for x in text.split("\n") if x.strip()]
    shares = (
        sum(map(eq, words, words[1:])) / len(words),
        1 - len(set(words)) / len(words),
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, len(text) / len(words) / 20),
        min(1.0, len(words) / max(1, len(lines)) / 100),
    )
    for k, share in enumerate(shares):
        out[SHAPES + WORDS + 12 * k + _bin(share)] = 0.3
    return out


@dataclass(frozen=True)
class NeighbourModel:
    weights: np.ndarray  # of the terms
    space: np.ndarray  # DIM x rank
    vectors: np.ndarray  # labelled x rank, of unit length
    labels: np.ndarray
    counts: np.ndarray  # labelled documents that each of the sample stands for
    neighbours: int = NEIGHBOURS

    def project(self, terms: np.ndarray) -> np.ndarray:
        low = (terms * self.weights).astype(np.float32) @ self.space
        return low / np.maximum(np.linalg.norm(low, axis=1, keepdims=True), 1e-12)

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """Share of the votes of the nearest labelled vectors that label 1 has; where none is similar, the share of label 1 among all labelled documents.

        A vote is the similarity to the power POWER, times the count that the voter stands for. Of vectors equally near at the
        bound, any may vote.
        """
        prior = float(np.average(self.labels, weights=self.counts)) if len(self.labels) else 0.5
        if not len(self.labels) or not len(terms):
            return np.full(len(terms), prior)
        near = self.project(terms) @ self.vectors.T
        k = min(self.neighbours, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, 1), 0).astype(float) ** POWER * self.counts[top]
        total = weight.sum(1)
        return np.where(total > 1e-12, (weight * self.labels[top]).sum(1) / np.maximum(total, 1e-12), prior).clip(0, 1)


def _termed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for at, texts in texts_in(batch):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array([term_counts(t, hashes).astype(np.float32).tobytes() for t in texts], pa.binary())], names=["doc_id", "label", "terms"])


def fit_neighbours(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, rank: int = RANK, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", neighbours: int = NEIGHBOURS) -> NeighbourModel:
    """Learns from labelled documents that aren't held out: at most ``max_docs`` of either label, those whose ids hash lowest.

    Null ids and labels teach nothing; an id with several labels has the rounded mean, a half up.
    """
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out("doc_id"))
    own = own.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    of_label = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    sample = bounded_sample(own.where("label = 1"), "doc_id", max_docs).unionAll(bounded_sample(own.where("label = 0"), "doc_id", max_docs))
    # At most 2 * max_docs rows of two numbers: the bound makes the broadcast safe.
    taught = documents_of(docs, id_col, text_col).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = taught.mapInArrow(_termed, "doc_id long, label int, terms binary").toArrow()
    ids, blobs = rows["doc_id"].to_pylist(), rows["terms"].to_pylist()
    order = sorted(range(len(rows)), key=lambda i: (ids[i], blobs[i]))
    if not len(rows):
        return NeighbourModel(np.ones(DIM), np.zeros((DIM, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0), neighbours)
    terms = np.frombuffer(b"".join(blobs), np.float32).reshape(-1, DIM)[order]
    answer = rows["label"].to_numpy().astype(float)[order]
    counts = np.array([of_label.get(y, 0) / max(1, (answer == y).sum()) for y in (0, 1)])[answer.astype(int)]
    weights = np.log((1 + len(terms)) / (1 + (terms > 0).sum(0))) + 0.2
    x = (terms * weights).astype(np.float32)
    rank = min(rank, *x.shape)
    basis = np.linalg.qr(x.T @ np.random.default_rng(5).standard_normal((len(x), rank + 8)).astype(np.float32))[0]
    for _ in range(4):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    _, _, right = np.linalg.svd(x @ basis, full_matrices=False)
    space = (basis @ right.T[:, :rank]).astype(np.float32)
    low = x @ space
    return NeighbourModel(weights, space, low / np.maximum(np.linalg.norm(low, axis=1, keepdims=True), 1e-12), answer, counts, neighbours)


def _scored(model: NeighbourModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids, out = batch.column(0), []
            for _, texts in texts_in(batch):
                for i in range(0, len(texts), BLOCK):
                    out.append(model.scores(np.stack([term_counts(t, hashes) for t in texts[i : i + BLOCK]])))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(out) if out else [], pa.float64())], names=["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Returns doc_id, held_out, score, predicted (1 if score >= threshold), one row for each row.

    Null texts and texts without words share one term, so labelled ones of that kind decide; where none is labelled,
    they get the share of label 1 among all labelled documents, one half without labels. Very long texts are read
    whole, part by part. Repeated rows are scored each. A row without doc_id is scored too; it is not held out. Of
    equal labels the lowest id hash is sampled; of vectors equally near, any vote. Other columns are not read, whatever
    their names. An empty table gives no rows.
    """
    model = fit_neighbours(docs, labels, max_docs, id_col=id_col, text_col=text_col, label_col=label_col)
    scored = documents_of(docs, id_col, text_col).mapInArrow(_scored(model), "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
