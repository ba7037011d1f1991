"""Operator 9: language proportions of each document by expectation-maximisation over n-gram likelihoods.

Each language has a multinomial over hashed letter trigrams, counted on labelled documents. A document is a mixture
of languages: expectation-maximisation finds the proportions that make its trigrams likeliest. The set of languages
grows from the best single one as long as a further language raises the log likelihood by more than a penalty that
grows with the logarithm of the document's trigram count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import held_out

DIM_BITS = 15
DIM = 1 << DIM_BITS
#: Bound of the labelled sample, documents a language.
MAX_TRAIN_DOCS = 3_000
#: Bound of the distinct languages, which are rows of the table that goes to all tasks; more are an error, none is left out.
MAX_LANGUAGES = 500
PENALTY = 6.0
SMOOTHING = 0.5
ROUNDS = 25
PART = 1_000_000
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Code point to its lower case, 32 where it is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def trigram_counts(text: str) -> np.ndarray:
    """Counts of hashed trigrams of lower-cased letters; runs of other characters are one space. Long texts go part by part."""
    total = np.zeros(DIM, np.int64)
    tail = np.array([32], np.uint32)
    for at in range(0, len(text), PART):
        codes = _letters()[np.frombuffer(text[at : at + PART].encode("utf-32-le", "surrogatepass"), np.uint32)]
        codes = np.concatenate([tail, codes])
        if at + PART >= len(text):
            codes = np.append(codes, np.uint32(32))
        space = codes == 32
        keep = np.ones(len(codes), bool)
        keep[1:] = ~(space[1:] & space[:-1])
        codes = codes[keep]
        if len(codes) >= 3:
            a, b, c = codes[:-2], codes[1:-1], codes[2:]
            key = (a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D) + c * np.uint32(0x27D4EB2F)
            key ^= key >> np.uint32(15)
            key *= np.uint32(0x2C1B3C6D)
            total += np.bincount((key >> np.uint32(32 - DIM_BITS))[b != 32], minlength=DIM)
        tail = codes[-2:]
    return total


@dataclass(frozen=True)
class LanguageModel:
    """languages in order of name; log probabilities, a row for each."""

    languages: tuple[str, ...]
    log_probs: np.ndarray
    penalty: float = PENALTY

    def mixture(self, text: str | None) -> tuple[str, float, list[tuple[str, float]]]:
        """(likeliest language, its share, all shares over 0 by falling share); und and 0 without letters or model."""
        counts = trigram_counts(text) if text else None
        grams = np.flatnonzero(counts) if counts is not None else ()
        if not len(grams) or not self.languages:
            return UNKNOWN, 0.0, []
        n = counts[grams].astype(float)
        logs = self.log_probs[:, grams]
        single = logs @ n
        best = int(single.argmax())
        chosen, shares, value = [best], np.ones(1), single[best]
        if len(self.languages) > 1:
            probs = np.exp(logs - logs.max(0))
            floor = float(logs.max(0) @ n)
            full, _ = _fit(probs, n)
            price = self.penalty * math.log(n.sum() + 1)
            for more in np.argsort(-full, kind="stable"):
                if more in chosen:
                    continue
                theta, likely = _fit(probs[[*chosen, more]], n)
                if likely + floor - value <= price:
                    break
                chosen, shares, value = [*chosen, int(more)], theta, likely + floor
        order = sorted(range(len(chosen)), key=lambda k: (-shares[k], self.languages[chosen[k]]))
        mix = [(self.languages[chosen[k]], float(shares[k])) for k in order]
        return mix[0][0], min(1.0, mix[0][1]), mix


def _fit(probs: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    theta, total = np.full(len(probs), 1 / len(probs)), n.sum()
    for _ in range(rounds):
        new = theta * (probs @ (n / (theta @ probs))) / total
        moved, theta = np.abs(new - theta).max(), new
        if moved < 1e-4:
            break
    return theta, float(n @ np.log(np.maximum(theta @ probs, 1e-300)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            sums[lang] = sums.get(lang, 0) + trigram_counts(cell.as_py())
    for lang, counts in sums.items():
        grams = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int32()), pa.array(counts[grams], pa.int64())], names=["lang", "gram", "n"])


def fit_languages(docs: DataFrame, max_docs: int = MAX_TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", penalty: float = PENALTY) -> LanguageModel:
    """Learns from documents with text, id and language that aren't held out: at most ``max_docs`` a language, by hash of the id."""
    able = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    able = able.where(F.col("_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("_id"))
    sizes = {r["lang"]: r["count"] for r in able.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; is {lang_col} a column of languages?")
    # Of each language, about max_docs rows by hash, a little fewer so that the bound holds.
    share = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 0.95 * max_docs / v) if v > max_docs else 1.0))]) if sizes else None
    if share is None:
        return LanguageModel((), np.zeros((0, DIM)), penalty)
    chosen = able.where(F.pmod(F.xxhash64("_id", F.lit(17)), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    rows = chosen.select("lang", "text").mapInArrow(_counted, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    languages = tuple(sorted(set(rows["lang"].to_pylist())))
    counts = np.zeros((len(languages), DIM))
    place = {k: i for i, k in enumerate(languages)}
    np.add.at(counts, ([place[k] for k in rows["lang"].to_pylist()], rows["gram"].to_numpy()), rows["n"].to_numpy())
    common = counts.sum(0) + 1
    common /= common.sum()
    smooth = SMOOTHING * DIM
    probs = (counts + smooth * common) / (counts.sum(1, keepdims=True) + smooth)
    return LanguageModel(languages, np.log(probs), penalty)


def _judged(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("_text")
            found = [model.mixture(cell.as_py()) for cell in batch.column(at)]
            rest = [i for i in range(batch.num_columns) if i != at]
            mixes = pa.array([[{"lang": a, "share": b} for a, b in f[2]] for f in found], pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), mixes], names=[*(batch.schema.names[i] for i in rest), "_pred", "_score", "_mix"])

    return run


def judge_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Every row of docs as struct _row, with _pred, _score (share of _pred) and _mix (the chosen languages' shares)."""
    from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.col(text_col).cast("string").alias("_text"))
    mix = ArrayType(StructType([StructField("lang", StringType()), StructField("share", DoubleType())]))
    schema = StructType([rows.schema["_row"], StructField("_pred", StringType()), StructField("_score", DoubleType()), StructField("_mix", mix)])
    return rows.mapInArrow(_judged(model), schema)


def identify_languages(docs: DataFrame, max_docs: int = MAX_TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Returns doc_id, held_out, lang_pred, score, languages (array of lang and share), one row for each row.

    lang_pred is ``und`` with score 0 if the text is null or has no letter, or if nothing could be learnt. Rows
    without id or language teach nothing. Repeated rows count each. Ties go to the language first by name. Very long
    texts are read whole, part by part. Other columns are not read, whatever their names. An empty table gives no rows.
    """
    model = fit_languages(docs, max_docs, id_col, text_col, lang_col)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return judge_languages(slim, model).select("_row.doc_id", held_out("_row.doc_id").alias("held_out"), F.col("_pred").alias("lang_pred"), F.col("_score").alias("score"), F.col("_mix").alias("languages"))
