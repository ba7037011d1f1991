"""Operator 13: phrase collocation mining with merged count-min sketches.

A first reading of the texts puts words into a count-min sketch, a second one the phrases of two words and more whose
words the first sketch holds for frequent. Each task fills a sketch of its own; sketches are cut into pieces, and equal
pieces are added up. A sketch overestimates, so what it puts below the least count is rare for certain. A bit for each
cell goes to the tasks of the third reading, which counts exactly what is left; sums below the least count go there. So
no frequent phrase is lost, however full the sketch is: a fuller one lets more rare phrases into the exact count.

The parts of a frequent phrase are frequent as well, so the exact counts hold all that the scores need.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import CACHE_ENTRIES, CHUNK_CHARS, lowered, materialize, mixed, texts_in

LEAST = 30
MAX_WORDS = 4
#: A phrase is dropped for a longer one that has this share of its occurrences, in percent.
SUBSUMED = 80
MOST = 2_000
SCALE = 2_000_000
UNKNOWN = "und"
#: Rows of a sketch; cells of a row as powers of two: of the sketch of words, and at most of that of phrases. Piece: what is merged at once.
DEPTH, WORD_BITS, MAX_BITS, PIECE_BITS = 2, 24, 26, 16
#: Words for each cell of a row of the phrases' sketch, as long as MAX_BITS allows it.
WORDS_PER_CELL = 6
#: Words of a task that sketches or counts phrases, where there are enough for all cores: each task has a sketch and each frequent phrase once.
WORDS_PER_TASK = 16_000_000
#: Hashes that a task adds to its sketch at once; distinct phrases that it counts before it passes them on.
BUFFERED, COUNTED = 2_000_000, 750_000
#: Tokens that a task takes on at once; a part of a text may go beyond.
RUN = 200_000

_BREAK = ".,;:!?\x0a\x0b\x0c\x0d"
_TOKEN = re.compile(r"[^\x20\x09.,;:!?\x0a-\x0d]+|[.,;:!?\x0a-\x0d]")
_AT_BREAK = re.compile("[.,;:!?\x0a-\x0d]")


class _Hashes(dict):
    """Token to its 64-bit hash, 0 for a character that ends a piece. Forgets everything at CACHE_ENTRIES."""

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[token] = 0 if token in _BREAK else xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass")) or 1
        return value


def parts_of(text: str, most: int = CHUNK_CHARS) -> Iterator[str]:
    """The text in parts of at least ``most`` characters, each but the last up to a character that ends a piece."""
    at = 0
    while len(text) - at > most:
        end = _AT_BREAK.search(text, at + most - 1)
        if end is None:
            break
        yield text[at : end.end()]
        at = end.end()
    yield text[at:]


def tokens_of(text: str) -> list[str]:
    """Words and, as tokens of their own, the characters that end a piece; A-Z lower-cased."""
    return _TOKEN.findall(lowered(text))


@dataclass(frozen=True)
class Sieve:
    """The cells of a sketch that reach the least count, a bit each, row after row."""

    bits: int
    table: np.ndarray

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        ok = np.ones(len(hashes), bool)
        for row in range(DEPTH):
            at = cells_of(hashes, row, self.bits)
            ok &= (self.table[row, at >> np.int64(3)] >> (7 - (at & np.int64(7))).astype(np.uint8)) & np.uint8(1) != 0
        return ok


def cells_of(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((hashes >> np.uint64(32 * row)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def phrase_hashes(words: np.ndarray, marks: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(k, a hash for each place of a phrase of k words and its language's mark), k from 1; places too near the end have none."""
    own = mixed(words ^ marks)
    yield 1, own
    for k in range(2, most + 1):
        own = mixed(own[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[k - 1 :])
        yield k, own


def _whole(inside: np.ndarray, words: int) -> np.ndarray:
    """Places from which so many tokens in a row are marked."""
    n = len(inside) - words + 1
    ok = inside[: max(0, n)].copy()
    for o in range(1, words):
        ok &= inside[o : o + max(0, n)]
    return ok


class Sketch:
    """Count-min sketch whose cells stop at their type's largest value."""

    def __init__(self, bits: int, least: int):
        self.bits, self.cells = bits, np.zeros((DEPTH, 1 << bits), np.uint8 if least < 256 else np.uint32)
        self._waiting: list[np.ndarray] = []
        self._n = 0

    def add(self, hashes: np.ndarray) -> None:
        self._waiting.append(hashes)
        self._n += len(hashes)
        if self._n >= BUFFERED:
            self.flush()

    def add_counts(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        """Distinct hashes, each so many times."""
        top = np.iinfo(self.cells.dtype).max
        for row, own in enumerate(self.cells):
            at, which = np.unique(cells_of(hashes, row, self.bits), return_inverse=True)
            own[at] = np.minimum(own[at] + np.bincount(which, np.minimum(counts, top)).astype(np.int64), top)

    def flush(self) -> None:
        if self._n:
            hashes = np.concatenate(self._waiting)
            top = np.iinfo(self.cells.dtype).max
            for row, own in enumerate(self.cells):
                at, n = np.unique(cells_of(hashes, row, self.bits), return_counts=True)
                own[at] = np.minimum(own[at] + n, top)
        self._waiting, self._n = [], 0

    def pieces(self) -> Iterator[tuple[int, bytes]]:
        """(number, cells) of the pieces that aren't empty."""
        self.flush()
        for k, piece in enumerate(self.cells.reshape(-1, 1 << min(PIECE_BITS, self.bits))):
            at = np.flatnonzero(piece)
            if len(at):
                yield k, packed(at, piece[at])


def packed(at: np.ndarray, values: np.ndarray) -> bytes:
    """Ascending places below 2^16 and their values: bytes of equal meaning stand together, so they compress."""
    gaps = np.diff(at, prepend=0).astype("<u2")
    return zstandard.ZstdCompressor(level=1).compress(gaps.view(np.uint8).reshape(-1, 2).T.tobytes() + values.tobytes())


def unpacked(data: bytes, kind: type) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = len(raw) // (2 + np.dtype(kind).itemsize)
    gaps = np.frombuffer(raw, np.uint8, 2 * n).reshape(2, n).T.copy().view("<u2").ravel()
    return gaps.astype(np.int64).cumsum(), np.frombuffer(raw, kind, n, 2 * n)


class _Run:
    """Tokens of several texts in a row, a break behind each, with their languages."""

    def __init__(self):
        self.tokens: list[str] = []
        self.langs: list[str] = []
        self.ends: list[int] = []

    def add(self, lang: str, part: str) -> None:
        self.tokens += tokens_of(part)
        self.tokens.append("\n")
        self.langs.append(lang)
        self.ends.append(len(self.tokens))

    def by_token(self) -> tuple[list[str], np.ndarray]:
        """The languages, and for each token the number of its own."""
        names: dict[str, int] = {}
        own = [names.setdefault(x, len(names)) for x in self.langs]
        return list(names), np.repeat(own, np.diff([0, *self.ends]))


def _mark(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[_Run]:
    """The texts of the batches (text, lang) in runs of some hundred thousand tokens."""
    run = _Run()
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for at, texts in texts_in(batch):
            for text, lang in zip(texts, langs[at : at + len(texts)], strict=True):
                for part in parts_of(text or ""):
                    run.add(lang, part)
                    if len(run.tokens) >= RUN:
                        yield run
                        run = _Run()
    if run.tokens:
        yield run


def _sketched_words(bits: int, least: int):
    """Tasks that sketch words, and count all words by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, counts, total = Sketch(bits, least), {}, Counter()

        def flush() -> None:
            for lang, own in counts.items():
                words = [w for w in own if w not in _BREAK]
                h = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) or 1 for w in words), np.uint64, len(words))
                n = np.fromiter((own[w] for w in words), np.int64, len(words))
                total[lang] += int(n.sum())
                sketch.add_counts(mixed(h ^ np.uint64(_mark(lang))), n)
            counts.clear()

        for own in _runs(batches):
            begin = 0
            for lang, end in zip(own.langs, own.ends, strict=True):
                counts.setdefault(lang, Counter()).update(own.tokens[begin:end])
                begin = end
            if sum(map(len, counts.values())) >= COUNTED:
                flush()
        flush()
        yield from _pieces(sketch)
        yield _words(total)

    return run


def _pieces(sketch: Sketch) -> Iterator[pa.RecordBatch]:
    for k, cells in sketch.pieces():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([cells], pa.binary()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64())], names=["piece", "cells", "lang", "n"])


def _sketched_phrases(bits: int, least: int, max_words: int, sent):
    """Tasks that sketch the phrases of two words and more whose words all pass the sieve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sketch, sieve = _Hashes(), Sketch(bits, least), sent.value
        for own in _runs(batches):
            h = np.fromiter(map(known.__getitem__, own.tokens), np.uint64, len(own.tokens))
            names, lang = own.by_token()
            marks = np.array([_mark(x) for x in names], np.uint64)[lang]
            for k, hashes in phrase_hashes(h, marks, max_words):
                if k == 1:
                    inside = (h != 0) & sieve.passes(hashes)
                else:
                    sketch.add(hashes[_whole(inside, k)])
        yield from _pieces(sketch)

    return run


def _merged(least: int):
    """Adds up the pieces of one number as they come, and the words of one language; a task holds one piece of each of its numbers."""
    kind = np.uint8 if least < 256 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        words: Counter[str] = Counter()
        for batch in batches:
            for k, cells, lang, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k is None:
                    words[lang] += n
                    continue
                at, more = unpacked(cells, kind)
                own = sums.setdefault(k, np.zeros(1 << PIECE_BITS, kind))
                own[at] = np.minimum(own[at].astype(np.int64) + more, np.iinfo(kind).max)
        for k, cells in sums.items():
            if (full := cells >= least).any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(np.packbits(full).tobytes())], pa.binary()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64())], names=["piece", "cells", "lang", "n"])
        yield _words(words)

    return run


def _words(words: Counter) -> pa.RecordBatch:
    langs = list(words)
    return pa.RecordBatch.from_arrays([pa.nulls(len(langs), pa.int32()), pa.nulls(len(langs), pa.binary()), pa.array(langs, pa.string()), pa.array([words[x] for x in langs], pa.int64())], names=["piece", "cells", "lang", "n"])


def sift(texts: DataFrame, bits: int, least: int, sketched) -> tuple[Sieve, dict[str, int]]:
    """The sieve that the tasks' sketches make together, and the number of words by language.

    The driver gets DEPTH x 2^bits bits at most and a number for each language, whatever the size of texts.
    """
    spark, schema = texts.sparkSession, "piece int, cells binary, lang string, n long"
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged = texts.mapInArrow(sketched, schema).repartition(tasks, F.xxhash64("piece", "lang")).mapInArrow(_merged(least), schema)
    wide = 1 << min(PIECE_BITS, bits)
    table = np.zeros((DEPTH << bits) // wide * (wide // 8), np.uint8).reshape(-1, wide // 8)
    words: Counter[str] = Counter()
    for batch in merged.toArrow().to_batches():
        for k, full, lang, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k is None:
                words[lang] += n
            else:
                table[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(full), np.uint8)[: wide // 8]
    return Sieve(bits, table.reshape(DEPTH, -1)), dict(words)


def _counted(of_words, of_phrases, max_words: int):
    """Tasks that count the phrases that the sieves let pass, by their texts."""

    def rows(counts: dict[str, list[Counter]]) -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            for k, found in enumerate(own):
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array([k] * len(found), pa.int32()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "words", "phrase", "n"])
        counts.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = _Hashes(), {}
        words, phrases = of_words.value, of_phrases.value
        for own in _runs(batches):
            tokens = own.tokens
            h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
            names, lang = own.by_token()
            marks = np.array([_mark(x) for x in names], np.uint64)[lang]
            for k, hashes in phrase_hashes(h, marks, max_words):
                # A phrase can be frequent only if both phrases of one word less in it are.
                at = np.flatnonzero((h != 0) & words.passes(hashes)) if k == 1 else np.flatnonzero(_whole(inside, 2))
                if k > 1:
                    at = at[phrases.passes(hashes[at])]
                inside = np.zeros(len(hashes), bool)
                inside[at] = True
                of = lang[at]
                for x, name in enumerate(names):
                    found = counts.setdefault(name, [Counter() for _ in range(max_words + 1)])[k]
                    mine = at[of == x].tolist()
                    found.update([tokens[i] for i in mine] if k == 1 else [" ".join(tokens[i : i + k]) for i in mine])
            if sum(len(c) for x in counts.values() for c in x) >= COUNTED:
                yield from rows(counts)
        yield from rows(counts)

    return run


def count_phrases(docs: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS, text_col: str = "text", lang_col: str = "lang", word_bits: int = WORD_BITS, max_bits: int = MAX_BITS) -> tuple[DataFrame, dict[str, int]]:
    """(lang, words, phrase, n) of all phrases of 1 to max_words words found at least ``least`` times in their language, and the
    number of all words by language."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    of_words, total = sift(texts, word_bits, least, _sketched_words(word_bits, least))
    first = spark.sparkContext.broadcast(of_words)
    bits = min(max_bits, max(PIECE_BITS, (sum(total.values()) // WORDS_PER_CELL).bit_length()))
    texts = texts.coalesce(max(spark.sparkContext.defaultParallelism, -(-sum(total.values()) // WORDS_PER_TASK)))
    of_phrases, _ = sift(texts, bits, least, _sketched_phrases(bits, least, max_words, first))
    second = spark.sparkContext.broadcast(of_phrases)
    counts = texts.mapInArrow(_counted(first, second, max_words), "lang string, words int, phrase string, n long")
    return materialize(counts.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "phrases"), total


def _exact(column):
    """A number whose products don't overflow."""
    return column.cast("decimal(19,0)")


def score_of():
    """Column: floor(SCALE * a / (l + r)), exact."""
    return F.expr(f"CAST({SCALE} * CAST(a AS decimal(19,0)) AS decimal(38,0)) div (CAST(l AS decimal(19,0)) + CAST(r AS decimal(19,0)))")


def mine_phrases(docs: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS, subsumed: int = SUBSUMED, most: int = MOST, text_col: str = "text", lang_col: str = "lang", max_bits: int = MAX_BITS) -> DataFrame:
    """The ``most`` best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A null text has no words and a null lang is "und". Very long texts go part by part, cut where a piece ends, so no
    phrase is lost. Repeated rows count each. Ties are broken by a and by the phrase's bytes. Other columns are not read,
    whatever their names. An empty table gives no rows. More than 2,147,483,647 words of one text are not foreseen.
    """
    if max_words < 2:
        raise ValueError("a phrase has at least two words")
    spark = docs.sparkSession
    counts, total = count_phrases(docs, least, max_words, text_col, lang_col, max_bits=max_bits)
    found = counts.where("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"))
    cuts = found.select("*", F.split("phrase", " ").alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("left"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("words") - F.col("cut")), " ").alias("right"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    score = score_of()
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("x"))
    longer = found.where("words > 2").select("lang", F.col("a").alias("b"), "words", F.split("phrase", " ").alias("w"))
    longer = longer.select("lang", "b", "words", "w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    longer = longer.select("lang", "b", "size", "w", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    longer = longer.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase")).agg(F.max("b").alias("b"))
    left = scored.join(longer, ["lang", "phrase"], "left").where(F.col("b").isNull() | (100 * _exact(F.col("b")) < subsumed * _exact(F.col("a"))))
    sums = spark.createDataFrame([(k, v) for k, v in total.items()], "lang string, n long")
    best = Window.partitionBy("lang").orderBy(F.col("x.score").desc(), F.col("a").desc(), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    return ranked.join(F.broadcast(sums), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "x.l", "x.r", "n", "x.score")
