"""Operator 4: best-fit packing of tokenised documents by length patterns.

Pieces are counted by length, so the plan is made from a histogram of at most ``capacity`` numbers,
however many documents there are:

1. patterns of two and three lengths that fill a sequence exactly are enumerated from the lengths that occur;
2. non-negative least squares fits repeat counts of the patterns to the histogram;
3. counts are rounded and cut to what is there; the residual is packed best-fit decreasing, run by run;
4. the plan is a list of runs (length, first rank, how many, first sequence, offset). Each piece knows its rank
   among pieces of its length from counts by partition and a counter within the partition, so no group of equal
   lengths is ever brought together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import CACHE_ENTRIES, documents_of, materialize, texts_in

CAPACITY = 1024
#: Appended to every document.
END_ID = 2
VOCABULARY = "byte_bpe_50k"
#: Added to a fitted count before it is cut to a whole number.
ROUNDINGS = (0.5, 0.25, 0.0)
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("local_rank", pa.int64())])


class IdBytes:
    """Text to its ids as little-endian unsigned 32-bit bytes.

    A run without blanks at either end, and the space before it, is tokenised by itself: the splitting pattern
    of the vocabulary never joins it with a neighbour. So its ids come from a bounded cache. Texts with other
    runs of blanks go to the tokenizer whole.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        import base64

        import public_tokenizers
        import tiktoken

        lines = open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb")
        with lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._runs = _Runs(self.whole)

    def whole(self, text: str) -> bytes:
        return np.array(self._encoding.encode_ordinary(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if text[0].isspace() or text[-1].isspace() or "  " in text or _odd_blanks(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.whole(first) + b"".join(map(self._runs.__getitem__, rest))


class _Runs(dict):
    def __init__(self, encode):
        super().__init__()
        self._encode = encode

    def __missing__(self, run: str) -> bytes:
        value = self._encode(" " + run)
        if len(run) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[run] = value
        return value


#: White space beside U+0020 that may touch a space; a run beside one is not a text of its own.
_BLANK_CHARS = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c != " ")


def _odd_blanks(text: str) -> bool:
    return any((f"{c} " in text or f" {c}" in text) for c in (_BLANK_CHARS if not text.isascii() else _BLANK_CHARS[:9]) if c in text)


def _pieces(capacity: int, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = IdBytes(vocabulary), TaskContext.get().partitionId()
        end = np.array([END_ID], "<u4").tobytes()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for at, texts in texts_in(batch):
                out: list[list] = [[] for _ in _PIECES]
                for i, text in enumerate(texts):
                    data, doc = encode(text or "") + end, ids[at + i].as_py()
                    n = len(data) // 4
                    start, stop, piece = 0, n % capacity or capacity, 0
                    while start < n:
                        for column, value in zip(out, (doc, piece, start, stop - start, zlib.crc32(data[4 * start : 4 * stop]), part, int(seen[stop - start])), strict=True):
                            column.append(value)
                        seen[stop - start] += 1
                        start, stop, piece = stop, stop + capacity, piece + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PIECES, strict=True)], schema=_PIECES)

    return run


def tokenized_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of at most ``capacity`` ids: of a longer document all pieces but the first are full."""
    return documents_of(docs, id_col, text_col).mapInArrow(_pieces(capacity, vocabulary), PIECE_SCHEMA)


def exact_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of three lengths (0: none) that add up to the capacity: all pairs, and all triples, of lengths that occur."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    own = np.flatnonzero(there[:capacity])
    out = [np.stack([own, capacity - own, np.zeros_like(own)], 1)[(own <= capacity - own) & there[capacity - own]]] if len(own) else []
    for a in own[own <= capacity // 3]:
        b = own[(own >= a) & (own <= (capacity - a) // 2)]
        c = capacity - a - b
        b = b[there[c]]
        if len(b):
            out.append(np.stack([np.full_like(b, a), b, capacity - a - b], 1))
    return np.concatenate(out) if out else np.empty((0, 3), np.int64)


def fitted_counts(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths near the histogram in least squares.

    Multiplicative updates, which converge to the optimum. The default rounds stop one or two hundredths of the
    histogram's norm short of it; with twenty times as many the plans of the test tables have as many sequences.
    """
    size = len(histogram)

    def lengths_of(x: np.ndarray) -> np.ndarray:
        total = sum(np.bincount(patterns[:, k], x, size) for k in range(3))
        total[0] = 0
        return total

    wanted = histogram.astype(float)
    wanted[0] = 0
    pull = sum(wanted[patterns[:, k]] for k in range(3))
    x = np.minimum.reduce([np.where(patterns[:, k] > 0, wanted[patterns[:, k]], np.inf) for k in range(3)]) / 3
    for _ in range(rounds):
        made = lengths_of(x)
        x *= pull / np.maximum(sum(made[patterns[:, k]] for k in range(3)), 1e-9)
    return x


def _groups(left: np.ndarray, patterns: np.ndarray, x: np.ndarray, rounding: float, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(sequences, their lengths): patterns by falling count, which is rounded and cut to what is there, then the residual."""
    left = left.copy()
    groups: list[tuple[int, tuple[int, ...]]] = []
    if left[capacity]:
        groups.append((int(left[capacity]), (capacity,)))
        left[capacity] = 0
    for p in np.argsort(-x, kind="stable"):
        repeats = int(x[p] + rounding)
        if not repeats:
            break
        own = [int(v) for v in patterns[p] if v]
        repeats = min(repeats, *(int(left[v]) // own.count(v) for v in own))
        if repeats:
            groups.append((repeats, tuple(own)))
            for v in own:
                left[v] -= repeats
    # Best fit, longest first, on the residual: room[r] holds groups of sequences with r ids of room.
    room: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        n, r = int(left[length]), length
        while n:
            while r < capacity and not room[r]:
                r += 1
            if r >= capacity:
                each = capacity // length
                if n // each:
                    room[capacity - each * length].append((n // each, (length,) * each))
                if n % each:
                    room[capacity - n % each * length].append((1, (length,) * (n % each)))
                break
            count, own = room[r].pop()
            each = r // length
            full = min(count, n // each)
            if full:
                room[r - each * length].append((full, own + (length,) * each))
                n -= full * each
            if full < count and n:  # fewer than `each` are left: one more sequence takes them
                room[r - n * length].append((1, own + (length,) * n))
                full, n = full + 1, 0
            if full < count:
                room[r].append((count - full, own))
    return groups + [g for own in room for g in own]


def packing_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """For each length its runs (first rank, how many, first sequence, offset), and the number of sequences.

    The fitted counts are rounded in several ways; the plan of fewest sequences counts.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        left[length] += n
    patterns = exact_patterns(np.flatnonzero(left[:capacity]), capacity)
    x = fitted_counts(patterns, np.where(np.arange(capacity + 1) < capacity, left, 0)) if len(patterns) else np.zeros(0)
    groups = min((_groups(left, patterns, x, r, capacity) for r in ROUNDINGS), key=lambda own: sum(n for n, _ in own))
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks, sequence = np.zeros(capacity + 1, np.int64), 0
    for count, own in groups:
        offset = 0
        for length in own:
            runs.setdefault(length, []).append((int(ranks[length]), count, sequence, offset))
            ranks[length] += count
            offset += length
        sequence += count
    return runs, sequence


def _placed(runs: dict[int, list[tuple[int, int, int, int]]], names: list[str]):
    flat = {length: np.array(own, np.int64) for length, own in runs.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {f: i for i, f in enumerate(batch.schema.names)}
            length, rank = (batch.column(at[c]).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for v in np.unique(length):
                own, rows = flat[int(v)], np.flatnonzero(length == v)
                k = np.searchsorted(own[:, 0], rank[rows], "right") - 1
                sequence[rows] = own[k, 2] + rank[rows] - own[k, 0]
                offset[rows] = own[k, 3]
            yield pa.RecordBatch.from_arrays([*(batch.column(at[c]) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` ids.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece.
    A null text counts as empty: one piece that holds only the end id. Repeated rows are packed each by itself.
    Very long texts are tokenised whole and cut into pieces; pieces of equal length may change places freely.
    A null doc_id stays null. An empty table gives no rows. Columns besides id and text are not read, whatever their names.
    The driver gets one number for each length and no document.
    """
    pieces = materialize(tokenized_pieces(docs, capacity, vocabulary, id_col, text_col), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = packing_plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("local_rank"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*names, "rank").mapInArrow(_placed(runs, names), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
