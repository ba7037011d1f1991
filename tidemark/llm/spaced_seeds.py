"""Operator 10: benchmark decontamination by spaced-seed hashing.

A mask keeps some positions of a window of tokens and ignores the others. The hashes of all benchmark windows under
each mask are joined with those of all training windows; around a hit both texts are compared token by token on the
hit's diagonal. A document holds a passage of an item if ``window`` tokens in a row agree but for ``substitutions``.
The masks are a lossless family for the default window and substitutions: wherever the substitutions fall, some mask
at some shift ignores them all. Items shorter than the window must agree whole, with a proportionate allowance.

The seeds of a benchmark of up to TASK_CHARS characters go to the tasks, which join on the way through the corpus. Of a
larger one the seeds are a table: a bit table of fixed size keeps the corpus windows that can't meet any seed out, the
others are joined with the seeds by a shuffle, and the pairs of document and item that meet are verified. Either way
the corpus is read once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import WordHashes, documents_of, materialize, window_hashes

WINDOW = 12
SUBSTITUTIONS = 2
MASKS = ((0, 1, 3, 5, 6, 7), (0, 1, 2, 6, 8, 9), (0, 5, 6, 9, 10, 11))
#: Items of fewer tokens aren't searched. By default every item with a token is.
MIN_ITEM = 1
#: Most characters of a benchmark whose seeds go to all tasks; the seeds of a larger one are joined by a shuffle.
TASK_CHARS = 4_000_000
#: Bits, as a power of two, of the table that keeps windows without a seed out of that shuffle, and of its pieces.
FILTER_BITS, PIECE_BITS = 27, 16
#: Hits of a document that are listed at once.
LISTED = 500_000
#: Tasks over which the items that meet one document are dealt.
SALTS = 64
# Scripts that are written without blanks between words: Thai and Lao, Burmese, Khmer, kana, Han. Each letter is a token.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_ONE_UNSPACED = re.compile(f"[{_UNSPACED}]")
_TOKEN, _MIXED_TOKEN = re.compile(r"\w+"), re.compile(f"[{_UNSPACED}]|[^\\W{_UNSPACED}]+")


def tokens_of(text: str | None) -> list[str]:
    """Lower-cased runs of word characters; in scripts without blanks each letter by itself."""
    if not text:
        return []
    text = text.lower()
    spaced = text.isascii() or _ONE_UNSPACED.search(text) is None
    return (_TOKEN if spaced else _MIXED_TOKEN).findall(text)


def allowed(length: int, window: int = WINDOW, substitutions: int = SUBSTITUTIONS) -> int:
    """Substitutions in a window of this length; items shorter than the window have a smaller one."""
    return substitutions if length >= window else length * substitutions // window


def lossless(masks: tuple[tuple[int, ...], ...], window: int, substitutions: int) -> bool:
    """Whether every placing of the substitutions in the window is ignored by some mask at some shift."""
    placed = [{s + m for m in mask} for mask in masks for s in range(window - mask[-1])]
    return all(any(not own & set(bad) for own in placed) for bad in combinations(range(window), substitutions))


class Seeds:
    """Items of a benchmark with the hashes of their windows, sorted, and a bit table before the search."""

    def __init__(self, items: list[tuple[int, str | None]], masks=MASKS, window: int = WINDOW, substitutions: int = SUBSTITUTIONS, min_item: int = MIN_ITEM):
        if not lossless(masks, window, substitutions):
            raise ValueError("these masks could miss a passage of this window and so many substitutions")
        self.masks, self.window, self.substitutions = masks, window, substitutions
        hashes = WordHashes()
        self.items = [(i, t) for i, text in items if i is not None and len(t := hashes.array(tokens_of(text))) >= max(1, min_item)]
        by_mask: dict[tuple[int, ...], list[tuple[np.ndarray, int]]] = {}
        for k, (_, t) in enumerate(self.items):
            for mask, keys in item_seeds(t, masks, window, substitutions):
                by_mask.setdefault(mask, []).append((keys, k))
        self.searched = []
        for mask, found in by_mask.items():
            key = np.concatenate([keys for keys, _ in found])
            order = np.argsort(key, kind="stable")
            item = np.concatenate([np.full(len(keys), k) for keys, k in found])
            place = np.concatenate([np.arange(len(keys)) for keys, _ in found])
            shift = np.uint64(64 - min(22, max(8, 4 + len(key).bit_length())))
            table = np.zeros(1 << int(64 - shift), bool)
            table[key >> shift] = True
            self.searched.append((mask, key[order], item[order], place[order], shift, table))

    def diagonals(self, own: np.ndarray) -> np.ndarray:
        """Distinct (item, document position - item position) of all hits as rows, in ascending order. Repetitive texts have
        many hits on few diagonals, so hits are listed part by part."""
        parts = [np.empty(0, np.int64)]
        for mask, keys, item, place, shift, table in self.searched:
            at = window_hashes(own, mask)
            near = np.flatnonzero(table[at >> shift])
            first, last = np.searchsorted(keys, at[near], "left"), np.searchsorted(keys, at[near], "right")
            hit = last > first
            near, first, many = near[hit], first[hit], (last - first)[hit]
            sums = np.concatenate([[0], np.cumsum(many)])
            low = 0
            while low < len(near):
                high = max(low + 1, int(np.searchsorted(sums, sums[low] + LISTED, "right")) - 1)
                entry = np.arange(sums[high] - sums[low]) + np.repeat(first[low:high] - (sums[low:high] - sums[low]), many[low:high])
                # One number for item and diagonal; texts are shorter than 2**40 tokens.
                parts.append(np.unique((item[entry] << 41) + np.repeat(near[low:high], many[low:high]) - place[entry] + (1 << 40)))
                low = high
        code = np.unique(np.concatenate(parts))
        return np.stack([code >> 41, (code & ((1 << 41) - 1)) - (1 << 40)], 1)

    def passages(self, own: np.ndarray) -> dict[int, tuple[int, int, int, int, int]]:
        """Of each item found: (tokens of it that agree, tokens in its windows, first and last+1 document token, tokens of the item) on its best diagonal."""
        best: dict[int, tuple[int, int, int, int, int]] = {}
        for k, group in groupby(self.diagonals(own).tolist(), lambda row: row[0]):
            item, t = self.items[k]
            for _, shift in group:
                found = overlap(own, t, shift, self.window, self.substitutions)
                if found and (item not in best or (found[0], -found[2]) > (best[item][0], -best[item][2])):
                    best[item] = (*found, len(t))
                if found and found[0] == len(t):
                    break  # later diagonals can only agree as well, further on
        return best


def item_seeds(t: np.ndarray, masks=MASKS, window: int = WINDOW, substitutions: int = SUBSTITUTIONS) -> list[tuple[tuple[int, ...], np.ndarray]]:
    """(mask, hash of each window) of an item's tokens. Items shorter than the window have masks of their own over the whole."""
    if len(t) >= window:
        return [(mask, window_hashes(t, mask)) for mask in masks]
    return [(mask, window_hashes(t, mask)[:1]) for mask in _short_masks(len(t), allowed(len(t), window, substitutions))]


def _short_masks(n: int, misses: int) -> tuple[tuple[int, ...], ...]:
    """Masks over a whole item of n tokens; misses + 1 interleaved classes, of which one is free of any so many misses."""
    return tuple(tuple(range(k, n, misses + 1)) for k in range(misses + 1)) if misses else (tuple(range(n)),)


def overlap(own: np.ndarray, t: np.ndarray, shift: int, window: int = WINDOW, substitutions: int = SUBSTITUTIONS) -> tuple[int, int, int, int] | None:
    """What the windows that pass on this diagonal cover together; None if none passes."""
    low, high = max(0, -shift), min(len(t), len(own) - shift)
    size = min(window, len(t))
    if high - low < size:
        return None
    same = t[low:high] == own[low + shift : high + shift]
    sums = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(sums[size:] - sums[:-size] >= size - allowed(len(t), window, substitutions))
    if not len(good):
        return None
    covered = np.zeros(len(same), bool)
    for g in good.tolist():
        covered[g : g + size] = True
    spots = np.flatnonzero(covered)
    return int((same & covered).sum()), int(covered.sum()), int(spots[0] + low + shift), int(spots[-1] + 1 + low + shift)


OUT = "doc_id long, item_id long, matched long, overlap long, item_tokens long, first_token long, end_token long"
_NAMES = ["doc_id", "item_id", "matched", "overlap", "item_tokens", "first_token", "end_token"]


def _rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(7)], names=_NAMES)


def _found(doc: int | None, passages: dict[int, tuple[int, int, int, int, int]]) -> list[tuple]:
    return [(doc, item, matched, covered, tokens, first, end) for item, (matched, covered, first, end, tokens) in passages.items()]


def _searched(seeds: Seeds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for doc, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows += _found(doc, seeds.passages(hashes.array(tokens_of(cell.as_py()))))
            yield _rows(rows)

    return run


def _known(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct (item_id, text) that have both."""
    return benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()


def _fits_a_task(known: DataFrame) -> bool:
    return (known.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0) <= TASK_CHARS


def _listed(known: DataFrame) -> list[tuple[int, str]]:
    """The items of a benchmark that was found to fit a task."""
    return sorted((r["item_id"], r["text"]) for r in known.collect())


# A large benchmark: seeds of both sides are rows (key). The mask is a part of the key.


def _keyed(mask: tuple[int, ...], values: np.ndarray) -> np.ndarray:
    return values ^ np.uint64(hash_of_mask(mask))


def hash_of_mask(mask: tuple[int, ...]) -> int:
    return int(window_hashes(np.array([len(mask), *mask], np.uint64), tuple(range(len(mask) + 1)))[0])


def _item_keys(masks, window: int, substitutions: int, min_item: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            keys, items, sizes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for item, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = hashes.array(tokens_of(cell.as_py()))
                if len(t) >= max(1, min_item):
                    own = np.unique(np.concatenate([_keyed(mask, values) for mask, values in item_seeds(t, masks, window, substitutions)]))
                    keys.append(own)
                    items.append(np.full(len(own), item))
                    sizes.append(np.full(len(own), len(t) if len(t) < window else 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(items)), pa.array(np.concatenate(sizes))], names=["key", "item_id", "short"])

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, bits) from (piece, slot) sorted by piece."""
    piece, table = None, None

    def done() -> pa.RecordBatch:
        n = piece is not None
        return pa.RecordBatch.from_arrays([pa.array([piece] if n else [], pa.int32()), pa.array([np.packbits(table).tobytes()] if n else [], pa.binary())], names=["piece", "bits"])

    for batch in batches:
        pieces, slots = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for p in np.unique(pieces).tolist():
            if p != piece:
                yield done()
                piece, table = p, np.zeros(1 << PIECE_BITS, bool)
            table[slots[pieces == p]] = True
    yield done()


def _bit_table(keys: DataFrame) -> np.ndarray:
    """2 ** FILTER_BITS bits, one for the leading bits of each key: of fixed size, whatever the benchmark's."""
    lead = F.shiftrightunsigned("key", 64 - FILTER_BITS)
    slots = keys.select(F.shiftright(lead, PIECE_BITS).cast("int").alias("piece"), lead.bitwiseAND(F.lit((1 << PIECE_BITS) - 1)).cast("int").alias("slot")).distinct()
    table = np.zeros(((1 << FILTER_BITS - PIECE_BITS), 1 << PIECE_BITS - 3), np.uint8)
    for r in slots.repartition("piece").sortWithinPartitions("piece").mapInArrow(_pieces, "piece int, bits binary").toLocalIterator():
        table[r["piece"]] = np.frombuffer(r["bits"], np.uint8)
    return table.ravel()


def _document_keys(table: np.ndarray, masks: list[tuple[int, ...]]):
    """Of each document row the distinct keys that the bit table lets through, and its text if there are any."""
    lead = np.uint64(64 - FILTER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            kept, keys = [], []
            for k, cell in enumerate(batch.column(2)):
                own = hashes.array(tokens_of(cell.as_py()))
                found = np.unique(np.concatenate([np.empty(0, np.uint64), *(_keyed(mask, window_hashes(own, mask)) for mask in masks)]))
                slot = found >> lead
                found = found[(table[slot >> np.uint64(3)] >> (np.uint64(7) - (slot & np.uint64(7))).astype(np.uint8)) & 1 == 1]
                if len(found):
                    kept.append(k)
                    keys.append(found.view(np.int64))
            at = np.cumsum([0, *map(len, keys)])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(kept, pa.int64())) for c in batch.columns), lists], names=["row", "doc_id", "text", "keys"])

    return run


def _verified(masks, window: int, substitutions: int, min_item: int):
    """Passages of the items that meet a document: sorted by (row, salt), the document comes first (item_id null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, group, doc, text, items = WordHashes(), None, None, None, []

        def done() -> pa.RecordBatch:
            found = Seeds(items, masks, window, substitutions, min_item).passages(hashes.array(tokens_of(text))) if items else {}
            return _rows(_found(doc, found))

        for batch in batches:
            for row, salt, item, own, cell in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), strict=True):
                if (row, salt) != group:
                    yield done()
                    group, doc, text, items = (row, salt), own, cell.as_py(), []
                else:
                    items.append((item, cell.as_py()))
        yield done()

    return run


def _joined(plain: DataFrame, known: DataFrame, masks, window: int, substitutions: int, min_item: int) -> DataFrame:
    known = materialize(known, "items")
    seeds = materialize(known.mapInArrow(_item_keys(masks, window, substitutions, min_item), "key long, item_id long, short long"), "seeds")
    short = sorted(r["short"] for r in seeds.select("short").distinct().collect() if r["short"])  # at most window - 1 numbers
    every = list(dict.fromkeys([*masks, *(m for n in short for m in _short_masks(n, allowed(n, window, substitutions)))]))
    rows = plain.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    keyed = materialize(rows.mapInArrow(_document_keys(_bit_table(seeds), every), "row long, doc_id long, text string, keys array<long>"), "keyed")
    # A key may be in a third of all documents: both sides are distinct in it, so adaptive execution can split the larger one.
    met = keyed.select("row", F.explode("keys").alias("key")).join(seeds.select("key", "item_id").distinct(), "key").select("row", "item_id").distinct()
    met = materialize(met.withColumn("salt", F.pmod(F.xxhash64("item_id"), F.lit(SALTS)).cast("int")), "met")
    texts = known.select(F.col("item_id"), F.lit(None).cast("long").alias("doc_id"), "text")
    asked = met.join(texts, "item_id").select("row", "salt", "item_id", "doc_id", "text")
    heads = met.select("row", "salt").distinct().join(keyed.select("row", "doc_id", "text"), "row").select("row", "salt", F.lit(None).cast("long").alias("item_id"), "doc_id", "text")
    dealt = asked.unionByName(heads).repartition("row", "salt").sortWithinPartitions("row", "salt", F.col("item_id").asc_nulls_first(), "text")
    return dealt.mapInArrow(_verified(masks, window, substitutions, min_item), OUT)


def find_passages(docs: DataFrame, benchmark: DataFrame, masks=MASKS, window: int = WINDOW, substitutions: int = SUBSTITUTIONS, min_item: int = MIN_ITEM, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and item of which it holds a passage: doc_id, item_id, matched (tokens that agree), overlap
    (tokens in its passing windows), item_tokens, first_token, end_token (of the document, on the best diagonal).

    Null and empty texts hold nothing; items without id, without text or of fewer than ``min_item`` tokens aren't
    searched (by default every item with a token is). Items that share an id are one item, of which the text that agrees
    best is reported. Very long texts are searched whole. Repeated documents are reported each; a null doc_id stays
    null. Of equal diagonals the first in the document is reported. Other columns are not read, whatever their names.
    Empty tables give no rows. A benchmark of more than TASK_CHARS characters is joined by a shuffle.
    """
    plain, known = documents_of(docs, id_col, text_col), _known(benchmark, item_col, item_text_col)
    if not _fits_a_task(known):
        return _joined(plain, known, masks, window, substitutions, min_item)
    items = _listed(known)
    spark: SparkSession = docs.sparkSession
    return plain.mapInArrow(_searched(Seeds(items, masks, window, substitutions, min_item)), OUT) if items else spark.createDataFrame([], OUT)


def clean_rows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", min_item: int = MIN_ITEM) -> DataFrame:
    """The rows of docs, with all their columns, that hold no passage of the benchmark."""

    def run(seeds: Seeds, column: int):
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch in batches:
                held = [bool(seeds.passages(hashes.array(tokens_of(cell.as_py())))) for cell in batch.column(column)]
                yield batch.filter(pa.array([not h for h in held], pa.bool_()))

        return go

    known = _known(benchmark, "item_id", "text")
    if _fits_a_task(known):
        items = _listed(known)
        return docs.mapInArrow(run(Seeds(items, min_item=min_item), docs.columns.index(text_col)), docs.schema) if items else docs
    numbered = materialize(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.monotonically_increasing_id().alias("_at")), "numbered")
    plain = numbered.select(F.col("_at").alias("doc_id"), F.col("_row")[text_col].cast("string").alias("text"))
    held = _joined(plain, known, MASKS, WINDOW, SUBSTITUTIONS, min_item).select(F.col("doc_id").alias("_at")).distinct()
    return numbered.join(held, "_at", "left_anti").select("_row.*")
