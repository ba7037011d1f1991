"""Operator 12: ranked lexical search over a tiered index.

The index has a row for each document and a column for each tier: the postings of highest impact are in the first one,
those of lowest in the last. Where a tier ends is set for each term by the impacts of all its postings, so terms of few
documents are in the first tier whole. What a posting behind a tier can add at most is the term's residual bound.

A search reads the first tier, adds up what it finds and compares: an item whose unseen documents can't reach its k-th
best sum is settled by the documents that still may. For an item without that proof the next tier is read as well; the
last one leaves nothing open. The scores of an item's documents are added up inside the task that holds the document, so
nothing is shuffled but the best of each task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._common import CHUNK_CHARS, documents_of, forget, lowered, materialize, texts_in

TOP = 50
TIERS = 3
#: A tier before the last takes postings from the highest impact down, as long as they are at most FEW or this share of the term's.
FEW, SHARES = 1_000, (1 / 64, 1 / 8)
#: Impacts are counted in so many bins to find where tiers end; an impact is below 1,000,000.
BINS, IMPACTS = 64, 1_000_000
#: Most characters and items of a block of queries: a block's terms and weights go to all tasks, and the corpus is read once a block.
BLOCK_CHARS, BLOCK_ITEMS = 4_000_000, 4_000
#: An item with more documents than so many times k that may still be among its best isn't settled.
CANDIDATES = 20
#: Sums, of documents times items, that a task holds at once.
CELLS = 2_000_000

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
# Characters at which a text may be cut without cutting a term.
_GAP = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def terms_of(text: str | None) -> list[str]:
    return _TERM.findall(lowered(text)) if text else []


def _parts(text: str, most: int = CHUNK_CHARS) -> Iterator[str]:
    at = 0
    while len(text) - at > most and (end := _GAP.search(text, at + most)):
        yield text[at : end.start()]
        at = end.start()
    yield text[at:]


@dataclass(frozen=True)
class Items:
    """A block of queries: their ids and, term after term, the items that hold it."""

    ids: list[int]
    terms: dict[str, int]
    start: np.ndarray  # of each term's items
    items: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, str | None]]) -> Items:
        by_item: dict[int, set[str]] = {}
        for i, text in rows:
            by_item.setdefault(i, set()).update(terms_of(text))
        ids, terms, held = sorted(by_item), {}, []
        for at, i in enumerate(ids):
            for term in sorted(by_item[i]):
                k = terms.setdefault(term, len(terms))
                if k == len(held):
                    held.append([])
                held[k].append(at)
        return cls(ids, terms, np.cumsum([0, *map(len, held)]), np.array([x for own in held for x in own], np.int64))


def _postings(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.terms.get
        for batch in batches:
            lengths, terms, counts = [], [], []
            for _, texts in texts_in(batch):
                for text in texts:
                    n, found = 0, []
                    for part in _parts(text or ""):
                        words = terms_of(part)
                        n += len(words)
                        found += [k for k in map(number, words) if k is not None]
                    own, tf = np.unique(np.array(found, np.int32), return_counts=True)
                    lengths.append(n)
                    terms.append(own)
                    counts.append(tf)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "length", "terms", "counts"])

    return run


def impact(tf: str, length: str, n: int, total: int) -> str:
    """SQL: what a posting adds for each unit of its term's weight."""
    return f"(1000000000L * {tf}) div (1000L * {tf} + 20L * (100L - 50L + (50L * {length} * {n}L) div {total}L))"


@dataclass(frozen=True)
class Tiers:
    """For each term its weight, the least impact in each tier but the last, and the largest impact behind it."""

    weights: np.ndarray
    cuts: np.ndarray  # tiers - 1 x terms
    residuals: np.ndarray  # tiers x terms; 0 behind the last


def _tiers_of(bins: list[tuple[int, int, int, int]], n_terms: int, n_docs: int, few: int, shares: tuple[float, ...]) -> Tiers:
    """From rows (term, bin, postings, largest impact) of all terms."""
    counts, largest = np.zeros((n_terms, BINS), np.int64), np.zeros((n_terms, BINS), np.int64)
    for term, k, n, top in bins:
        counts[term, k], largest[term, k] = n, top
    df = counts.sum(1)
    weights = np.array([int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * int(x) + 1)))) for x in df], np.int64)
    from_top = counts[:, ::-1].cumsum(1)[:, ::-1]
    cuts, residuals = [], []
    for share in shares:
        fits = from_top <= np.maximum(few, (df * share).astype(np.int64))[:, None]
        first = np.where(fits.any(1), fits.argmax(1), BINS)  # the lowest bin that is still in the tier
        cuts.append(first * (IMPACTS // BINS))
        behind = np.where(np.arange(BINS)[None, :] < first[:, None], largest, 0)
        residuals.append(behind.max(1))
    return Tiers(weights, np.array(cuts, np.int64).reshape(len(shares), n_terms), np.array([*residuals, np.zeros(n_terms)], np.int64))


def _dealt(sent):
    """Splits postings into the tiers' columns: each the terms, then the impacts, as 32-bit numbers; null if none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = sent.value.cuts
        for batch in batches:
            out: list[list[bytes | None]] = [[] for _ in range(len(cuts) + 1)]
            for terms, impacts in zip(batch.column(1), batch.column(2), strict=True):
                t, v = terms.values.to_numpy().astype(np.int32), impacts.values.to_numpy().astype(np.int32)
                tier = (v[None, :] < cuts[:, t]).sum(0)
                for k, own in enumerate(out):
                    at = tier == k
                    own.append(np.concatenate([t[at], v[at]]).tobytes() if at.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.binary()) for x in out)], names=["doc_id", *(f"tier{k}" for k in range(len(out)))])

    return run


class TieredIndex:
    """Postings of all documents for the terms of a block of queries, in tiers by impact."""

    def __init__(self, docs: DataFrame, items: Items, few: int = FEW, shares: tuple[float, ...] = SHARES):
        spark: SparkSession = docs.sparkSession
        self.items, self.spark = items, spark
        sent = spark.sparkContext.broadcast(items)
        words = materialize(docs.mapInArrow(_postings(sent), "doc_id long, length long, terms array<int>, counts array<long>"), "postings")
        n, total = words.where("length > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        self.n, self.total = n, total
        value = impact("tf", "length", n, max(1, total))
        scored = words.where("size(terms) > 0").select("doc_id", "terms", F.expr(f"transform(counts, tf -> {value})").alias("impacts"))
        flat = scored.select(F.explode(F.arrays_zip("terms", "impacts")).alias("p")).select("p.terms", "p.impacts")
        bins = flat.groupBy("terms", F.expr(f"least({BINS - 1}, impacts div {IMPACTS // BINS})").alias("bin")).agg(F.count(F.lit(1)), F.max("impacts"))
        self.tiers = _tiers_of([tuple(r) for r in bins.toLocalIterator()], len(items.terms), n, few, shares)
        self.bounds = spark.sparkContext.broadcast(self.tiers)
        columns = ", ".join(f"tier{k} binary" for k in range(len(shares) + 1))
        self.table = materialize(scored.mapInArrow(_dealt(self.bounds), f"doc_id long, {columns}"), "tiers")
        forget(words)

    def read(self, tiers: int) -> DataFrame:
        """Documents with a posting in the first tiers, and those columns only."""
        names = [f"tier{k}" for k in range(tiers)]
        return self.table.select("doc_id", *names).where(" OR ".join(f"{x} IS NOT NULL" for x in names))

    def residuals(self, tier: int) -> list[int]:
        """What unseen postings behind this tier can add to a document, for each item at most."""
        out = np.zeros(len(self.items.ids), np.int64)
        of_term = np.repeat(self.tiers.weights * self.tiers.residuals[tier], np.diff(self.items.start))
        np.add.at(out, self.items.items, of_term)
        return out.tolist()


def _cells(columns: list[pa.Array], at: int, end: int, items: Items, tiers: Tiers, open_: np.ndarray, less: np.ndarray | None) -> np.ndarray:
    """Sums of documents at..end for all items; with ``less`` each posting counts only by what it is above its term's residual bound."""
    out = np.zeros((end - at, len(items.ids)), np.int64)
    flat = out.reshape(-1)
    rows, terms, values = [], [], []
    for column in columns:
        for k in range(at, end):
            cell = column[k]
            if cell.is_valid:
                own = np.frombuffer(cell.as_buffer(), np.int32)
                half = len(own) // 2
                rows.append(np.full(half, k - at))
                terms.append(own[:half])
                values.append(own[half:])
    if not rows:
        return out
    row, term, value = np.concatenate(rows), np.concatenate(terms), np.concatenate(values).astype(np.int64)
    value = (value - less[term] if less is not None else value) * tiers.weights[term]
    n = items.start[term + 1] - items.start[term]
    ends = np.cumsum(n)
    item = items.items[np.arange(ends[-1]) - np.repeat(ends - n - items.start[term], n)]
    np.add.at(flat, np.repeat(row, n) * len(items.ids) + item, np.repeat(value, n))
    out[:, ~open_] = 0
    return out


def _best(items_sent, tiers_sent, open_items: list[int], floor: list[int], k: int):
    """Each task's k best documents of each open item, by what these tiers add up to; only sums above 0 and from ``floor`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, tiers = items_sent.value, tiers_sent.value
        open_ = np.zeros(len(items.ids), bool)
        open_[open_items] = True
        least = np.maximum(1, np.array(floor, np.int64))
        item, doc, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        null = np.empty(0, bool)
        step = max(1, CELLS // max(1, len(items.ids)))
        for batch in batches:
            ids = batch.column(0)
            nulls, own_ids = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy()
            for at in range(0, batch.num_rows, step):
                end = min(at + step, batch.num_rows)
                sums = _cells(batch.columns[1:], at, end, items, tiers, open_, None)
                r, c = np.nonzero((sums >= least[None, :]) & open_[None, :])
                item, doc, score, null = np.concatenate([item, c]), np.concatenate([doc, own_ids[at + r]]), np.concatenate([score, sums[r, c]]), np.concatenate([null, nulls[at + r]])
                order = np.lexsort((doc, null, -score, item))
                item, doc, score, null = item[order], doc[order], score[order], null[order]
                first = np.searchsorted(item, np.arange(len(items.ids)))
                stay = np.arange(len(item)) - first[item] < k
                item, doc, score, null = item[stay], doc[stay], score[stay], null[stay]
                full = np.flatnonzero(np.bincount(item, minlength=len(items.ids)) >= k)
                if len(full):
                    last = np.searchsorted(item, full, side="right") - 1
                    least[full] = np.maximum(least[full], score[last])
        for at in range(0, len(item), 100_000):
            s = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(item[s], pa.int32()), pa.array(doc[s], pa.int64(), mask=null[s]), pa.array(score[s], pa.int64())], names=["item", "doc_id", "score"])

    return run


def _possible(items_sent, tiers_sent, open_items: list[int], floor: list[int], bounds: list[int], tier: int):
    """(item, doc_id) that these tiers leave a chance: the sum and all that may be unseen reach the floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, tiers = items_sent.value, tiers_sent.value
        open_ = np.zeros(len(items.ids), bool)
        open_[open_items] = True
        least = np.array(floor, np.int64) - np.array(bounds, np.int64)
        step = max(1, CELLS // max(1, len(items.ids)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                end = min(at + step, batch.num_rows)
                sums = _cells(batch.columns[1:], at, end, items, tiers, open_, tiers.residuals[tier])
                r, c = np.nonzero((sums >= least[None, :]) & open_[None, :])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), batch.column(0).take(pa.array(at + r))], names=["item", "doc_id"])

    return run


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    """(item, rank, doc_id, score): equal scores by ascending doc_id, rows without doc_id last."""
    by = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _floors(best: DataFrame, n: int, k: int) -> list[int]:
    """The k-th best sum of each item, 0 where there are fewer: a number for each item of the block."""
    out = [0] * n
    for r in _ranked(best, k).where(F.col("rank") == k).select("item", "score").collect():
        out[r["item"]] = r["score"]
    return out


def search(index: TieredIndex, k: int = TOP, candidates: int = CANDIDATES) -> tuple[DataFrame | None, list[int]]:
    """(item, rank, doc_id, score) of the k best documents of each item, exact, and the tier that settled each item."""
    items, spark = index.items, index.spark
    sent, schema = spark.sparkContext.broadcast(items), "item int, doc_id long, score long"
    columns = len(index.tiers.cuts) + 1
    open_items, floor, parts, settled = list(range(len(items.ids))), [0] * len(items.ids), [], [columns - 1] * len(items.ids)
    for tier in range(columns - 1):
        best = materialize(index.read(tier + 1).mapInArrow(_best(sent, index.bounds, open_items, floor, k), schema), "best")
        floor = [max(a, b) for a, b in zip(floor, _floors(best, len(floor), k), strict=True)]
        forget(best)
        bounds = index.residuals(tier)
        proven = [i for i in open_items if bounds[i] < floor[i]]
        if not proven:
            continue
        chance = materialize(index.read(tier + 1).mapInArrow(_possible(sent, index.bounds, proven, floor, bounds, tier), "item int, doc_id long"), "possible")
        many = {r["item"]: r["count"] for r in chance.groupBy("item").count().collect()}
        proven = [i for i in proven if many.get(i, 0) <= candidates * k]
        if not proven:
            continue
        # At most candidates * k documents for each item of a block: the bound makes the broadcast safe.
        wanted = chance.where(F.col("item").isin(proven)).select("doc_id").distinct()
        rows = index.table.join(F.broadcast(wanted), index.table["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi")
        parts.append(rows.mapInArrow(_best(sent, index.bounds, proven, floor, k), schema))
        done = set(proven)
        open_items = [i for i in open_items if i not in done]
        for i in proven:
            settled[i] = tier
    if open_items:
        parts.append(index.read(columns).mapInArrow(_best(sent, index.bounds, open_items, floor, k), schema))
    out = None
    for part in parts:
        out = part if out is None else out.unionAll(part)
    return (None if out is None else _ranked(out, k)), settled


def _blocks(queries: DataFrame, id_col: str, text_col: str, chars: int, most: int) -> Iterator[list[tuple[int, str | None]]]:
    """Queries in blocks by ascending id; rows that share an id are in one block."""
    block, size, last = [], 0, None
    for row in queries.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("i IS NOT NULL").orderBy("i").toLocalIterator():
        if row["i"] != last and block and (size >= chars or len(block) >= most):
            yield block
            block, size = [], 0
        block.append((row["i"], row["t"]))
        size += len(row["t"] or "")
        last = row["i"]
    if block:
        yield block


def rank_documents(
    docs: DataFrame, queries: DataFrame, k: int = TOP, few: int = FEW, shares: tuple[float, ...] = SHARES, candidates: int = CANDIDATES, block_chars: int = BLOCK_CHARS, block_items: int = BLOCK_ITEMS, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text"
) -> DataFrame:
    """Each query's k documents of highest score: item_id, rank, doc_id, score.

    Null and empty texts have no terms: such documents are never found and count for nothing, such queries find nothing.
    Very long texts are read whole, part by part, cut between terms. Rows that share a doc_id are documents of their
    own; rows without doc_id count and are ranked after others of equal score. Queries that share an id are one query
    with the terms of all; queries without id are left out. Other columns are not read, whatever their names. Empty
    tables give no rows.
    """
    spark = docs.sparkSession
    texts = documents_of(docs, id_col, text_col)
    out = None
    for block in _blocks(queries, query_id, query_text, block_chars, block_items):
        items = Items.of(block)
        if not items.terms:
            continue
        found, _ = search(TieredIndex(texts, items, few, shares), k, candidates)
        if found is None:
            continue
        names = spark.createDataFrame(list(enumerate(items.ids)), "item int, item_id long")
        rows = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = rows if out is None else out.unionAll(rows)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
