"""Overlaps of intervals of time, half open: pairs, counts for each interval, and the greatest number at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructField, StructType

from tidemark.operators.ranges import RANGES, in_ranges

#: Beginnings that a task holds at once where intervals meet, most ranges of time, and pairs that it returns at once.
HELD, MOST_RANGES, PAIRS = 20_000, 4_096, 100_000
#: Intervals that are dealt to their ranges at once.
DEALT = 1_000


def _whole(rows: DataFrame, start: str, end: str) -> DataFrame:
    return rows.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) < F.col(end)))


def _dealt(own: DataFrame, by: list[str], width: int | None) -> tuple[DataFrame, DataFrame]:
    """(by, _w, _b, _id, _s, _e) of intervals in the bins that they touch, and (by, _w, _b, _id2, _s2, _e2) of their beginnings."""
    # Microseconds of a bin: the greatest power of two up to the length, of which the driver gets a few numbers.
    length = F.unix_micros("_e") - F.unix_micros("_s")
    own = own.withColumn("_w", F.lit(width * 1_000_000).cast("long") if width else F.pow(F.lit(2.0), F.length(F.bin(length)) - 1).cast("long"))
    widths = [width * 1_000_000] if width else [r["_w"] for r in own.select("_w").distinct().collect()]
    place = lambda micros: F.floor(micros / F.col("_w")).cast("long")
    touched = own.withColumn("_b", F.explode(F.sequence(place(F.unix_micros("_s")), place(F.unix_micros("_e") - 1))))
    begins = own.drop("_w").withColumn("_w", F.explode(F.array(*map(F.lit, widths)).cast("array<bigint>"))).withColumn("_b", place(F.unix_micros("_s")))
    return touched, begins.select(*by, "_w", "_b", *(F.col(c).alias(f"{c}2") for c in own.columns if c.startswith("_") and c not in ("_w", "_b")))


def _ranges(own: DataFrame, start: str, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """Instants that cut the beginnings into ranges of about HELD, and the number of blocks of each range: several where one instant has more."""
    micros = F.unix_micros(start)
    got = own.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(micros, [i / MOST_RANGES for i in range(1, MOST_RANGES)], 50_000).alias("c")).first()
    ranges = min(MOST_RANGES, max(1, -(-got["n"] // HELD), min(4 * tasks, got["n"] // 64)))
    cuts, times = np.unique(np.array([got["c"][i * MOST_RANGES // ranges - 1] for i in range(1, ranges)], np.int64), return_counts=True)
    # Beyond MOST_RANGES a range is of several blocks.
    return cuts, np.append(times, 1) * max(1, -(-got["n"] // (ranges * HELD)))


def _to_ranges(cuts: np.ndarray, blocks: np.ndarray):
    """(g, id, s, e) of intervals: once, with an even g, in a block of the range in which they begin; with an odd g in all blocks of the ranges that they touch."""
    firsts = np.concatenate([[0], np.cumsum(blocks)])

    def row(g: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (g, *columns)], names=["g", "id", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), DEALT):
                ids, s, e = (batch.column(k).slice(at, DEALT).to_numpy() for k in range(3))
                low, high = np.searchsorted(cuts, s), np.searchsorted(cuts, e - 1)
                block = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks[low]
                yield row(2 * (firsts[low] + block), ids, s, e)
                many = firsts[high + 1] - firsts[low]
                g = np.arange(many.sum()) + np.repeat(firsts[low] - (np.cumsum(many) - many), many)
                yield row(2 * g + 1, *(np.repeat(c, many) for c in (ids, s, e)))

    return run


_PAIR = ["first_id", "second_id", "overlap_from", "overlap_to"]


def _met():
    """Pairs (first_id, second_id, overlap_from, overlap_to) out of (g, id, s, e, from, to) sorted by (g, s, id): a block's beginnings come first and are held."""

    def joined(held: pa.RecordBatch, own: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        (id2, s2, e2), (ids, s, e) = ([b.column(k).to_numpy() for k in (1, 2, 3)] for b in (held, own))
        n = len(held)
        # Of each interval the beginnings behind its own, by (s, id), and before its end.
        order = np.lexsort((np.arange(n + len(own)) >= n, np.concatenate([id2, ids]), np.concatenate([s2, s])))
        low = np.empty(n + len(own), np.int64)
        low[order] = np.cumsum(order < n)
        low = low[n:]
        many = np.maximum(np.searchsorted(s2, e) - low, 0)
        ends = pa.concat_arrays([own.column(5), held.column(5)])
        sums = np.concatenate([[0], np.cumsum(many)])
        at = 0
        while at < len(own):
            to = max(at + 1, int(np.searchsorted(sums, sums[at] + PAIRS, "right")) - 1)
            a = np.repeat(np.arange(at, to), many[at:to])
            b = np.arange(sums[at], sums[to]) - sums[a] + low[a]
            other = ids[a] != id2[b]
            a, b = a[other], b[other]
            at = to
            if len(a):
                x, y = ids[a], id2[b]
                end = ends.take(pa.array(np.where(e[a] <= e2[b], a, len(own) + b)))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), held.column(4).take(pa.array(b)), end], names=_PAIR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, held = None, [], None
        for batch in batches:
            groups = batch.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(groups)) + 1, [len(groups)]]).tolist()
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                g, own = int(groups[low]), batch.slice(low, high - low)
                if g >> 1 != block:
                    block, parts, held = g >> 1, [], None
                if not g & 1:
                    parts.append(own)
                elif parts:
                    if held is None:
                        held = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                    yield from joined(held, own)

    return run


def _swept(rows: DataFrame, id_col: str, start: str, end: str, shown: Callable[[str], Column]) -> DataFrame:
    spark, number = rows.sparkSession, F.col(id_col).cast("long")
    own = _whole(rows, start, end).where(F.col(id_col).isNotNull()).select(F.col(id_col), F.col(start), F.col(end))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts, blocks = _ranges(own, start, tasks)
    dealt = own.select(number.alias("id"), F.unix_micros(start).alias("s"), F.unix_micros(end).alias("e")).mapInArrow(_to_ranges(cuts, blocks), "g long, id long, s long, e long")
    # As many tasks as are asked for, however small the blocks: it is the pairs that take time.
    dealt = dealt.repartition(tasks, F.shiftright("g", 1)).sortWithinPartitions("g", "s", "id")
    # Named as in rows for ``shown``; what is carried has a name that none of them has.
    carried = next(f"_{k}" for k in range(3) if f"_{k}" not in (start, end))
    instants = dealt.select(F.struct("g", "id", "s", "e").alias(carried), *(F.timestamp_micros(c).cast(own.schema[n].dataType).alias(n) for c, n in (("s", start), ("e", end))))
    seen = instants.select(*(F.col(carried)[c].alias(c) for c in ("g", "id", "s", "e")), shown(start).alias("_from"), shown(end).alias("_to"))
    schema = StructType([StructField(name, seen.schema[c].dataType) for name, c in zip(_PAIR, ("id", "id", "_from", "_to"), strict=True)])
    return seen.mapInArrow(_met(), schema).select(*(F.col(c).cast(own.schema[id_col].dataType).alias(c) for c in ("first_id", "second_id")), "overlap_from", "overlap_to")


def overlap_pairs(rows: DataFrame, id_col: str, start: str, end: str, by: list[str] | None = None, width: int | None = None, shown: Callable[[str], Column] = F.col) -> DataFrame:
    """(by, first_id, second_id, overlap_from, overlap_to) of pairs of intervals that overlap, each pair once; first_id is the smaller.

    An overlap begins where one of the two begins while the other is open. Without ``by`` and ``width``, and with whole
    numbers for ids, the instants are cut into ranges of about equal counts of beginnings. An interval goes to each range
    that it touches, as three numbers in one shuffle; a task holds the beginnings of a range, or of a block of them where
    many begin at one instant, and the intervals pass by them in batches. Else an interval is open in each bin that it
    touches and begins in one, so a pair meets there and nowhere else. Bins are of ``width`` seconds, or, if that is not
    given, as long as the greatest power of two up to the interval's length: it is in three of them at most and meets
    little besides what overlaps it, long or short, and a beginning is looked for once for each such length that there is.
    Empty and unbounded intervals, and rows with a null key, overlap with nothing. Rows of one id are intervals of their
    own and no pair with each other. ``shown`` makes what is returned of an instant, once for each interval and range or
    bin, and not for each pair.
    """
    by = by or []
    if not by and width is None and isinstance(rows.schema[id_col].dataType, IntegralType):
        return _swept(rows, id_col, start, end, shown)
    own = _whole(rows, start, end).select(*by, F.col(id_col).alias("_id"), F.col(start).alias("_s"), F.col(end).alias("_e"), shown(start).alias("_from"), shown(end).alias("_to"))
    touched, begins = _dealt(own, by, width)
    later = (F.col("_s") < F.col("_s2")) | ((F.col("_s") == F.col("_s2")) & (F.col("_id") < F.col("_id2")))
    met = touched.join(begins, [*by, "_w", "_b"]).where((F.col("_id") != F.col("_id2")) & later & (F.col("_s2") < F.col("_e")))
    return met.select(*by, F.least("_id", "_id2").alias("first_id"), F.greatest("_id", "_id2").alias("second_id"), F.col("_from2").alias("overlap_from"), F.when(F.col("_e") <= F.col("_e2"), F.col("_to")).otherwise(F.col("_to2")).alias("overlap_to"))


def _running(deltas: DataFrame, by: list[str], sums: list[str], ranges: int) -> DataFrame:
    """deltas (by, t, sums), one row an instant: running totals by t, range by range, of all ranges before and the own one up to the row."""
    dealt = in_ranges(deltas, "t", ranges)
    inside = Window.partitionBy(*by, "_r").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each key and range.
    bases = dealt.groupBy(*by, "_r").agg(*(F.sum(c).alias(c) for c in sums)).select(*by, "_r", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_base_{c}") for c in sums))
    return dealt.select("*", *(F.sum(c).over(inside).alias(f"_in_{c}") for c in sums)).join(bases, [*by, "_r"]).select(*by, "t", *(F.col(c).alias(f"at_{c}") for c in sums), *((F.col(f"_in_{c}") + F.col(f"_base_{c}")).alias(c) for c in sums))


def _instants(own: DataFrame, by: list[str]) -> DataFrame:
    both = own.select(*by, F.col("_s").alias("t"), F.lit(1).alias("starts"), F.lit(0).alias("ends")).unionAll(own.select(*by, F.col("_e").alias("t"), F.lit(0).alias("starts"), F.lit(1).alias("ends")))
    return both.groupBy(*by, "t").agg(F.sum("starts").alias("starts"), F.sum("ends").alias("ends"))


def at_once(rows: DataFrame, start: str, end: str, by: list[str] | None = None, ranges: int = RANGES) -> DataFrame:
    """(by, at, n): how many intervals are open from each instant on at which one begins or ends. No pair is made."""
    by = by or []
    own = _whole(rows, start, end).select(*by, F.col(start).alias("_s"), F.col(end).alias("_e"))
    return _running(_instants(own, by), by, ["starts", "ends"], ranges).select(*by, F.col("t").alias("at"), (F.col("starts") - F.col("ends")).alias("n"))


def most_at_once(rows: DataFrame, start: str, end: str, by: list[str] | None = None, ranges: int = RANGES) -> DataFrame:
    """(by, n, at): the greatest number of intervals that are open at once, and the first instant with it."""
    by = by or []
    best = at_once(rows, start, end, by, ranges).groupBy(*by).agg(F.max(F.struct("n", (-F.unix_micros("at")).alias("m"))).alias("x"))
    return best.where("x IS NOT NULL").select(*by, "x.n", F.timestamp_micros(-F.col("x.m")).alias("at"))


def overlap_counts(rows: DataFrame, id_col: str, start: str, end: str, by: list[str] | None = None, ranges: int = RANGES) -> DataFrame:
    """(by, id, start, end, n): how many other intervals each one overlaps. No pair is made.

    Those that begin before its end, less those that ended by its start, less itself: two looks into running totals.
    """
    by = by or []
    own = _whole(rows, start, end).select(*by, F.col(id_col), F.col(start), F.col(end))
    totals = _running(_instants(own.withColumnsRenamed({start: "_s", end: "_e"}), by), by, ["starts", "ends"], ranges)
    begun = totals.select(*by, F.col("t").alias(end), (F.col("starts") - F.col("at_starts")).alias("_begun"))
    ended = totals.select(*by, F.col("t").alias(start), F.col("ends").alias("_ended"))
    return own.join(begun, [*by, end]).join(ended, [*by, start]).select(*by, id_col, start, end, (F.col("_begun") - F.col("_ended") - 1).alias("n"))
