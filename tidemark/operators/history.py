"""Values of keys as intervals of validity, folded out of batches of changes that may come late, and reads as of an instant.

An interval begins with each change that was seen, also with one that repeats the value before it: a late change in
between must find it. coalesced() shows intervals of distinct values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranges import RANGES, carried, in_ranges

COLUMNS = ("key", "valid_from", "valid_to", "value")


def _closed(points: DataFrame, ranges: int) -> DataFrame:
    """Points (key, valid_from, value), one a key and instant, with valid_to: when the key's next point begins, null for its last."""
    dealt = in_ranges(points, "valid_from", ranges)
    following = F.lead("valid_from").over(Window.partitionBy("key", "_r").orderBy("valid_from"))
    firsts = carried(dealt.groupBy("key", "_r").agg(F.min("valid_from").alias("_first")), ["key"], "_first", "_next", before=False).select("key", "_r", "_next")
    return dealt.withColumn("_own", following).join(firsts, ["key", "_r"]).select("key", "valid_from", F.coalesce("_own", "_next").alias("valid_to"), "value")


def fold_history(history: DataFrame | None, changes: DataFrame, ranges: int = RANGES) -> DataFrame:
    """The history after a batch of changes (key, at, value).

    Only the intervals of keys in the batch are made anew; all others pass through. Of changes of a key at one instant the
    greatest value counts, and a batch's change replaces what the history has at that instant. Changes without key or time
    are left out; a null value is a value. A key's rows are dealt by ranges of time.
    """
    own = changes.where("key IS NOT NULL AND at IS NOT NULL").select("key", F.col("at").alias("valid_from"), F.struct("value").alias("_v"))
    own = own.groupBy("key", "valid_from").agg(F.max("_v").alias("_v"))
    if history is None:
        return _closed(own.select("key", "valid_from", "_v.value"), ranges).select(*COLUMNS)
    keys = own.select("key").distinct()
    touched = history.join(keys, "key", "left_semi")
    old = touched.select("key", "valid_from", F.struct("value").alias("_v"), F.lit(0).alias("_new"))
    points = old.unionByName(own.withColumn("_new", F.lit(1))).groupBy("key", "valid_from").agg(F.max_by("_v", "_new").alias("_v"))
    made = _closed(points.select("key", "valid_from", "_v.value"), ranges)
    return history.join(keys, "key", "left_anti").select(*COLUMNS).unionByName(made.select(*COLUMNS))


def state_at(history: DataFrame, instant) -> DataFrame:
    """(key, value) of the keys that have a value at this instant; bounds reach the scan as filters."""
    at = F.lit(instant)
    return history.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to")))).select("key", "value")


def coalesced(history: DataFrame, ranges: int = RANGES) -> DataFrame:
    """The history with an interval for each run of equal values."""
    dealt = in_ranges(history.select(*COLUMNS), "valid_from", ranges)
    held = dealt.withColumn("_v", F.struct("value"))
    inside = Window.partitionBy("key", "_r").orderBy("valid_from")
    ends = carried(held.groupBy("key", "_r").agg(F.max_by("_v", "valid_from").alias("_end")), ["key"], "_end", "_last").select("key", "_r", "_last")
    before = F.coalesce(F.lag("_v").over(inside), F.col("_last"))
    starts = held.join(ends, ["key", "_r"]).withColumn("_before", before).where(F.col("_before").isNull() | ~F.col("_before")["value"].eqNullSafe(F.col("value")))
    return _closed(starts.select("key", "valid_from", "value"), ranges).select(*COLUMNS)
