"""Rows of a key in ranges of an order column, so that no key, however hot, is sorted by one task.

A value that passes from one range to the next is aggregated to a row for each key and range first; only those rows, as
many as there are ranges, meet by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def _number(order: str, kind: str) -> Column:
    """The whole number behind a value: microseconds of a timestamp, days of a date."""
    if kind == "timestamp":
        return F.unix_micros(order)
    if kind == "timestamp_ntz":
        return F.unix_micros(F.to_utc_timestamp(order, "UTC"))
    return F.unix_date(order).cast("long") if kind == "date" else F.col(order).cast("long")


def cuts_of(rows: DataFrame, order: str, ranges: int = RANGES) -> list[int]:
    """Values that cut the rows into so many ranges of about equal counts: a bounded list, whatever the number of rows."""
    number = _number(order, rows.schema[order].dataType.simpleString())
    found = rows.agg(F.percentile_approx(number, [i / ranges for i in range(1, ranges)], 10_000).alias("c")).first()["c"] if ranges > 1 else None
    return sorted(set(found or []))


def in_ranges(rows: DataFrame, order: str, ranges: int = RANGES) -> DataFrame:
    """rows with _r, the number of the range that their value of the order column is in."""
    cuts = cuts_of(rows, order, ranges)
    number = _number(order, rows.schema[order].dataType.simpleString())
    return rows.withColumn("_r", F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), lambda n, c: n + (c < number).cast("int")) if cuts else F.lit(0))


def carried(rows: DataFrame, by: list[str], value: str, name: str, before: bool = True) -> DataFrame:
    """rows (by, _r, value, ...), value null where a range has none: adds ``name``, the nearest value of the ranges before (or after) a row's own.

    rows hold one row a key and range at most.
    """
    side = Window.partitionBy(*by).orderBy("_r")
    chosen = F.last(value, ignorenulls=True).over(side.rowsBetween(Window.unboundedPreceding, -1)) if before else F.first(value, ignorenulls=True).over(side.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn(name, chosen)
