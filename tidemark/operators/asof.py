"""As-of join: each row with the last row of another table at or before its own time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranges import RANGES, carried, in_ranges


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, take: list[str], by: list[str] | None = None, tie: list[str] | None = None, ranges: int = RANGES) -> DataFrame:
    """left with the columns ``take`` of the last row of right whose time isn't after its own, null where there is none.

    With ``by`` only rows with equal values of these columns, of the same names on both sides, are looked at; null equals
    nothing. Of right rows of equal time the greatest in ``tie`` (by default in take) counts. Times are timestamps or whole
    numbers of one type; a left row without time gets nulls, a right row without time is passed over.

    Instants are looked up, not rows: equal ones of a key are one row on either side. They are cut into ranges of time;
    in a range the last value is carried on by a window, from range to range by a row for each key and range. A third of
    all rows may have one key or one instant.
    """
    by = by or []
    clash = {"_t", "_r", "_v", "_key"} & {*left.columns, *right.columns}
    if clash:
        raise ValueError(f"column names in use: {', '.join(sorted(clash))}")
    keyed = lambda df: df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in by)) if by else df
    last = F.max_by(F.struct(*take), F.struct(*(tie or take)))
    values = keyed(right.where(F.col(right_time).isNotNull())).groupBy(*by, F.col(right_time).alias("_t")).agg(last.alias("_v"))
    asked = keyed(left.where(F.col(left_time).isNotNull())).select(*by, F.col(left_time).alias("_t")).distinct()
    kind = values.schema["_v"].dataType
    both = values.select(*by, "_t", "_v", F.lit(False).alias("_asked")).unionAll(asked.select(*by, "_t", F.lit(None).cast(kind).alias("_v"), F.lit(True).alias("_asked")))
    both = both.groupBy(*by, "_t").agg(F.max("_v").alias("_v"), F.max("_asked").alias("_asked"))
    dealt = in_ranges(both, "_t", ranges)
    inside = Window.partitionBy(*by, "_r").orderBy("_t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = dealt.withColumn("_own", F.last("_v", ignorenulls=True).over(inside)).where("_asked")
    ends = dealt.groupBy(*by, "_r").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_t"))).alias("_end"))
    # Without keys there are as many rows here as ranges.
    ends = carried(ends, by, "_end", "_before").select(*by, "_r", "_before")
    found = own.join(ends, [*by, "_r"]).select(*by, "_t", F.coalesce("_own", "_before").alias("_v"))
    found = found.select(*(F.col(c).alias(f"_key{i}") for i, c in enumerate(by)), F.col("_t"), F.col("_v"))
    same = F.col(left_time) == F.col("_t")
    for i, c in enumerate(by):
        same = same & (left[c] == F.col(f"_key{i}"))
    out = left.join(found, same, "left")
    return out.select(*(left[c] for c in left.columns), *(F.col("_v")[c].alias(c) for c in take))
