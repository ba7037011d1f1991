"""Counts of active notices on all levels of category, month and freshness in one pass."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.feed import active, with_freshness
from tidemark.operators.schema import CATEGORIES

DIMENSIONS = ("category_id", "month", "freshness")


def level_counts(notices: DataFrame, runs: DataFrame, now: datetime, zeros: bool = True) -> DataFrame:
    """(category_id, month, freshness, level, n): level has a bit for each column that is summed over, category the highest.

    One Expand feeds one aggregation of all eight levels. With ``zeros`` the catalog's categories that have no row on a
    level get one with n = 0, at each value of the level's other columns that occurs.
    """
    own = with_freshness(active(notices), runs, now).select("category_id", F.date_format("posted_date", "yyyy-MM").alias("month"), "freshness")
    counts = own.cube(*DIMENSIONS).agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"))
    if not zeros:
        return counts
    # What occurs beside the category: the rows that sum over it, one level up.
    beside = counts.where("level >= 4").select("month", "freshness", (F.col("level") - 4).alias("level"), F.lit(0).cast("long").alias("n"))
    none = beside.withColumn("category_id", F.explode(F.array(*[F.lit(key) for _, key in CATEGORIES])))
    both = counts.unionByName(none.select(*DIMENSIONS, "level", "n"))
    return both.groupBy(*DIMENSIONS, "level").agg(F.sum("n").alias("n"))
