"""Counts that are kept up to date by the changes of each batch instead of being counted anew.

A batch of changes is what a merge replaces and what it puts there: rows before (-1) and after (+1) of the batch's keys.
Each view is a log of such changes, a folder for each batch, written again whole if a batch is run again; reading adds
them up. compact() puts what is there into one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.feed import active
from tidemark.operators.search import tokenized


def _by_day(rows: DataFrame) -> DataFrame:
    return active(rows).select("category_id", "posted_date", F.lit(1).cast("long").alias("n"))


def _by_term(rows: DataFrame) -> DataFrame:
    return tokenized(rows).select(F.explode(F.array_distinct(F.flatten("_words"))).alias("term"), F.lit(1).cast("long").alias("n"))


def _corpus(rows: DataFrame) -> DataFrame:
    return tokenized(rows).select(F.lit(1).cast("long").alias("n"), F.col("_size").cast("long").alias("words"))


#: Name: (keys, sums, what a notice adds).
VIEWS: dict[str, tuple[list[str], list[str], Callable[[DataFrame], DataFrame]]] = {
    "by_day": (["category_id", "posted_date"], ["n"], _by_day),
    "by_term": (["term"], ["n"], _by_term),
    "corpus": ([], ["n", "words"], _corpus),
}


class Upkeep:
    """The views in a folder. Batches have ascending numbers; a batch that is run again overwrites what it wrote."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def apply(self, number: int, before: DataFrame, after: DataFrame) -> None:
        """Takes in a batch: whole notices of its keys as they were, none for new keys, and as they are, none for keys that went."""
        for name, (keys, sums, of) in VIEWS.items():
            both = of(after).select(*keys, *sums).unionAll(of(before).select(*keys, *((-F.col(c)).alias(c) for c in sums)))
            added = both.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums)) if keys else both.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums))
            any_ = " OR ".join(f"{c} <> 0" for c in sums)
            added.where(any_).write.mode("overwrite").parquet(f"{self.folder}/{name}/upto={number}")

    def read(self, name: str) -> DataFrame:
        """The view as it is: keys with their sums, without those that add up to nothing."""
        keys, sums, _ = VIEWS[name]
        log = self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}")
        if not keys:
            return log.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums))
        return log.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums)).where(" OR ".join(f"{c} <> 0" for c in sums))

    def compact(self, folder: str, upto: int) -> Upkeep:
        """The same views in another folder, each as one batch of this number."""
        out = Upkeep(self.spark, folder)
        for name in VIEWS:
            self.read(name).write.mode("overwrite").parquet(f"{out.folder}/{name}/upto={upto}")
        return out


def batch_of(stored: DataFrame, merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(before, after) of the keys of merged rows: what apply() takes. stored is read for these keys only."""
    return stored.join(merged.select("duid").distinct(), "duid", "left_semi"), merged
