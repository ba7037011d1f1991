"""Distinct counts and quantiles out of sketches that are kept as binary columns and merged upwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2^LG_K registers of a distinct sketch: a relative standard error of about 1.04 / 2^(LG_K / 2). K of a quantile sketch: ranks are off by about 1.7 % at 200.
LG_K, K = 12, 200
#: Standard errors, and the rank error, within which estimates are promised.
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (LG_K / 2), 0.0265


def sketched(rows: DataFrame, by: list[str], distinct: str, number: str) -> DataFrame:
    """(by, n, distinct_sketch, number_sketch): sketches of a column's distinct values and of a whole number's distribution.

    Null values are in neither sketch. Map-side parts are sketches too, so a hot group moves a few kilobytes a task.
    """
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(distinct, F.lit(LG_K)).alias("distinct_sketch"), F.kll_sketch_agg_bigint(F.col(number).cast("long"), F.lit(K)).alias("number_sketch"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of coarser groups, out of finer ones only. In whatever order they are merged, estimates stay within their errors."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_bigint("number_sketch").alias("number_sketch"))


def estimated(sketches: DataFrame, ranks: list[float]) -> DataFrame:
    """Sketches with distinct_estimate and quantiles (an array, one for each rank)."""
    quantiles = F.kll_sketch_get_quantile_bigint("number_sketch", F.array(*map(F.lit, ranks)))
    return sketches.withColumns({"distinct_estimate": F.hll_sketch_estimate("distinct_sketch"), "quantiles": quantiles})
