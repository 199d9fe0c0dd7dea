"""Profiles from sketches that are kept per part of a table and merged, so a new day costs a day.

A part (a day, a load) is reduced to one row per column: exact counts, extremes and sum, a HyperLogLog
sketch of its distinct values and a KLL sketch of its quantiles. Profiles of any set of parts merge these
rows; the data are not read again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.functions import as_missing

#: 2**14 registers: distinct counts within 0.8 % in two cases of three. Quantiles within 1 % of rank.
DISTINCT_BITS = 14
QUANTILE_SIZE = 400
#: Four standard errors of the distinct sketch, and a rank error that the quantile sketch hardly exceeds.
DISTINCT_ERROR, RANK_ERROR = 4 * 1.04 / 2 ** (DISTINCT_BITS / 2), 0.015


def part_sketches(df: DataFrame, part: Column | str, columns: Sequence[str]) -> DataFrame:
    """One row per part and numeric column; NULL and NaN count as missing.

    Rows are reduced in every task before the shuffle, so a dominant part costs one row per task.
    """
    named = df.select(
        (F.col(part) if isinstance(part, str) else part).alias("part"),
        *[as_missing(c).cast("double").alias(c) for c in columns],
    )
    long = named.select(
        "part", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in columns]))
    )
    return long.groupBy("part", "feature").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("x").alias("values"),
        F.sum("x").alias("total"),
        F.min("x").alias("least"),
        F.max("x").alias("most"),
        F.hll_sketch_agg(F.when(F.col("x").isNotNull(), F.xxhash64("x")), F.lit(DISTINCT_BITS)).alias("distinct"),
        F.kll_sketch_agg_double("x", F.lit(QUANTILE_SIZE)).alias("quantiles"),
    )


def merged_profile(sketches: DataFrame, shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Profile of each column over all parts in `sketches`."""
    merged = sketches.groupBy("feature").agg(
        F.sum("rows").alias("rows"),
        F.sum("values").alias("values"),
        (F.sum("total") / F.sum("values")).alias("mean"),
        F.min("least").alias("min"),
        F.max("most").alias("max"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("nunique"),
        F.kll_merge_agg_double("quantiles").alias("__quantiles"),
    )
    # A sketch without values has no quantiles.
    found = [
        F.when(F.col("values") > 0, F.kll_sketch_get_quantile_double("__quantiles", F.lit(s))).alias(f"q{100 * s:g}")
        for s in shares
    ]
    return merged.select("feature", "rows", "values", "mean", "min", "max", "nunique", *found)


def merged_histogram(sketches: DataFrame, edges: Sequence[float]) -> DataFrame:
    """Estimated share of each column's values in every bin `(low, high]`; the first holds its low edge too."""
    merged = sketches.groupBy("feature").agg(
        F.sum("values").alias("values"), F.kll_merge_agg_double("quantiles").alias("__quantiles")
    )
    ranks = [F.kll_sketch_get_rank_double("__quantiles", F.lit(float(e))) for e in edges]
    bins = [
        F.struct(
            F.lit(k).alias("bin"),
            F.lit(float(low)).alias("low"),
            F.lit(float(high)).alias("high"),
            (ranks[k + 1] - (F.lit(0.0) if k == 0 else ranks[k])).alias("share"),
        )
        for k, (low, high) in enumerate(zip(edges, edges[1:], strict=False))
    ]
    return merged.where(F.col("values") > 0).select("feature", F.inline(F.array(*bins)))


def all_parts(*sketches: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sketches)
