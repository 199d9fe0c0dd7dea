"""Data profiling: the numbers behind tables and plots of an exploration."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.functions import as_missing, from_micros, micros_of, week_ending_sunday
from demandloom.operators.ranges import counted_values, exact_quantiles, quantiles_of_counts

# Shape of the summaries.
QUARTILES = (0.25, 0.5, 0.75)
LATENCY_QUANTILES = (0.5, 0.95, 0.99)
HISTOGRAM_BINS = 30
WHISKER = 1.5
BAR_CHART_LIMIT = 5
LATENCY_DIGITS = 3


def _long(
    df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), all_rows: bool = False
) -> DataFrame:
    """One row per column and present value; with `all_rows` also for missing ones."""
    entries = [
        F.struct(F.lit(c).alias("column"), as_missing(c).alias("value")) for c in columns
    ]
    rows = df.select(*keep, F.inline(F.array(*entries)))
    return rows if all_rows else rows.where(F.col("value").isNotNull())


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    approx: bool = False,
) -> DataFrame:
    """`exact_quantiles`, or its sketch-based stand-in of the same shape."""
    if not approx:
        return exact_quantiles(df, columns, probabilities, by)
    sketch = F.percentile_approx("value", list(probabilities), 10_000)
    rows = (
        _long(df, columns, by)
        .groupBy(*by, "column")
        .agg(F.count(F.lit(1)).alias("n"), sketch.alias("__q"))
    )
    return rows.select(
        *by, "column", "n", *[F.col("__q")[i].alias(f"q{i}") for i in range(len(probabilities))]
    )


def describe(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """count, mean, sample deviation, minimum, quartiles and maximum, one row per column."""
    basics = _long(df, columns, all_rows=True).groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    spread = quantiles(df, columns, QUARTILES, approx=approx)
    return basics.join(spread, "column", "left").select(
        "column",
        "count",
        "mean",
        "std",
        "min",
        F.col("q0").alias("q25"),
        F.col("q1").alias("q50"),
        F.col("q2").alias("q75"),
        "max",
    )


def describe_times(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """count, mean, minimum, quartiles and maximum of time columns of one type, a row per column."""
    dtype = df.schema[columns[0]].dataType
    micros = df.select(*[micros_of(c, dtype).alias(c) for c in columns])
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]
    # Microseconds are summed as decimals: doubles would lose some in the mean.
    basics = (
        micros.select(F.inline(F.array(*entries)))
        .groupBy("column")
        .agg(
            F.count("value").alias("count"),
            F.avg(F.col("value").cast("decimal(20,0)")).alias("mean"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )
    spread = quantiles(micros, columns, QUARTILES, approx=approx)
    names = {"mean": "mean", "min": "min", "q0": "q25", "q1": "q50", "q2": "q75", "max": "max"}
    return basics.join(spread, "column", "left").select(
        "column", "count", *[from_micros(c, dtype).alias(name) for c, name in names.items()]
    )


def info(df: DataFrame) -> DataFrame:
    """Position, name, type and number of present values of every column, in one pass."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("column"),
            F.col(f"c{i}").alias("non_null"),
            F.lit(dtype).alias("dtype"),
        )
        for i, (name, dtype) in enumerate(df.dtypes)
    ]
    return counts.select(F.inline(F.array(*rows)))


def nunique(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """Distinct present values per column, and whether a bar chart suits it."""
    count = F.approx_count_distinct if approx else F.count_distinct
    one = df.agg(*[count(F.col(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    rows = [
        F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("distinct"))
        for i, c in enumerate(columns)
    ]
    listed = one.select(F.inline(F.array(*rows)))
    return listed.withColumn("bar_chart", F.col("distinct") <= BAR_CHART_LIMIT)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency of every present value, in value order."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(column)
    )


def count_where(df: DataFrame, condition: Column) -> DataFrame:
    """Matching rows, all rows, and the share of the two."""
    hits = F.count_if(condition)
    rows = F.count(F.lit(1))
    return df.agg(
        hits.alias("matching"), rows.alias("total"), F.try_divide(hits, rows).alias("share")
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def histogram(df: DataFrame, columns: Sequence[str], bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts in equal bins from minimum to maximum, the last bin closed, empty bins included.

    A column with a single value is given the range half a unit around it. The range of every column
    comes from one aggregation; its few rows are joined back by column name.
    """
    bounds = _long(df, columns).groupBy("column").agg(
        F.min("value").alias("__min"), F.max("value").alias("__max")
    )
    flat = F.col("__min") == F.col("__max")
    bounds = bounds.select(
        "column",
        F.when(flat, F.col("__min") - 0.5).otherwise(F.col("__min")).alias("lo"),
        F.when(flat, F.col("__max") + 0.5).otherwise(F.col("__max")).alias("hi"),
    ).withColumn("step", (F.col("hi") - F.col("lo")) / bins)

    def edge(i: Column) -> Column:
        return F.col("lo") + i * F.col("step")

    last = F.lit(bins - 1)
    # The division can land one bin off at an edge, so the edges themselves decide.
    guess = F.least(F.floor((F.col("value") - F.col("lo")) / F.col("step")), last)
    settled = (
        F.when(F.col("value") < edge(F.col("bin")), F.col("bin") - 1)
        .when(
            (F.col("bin") < last) & (F.col("value") >= edge(F.col("bin") + 1)), F.col("bin") + 1
        )
        .otherwise(F.col("bin"))
    )
    # One bounds row per profiled column: the list of columns bounds this broadcast.
    counted = (
        _long(df, columns)
        .join(F.broadcast(bounds), "column")
        .withColumn("bin", guess)
        .withColumn("bin", settled)
        .groupBy("column", "bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    spine = bounds.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return (
        spine.withColumn("bin", F.col("bin").cast("long"))
        .join(counted, ["column", "bin"], "left")
        .select(
            "column",
            "bin",
            edge(F.col("bin")).alias("lower"),
            F.when(F.col("bin") == bins - 1, F.col("hi")).otherwise(edge(F.col("bin") + 1)).alias("upper"),
            F.coalesce("count", F.lit(0)).alias("count"),
        )
    )


def box_stats(df: DataFrame, by: str, y: str) -> DataFrame:
    """Quartiles, whiskers (outermost points inside the fences) and outlier count per group."""
    values = counted_values(df, [y], [by])
    boxes = quantiles_of_counts(values, [y], QUARTILES, [by]).select(
        by, "n", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3")
    )
    reach = WHISKER * (F.col("q3") - F.col("q1"))
    # Values meet their box by group and range, so a dominant group is not joined in one task.
    spread = values.select(by, "__range").distinct().join(boxes, by)
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        values.join(spread, [by, "__range"])
        .groupBy(by, "n", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
            F.coalesce(F.sum(F.when(~inside, F.col("__c"))), F.lit(0)).alias("outliers"),
        )
    )


def _pearson(a: str, b: str) -> Column:
    """Correlation over rows that have both values; NULL when either does not vary."""
    x, y = as_missing(a), as_missing(b)
    xs = F.when(y.isNotNull(), x)
    ys = F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(xs)) * F.sqrt(F.var_pop(ys)))


def corr_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(_pearson(a, b).alias("corr"))


def _pair_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """`a`, `b`, `corr` of each pair, all pairs in one pass.

    A row yields one small record per pair and these are summed up before the shuffle, so the plan
    stays the same size for any number of columns.
    """
    entries = [
        F.struct(
            F.lit(a).alias("a"),
            F.lit(b).alias("b"),
            as_missing(a).alias("__x"),
            as_missing(b).alias("__y"),
        )
        for a, b in pairs
    ]
    return (
        df.select(F.inline(F.array(*entries)))
        .groupBy("a", "b")
        .agg(_pearson("__x", "__y").alias("corr"))
    )


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns in both orders, and of each with itself."""
    half = _pair_correlations(df, [(c, c) for c in columns] + list(combinations(columns, 2)))
    mirrored = F.array(F.struct("a", "b", "corr"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "corr"))
    once = F.array(F.struct("a", "b", "corr"))
    return half.select(F.inline(F.when(F.col("a") == F.col("b"), once).otherwise(mirrored)))


def corr_to_target(df: DataFrame, columns: Sequence[str], y: str) -> DataFrame:
    """Correlation of every column with the target, itself included, highest first."""
    names = [c for c in columns if c != y] + [y]
    rows = _pair_correlations(df, [(c, y) for c in names])
    return rows.select(F.col("a").alias("column"), "corr").orderBy(
        F.desc_nulls_last("corr"), "column"
    )


def mean_by_group(df: DataFrame, by: str, y: str, approx: bool = False) -> DataFrame:
    """Mean, median and count of `y` per group."""
    means = (
        df.where(F.col(by).isNotNull())
        .groupBy(by)
        .agg(F.avg(as_missing(y)).alias("mean"), F.count(as_missing(y)).alias("count"))
    )
    medians = quantiles(df, [y], [0.5], [by], approx).select(by, F.col("q0").alias("median"))
    return means.join(medians, by, "left").select(by, "mean", "median", "count")


def group_lift(df: DataFrame, flag: str, y: str) -> DataFrame:
    """Means of `y` for flag 0 and 1 and the relative gain of 1 over 0."""
    off = F.avg(F.when(F.col(flag) == 0, as_missing(y)))
    on = F.avg(F.when(F.col(flag) == 1, as_missing(y)))
    return df.agg(
        off.alias("mean_off"), on.alias("mean_on"), (F.try_divide(on, off) - 1).alias("lift")
    )


def mean_by_bin(df: DataFrame, bin_of: Column, y: str) -> DataFrame:
    """Mean and count of `y` per value of a bin expression."""
    return df.groupBy(bin_of.alias("bin")).agg(
        F.avg(as_missing(y)).alias("mean"), F.count(as_missing(y)).alias("count")
    )


def weekly_counts(df: DataFrame, ts: str) -> DataFrame:
    """Rows per week ending on Sunday, from the first to the last week, quiet weeks with 0."""
    counted = (
        df.where(F.col(ts).isNotNull())
        .groupBy(week_ending_sunday(ts).alias("week"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    span = counted.agg(F.min("week").alias("first"), F.max("week").alias("last"))
    calendar = span.where(F.col("first").isNotNull()).select(
        F.explode(F.expr("sequence(first, last, interval 7 days)")).alias("week")
    )
    return calendar.join(counted, "week", "left").select(
        "week", F.coalesce("count", F.lit(0)).alias("count")
    )


def latency_summary(
    df: DataFrame, feature_ms: str, predict_ms: str, by: str, approx: bool = False
) -> DataFrame:
    """Mean and percentiles of the two steps together, and the mean of each, per source."""
    timed = df.withColumn("__total", F.col(feature_ms) + F.col(predict_ms))
    means = timed.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_iterations"),
        F.avg("__total").alias("avg_latency_ms"),
        F.avg(feature_ms).alias("avg_features_ms"),
        F.avg(predict_ms).alias("avg_predict_ms"),
    )
    spread = quantiles(timed, ["__total"], LATENCY_QUANTILES, [by], approx).select(
        by,
        F.col("q0").alias("p50_latency_ms"),
        F.col("q1").alias("p95_latency_ms"),
        F.col("q2").alias("p99_latency_ms"),
    )
    joined = means.join(spread, by, "left")
    # Nine places first: a tie in the third must not hang on the last bits of a sum.
    rounded = [
        F.round(F.round(c, 9), LATENCY_DIGITS).alias(c)
        for c in joined.columns
        if c.endswith("_ms")
    ]
    return joined.select(by, "n_iterations", *rounded)


def latency_compare(summary: DataFrame, by: str, raw: str, store: str) -> DataFrame:
    """Mean latency of both sources and how much the store adds."""
    def mean_of(name: str) -> Column:
        return F.max(F.when(F.col(by) == name, F.col("avg_latency_ms")))

    return summary.agg(mean_of(raw).alias("raw_avg"), mean_of(store).alias("store_avg")).withColumn(
        "difference", F.col("store_avg") - F.col("raw_avg")
    )
