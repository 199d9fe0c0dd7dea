"""Global order without a single-task sort.

Values are cut into ranges at approximate quantiles of the column itself, so every range holds about
the same share of the rows however the values are spread. The cut points are the only thing the
driver sees: at most `split_count` doubles per column. Work inside a range is one window per range,
and the few range totals are prefix-summed on their own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandloom.functions import as_missing
from demandloom.session import split_count

_RANGE = "__range"


def cut_points(df: DataFrame, columns: Sequence[str], pieces: int | None = None) -> list[list[float]]:
    """Strictly increasing cut points per numeric column, found in one aggregation."""
    pieces = pieces or split_count(df.sparkSession)
    shares = [i / pieces for i in range(1, pieces)]
    accuracy = 16 * pieces
    found = df.agg(
        *[
            F.percentile_approx(as_missing(c), shares, accuracy).alias(f"c{i}")
            for i, c in enumerate(columns)
        ]
    ).first()
    # One cut is the least there can be; where there are no values any will do.
    return [
        sorted({x for x in found[f"c{i}"] or [] if math.isfinite(x)}) or [0.0]
        for i in range(len(columns))
    ]


def with_ranges(
    df: DataFrame, columns: Sequence[str], outputs: Sequence[str], pieces: int | None = None
) -> DataFrame:
    """Add the range number of each column; equal values always share a range."""
    edges = [
        [-float("inf"), *points, float("inf")] for points in cut_points(df, columns, pieces)
    ]
    cutter = Bucketizer(
        inputCols=list(columns), outputCols=list(outputs), splitsArray=edges, handleInvalid="keep"
    )
    cut = cutter.transform(df)
    return cut.withColumns({c: F.col(c).cast("int") for c in outputs})


def _number(
    ranged: DataFrame, order: Sequence[str | Column], out: str, total: str | None, by: Sequence[str] = ()
) -> DataFrame:
    """Position of every row: place inside its range plus the size of all ranges before it.

    Without groups there are at most `MAX_SPLITS` + 2 range sizes, which bounds the broadcast of the
    offsets. With groups their number is unknown and Spark picks the join by size.
    """
    by = list(by)
    sizes = ranged.groupBy(*by, _RANGE).agg(F.count(F.lit(1)).alias("__size"))
    group = W.partitionBy(*by)
    before = group.orderBy(_RANGE).rowsBetween(W.unboundedPreceding, -1)
    renamed = [F.col(c).alias(f"__g{i}") for i, c in enumerate([*by, _RANGE])]
    offsets = sizes.select(
        *renamed,
        F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"),
        F.sum("__size").over(group).alias("__total"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate([*by, _RANGE])]
    inside = W.partitionBy(*by, _RANGE).orderBy(*order)
    numbered = (
        ranged.withColumn("__inside", F.row_number().over(inside) - 1)
        .join(offsets if by else F.broadcast(offsets), same)
        .withColumn(out, F.col("__inside") + F.col("__offset"))
    )
    if total:
        numbered = numbered.withColumn(total, F.col("__total"))
    helpers = [f"__g{i}" for i in range(len(same))]
    return numbered.drop(_RANGE, "__inside", "__offset", "__total", *helpers)


def dense_position(
    df: DataFrame,
    key: str,
    out: str = "position",
    total: str | None = None,
    by: Sequence[str] = (),
    ties: Sequence[Column] = (),
) -> DataFrame:
    """Number the rows 0..n-1 in the order of a unique numeric key, anew in every group of `by`.

    Where the key repeats, `ties` order its rows.
    """
    return _number(with_ranges(df, [key], [_RANGE]), [key, *ties], out, total, by)


def shuffled_position(df: DataFrame, key: str, seed: int, out: str = "position") -> DataFrame:
    """A pseudo-random permutation of 0..n-1 that depends only on the keys and the seed.

    Hashes are spread evenly, so their leading bits serve as ranges without looking at the data.
    """
    bits = (split_count(df.sparkSession) - 1).bit_length()
    mixed = df.withColumn("__hash", F.xxhash64(F.lit(seed), F.col(key)))
    ranged = mixed.withColumn(_RANGE, F.shiftright("__hash", 64 - bits))
    return _number(ranged, ["__hash", key], out, None).drop("__hash")


def kfold_assign(df: DataFrame, key: str, k: int = 5, out: str = "fold") -> DataFrame:
    """Contiguous folds 0..k-1 in key order; the first n mod k folds hold one row more."""
    numbered = dense_position(df, key, "__pos", "__n")
    small = F.floor(F.col("__n") / k)
    larger = F.col("__n") % k
    edge = larger * (small + 1)
    position = F.col("__pos")
    fold = F.when(position < edge, F.floor(position / (small + 1))).otherwise(
        larger + F.floor(F.try_divide(position - edge, small))
    )
    return numbered.withColumn(out, fold.cast("int")).drop("__pos", "__n")


def counted_values(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), pieces: int | None = None
) -> DataFrame:
    """How often each present value occurs per group, with the range it falls in.

    One row per `by`..., `__col` (number of the column), `__range` and `value`; rows without a group
    are left out. Equal values are counted before the shuffle.
    """
    by = list(by)
    names = [f"__r{i}" for i in range(len(columns))]
    values = df.select(*by, *[as_missing(c).alias(c) for c in columns])
    if by:
        values = values.dropna(subset=by)
    ranged = with_ranges(values, columns, names, pieces)
    entries = [
        F.struct(F.lit(i).alias("__col"), F.col(c).alias("value"), F.col(r).alias(_RANGE))
        for i, (c, r) in enumerate(zip(columns, names))
    ]
    # The column goes by its number: fixed-width keys aggregate faster. Both conditions are stated,
    # so that several uses of the counts in one query share one shuffle.
    return (
        ranged.select(*by, F.inline(F.array(*entries)))
        .where(F.col("value").isNotNull() & F.col(_RANGE).isNotNull())
        .groupBy(*by, "__col", _RANGE, "value")
        .agg(F.count(F.lit(1)).alias("__c"))
    )


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    pieces: int | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles of each column per group, exact at any group size.

    One row per group and column: `by`..., `column`, `n`, `q0`, `q1`, ...
    """
    return quantiles_of_counts(counted_values(df, columns, by, pieces), columns, probabilities, by)


def quantiles_of_counts(
    counted: DataFrame, columns: Sequence[str], probabilities: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """`exact_quantiles` over the result of `counted_values`.

    Only the ranges that hold a wanted rank are sorted, each in a window of its own, so no task ever
    holds a whole group.
    """
    by = list(by)
    group = [*by, "__col"]
    before = W.partitionBy(*group).orderBy(_RANGE).rowsBetween(W.unboundedPreceding, -1)
    cells = (
        counted.groupBy(*group, _RANGE)
        .agg(F.sum("__c").alias("__cell"))
        .withColumn("n", F.sum("__cell").over(W.partitionBy(*group)))
        .withColumn("__before", F.coalesce(F.sum("__cell").over(before), F.lit(0)))
    )
    place = [F.lit(p) * (F.col("n") - 1) for p in probabilities]
    ranks = F.array_distinct(
        F.flatten(
            F.array(*[F.array(F.floor(p).cast("long"), F.ceil(p).cast("long")) for p in place])
        )
    )
    wanted = cells.withColumn(
        "__ranks",
        F.filter(
            ranks,
            lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__cell")),
        ),
    ).where(F.size("__ranks") > 0)
    if not by:
        # Two ranks per column and probability at most.
        wanted = F.broadcast(wanted)
    inside = W.partitionBy(*group, _RANGE).orderBy("value")
    running = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    picked = (
        counted.join(wanted, [*group, _RANGE])
        .withColumn("__upto", F.col("__before") + F.sum("__c").over(running))
        .select(
            *group,
            "n",
            "value",
            F.explode(
                F.filter(
                    "__ranks",
                    lambda r: (r < F.col("__upto")) & (r >= F.col("__upto") - F.col("__c")),
                )
            ).alias("__rank"),
        )
    )
    results = []
    for i, p in enumerate(probabilities):
        spot = F.lit(p) * (F.col("n") - 1)
        low = F.max(F.when(F.col("__rank") == F.floor(spot), F.col("value")))
        high = F.max(F.when(F.col("__rank") == F.ceil(spot), F.col("value")))
        share = F.max(spot - F.floor(spot))
        results.append((low + (high - low) * share).alias(f"q{i}"))
    named = F.array(*[F.lit(c) for c in columns])[F.col("__col")].alias("column")
    answers = picked.groupBy(*group).agg(F.max("n").alias("n"), *results)
    return answers.select(*by, named, "n", *[f"q{i}" for i in range(len(probabilities))])
