"""Tree models on pyspark.ml: fit, cross-validate, score, explain, compare column sets."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.operators.features import null_guard
from demandloom.operators.metrics import fold_maes, fold_metrics, regression_metrics
from demandloom.operators.ranges import dense_position, kfold_assign, shuffled_position
from demandloom.session import staged

# Parameters of the published models.
FOREST_PARAMS = {"trees": 200, "depth": 10, "seed": 42}
BOOSTING_PARAMS = {"rounds": 200, "depth": 5, "rate": 0.1, "seed": 42}
FOLDS = 5
PERMUTATION_REPEATS = 10
PREDICTION_DIGITS = 2

# Continuous columns split finer than the library default of 32 candidates.
MAX_BINS = 256
FEATURES = "features"
# Fits of one cross-validation that run side by side.
FITS_AT_ONCE = 5
# Memory for the statistics of the nodes that are split in one pass over the data. The last levels of a
# deep forest hold thousands of nodes; with less memory they take many passes.
NODE_MEMORY_MB = 1024
# Frames of fewer rows are fitted and scored in the partitions they come in.
SPREAD_LEAST = 50_000
# Rows of one task of a fit, at most. Every task holds statistics of its own, so few tasks cost less.
FIT_ROWS = 250_000
# What a fit keeps of a row for each tree: how often the tree draws it, and its node before and after a pass.
DRAW_BYTES, NODE_BYTES = 4, 8
# Passes after which kept nodes are written to the shared folder, which cuts their lineage.
NODE_PASSES = 50


def forest(
    trees: int = FOREST_PARAMS["trees"],
    depth: int = FOREST_PARAMS["depth"],
    seed: int = FOREST_PARAMS["seed"],
    bootstrap: bool = True,
    memory_mb: int = NODE_MEMORY_MB,
) -> RandomForestRegressor:
    """Random forest that considers every feature at each split.

    `memory_mb` bounds what a task holds of the nodes split together. One tree without bootstrap that
    may grow deep enough predicts the mean of every combination of values.
    """
    return RandomForestRegressor(
        numTrees=trees,
        maxDepth=depth,
        seed=seed,
        bootstrap=bootstrap,
        featureSubsetStrategy="all",
        maxBins=MAX_BINS,
        maxMemoryInMB=memory_mb,
        featuresCol=FEATURES,
    )


def boosting(
    rounds: int = BOOSTING_PARAMS["rounds"],
    depth: int = BOOSTING_PARAMS["depth"],
    rate: float = BOOSTING_PARAMS["rate"],
    seed: int = BOOSTING_PARAMS["seed"],
) -> GBTRegressor:
    return GBTRegressor(
        maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, maxBins=MAX_BINS, featuresCol=FEATURES
    )


# Memory Spark keeps back in every executor before it shares the rest.
RESERVED_MB = 300
SIZE_UNITS = {"k": 1 / 1024, "m": 1, "g": 1024, "t": 1024 * 1024}


def size_mb(text: str) -> float:
    """Megabytes of a memory setting such as `10g` or `512m` (bare numbers are megabytes)."""
    text = text.strip().lower().removesuffix("b")
    if text and text[-1] in SIZE_UNITS:
        return float(text[:-1]) * SIZE_UNITS[text[-1]]
    return float(text)


def node_memory_mb(spark, wanted: int) -> int:
    """Node memory of one fit that every task of an executor can hold at the same time.

    The statistics of the nodes split together live in user memory, outside what Spark manages, next
    to their serialized copy for the shuffle, and each task slot of an executor may hold a group of
    any fit that runs. Which nodes share a pass does not change the trees, only the number of passes.
    """
    sc = spark.sparkContext
    return slot_share_mb(sc.master, sc.getConf().get, sc.defaultParallelism, wanted)


def slot_share_mb(master: str, setting, parallelism: int, wanted: int) -> int:
    """One task slot's half of an executor's user memory, at most `wanted`.

    Only `local` and `local[n]` run the tasks in the driver; `local-cluster[n,cores,mb]` has executors
    of their own, with `spark.executor.memory` each and `cores` task slots.
    """
    cluster = re.fullmatch(r"local-cluster\[\s*\d+\s*,\s*(\d+)\s*,\s*\d+\s*\]", master.strip())
    local = master.startswith("local") and not cluster
    heap = size_mb(setting("spark.driver.memory" if local else "spark.executor.memory", "1g"))
    fraction = float(setting("spark.memory.fraction", "0.6"))
    cores = int(setting("spark.executor.cores", cluster.group(1) if cluster else str(parallelism)))
    slots = max(1, cores // int(setting("spark.task.cpus", "1")))
    share = (heap - RESERVED_MB) * (1 - fraction) / slots / 2
    return max(1, min(wanted, int(share)))


def storage_bytes(spark) -> int:
    """What the executors together can hold in memory of cached rows."""
    sc = spark.sparkContext
    status = sc._jsc.sc().getExecutorMemoryStatus()
    found, each = {}, status.keys().iterator()
    while each.hasNext():
        name = each.next()
        found[name] = int(status.apply(name)._1())
    if len(found) > 1:
        # The driver's own memory is listed too; it runs no tasks then.
        found.pop(sc._jvm.org.apache.spark.SparkEnv.get().blockManager().blockManagerId().hostPort(), None)
    return sum(found.values())


def fits_at_once(storage: int, rows: int, trees: int, most: int) -> int:
    """How many fits over `rows` rows may run side by side with their rows in memory, one at least."""
    return max(1, min(most, storage // max(1, rows * trees * (DRAW_BYTES + NODE_BYTES))))


def fit_tasks(rows: int, slots: int, at_once: int) -> int:
    """Tasks of each of `at_once` fits: their share of the slots, or more where tasks would be too large."""
    return max(1, -(-slots // at_once), -(-rows // FIT_ROWS))


def train(df: DataFrame, columns: Sequence[str], y: str, estimator, at_once: int = 1) -> PipelineModel:
    """Fit on all rows; the model carries its own column list and order.

    Rows of a forest are dealt out evenly to the task slots, which `at_once` such fits share. If the
    node of every row in every tree fits in memory as well, it is kept there and not searched from the
    root in every pass; that does not change the trees.
    """
    assembler = VectorAssembler(inputCols=list(columns), outputCol=FEATURES)
    fitted = estimator.copy({estimator.labelCol: y})
    if fitted.hasParam("maxMemoryInMB"):
        memory = fitted.getOrDefault("maxMemoryInMB")
        fitted = fitted.copy({fitted.maxMemoryInMB: node_memory_mb(df.sparkSession, memory)})
    if fitted.hasParam("numTrees"):
        spark, trees = df.sparkSession, fitted.getOrDefault("numTrees")
        rows = df.count()
        if rows >= SPREAD_LEAST:
            slots = spark.sparkContext.defaultParallelism
            df = df.select(*dict.fromkeys([*columns, y])).repartition(fit_tasks(rows, slots, at_once))
            room = storage_bytes(spark) // at_once
            held = rows * trees * (DRAW_BYTES + NODE_BYTES) <= room
            fitted = fitted.copy({fitted.cacheNodeIds: held, fitted.checkpointInterval: NODE_PASSES})
    return Pipeline(stages=[assembler, fitted]).fit(df)


def fold_table(
    df: DataFrame, columns: Sequence[str], y: str, k: int = FOLDS, key: str = "vehicle_id"
) -> DataFrame:
    """Rows with their fold, written once and split by fold.

    A fit or a scoring pass over it opens only the folds it needs.
    """
    return staged(kfold_assign(df.select(key, y, *columns), key, k), "folds", "fold")


def scored_folds(
    folds: DataFrame,
    columns: Sequence[str],
    y: str,
    estimator,
    k: int = FOLDS,
    key: str = "vehicle_id",
    parallelism: int = FITS_AT_ONCE,
) -> DataFrame:
    """Every row predicted by the model fitted on the other folds: key, fold, y, prediction.

    So many fits run side by side as can keep their rows in memory.
    """
    at_once = min(k, parallelism)
    if estimator.hasParam("numTrees"):
        spark, trees = folds.sparkSession, estimator.getOrDefault("numTrees")
        at_once = fits_at_once(storage_bytes(spark), folds.count() * (k - 1) // k, trees, at_once)

    def fit_and_score(fold: int) -> DataFrame:
        model = train(folds.where(F.col("fold") != fold), columns, y, estimator, at_once)
        held_out = folds.where(F.col("fold") == fold)
        return model.transform(held_out).select(key, "fold", y, "prediction")

    with ThreadPool(at_once) as pool:
        task = inheritable_thread_target(folds.sparkSession)(fit_and_score)
        return reduce(DataFrame.unionByName, pool.map(task, range(k)))


def cross_validate(
    df: DataFrame, columns: Sequence[str], y: str, estimator, k: int = FOLDS, key: str = "vehicle_id"
) -> tuple[DataFrame, DataFrame]:
    """Fold summary (mean, deviation) and the MAE of each fold."""
    scored = scored_folds(fold_table(df, columns, y, k, key), columns, y, estimator, k, key)
    return fold_metrics(scored, "fold", y, "prediction"), fold_maes(scored, "fold", y, "prediction")


def feature_importance(model: PipelineModel, columns: Sequence[str], df: DataFrame) -> DataFrame:
    """Impurity importance of each feature; one row per model input."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(c, float(w)) for c, w in zip(columns, weights, strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def _as_metrics(row: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Columns of a one-row frame as name, value rows."""
    entries = [
        F.struct(F.lit(name).alias("name"), F.col(c).alias("value")) for c, name in names.items()
    ]
    return row.select(F.inline(F.array(*entries)))


def run_metrics(
    df: DataFrame, columns: Sequence[str], y: str, estimator, k: int = FOLDS, key: str = "vehicle_id"
) -> tuple[PipelineModel, DataFrame]:
    """Cross-validate, fit on everything, and list every metric of the run as name, value."""
    summary, folds = cross_validate(df, columns, y, estimator, k, key)
    model = train(df, columns, y, estimator)
    fitted = regression_metrics(model.transform(df), y, "prediction")
    importances = feature_importance(model, columns, df)
    return model, reduce(
        DataFrame.unionByName,
        [
            _as_metrics(summary, {c: c for c in ("cv_mae_mean", "cv_mae_std")}),
            folds.select(
                F.concat(F.lit("cv_mae_fold_"), F.col("fold") + 1).alias("name"),
                F.col("mae").alias("value"),
            ),
            _as_metrics(fitted, {c: f"train_{c}" for c in ("mae", "rmse", "r2")}),
            importances.select(
                F.concat(F.lit("importance_"), "feature").alias("name"),
                F.col("importance").alias("value"),
            ),
        ],
    )


def permutation_importance(
    model: PipelineModel,
    df: DataFrame,
    columns: Sequence[str],
    y: str,
    key: str = "vehicle_id",
    repeats: int = PERMUTATION_REPEATS,
    seed: int = 42,
) -> DataFrame:
    """Mean and population deviation of the loss in R² when one feature is shuffled.

    Each repeat joins the rows to themselves under a random order of the keys. For a feature a row takes
    as many values as its partners of all repeats have; the model scores each of them once, and the row's
    own values once for all features, so a feature of few values costs few scores.
    """
    columns = list(columns)
    predictor = model.stages[-1]
    # Adding zero makes one value of both zeros.
    base = df.select(
        key, F.col(y).cast("double").alias("__y"), *[(F.col(c).cast("double") + 0.0).alias(c) for c in columns]
    )
    plain = regression_metrics(model.transform(df), y, "prediction")
    placed = staged(dense_position(base, key, "__pos"), "placed")
    wide = placed
    for r in range(repeats):
        donor = shuffled_position(placed.drop("__pos"), key, seed + r, "__pos").select(
            "__pos", *[F.col(c).alias(f"__d{r}_{c}") for c in columns]
        )
        wide = wide.join(donor, "__pos")
    # Written before it is scored, so that tasks of the scoring are dealt out evenly.
    wide = staged(
        wide.select(
            "__y", *columns, *[F.array(*[F.col(f"__d{r}_{c}") for r in range(repeats)]).alias(f"__d_{c}") for c in columns]
        ),
        "partners",
    )
    rows = wide.count()
    if rows >= SPREAD_LEAST:
        slots = df.sparkSession.sparkContext.defaultParallelism
        wide = wide.repartition(max(slots, -(-rows // SPREAD_LEAST)))

    def uses(c: str, value: Column) -> Column:
        """The repeats in which feature `c` takes `value`."""
        taken = F.transform(f"__d_{c}", lambda d, r: F.when(d.eqNullSafe(value), r))
        return F.transform(
            F.filter(taken, lambda r: r.isNotNull()), lambda r: F.struct(F.lit(c).alias("feature"), r.alias("repeat"))
        )

    def changed(c: str) -> Column:
        others = F.filter(F.array_distinct(f"__d_{c}"), lambda d: ~d.eqNullSafe(F.col(c)))
        return F.transform(
            others,
            lambda d: F.struct(
                uses(c, d).alias("uses"), F.array(*[d if x == c else F.col(x) for x in columns]).alias("__v")
            ),
        )

    own = F.struct(
        F.concat(*[uses(c, F.col(c)) for c in columns]).alias("uses"), F.array(*columns).alias("__v")
    )
    variants = F.concat(F.array(own), *[changed(c) for c in columns])
    stacked = (
        wide.select("__y", F.inline(F.filter(variants, lambda v: F.size(v["uses"]) > 0)))
        .withColumn(FEATURES, array_to_vector("__v"))
    )
    scored = predictor.transform(stacked).select("__y", "prediction", F.inline("uses"))
    shuffled = regression_metrics(scored, "__y", "prediction", ["feature", "repeat"])
    drop = plain.select("r2").scalar() - F.col("r2")
    return (
        shuffled.withColumn("drop", drop)
        .groupBy("feature")
        .agg(
            F.avg("drop").alias("importance_mean"),
            F.stddev_pop("drop").alias("importance_std"),
        )
    )


def feature_ablation(
    df: DataFrame,
    column_sets: Mapping[str, Sequence[str]],
    y: str,
    estimator,
    k: int = FOLDS,
    key: str = "vehicle_id",
) -> DataFrame:
    """Cross-validated error per column set, on the same folds, and its difference to the first set."""
    every = list(dict.fromkeys(c for columns in column_sets.values() for c in columns))
    folds = fold_table(df, every, y, k, key)
    parts = []
    for order, (name, columns) in enumerate(column_sets.items()):
        scored = scored_folds(folds, columns, y, estimator, k, key)
        parts.append(
            fold_metrics(scored, "fold", y, "prediction").select(
                F.lit(order).alias("order"), F.lit(name).alias("columns"), "cv_mae_mean", "cv_mae_std"
            )
        )
    table = reduce(DataFrame.unionByName, parts)
    baseline = table.where(F.col("order") == 0).select("cv_mae_mean")
    return table.withColumn("difference", F.col("cv_mae_mean") - baseline.scalar())


def score(
    df: DataFrame, model: PipelineModel, version: str | None, out: str = "predicted_reservations"
) -> DataFrame:
    """Add the rounded prediction and the version that made it; no rows in, no rows out."""
    scored = model.transform(df)
    return scored.withColumn(out, F.round("prediction", PREDICTION_DIGITS)).withColumn(
        "model_version", F.lit(version)
    ).drop(FEATURES, "prediction")


def score_known(
    rows: DataFrame, columns: Sequence[str], model: PipelineModel, version: str | None
) -> tuple[DataFrame, DataFrame]:
    """Score rows that have every feature; the others come back as not found."""
    complete, incomplete = null_guard(rows, columns)
    return score(complete, model, version), incomplete


def without_model(df: DataFrame, out: str = "predicted_reservations") -> DataFrame:
    """Rows as they look while no champion is loaded."""
    return df.withColumn(out, F.lit(None).cast(T.DoubleType())).withColumn(
        "model_version", F.lit(None).cast(T.StringType())
    )
