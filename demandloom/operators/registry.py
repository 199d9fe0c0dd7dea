"""Model registry as tables: versions, alias assignments, run metrics, run params.

versions  model_name, version, run_id, model_path, created_at
aliases   model_name, alias, version, assigned_at   (every assignment is a row, the newest counts)
metrics   run_id, name, value
params    run_id, name, value
runs      run_id, started_at
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.functions import batch_time, rounded_map
from demandloom.operators.stores import latest_per_key

# Alias names and the metric compared (lower is better).
CANDIDATE = "candidate"
CHAMPION = "champion"
COMPARED_METRIC = "cv_mae_mean"


def current_aliases(aliases: DataFrame) -> DataFrame:
    """The version each alias points at now."""
    return latest_per_key(aliases, ["model_name", "alias"], "assigned_at", "version")


def metric_of_runs(metrics: DataFrame, metric: str) -> DataFrame:
    """One value per run: of several, the one logged last."""
    named = latest_values(metrics.where(F.col("name") == metric))
    return named.select("run_id", F.col("value").alias("metric"))


def latest_values(rows: DataFrame) -> DataFrame:
    """One value of each run and name: the last by `logged_at` or `step`, where there is such a column.

    Values that nothing tells apart are settled by the largest, so a result never depends on chance.
    """
    stamps = [c for c in ("logged_at", "step") if c in rows.columns]
    return latest_per_key(rows, ["run_id", "name"], *stamps, "value").select("run_id", "name", "value")


def alias_metric_join(
    versions: DataFrame,
    aliases: DataFrame,
    metrics: DataFrame,
    metric: str = COMPARED_METRIC,
    alias: str = CANDIDATE,
    explicit: DataFrame | None = None,
) -> DataFrame:
    """Version, run and metric behind an alias; a version in `explicit` goes before the alias."""
    chosen = current_aliases(aliases).where(F.col("alias") == alias).select("model_name", "version")
    if explicit is not None:
        named = explicit.select("model_name", F.col("version").alias("__named"))
        chosen = named.join(chosen, "model_name", "full").select(
            "model_name", F.coalesce("__named", "version").alias("version")
        )
    return (
        chosen.join(versions.select("model_name", "version", "run_id"), ["model_name", "version"], "left")
        .join(metric_of_runs(metrics, metric), "run_id", "left")
        .select("model_name", "version", "run_id", "metric")
    )


def _strictly_lower(a: Column, b: Column) -> Column:
    """`a < b` where a NaN on either side is never lower."""
    return F.when(F.isnan(a) | F.isnan(b), F.lit(False)).otherwise(a < b)


def promote(
    versions: DataFrame,
    aliases: DataFrame,
    metrics: DataFrame,
    metric: str = COMPARED_METRIC,
    explicit: DataFrame | None = None,
    candidate_alias: str = CANDIDATE,
) -> DataFrame:
    """One decision per model that has a candidate.

    `promoted` is NULL, with the cause in `outcome`, where a version has no run to compare.
    """
    candidate = alias_metric_join(versions, aliases, metrics, metric, candidate_alias, explicit)
    champion = alias_metric_join(versions, aliases, metrics, metric, CHAMPION)
    sides = candidate.select(
        "model_name",
        F.col("version").alias("candidate_version"),
        F.col("run_id").alias("__candidate_run"),
        F.col("metric").alias("candidate_metric"),
    ).join(
        champion.select(
            "model_name",
            F.col("version").alias("champion_version"),
            F.col("run_id").alias("__champion_run"),
            F.col("metric").alias("champion_metric"),
        ),
        "model_name",
        "left",
    )
    outcome = (
        F.when(F.col("__candidate_run").isNull(), "candidate_without_run")
        .when(F.col("candidate_metric").isNull(), "candidate_metric_missing")
        .when(F.col("champion_version").isNull(), "first_champion")
        .when(F.col("__champion_run").isNull(), "champion_without_run")
        .when(F.col("champion_metric").isNull(), "champion_metric_missing")
        .when(_strictly_lower(F.col("candidate_metric"), F.col("champion_metric")), "better")
        .otherwise("not_better")
    )
    promoted = F.when(
        F.col("outcome").isin("first_champion", "champion_metric_missing", "better"), True
    ).when(F.col("outcome").isin("candidate_metric_missing", "not_better"), False)
    return sides.withColumn("outcome", outcome).withColumn("promoted", promoted).drop(
        "__candidate_run", "__champion_run"
    )


def promoted_aliases(decisions: DataFrame, at: object = None) -> DataFrame:
    """Alias rows to append for the promoted candidates."""
    return decisions.where("promoted").select(
        "model_name",
        F.lit(CHAMPION).alias("alias"),
        F.col("candidate_version").alias("version"),
        batch_time(at).alias("assigned_at"),
    )


def register_candidate(
    versions: DataFrame, runs: DataFrame, at: object = None
) -> tuple[DataFrame, DataFrame]:
    """Version rows and candidate alias rows for new runs.

    `runs` has model_name, run_id, model_path. Versions of a model go on from its highest, in the order
    of run_id, the first being 1; the last of several runs becomes the candidate.
    """
    highest = versions.groupBy("model_name").agg(F.max("version").alias("__top"))
    new = runs.join(highest, "model_name", "left").select(
        "model_name",
        (
            F.coalesce("__top", F.lit(0)) + F.row_number().over(Window.partitionBy("model_name").orderBy("run_id"))
        ).cast("long").alias("version"),
        "run_id",
        "model_path",
        batch_time(at).alias("created_at"),
    )
    return new, candidate_aliases(latest_per_key(new, "model_name", "version"))


def candidate_aliases(versions: DataFrame) -> DataFrame:
    """Alias rows that make the given versions the candidates of their models."""
    return versions.select(
        "model_name",
        F.lit(CANDIDATE).alias("alias"),
        "version",
        F.col("created_at").alias("assigned_at"),
    )


def name_value_map(rows: DataFrame, out: str) -> DataFrame:
    """The names and values of a run as a map; runs carry a few dozen of them at most."""
    pairs = F.array_sort(F.collect_list(F.struct("name", "value")))
    return latest_values(rows).groupBy("run_id").agg(F.map_from_entries(pairs).alias(out))


def model_info(
    versions: DataFrame,
    aliases: DataFrame,
    metrics: DataFrame,
    params: DataFrame,
    runs: DataFrame,
    alias: str = CHAMPION,
) -> DataFrame:
    """The aliased version of each model with its run's start, rounded metrics and params."""
    chosen = current_aliases(aliases).where(F.col("alias") == alias).select("model_name", "version")
    served = chosen.join(versions, ["model_name", "version"])
    keys = served.select("run_id")

    def of_served(rows: DataFrame) -> DataFrame:
        return rows.join(keys, "run_id", "left_semi")

    return (
        served.join(runs, "run_id", "left")
        .join(name_value_map(of_served(metrics), "metrics"), "run_id", "left")
        .join(name_value_map(of_served(params), "params"), "run_id", "left")
        .withColumn("metrics", rounded_map("metrics"))
        .select("model_name", "version", "run_id", "started_at", "metrics", "params")
    )


def sorted_params(params: DataFrame) -> DataFrame:
    """Params in name order within their run."""
    return params.orderBy("run_id", "name")


def model_compare(metrics: DataFrame, model: str = "model", value: str = "value") -> DataFrame:
    """The model with the lowest metric."""
    return metrics.where(F.col(value).isNotNull()).agg(
        F.min_by(model, F.struct(value, model)).alias("best_model"), F.min(value).alias("best_value")
    )


def rank_importances(importances: DataFrame, value: str = "importance") -> DataFrame:
    """Importances in ascending order."""
    return importances.orderBy(value, "feature")


def align_importances(left: DataFrame, right: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Two importance tables side by side; a feature only one of them has stays, with NULL."""
    a = left.select("feature", F.col("importance").alias(names[0]))
    b = right.select("feature", F.col("importance").alias(names[1]))
    return a.join(b, "feature", "full")
