"""Fits whose result SQL can state: one tree that sees all rows and splits every combination of few values.

Such a tree predicts the mean label of each combination, so training, cross-validation, ablation, scoring
and the registry's metrics run the same code as the published models and are compared exactly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.operators import models
from demandloom.plans.model_jobs import score_ids, score_new_arrivals
from demandloom.registered.base import half_up, query
from demandloom.schemas import LISTING_VIEW
from demandloom.session import scratch_path
from demandloom.sources import demo
from demandloom.sources.registry import Registry

KEY, LABEL, FEATURES = LISTING_VIEW.key, LISTING_VIEW.label, LISTING_VIEW.feature_names
PAIR = ["technology", "street_parked"]
DEPTH = 12


def whole_tree():
    return models.forest(trees=1, depth=DEPTH, bootstrap=False)


@query(
    "train_whole_tree",
    "offline",
    """SELECT vehicle_id, num_reservations, round(avg(num_reservations) OVER (
       PARTITION BY technology, street_parked, num_images), 6) AS prediction FROM offline""",
)
def train_whole_tree(spark, folder):
    rows = demo.offline(spark, folder).select(KEY, LABEL, *PAIR, "num_images")
    model = models.train(rows, [*PAIR, "num_images"], LABEL, whole_tree())
    return model.transform(rows).select(KEY, LABEL, F.round("prediction", 6).alias("prediction"))


def cross_validated(columns: str) -> str:
    """Mean and deviation of the fold errors when a row is predicted by its combination in the other folds."""
    same = " AND ".join(f"a.{c} = b.{c}" for c in columns.split(", "))
    return f"""SELECT avg(mae) AS cv_mae_mean, stddev_pop(mae) AS cv_mae_std, count(*) AS folds FROM (
        SELECT fold, avg(abs(num_reservations - prediction)) AS mae FROM (
          SELECT a.fold, a.num_reservations, sum(b.total) / sum(b.n) AS prediction FROM placed AS a JOIN (
            SELECT {columns}, fold, sum(num_reservations) AS total, count(*) AS n FROM placed GROUP BY ALL) AS b
          ON a.fold <> b.fold AND {same} GROUP BY a.vehicle_id, a.fold, a.num_reservations) GROUP BY fold)"""


def placed(body: str) -> str:
    """A statement over the offline rows with their folds."""
    folds = "SELECT *, CAST(ntile(5) OVER (ORDER BY vehicle_id) - 1 AS INTEGER) AS fold FROM offline"
    return f"SELECT * FROM (WITH placed AS ({folds}) {body})"


@query(
    "cross_validate_whole_tree",
    "offline",
    placed(
        f"""SELECT round(cv_mae_mean, 6) AS cv_mae_mean, round(cv_mae_std, 6) AS cv_mae_std, folds
            FROM ({cross_validated("technology, street_parked")})"""
    ),
)
def cross_validate_whole_tree(spark, folder):
    summary, _ = models.cross_validate(demo.offline(spark, folder), PAIR, LABEL, whole_tree())
    return summary.select(*[F.round(c, 6).alias(c) for c in ("cv_mae_mean", "cv_mae_std")], "folds")


@query(
    "feature_ablation_whole_tree",
    "offline",
    placed(
        f"""SELECT name AS columns, round(cv_mae_mean, 6) AS cv_mae_mean, round(cv_mae_mean - base, 6) + 0.0 AS difference
            FROM (SELECT 'both' AS name, * FROM ({cross_validated("technology, street_parked")}) UNION ALL
                  SELECT 'technology', * FROM ({cross_validated("technology")}) UNION ALL
                  SELECT 'street_parked', * FROM ({cross_validated("street_parked")})),
                 (SELECT cv_mae_mean AS base FROM ({cross_validated("technology, street_parked")}))"""
    ),
)
def feature_ablation_whole_tree(spark, folder):
    sets = {"both": PAIR, "technology": PAIR[:1], "street_parked": PAIR[1:]}
    table = models.feature_ablation(demo.offline(spark, folder), sets, LABEL, whole_tree())
    return table.select("columns", F.round("cv_mae_mean", 6).alias("cv_mae_mean"), (F.round("difference", 6) + 0.0).alias("difference"))


@query(
    "feature_importance_whole_tree",
    "",
    "SELECT 'technology' AS feature, 0.0::DOUBLE AS importance UNION ALL SELECT 'num_images', 1.0 UNION ALL SELECT 'street_parked', 0.0",
)
def feature_importance_whole_tree(spark, folder):
    """A label that one feature determines: all importance is its own."""
    rows = demo.listings(spark, folder).select(KEY, *PAIR, "num_images", (F.col("num_images") % 5).alias(LABEL))
    columns = [*PAIR, "num_images"]
    model = models.train(rows, columns, LABEL, whole_tree())
    return models.feature_importance(model, columns, rows).withColumn("importance", F.round("importance", 6))


def registered_tree(spark, folder):
    """The tree of all features in which only the pair varies, as the champion of a registry."""
    rows = demo.offline(spark, folder).select(
        KEY, LABEL, *PAIR, *[F.lit(0.0).alias(c) for c in FEATURES if c not in PAIR]
    )
    return rows, models.train(rows, FEATURES, LABEL, whole_tree())


MEANS = "(SELECT technology, street_parked, avg(num_reservations) AS m FROM offline GROUP BY ALL)"
ROUNDED = half_up("m", 2)


@query(
    "score_by_id_whole_tree",
    "offline online",
    f"""SELECT vehicle_id, predicted_reservations, CASE WHEN predicted_reservations IS NOT NULL THEN '1' END AS model_version
        FROM (SELECT c_custkey * 10 AS vehicle_id, {ROUNDED} AS predicted_reservations
        FROM customer LEFT JOIN (SELECT online.vehicle_id AS id, m FROM online JOIN {MEANS} USING (technology, street_parked))
        ON id = c_custkey * 10)""",
)
def score_by_id_whole_tree(spark, folder):
    _, model = registered_tree(spark, folder)
    ids = demo.table(spark, folder, "customer").select((F.col("c_custkey") * 10).alias(KEY))
    scored, unknown = score_ids(ids, demo.online(spark, folder), model, "1")
    columns = [KEY, "predicted_reservations", "model_version"]
    return scored.select(*columns).unionByName(models.without_model(unknown).select(*columns))


@query(
    "score_new_arrivals_whole_tree",
    "offline online",
    f"""SELECT vehicle_id, {ROUNDED} AS predicted_reservations, '1' AS model_version
        FROM online JOIN {MEANS} USING (technology, street_parked)""",
)
def score_new_arrivals_whole_tree(spark, folder):
    _, model = registered_tree(spark, folder)
    rows = score_new_arrivals(demo.features(spark, folder), demo.online(spark, folder), model, "1")
    return rows.select(KEY, "predicted_reservations", "model_version")


@query(
    "registry_run_metrics",
    "offline",
    placed(
        f"""SELECT 'demand' AS model_name, CAST(1 AS BIGINT) AS version, name, round(value, 6) AS value FROM (
            SELECT 'cv_mae_mean' AS name, cv_mae_mean AS value FROM ({cross_validated("technology, street_parked")})
            UNION ALL SELECT 'train_mae', avg(abs(num_reservations - m)) FROM offline JOIN {MEANS} USING (technology, street_parked)
            UNION ALL SELECT 'train_rmse', sqrt(avg((num_reservations - m) ** 2)) FROM offline
            JOIN {MEANS} USING (technology, street_parked))"""
    ),
)
def registry_run_metrics(spark, folder):
    """A run logged and registered in a fresh registry, read back from it."""
    registry = Registry(spark, scratch_path(spark, "registry")).create()
    model, metrics = models.run_metrics(demo.offline(spark, folder), PAIR, LABEL, whole_tree())
    path = registry.log_run("run", model, metrics, {"depth": DEPTH}, {})
    registry.register("demand", "run", path)
    logged = registry.table("metrics").where(F.col("name").isin("cv_mae_mean", "train_mae", "train_rmse"))
    versions = registry.table("versions").select("model_name", "version", "run_id")
    return versions.join(logged, "run_id").select("model_name", "version", "name", F.round("value", 6).alias("value"))
