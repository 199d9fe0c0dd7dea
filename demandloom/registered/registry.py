"""Model registry and model selection on tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.operators import profile, registry as reg
from demandloom.registered.base import half_up, query
from demandloom.registered.joins import _weights
from demandloom.schemas import EXPLORED_FEATURES, LISTING_VIEW
from demandloom.sources import demo

LABEL = LISTING_VIEW.label


@query(
    "register_candidate",
    "registry_versions",
    """SELECT model_name, max(version) + 1 AS version, 'new_' || model_name AS run_id, 'candidate' AS alias
       FROM registry_versions GROUP BY model_name""",
)
def register_candidate(spark, folder):
    versions = demo.versions(spark, folder)
    runs = versions.select("model_name").distinct().select(
        "model_name",
        F.concat(F.lit("new_"), "model_name").alias("run_id"),
        F.concat(F.lit("models/"), "model_name").alias("model_path"),
    )
    new, alias = reg.register_candidate(versions, runs)
    return new.join(alias, ["model_name", "version"]).select("model_name", "version", "run_id", "alias")


DECISIONS = """SELECT c.model_name, c.version AS candidate_version, round(c.metric, 2) AS candidate_metric,
    h.version AS champion_version, round(h.metric, 2) AS champion_metric,
    CASE WHEN c.metric IS NULL THEN 'candidate_metric_missing'
         WHEN h.version IS NULL THEN 'first_champion'
         WHEN h.metric IS NULL THEN 'champion_metric_missing'
         WHEN c.metric < h.metric THEN 'better' ELSE 'not_better' END AS outcome,
    CASE WHEN c.metric IS NULL THEN false WHEN h.version IS NULL THEN true WHEN h.metric IS NULL THEN true
         ELSE c.metric < h.metric END AS promoted
    FROM candidates c LEFT JOIN champions h USING (model_name)"""


def decide(spark, folder):
    return reg.promote(demo.versions(spark, folder), demo.aliases(spark, folder), demo.metrics(spark, folder))


@query("promote", "candidates champions", DECISIONS)
def promote(spark, folder):
    return decide(spark, folder).withColumns(
        {c: F.round(c, 2) for c in ("candidate_metric", "champion_metric")}
    )


@query(
    "promoted_aliases",
    "candidates champions",
    f"""SELECT m.model_name, coalesce(p.version, h.version) AS champion_version
        FROM (SELECT DISTINCT model_name FROM registry_versions) m
        LEFT JOIN (SELECT model_name, candidate_version AS version FROM ({DECISIONS}) WHERE promoted) p USING (model_name)
        LEFT JOIN champions h USING (model_name)
        WHERE p.version IS NOT NULL OR h.version IS NOT NULL""",
)
def promoted_aliases(spark, folder):
    moved = demo.aliases(spark, folder).unionByName(reg.promoted_aliases(decide(spark, folder)))
    current = reg.current_aliases(moved).where(F.col("alias") == "champion")
    return current.select("model_name", F.col("version").alias("champion_version"))


@query(
    "model_info",
    "champions",
    f"""SELECT model_name, version, run_id, {half_up('metric', 4)} AS cv_mae_mean, {half_up('train_mae', 4)} AS train_mae,
       segment, account, CAST(nation AS VARCHAR) AS nation, 1000000000 + version AS started_at FROM champions""",
)
def model_info(spark, folder):
    info = reg.model_info(
        demo.versions(spark, folder),
        demo.aliases(spark, folder),
        demo.metrics(spark, folder),
        demo.params(spark, folder),
        demo.runs(spark, folder),
    )
    return info.select(
        "model_name",
        "version",
        "run_id",
        F.try_element_at("metrics", F.lit("cv_mae_mean")).alias("cv_mae_mean"),
        F.try_element_at("metrics", F.lit("train_mae")).alias("train_mae"),
        *[F.try_element_at("params", F.lit(p)).alias(p) for p in ("segment", "account", "nation")],
        F.unix_seconds("started_at").alias("started_at"),
    )


@query(
    "model_compare",
    "registry_versions",
    """SELECT first(segment ORDER BY value, segment) AS best_model, round(min(value), 6) AS best_value FROM (
       SELECT segment, avg(metric) AS value FROM registry_versions GROUP BY segment)""",
)
def model_compare(spark, folder):
    compared = (
        demo.metrics(spark, folder)
        .where(F.col("name") == "cv_mae_mean")
        .join(demo.params(spark, folder).where(F.col("name") == "segment").select("run_id", F.col("value").alias("model")), "run_id")
        .groupBy("model")
        .agg(F.avg("value").alias("value"))
    )
    return reg.model_compare(compared).withColumn("best_value", F.round("best_value", 6))


@query(
    "sorted_params",
    "registry_versions",
    """SELECT run_id, 'account' AS name, account AS value FROM registry_versions UNION ALL
       SELECT run_id, 'nation', CAST(nation AS VARCHAR) FROM registry_versions UNION ALL
       SELECT run_id, 'segment', segment FROM registry_versions""",
)
def sorted_params(spark, folder):
    return reg.sorted_params(demo.params(spark, folder))


@query(
    "rank_importances",
    "explored",
    f"""SELECT feature, round(importance, 6) AS importance FROM ({_weights(EXPLORED_FEATURES, LABEL)})""",
)
def rank_importances(spark, folder):
    weights = profile.corr_to_target(demo.explored(spark, folder), EXPLORED_FEATURES, LABEL)
    rows = weights.where(F.col("column") != LABEL).select(
        F.col("column").alias("feature"), F.round("corr", 6).alias("importance")
    )
    return reg.rank_importances(rows)
