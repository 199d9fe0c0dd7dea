"""Training, promotion and scoring jobs on the stores and the registry."""

from __future__ import annotations

import logging
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.functions import rounded_map
from demandloom.operators.features import new_arrivals, null_guard, price_diff, validate_rows
from demandloom.operators.models import (
    FOLDS,
    FOREST_PARAMS,
    forest,
    run_metrics,
    score,
    score_known,
    without_model,
)
from demandloom.operators.registry import CANDIDATE, COMPARED_METRIC, promote
from demandloom.operators.stores import online_lookup
from demandloom.schemas import LISTING_VIEW, listing_rules
from demandloom.sources.events import to_events, write_events
from demandloom.sources.registry import Registry
from demandloom.sources.snapshots import Snapshot
from demandloom.sources.tables import scan_offline

log = logging.getLogger(__name__)


def train_candidate(
    spark: SparkSession,
    offline_path: str,
    registry: Registry,
    model_name: str,
    params: dict[str, int] | None = None,
    folds: int = FOLDS,
) -> int:
    """Cross-validate and fit on the offline store, log the run, register it as candidate."""
    params = {**FOREST_PARAMS, **(params or {})}
    columns, label = LISTING_VIEW.feature_names, LISTING_VIEW.label
    rows = scan_offline(spark, offline_path).select(LISTING_VIEW.key, label, *columns)
    model, metrics = run_metrics(rows, columns, label, forest(**params), folds, LISTING_VIEW.key)
    run_id = uuid.uuid4().hex
    path = registry.log_run(
        run_id, model, metrics, params, {"model_type": "RandomForestRegressor", "feature_source": "feature_store"}
    )
    return registry.register(model_name, run_id, path)


def promote_models(
    registry: Registry,
    model_name: str | None = None,
    version: int | None = None,
    metric: str = COMPARED_METRIC,
    candidate_alias: str = CANDIDATE,
    events_path: str | None = None,
    batch: int = 0,
) -> DataFrame:
    """Decide for one model or for all, move the champion aliases and announce the promotions.

    A `version` of the named model goes before its candidate alias.

    A decision holds for the snapshot it was made on; if the registry changed meanwhile it is made
    again. A failed announcement is logged and does not undo a promotion.
    """
    spark = registry.spark
    if version is not None and model_name is None:
        raise ValueError("a version needs the name of its model")
    explicit = None
    if version is not None:
        explicit = spark.range(1).select(
            F.lit(model_name).alias("model_name"), F.lit(version).cast("long").alias("version")
        )

    def decide(now: Snapshot) -> DataFrame:
        aliases = registry.table("aliases", now)
        if model_name is not None:
            aliases = aliases.where(F.col("model_name") == model_name)
        tables = registry.table("versions", now), aliases, registry.table("metrics", now)
        return promote(*tables, metric, explicit, candidate_alias)

    decisions = registry.promote(decide)
    if events_path is not None:
        moved = decisions.where("promoted").selectExpr(
            "model_name", "cast(candidate_version as string) AS version"
        )
        try:
            write_events(to_events(moved, ["model_name", "version"]), events_path, batch)
        except Exception:
            log.exception("promotion events were not written")
    return decisions


def champion_model(registry: Registry, model_name: str) -> tuple[PipelineModel | None, str | None]:
    """The loaded champion and its version; nothing when there is none."""
    found = registry.champion(model_name)
    if found is None:
        return None, None
    version, path = found
    return PipelineModel.load(path), str(version)


def score_listings(listings: DataFrame, model: PipelineModel | None, version: str | None) -> DataFrame:
    """Score raw listings; the price gap is computed on the way.

    Rows that lack a feature are returned without a prediction, like all rows when there is no model.
    """
    rows = price_diff(listings)
    if model is None:
        return without_model(rows)
    complete, incomplete = null_guard(rows, LISTING_VIEW.feature_names)
    return score(complete, model, version).unionByName(without_model(incomplete))


def score_request(
    listings: DataFrame, model: PipelineModel | None, version: str | None
) -> tuple[DataFrame, DataFrame]:
    """Scores of the listings that keep every rule, and the others with the names of the rules they break.

    A listing need not have an id to be scored.
    """
    rules = {name: rule for name, rule in listing_rules().items() if name != LISTING_VIEW.key}
    valid, rejected = validate_rows(listings, rules)
    return score_listings(valid, model, version), rejected


def served_importances(registry: Registry, model_name: str) -> DataFrame:
    """Version and feature importances of the champion as a map of their own; no row without a champion."""
    spark = registry.spark
    schema = "model_name string, version long, importances map<string, double>"
    found = registry.champion(model_name)
    if found is None:
        return spark.createDataFrame([], schema)
    version, path = found
    weights = PipelineModel.load(path).stages[-1].featureImportances.toArray().tolist()
    named = dict(zip(LISTING_VIEW.feature_names, weights, strict=True))
    rows = spark.createDataFrame([(model_name, version, named)], schema)
    return rows.withColumn("importances", rounded_map("importances"))


def score_ids(
    ids: DataFrame, online: DataFrame, model: PipelineModel, version: str | None
) -> tuple[DataFrame, DataFrame]:
    """Score ids by their online features; ids without a complete feature row are returned apart."""
    rows = online_lookup(online, ids, LISTING_VIEW.key).select(
        LISTING_VIEW.key, *LISTING_VIEW.feature_names
    )
    return score_known(rows, LISTING_VIEW.feature_names, model, version)


def score_new_arrivals(
    catalog: DataFrame, online: DataFrame, model: PipelineModel, version: str | None
) -> DataFrame:
    """Score every listing without an outcome; those not in the online store yet are skipped."""
    waiting = new_arrivals(catalog, LISTING_VIEW.label).select(LISTING_VIEW.key)
    rows = online.join(waiting, LISTING_VIEW.key, "left_semi").select(
        LISTING_VIEW.key, *LISTING_VIEW.feature_names
    )
    complete, _ = null_guard(rows, LISTING_VIEW.feature_names)
    return score(complete, model, version)
