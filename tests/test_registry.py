from datetime import datetime

import pytest
from conftest import rows

from demandloom.operators import registry as reg

AT = datetime(2025, 1, 1)


def tables(spark, candidate, champion, candidate_run="r2", champion_run="r1", with_champion=True):
    """One model: version 2 is the candidate, version 1 the champion if there is one."""
    versions = spark.createDataFrame(
        [("m", 1, champion_run, "p1", AT), ("m", 2, candidate_run, "p2", AT)],
        "model_name string, version long, run_id string, model_path string, created_at timestamp",
    )
    pointers = [("m", "candidate", 1, AT), ("m", "candidate", 2, datetime(2025, 1, 2))]
    if with_champion:
        pointers.append(("m", "champion", 1, AT))
    aliases = spark.createDataFrame(pointers, "model_name string, alias string, version long, assigned_at timestamp")
    values = [(r, "cv_mae_mean", v) for r, v in (("r1", champion), ("r2", candidate)) if v is not None]
    metrics = spark.createDataFrame(values, "run_id string, name string, value double")
    return versions, aliases, metrics


@pytest.mark.parametrize(
    "candidate,champion,with_champion,outcome,promoted",
    [
        (2.5, None, False, "first_champion", True),
        (2.0, 3.0, True, "better", True),
        (4.0, 3.0, True, "not_better", False),
        (3.0, 3.0, True, "not_better", False),
        (None, 3.0, True, "candidate_metric_missing", False),
        (None, None, False, "candidate_metric_missing", False),
        (2.5, None, True, "champion_metric_missing", True),
        (float("nan"), 3.0, True, "not_better", False),
        (3.0, float("nan"), True, "not_better", False),
    ],
)
def test_decisions(spark, candidate, champion, with_champion, outcome, promoted):
    got = reg.promote(*tables(spark, candidate, champion, with_champion=with_champion)).first()
    assert (got.outcome, got.promoted, got.candidate_version) == (outcome, promoted, 2)


def test_versions_without_a_run(spark):
    got = reg.promote(*tables(spark, 2.0, 3.0, candidate_run=None)).first()
    assert (got.outcome, got.promoted) == ("candidate_without_run", None)
    got = reg.promote(*tables(spark, 2.0, 3.0, champion_run=None)).first()
    assert (got.outcome, got.promoted) == ("champion_without_run", None)


def test_an_explicit_version_goes_before_the_alias(spark):
    versions, aliases, metrics = tables(spark, 2.0, 3.0)
    named = spark.createDataFrame([("m", 1)], "model_name string, version long")
    got = reg.promote(versions, aliases, metrics, explicit=named).first()
    assert (got.candidate_version, got.outcome) == (1, "not_better")
    resolved = reg.alias_metric_join(versions, aliases, metrics)
    assert rows(resolved) == [("m", 2, "r2", 2.0)]


def test_promotion_moves_the_champion(spark):
    versions, aliases, metrics = tables(spark, 2.0, 3.0)
    moved = aliases.unionByName(reg.promoted_aliases(reg.promote(versions, aliases, metrics)))
    champion = reg.current_aliases(moved).where("alias = 'champion'")
    assert rows(champion, "version") == [(2,)]


def test_registration_counts_up_per_model(spark):
    versions, _, _ = tables(spark, 2.0, 3.0)
    runs = spark.createDataFrame(
        [("m", "r3", "p3"), ("new", "n1", "q1")], "model_name string, run_id string, model_path string"
    )
    added, alias = reg.register_candidate(versions, runs, AT)
    assert rows(added, "model_name", "version", "run_id") == [("m", 3, "r3"), ("new", 1, "n1")]
    assert rows(alias, "model_name", "alias", "version") == [("m", "candidate", 3), ("new", "candidate", 1)]


def test_model_info_rounds_metrics(spark):
    versions, aliases, _ = tables(spark, 2.0, 3.0)
    metrics = spark.createDataFrame([("r1", "cv_mae_mean", 3.123456), ("r2", "cv_mae_mean", 1.0)], "run_id string, name string, value double")
    params = spark.createDataFrame([("r1", "depth", "10")], "run_id string, name string, value string")
    runs = spark.createDataFrame([("r1", AT)], "run_id string, started_at timestamp")
    got = reg.model_info(versions, aliases, metrics, params, runs).first()
    assert (got.version, got.metrics, got.params, got.started_at) == (1, {"cv_mae_mean": 3.1235}, {"depth": "10"}, AT)


def test_comparison_and_importances(spark):
    m = spark.createDataFrame([("forest", 3.45), ("boosting", 3.74), ("none", None)], "model string, value double")
    assert tuple(reg.model_compare(m).first()) == ("forest", 3.45)
    a = spark.createDataFrame([("x", 0.7), ("y", 0.3)], "feature string, importance double")
    b = spark.createDataFrame([("y", 0.9), ("z", 0.1)], "feature string, importance double")
    assert rows(reg.align_importances(a, b, ("a", "b"))) == [("x", 0.7, None), ("y", 0.3, 0.9), ("z", None, 0.1)]
    assert [r.feature for r in reg.rank_importances(a).collect()] == ["y", "x"]
    p = spark.createDataFrame([("r", "b", "2"), ("r", "a", "1")], "run_id string, name string, value string")
    assert [r.name for r in reg.sorted_params(p).collect()] == ["a", "b"]
