"""Every registered query against its SQL, and the shape of every physical plan."""

import pytest
from conftest import SMALL

from __spark_entry__ import entry
from demandloom.registered import QUERIES, SQL
from tools.check_oracle import compare, connect

FITTED = {
    "train_rf", "train_gbt", "cross_validate", "feature_importance", "permutation_importance",
    "feature_ablation", "score_batch", "score_by_id", "score_new_arrivals", "sink_registry",
    "stream_champion_scoring",
}


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_only_fitted_models_go_without_sql():
    assert set(QUERIES) - set(SQL) == FITTED
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry(spark).count() == 200


@pytest.mark.parametrize("name", sorted(SQL))
def test_result_equals_sql(spark, con, name):
    """Also: no plan pairs all rows of two sides or sends rows through Python."""
    df = QUERIES[name](spark, SMALL)
    assert compare(df, SQL[name], con) is None
    plan = plan_of(df)
    for word in ("CartesianProduct", "NestedLoop", "EvalPython", "InPandas", "InArrow"):
        assert word not in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_columns_reach_the_scan(spark):
    plan = plan_of(QUERIES["feature_build"](spark, SMALL))
    assert "ReadSchema: struct<user_id:bigint>" in plan
    assert plan_of(QUERIES["scan_projected"](spark, SMALL)).count("l_extendedprice") == 0


@pytest.mark.parametrize("name", ["latest_per_key", "upsert_latest", "split_and_limit", "resolve_features"])
def test_rank_filters_run_before_the_shuffle(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert "Partial" in plan and "WindowGroupLimit" in plan


def test_counts_of_quantiles_are_shuffled_once(spark):
    df = QUERIES["box_stats_events"](spark, SMALL)
    df.collect()
    assert "ReusedExchange" in plan_of(df)
