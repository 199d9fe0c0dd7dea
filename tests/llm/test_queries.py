"""Registered queries of this folder against their SQL, on whole tables."""

import pytest
from conftest import SMALL

from demandloom.llm.queries import QUERIES, SQL
from tools.check_oracle import compare, connect


@pytest.mark.parametrize("name", sorted(SQL))
def test_result_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SMALL), SQL[name], connect(SMALL)) is None


@pytest.mark.parametrize("name", ["op2_host_rules", "op3_hilbert_shards", "op4_url_filter"])
def test_native_operators_stay_in_the_jvm(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop") if word in plan]


def test_one_query_for_each_operator():
    assert [int(q.split("_")[0][2:]) for q in QUERIES] == list(range(1, 14))
