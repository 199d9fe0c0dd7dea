import numpy as np
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from demandloom.operators import ranges

SLOW = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


@pytest.mark.parametrize("n,k", [(0, 5), (1, 5), (3, 5), (13, 5), (100, 7), (1000, 5)])
def test_folds_are_contiguous_and_as_even_as_ntile(spark, n, k):
    df = spark.range(n).select((F.col("id") * 3 + 1).alias("key"))
    got = {r.key: r.fold for r in ranges.kfold_assign(df, "key", k).collect()}
    sizes = [n // k + (1 if i < n % k else 0) for i in range(k)]
    expected = [f for f, size in enumerate(sizes) for _ in range(size)]
    assert [got[key] for key in sorted(got)] == expected


def test_positions_are_dense_for_any_spread(spark):
    keys = spark.range(5000).select(F.pow(F.col("id"), 3).cast("long").alias("key"))
    got = ranges.dense_position(keys, "key", "p").orderBy("key").collect()
    assert [r.p for r in got] == list(range(5000))


def test_positions_restart_in_every_group(spark):
    df = spark.range(900).select("id", F.when(F.col("id") < 600, "hot").otherwise("cold").alias("g"))
    got = ranges.dense_position(df, "id", "p", by=["g"])
    assert rows(got.groupBy("g").agg(F.min("p"), F.max("p"), F.countDistinct("p"))) == [
        ("cold", 0, 299, 300),
        ("hot", 0, 599, 600),
    ]


def test_large_keys_keep_their_order(spark):
    base = 2**62
    df = spark.range(1000).select((F.lit(base) + F.col("id")).alias("key"))
    got = ranges.dense_position(df, "key", "p")
    assert got.where(F.col("p") != F.col("key") - base).count() == 0


def test_shuffle_is_a_permutation_fixed_by_the_seed(spark):
    df = spark.range(2000).withColumnRenamed("id", "key")
    one = rows(ranges.shuffled_position(df, "key", 1))
    again = rows(ranges.shuffled_position(df.repartition(7), "key", 1))
    other = rows(ranges.shuffled_position(df, "key", 2))
    assert one == again and one != other
    assert sorted(p for _, p in one) == list(range(2000))
    assert sum(k == p for k, p in one) < 50


@SLOW
@given(
    data=st.lists(
        st.tuples(st.sampled_from(["a", "b"]), st.one_of(st.none(), st.integers(-5, 5), st.floats(-1e6, 1e6))),
        min_size=1,
        max_size=60,
    ),
    pieces=st.integers(2, 9),
)
def test_quantiles_equal_numpy(spark, data, pieces):
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in data], "g string, v double")
    probabilities = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {
        r.g: (r.n, [r[f"q{i}"] for i in range(5)])
        for r in ranges.exact_quantiles(df, ["v"], probabilities, ["g"], pieces).collect()
    }
    groups = {g for g, v in data if v is not None}
    assert set(got) == groups
    for g in groups:
        values = [float(v) for h, v in data if h == g and v is not None]
        assert got[g][0] == len(values)
        assert np.allclose(got[g][1], np.quantile(values, probabilities), rtol=1e-12, atol=1e-9)


def test_quantiles_of_a_dominant_group_and_value(spark):
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "rest").otherwise("hot").alias("g"),
        F.when(F.col("id") % 2 == 0, 5.0).otherwise(F.col("id").cast("double")).alias("v"),
    )
    frame = df.toPandas()
    for r in ranges.exact_quantiles(df, ["v"], [0.1, 0.5, 0.99], ["g"]).collect():
        want = np.quantile(frame.v[frame.g == r.g], [0.1, 0.5, 0.99])
        assert np.allclose([r.q0, r.q1, r.q2], want)


def test_quantiles_skip_nan_and_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "v double")
    got = ranges.exact_quantiles(df, ["v"], [0.5]).first()
    assert (got.n, got.q0) == (2, 2.0)
    assert ranges.exact_quantiles(df.where("v is null"), ["v"], [0.5]).count() == 0
