import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from demandloom.operators import metrics, profile


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    n = 700
    return pd.DataFrame(
        {
            "g": np.where(rng.random(n) < 0.7, "hot", "cold"),
            "x": np.round(rng.normal(50, 20, n), 2),
            "y": rng.integers(0, 12, n).astype(float),
            "flat": np.full(n, 3.0),
            "gappy": np.where(rng.random(n) < 0.3, np.nan, rng.normal(0, 1, n)),
        }
    )


@pytest.fixture(scope="module")
def df(spark, frame):
    made = spark.createDataFrame(frame)
    return made.withColumn("gappy", F.when(~F.isnan("gappy"), F.col("gappy")))


def test_describe_equals_pandas(df, frame):
    got = {r["column"]: r for r in profile.describe(df, ["x", "y", "gappy"]).collect()}
    want = frame.describe()
    for c in ("x", "y", "gappy"):
        r = got[c]
        mine = [r["count"], r["mean"], r["std"], r["min"], r["q25"], r["q50"], r["q75"], r["max"]]
        assert np.allclose(mine, want[c].to_numpy(), rtol=1e-10)


def test_describe_of_one_row_has_no_deviation(spark):
    one = spark.createDataFrame([(4.0,)], "x double")
    r = profile.describe(one, ["x"]).first()
    assert r["std"] is None and r["q25"] == r["max"] == 4.0


def test_approximate_quantiles_have_the_same_shape(df):
    exact, approx = profile.describe(df, ["x"]), profile.describe(df, ["x"], approx=True)
    assert exact.columns == approx.columns
    assert abs(exact.first()["q50"] - approx.first()["q50"]) < 0.5


def test_info_and_nunique(df, frame):
    info = {r["column"]: (r["non_null"], r["dtype"]) for r in profile.info(df).collect()}
    assert info["gappy"] == (int(frame.gappy.notna().sum()), "double") and info["g"] == (700, "string")
    unique = {r["column"]: (r["distinct"], r["bar_chart"]) for r in profile.nunique(df, ["g", "y", "gappy"]).collect()}
    assert unique == {"g": (2, True), "y": (12, False), "gappy": (frame.gappy.nunique(), False)}


def test_value_counts_in_value_order(df, frame):
    got = [(r.y, r["count"]) for r in profile.value_counts(df, "y").collect()]
    assert got == [(k, int(v)) for k, v in frame.y.value_counts().sort_index().items()]


def test_histogram_equals_numpy(df, frame):
    got = profile.histogram(df, ["x", "y", "flat", "gappy"]).orderBy("column", "bin").toPandas()
    for c in ("x", "y", "flat", "gappy"):
        counts, edges = np.histogram(frame[c].dropna(), bins=30)
        mine = got[got["column"] == c]
        assert mine["count"].tolist() == counts.tolist(), c
        assert np.allclose([*mine.lower, mine.upper.iloc[-1]], edges)


def test_box_statistics(df, frame):
    for r in profile.box_stats(df, "g", "x").collect():
        values = frame.x[frame.g == r.g]
        q1, q2, q3 = np.percentile(values, [25, 50, 75])
        reach = 1.5 * (q3 - q1)
        inside = values[(values >= q1 - reach) & (values <= q3 + reach)]
        assert np.allclose([r.q1, r.median, r.q3], [q1, q2, q3])
        assert (r.whisker_low, r.whisker_high) == (inside.min(), inside.max())
        assert r.outliers == len(values) - len(inside) and r.n == len(values)


def test_correlations_equal_pandas(df, frame):
    columns = ["x", "y", "flat", "gappy"]
    want = frame[columns].corr()
    got = profile.corr_matrix(df, columns).collect()
    assert len(got) == 16
    for r in got:
        expected = want.loc[r.a, r.b]
        assert r["corr"] is None if np.isnan(expected) else np.isclose(r["corr"], expected)
    ranked = [r["column"] for r in profile.corr_to_target(df, ["x", "flat"], "y").collect()]
    assert ranked == ["y", "x", "flat"]
    assert np.isclose(profile.corr_pair(df, "x", "y").first()[0], want.loc["x", "y"])


def test_group_means_and_lift(df, frame):
    got = {r.g: r for r in profile.mean_by_group(df, "g", "x").collect()}
    for g, values in frame.groupby("g").x:
        assert np.allclose([got[g]["mean"], got[g]["median"], got[g]["count"]], [values.mean(), values.median(), len(values)])
    flagged = df.withColumn("flag", (F.col("g") == "hot").cast("int"))
    lift = profile.group_lift(flagged, "flag", "x").first().lift
    means = frame.groupby("g").x.mean()
    assert np.isclose(lift, means["hot"] / means["cold"] - 1)


def test_weeks_end_on_sunday_and_have_no_gaps(spark):
    days = ["2025-01-05 23:59:59", "2025-01-06 00:00:00", "2025-01-27 12:00:00", None]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.col("d").cast("timestamp").alias("ts"))
    got = profile.weekly_counts(df, "ts").orderBy("week").collect()
    series = pd.Series(1, index=pd.to_datetime([d for d in days if d])).resample("W").size()
    assert [(r.week, r["count"]) for r in got] == [(i.date(), int(n)) for i, n in series.items()]
    assert profile.weekly_counts(df.limit(0), "ts").count() == 0


def test_latency_summary(spark):
    f, p = [0.1, 0.2, 0.4, 2.0], [1.0, 3.0, 2.0, 5.0]
    df = spark.createDataFrame([("raw", a, b) for a, b in zip(f, p)], "source string, f double, p double")
    r = profile.latency_summary(df, "f", "p", "source").first()
    total = np.add(f, p)
    want = [total.mean(), *np.percentile(total, [50, 95, 99]), np.mean(f), np.mean(p)]
    mine = [r.avg_latency_ms, r.p50_latency_ms, r.p95_latency_ms, r.p99_latency_ms, r.avg_features_ms, r.avg_predict_ms]
    assert np.allclose(mine, want, atol=6e-4) and r.n_iterations == 4


def test_regression_metrics(spark):
    y, p = [1.0, 2.0, 4.0], [1.5, 2.0, 3.0]
    df = spark.createDataFrame(list(zip(y, p)), "y double, p double")
    r = metrics.regression_metrics(df, "y", "p").first()
    e = np.subtract(y, p)
    assert np.allclose([r.mae, r.rmse, r.r2], [np.abs(e).mean(), np.sqrt((e**2).mean()), 1 - (e**2).sum() / np.var(y) / 3])
    flat = spark.createDataFrame([(1.0, 1.5), (1.0, 1.0)], "y double, p double")
    assert metrics.regression_metrics(flat, "y", "p").first().r2 is None


def test_folds_weigh_the_same(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0), (0, 1.0, 0.0), (1, 1.0, 0.5)], "fold int, y double, p double")
    r = metrics.fold_metrics(df, "fold", "y", "p").first()
    assert (r.cv_mae_mean, r.cv_mae_std, r.folds) == (0.75, 0.25, 2)


def test_counting_by_condition(spark):
    df = spark.createDataFrame([(0,), (1,), (None,)], "n int")
    r = profile.count_where(df, F.col("n") == 0).first()
    assert (r.matching, r.total) == (1, 3) and np.isclose(r.share, 1 / 3)
    assert rows(profile.distinct_values(df.dropna(), "n")) == [(0,), (1,)]
    bins = profile.mean_by_bin(df, F.col("n"), "n")
    assert rows(bins) == sorted([(None, None, 0), (0, 0.0, 1), (1, 1.0, 1)], key=repr)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_time_summaries_equal_pandas(spark, kind):
    texts = ["2025-01-01 00:00:00", "2025-01-02 12:30:00.25", "2025-03-09 02:30:00", "2024-06-30 23:59:59.999999", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").cast(kind).alias("ts"))
    r = profile.describe_times(df, ["ts"]).first()
    want = pd.Series(pd.to_datetime([t for t in texts if t], format="ISO8601")).describe()
    assert r["count"] == 4
    for mine, theirs in zip(["mean", "min", "q25", "q50", "q75", "max"], ["mean", "min", "25%", "50%", "75%", "max"]):
        assert abs(pd.Timestamp(r[mine]) - want[theirs]) <= pd.Timedelta(1, "us"), mine
