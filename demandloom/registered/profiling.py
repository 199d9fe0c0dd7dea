"""Aggregations and profiles. Statistics are rounded to six places on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.functions import micros_of
from demandloom.operators import features as feat, metrics, profile
from demandloom.operators.ranges import kfold_assign
from demandloom.registered.base import half_up, query
from demandloom.schemas import EXPLORED_FEATURES, LISTING_VIEW, RAW_ATTRIBUTES
from demandloom.sources import demo

KEY, LABEL = LISTING_VIEW.key, LISTING_VIEW.label
ITEM_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def union_all(template, columns):
    return " UNION ALL ".join(template.format(c=c) for c in columns)


@query("count_per_key", "", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey")
def count_per_key(spark, folder):
    return feat.count_per_key(demo.table(spark, folder, "lineitem"), "l_partkey")


@query(
    "count_where",
    "explored",
    """SELECT count(*) FILTER (WHERE num_reservations = 0) AS matching, count(*) AS total,
       round(count(*) FILTER (WHERE num_reservations = 0) / count(*), 6) AS share FROM explored""",
)
def count_where(spark, folder):
    return rounded(profile.count_where(demo.explored(spark, folder), F.col(LABEL) == 0), "share")


@query("distinct_values", "listings", "SELECT DISTINCT source FROM listings")
def distinct_values(spark, folder):
    return profile.distinct_values(demo.listings(spark, folder), "source")


@query(
    "mean_by_group",
    "explored",
    """SELECT technology, round(avg(num_reservations), 6) AS mean, round(quantile_cont(num_reservations, 0.5), 6) AS median,
       count(num_reservations) AS count FROM explored GROUP BY technology""",
)
def mean_by_group(spark, folder):
    return rounded(profile.mean_by_group(demo.explored(spark, folder), "technology", LABEL), "mean", "median")


@query(
    "mean_by_group_items",
    "",
    """SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean,
       round(quantile_cont(l_extendedprice, 0.5), 4) AS median, count(*) AS count FROM lineitem GROUP BY l_returnflag""",
)
def mean_by_group_items(spark, folder):
    items = demo.table(spark, folder, "lineitem")
    return rounded(profile.mean_by_group(items, "l_returnflag", "l_extendedprice"), "mean", "median", digits=4)


@query(
    "group_lift",
    "explored",
    """SELECT round(off, 6) AS mean_off, round(on_, 6) AS mean_on, round(on_ / off - 1, 6) AS lift FROM (
       SELECT avg(num_reservations) FILTER (WHERE technology = 0) AS off,
              avg(num_reservations) FILTER (WHERE technology = 1) AS on_ FROM explored)""",
)
def group_lift(spark, folder):
    return rounded(
        profile.group_lift(demo.explored(spark, folder), "technology", LABEL), "mean_off", "mean_on", "lift"
    )


@query(
    "mean_by_bin",
    "explored",
    """SELECT CAST(floor(description / 50) AS BIGINT) AS bin, round(avg(num_reservations), 6) AS mean,
       count(num_reservations) AS count FROM explored GROUP BY 1""",
)
def mean_by_bin(spark, folder):
    bins = F.floor(F.col("description") / 50)
    return rounded(profile.mean_by_bin(demo.explored(spark, folder), bins, LABEL), "mean")


@query(
    "mean_by_value",
    "explored",
    """SELECT num_images AS bin, round(avg(num_reservations), 6) AS mean, count(num_reservations) AS count
       FROM explored GROUP BY 1""",
)
def mean_by_value(spark, folder):
    rows = profile.mean_by_bin(demo.explored(spark, folder), F.col("num_images"), LABEL)
    return rounded(rows, "mean")


@query(
    "mean_by_threshold",
    "explored",
    """SELECT actual_price > 1000 AS bin, round(avg(num_reservations), 6) AS mean, count(num_reservations) AS count
       FROM explored GROUP BY 1""",
)
def mean_by_threshold(spark, folder):
    rows = profile.mean_by_bin(demo.explored(spark, folder), F.col("actual_price") > 1000, LABEL)
    return rounded(rows, "mean")


DESCRIBE = """SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean,
    round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min,
    round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
    round(quantile_cont({c}, 0.75), 6) AS q75, round(CAST(max({c}) AS DOUBLE), 6) AS max FROM """
DESCRIBED = ["mean", "std", "min", "q25", "q50", "q75", "max"]


def described(df, columns):
    return rounded(profile.describe(df, columns), *DESCRIBED)


@query("describe", "explored", union_all(DESCRIBE + "explored", [*EXPLORED_FEATURES, LABEL]))
def describe(spark, folder):
    return described(demo.explored(spark, folder), [*EXPLORED_FEATURES, LABEL])


@query("describe_items", "", union_all(DESCRIBE + "lineitem", ITEM_COLUMNS))
def describe_items(spark, folder):
    return described(demo.table(spark, folder, "lineitem"), ITEM_COLUMNS)


@query(
    "describe_counts",
    "",
    DESCRIBE.format(c="n") + "(SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey)",
)
def describe_counts(spark, folder):
    return described(feat.count_per_key(demo.table(spark, folder, "lineitem"), "l_partkey"), ["n"])


TIMES = ["mean", "min", "q25", "q50", "q75", "max"]


@query(
    "describe_times",
    "",
    """SELECT 'ts' AS "column", count(*) AS count, CAST(round(avg(m / 1000.0)) AS BIGINT) AS mean,
       CAST(round(min(m) / 1000.0) AS BIGINT) AS min, CAST(round(quantile_cont(m, 0.25) / 1000.0) AS BIGINT) AS q25,
       CAST(round(quantile_cont(m, 0.5) / 1000.0) AS BIGINT) AS q50,
       CAST(round(quantile_cont(m, 0.75) / 1000.0) AS BIGINT) AS q75,
       CAST(round(max(m) / 1000.0) AS BIGINT) AS max FROM (SELECT epoch_us(ts) AS m FROM events)""",
)
def describe_times(spark, folder):
    """Milliseconds of the times, for comparison."""
    rows = profile.describe_times(demo.table(spark, folder, "events"), ["ts"])
    kind = rows.schema["mean"].dataType
    return rows.withColumns({c: F.round(micros_of(c, kind) / 1000).cast("long") for c in TIMES})


INFO = [
    ("o_orderkey", "bigint"),
    ("o_custkey", "bigint"),
    ("o_orderstatus", "string"),
    ("o_totalprice", "double"),
    ("o_orderdate", "timestamp_ntz"),
    ("o_orderpriority", "string"),
]


@query(
    "info",
    "",
    " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS \"column\", count({c}) AS non_null, '{t}' AS dtype FROM orders"
        for i, (c, t) in enumerate(INFO)
    ),
)
def info(spark, folder):
    return profile.info(demo.table(spark, folder, "orders"))


@query(
    "nunique",
    "explored",
    union_all(
        "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\", count(DISTINCT {c}) <= 5 AS bar_chart FROM explored",
        RAW_ATTRIBUTES,
    ),
)
def nunique(spark, folder):
    return profile.nunique(demo.explored(spark, folder), RAW_ATTRIBUTES)


@query("value_counts", "explored", "SELECT technology, count(*) AS count FROM explored GROUP BY technology")
def value_counts(spark, folder):
    return profile.value_counts(demo.explored(spark, folder), "technology")


@query("value_counts_items", "", "SELECT l_quantity, count(*) AS count FROM lineitem GROUP BY l_quantity")
def value_counts_items(spark, folder):
    return profile.value_counts(demo.table(spark, folder, "lineitem"), "l_quantity")


def histogram_sql(columns, source, where="true"):
    values = union_all(
        f"""SELECT '{{c}}' AS "column", CAST({{c}} AS DOUBLE) AS value FROM {source} WHERE {where}""", columns
    )
    return f"""SELECT "column", bin, round(lo + bin * step, 6) AS lower,
        round(CASE WHEN bin = 29 THEN hi ELSE lo + (bin + 1) * step END, 6) AS upper, coalesce(n, 0) AS count
        FROM (SELECT *, unnest(range(0, 30)) AS bin FROM (
            SELECT "column", lo, hi, (hi - lo) / 30 AS step FROM (
                SELECT "column", CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo,
                       CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi
                FROM ({values}) GROUP BY "column")))
        LEFT JOIN (SELECT "column", bin, count(*) AS n FROM (
            SELECT "column", CASE WHEN value < lo + guess * step THEN guess - 1
                WHEN guess < 29 AND value >= lo + (guess + 1) * step THEN guess + 1 ELSE guess END AS bin
            FROM (SELECT *, least(CAST(floor((value - lo) / step) AS BIGINT), 29) AS guess FROM (
                SELECT "column", value, lo, hi, (hi - lo) / 30 AS step FROM (
                    SELECT *, CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo,
                           CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi
                    FROM (SELECT *, min(value) OVER (PARTITION BY "column") AS mn,
                                 max(value) OVER (PARTITION BY "column") AS mx FROM ({values}))))))
            GROUP BY "column", bin) USING ("column", bin)"""


@query("histogram", "explored", histogram_sql([*RAW_ATTRIBUTES, LABEL], "explored"))
def histogram(spark, folder):
    rows = profile.histogram(demo.explored(spark, folder), [*RAW_ATTRIBUTES, LABEL])
    return rounded(rows, "lower", "upper")


@query("histogram_positive", "explored", histogram_sql([LABEL], "explored", "num_reservations > 0"))
def histogram_positive(spark, folder):
    rows = profile.histogram(feat.positive_only(demo.explored(spark, folder), LABEL), [LABEL])
    return rounded(rows, "lower", "upper")


@query("histogram_items", "", histogram_sql(ITEM_COLUMNS, "lineitem"))
def histogram_items(spark, folder):
    return rounded(profile.histogram(demo.table(spark, folder, "lineitem"), ITEM_COLUMNS), "lower", "upper")


def box_sql(by, y, source):
    return f"""SELECT {by}, any_value(n) AS n, round(any_value(q1), 6) AS q1, round(any_value(q2), 6) AS median,
        round(any_value(q3), 6) AS q3,
        round(min(y) FILTER (WHERE inside), 6) AS whisker_low, round(max(y) FILTER (WHERE inside), 6) AS whisker_high,
        count(*) FILTER (WHERE NOT inside) AS outliers FROM (
          SELECT *, y BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM (
            SELECT {by}, CAST({y} AS DOUBLE) AS y FROM {source}) JOIN (
            SELECT {by}, count({y}) AS n, quantile_cont({y}, 0.25) AS q1, quantile_cont({y}, 0.5) AS q2,
                   quantile_cont({y}, 0.75) AS q3 FROM {source} GROUP BY {by}) USING ({by})) GROUP BY {by}"""


BOX = ["q1", "median", "q3", "whisker_low", "whisker_high"]


@query("box_stats", "explored", box_sql("technology", LABEL, "explored"))
def box_stats(spark, folder):
    return rounded(profile.box_stats(demo.explored(spark, folder), "technology", LABEL), *BOX)


@query("box_stats_events", "", box_sql("event_type", "value", "events"))
def box_stats_events(spark, folder):
    return rounded(profile.box_stats(demo.table(spark, folder, "events"), "event_type", "value"), *BOX)


CORR = """covar_pop({a}, {b}) / nullif(sqrt(var_pop({a})) * sqrt(var_pop({b})), 0)"""
CORRELATED = [*EXPLORED_FEATURES, LABEL]


@query(
    "corr_matrix",
    "explored",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round({CORR.format(a=a, b=b)}, 6) AS corr FROM explored"
        for a in CORRELATED
        for b in CORRELATED
    ),
)
def corr_matrix(spark, folder):
    return rounded(profile.corr_matrix(demo.explored(spark, folder), CORRELATED), "corr")


@query(
    "corr_to_target",
    "explored",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round({CORR.format(a=c, b=LABEL)}, 6) AS corr FROM explored" for c in CORRELATED
    ),
)
def corr_to_target(spark, folder):
    return rounded(profile.corr_to_target(demo.explored(spark, folder), EXPLORED_FEATURES, LABEL), "corr")


@query(
    "corr_pair",
    "explored",
    f"SELECT round({CORR.format(a='price_diff', b='price_ratio')}, 6) AS corr FROM explored",
)
def corr_pair(spark, folder):
    return rounded(profile.corr_pair(demo.explored(spark, folder), "price_diff", "price_ratio"), "corr")


def weekly_sql(ts, source):
    week = f"CAST(date_trunc('week', {ts}) AS DATE) + 6"
    return f"""SELECT CAST(week AS DATE) AS week, coalesce(n, 0) AS count FROM (
        SELECT unnest(generate_series(CAST(min({week}) AS TIMESTAMP), CAST(max({week}) AS TIMESTAMP), INTERVAL 7 DAY)) AS week
        FROM {source}) LEFT JOIN (SELECT {week} AS w, count(*) AS n FROM {source} GROUP BY 1) ON w = week"""


@query("weekly_counts", "bookings", weekly_sql("created_at", "bookings"))
def weekly_counts(spark, folder):
    return profile.weekly_counts(demo.bookings(spark, folder), "created_at")


@query("weekly_counts_orders", "", weekly_sql("o_orderdate", "orders"))
def weekly_counts_orders(spark, folder):
    return profile.weekly_counts(demo.table(spark, folder, "orders"), "o_orderdate")


LATENCY = f"""SELECT source, count(*) AS n_iterations, {half_up('avg(t)', 3)} AS avg_latency_ms,
    {half_up('quantile_cont(t, 0.5)', 3)} AS p50_latency_ms, {half_up('quantile_cont(t, 0.95)', 3)} AS p95_latency_ms,
    {half_up('quantile_cont(t, 0.99)', 3)} AS p99_latency_ms, {half_up('avg(feature_ms)', 3)} AS avg_features_ms,
    {half_up('avg(predict_ms)', 3)} AS avg_predict_ms
    FROM (SELECT *, feature_ms + predict_ms AS t FROM latencies) GROUP BY source"""


@query("latency_summary", "latencies", LATENCY)
def latency_summary(spark, folder):
    return profile.latency_summary(demo.latencies(spark, folder), "feature_ms", "predict_ms", "source")


@query(
    "latency_compare",
    "latencies",
    f"""SELECT raw_avg, store_avg, round(store_avg - raw_avg, 6) AS difference FROM (
        SELECT max(avg_latency_ms) FILTER (WHERE source = 'raw') AS raw_avg,
               max(avg_latency_ms) FILTER (WHERE source = 'online_store') AS store_avg FROM ({LATENCY}))""",
)
def latency_compare(spark, folder):
    summary = profile.latency_summary(demo.latencies(spark, folder), "feature_ms", "predict_ms", "source")
    return rounded(profile.latency_compare(summary, "source", "raw", "online_store"), "difference")


@query(
    "regression_metrics",
    "folds",
    """SELECT count(*) AS n, round(avg(abs(num_reservations - prediction)), 6) AS mae,
       round(sqrt(avg((num_reservations - prediction) ** 2)), 6) AS rmse,
       round(1 - sum((num_reservations - prediction) ** 2) / (var_pop(num_reservations) * count(*)), 6) AS r2 FROM folds""",
)
def regression_metrics(spark, folder):
    scored = demo.offline(spark, folder).withColumn("prediction", F.col("num_images") / 3.0)
    return rounded(metrics.regression_metrics(scored, LABEL, "prediction"), "mae", "rmse", "r2")


def folded(spark, folder):
    rows = demo.offline(spark, folder).withColumn("prediction", F.col("num_images") / 3.0)
    return kfold_assign(rows, KEY)


@query(
    "fold_metrics",
    "folds",
    """SELECT round(avg(mae), 6) AS cv_mae_mean, round(stddev_pop(mae), 6) AS cv_mae_std, count(*) AS folds
       FROM (SELECT fold, avg(abs(num_reservations - prediction)) AS mae FROM folds GROUP BY fold)""",
)
def fold_metrics(spark, folder):
    return rounded(
        metrics.fold_metrics(folded(spark, folder), "fold", LABEL, "prediction"), "cv_mae_mean", "cv_mae_std"
    )


@query("kfold_assign", "folds", "SELECT vehicle_id, fold FROM folds")
def kfold_assign_query(spark, folder):
    return folded(spark, folder).select(KEY, "fold")


@query(
    "kfold_assign_orders",
    "",
    "SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders",
)
def kfold_assign_orders(spark, folder):
    orders = demo.table(spark, folder, "orders").select("o_orderkey")
    return kfold_assign(orders, "o_orderkey", 7)
