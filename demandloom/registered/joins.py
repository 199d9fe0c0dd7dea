"""Joins between entities, facts, stores and arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.functions import zipped_sum
from demandloom.operators import catalog, features as feat, profile, registry as reg, stores
from demandloom.registered.base import query
from demandloom.schemas import EXPLORED_FEATURES, LISTING_VIEW
from demandloom.sources import demo

KEY, LABEL = LISTING_VIEW.key, LISTING_VIEW.label


@query(
    "left_join_counts",
    "",
    """SELECT c_custkey AS user_id, c_mktsegment, n_events FROM customer
       LEFT JOIN (SELECT user_id, count(*) AS n_events FROM events GROUP BY user_id) ON user_id = c_custkey""",
)
def left_join_counts(spark, folder):
    customers = demo.table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return feat.left_join_counts(customers, demo.table(spark, folder, "events"), "user_id", "n_events")


def requested(spark, folder):
    """Ids asked for: twice the customer keys, some of them unknown."""
    return demo.table(spark, folder, "customer").select((F.col("c_custkey") * 2).alias(KEY))


@query(
    "offline_lookup",
    "offline",
    "SELECT * FROM offline WHERE vehicle_id IN (SELECT c_custkey * 2 FROM customer)",
)
def offline_lookup(spark, folder):
    return stores.offline_lookup(demo.offline(spark, folder), requested(spark, folder)).drop("event_timestamp")


@query(
    "online_lookup",
    "online",
    """SELECT c_custkey * 2 AS vehicle_id, technology, num_images, price_diff FROM customer
       LEFT JOIN online ON vehicle_id = c_custkey * 2""",
)
def online_lookup(spark, folder):
    rows = stores.online_lookup(demo.online(spark, folder), requested(spark, folder))
    return rows.select(KEY, "technology", "num_images", "price_diff")


@query(
    "missing_ids",
    "offline",
    """SELECT c_custkey * 2 AS vehicle_id FROM customer
       WHERE NOT EXISTS (SELECT 1 FROM offline WHERE vehicle_id = c_custkey * 2)""",
)
def missing_ids(spark, folder):
    return stores.missing_ids(requested(spark, folder), demo.offline(spark, folder))


def resolve(spark, folder, **options):
    ids = demo.listings(spark, folder).select(KEY)
    return stores.resolve_features(ids, demo.offline(spark, folder), demo.online(spark, folder), **options)


@query("resolve_features", "resolved", "SELECT * FROM resolved")
def resolve_features(spark, folder):
    return resolve(spark, folder)


@query(
    "resolve_features_degraded",
    "offline",
    """SELECT vehicle_id, 'offline' AS store, true AS materialized, technology, num_images, street_parked,
       description, price_diff FROM offline""",
)
def resolve_features_degraded(spark, folder):
    ids = demo.listings(spark, folder).select(KEY)
    return stores.resolve_features(ids, demo.offline(spark, folder), None, drop_unresolved=True)


@query(
    "alias_metric_join",
    "candidates",
    "SELECT model_name, version, run_id, round(metric, 2) AS metric FROM candidates",
)
def alias_metric_join(spark, folder):
    rows = reg.alias_metric_join(
        demo.versions(spark, folder), demo.aliases(spark, folder), demo.metrics(spark, folder)
    )
    return rows.withColumn("metric", F.round("metric", 2))


@query(
    "zip_add",
    "",
    """SELECT vec_id, CAST(i - 1 AS INTEGER) AS position, CAST(embedding[i] AS DOUBLE) +
       CAST(embedding[len(embedding) + 1 - i] AS DOUBLE) AS value
       FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""",
)
def zip_add(spark, folder):
    vectors = demo.table(spark, folder, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("v")
    )
    added = vectors.select("vec_id", zipped_sum("v", F.reverse("v")).alias("v"))
    return added.select("vec_id", F.posexplode("v").alias("position", "value"))


def _weights(columns, target):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, corr({c}, {target}) AS importance FROM explored" for c in columns
    )


LEFT_FEATURES = EXPLORED_FEATURES[:6]
RIGHT_FEATURES = EXPLORED_FEATURES[2:]


@query(
    "align_importances",
    "explored",
    f"""SELECT feature, round(a.importance, 6) AS first, round(b.importance, 6) AS second
        FROM ({_weights(LEFT_FEATURES, 'num_reservations')}) a
        FULL JOIN ({_weights(RIGHT_FEATURES, 'num_images + description')}) b USING (feature)""",
)
def align_importances(spark, folder):
    frame = demo.explored(spark, folder).withColumn("other", F.col("num_images") + F.col("description"))

    def weights(columns, target):
        rows = profile.corr_to_target(frame, columns, target).where(F.col("column") != target)
        return rows.select(F.col("column").alias("feature"), F.col("corr").alias("importance"))

    both = reg.align_importances(
        weights(LEFT_FEATURES, LABEL), weights(RIGHT_FEATURES, "other"), ("first", "second")
    )
    return both.select("feature", F.round("first", 6).alias("first"), F.round("second", 6).alias("second"))


@query(
    "catalog_view",
    "catalog resolved",
    """SELECT c.vehicle_id, source, num_reservations, round(c.num_images / 4.0, 2) AS predicted_reservations,
       CASE store WHEN 'online' THEN 'Online Store' WHEN 'offline' THEN 'Offline Store' ELSE 'Pending' END AS status,
       materialized AS can_score FROM catalog c JOIN resolved USING (vehicle_id)""",
)
def catalog_view(spark, folder):
    entities = catalog.list_entities(demo.listings(spark, folder), demo.bookings(spark, folder))
    predictions = demo.listings(spark, folder).select(
        KEY, F.round(F.col("num_images") / 4.0, 2).alias("predicted_reservations")
    )
    view = catalog.catalog_view(entities, resolve(spark, folder), predictions)
    return view.select(KEY, "source", LABEL, "predicted_reservations", "status", "can_score")


@query(
    "asof_features",
    "",
    """WITH clicks AS (SELECT user_id, ts, event_id AS click_id, value AS click_value FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS r
         FROM events WHERE event_type = 'click') WHERE r = 1)
       SELECT e.event_id, CASE WHEN c.ts > e.ts - INTERVAL 2 DAY THEN click_id END AS click_id,
              CASE WHEN c.ts > e.ts - INTERVAL 2 DAY THEN click_value END AS click_value
       FROM events e ASOF LEFT JOIN clicks c ON e.user_id = c.user_id AND e.ts >= c.ts""",
)
def asof_features(spark, folder):
    events = demo.table(spark, folder, "events")
    clicks = events.where(F.col("event_type") == "click").select(
        "user_id", "ts", F.col("event_id").alias("click_id"), F.col("value").alias("click_value")
    )
    rows = stores.asof_features(
        events.select("event_id", "user_id", "ts"),
        clicks,
        "user_id",
        "ts",
        ["click_id", "click_value"],
        ttl_days=2,
        newest=["click_id"],
    )
    return rows.select("event_id", "click_id", "click_value")


@query(
    "union_stores",
    "offline online",
    """SELECT *, 'offline' AS store FROM offline UNION ALL
       SELECT *, 'online' FROM online WHERE vehicle_id NOT IN (SELECT vehicle_id FROM offline)""",
)
def union_stores(spark, folder):
    return stores.union_stores(demo.offline(spark, folder), demo.online(spark, folder)).drop("event_timestamp")


@query(
    "first_materialized",
    "resolved",
    "SELECT min(vehicle_id) AS vehicle_id FROM resolved WHERE materialized",
)
def first_materialized(spark, folder):
    return catalog.first_materialized(demo.listings(spark, folder), resolve(spark, folder))
