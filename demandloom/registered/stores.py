"""Online and offline stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.operators import stores
from demandloom.registered.base import query
from demandloom.registered.joins import resolve
from demandloom.schemas import LISTING_VIEW
from demandloom.session import scratch_path
from demandloom.sources import demo
from demandloom.sources.online import compact_online, materialize_arrivals, read_online, write_online
from demandloom.sources.tables import store_stats

KEY, LABEL = LISTING_VIEW.key, LISTING_VIEW.label
UPDATED = """SELECT vehicle_id, technology, num_images, street_parked, description,
    CASE WHEN num_images >= 3 THEN price_diff - 1 ELSE price_diff END AS price_diff, num_reservations
    FROM features WHERE num_reservations IS NULL"""


def updated_store(spark, folder):
    """Arrivals written once, then those with photos again with a newer stamp and a lower gap."""
    path = scratch_path(spark, "online")
    rows = demo.features(spark, folder)
    materialize_arrivals(rows, path, "backfill", 0)
    newer = demo.online(spark, folder).withColumns(
        {
            "price_diff": F.col("price_diff") - 1,
            "event_timestamp": F.col("event_timestamp") + F.expr("INTERVAL 1 HOUR"),
        }
    )
    write_online(newer, path, "events", 0)
    return path


@query("sink_online_upsert", "features", UPDATED)
def sink_online_upsert(spark, folder):
    return read_online(spark, updated_store(spark, folder)).drop("event_timestamp")


@query("compact_online", "features", UPDATED)
def compact_online_query(spark, folder):
    target = scratch_path(spark, "online")
    return compact_online(spark, updated_store(spark, folder), target).drop("event_timestamp")


@query(
    "upsert_latest",
    "",
    """SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (
       PARTITION BY user_id ORDER BY ts DESC, (event_type <> 'view') DESC) AS r FROM events) WHERE r = 1""",
)
def upsert_latest(spark, folder):
    events = demo.table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type", "value")
    views = events.where(F.col("event_type") == "view")
    current = stores.latest_per_key(views, "user_id", "ts", "event_id")
    incoming = events.where(F.col("event_type") != "view")
    return stores.upsert_latest(current, incoming, "user_id", "ts").drop("ts")


@query(
    "latest_per_key",
    "",
    """SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (
       PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""",
)
def latest_per_key(spark, folder):
    events = demo.table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return stores.latest_per_key(events, "user_id", "ts", "event_id").drop("ts")


@query(
    "store_stats",
    "offline online",
    """SELECT 'offline' AS store, count(*) > 0 AS available, count(*) AS rows, count(DISTINCT vehicle_id) AS keys
       FROM offline UNION ALL SELECT 'online', count(*) > 0, count(*), count(DISTINCT vehicle_id) FROM online""",
)
def store_stats_query(spark, folder):
    return store_stats(demo.offline(spark, folder), demo.online(spark, folder), KEY)


@query(
    "store_coverage",
    "resolved",
    """SELECT count(*) FILTER (WHERE store = 'offline') AS offline, count(*) FILTER (WHERE store = 'online') AS online,
       count(*) FILTER (WHERE NOT materialized) AS pending, count(*) AS total FROM resolved""",
)
def store_coverage(spark, folder):
    return stores.store_coverage(resolve(spark, folder))


@query(
    "online_ttl",
    "",
    """SELECT event_id, user_id, value FROM events
       WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14 DAY""",
)
def online_ttl(spark, folder):
    events = demo.table(spark, folder, "events")
    kept = stores.online_ttl(events, "ts", 14, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))
    return kept.select("event_id", "user_id", "value")


@query(
    "purge_online",
    "online",
    "SELECT vehicle_id, price_diff FROM online WHERE vehicle_id IN (SELECT c_custkey FROM customer)",
)
def purge_online(spark, folder):
    alive = demo.table(spark, folder, "customer").select(F.col("c_custkey").alias(KEY))
    return stores.purge_online(demo.online(spark, folder), alive).select(KEY, "price_diff")
