"""Versioned stores: snapshots, merges, conflicts, reserved ids, the outbox, lookups by an index."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.operators.sketches import DISTINCT_ERROR, RANK_ERROR, all_parts, merged_profile, part_sketches
from demandloom.plans.batch import deliver_saved, save_listings
from demandloom.registered.base import query
from demandloom.registered.joins import requested
from demandloom.schemas import LISTING, LISTING_VIEW
from demandloom.session import scratch_path
from demandloom.sources import demo
from demandloom.sources.events import SAVED_EVENT, read_events
from demandloom.sources.online import ROWS, materialize_arrivals, merge_online, read_online, write_online
from demandloom.sources.registry import Registry
from demandloom.sources.snapshots import Store
from demandloom.sources.tables import file_stats, lookup, scan_evolving, scan_offline, write_offline

KEY = LISTING_VIEW.key
BATCHES = 5


def many_batches(spark, folder):
    """A store of arrivals whose prices are written anew by several batches; its path and first version."""
    path = scratch_path(spark, "online")
    materialize_arrivals(demo.features(spark, folder), path, "backfill", 0)
    first = Store(spark, path).snapshot().version
    newer = demo.online(spark, folder)
    for batch in range(1, BATCHES + 1):
        rows = newer.withColumns(
            {
                "price_diff": F.col("price_diff") - batch,
                "event_timestamp": F.col("event_timestamp") + F.make_dt_interval(hours=F.lit(batch)),
            }
        )
        write_online(rows, path, "events", batch)
    return path, first


@query(
    "online_after_merges",
    "features",
    f"""SELECT vehicle_id, technology, num_images, street_parked, description,
        CASE WHEN num_images >= 3 THEN price_diff - {BATCHES} ELSE price_diff END AS price_diff, num_reservations
        FROM features WHERE num_reservations IS NULL""",
)
def online_after_merges(spark, folder):
    return read_online(spark, many_batches(spark, folder)[0]).drop("event_timestamp")


@query(
    "online_store_size",
    "features",
    """SELECT count(*) AS keys, true AS follows_keys, count(*) AS keys_after_merge
       FROM features WHERE num_reservations IS NULL""",
)
def online_store_size(spark, folder):
    """Live rows stay within one and a half times the keys and one batch, however many batches there were."""
    path, _ = many_batches(spark, folder)
    store = Store(spark, path)
    live = sum(p.rows for p in store.snapshot().of(ROWS))
    largest = demo.online(spark, folder).count()
    merged = merge_online(spark, path)
    keys = read_online(spark, path).agg(F.count(F.lit(1)).alias("keys"))
    return keys.select(
        "keys",
        (F.lit(live) <= 1.5 * F.col("keys") + largest).alias("follows_keys"),
        F.lit(sum(p.rows for p in merged.of(ROWS))).cast("long").alias("keys_after_merge"),
    )


@query(
    "online_pinned_version",
    "features",
    """SELECT vehicle_id, technology, num_images, street_parked, description, price_diff, num_reservations
       FROM features WHERE num_reservations IS NULL""",
)
def online_pinned_version(spark, folder):
    """What a reader of the first version sees after batches and a merge were committed."""
    path, first = many_batches(spark, folder)
    merge_online(spark, path)
    return read_online(spark, path, version=first).drop("event_timestamp")


@query(
    "register_from_one_snapshot",
    "registry_versions",
    """SELECT model_name, max(version) + 1 AS version, 'first_' || model_name AS run_id, false AS candidate
       FROM registry_versions GROUP BY model_name UNION ALL
       SELECT model_name, max(version) + 2, 'second_' || model_name, true FROM registry_versions GROUP BY model_name""",
)
def register_from_one_snapshot(spark, folder):
    """Two writers register a run of every model from the same snapshot: the later one counts again."""
    registry = Registry(spark, scratch_path(spark, "registry")).create()
    registry.append("versions", demo.versions(spark, folder))
    seen = registry.store.snapshot()
    models = registry.table("versions", seen).select("model_name").distinct()
    for writer in ("first", "second"):
        registry.register_all(
            models.select(
                "model_name",
                F.concat(F.lit(f"{writer}_"), "model_name").alias("run_id"),
                F.lit("models").alias("model_path"),
            ),
            seen,
        )
    newest = registry.table("aliases").groupBy("model_name").agg(F.max("version").alias("top"))
    added = registry.table("versions").where(F.col("model_path") == "models")
    return added.join(newest, "model_name").select(
        "model_name", "version", "run_id", (F.col("version") == F.col("top")).alias("candidate")
    )


def saved_twice(spark, folder):
    """A warehouse of listings to which customers were added in two saves, the first deleted between them."""
    root = scratch_path(spark, "saves")
    warehouse = f"{root}/warehouse"
    demo.listings(spark, folder).select(*LISTING.fieldNames()).write.parquet(f"{warehouse}/vehicles")
    requests = demo.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("request"),
        F.lit(1).cast("long").alias("technology"),
        (F.col("c_nationkey") + 30).cast("double").alias("actual_price"),
        # Accounts in debt offer nothing: their listings break a rule.
        F.when(F.col("c_acctbal") >= 0, 50.0).otherwise(0.0).alias("recommended_price"),
        F.lit(8).cast("long").alias("num_images"),
        F.lit(0).cast("long").alias("street_parked"),
        F.lit(250).cast("long").alias("description"),
    )
    return warehouse, f"{root}/events", requests


@query(
    "save_with_reserved_ids",
    "listings",
    """SELECT (SELECT max(vehicle_id) FROM listings) + 2 * (SELECT count(*) FROM customer WHERE c_acctbal >= 0)
         + row_number() OVER (ORDER BY c_custkey) AS vehicle_id, CAST(c_nationkey + 30 AS DOUBLE) AS actual_price
       FROM customer WHERE c_acctbal >= 0""",
)
def save_with_reserved_ids(spark, folder):
    """The third of three saves, when the rows of the others are gone from the table."""
    warehouse, _, requests = saved_twice(spark, folder)
    for _ in range(2):
        save_listings(spark, warehouse, requests, "request")
    demo.listings(spark, folder).select(*LISTING.fieldNames()).write.mode("overwrite").parquet(f"{warehouse}/vehicles")
    saved, _ = save_listings(spark, warehouse, requests, "request")
    return saved.select(KEY, "actual_price")


@query(
    "save_rejects",
    "",
    "SELECT c_custkey AS request, 'recommended_price' AS errors FROM customer WHERE c_acctbal < 0",
)
def save_rejects(spark, folder):
    warehouse, _, requests = saved_twice(spark, folder)
    rejects = f"{warehouse}/rejects"
    save_listings(spark, warehouse, requests, "request", rejects_path=rejects)
    return spark.read.parquet(rejects).select("request", F.concat_ws(",", "errors").alias("errors"))


@query(
    "outbox_delivery",
    "listings",
    """SELECT vehicle_id, actual_price, CAST(1 AS BIGINT) AS told FROM listings WHERE source = 'ui' UNION ALL
       SELECT (SELECT max(vehicle_id) FROM listings) + row_number() OVER (ORDER BY c_custkey),
              CAST(c_nationkey + 30 AS DOUBLE), 1 FROM customer WHERE c_acctbal >= 0""",
)
def outbox_delivery(spark, folder):
    """Events of a save that announced nothing, delivered later and then asked for again."""
    warehouse, events, requests = saved_twice(spark, folder)
    save_listings(spark, warehouse, requests, "request")
    for _ in range(2):
        deliver_saved(spark, warehouse, events)
    told, _ = read_events(spark.read.text(events), SAVED_EVENT, [KEY])
    return told.groupBy(KEY, "actual_price").agg(F.count(F.lit(1)).alias("told"))


@query(
    "offline_lookup_indexed",
    "offline",
    "SELECT * FROM offline WHERE vehicle_id IN (SELECT c_custkey * 2 FROM customer)",
)
def offline_lookup_indexed(spark, folder):
    """Many ids: a join within their range."""
    path = scratch_path(spark, "offline")
    write_offline(demo.offline(spark, folder), path, order=KEY)
    return lookup(scan_offline(spark, path), requested(spark, folder), KEY).drop("event_timestamp")


@query(
    "online_lookup_indexed",
    "online",
    "SELECT * FROM online WHERE vehicle_id IN (SELECT n_nationkey * 10 FROM nation)",
)
def online_lookup_indexed(spark, folder):
    """Few ids: conditions that row groups are skipped by."""
    path = scratch_path(spark, "online")
    write_online(demo.online(spark, folder), path, "events", 0)
    merge_online(spark, path)
    ids = demo.table(spark, folder, "nation").select((F.col("n_nationkey") * 10).alias(KEY))
    return read_online(spark, path, ids=ids).drop("event_timestamp")


@query(
    "scan_evolving",
    "listings",
    """SELECT vehicle_id, actual_price, num_images, CASE WHEN vehicle_id % 3 = 0 THEN source ELSE 'csv' END AS source,
       CASE WHEN vehicle_id % 3 = 1 THEN NULL ELSE description END AS description FROM listings""",
)
def scan_evolving_query(spark, folder):
    """Files of three ages: without a source and a description, without a source, and with both."""
    path = scratch_path(spark, "evolving")
    listings = demo.listings(spark, folder).select(KEY, "actual_price", "num_images", "description", "source")
    ages = [listings, listings.drop("source", "description"), listings.drop("source")]
    for k, rows in enumerate(ages):
        rows.where(F.col(KEY) % 3 == k).write.mode("append").parquet(path)
    return scan_evolving(spark, path, listings.schema, {"source": "csv"})


@query(
    "store_file_facts",
    "offline",
    "SELECT count(*) AS rows, true AS has_files, true AS has_bytes, true AS has_stamp FROM offline",
)
def store_file_facts(spark, folder):
    path = scratch_path(spark, "offline")
    write_offline(demo.offline(spark, folder), path)
    table = scan_offline(spark, path)
    facts = file_stats(table).select(
        (F.col("files") > 0).alias("has_files"),
        (F.col("size_bytes") > 0).alias("has_bytes"),
        F.col("last_modified").isNotNull().alias("has_stamp"),
    )
    rows = table.agg(F.count(F.lit(1)).alias("rows"))
    return facts.select(rows.scalar().alias("rows"), "*")


@query(
    "sketched_profile",
    "",
    """SELECT feature, count(*) AS rows, count(x) AS values, min(x) AS min, max(x) AS max,
       true AS nunique_close, true AS median_close
       FROM (SELECT 'value' AS feature, CAST(value AS DOUBLE) AS x FROM events UNION ALL
             SELECT 'user_id', CAST(user_id AS DOUBLE) FROM events) GROUP BY feature""",
)
def sketched_profile(spark, folder):
    """Sketches of every day, kept apart for the earlier and the later days and merged."""
    events = demo.table(spark, folder, "events")
    columns = ["value", "user_id"]
    day = F.to_date("ts")
    path = scratch_path(spark, "sketches")
    part_sketches(events.where(F.day("ts") <= 15), day, columns).write.parquet(f"{path}/1")
    part_sketches(events.where(F.day("ts") > 15), day, columns).write.parquet(f"{path}/2")
    merged = merged_profile(all_parts(spark.read.parquet(f"{path}/1"), spark.read.parquet(f"{path}/2")))
    long = events.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns]))
    )
    exact = (
        long.join(merged.select("feature", "q50"), "feature")
        .groupBy("feature")
        .agg(
            F.count_distinct("x").alias("distinct"),
            (F.count_if(F.col("x") < F.col("q50")) / F.count("x")).alias("below"),
            (F.count_if(F.col("x") <= F.col("q50")) / F.count("x")).alias("upto"),
        )
    )
    return merged.join(exact, "feature").select(
        "feature",
        "rows",
        "values",
        "min",
        "max",
        (F.abs(F.col("nunique") - F.col("distinct")) <= DISTINCT_ERROR * F.col("distinct")).alias("nunique_close"),
        ((F.col("below") - RANK_ERROR <= 0.5) & (F.col("upto") + RANK_ERROR >= 0.5)).alias("median_close"),
    )
