"""Streaming jobs run to the end of their input; the SQL states what the batch job would give."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.operators import models
from demandloom.registered.base import query
from demandloom.registered.models import fitted
from demandloom.schemas import LISTING_VIEW, listing_rules
from demandloom.operators.features import validate_rows
from demandloom.session import scratch_path
from demandloom.sources import demo
from demandloom.sources.events import (
    HEALTH_CHANGED,
    PIPELINE_COMPLETED,
    SAVED_EVENT,
    VEHICLE_MATERIALIZED,
    read_events,
    stream_messages,
    to_events,
)
from demandloom.sources.online import read_online
from demandloom.sources.registry import Registry
from demandloom.streaming import (
    event_projection,
    stream_champion_scoring,
    stream_dead_letter,
    stream_materialize,
)
from demandloom.streaming.event_time import EVENT_TIME, announce_once, store_by_event_time
from demandloom.streaming.jobs import saved_features
from demandloom.streaming.promotions import score_by_promotions, with_control

KEY, LABEL, FEATURES = LISTING_VIEW.key, LISTING_VIEW.label, LISTING_VIEW.feature_names
SAVED_FIELDS = SAVED_EVENT.fieldNames()


def streamed(spark, folder, name):
    """A table of the data set as a stream of its files."""
    schema = demo.table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}*.parquet")


def saved_messages(spark, folder):
    return to_events(demo.as_listings(streamed(spark, folder, "part")), SAVED_FIELDS)


def drained(stream, folder, checkpoint):
    """Write a stream to a Parquet folder until its input is used up."""
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(folder)
    )
    query.awaitTermination()


SAVED_VALID = """SELECT vehicle_id, technology, num_images, street_parked, description,
    actual_price - recommended_price AS price_diff, CAST(NULL AS BIGINT) AS num_reservations
    FROM listings WHERE vehicle_id > 0"""


def run_materialize(spark, folder):
    root = scratch_path(spark, "materialize")
    paths = {name: f"{root}/{name}" for name in ("online", "events", "rejects", "checkpoint")}
    stream_materialize(
        saved_messages(spark, folder),
        paths["online"],
        paths["events"],
        paths["rejects"],
        paths["checkpoint"],
    ).awaitTermination()
    return paths


@query("stream_materialize", "listings", SAVED_VALID)
def stream_materialize_query(spark, folder):
    return read_online(spark, run_materialize(spark, folder)["online"]).drop("event_timestamp")


@query(
    "stream_last_message",
    "listings",
    """SELECT vehicle_id, technology, num_images, street_parked, description + 2 AS description,
       actual_price - recommended_price AS price_diff, CAST(NULL AS BIGINT) AS num_reservations
       FROM listings WHERE vehicle_id > 0""",
)
def stream_last_message(spark, folder):
    """Every listing saved three times, twice in one file, over files that come four to a micro-batch."""
    root = scratch_path(spark, "resaved")
    listings = demo.listings(spark, folder)

    def saved(*versions):
        rows = None
        for v in versions:
            one = to_events(listings.withColumn("description", F.col("description") + v), SAVED_FIELDS)
            one = one.withColumn("v", F.lit(v)).withColumn(KEY, F.get_json_object("value", f"$.{KEY}"))
            rows = one if rows is None else rows.unionByName(one)
        # All versions of a listing in one file, in their order.
        return rows.repartition(KEY).sortWithinPartitions("v").select("value")

    saved(5).write.mode("append").text(f"{root}/messages")
    saved(0, 2).write.mode("append").text(f"{root}/messages")
    paths = {name: f"{root}/{name}" for name in ("online", "events", "rejects", "checkpoint")}
    stream_materialize(
        stream_messages(spark, f"{root}/messages", 4),
        paths["online"],
        paths["events"],
        paths["rejects"],
        paths["checkpoint"],
    ).awaitTermination()
    return read_online(spark, paths["online"]).drop("event_timestamp")


@query(
    "stream_materialize_events",
    "listings",
    "SELECT 'vehicle-materialized' AS type, vehicle_id FROM listings WHERE vehicle_id > 0",
)
def stream_materialize_events(spark, folder):
    path = run_materialize(spark, folder)["events"]
    return event_projection(spark.read.text(path), VEHICLE_MATERIALIZED)


@query(
    "stream_materialize_rejects",
    "listings",
    "SELECT vehicle_id, false AS undecodable, 'vehicle_id' AS errors FROM listings WHERE vehicle_id <= 0",
)
def stream_materialize_rejects(spark, folder):
    rejects = spark.read.parquet(run_materialize(spark, folder)["rejects"])
    return rejects.select(
        F.get_json_object("value", "$.vehicle_id").cast("long").alias(KEY),
        "undecodable",
        F.concat_ws(",", "errors").alias("errors"),
    )


@query(
    "backfill_equals_stream",
    "listings",
    """SELECT count(*) AS batch_rows, count(*) AS stream_rows, CAST(0 AS BIGINT) AS differing
       FROM listings WHERE vehicle_id > 0""",
)
def backfill_equals_stream(spark, folder):
    valid, _ = validate_rows(demo.listings(spark, folder), listing_rules())
    batch = saved_features(valid).drop("event_timestamp")
    stream = read_online(spark, run_materialize(spark, folder)["online"]).drop("event_timestamp")
    sides = batch.select(KEY, F.struct(*FEATURES, LABEL).alias("b")).join(
        stream.select(KEY, F.struct(*FEATURES, LABEL).alias("s")), KEY, "full"
    )
    return sides.agg(
        F.count("b").alias("batch_rows"),
        F.count("s").alias("stream_rows"),
        F.count_if(~F.col("b").eqNullSafe(F.col("s"))).alias("differing"),
    )


@query(
    "sink_events_json",
    "listings",
    """SELECT vehicle_id, technology, actual_price, recommended_price, num_images, street_parked, description
       FROM listings""",
)
def sink_events_json(spark, folder):
    root = scratch_path(spark, "saved")
    messages = saved_messages(spark, folder)
    query = (
        messages.writeStream.format("text")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{root}/messages")
    )
    query.awaitTermination()
    good, _ = read_events(spark.read.text(f"{root}/messages"), SAVED_EVENT, [KEY])
    return good.drop("value")


PROPS = T.StructType([T.StructField("k", T.LongType())])


@query(
    "source_events_json",
    "",
    "SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
)
def source_events_json(spark, folder):
    root = scratch_path(spark, "events")
    payload = ["event_id", "user_id", "event_type", F.from_json("props", PROPS)["k"].alias("k")]
    to_events(demo.table(spark, folder, "events"), payload).write.text(f"{root}/messages")
    schema = T.StructType(
        [
            T.StructField("event_id", T.LongType()),
            T.StructField("user_id", T.LongType()),
            T.StructField("event_type", T.StringType()),
            T.StructField("k", T.LongType()),
        ]
    )
    good, _ = read_events(stream_messages(spark, f"{root}/messages"), schema, ["event_id"])
    drained(good.drop("value", "place"), f"{root}/decoded", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/decoded")


@query(
    "stream_dead_letter",
    "",
    """SELECT event_type, event_type <> 'error' AS decoded, count(*) AS n,
       CAST(sum(CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END) AS BIGINT) AS k
       FROM events GROUP BY event_type""",
)
def stream_dead_letter_query(spark, folder):
    """Messages of error events are cut off before the closing brace."""
    root = scratch_path(spark, "dead-letter")
    cut = F.regexp_replace("props", r"\}$", "")
    messages = streamed(spark, folder, "events").select(
        "event_type", F.when(F.col("event_type") == "error", cut).otherwise(F.col("props")).alias("value")
    )
    stream_dead_letter(
        messages, PROPS, ["k"], f"{root}/good", f"{root}/bad", f"{root}/checkpoint"
    ).awaitTermination()
    good = spark.read.parquet(f"{root}/good").select("event_type", F.lit(True).alias("decoded"), "k")
    bad = spark.read.parquet(f"{root}/bad").select(
        "event_type", F.lit(False).alias("decoded"), F.lit(None).cast("long").alias("k")
    )
    return (
        good.unionByName(bad)
        .groupBy("event_type", "decoded")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))
    )


@query(
    "stream_event_projection",
    "",
    """SELECT CASE event_type WHEN 'view' THEN 'vehicle-materialized' WHEN 'signup' THEN 'pipeline-completed'
         ELSE 'health-changed' END AS type,
       CASE event_type WHEN 'view' THEN event_id END AS vehicle_id,
       CASE event_type WHEN 'signup' THEN 'run_' || event_id END AS dag_run_id,
       CASE event_type WHEN 'signup' THEN CASE WHEN value > 50 THEN 'success' ELSE 'failed' END END AS state,
       CASE WHEN event_type IN ('click', 'purchase', 'error') THEN
            CASE WHEN event_type = 'error' THEN 'no_model' ELSE 'ok' END END AS status,
       CASE WHEN event_type IN ('click', 'purchase', 'error') THEN
            CASE WHEN event_type = 'error' THEN '' ELSE CAST(user_id AS VARCHAR) END END AS model_version
       FROM events""",
)
def stream_event_projection(spark, folder):
    """Events spread over the three channels by their type."""
    events = streamed(spark, folder, "events")
    kind = F.col("event_type")
    channels = {
        VEHICLE_MATERIALIZED: to_events(
            events.where(kind == "view"), [F.col("event_id").alias("vehicle_id")]
        ),
        PIPELINE_COMPLETED: to_events(
            events.where(kind == "signup"),
            [
                F.lit("refresh").alias("dag_id"),
                F.concat(F.lit("run_"), F.col("event_id")).alias("dag_run_id"),
                F.when(F.col("value") > 50, "success").otherwise("failed").alias("state"),
            ],
        ),
        HEALTH_CHANGED: to_events(
            events.where(kind.isin("click", "purchase", "error")),
            [F.when(kind == "error", "").otherwise(F.col("user_id").cast("string")).alias("version")],
            "model-reloaded",
        ),
    }
    root = scratch_path(spark, "projection")
    parts = []
    for name, messages in channels.items():
        drained(event_projection(messages, name), f"{root}/{name}", f"{root}/checkpoint-{name}")
        parts.append(spark.read.parquet(f"{root}/{name}"))
    merged = parts[0].unionByName(parts[1], True).unionByName(parts[2], True)
    return merged.select("type", KEY, "dag_run_id", "state", "status", "model_version")


@query("stream_champion_scoring")
def stream_champion_scoring_query(spark, folder):
    """Listings scored by the champion as they arrive."""
    root = scratch_path(spark, "champion")
    registry = Registry(spark, f"{root}/registry").create()
    rows, model = fitted(spark, folder)
    metrics = models.feature_importance(model, FEATURES, rows).selectExpr("feature AS name", "importance AS value")
    path = registry.log_run("first", model, metrics, {}, {})
    version = registry.register("demand", "first", path)
    registry.append(
        "aliases",
        registry.table("aliases").where(F.col("version") == version).withColumn("alias", F.lit("champion")),
    )
    listings = demo.as_listings(streamed(spark, folder, "part"))
    arrivals = listings.withColumn("price_diff", F.col("actual_price") - F.col("recommended_price"))
    stream_champion_scoring(
        arrivals.select(KEY, *FEATURES), registry, "demand", f"{root}/scored", f"{root}/checkpoint"
    ).awaitTermination()
    scored = spark.read.parquet(f"{root}/scored")
    return scored.select(KEY, "predicted_reservations", "model_version", "reload")


@query(
    "stream_event_time",
    "listings",
    """SELECT vehicle_id, technology, num_images, street_parked, description + 2 AS description,
       actual_price - recommended_price AS price_diff, CAST(NULL AS BIGINT) AS num_reservations,
       TIMESTAMP '2024-03-01 02:00:00' AS event_timestamp FROM listings WHERE vehicle_id > 0""",
)
def stream_event_time(spark, folder):
    """Every listing saved three times and delivered newest first, the newest once more at the end."""
    root = scratch_path(spark, "timed")
    messages = timed_messages(spark, folder, f"{root}/messages")
    store_by_event_time(
        messages, f"{root}/online", f"{root}/rejects", f"{root}/checkpoint"
    ).awaitTermination()
    return read_online(spark, f"{root}/online")


@query(
    "stream_announce_once",
    "listings",
    "SELECT 'vehicle-materialized' AS type, vehicle_id, CAST(3 AS BIGINT) AS n FROM listings WHERE vehicle_id > 0",
)
def stream_announce_once(spark, folder):
    """The same deliveries: each save is told once."""
    root = scratch_path(spark, "announced")
    messages = timed_messages(spark, folder, f"{root}/messages")
    announce_once(messages, f"{root}/events", f"{root}/checkpoint", "1 day").awaitTermination()
    told = event_projection(spark.read.text(f"{root}/events"), VEHICLE_MATERIALIZED)
    return told.groupBy("type", KEY).agg(F.count(F.lit(1)).alias("n"))


def timed_messages(spark, folder, path):
    listings = demo.listings(spark, folder)
    for hour in (2, 0, 1, 2):
        rows = listings.withColumn("description", F.col("description") + hour).withColumn(
            EVENT_TIME, F.lit(f"2024-03-01 0{hour}:00:00").cast("timestamp")
        )
        to_events(rows, [*SAVED_FIELDS, EVENT_TIME]).write.mode("append").text(path)
    return stream_messages(spark, path, 2)


@query(
    "stream_promotions",
    "listings",
    """SELECT vehicle_id, CAST(max(n_nationkey) AS VARCHAR) AS model_version,
       CAST(max(n_nationkey) AS DOUBLE) AS predicted_reservations
       FROM listings LEFT JOIN nation ON n_nationkey * 40 + 100 <= vehicle_id * 31 % 1000 GROUP BY vehicle_id""",
)
def stream_promotions(spark, folder):
    """Listings among promotions of versions, one for each nation; the version stands for a prediction."""
    root = scratch_path(spark, "promotions")
    start = F.lit("2024-03-01 00:00:00").cast("timestamp")

    def after(seconds):
        return start + F.make_dt_interval(secs=seconds)

    rows = demo.as_listings(streamed(spark, folder, "part")).withColumn(
        "price_diff", F.col("actual_price") - F.col("recommended_price")
    )
    rows = rows.select(KEY, *FEATURES, after(F.col(KEY) * 31 % 1000).alias("at"))
    nation = streamed(spark, folder, "nation")
    promoted = to_events(
        nation.select(
            F.lit("demand").alias("model_name"),
            F.col("n_nationkey").cast("string").alias("version"),
            after(F.col("n_nationkey") * 40 + 100).alias("at"),
        ),
        ["model_name", "version", "at"],
    )

    def scorer(rows, version):
        return rows.withColumn("predicted_reservations", F.lit(float(version))).withColumn("model_version", F.lit(version))

    score_by_promotions(
        with_control(rows, promoted), "demand", scorer, f"{root}/out", f"{root}/checkpoint"
    ).awaitTermination()
    return spark.read.parquet(f"{root}/out/rows").select(KEY, "model_version", "predicted_reservations")
