"""Event-driven jobs.

Delivery is at least once, and every sink is a folder per batch number that a repeated batch replaces,
so the outcome is the same as if each batch had run once. `available_now` drains what is there and
stops; without it the query keeps running.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from demandloom.functions import batch_time
from demandloom.operators.features import annotate_errors, coerce_types, null_guard, price_diff
from demandloom.operators.models import score, without_model
from demandloom.schemas import LISTING_VIEW, listing_rules
from demandloom.operators.stores import latest_per_key
from demandloom.sources.events import (
    BROKEN,
    COMPLETED_EVENT,
    HEALTH_CHANGED,
    LOADED_EVENT,
    MATERIALIZED_EVENT,
    PIPELINE_COMPLETED,
    PLACE,
    SAVED_EVENT,
    VEHICLE_MATERIALIZED,
    decode,
    is_usable,
    to_events,
    write_events,
)
from demandloom.sources.online import read_part, write_online
from demandloom.sources.registry import Registry


log = logging.getLogger(__name__)

SEQUENCE = ("__place", "__read")


def start_query(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    """Run a query to the end of its input, or until it is stopped."""
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def saved_features(rows: DataFrame, as_of: object = None) -> DataFrame:
    """Stored rows of saved listings: price gap, no label yet. Used by stream and backfill alike."""
    unlabelled = price_diff(rows).withColumn(LISTING_VIEW.label, F.lit(None).cast("long"))
    return coerce_types(
        unlabelled.withColumn(LISTING_VIEW.timestamp, batch_time(as_of)), LISTING_VIEW.schema
    )


def in_order(batch: DataFrame) -> DataFrame:
    """Messages with where they stand: the place their source gave them, then their order as read."""
    place = F.col(PLACE) if PLACE in batch.columns else F.lit(None).cast("long")
    return batch.select("value", place.alias(SEQUENCE[0]), F.monotonically_increasing_id().alias(SEQUENCE[1]))


def stream_materialize(
    messages: DataFrame,
    online_path: str,
    events_path: str,
    rejects_path: str,
    checkpoint: str,
    writer: str = "events",
    rules: Mapping[str, Column] | None = None,
    as_of: object = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Saved-listing messages to online rows, a materialized event per row, and a reject side.

    Rejected are messages that cannot be decoded and rows that break a rule; the stream goes on. The
    events are taken from the written batch, so they name exactly the rows that are in the store.
    """
    rules = listing_rules() if rules is None else rules

    def run(batch: DataFrame, number: int) -> None:
        decoded = annotate_errors(decode(in_order(batch), SAVED_EVENT), rules)
        decoded = decoded.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            good = is_usable([LISTING_VIEW.key]) & (F.size("errors") == 0)
            rejected = decoded.where(~good).select(
                "value", F.col(BROKEN).isNotNull().alias("undecodable"), "errors"
            )
            rejected.write.mode("overwrite").parquet(f"{rejects_path}/batch={number}")
            # Of an id saved several times in a batch the last message holds.
            last = latest_per_key(decoded.where(good), LISTING_VIEW.key, *SEQUENCE)
            rows = saved_features(last, as_of)
            part = write_online(rows, online_path, writer, number)
        finally:
            decoded.unpersist()
        written = read_part(batch.sparkSession, online_path, part)
        write_events(to_events(written, [LISTING_VIEW.key], VEHICLE_MATERIALIZED), events_path, number)

    return start_query(messages.writeStream.foreachBatch(run), checkpoint, available_now)


def stream_dead_letter(
    messages: DataFrame,
    schema: T.StructType,
    required: Sequence[str],
    good_path: str,
    bad_path: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Split a message stream into decoded rows and raw rejects."""

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.drop(PLACE)
        decoded = decode(batch, schema).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            usable = is_usable(required)
            decoded.where(usable).drop(BROKEN).write.mode("overwrite").parquet(
                f"{good_path}/batch={number}"
            )
            decoded.where(~usable).select(*batch.columns).write.mode("overwrite").parquet(
                f"{bad_path}/batch={number}"
            )
        finally:
            decoded.unpersist()

    return start_query(messages.writeStream.foreachBatch(run), checkpoint, available_now)


def event_projection(messages: DataFrame, kind: str) -> DataFrame:
    """Messages of one channel as the events listeners receive; works on streams and tables.

    A message that cannot be decoded is left out, as a listener would skip it.
    """
    messages = messages.select("value")
    if kind == VEHICLE_MATERIALIZED:
        rows = decode(messages, MATERIALIZED_EVENT)
        fields = [F.col("vehicle_id")]
    elif kind == PIPELINE_COMPLETED:
        rows = decode(messages, COMPLETED_EVENT)
        fields = [F.col("dag_id"), F.col("dag_run_id"), F.col("state")]
    elif kind == HEALTH_CHANGED:
        rows = decode(messages, LOADED_EVENT)
        loaded = F.coalesce(F.col("version"), F.lit("")) != ""
        fields = [
            F.when(loaded, "ok").otherwise("no_model").alias("status"),
            F.coalesce(F.col("version"), F.lit("")).alias("model_version"),
        ]
    else:
        raise ValueError(f"unknown event type {kind!r}")
    return rows.where(F.col(BROKEN).isNull()).select(F.lit(kind).alias("type"), *fields)


def stream_champion_scoring(
    rows: DataFrame,
    registry: Registry,
    model_name: str,
    out_path: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Score feature rows with the champion of the moment.

    The alias is looked up once per batch and the model loaded when the version has changed. Rows
    that cannot be scored, for want of a model or of a feature, are written with a NULL prediction.
    """
    loaded: dict[str, object] = {"version": None, "model": None}

    def run(batch: DataFrame, number: int) -> None:
        found = registry.champion(model_name)
        previous = loaded["version"]
        if found is None:
            loaded.update(version=None, model=None)
        elif found[0] != previous:
            try:
                loaded.update(version=found[0], model=PipelineModel.load(found[1]))
            except Exception:
                log.exception("the champion %s could not be loaded", found[1])
                loaded.update(version=None, model=None)
        failed = found is not None and loaded["version"] is None
        reload = "failed" if failed else "reloaded" if loaded["version"] != previous else "unchanged"
        model, version = loaded["model"], loaded["version"]
        features = LISTING_VIEW.feature_names
        if model is None:
            result = without_model(batch)
        else:
            complete, incomplete = null_guard(batch, features)
            result = score(complete, model, str(version)).unionByName(without_model(incomplete))
        result.withColumn("reload", F.lit(reload)).write.mode("overwrite").parquet(
            f"{out_path}/batch={number}"
        )

    return start_query(rows.writeStream.foreachBatch(run), checkpoint, available_now)
