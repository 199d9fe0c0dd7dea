"""Saved listings by the time of their event, whatever the order they arrive in.

The store takes every message with the time it names; a read takes the newest, so an older event that
arrives later changes nothing, and no message is dropped for being late. Announcements are told once:
messages delivered again within the delay are known from the state, which the watermark bounds.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from demandloom.operators.features import annotate_errors
from demandloom.operators.stores import latest_per_key
from demandloom.schemas import LISTING_VIEW, listing_rules
from demandloom.sources.events import (
    BROKEN,
    PLACE,
    SAVED_EVENT,
    VEHICLE_MATERIALIZED,
    decode,
    is_usable,
    to_events,
)
from demandloom.sources.online import write_online
from demandloom.streaming.jobs import saved_features, start_query

EVENT_TIME = "saved_at"
DELAY = "1 hour"
TIMED_EVENT = T.StructType([*SAVED_EVENT.fields, T.StructField(EVENT_TIME, T.TimestampType())])


def _checked(messages: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, Column]:
    """Decoded messages with their errors, and the condition for those that count."""
    decoded = annotate_errors(decode(messages.drop(PLACE), TIMED_EVENT), rules)
    return decoded, is_usable([LISTING_VIEW.key, EVENT_TIME]) & (F.size("errors") == 0)


def store_by_event_time(
    messages: DataFrame,
    online_path: str,
    rejects_path: str,
    checkpoint: str,
    writer: str = "events",
    rules: Mapping[str, Column] | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Messages to online rows whose stamp is the event's; those without a time are rejected.

    Messages of one key and time are told apart by their values, so the store ends in one state for
    every order and every split into batches.
    """
    rules = listing_rules() if rules is None else rules

    def run(batch: DataFrame, number: int) -> None:
        decoded, good = _checked(batch, rules)
        decoded = decoded.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            decoded.where(~good).select("value", F.col(BROKEN).isNotNull().alias("undecodable"), "errors").write.mode(
                "overwrite"
            ).parquet(f"{rejects_path}/batch={number}")
            rows = saved_features(decoded.where(good), F.col(EVENT_TIME))
            last = latest_per_key(rows, LISTING_VIEW.key, LISTING_VIEW.timestamp, *LISTING_VIEW.feature_names)
            write_online(last, online_path, writer, number, arrival=0)
        finally:
            decoded.unpersist()

    return start_query(messages.writeStream.foreachBatch(run), checkpoint, available_now)


def announce_once(
    messages: DataFrame,
    events_path: str,
    checkpoint: str,
    delay: str = DELAY,
    rules: Mapping[str, Column] | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """A materialized event for every saved key and time, once for all deliveries within `delay`.

    A message that comes later than `delay` after the newest one is stored but not announced: whether
    it was told before is not known any more.
    """
    decoded, good = _checked(messages, listing_rules() if rules is None else rules)
    once = (
        decoded.where(good)
        .select(LISTING_VIEW.key, EVENT_TIME)
        .withWatermark(EVENT_TIME, delay)
        .dropDuplicatesWithinWatermark([LISTING_VIEW.key, EVENT_TIME])
    )
    events = to_events(once, [LISTING_VIEW.key], VEHICLE_MATERIALIZED)
    return start_query(events.writeStream.format("text").option("path", events_path), checkpoint, available_now)
