"""Batch jobs over the listing tables."""

from __future__ import annotations

import logging
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.operators.catalog import DELETABLE_SOURCES, delete_new_arrival, with_ids_from
from demandloom.operators.features import coerce_types, feature_build, fleet_rows, validate_rows
from demandloom.schemas import BOOKING_CSV, LISTING, LISTING_CSV, LISTING_VIEW, listing_rules
from demandloom.session import staged
from demandloom.sources.events import SAVED_EVENT, to_events, write_events
from demandloom.sources.online import materialize_arrivals
from demandloom.sources.snapshots import Snapshot, Store
from demandloom.sources.tables import (
    append_new,
    scan_csv,
    scan_projected,
    table_or_none,
    write_offline,
)

log = logging.getLogger(__name__)

DELETED = "vehicle_id long"
QUEUED, SENT = "queued", "sent"


def load_tables(spark: SparkSession, data_dir: str, warehouse: str) -> None:
    """Load both CSV files into Parquet tables; rows already there are not loaded again.

    A listing is loaded once, by its id. Bookings have no id: of equal ones, as many are added as the
    file holds more than the table, so a grown file adds what is new and a repeated load adds none.
    """
    listings = scan_csv(spark, f"{data_dir}/vehicles.csv", LISTING_CSV, "csv")
    append_new(spark, listings, f"{warehouse}/vehicles", "vehicle_id", unique=True)
    bookings = scan_csv(spark, f"{data_dir}/reservations.csv", BOOKING_CSV)
    append_new(spark, bookings, f"{warehouse}/reservations", ["vehicle_id", "created_at"])


def materialize(
    spark: SparkSession,
    warehouse: str,
    offline_path: str,
    online_path: str,
    as_of: datetime | str | Column | None = None,
    batch: int | None = None,
) -> DataFrame:
    """Build features once and write both stores from the written copy.

    Rows with an observed label replace the offline store, the others go to the online store as one
    batch. Returns the feature rows.
    """
    listings = current_listings(spark, warehouse)
    bookings = scan_projected(spark, f"{warehouse}/reservations", BOOKING_CSV.fieldNames())
    built = coerce_types(feature_build(listings, bookings, as_of=as_of), LISTING_VIEW.schema)
    features = staged(built, "features")
    write_offline(fleet_rows(features), offline_path)
    number = int(datetime.now().timestamp() * 1000) if batch is None else batch
    materialize_arrivals(features, online_path, "backfill", number)
    return features


def current_listings(spark: SparkSession, warehouse: str) -> DataFrame:
    """Listings that have not been deleted."""
    listings = scan_projected(spark, f"{warehouse}/vehicles", LISTING.fieldNames())
    gone = table_or_none(spark, f"{warehouse}/deleted", DELETED)
    return listings if gone is None else listings.join(gone, LISTING_VIEW.key, "left_anti")


def save_listings(
    spark: SparkSession,
    warehouse: str,
    new: DataFrame,
    order: str,
    events_path: str | None = None,
    rejects_path: str | None = None,
) -> tuple[DataFrame, bool]:
    """Append the valid ones of some listings under fresh ids and announce each.

    Rows that break a rule are not saved; with `rejects_path` they are added there with the names of the
    rules. Ids come from a range that is reserved before the rows are written, so they are never given
    twice, whether rows are deleted or two saves run at once. Returns the saved rows and whether they
    were announced; what could not be announced is delivered by the next save, or by `deliver_saved`.
    """
    rules = {name: rule for name, rule in listing_rules().items() if name != LISTING_VIEW.key}
    valid, rejected = validate_rows(new, rules)
    if rejects_path is not None:
        rejected.write.mode("append").parquet(rejects_path)
    valid = staged(valid, "valid")
    everything = scan_projected(spark, f"{warehouse}/vehicles", LISTING.fieldNames())
    used = everything.agg(F.max(LISTING_VIEW.key)).first()[0] or 0
    first = Store(spark, f"{warehouse}/_ids").reserve(LISTING_VIEW.key, valid.count(), used)
    saved = staged(with_ids_from(valid, first, LISTING_VIEW.key, order, everything.columns), "saved")
    saved.write.mode("append").parquet(f"{warehouse}/vehicles")
    if events_path is None:
        return saved, False
    try:
        deliver_saved(spark, warehouse, events_path)
    except Exception:
        log.exception("saved-listing events were not written")
        return saved, False
    return saved, True


def deliver_saved(spark: SparkSession, warehouse: str, events_path: str) -> int:
    """Announce every saved listing that has not been announced; returns how many were sent.

    The saved rows are the outbox: what is to be sent is what an anti join with the queued ids leaves.
    Ids are queued under a number before they are sent, and the events of a number are one folder that
    is replaced if it is sent again. So a delivery that fails anywhere is taken up by the next one, and
    no event is lost or left twice.
    """
    store = Store(spark, f"{warehouse}/_outbox")
    saved = scan_projected(spark, f"{warehouse}/vehicles", LISTING.fieldNames()).where(
        F.col("source").isin(*DELETABLE_SOURCES)
    )

    def queue(now: Snapshot) -> Snapshot:
        waiting = saved.select(LISTING_VIEW.key).join(store.read(QUEUED, DELETED, now), LISTING_VIEW.key, "left_anti")
        number = now.properties.get(QUEUED, 0) + 1
        part = store.write(waiting, QUEUED, "outbox", number)
        return now.with_parts(part).with_property(QUEUED, number) if part.rows else now

    now = store.transact(queue)
    sent = 0
    for part in sorted(now.of(QUEUED), key=lambda p: p.batch):
        if part.batch <= now.properties.get(SENT, 0):
            continue
        ids = spark.read.schema(DELETED).parquet(f"{store.path}/{part.folder}")
        events = saved.join(ids, LISTING_VIEW.key, "left_semi")
        write_events(to_events(events, SAVED_EVENT.fieldNames()), events_path, part.batch)
        store.transact(lambda base, n=part.batch: base.with_property(SENT, max(n, base.properties.get(SENT, 0))))
        sent += part.rows
    done = store.snapshot()
    store.fold(QUEUED, DELETED, lambda p: p.batch <= done.properties.get(SENT, 0))
    return sent


def delete_listings(spark: SparkSession, warehouse: str, ids: DataFrame) -> DataFrame:
    """Delete listings that may be deleted by noting their ids; one report row per requested id."""
    _, outcome = delete_new_arrival(current_listings(spark, warehouse), ids)
    report = staged(outcome, "deletions")
    gone = report.where(F.col("outcome") == "deleted").select(LISTING_VIEW.key)
    gone.write.mode("append").parquet(f"{warehouse}/deleted")
    return report


def completion_event(spark: SparkSession, dag_id: str, run_id: str, state: str) -> DataFrame:
    """The message that tells listeners a job has ended."""
    return spark.range(1).select(
        F.lit(dag_id).alias("dag_id"), F.lit(run_id).alias("dag_run_id"), F.lit(state).alias("state")
    )
