from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from demandloom.schemas import BOOKING_CSV, LISTING_CSV, LISTING_VIEW
from demandloom.session import scratch_path, shared_dir, split_count
from demandloom.sources import events as ev
from demandloom.sources import online
from demandloom.sources.snapshots import Store
from demandloom.sources.tables import (
    append_new,
    file_stats,
    scan_csv,
    scan_offline,
    scan_projected,
    store_stats,
    view_summary,
    write_offline,
)

VEHICLES = (
    "vehicle_id,technology,actual_price,recommended_price,num_images,street_parked,description\r\n"
    "1,1,45,50,8,0,250\r\n2,0,30.5,25,2,1,50\r\n3,1,60,55,15,0,400\r\n"
)
RESERVATIONS = "id,vehicle_id,created_at\n1,1,2025-01-01 10:00:00\n2,1,2025-01-01 10:00:00\n3,3,2025-01-02\n"


@pytest.fixture
def data_dir(tmp_path):
    (tmp_path / "vehicles.csv").write_bytes(VEHICLES.encode())
    (tmp_path / "reservations.csv").write_text(RESERVATIONS)
    return str(tmp_path)


def test_csv_with_carriage_returns_and_whole_prices(spark, data_dir):
    got = scan_csv(spark, f"{data_dir}/vehicles.csv", LISTING_CSV, "csv")
    assert rows(got, "vehicle_id", "recommended_price", "description", "source") == [
        (1, 50.0, 250, "csv"),
        (2, 25.0, 50, "csv"),
        (3, 55.0, 400, "csv"),
    ]


def test_csv_columns_are_matched_by_name(spark, data_dir):
    got = scan_csv(spark, f"{data_dir}/reservations.csv", BOOKING_CSV)
    assert got.schema == BOOKING_CSV
    assert rows(got, "vehicle_id") == [(1,), (1,), (3,)]


def test_malformed_csv_stops_the_load(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("vehicle_id,created_at\nx,2025-01-01\n")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        scan_csv(spark, str(tmp_path / "bad.csv"), BOOKING_CSV).collect()


def test_a_second_load_adds_nothing(spark, data_dir):
    path = scratch_path(spark, "t")
    table = scan_csv(spark, f"{data_dir}/vehicles.csv", LISTING_CSV, "csv")
    for part in (table.where("vehicle_id < 3"), table, table):
        append_new(spark, part, path, "vehicle_id")
    assert rows(spark.read.parquet(path), "vehicle_id") == [(1,), (2,), (3,)]


def test_offline_round_trip_replaces(spark, listings):
    path = scratch_path(spark, "a/b/c")
    write_offline(listings, path)
    write_offline(listings.where("vehicle_id > 1"), path)
    assert rows(scan_offline(spark, path), "vehicle_id") == [(2,), (3,)]
    assert scan_projected(spark, path, ["description"]).columns == ["description"]
    write_offline(listings, path, order="vehicle_id")
    assert rows(scan_offline(spark, path), "vehicle_id") == [(1,), (2,), (3,)]
    stats = file_stats(scan_offline(spark, path)).first()
    assert stats.files >= 1 and stats.size_bytes > 0 and stats.last_modified is not None


def test_store_statistics(spark, listings):
    got = store_stats(listings, listings.limit(0), "vehicle_id")
    assert rows(got) == [("offline", True, 3, 3), ("online", False, 0, 0)]
    view = view_summary(spark, LISTING_VIEW).first()
    assert (view.entity_key, view.label, view.ttl_days) == ("vehicle_id", "num_reservations", 365)


def stored(spark, *cells, hours=0):
    stamp = datetime(2025, 1, 1) + timedelta(hours=hours)
    return spark.createDataFrame([(i, 1, 8, 0, 250, gap, label, stamp) for i, gap, label in cells], LISTING_VIEW.schema)


def test_only_rows_without_outcome_go_online(spark):
    path = scratch_path(spark, "online")
    assert online.materialize_arrivals(stored(spark, (1, 1.0, 3), (2, 2.0, None), (3, 3.0, None)), path, "backfill", 0)
    assert rows(online.read_online(spark, path), "vehicle_id") == [(2,), (3,)]
    assert not online.materialize_arrivals(stored(spark, (1, 1.0, 3)), scratch_path(spark, "online"), "backfill", 0)


def test_online_writes_replace_and_repeat_safely(spark):
    path = scratch_path(spark, "online")
    online.write_online(stored(spark, (1, 1.0, None), (2, 1.0, None)), path, "backfill", 0)
    for _ in range(2):
        online.write_online(stored(spark, (2, 5.0, None), hours=1), path, "events", 0)
    online.write_online(stored(spark, (2, 6.0, None), hours=1), path, "events", 1)
    want = [(1, 1.0), (2, 6.0)]
    assert rows(online.read_online(spark, path), "vehicle_id", "price_diff") == want
    asked = spark.createDataFrame([(2,), (9,)], "vehicle_id long")
    assert rows(online.read_online(spark, path, ids=asked), "vehicle_id", "price_diff") == [(2, 6.0)]
    target = scratch_path(spark, "online")
    compacted = online.compact_online(spark, path, target)
    assert rows(compacted, "vehicle_id", "price_diff") == want
    assert sum(p.rows for p in Store(spark, target).snapshot().of(online.ROWS)) == 2


def test_messages_are_split_by_usability(spark):
    messages = spark.createDataFrame(
        [
            ('{"vehicle_id": 1, "technology": 1, "actual_price": 45}',),
            ('{"vehicle_id": "x"}',),
            ('{"technology": 1}',),
            ("not json",),
            (None,),
        ],
        "value string",
    )
    good, bad = ev.read_events(messages, ev.SAVED_EVENT, ["vehicle_id"])
    assert rows(good, "vehicle_id", "actual_price") == [(1, 45.0)]
    assert bad.count() == 4


def test_events_round_trip(spark, listings):
    path = scratch_path(spark, "messages")
    for _ in range(2):
        ev.write_events(ev.to_events(listings, ["vehicle_id"], "vehicle-materialized"), path, 0)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert sorted(lines)[0] == '{"type":"vehicle-materialized","vehicle_id":1}' and len(lines) == 3


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert split_count(spark) == 64


def test_every_timing_counts_and_samples_pair_by_position(spark, tmp_path):
    import datetime
    from decimal import ROUND_HALF_UP, Decimal

    import numpy as np

    from demandloom.registered import QUERIES

    kinds = ["view"] * 7 + ["click"] * 4 + ["purchase"] * 2 + ["signup"] * 5 + ["error"] * 3
    day = datetime.datetime(2025, 3, 4)
    rows = [(i * 13 % 97, day, 1, kind, float(i * i % 31), f'{{"k": {i}}}') for i, kind in enumerate(kinds)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "events.parquet"))

    def samples(kind):
        return [r[4] for r in sorted(rows) if r[3] == kind]

    def shown(values):
        return float(Decimal(repr(round(float(np.mean(values)), 9))).quantize(Decimal("0.001"), ROUND_HALF_UP))

    got = {r["source"]: r for r in QUERIES["latency_summary"](spark, str(tmp_path)).collect()}
    assert set(got) == {*kinds, "raw", "online_store"}
    means = {}
    for source, feature, predict in [("raw", "click", "view"), ("online_store", "purchase", "signup")]:
        f, p = samples(feature), samples(predict)
        means[source] = shown([a + b for a, b in zip(f, p)])
        mine = got[source]
        assert mine["n_iterations"] == max(len(f), len(p))
        assert [mine["avg_latency_ms"], mine["avg_features_ms"], mine["avg_predict_ms"]] == [means[source], shown(f), shown(p)]
    for kind in set(kinds):
        assert got[kind]["n_iterations"] == kinds.count(kind)
    compared = QUERIES["latency_compare"](spark, str(tmp_path)).first()
    assert [compared["raw_avg"], compared["store_avg"]] == [means["raw"], means["online_store"]]
