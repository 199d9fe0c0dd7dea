import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from demandloom.operators import stores
from demandloom.schemas import LISTING_VIEW

T0 = datetime(2025, 1, 1)
FEATURES = LISTING_VIEW.feature_names


def feature_rows(spark, *ids, label=None, stamp=T0, gap=-5.0):
    return spark.createDataFrame(
        [(i, 1, 8, 0, 250, gap, label, stamp) for i in ids], "vehicle_id long, technology long, num_images long,"
        "street_parked long, description long, price_diff double, num_reservations long, event_timestamp timestamp"
    )


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "vehicle_id long")


def test_offline_lookup(spark):
    offline = feature_rows(spark, 1, 2, label=5)
    assert rows(stores.offline_lookup(offline, ids(spark, 1)), "vehicle_id") == [(1,)]
    assert rows(stores.offline_lookup(offline, ids(spark, 999))) == []
    assert rows(stores.offline_lookup(offline, ids(spark, 1, 999)), "vehicle_id") == [(1,)]
    assert rows(stores.offline_lookup(offline.limit(0), ids(spark, 1))) == []


def test_online_lookup_keeps_the_request_shape(spark):
    found = stores.online_lookup(feature_rows(spark, 1), ids(spark, 1, 7))
    assert rows(found, "vehicle_id", "technology") == [(1, 1), (7, None)]
    assert rows(stores.missing_ids(ids(spark, 1, 7), feature_rows(spark, 1))) == [(7,)]


def test_resolution_order_and_unknown_ids(spark):
    offline = feature_rows(spark, 1, 2, label=3)
    online = feature_rows(spark, 2, 3, gap=50.0).unionByName(
        feature_rows(spark, 4).withColumn("technology", F.lit(None).cast("long"))
    )
    got = stores.resolve_features(ids(spark, 1, 2, 3, 4, 5), offline, online)
    assert rows(got, "vehicle_id", "store", "materialized", "price_diff") == [
        (1, "offline", True, -5.0),
        (2, "offline", True, -5.0),
        (3, "online", True, 50.0),
        (4, "none", False, None),
        (5, "none", False, None),
    ]
    degraded = stores.resolve_features(ids(spark, 1, 3), offline, None, drop_unresolved=True)
    assert rows(degraded, "vehicle_id") == [(1,)]
    single = stores.resolve_features(ids(spark, 3), offline, None)
    assert rows(single, "vehicle_id", "store") == [(3, "none")]
    assert tuple(stores.store_coverage(got).first()) == (2, 1, 2, 5)


def test_an_id_asked_twice_resolves_once(spark):
    got = stores.resolve_features(ids(spark, 1, 1, 2, 2), feature_rows(spark, 1), None)
    assert rows(got, "vehicle_id", "store") == [(1, "offline"), (2, "none")]


def test_a_key_stored_twice_resolves_once(spark):
    twice = feature_rows(spark, 1, gap=1.0).unionByName(
        feature_rows(spark, 1, gap=2.0, stamp=T0 + timedelta(days=1))
    )
    got = stores.resolve_features(ids(spark, 1), twice, None)
    assert rows(got, "vehicle_id", "price_diff") == [(1, 2.0)]


def test_upsert_takes_the_newer_stamp_and_the_incoming_row_on_a_tie(spark):
    current = feature_rows(spark, 1, 2, 3, gap=1.0, stamp=T0 + timedelta(days=1))
    incoming = (
        feature_rows(spark, 1, gap=2.0, stamp=T0)
        .unionByName(feature_rows(spark, 2, gap=2.0, stamp=T0 + timedelta(days=1)))
        .unionByName(feature_rows(spark, 4, gap=2.0))
    )
    merged = stores.upsert_latest(current, incoming, "vehicle_id", "event_timestamp")
    assert rows(merged, "vehicle_id", "price_diff") == [(1, 1.0), (2, 2.0), (3, 1.0), (4, 2.0)]


def test_life_time_is_strict(spark):
    df = feature_rows(spark, 1, stamp=T0).unionByName(feature_rows(spark, 2, stamp=T0 + timedelta(seconds=1)))
    kept = stores.online_ttl(df, now=T0 + timedelta(days=365))
    assert rows(kept, "vehicle_id") == [(2,)]
    assert rows(stores.purge_online(df, ids(spark, 1)), "vehicle_id") == [(1,)]


def test_union_stores_prefers_offline(spark):
    both = stores.union_stores(feature_rows(spark, 1), feature_rows(spark, 1, 2))
    assert rows(both, "vehicle_id", "store") == [(1, "offline"), (2, "online")]


def asof_case(seed, n_labels, n_history, hot):
    rng = random.Random(seed)

    def key():
        return 0 if rng.random() < hot else rng.randint(1, 5)

    labels = [(i, key(), T0 + timedelta(minutes=rng.randint(0, 4000))) for i in range(n_labels)]
    history = [
        (key(), T0 + timedelta(minutes=rng.randint(0, 4000)), i, None if rng.random() < 0.2 else float(i))
        for i in range(n_history)
    ]
    return labels, history


def brute_asof(labels, history, ttl):
    out = []
    for lid, key, ts in labels:
        best = None
        for hkey, hts, hid, value in history:
            if hkey == key and ts - ttl < hts <= ts and (best is None or (hts, hid) > best[:2]):
                best = (hts, hid, value)
        out.append((lid, best[1] if best else None, best[2] if best else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("dominant_rows", [None, 1, 150])
@pytest.mark.parametrize("seed,hot", [(1, 0.0), (2, 0.6), (3, 0.95)])
def test_asof_equals_brute_force_with_a_dominant_key(spark, seed, hot, dominant_rows):
    labels, history = asof_case(seed, 300, 400, hot)
    got = stores.asof_features(
        spark.createDataFrame(labels, "lid long, k long, ts timestamp"),
        spark.createDataFrame(history, "k long, ts timestamp, hid long, v double"),
        "k",
        "ts",
        ["hid", "v"],
        ttl_days=1,
        newest=["hid"],
        dominant_rows=dominant_rows,
    )
    assert rows(got, "lid", "hid", "v") == brute_asof(labels, history, timedelta(days=1))


@pytest.mark.parametrize("dominant_rows", [None, 1])
def test_asof_keeps_labels_without_time_and_repeated_labels(spark, dominant_rows):
    labels = spark.createDataFrame(
        [(1, 1, T0), (2, 1, T0), (3, 1, None), (4, None, T0)], "lid long, k long, ts timestamp"
    )
    history = spark.createDataFrame([(1, T0, 9.0), (None, T0, 1.0)], "k long, ts timestamp, v double")
    got = stores.asof_features(labels, history, "k", "ts", ["v"], dominant_rows=dominant_rows)
    assert rows(got, "lid", "v") == [(1, 9.0), (2, 9.0), (3, None), (4, None)]


def test_asof_refuses_columns_that_would_be_overwritten(spark):
    df = spark.createDataFrame([(1, T0, 1.0)], "k long, ts timestamp, v double")
    with pytest.raises(ValueError, match="already have"):
        stores.asof_features(df, df, "k", "ts", ["v"])


def test_asof_spreads_a_dominant_key_over_ranges(spark):
    labels = spark.range(20_000).selectExpr("id", "1L as k", "timestamp_seconds(1700000000 + id * 7) as ts")
    history = spark.range(20_000).selectExpr("1L as k", "timestamp_seconds(1700000000 + id * 7 - 3) as ts", "id as v")
    got = stores.asof_features(labels, history, "k", "ts", ["v"], dominant_rows=1000)
    assert got.where("v = id").count() == 20_000
    tasks = got.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1


def test_dominant_keys_are_found_by_their_share(spark):
    side = spark.range(100).select(F.when(F.col("id") < 40, 7).otherwise(F.col("id")).alias("k"))
    assert stores.dominant_keys([side, side], "k") == []
    assert stores.dominant_keys([side, side], "k", 80) == [7]
    assert stores.dominant_keys([side.limit(0)], "k", 1) == []


def test_latest_per_key_matches_pandas(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    frame = pd.read_parquet(f"{folder}/events.parquet").sort_values(["ts", "event_id"]).groupby("user_id").tail(1)
    got = stores.latest_per_key(events, "user_id", "ts", "event_id")
    assert rows(got, "event_id") == sorted(((int(i),) for i in frame.event_id), key=repr)
