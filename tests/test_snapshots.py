"""Versioned tables: pinned readers, conflicts, merges, reserved ids, expiry, the outbox, the key index."""

import threading
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from demandloom.plans import batch
from demandloom.schemas import LISTING_VIEW
from demandloom.session import scratch_path
from demandloom.sources import events as ev
from demandloom.sources import online
from demandloom.sources.registry import Registry
from demandloom.sources.snapshots import Conflict, Store
from demandloom.sources.tables import key_index, lookup, scan_evolving, write_offline

SCHEMA = "k long, v string"


def some(spark, *cells):
    return spark.createDataFrame(list(cells), SCHEMA)


def test_a_reader_keeps_its_version(spark):
    store = Store(spark, scratch_path(spark, "store"))
    assert store.snapshot().version == 0 and store.read("t", SCHEMA).collect() == []
    first = store.transact(lambda now: now.with_parts(store.write(some(spark, (1, "a")), "t")))
    second = store.transact(lambda now: now.with_parts(store.write(some(spark, (2, "b")), "t")))
    assert (first.version, second.version) == (1, 2)
    pinned = store.read("t", SCHEMA, store.snapshot(1))
    store.fold("t", SCHEMA, most=1)
    assert len(store.snapshot().of("t")) == 1
    assert rows(pinned) == [(1, "a")] and rows(store.read("t", SCHEMA)) == [(1, "a"), (2, "b")]
    assert store.versions() == [1, 2, 3]


def test_the_second_commit_on_a_snapshot_is_refused(spark):
    store = Store(spark, scratch_path(spark, "store"))
    base = store.snapshot()
    store.commit(base, base.with_property("x", 1))
    with pytest.raises(Conflict):
        store.commit(base, base.with_property("x", 2))
    assert store.snapshot().properties == {"x": 1}
    assert store.transact(lambda now: now).version == 1


def test_writers_at_once_lose_nothing(spark):
    store = Store(spark, scratch_path(spark, "store"))
    got = []

    def take():
        for _ in range(5):
            got.append(store.reserve("id", 3, least=100))

    threads = [threading.Thread(target=take) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == list(range(101, 161, 3)) and store.snapshot().version == 20


def test_expired_versions_and_their_folders_go(spark):
    store = Store(spark, scratch_path(spark, "store"))
    for k in range(3):
        store.transact(lambda now, k=k: now.with_parts(store.write(some(spark, (k, "x")), "t", "w", 0)))
    orphan = store.write(some(spark, (9, "lost")), "t")
    assert store.expire(keep=2) == []
    assert store.versions() == [2, 3]
    dropped = store.expire(keep=1, older_than=0)
    assert len(dropped) == 3 and orphan.folder in dropped
    assert rows(store.read("t", SCHEMA)) == [(2, "x")]


def stored(spark, cells, hours=0):
    stamp = datetime(2025, 1, 1) + timedelta(hours=hours)
    return spark.createDataFrame([(i, 1, 8, 0, 250, gap, None, stamp) for i, gap in cells], LISTING_VIEW.schema)


def test_the_store_follows_its_keys(spark):
    path = scratch_path(spark, "online")
    for n in range(7):
        online.write_online(stored(spark, [(k, float(n)) for k in range(20)], n), path, "events", n)
    live = sum(p.rows for p in Store(spark, path).snapshot().of(online.ROWS))
    assert live <= 50
    assert rows(online.read_online(spark, path), "vehicle_id", "price_diff") == rows(
        spark.range(20).selectExpr("id", "cast(6 as double) as g")
    )


def test_batches_committed_during_a_merge_stay(spark, monkeypatch):
    path = scratch_path(spark, "online")
    online.write_online(stored(spark, [(1, 1.0), (2, 1.0)]), path, "events", 0, merge=False)
    plain = Store.write

    def write(self, df, table, writer="", batch=-1, **options):
        part = plain(self, df, table, writer, batch, **options)
        if writer == online.BASE:
            online.write_online(stored(spark, [(2, 7.0)], 1), path, "events", 1, merge=False)
        return part

    monkeypatch.setattr(Store, "write", write)
    merged = online.merge_online(spark, path)
    assert sorted(p.writer for p in merged.of(online.ROWS)) == ["base", "events"]
    assert rows(online.read_online(spark, path), "vehicle_id", "price_diff") == [(1, 1.0), (2, 7.0)]


def test_a_merge_that_comes_second_has_no_effect(spark, monkeypatch):
    path = scratch_path(spark, "online")
    for n in range(2):
        online.write_online(stored(spark, [(n, 1.0)]), path, "events", n, merge=False)
    seen = Store(spark, path).snapshot()
    first = online.merge_online(spark, path)
    monkeypatch.setattr(Store, "snapshot", lambda self, version=None, real=Store.snapshot, late=[seen]: late.pop() if late else real(self, version))
    assert online.merge_online(spark, path) == first
    assert rows(online.read_online(spark, path), "vehicle_id") == [(0,), (1,)]


def test_registrations_from_one_snapshot_get_two_versions(spark):
    registry = Registry(spark, scratch_path(spark, "registry")).create()
    assert registry.register("m", "r0", "p0") == 1
    seen = registry.store.snapshot()
    assert [registry.register("m", run, "p", seen) for run in ("r1", "r2")] == [2, 3]
    assert rows(registry.table("versions"), "version", "run_id") == [(1, "r0"), (2, "r1"), (3, "r2")]
    assert registry.path_of("m", 1) == "p0" and registry.path_of("m", 9) is None


NEW = "request long, technology long, actual_price double, recommended_price double, num_images long, street_parked long, description long"


def a_warehouse(spark):
    root = scratch_path(spark, "warehouse")
    known = spark.createDataFrame([(5, 1, 20.0, 30.0, 1, 0, 9, "csv")], batch.LISTING)
    known.write.parquet(f"{root}/vehicles")
    return root, spark.createDataFrame([(1, 1, 45.0, 50.0, 8, 0, 250), (2, 7, 45.0, None, 8, 0, 250)], NEW)


def test_invalid_listings_are_not_saved(spark):
    root, new = a_warehouse(spark)
    saved, _ = batch.save_listings(spark, root, new, "request", rejects_path=f"{root}/rejects")
    assert rows(saved, "vehicle_id") == [(6,)]
    bad = spark.read.parquet(f"{root}/rejects").first()
    assert (bad.request, bad.errors) == (2, ["technology", "recommended_price"])


def test_events_that_failed_are_delivered_once(spark, monkeypatch):
    root, new = a_warehouse(spark)
    events, real = f"{root}/events", batch.write_events
    calls = []

    def failing(rows_, path, number):
        # The first delivery fails before anything is written, the second after it.
        calls.append(number)
        if len(calls) > 1:
            real(rows_, path, number)
        raise OSError("channel is down")

    monkeypatch.setattr(batch, "write_events", failing)
    for _ in range(2):
        _, announced = batch.save_listings(spark, root, new, "request", events)
        assert not announced
    monkeypatch.setattr(batch, "write_events", real)
    assert batch.deliver_saved(spark, root, events) == 2
    assert batch.deliver_saved(spark, root, events) == 0
    told, _ = ev.read_events(spark.read.text(events), ev.SAVED_EVENT, ["vehicle_id"])
    assert rows(told, "vehicle_id") == [(6,), (7,)] and calls == [1, 1]


def rows_read(df):
    """Rows that the scan handed on."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_a_lookup_opens_few_row_groups(spark):
    path, n = scratch_path(spark, "offline"), 200_000
    table = spark.range(n).select((F.col("id") * 7919 % n * 2).alias("k"), F.lit("x" * 20).alias("v"))
    write_offline(table, path, order="k")
    stored_table = spark.read.parquet(path)
    assert rows_read(stored_table) == n
    few = lookup(stored_table, some(spark, (8, ""), (8, ""), (None, "")), "k")
    assert rows(few, "k") == [(8,)] and rows_read(few) <= n / 4
    # Odd ids lie within every range; the Bloom filters tell that they are not there.
    unordered = scratch_path(spark, "bloom")
    table.write.options(**key_index("k")).parquet(unordered)
    absent = lookup(spark.read.parquet(unordered), some(spark, (7777, "")), "k")
    assert rows_read(absent) <= n / 4
    assert lookup(stored_table, some(spark), "k").count() == 0
    many = lookup(stored_table, spark.range(1000).selectExpr("id as k"), "k")
    assert many.count() == 500


def test_files_of_different_age(spark):
    path = scratch_path(spark, "evolving")
    spark.createDataFrame([(1, 2)], "k long, n int").write.parquet(f"{path}/old")
    spark.createDataFrame([(2, 3, "b"), (3, 4, None)], "k long, n int, v string").write.parquet(f"{path}/new")
    schema = spark.createDataFrame([], "k long, n long, v string, w double").schema
    folders = spark.createDataFrame([], schema).schema
    got = scan_evolving(spark, f"{path}/*", folders, {"v": "none"})
    assert rows(got) == [(1, 2, "none", None), (2, 3, "b", None), (3, 4, "none", None)]
    wrong = spark.createDataFrame([], "k string, n long").schema
    with pytest.raises(ValueError, match="k is bigint, not string"):
        scan_evolving(spark, f"{path}/*", wrong)
