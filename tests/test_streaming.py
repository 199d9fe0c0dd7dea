import json
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from demandloom.operators import models
from demandloom.operators.features import validate_rows
from demandloom.schemas import LISTING_CSV, LISTING_VIEW, listing_rules
from demandloom.session import scratch_path
from demandloom.sources import events as ev
from demandloom.sources.online import read_online
from demandloom.sources.registry import Registry
from demandloom.sources.snapshots import Store
from demandloom.streaming import event_projection, stream_champion_scoring, stream_materialize
from demandloom.streaming.event_time import announce_once, store_by_event_time
from demandloom.streaming.jobs import saved_features
from demandloom.streaming.promotions import registered_scorer, score_by_promotions, with_control

FEATURES = LISTING_VIEW.feature_names


def saved(vid, gap=-5.0, **changes):
    event = {
        "vehicle_id": vid,
        "technology": 1,
        "actual_price": 70.0 + gap,
        "recommended_price": 70.0,
        "num_images": 8,
        "street_parked": 0,
        "description": 180,
    }
    return json.dumps({**event, **changes})


@pytest.fixture
def channel(tmp_path):
    """A folder of message files; every call adds one file."""
    folder = tmp_path / "channel"
    folder.mkdir()

    def add(*lines):
        number = len(os.listdir(folder))
        (folder / f"{number:03d}.txt").write_text("\n".join(lines) + "\n")
        return str(folder)

    return add


def start(spark, folder, root, **options):
    messages = ev.stream_messages(spark, folder, files_per_batch=1)
    query = stream_materialize(
        messages, f"{root}/online", f"{root}/events", f"{root}/rejects", f"{root}/checkpoint", **options
    )
    query.awaitTermination()
    return query


def test_messages_over_several_batches(spark, channel):
    root = scratch_path(spark, "s")
    channel(saved(1), saved(2), "broken {")
    channel(saved(2, gap=9.0), saved(3, technology=5))
    folder = channel('{"technology": 1}', saved(4, actual_price=None))
    start(spark, folder, root)
    got = read_online(spark, f"{root}/online")
    assert rows(got, "vehicle_id", "price_diff", "num_reservations") == [(1, -5.0, None), (2, 9.0, None)]
    assert got.schema == LISTING_VIEW.schema
    rejects = spark.read.parquet(f"{root}/rejects")
    assert rejects.count() == 4 and rejects.where("undecodable").count() == 1
    told = event_projection(spark.read.text(f"{root}/events"), ev.VEHICLE_MATERIALIZED)
    assert rows(told) == [(ev.VEHICLE_MATERIALIZED, v) for v in (1, 2, 2)]


def test_a_restart_reads_only_new_messages(spark, channel):
    root = scratch_path(spark, "s")
    start(spark, channel(saved(1)), root)
    start(spark, channel(saved(2)), root)
    assert rows(read_online(spark, f"{root}/online"), "vehicle_id") == [(1,), (2,)]
    assert spark.read.text(f"{root}/events").count() == 2


def test_a_batch_that_runs_again_leaves_one_copy(spark, channel):
    root = scratch_path(spark, "s")
    folder = channel(saved(1), "broken {")
    start(spark, folder, root)
    # A fresh checkpoint makes batch 0 run once more into the same folders.
    messages = ev.stream_messages(spark, folder)
    stream_materialize(
        messages, f"{root}/online", f"{root}/events", f"{root}/rejects", f"{root}/checkpoint-2"
    ).awaitTermination()
    assert [p.rows for p in Store(spark, f"{root}/online").snapshot().parts] == [1]
    assert spark.read.text(f"{root}/events").count() == 1
    assert spark.read.parquet(f"{root}/rejects").count() == 1


def test_backfill_gives_the_same_rows(spark, channel):
    root = scratch_path(spark, "s")
    lines = [saved(i, gap=float(i)) for i in range(0, 40)]
    channel(*lines[:15])
    folder = channel(*lines[15:])
    start(spark, folder, root, as_of="2025-01-01 00:00:00")
    table = spark.read.schema(LISTING_CSV).json(folder)
    batch = saved_features(validate_rows(table, listing_rules())[0], "2025-01-01 00:00:00")
    assert rows(batch) == rows(read_online(spark, f"{root}/online"))
    assert batch.count() == 39


def test_projection_labels_and_fields(spark):
    def project(kind, *messages):
        return rows(event_projection(spark.createDataFrame([(m,) for m in messages], "value string"), kind))

    assert project(ev.VEHICLE_MATERIALIZED, '{"vehicle_id": 4}', "{") == [("vehicle-materialized", 4)]
    done = '{"dag_id": "d", "dag_run_id": "r", "state": "success"}'
    assert project(ev.PIPELINE_COMPLETED, done) == [("pipeline-completed", "d", "r", "success")]
    loaded, empty = '{"type": "model-reloaded", "version": "3"}', '{"type": "model-reloaded"}'
    assert project(ev.HEALTH_CHANGED, loaded, empty) == [
        ("health-changed", "no_model", ""),
        ("health-changed", "ok", "3"),
    ]
    with pytest.raises(ValueError, match="unknown event type"):
        project("other", "{}")


def test_scoring_follows_the_champion(spark, tmp_path):
    root = scratch_path(spark, "c")
    registry = Registry(spark, f"{root}/registry").create()
    schema = f"vehicle_id long, {', '.join(f'{c} double' for c in FEATURES)}"
    incoming = tmp_path / "rows"

    def arrive(*ids):
        spark.createDataFrame(
            [(i, 1.0, 9.0, 0.0, 180.0, None if i == 99 else -5.0) for i in ids], schema
        ).coalesce(1).write.mode("append").parquet(str(incoming))
        stream = spark.readStream.schema(schema).parquet(str(incoming))
        stream_champion_scoring(stream, registry, "m", f"{root}/out", f"{root}/checkpoint").awaitTermination()

    def promote(level):
        train = spark.range(20).selectExpr(
            "id as vehicle_id", *[f"cast(id as double) as {c}" for c in FEATURES], f"{level} as y"
        )
        model = models.train(train, FEATURES, "y", models.forest(trees=1, depth=1))
        empty = spark.createDataFrame([], "name string, value double")
        path = registry.log_run(f"run{level}", model, empty, {}, {})
        registry.register("m", f"run{level}", path)
        newest = registry.table("aliases").where("alias = 'candidate'")
        registry.append(
            "aliases",
            newest.orderBy(F.desc("version")).limit(1).withColumn("alias", F.lit("champion")),
        )

    arrive(1)
    promote(2.0)
    arrive(2, 99)
    promote(5.0)
    arrive(3)
    got = spark.read.parquet(f"{root}/out")
    assert rows(got, "vehicle_id", "predicted_reservations", "model_version") == [
        (1, None, None),
        (2, 2.0, "1"),
        (3, 5.0, "2"),
        (99, None, None),
    ]


def timed(vid, hour, **changes):
    return saved(vid, saved_at=f"2025-01-01T{hour:02d}:00:00.000Z", **changes)


@pytest.mark.parametrize("files", [1, 3])
def test_arrival_order_does_not_matter_with_event_time(spark, tmp_path, files):
    lines = [timed(1, 5, num_images=1), timed(1, 9, num_images=2), timed(2, 3, num_images=3), timed(2, 3, num_images=4)]
    lines += [timed(3, 1, technology=4), saved(4), "broken {"]
    want = [(1, 2, 9), (2, 4, 3)]
    for name, order in (("a", lines), ("b", lines[::-1]), ("c", lines[3:] + lines[:3])):
        root, folder = scratch_path(spark, "t"), tmp_path / name
        folder.mkdir()
        for k, line in enumerate(order):
            (folder / f"{k}.txt").write_text(line + "\n")
        messages = ev.stream_messages(spark, str(folder), files_per_batch=files)
        store_by_event_time(messages, f"{root}/online", f"{root}/rejects", f"{root}/c").awaitTermination()
        got = read_online(spark, f"{root}/online").withColumn("hour", F.hour("event_timestamp"))
        assert rows(got, "vehicle_id", "num_images", "hour") == want
        assert spark.read.parquet(f"{root}/rejects").count() == 3


def test_repeated_deliveries_are_announced_once(spark, channel):
    root = scratch_path(spark, "t")
    channel(timed(1, 5), timed(2, 5))
    channel(timed(1, 5), timed(1, 6), timed(3, 6, technology=9))
    folder = channel(timed(2, 5))
    messages = ev.stream_messages(spark, folder, files_per_batch=1)
    announce_once(messages, f"{root}/events", f"{root}/c", "1 day").awaitTermination()
    told = event_projection(spark.read.text(f"{root}/events"), ev.VEHICLE_MATERIALIZED)
    assert rows(told, "vehicle_id") == [(1,), (1,), (2,)]


def test_promotions_decide_by_their_time_and_are_replayed(spark, tmp_path):
    root = scratch_path(spark, "p")
    schema = "vehicle_id long, at timestamp"
    incoming, control = tmp_path / "rows", tmp_path / "control"
    control.mkdir()
    spark.createDataFrame([], schema).write.parquet(str(incoming))

    def arrive(*cells):
        rows_ = spark.createDataFrame(list(cells), "vehicle_id long, at string").withColumn("at", F.to_timestamp("at"))
        rows_.coalesce(1).write.mode("append").parquet(str(incoming))

    def tell(*promotions):
        lines = [json.dumps({"model_name": m, "version": v, "at": at}) for m, v, at in promotions]
        (control / f"{len(os.listdir(control))}.txt").write_text("\n".join(lines) + "\n")

    def run(checkpoint="c"):
        stream = with_control(
            spark.readStream.schema(schema).parquet(str(incoming)), ev.stream_messages(spark, str(control))
        )
        score_by_promotions(
            stream, "m", lambda df, v: df.withColumn("predicted_reservations", F.lit(float(v))).withColumn("model_version", F.lit(v)),
            f"{root}/out", f"{root}/{checkpoint}", f"{root}/events",
        ).awaitTermination()
        return rows(spark.read.parquet(f"{root}/out/rows"), "vehicle_id", "model_version", "predicted_reservations")

    tell(("m", "2", "2025-01-01T02:00:00Z"), ("other", "9", "2025-01-01T00:00:00Z"), ("m", None, "2025-01-01T00:00:00Z"))
    arrive((1, "2025-01-01 01:59:59"), (2, "2025-01-01 02:00:00"), (3, "2025-01-01 05:00:00"))
    first = [(1, None, None), (2, "2", 2.0), (3, "2", 2.0)]
    assert run() == first
    tell(("m", "3", "2025-01-01T04:00:00Z"))
    arrive((4, "2025-01-01 03:00:00"), (5, "2025-01-01 04:30:00"))
    # Row 3 came before the promotion was known and stays as it was written.
    assert run() == first + [(4, "2", 2.0), (5, "3", 3.0)]
    told = spark.read.text(f"{root}/events")
    assert rows(event_projection(told, ev.HEALTH_CHANGED), "model_version") == [("2",), ("3",)]
    # A batch that runs again without its checkpoint sees the promotions of its number.
    assert run("again")[0] == (1, None, None)


def test_a_registered_model_scores_by_its_version(spark):
    registry = Registry(spark, scratch_path(spark, "r")).create()
    train = spark.range(20).selectExpr("id as vehicle_id", *[f"cast(id as double) as {c}" for c in FEATURES], "4.0 as y")
    model = models.train(train, FEATURES, "y", models.forest(trees=1, depth=1))
    path = registry.log_run("run", model, spark.createDataFrame([], "name string, value double"), {}, {})
    registry.register("m", "run", path)
    scorer = registered_scorer(registry, "m")
    incomplete = train.withColumn("price_diff", F.when(F.col("vehicle_id") > 0, F.col("price_diff")))
    assert scorer(incomplete, "1").where("predicted_reservations = 4.0").count() == 19
    assert scorer(incomplete, "8").where("predicted_reservations is null").count() == 20
