import pytest
from conftest import rows
from pyspark.sql import functions as F

from demandloom.__main__ import main, parse_args
from demandloom.plans import batch, model_jobs
from demandloom.schemas import LISTING_VIEW
from demandloom.session import scratch_path
from demandloom.sources import events as ev
from demandloom.sources.online import read_online
from demandloom.sources.registry import Registry

HEADER = "vehicle_id,technology,actual_price,recommended_price,num_images,street_parked,description"


@pytest.fixture(scope="module")
def data_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("data")
    vehicles = [f"{i},{i % 2},{40 + i % 9},50,{i % 6},{i % 2},{i * 7 % 250}" for i in range(1, 61)]
    (folder / "vehicles.csv").write_text("\n".join([HEADER, *vehicles]) + "\n")
    bookings = [f"{n},{i},2025-01-0{1 + n % 9}" for i in range(1, 61) for n in range(i % 5)]
    (folder / "reservations.csv").write_text("\n".join(["id,vehicle_id,created_at", *bookings]) + "\n")
    return str(folder)


@pytest.fixture(scope="module")
def stores(spark, data_dir):
    root = scratch_path(spark, "jobs")
    warehouse = f"{root}/warehouse"
    batch.load_tables(spark, data_dir, warehouse)
    batch.load_tables(spark, data_dir, warehouse)
    ui = spark.read.parquet(f"{warehouse}/vehicles").where("vehicle_id <= 3").withColumns(
        {"vehicle_id": F.col("vehicle_id") + 100, "source": F.lit("ui")}
    )
    ui.write.mode("append").parquet(f"{warehouse}/vehicles")
    batch.materialize(spark, warehouse, f"{root}/offline", f"{root}/online", as_of="2025-06-01")
    return root


def test_two_loads_and_both_stores(spark, stores):
    vehicles = spark.read.parquet(f"{stores}/warehouse/vehicles")
    assert vehicles.where("source = 'csv'").count() == 60
    offline = spark.read.parquet(f"{stores}/offline")
    assert offline.count() == 60 and offline.where("num_reservations is null").count() == 0
    assert offline.where("num_reservations = 0").count() == 12
    assert offline.schema.fieldNames() == LISTING_VIEW.schema.fieldNames()
    online = read_online(spark, f"{stores}/online")
    assert rows(online, "vehicle_id", "num_reservations") == [(101, None), (102, None), (103, None)]


def test_train_promote_and_score(spark, stores):
    registry = Registry(spark, f"{stores}/registry").create()
    events = f"{stores}/promoted"
    assert model_jobs.champion_model(registry, "demand") == (None, None)
    small = {"trees": 3, "depth": 3}
    assert model_jobs.train_candidate(spark, f"{stores}/offline", registry, "demand", small, folds=2) == 1
    first = model_jobs.promote_models(registry, "demand", events_path=events, batch=0).first()
    assert (first.outcome, first.promoted) == ("first_champion", True)
    assert model_jobs.train_candidate(spark, f"{stores}/offline", registry, "demand", small, folds=2) == 2
    second = model_jobs.promote_models(registry, "demand", events_path=events, batch=1).first()
    assert (second.outcome, second.promoted) == ("not_better", False)
    told = ev.read_events(spark.read.text(events), ev.PROMOTED_EVENT)[0]
    assert rows(told, "model_name", "version") == [("demand", "1")]
    assert model_jobs.promote_models(registry, "demand", version=2).first().candidate_version == 2

    model, version = model_jobs.champion_model(registry, "demand")
    assert version == "1"
    listings = spark.read.parquet(f"{stores}/warehouse/vehicles")
    assert model_jobs.score_listings(listings, model, version).where("predicted_reservations >= 0").count() == 63
    assert model_jobs.score_listings(listings.limit(0), model, version).count() == 0
    assert model_jobs.score_listings(listings, None, None).where("predicted_reservations is null").count() == 63
    torn = listings.withColumn("num_images", F.when(F.col("vehicle_id") > 5, F.col("num_images")))
    assert model_jobs.score_listings(torn, model, version).where("predicted_reservations is null").count() == 5
    scored, rejected = model_jobs.score_request(torn.drop("vehicle_id"), model, version)
    assert scored.where("predicted_reservations >= 0").count() == 58
    assert rows(rejected.select(F.concat_ws(",", "errors").alias("e")).distinct()) == [("num_images",)]
    served = model_jobs.served_importances(registry, "demand").first()
    assert served.version == 1 and set(served.importances) == set(LISTING_VIEW.feature_names)
    assert abs(sum(served.importances.values()) - 1) < 1e-3
    assert model_jobs.served_importances(registry, "other").collect() == []
    online = read_online(spark, f"{stores}/online")
    ids = spark.createDataFrame([(101,), (7,)], "vehicle_id long")
    scored, unknown = model_jobs.score_ids(ids, online, model, version)
    assert rows(scored, "vehicle_id") == [(101,)] and rows(unknown, "vehicle_id") == [(7,)]
    catalog = spark.createDataFrame([(101, None), (102, None), (999, None), (1, 4)], "vehicle_id long, num_reservations long")
    arrivals = model_jobs.score_new_arrivals(catalog, online, model, version)
    assert rows(arrivals, "vehicle_id") == [(101,), (102,)]
    assert registry.table("tags").count() == 4 and registry.table("params").count() == 6


def test_a_failed_announcement_does_not_undo_a_promotion(spark, stores, monkeypatch):
    registry = Registry(spark, f"{stores}/registry-2").create()
    model_jobs.train_candidate(spark, f"{stores}/offline", registry, "demand", {"trees": 2, "depth": 2}, folds=2)

    def broken(*args, **kwargs):
        raise OSError("channel is down")

    monkeypatch.setattr(model_jobs, "write_events", broken)
    model_jobs.promote_models(registry, "demand", events_path=f"{stores}/nowhere")
    assert registry.champion("demand")[0] == 1


def test_registering_an_unknown_version_is_refused(spark, stores):
    registry = Registry(spark, f"{stores}/registry-3").create()
    with pytest.raises(ValueError, match="name of its model"):
        model_jobs.promote_models(registry, version=3)


NEW = "request long, technology long, actual_price double, recommended_price double, num_images long, street_parked long, description long"


def test_save_delete_and_never_reuse_ids(spark, data_dir, monkeypatch):
    root = scratch_path(spark, "catalog")
    warehouse, events = f"{root}/w", f"{root}/saved"
    batch.load_tables(spark, data_dir, warehouse)
    new = spark.createDataFrame([(2, 1, 45.0, 50.0, 8, 0, 250), (1, 0, 30.0, 50.0, 2, 1, 50)], NEW)
    saved, announced = batch.save_listings(spark, warehouse, new, "request", events)
    assert announced and rows(saved, "vehicle_id", "actual_price", "source") == [(61, 30.0, "ui"), (62, 45.0, "ui")]
    told, bad = ev.read_events(spark.read.text(events), ev.SAVED_EVENT, ["vehicle_id"])
    assert rows(told, "vehicle_id", "recommended_price") == [(61, 50.0), (62, 50.0)] and bad.count() == 0

    ids = spark.createDataFrame([(62,), (5,), (999,)], "vehicle_id long")
    assert rows(batch.delete_listings(spark, warehouse, ids)) == [(5, "blocked"), (62, "deleted"), (999, "absent")]
    assert rows(batch.delete_listings(spark, warehouse, ids), "outcome") == [("absent",), ("absent",), ("blocked",)]
    left = batch.current_listings(spark, warehouse)
    assert left.count() == 61 and left.where("vehicle_id = 62").count() == 0

    def broken(*args, **kwargs):
        raise OSError("channel is down")

    monkeypatch.setattr(batch, "write_events", broken)
    again, announced = batch.save_listings(spark, warehouse, new.limit(1), "request", events)
    assert not announced and rows(again, "vehicle_id") == [(63,)]
    assert batch.current_listings(spark, warehouse).count() == 62
    batch.materialize(spark, warehouse, f"{root}/off", f"{root}/on")
    assert rows(read_online(spark, f"{root}/on"), "vehicle_id") == [(61,), (63,)]


def test_completion_event(spark):
    event = ev.to_events(batch.completion_event(spark, "materialize", "run-1", "success"), ["dag_id", "dag_run_id", "state"])
    assert event.first().value == '{"dag_id":"materialize","dag_run_id":"run-1","state":"success"}'


def test_command_line(spark, data_dir, capsys):
    args = parse_args(["promote", "--registry", "r", "--version", "3", "--metric", "m"])
    assert (args.version, args.metric, args.candidate_alias) == (3, "m", "candidate")
    with pytest.raises(SystemExit):
        parse_args(["train"])
    root = scratch_path(spark, "cli")
    main(["load", "--data-dir", data_dir, "--warehouse", f"{root}/w"])
    main(["materialize", "--warehouse", f"{root}/w", "--offline", f"{root}/off", "--online", f"{root}/on"])
    assert spark.read.parquet(f"{root}/off").count() == 60


def test_command_line_of_the_catalogue_and_the_streams(spark, data_dir, tmp_path, capsys):
    root = scratch_path(spark, "cli")
    main(["load", "--data-dir", data_dir, "--warehouse", f"{root}/w"])
    header = HEADER.removeprefix("vehicle_id,")
    (tmp_path / "new.csv").write_text(f"{header}\n1,40,50,3,1,20\n7,40,50,3,1,20\n0,41,50,3,1,20\n")
    save = ["save", "--warehouse", f"{root}/w", "--input", str(tmp_path / "new.csv"), "--rejects", f"{root}/rejects"]
    main(save)
    main(["deliver", "--warehouse", f"{root}/w", "--events", f"{root}/messages"])
    assert "saved 2 listings, not announced" in (said := capsys.readouterr().out) and "delivered 2 events" in said
    main(["stream-materialize", "--messages", f"{root}/messages/*", "--online", f"{root}/on", "--events", f"{root}/told",
          "--rejects", f"{root}/unread", "--checkpoint", f"{root}/c"])
    assert rows(read_online(spark, f"{root}/on"), "vehicle_id") == [(61,), (62,)]
    main(["merge", "--online", f"{root}/on", "--keep", "1"])
    assert rows(read_online(spark, f"{root}/on"), "vehicle_id") == [(61,), (62,)]
    main(["delete", "--warehouse", f"{root}/w", "61", "5"])
    assert "blocked" in capsys.readouterr().out
    main(["score", "--registry", f"{root}/none", "--input", str(tmp_path / "new.csv"), "--rejects", f"{root}/r", "--output", f"{root}/s"])
    assert spark.read.parquet(f"{root}/s").where("predicted_reservations is null").count() == 2
    assert spark.read.parquet(f"{root}/r").count() == 1
    told = spark.range(1).selectExpr("'m' as model_name", "'4' as version", "timestamp'2025-01-01' as at")
    ev.to_events(told, ["model_name", "version", "at"]).write.text(f"{root}/promoted")
    told.selectExpr("5L as vehicle_id", "timestamp'2025-01-02' as at", *[f"1.0 as {c}" for c in LISTING_VIEW.feature_names]).write.parquet(f"{root}/rows")
    main(["stream-score", "--rows", f"{root}/rows", "--promotions", f"{root}/promoted", "--registry", f"{root}/none",
          "--model-name", "m", "--output", f"{root}/scored", "--checkpoint", f"{root}/c2"])
    assert rows(spark.read.parquet(f"{root}/scored/rows"), "vehicle_id", "predicted_reservations") == [(5, None)]
