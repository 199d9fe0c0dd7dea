import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandloom.operators import models
from demandloom.registered import QUERIES

COLUMNS = ["a", "b", "noise"]


@pytest.fixture(scope="module")
def frame(spark):
    base = spark.range(400).select(
        F.col("id").alias("vehicle_id"),
        (F.col("id") % 7).cast("double").alias("a"),
        (F.col("id") % 3).cast("double").alias("b"),
        (F.xxhash64("id") % 100).cast("double").alias("noise"),
    )
    return base.withColumn("y", 3 * F.col("a") + F.col("b")).persist()


@pytest.fixture(scope="module")
def model(frame):
    return models.train(frame, COLUMNS, "y", models.forest(trees=5, depth=6))


def test_importances_are_shares(spark, frame, model):
    got = {r.feature: r.importance for r in models.feature_importance(model, COLUMNS, frame).collect()}
    assert set(got) == set(COLUMNS) and all(0 <= v <= 1 for v in got.values())
    assert math.isclose(sum(got.values()), 1.0, abs_tol=1e-9) and got["a"] > got["b"] > got["noise"]


def test_run_metrics_are_complete_and_finite(spark, frame):
    _, metrics = models.run_metrics(frame, COLUMNS, "y", models.forest(trees=3, depth=3), k=2)
    got = {r.name: r.value for r in metrics.collect()}
    expected = {"cv_mae_mean", "cv_mae_std", "train_mae", "train_rmse", "train_r2", "cv_mae_fold_1", "cv_mae_fold_2"}
    assert set(got) == expected | {f"importance_{c}" for c in COLUMNS}
    assert all(math.isfinite(v) for v in got.values())
    assert math.isclose(got["cv_mae_mean"], (got["cv_mae_fold_1"] + got["cv_mae_fold_2"]) / 2)


def test_every_row_is_held_out_once(spark, frame):
    folds = models.fold_table(frame, COLUMNS, "y", k=4)
    scored = models.scored_folds(folds, COLUMNS, "y", models.forest(trees=2, depth=3), k=4)
    assert scored.count() == 400 and scored.select("vehicle_id").distinct().count() == 400
    assert scored.groupBy("fold").count().where("count != 100").count() == 0


def test_same_seed_same_model(spark, frame, model):
    again = models.train(frame, COLUMNS, "y", models.forest(trees=5, depth=6))
    a = model.transform(frame).agg(F.sum("prediction")).first()[0]
    assert math.isclose(a, again.transform(frame).agg(F.sum("prediction")).first()[0])


def test_published_parameters_are_the_defaults():
    forest, boosting = models.forest(), models.boosting()
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getSeed()) == (200, 10, 42)
    assert (boosting.getMaxIter(), boosting.getMaxDepth(), boosting.getStepSize()) == (200, 5, 0.1)


def test_shuffling_an_informative_feature_costs_more(spark, frame, model):
    got = {r.feature: r for r in models.permutation_importance(model, frame, COLUMNS, "y", repeats=3).collect()}
    assert set(got) == set(COLUMNS)
    assert got["a"].importance_mean > got["b"].importance_mean > got["noise"].importance_mean - 1e-3
    assert all(r.importance_std >= 0 for r in got.values())


def test_ablation_reports_the_difference_to_the_first_set(spark, frame):
    sets = {"all": COLUMNS, "noise only": ["noise"]}
    got = {r["columns"]: r for r in models.feature_ablation(frame, sets, "y", models.forest(trees=3, depth=4), k=2).collect()}
    assert got["all"].difference == 0 and got["noise only"].difference > 0


def test_scores_are_rounded_and_carry_the_version(spark, frame, model):
    got = models.score(frame, model, "7")
    r = got.first()
    assert r.model_version == "7" and r.predicted_reservations == round(r.predicted_reservations, 2)
    assert "features" not in got.columns
    assert models.score(frame.limit(0), model, "7").count() == 0


def test_incomplete_rows_are_not_scored(spark, frame, model):
    holes = frame.withColumn("b", F.when(F.col("vehicle_id") >= 10, F.col("b")))
    scored, unknown = models.score_known(holes, COLUMNS, model, "1")
    assert (scored.count(), unknown.count()) == (390, 10)
    without = models.without_model(unknown)
    assert without.where("predicted_reservations is not null").count() == 0


def test_boosting_fits(spark, frame):
    model = models.train(frame, COLUMNS, "y", models.boosting(rounds=3, depth=3))
    assert model.transform(frame).where("prediction is null").count() == 0


class Stopped(Exception):
    pass


@pytest.mark.parametrize(
    "name",
    ["train_rf", "train_gbt", "cross_validate", "feature_importance", "permutation_importance", "feature_ablation",
     "score_batch", "score_by_id", "score_new_arrivals", "sink_registry"],
)
def test_registered_fits_use_the_published_parameters(spark, folder, monkeypatch, name):
    seen = []

    def stop(df, columns, y, estimator, k=models.FOLDS):
        seen.append((estimator, k))
        raise Stopped

    for step in ("train", "cross_validate", "feature_ablation", "run_metrics"):
        monkeypatch.setattr(models, step, stop)
    with pytest.raises(Stopped):
        QUERIES[name](spark, folder)
    (estimator, k), = seen
    size = estimator.getMaxIter() if name == "train_gbt" else estimator.getNumTrees()
    assert (size, estimator.getMaxDepth(), k) == (200, 5 if name == "train_gbt" else 10, 5)


def test_registered_permutations_use_the_published_repeats(spark, folder, monkeypatch):
    monkeypatch.setattr(models, "train", lambda *_: None)
    monkeypatch.setattr(models, "permutation_importance", lambda *_, repeats=models.PERMUTATION_REPEATS: repeats)
    assert QUERIES["permutation_importance"](spark, folder) == 10


def test_node_memory_fits_every_task_slot_and_keeps_the_trees(spark, frame):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    conf = spark.sparkContext.getConf()
    heap = models.size_mb(conf.get("spark.driver.memory", "1g"))
    slots = spark.sparkContext.defaultParallelism
    share = (heap - models.RESERVED_MB) * (1 - float(conf.get("spark.memory.fraction", "0.6"))) / slots
    fitted = models.train(frame, COLUMNS, "y", models.forest(trees=5, depth=6))
    assert fitted.stages[-1].getOrDefault("maxMemoryInMB") * 2 <= share
    whole = Pipeline(
        stages=[VectorAssembler(inputCols=COLUMNS, outputCol=models.FEATURES), models.forest(trees=5, depth=6).setLabelCol("y")]
    ).fit(frame)
    a = fitted.transform(frame).select("vehicle_id", "prediction").orderBy("vehicle_id").collect()
    b = whole.transform(frame).select("vehicle_id", "prediction").orderBy("vehicle_id").collect()
    assert a == b


def test_memory_settings_are_read_in_megabytes():
    assert [models.size_mb(t) for t in ("10g", "512m", "2048", "1gb")] == [10240, 512, 2048, 1024]


def test_node_memory_of_a_local_cluster_is_an_executor_slot_share():
    conf = {"spark.executor.memory": "1800m", "spark.driver.memory": "750m"}.get
    assert models.slot_share_mb("local-cluster[3,2,3000]", conf, 6, 1024) == 150
    assert models.slot_share_mb("local[6]", conf, 6, 1024) == 15
    assert models.slot_share_mb("spark://host:7077", {**{"spark.executor.cores": "4"}, "spark.executor.memory": "10g"}.get, 12, 1024) == 497



def test_large_forest_fits_are_dealt_to_all_slots_and_keep_their_trees(spark, frame, monkeypatch):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    monkeypatch.setattr(models, "SPREAD_LEAST", 10)
    slots = spark.sparkContext.defaultParallelism
    narrow = frame.coalesce(1)
    fitted = models.train(narrow, COLUMNS, "y", models.forest(trees=5, depth=6)).stages[-1]
    assert fitted.getOrDefault("cacheNodeIds")
    plain = Pipeline(
        stages=[VectorAssembler(inputCols=COLUMNS, outputCol="features"), models.forest(trees=5, depth=6).copy()]
    )
    plain.getStages()[-1].setLabelCol("y")
    same = plain.fit(narrow.select(*COLUMNS, "y").repartition(slots)).stages[-1]
    assert not same.getOrDefault("cacheNodeIds") and same.toDebugString.split("\n", 1)[1] == fitted.toDebugString.split("\n", 1)[1]


def test_fits_run_side_by_side_as_far_as_their_rows_fit():
    held = 1_000 * 200 * (models.DRAW_BYTES + models.NODE_BYTES)
    assert [models.fits_at_once(x * held, 1_000, 200, 5) for x in (0, 1, 3, 9)] == [1, 1, 3, 5]
    assert [models.fit_tasks(1_000, 6, n) for n in (1, 5, 6, 9)] == [6, 2, 1, 1]
    assert models.fit_tasks(4 * models.FIT_ROWS + 1, 2, 2) == 5


def test_storage_is_that_of_the_executors(spark):
    heap = models.size_mb(spark.sparkContext.getConf().get("spark.driver.memory", "1g")) * 2**20
    assert 0 < models.storage_bytes(spark) < heap


def test_metrics_predict_every_row_once(spark, frame, model):
    scored = model.transform(frame)
    for by in ([], ["b"]):
        plan = models.regression_metrics(scored, "y", "prediction", by)._jdf.queryExecution().executedPlan().toString()
        assert "UDF(" in plan and not [x for x in plan.split("\n") if "Filter" in x and "UDF(" in x]


def test_permutations_equal_scores_of_every_shuffled_row(spark, frame, model, monkeypatch):
    """With a feature of two values, whose values are scored once, and rows dealt out anew."""
    from demandloom.operators.ranges import dense_position, shuffled_position

    monkeypatch.setattr(models, "SPREAD_LEAST", 100)
    few = frame.withColumn("b", F.when(F.col("b") > F.lit(0), 1.0).otherwise(-0.0))
    scored = []
    predict = type(model.stages[-1]).transform
    monkeypatch.setattr(type(model.stages[-1]), "transform", lambda m, df: scored.append(df) or predict(m, df))
    got = {r.feature: r for r in models.permutation_importance(model, few, COLUMNS, "y", repeats=4).collect()}
    n = few.count()
    assert n < scored[-1].count() <= n * (1 + 4 * (len(COLUMNS) - 1) + 1)
    rows = dense_position(few.select("vehicle_id", "y", *COLUMNS), "vehicle_id", "pos").collect()
    y = np.array([r.y for r in rows])
    total = ((y - y.mean()) ** 2).sum()

    def r2(values):
        made = spark.createDataFrame([(int(k), *map(float, v)) for k, v in enumerate(values)], ["k", *COLUMNS])
        found = {r.k: r.prediction for r in model.transform(made).collect()}
        return 1 - ((y - np.array([found[k] for k in range(len(values))])) ** 2).sum() / total

    own = np.array([[r[c] for c in COLUMNS] for r in rows], float)
    for i, c in enumerate(COLUMNS):
        drops = []
        for r in range(4):
            donor = shuffled_position(few.select("vehicle_id", c), "vehicle_id", 42 + r, "pos").orderBy("pos").collect()
            values = own.copy()
            values[np.argsort([x.pos for x in rows]), i] = [x[c] for x in donor]
            drops.append(r2(own) - r2(values))
        assert np.allclose([got[c].importance_mean, got[c].importance_std], [np.mean(drops), np.std(drops)])
