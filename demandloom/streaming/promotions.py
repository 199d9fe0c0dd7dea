"""Promotion events as a control stream: each row is scored by the version promoted last before it.

Rows and promotions come in one stream, so both are replayed from one checkpoint. The promotions of a
batch are committed under the batch's number before its rows are scored; a batch that runs again
replaces them and sees what it saw the first time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from demandloom.operators.features import null_guard
from demandloom.operators.models import score, without_model
from demandloom.operators.stores import asof_features
from demandloom.schemas import LISTING_VIEW
from demandloom.session import staged
from demandloom.sources.events import MODEL_RELOADED, PROMOTED_EVENT, decode, to_events, write_events
from demandloom.sources.registry import Registry
from demandloom.sources.snapshots import Store
from demandloom.streaming.jobs import start_query

AT = "at"
PROMOTIONS = "promotions"
#: A promotion holds until the next one.
FOREVER_DAYS = 365_000
CONTROL = T.StructType([*PROMOTED_EVENT.fields, T.StructField(AT, T.TimestampType())])
HISTORY = f"model_name string, {AT} timestamp, version string, batch long"

Scorer = Callable[[DataFrame, str], DataFrame]


def with_control(rows: DataFrame, promotions: DataFrame) -> DataFrame:
    """One stream of feature rows and promotion messages; `row` is null for a promotion.

    `rows` has a time column `at`; promotions are JSON messages in `value`, with a time `at` too.
    """
    mine = rows.select(AT, F.struct(*[c for c in rows.columns if c != AT]).alias("row"), F.lit(None).cast("string").alias("value"))
    kind = mine.schema["row"].dataType
    return mine.unionByName(
        promotions.select(F.lit(None).cast("timestamp").alias(AT), F.lit(None).cast(kind).alias("row"), "value")
    )


def versions_at(rows: DataFrame, history: DataFrame, model_name: str) -> DataFrame:
    """Rows with the version of the model that was promoted last at or before their time."""
    named = rows.withColumn("model_name", F.lit(model_name))
    known = history.select("model_name", AT, F.col("version").alias("model_version"), "batch")
    return asof_features(
        named, known, "model_name", AT, ["model_version"], FOREVER_DAYS, ["batch", "model_version"], "promoted_at"
    ).drop("model_name")


def score_by_promotions(
    stream: DataFrame,
    model_name: str,
    scorer: Scorer,
    out_path: str,
    checkpoint: str,
    events_path: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Score the rows of `with_control`, each by the version in force at its time.

    `scorer` gets the rows of one version and the version. Rows before the first promotion are written
    without a prediction. A batch uses the promotions that it and earlier ones brought: one that
    arrives after the rows it would have governed does not change them. With `events_path` every batch
    that brings promotions of the model tells which version is loaded now.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        store = Store(spark, f"{out_path}/_control")
        told = decode(batch.where(F.col("row").isNull()).select("value"), CONTROL).where(
            (F.col("model_name") == model_name) & F.col("version").isNotNull() & F.col(AT).isNotNull()
        )
        part = store.write(told.select("model_name", AT, "version", F.lit(number).cast("long").alias("batch")), PROMOTIONS, "stream", number)
        store.transact(lambda base: base.with_parts(part))
        history = store.read(PROMOTIONS, HISTORY).where(F.col("batch") <= number)
        rows = batch.where(F.col("row").isNotNull()).select(AT, "row.*")
        decided = staged(versions_at(rows, history, model_name), "decided")
        result = without_model(decided.where(F.col("model_version").isNull()).drop("model_version"))
        # As many versions as were promoted within the time of one batch.
        for found in decided.select("model_version").distinct().where("model_version is not null").collect():
            version = found["model_version"]
            mine = decided.where(F.col("model_version") == version).drop("model_version")
            result = result.unionByName(scorer(mine, version))
        result.write.mode("overwrite").parquet(f"{out_path}/rows/batch={number}")
        if events_path is not None and part.rows:
            newest = history.agg(F.max_by("version", F.struct(AT, "batch", "version")).alias("version"))
            write_events(to_events(newest, ["version"], MODEL_RELOADED), events_path, number)

    return start_query(stream.writeStream.foreachBatch(run), checkpoint, available_now)


def registered_scorer(registry: Registry, model_name: str) -> Scorer:
    """Scores by the models of a registry; each version is loaded once.

    Rows that lack a feature, and all rows of a version that is not registered, get no prediction.
    """
    loaded: dict[str, PipelineModel | None] = {}

    def run(rows: DataFrame, version: str) -> DataFrame:
        if version not in loaded:
            path = registry.path_of(model_name, int(version)) if version.isdigit() else None
            loaded[version] = PipelineModel.load(path) if path else None
        model = loaded[version]
        if model is None:
            return without_model(rows)
        complete, incomplete = null_guard(rows, LISTING_VIEW.feature_names)
        return score(complete, model, version).unionByName(without_model(incomplete))

    return run
