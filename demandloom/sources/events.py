"""JSON event messages: decode with a reject side, encode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.schemas import LISTING_CSV

BROKEN = "__broken"
#: Where a streamed message stood: time, source and position; orders the messages of a micro-batch.
PLACE = "place"

# Payload fields and type labels of the event channels.
SAVED_EVENT = LISTING_CSV
MATERIALIZED_EVENT = T.StructType([T.StructField("vehicle_id", T.LongType())])
PROMOTED_EVENT = T.StructType(
    [T.StructField("model_name", T.StringType()), T.StructField("version", T.StringType())]
)
LOADED_EVENT = T.StructType(
    [T.StructField("type", T.StringType()), T.StructField("version", T.StringType())]
)
COMPLETED_EVENT = T.StructType(
    [
        T.StructField("dag_id", T.StringType()),
        T.StructField("dag_run_id", T.StringType()),
        T.StructField("state", T.StringType()),
    ]
)
VEHICLE_MATERIALIZED = "vehicle-materialized"
PIPELINE_COMPLETED = "pipeline-completed"
HEALTH_CHANGED = "health-changed"
MODEL_RELOADED = "model-reloaded"


def stream_messages(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Text lines of a growing folder as a stream with one `value` per message."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    place = F.struct(
        F.col("_metadata.file_modification_time").alias("at"),
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    return reader.load(path).select("value", place.alias(PLACE))


def stream_topic(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Messages of a Kafka topic; `options` are those of Spark's Kafka source, which brings its own jar."""
    stream = spark.readStream.format("kafka").options(**options).load()
    place = F.struct(
        F.col("timestamp").alias("at"), F.col("partition").cast("string").alias("source"), F.col("offset").alias("block")
    )
    return stream.select(F.col("value").cast("string"), place.alias(PLACE))


def decode(messages: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """Payload fields beside the raw message; `__broken` holds text that does not fit the schema."""
    with_broken = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    parsed = F.from_json(
        value, with_broken, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}
    )
    return messages.withColumn("__payload", parsed).select(*messages.columns, "__payload.*")


def is_usable(required: Sequence[str]) -> Column:
    """A decoded message with all required fields present."""
    ok = F.col(BROKEN).isNull()
    for c in required:
        ok = ok & F.col(c).isNotNull()
    return ok


def read_events(
    messages: DataFrame, schema: T.StructType, required: Sequence[str] = (), value: str = "value"
) -> tuple[DataFrame, DataFrame]:
    """Decoded messages, and the raw text of those that cannot be used."""
    decoded = decode(messages, schema, value)
    usable = is_usable(required)
    return decoded.where(usable).drop(BROKEN), decoded.where(~usable).select(*messages.columns)


def to_events(df: DataFrame, columns: Sequence[str], kind: str | None = None) -> DataFrame:
    """One JSON message per row, with a `type` field first when a kind is given."""
    fields = [F.lit(kind).alias("type")] if kind else []
    return df.select(F.to_json(F.struct(*fields, *columns)).alias("value"))


def write_events(events: DataFrame, path: str, batch: int) -> None:
    """One folder of text lines per batch, replaced as a whole when the batch runs again."""
    events.write.mode("overwrite").text(f"{path}/batch={batch}")
