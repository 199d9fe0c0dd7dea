"""The listing tables as views of a star schema: parts are listings, events bookings, latencies and
messages, customers model versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.functions import price_diff_of, price_ratio_of
from demandloom.operators.features import feature_build, left_join_counts
from demandloom.operators.ranges import dense_position
from demandloom.schemas import LISTING_VIEW

STAMP = "2001-12-01 00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def as_listings(part: DataFrame) -> DataFrame:
    """Prices are computed in whole cents, so every engine gets the same doubles."""
    cents = F.floor(F.col("p_retailprice") * (75 + F.col("p_size")) + 0.5)
    return part.select(
        F.col("p_partkey").alias("vehicle_id"),
        F.when(F.col("p_type") == "PROMO", 1).otherwise(0).cast("long").alias("technology"),
        (cents / 100).alias("actual_price"),
        F.col("p_retailprice").alias("recommended_price"),
        (F.col("p_size") % 18).cast("long").alias("num_images"),
        (F.col("p_partkey") % 2).cast("long").alias("street_parked"),
        ((F.col("p_partkey") * 37) % 401).cast("long").alias("description"),
        F.when(F.col("p_partkey") % 10 == 0, "ui").otherwise("csv").alias("source"),
    )


def listings(spark: SparkSession, folder: str) -> DataFrame:
    return as_listings(table(spark, folder, "part"))


def bookings(spark: SparkSession, folder: str) -> DataFrame:
    """All events as bookings of the listing their user number names; most listings have none."""
    events = table(spark, folder, "events")
    return events.select(F.col("user_id").alias("vehicle_id"), F.col("ts").alias("created_at"))


def features(spark: SparkSession, folder: str) -> DataFrame:
    return feature_build(listings(spark, folder), bookings(spark, folder), as_of=STAMP)


def offline(spark: SparkSession, folder: str) -> DataFrame:
    rows = features(spark, folder)
    return rows.where(F.col(LISTING_VIEW.label).isNotNull())


def online(spark: SparkSession, folder: str) -> DataFrame:
    """Arrivals with enough photos have been materialized; the others are still pending."""
    rows = features(spark, folder)
    return rows.where(F.col(LISTING_VIEW.label).isNull() & (F.col("num_images") >= 3))


def explored(spark: SparkSession, folder: str) -> DataFrame:
    """Listings with counts, every missing count read as zero, and both price gaps."""
    counted = left_join_counts(listings(spark, folder), bookings(spark, folder), "vehicle_id")
    return counted.withColumns(
        {
            "num_reservations": F.coalesce("num_reservations", F.lit(0)),
            "price_diff": price_diff_of("actual_price", "recommended_price"),
            "price_ratio": price_ratio_of("actual_price", "recommended_price"),
        }
    )


def latencies(spark: SparkSession, folder: str) -> DataFrame:
    """Timings of the two request paths, and both timings of every event, its type being the source.

    A path's n-th feature sample meets its n-th predict sample; where one list is longer, its rest stays
    without a partner.
    """
    events = table(spark, folder, "events")
    single = events.select(
        F.col("event_type").alias("source"),
        F.col("event_id").alias("iteration"),
        F.col("value").alias("feature_ms"),
        F.get_json_object("props", "$.k").cast("double").alias("predict_ms"),
    )
    kinds = ["click", "view", "purchase", "signup"]
    samples = events.where(F.col("event_type").isin(kinds)).select("event_id", "event_type", "value")
    ties = [F.col("value").asc_nulls_last()]
    numbered = dense_position(samples, "event_id", "iteration", by=["event_type"], ties=ties)

    def sample(kind: str) -> list[Column]:
        held = F.col("event_type") == kind
        return [F.max(F.when(held, F.col("value"))).alias(kind), F.count_if(held).alias(f"has_{kind}")]

    def timing(source: str, feature: str, predict: str) -> Column:
        return F.struct(
            F.lit(source).alias("source"),
            F.col(feature).alias("feature_ms"),
            F.col(predict).alias("predict_ms"),
            (F.col(f"has_{feature}") + F.col(f"has_{predict}") > 0).alias("held"),
        )

    wide = numbered.groupBy("iteration").agg(*[c for kind in kinds for c in sample(kind)])
    pairs = F.array(timing("raw", "click", "view"), timing("online_store", "purchase", "signup"))
    paired = wide.select("iteration", F.inline(pairs)).where("held").drop("held")
    return single.unionByName(paired)


def _model() -> Column:
    """Customers of one nation and market segment are the versions of one model."""
    return F.concat_ws("_", F.lit("model"), "c_nationkey", F.lower("c_mktsegment"))


def _moment() -> Column:
    return F.timestamp_seconds(F.lit(1_000_000_000) + F.col("c_custkey"))


def versions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        _model().alias("model_name"),
        F.col("c_custkey").alias("version"),
        F.concat(F.lit("run_"), F.col("c_custkey")).alias("run_id"),
        F.concat(F.lit("models/run_"), F.col("c_custkey")).alias("model_path"),
        _moment().alias("created_at"),
    )


def aliases(spark: SparkSession, folder: str) -> DataFrame:
    """Every version was the candidate once. Automobile models never had a champion, every building
    version became one, and of the others those with a high error or without one did."""
    customer = table(spark, folder, "customer")
    segment = F.col("c_mktsegment")
    outlying = (F.col("c_acctbal") < 1000) | (F.col("c_acctbal") > 7000)
    was_champion = (segment != "AUTOMOBILE") & ((segment == "BUILDING") | outlying)

    def assigned(rows: DataFrame, alias: str) -> DataFrame:
        return rows.select(
            _model().alias("model_name"),
            F.lit(alias).alias("alias"),
            F.col("c_custkey").alias("version"),
            _moment().alias("assigned_at"),
        )

    return assigned(customer, "candidate").unionByName(assigned(customer.where(was_champion), "champion"))


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Balances as errors; accounts below 1000 have no comparison metric."""
    customer = table(spark, folder, "customer").select(
        F.concat(F.lit("run_"), F.col("c_custkey")).alias("run_id"), "c_acctbal"
    )
    compared = customer.where(F.col("c_acctbal") >= 1000).select(
        "run_id", F.lit("cv_mae_mean").alias("name"), F.col("c_acctbal").alias("value")
    )
    fitted = customer.select(
        "run_id", F.lit("train_mae").alias("name"), (F.col("c_acctbal") / 8).alias("value")
    )
    return compared.unionByName(fitted)


def params(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer")
    pairs = [
        F.struct(F.lit(name).alias("name"), F.col(column).cast("string").alias("value"))
        for name, column in (("segment", "c_mktsegment"), ("account", "c_name"), ("nation", "c_nationkey"))
    ]
    return customer.select(
        F.concat(F.lit("run_"), F.col("c_custkey")).alias("run_id"), F.inline(F.array(*pairs))
    )


def runs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.concat(F.lit("run_"), F.col("c_custkey")).alias("run_id"), _moment().alias("started_at")
    )
