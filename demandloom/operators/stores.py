"""Offline and online feature stores: lookup, resolution, upsert, life time, as-of rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandloom.functions import batch_time, micros_of
from demandloom.operators.ranges import with_ranges
from demandloom.schemas import LISTING_VIEW

# A key with fewer rows is left to one task.
DOMINANT_ROWS = 1_000_000


def latest_per_key(df: DataFrame, key: str | Sequence[str], *newest: str) -> DataFrame:
    """The newest row of every key, by the given columns in turn.

    The rank filter runs in every input task before the shuffle, so a dominant key sends one row
    per task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rank = F.row_number().over(
        W.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in newest])
    )
    return df.withColumn("__rank", rank).where(F.col("__rank") == 1).drop("__rank")


def upsert_latest(current: DataFrame, incoming: DataFrame, key: str, ts: str) -> DataFrame:
    """Store contents after a write: the newer stamp wins per key, the incoming row on a tie."""
    both = current.withColumn("__wave", F.lit(0)).unionByName(
        incoming.select(*current.columns).withColumn("__wave", F.lit(1))
    )
    return latest_per_key(both, key, ts, "__wave").drop("__wave")


def offline_lookup(offline: DataFrame, ids: DataFrame, key: str = "vehicle_id") -> DataFrame:
    """Stored rows of the requested ids; unknown ids are absent."""
    return offline.join(ids.select(key), key, "left_semi")


def online_lookup(online: DataFrame, ids: DataFrame, key: str = "vehicle_id") -> DataFrame:
    """One row per requested id, features NULL for an unknown id."""
    return ids.select(key).join(online, key, "left")


def missing_ids(ids: DataFrame, offline: DataFrame, key: str = "vehicle_id") -> DataFrame:
    """Requested ids the offline store does not hold."""
    return ids.select(key).join(offline.select(key), key, "left_anti")


def resolve_features(
    ids: DataFrame,
    offline: DataFrame,
    online: DataFrame | None,
    key: str = "vehicle_id",
    features: Sequence[str] = tuple(LISTING_VIEW.feature_names),
    newest: str | None = "event_timestamp",
    drop_unresolved: bool = False,
) -> DataFrame:
    """One row per distinct id: its features from the offline store first, then the online store.

    `store` says where a row came from (`offline`, `online`, `none`). An online row without its first
    feature counts as unknown. `online=None` is the degraded mode without an online store; with
    `drop_unresolved` ids found nowhere are left out instead of returned with NULL features.
    """
    features = list(features)

    def side(store: DataFrame, name: str) -> DataFrame:
        # Rows of equal stamp are told apart by their values, not by chance.
        rows = latest_per_key(store, key, newest, *features) if newest else store
        return rows.select(key, F.struct(*features).alias(name))

    # Repeated ids go first: this shuffle is the one the joins need, and none of them meets a hot id.
    found = ids.select(key).distinct().join(side(offline, "__off"), key, "left")
    if online is None:
        found = found.withColumn("__on", F.lit(None).cast(found.schema["__off"].dataType))
    else:
        found = found.join(side(online, "__on"), key, "left")
    on_hit = F.col(f"__on.{features[0]}").isNotNull()
    store = F.when(F.col("__off").isNotNull(), "offline").when(on_hit, "online").otherwise("none")
    resolved = found.withColumn("store", store)
    values = [
        F.when(F.col("store") == "offline", F.col(f"__off.{f}"))
        .when(F.col("store") == "online", F.col(f"__on.{f}"))
        .alias(f)
        for f in features
    ]
    rows = resolved.select(
        key, *values, (F.col("store") != "none").alias("materialized"), "store"
    )
    return rows.where("materialized") if drop_unresolved else rows


def union_stores(offline: DataFrame, online: DataFrame, key: str = "vehicle_id") -> DataFrame:
    """All offline rows, and online rows of the ids the offline store lacks."""
    rest = online.join(offline.select(key), key, "left_anti")
    return offline.withColumn("store", F.lit("offline")).unionByName(
        rest.withColumn("store", F.lit("online"))
    )


def store_coverage(resolved: DataFrame) -> DataFrame:
    """Counts of offline and online rows, and of those still pending."""
    return resolved.agg(
        F.count_if(F.col("store") == "offline").alias("offline"),
        F.count_if(F.col("store") == "online").alias("online"),
        (F.count(F.lit(1)) - F.count_if(F.col("materialized"))).alias("pending"),
        F.count(F.lit(1)).alias("total"),
    )


def online_ttl(
    df: DataFrame,
    ts: str = "event_timestamp",
    days: int = LISTING_VIEW.ttl_days,
    now: datetime | str | Column | None = None,
) -> DataFrame:
    """Rows younger than their declared life time."""
    return df.where(F.col(ts) > batch_time(now) - F.make_dt_interval(days=F.lit(days)))


def purge_online(online: DataFrame, entities: DataFrame, key: str = "vehicle_id") -> DataFrame:
    """Online rows whose entity still exists."""
    return online.join(entities.select(key), key, "left_semi")


def dominant_keys(sides: Sequence[DataFrame], key: str, at_least: int | None = None) -> list:
    """Keys that hold so many rows of both sides together that one task should not take them whole.

    The bar is a quarter of an even share per shuffle task, so there are at most four such keys per
    task, and `at_least` rows, a million when not given.
    """
    spark = sides[0].sparkSession
    keys = reduce(DataFrame.unionByName, [side.select(key) for side in sides])
    counted = keys.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    size = counted.agg(F.max("n").alias("largest"), F.sum("n").alias("rows")).first()
    share = (size["rows"] or 0) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    at_least = max(DOMINANT_ROWS if at_least is None else at_least, share)
    if (size["largest"] or 0) < at_least:
        return []
    return [r[key] for r in counted.where(F.col("n") >= at_least).collect()]


def asof_features(
    labels: DataFrame,
    history: DataFrame,
    key: str,
    ts: str,
    features: Sequence[str],
    ttl_days: int = LISTING_VIEW.ttl_days,
    newest: Sequence[str] = (),
    feature_ts: str = "feature_ts",
    dominant_rows: int | None = None,
) -> DataFrame:
    """Label rows with the latest feature row at or before their time, within the life time.

    Keys of ordinary size take one shuffle and one window. Dominant keys are cut up by time, see
    `_asof_over_ranges`. A NULL feature of the newest row stays NULL. `newest` orders feature rows of
    the same key and time; their values do when it is not given.
    """
    features = list(features)
    taken = sorted({*features, feature_ts} & set(labels.columns))
    if taken:
        raise ValueError(f"labels already have columns {taken}")
    placed = F.col(key).isNotNull() & F.col(ts).isNotNull()
    known = history.where(placed)
    row = F.struct(F.col(ts).alias("__fts"), *features)
    stored = known.select(key, ts, row.alias("__row"), F.struct(*(newest or features)).alias("__tie"))
    asked = labels.where(placed)
    hot = dominant_keys([asked, stored], key, dominant_rows)
    usual = ~F.col(key).isin(hot) if hot else F.lit(True)
    parts = [_asof_within_key(asked.where(usual), stored.where(usual), key, ts)]
    if hot:
        parts.append(_asof_over_ranges(asked.where(~usual), stored.where(~usual), key, ts))
    parts.append(labels.where(~placed).withColumn("__hit", _nothing(stored, "__row")))
    alive = F.col("__hit.__fts") > F.col(ts) - F.make_dt_interval(days=F.lit(ttl_days))
    return (
        reduce(DataFrame.unionByName, parts)
        .withColumn("__hit", F.when(alive, F.col("__hit")))
        .withColumn(feature_ts, F.col("__hit.__fts"))
        .withColumns({f: F.col(f"__hit.{f}") for f in features})
        .drop("__hit")
    )


def _nothing(df: DataFrame, column: str) -> Column:
    return F.lit(None).cast(df.schema[column].dataType)


def _asof_within_key(labels: DataFrame, stored: DataFrame, key: str, ts: str) -> DataFrame:
    """Labels and feature rows of a key in one window by time, feature rows first."""
    label = F.struct(*labels.columns)
    asked = labels.select(key, ts, label.alias("__label"))
    merged = stored.unionByName(asked, allowMissingColumns=True)
    upto = (
        W.partitionBy(key)
        .orderBy(ts, F.col("__label").isNotNull(), "__tie")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    answered = merged.withColumn("__hit", F.last("__row", ignorenulls=True).over(upto))
    return answered.where(F.col("__label").isNotNull()).select("__label.*", "__hit")


def _asof_over_ranges(labels: DataFrame, stored: DataFrame, key: str, ts: str) -> DataFrame:
    """The same for keys too large for one task.

    Time is cut into ranges of about equal row counts. What a range needs from earlier ones is one row
    per key: the newest feature row before it, carried over from the range summaries. Labels and
    feature rows of one key and time are folded into one instant first, so ties cannot pile up either.
    """
    both = stored.withColumn("__asked", F.lit(0)).unionByName(
        labels.select(key, ts, F.lit(1).alias("__asked")), allowMissingColumns=True
    )
    placed = both.withColumn("__at", micros_of(ts, both.schema[ts].dataType))
    instants = (
        with_ranges(placed, ["__at"], ["__range"])
        .groupBy(key, "__range", "__at", ts)
        .agg(F.max_by("__row", "__tie").alias("__row"), F.max("__asked").alias("__asked"))
    )
    summary = instants.groupBy(key, "__range").agg(
        F.max_by("__row", F.when(F.col("__row").isNotNull(), F.col("__at"))).alias("__last"),
        F.min("__at").alias("__at"),
    )
    earlier = W.partitionBy(key).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    carried = summary.select(
        key,
        "__range",
        "__at",
        F.last("__last", ignorenulls=True).over(earlier).alias("__row"),
        F.lit(-1).alias("__asked"),
    )
    upto = (
        W.partitionBy(key, "__range")
        .orderBy("__at", "__asked")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    answered = (
        instants.unionByName(carried, allowMissingColumns=True)
        .withColumn("__hit", F.last("__row", ignorenulls=True).over(upto))
        .where(F.col("__asked") == 1)
        .select(key, ts, "__hit")
    )
    return labels.join(answered, [key, ts], "left")
