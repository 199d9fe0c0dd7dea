"""Catalogue operators: listing, search, insert, delete, display view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandloom.functions import number_text, zero_filled
from demandloom.operators.features import OBSERVED_SOURCES, count_per_key
from demandloom.operators.ranges import dense_position

# Rows of this source may be deleted; a result page shows this many rows.
DELETABLE_SOURCES = ("ui",)
PAGE_SIZE = 50


def list_entities(
    entities: DataFrame,
    facts: DataFrame | None = None,
    key: str = "vehicle_id",
    source: str = "source",
    label: str = "num_reservations",
    observed_sources: Sequence[str] = OBSERVED_SOURCES,
) -> DataFrame:
    """The catalogue with counts in key order; without a fact table nothing has been counted."""
    if facts is None:
        counted = entities.withColumn(label, F.lit(None).cast("long"))
    else:
        counted = entities.join(count_per_key(facts, key, label), key, "left")
    return counted.withColumn(label, zero_filled(label, source, observed_sources)).orderBy(key)


def order_by_key(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(key)


def head(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first n rows in key order."""
    return df.orderBy(key).limit(n)


def search_filter(
    df: DataFrame, query: str | None, key: str = "vehicle_id", price: str = "actual_price"
) -> DataFrame:
    """Rows whose id text or price text contains the query; an empty query keeps all."""
    if not query:
        return df
    text = F.lit(query.lower())
    return df.where(
        F.contains(F.col(key).cast("string"), text) | F.contains(number_text(price), text)
    )


def split_and_limit(
    df: DataFrame, label: str = "num_reservations", key: str = "vehicle_id", n: int = PAGE_SIZE
) -> DataFrame:
    """First n observed and first n unobserved rows in key order, with the size of each side.

    The rank filter is applied to every input task first, so each sends on at most n rows per side.
    """
    sided = df.withColumn("side", F.when(F.col(label).isNull(), "arrivals").otherwise("fleet"))
    totals = sided.groupBy("side").agg(F.count(F.lit(1)).alias("total"))
    rank = F.row_number().over(W.partitionBy("side").orderBy(key))
    return sided.withColumn("rank", rank).where(F.col("rank") <= n).join(totals, "side")


def with_fresh_ids(
    existing: DataFrame,
    new: DataFrame,
    key: str,
    order: str,
    source: str = "source",
    source_value: str = "ui",
    high_water: int = 0,
) -> DataFrame:
    """New rows in the shape of the table, under ids above every id used so far, by `order`."""
    used = existing.agg(F.greatest(F.max(key), F.lit(high_water)).alias("used"))
    first = F.coalesce(used.scalar(), F.lit(high_water)) + 1
    return with_ids_from(new, first, key, order, existing.columns, source, source_value)


def with_ids_from(
    new: DataFrame,
    first: int | Column,
    key: str,
    order: str,
    columns: Sequence[str],
    source: str = "source",
    source_value: str = "ui",
) -> DataFrame:
    """New rows with the ids from `first` on, by `order`."""
    numbered = dense_position(new, order, "__pos")
    fresh = numbered.withColumn(key, F.col("__pos") + first)
    return fresh.withColumn(source, F.lit(source_value)).select(*columns)


def insert_with_id(
    existing: DataFrame,
    new: DataFrame,
    key: str,
    order: str,
    source: str = "source",
    source_value: str = "ui",
    high_water: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Append rows under fresh ids, in the order of `order`.

    Returns the whole table and a one-row frame with the id to hand back as `high_water` next time,
    which keeps ids of deleted rows from being given out again.
    """
    merged = existing.unionByName(
        with_fresh_ids(existing, new, key, order, source, source_value, high_water)
    )
    return merged, merged.agg(F.greatest(F.max(key), F.lit(high_water)).alias("high_water"))


def delete_new_arrival(
    df: DataFrame,
    ids: DataFrame,
    key: str = "vehicle_id",
    source: str = "source",
    deletable: Sequence[str] = DELETABLE_SOURCES,
) -> tuple[DataFrame, DataFrame]:
    """Delete the requested rows that came from a deletable source.

    The report has one row per requested id: `deleted`, `blocked` (other source) or `absent`.
    """
    state = df.select(key, source).withColumn("__found", F.lit(True))
    outcome = F.when(F.col("__found").isNull(), "absent").otherwise(
        F.when(F.col(source).isin(*deletable), "deleted").otherwise("blocked")
    )
    report = (
        ids.select(key).distinct().join(state, key, "left").select(key, outcome.alias("outcome"))
    )
    gone = ids.select(key).distinct()
    removable = F.coalesce(F.col(source).isin(*deletable), F.lit(False))
    marked = df.join(gone.withColumn("__asked", F.lit(True)), key, "left")
    kept = marked.where(F.col("__asked").isNull() | ~removable).drop("__asked")
    return kept, report


def catalog_view(
    entities: DataFrame, resolved: DataFrame, predictions: DataFrame, key: str = "vehicle_id"
) -> DataFrame:
    """Entities with the store their features are in and their latest prediction."""
    status = (
        F.when(F.col("store") == "online", "Online Store")
        .when(F.col("store") == "offline", "Offline Store")
        .otherwise("Pending")
    )
    can_score = F.coalesce(F.col("materialized"), F.lit(False))
    return (
        entities.join(resolved.select(key, "store", "materialized"), key, "left")
        .join(predictions, key, "left")
        .withColumn("status", status)
        .withColumn("can_score", can_score)
        .drop("store", "materialized")
    )


def first_materialized(entities: DataFrame, resolved: DataFrame, key: str = "vehicle_id") -> DataFrame:
    """The first entity in key order whose features are in a store; one row, NULL when none is."""
    ready = resolved.where("materialized").select(key)
    return entities.join(ready, key, "left_semi").agg(F.min(key).alias(key))
