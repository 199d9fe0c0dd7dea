"""Feature building over an entity table and its fact table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.functions import (
    batch_time,
    description_band,
    photo_band,
    price_band,
    price_diff_of,
    price_ratio_of,
    zero_filled,
)
from demandloom.schemas import FeatureView

# Rows of this source have a complete history, so "no bookings" is a real zero.
OBSERVED_SOURCES = ("csv",)
# Fixed value: rows a client may send for scoring in one request.
REQUEST_LIMIT = 1000


def count_per_key(facts: DataFrame, key: str, out: str = "n") -> DataFrame:
    """Rows per key; counted before the shuffle, so a dominant key costs one row per task."""
    return (
        facts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(out))
    )


def left_join_counts(
    entities: DataFrame, facts: DataFrame, key: str, out: str = "num_reservations"
) -> DataFrame:
    """Every entity with its fact count, NULL when it has none; orphan facts fall away."""
    return entities.join(count_per_key(facts, key, out), key, "left")


def conditional_zero_fill(
    df: DataFrame, column: str, source: str, observed: Sequence[str] = OBSERVED_SOURCES
) -> DataFrame:
    return df.withColumn(column, zero_filled(column, source, observed))


def price_diff(
    df: DataFrame,
    actual: str = "actual_price",
    recommended: str = "recommended_price",
    out: str = "price_diff",
) -> DataFrame:
    return df.withColumn(out, price_diff_of(actual, recommended))


def price_ratio(
    df: DataFrame,
    actual: str = "actual_price",
    recommended: str = "recommended_price",
    out: str = "price_ratio",
) -> DataFrame:
    return df.withColumn(out, price_ratio_of(actual, recommended))


def feature_build(
    entities: DataFrame,
    facts: DataFrame,
    key: str = "vehicle_id",
    actual: str = "actual_price",
    recommended: str = "recommended_price",
    source: str = "source",
    label: str = "num_reservations",
    stamp: str = "event_timestamp",
    observed_sources: Sequence[str] = OBSERVED_SOURCES,
    as_of: datetime | str | Column | None = None,
) -> DataFrame:
    """Stored feature rows: three-valued label, price gap, batch time; raw prices dropped."""
    counted = left_join_counts(entities, facts, key, label)
    filled = conditional_zero_fill(counted, label, source, observed_sources)
    return (
        price_diff(filled, actual, recommended)
        .drop(actual, recommended, source)
        .withColumn(stamp, batch_time(as_of))
    )


def fleet_rows(df: DataFrame, label: str = "num_reservations") -> DataFrame:
    """Rows with an observed outcome."""
    return df.where(F.col(label).isNotNull())


def new_arrivals(df: DataFrame, label: str = "num_reservations") -> DataFrame:
    """Rows whose outcome is not observed yet."""
    return df.where(F.col(label).isNull())


def positive_only(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column) > 0)


def feature_select(
    df: DataFrame, view: FeatureView, refs: Sequence[str] | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """The referenced columns in reference order; the label is not allowed among them."""
    names = view.columns_of(view.feature_refs if refs is None else refs)
    if view.label in names:
        raise ValueError(f"label {view.label!r} cannot be a feature")
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns {missing}")
    return df.select(*keep, *names)


def coerce_types(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of `schema`, cast to its types; columns not there become NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def annotate_errors(df: DataFrame, rules: Mapping[str, Column], out: str = "errors") -> DataFrame:
    """Names of the rules a row breaks; a NULL operand breaks its rule."""
    failed = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn(out, F.filter(F.array(*failed), lambda name: name.isNotNull()))


def validate_rows(
    df: DataFrame, rules: Mapping[str, Column], out: str = "errors"
) -> tuple[DataFrame, DataFrame]:
    """Rows that keep every rule, and the others with the names of the rules they break."""
    checked = annotate_errors(df, rules, out)
    return checked.where(F.size(out) == 0).drop(out), checked.where(F.size(out) > 0)


def null_guard(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that can be scored, and rows with any of the columns missing."""
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    return df.where(complete), df.where(~complete)


def batch_limit_guard(
    requests: DataFrame, rows: DataFrame, key: str, limit: int = REQUEST_LIMIT
) -> DataFrame:
    """Size of every scoring request and the answer a client with a row limit would get.

    A report only: scoring itself takes any number of rows and gives no rows for none.
    """
    size = F.col("size")
    answer = F.when(size == 0, "empty").when(size <= limit, "accepted").otherwise("too large")
    sized = left_join_counts(requests, rows, key, "size").withColumn("size", F.coalesce("size", F.lit(0)))
    return sized.withColumn("answer", answer)


def add_missing_column(df: DataFrame, column: str, default: object) -> DataFrame:
    """Add a column an older table lacks; NULLs of merged schemas take the default too."""
    if column not in df.columns:
        return df.withColumn(column, F.lit(default))
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(default)))


def listing_bands(
    df: DataFrame,
    actual: str = "actual_price",
    recommended: str = "recommended_price",
    photos: str = "num_images",
    description: str = "description",
) -> DataFrame:
    """Words for price competitiveness, photo count and description length."""
    return df.withColumns(
        {
            "price_band": price_band(price_ratio_of(actual, recommended)),
            "photo_band": photo_band(photos),
            "description_band": description_band(description),
        }
    )


def round_outputs(df: DataFrame, digits: Mapping[str, int]) -> DataFrame:
    """Half-up rounding of the named columns."""
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})
