"""Table schemas, the feature view and the row rules of the listing data set."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class FeatureView:
    """Declared shape of a feature row: key, ordered features, label, stamp and life time."""

    name: str
    entity: str
    key: str
    features: tuple[tuple[str, T.DataType], ...]
    label: str
    timestamp: str
    ttl_days: int

    @property
    def feature_names(self) -> list[str]:
        return [name for name, _ in self.features]

    @property
    def feature_refs(self) -> list[str]:
        return [f"{self.name}:{name}" for name in self.feature_names]

    @property
    def label_ref(self) -> str:
        return f"{self.name}:{self.label}"

    @property
    def schema(self) -> T.StructType:
        """Schema of a stored row, key first, label and stamp last."""
        fields = [T.StructField(self.key, T.LongType())]
        fields += [T.StructField(name, dtype) for name, dtype in self.features]
        fields.append(T.StructField(self.label, T.LongType()))
        fields.append(T.StructField(self.timestamp, T.TimestampType()))
        return T.StructType(fields)

    def columns_of(self, refs: Sequence[str]) -> list[str]:
        """Column names behind `view:column` references, in the given order."""
        known = set(self.feature_names) | {self.label}
        names = []
        for ref in refs:
            view, _, column = ref.partition(":")
            if view != self.name or column not in known:
                raise ValueError(f"unknown feature reference {ref!r}")
            names.append(column)
        return names


# Names and types of the stored listing features, in model input order.
LISTING_VIEW = FeatureView(
    name="vehicle_features",
    entity="vehicle",
    key="vehicle_id",
    features=(
        ("technology", T.LongType()),
        ("num_images", T.LongType()),
        ("street_parked", T.LongType()),
        ("description", T.LongType()),
        ("price_diff", T.DoubleType()),
    ),
    label="num_reservations",
    timestamp="event_timestamp",
    ttl_days=365,
)

# Column names of the two input tables.
LISTING_CSV = T.StructType(
    [
        T.StructField("vehicle_id", T.LongType()),
        T.StructField("technology", T.LongType()),
        T.StructField("actual_price", T.DoubleType()),
        T.StructField("recommended_price", T.DoubleType()),
        T.StructField("num_images", T.LongType()),
        T.StructField("street_parked", T.LongType()),
        T.StructField("description", T.LongType()),
    ]
)
LISTING = T.StructType([*LISTING_CSV.fields, T.StructField("source", T.StringType())])
BOOKING_CSV = T.StructType(
    [
        T.StructField("vehicle_id", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

# The columns profiled and modelled in the exploration.
RAW_ATTRIBUTES = [
    "technology",
    "actual_price",
    "recommended_price",
    "num_images",
    "street_parked",
    "description",
]
EXPLORED_FEATURES = [*RAW_ATTRIBUTES, "price_diff", "price_ratio"]


def listing_rules() -> dict[str, Column]:
    """Conditions a saved listing must meet, by the name reported when one fails."""
    return {
        "vehicle_id": F.col("vehicle_id") > 0,
        "technology": F.col("technology").between(0, 1),
        "actual_price": F.col("actual_price") > 0,
        "recommended_price": F.col("recommended_price") > 0,
        "num_images": F.col("num_images") >= 0,
        "street_parked": F.col("street_parked").between(0, 1),
        "description": F.col("description") >= 0,
    }
