"""Shared steps of the operators: missing columns, staging, and joins that broadcast only checked sizes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.session import scratch_path, staged

#: A join side is broadcast only after its measured rows and bytes stay below this.
BROADCAST_BYTES = 32 << 20

ArrowMap = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

__all__ = ["BROADCAST_BYTES", "ArrowMap", "fresh", "read_table", "scratch_path", "sized", "staged"]


def fresh(stem: str) -> str:
    """A column name that no input column can have."""
    return f"__{stem}_{uuid.uuid4().hex[:8]}"


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(df: DataFrame, row_bytes: int | Column, bound: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if its measured size is within `bound`, else as it is.

    `df` should be staged, as it is read once for the measure. `row_bytes` is a bound for one row, or
    an expression for it.
    """
    cost = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    total = df.agg(F.sum(cost.cast("long")).alias("b")).first()["b"] or 0
    return F.broadcast(df) if total <= bound else df
