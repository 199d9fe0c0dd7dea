"""Connected components of an edge table by alternating large and small stars, as plain DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import staged

MAX_ROUNDS = 64


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`(node, root)` for every node of an edge, root being the smallest node of its component.

    Rows with a null end and loops are left out. Smallest neighbours are minima combined before the
    shuffle, so a hub with a third of all edges costs one row per task there; the joins back to the
    edges can be split by adaptive execution. The rounds grow with the logarithm of the longest
    path; each round is written to the shared folder, which cuts its lineage.
    """
    x, y = F.col(a), F.col(b)
    current = staged(
        edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges"
    )
    before = _state(current)
    if not before[0]:
        return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(MAX_ROUNDS):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u")
            .join(lowest, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = staged(large, "stars")
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).unionByName(lower.select("u", F.col("m").alias("v")))
        current = staged(small.distinct(), "edges")
        after = _state(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
