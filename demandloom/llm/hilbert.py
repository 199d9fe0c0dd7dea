"""Sharding along a Hilbert curve over several metadata columns, in DataFrame functions only.

Each dimension is cut at quantiles of its own values into 2**bits levels, the levels give a cell of
the curve, and rows are sorted by cell. Runs of equal row counts are the shards; within a shard,
files follow the curve, so their minima and maxima are narrow in every dimension at once.

Positions need no single task: rows are counted by cell and by a hash part of it, the counts are
summed up, and a row's place inside its part is added. Parts follow the number of rows, so a cell
with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import fresh, scratch_path, sized, staged

SHARDS = 8
BITS = 4
#: Rows of one hash part of a cell, about.
PART_ROWS = 50_000
#: The curve has at most 2**MAX_CELL_BITS cells, whose counts are summed up together.
MAX_CELL_BITS = 16
ACCURACY = 10_000


def _as_number(docs: DataFrame, column: str) -> Column:
    """Numbers as they are; texts by the six bytes after what all values begin with, in byte order."""
    kind = docs.schema[column].dataType
    value = F.col(f"`{column}`")
    if isinstance(kind, T.NumericType):
        return value.cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return value.cast("timestamp").cast("double")
    raw = value.cast("string")
    ends = docs.agg(F.left(F.min(raw), F.lit(200)).alias("a"), F.left(F.max(raw), F.lit(200)).alias("b")).first()
    low, high = (ends["a"] or "").encode(), (ends["b"] or "").encode()
    same = 0
    while same < min(len(low), len(high)) and low[same] == high[same]:
        same += 1
    tail = F.substring(raw.cast("binary"), same + 1, 6)
    return F.conv(F.rpad(F.hex(tail), 12, "0"), 16, 10).cast("double")


def quantised(docs: DataFrame, dimensions: list[str], bits: int) -> list[Column]:
    """A level from 0 to 2**bits - 1 for each dimension; null is level 0.

    Cut points are approximate quantiles over all rows: 2**bits - 1 numbers a dimension reach the driver.
    """
    numbers = [_as_number(docs, d) for d in dimensions]
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    found = docs.agg(*[F.percentile_approx(x, shares, ACCURACY).alias(f"q{k}") for k, x in enumerate(numbers)]).first()
    levels = []
    for k, x in enumerate(numbers):
        level = F.lit(0)
        for cut in sorted(set(found[f"q{k}"] or [])):
            level = level + (x > F.lit(cut)).cast("int")
        levels.append(F.coalesce(level, F.lit(0)))
    return levels


def with_hilbert(df: DataFrame, levels: list[str], bits: int, name: str) -> DataFrame:
    """Adds the Hilbert index of the integer columns `levels`, each of `bits` bits.

    The Gray-code transform of Skilling (2004), one level of bits at a time; every step is a projection.
    """
    n = len(levels)
    work = [fresh(f"x{k}") for k in range(n)]
    keep = [F.col(f"`{c}`") for c in df.columns]
    df = df.select(*keep, *[F.col(c).cast("int").alias(w) for c, w in zip(levels, work, strict=True)])

    def step(df: DataFrame, changed: dict[str, Column]) -> DataFrame:
        return df.select(*keep, *[changed.get(w, F.col(w)).alias(w) for w in work])

    first = F.col(work[0])
    for bit in range(bits - 1, 0, -1):
        q, p = 1 << bit, (1 << bit) - 1
        for k in range(n):
            own = F.col(work[k])
            up = own.bitwiseAND(F.lit(q)) != 0
            if k == 0:
                df = step(df, {work[0]: F.when(up, own.bitwiseXOR(F.lit(p))).otherwise(own)})
                continue
            swap = first.bitwiseXOR(own).bitwiseAND(F.lit(p))
            df = step(
                df,
                {
                    work[0]: F.when(up, first.bitwiseXOR(F.lit(p))).otherwise(first.bitwiseXOR(swap)),
                    work[k]: F.when(up, own).otherwise(own.bitwiseXOR(swap)),
                },
            )
    for k in range(1, n):
        df = step(df, {work[k]: F.col(work[k]).bitwiseXOR(F.col(work[k - 1]))})
    last = F.col(work[-1])
    turn = F.lit(0)
    for bit in range(bits - 1, 0, -1):
        turn = turn.bitwiseXOR(F.when(last.bitwiseAND(F.lit(1 << bit)) != 0, F.lit((1 << bit) - 1)).otherwise(F.lit(0)))
    flip = fresh("turn")
    df = df.select(*keep, *work, turn.alias(flip))
    index = F.lit(0).cast("long")
    for bit in range(bits - 1, -1, -1):
        for w in work:
            one = F.shiftright(F.col(w).bitwiseXOR(F.col(flip)), bit).bitwiseAND(F.lit(1)).cast("long")
            index = index * 2 + one
    return df.select(*keep, index.alias(name))


def hilbert_order(
    docs: DataFrame, dimensions: list[str], key: str = "doc_id", shards: int = SHARDS, bits: int = BITS
) -> DataFrame:
    """All rows and columns of `docs` with `shard` (0 to shards - 1) and `slot` (place in it, from 0).

    Row counts of shards differ by one at most. Rows are ordered by curve cell, then by hash part and
    key; ties of equal keys are ordered by nothing but are still placed apart. Null keys and null
    dimensions are placed like others (level 0); an empty table stays empty; columns named `shard` or
    `slot` are replaced. Texts that agree in six bytes after what all values begin with have one level. The result is range-partitioned along the curve and sorted within partitions.
    """
    if len(dimensions) * bits > MAX_CELL_BITS:
        raise ValueError(f"dimensions * bits may be {MAX_CELL_BITS} at most")
    docs = docs.drop("shard", "slot")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    cell, part, place = fresh("cell"), fresh("part"), fresh("place")
    names = [fresh(f"level{k}") for k in range(len(dimensions))]
    levels = quantised(docs, dimensions, bits)
    total = docs.count()
    # The curve is worked out once for each possible cell, at most 2**MAX_CELL_BITS rows, and looked up.
    grid = fresh("grid")
    spread = F.lit(0).cast("long")
    for level in levels:
        spread = spread * (1 << bits) + level
    curve = docs.sparkSession.range(1 << (bits * len(dimensions))).select(
        F.col("id").alias(grid),
        *[
            F.expr(f"cast(id div {1 << (bits * (len(names) - 1 - k))} % {1 << bits} AS int)").alias(name)
            for k, name in enumerate(names)
        ],
    )
    curve = staged(with_hilbert(curve, names, bits, cell).select(grid, cell), "curve")
    # A cell has as many parts as its own rows need, so counts by part stay near cells + rows / PART_ROWS.
    sizes = docs.select(spread.alias(grid)).groupBy(grid).agg(F.ceil(F.count("*") / PART_ROWS).alias(fresh("x")))
    width = fresh("parts")
    looked_up = staged(curve.join(sizes.toDF(grid, width), grid), "parts")
    celled = (
        docs.select("*", spread.alias(grid))
        .join(F.broadcast(looked_up), grid)
        .select(
            *columns,
            cell,
            F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in [key, *dimensions]]), F.col(width)).alias(part),
        )
    )
    counts = staged(celled.groupBy(cell, part).agg(F.count("*").alias("n")), "cells")
    # At most 2**MAX_CELL_BITS rows meet in the first window, and `parts` rows of a cell in the second.
    cells = counts.groupBy(cell).agg(F.sum("n").alias("n")).select(
        cell, (F.sum("n").over(Window.orderBy(cell)) - F.col("n")).alias("before")
    )
    inner = F.sum("n").over(Window.partitionBy(cell).orderBy(part)) - F.col("n")
    starts = staged(counts.select(cell, part, inner.alias("inside")).join(cells, cell).select(
        cell, part, (F.col("before") + F.col("inside")).alias("start")
    ), "starts")
    ranked = celled.repartitionByRange(cell, part).withColumn(
        place, F.row_number().over(Window.partitionBy(cell, part).orderBy(F.col(f"`{key}`"))) - 1
    )
    # Beyond the bound of a broadcast the join deals rows by hash; they are put back in order then.
    known = sized(starts, 24)
    placed = ranked.join(known, [cell, part]).select(
        *columns, (F.col("start") + F.col(place)).cast("long").alias(place)
    )
    if known is starts:
        placed = placed.repartitionByRange(place).sortWithinPartitions(place)
    shard = F.expr(f"`{place}` * {shards} div {max(total, 1)}")
    frame = placed.select(*columns, place, shard.cast("int").alias("shard"))
    low = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return frame.select(*columns, "shard", (F.col(place) - low).cast("long").alias("slot"))


def write_shards(ordered: DataFrame, path: str) -> None:
    """One folder for each shard; files inside follow the curve."""
    ordered.write.partitionBy("shard").parquet(path)


def read_shards(spark, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def sharded(docs: DataFrame, dimensions: list[str], path: str | None = None, **kw) -> DataFrame:
    """Writes the shards of `docs` below `path` (or the shared folder) and reads them back."""
    ordered = hilbert_order(docs, dimensions, **kw)
    path = path or scratch_path(docs.sparkSession, "shards")
    write_shards(ordered, path)
    return read_shards(docs.sparkSession, path, ordered.schema)
