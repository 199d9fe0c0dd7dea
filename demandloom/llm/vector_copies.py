"""Near copies among vectors by counting collisions of one-dimensional projections.

Every vector of unit length is projected on many random lines. Two vectors whose angle is small lie
close on nearly all lines, so they fall in the query-centred window of each other there; unrelated
ones do on few. The lines are dealt to tables: within a table, vectors meet if they share a cell on
each of its lines. Those that meet are sorted along the counting lines, the windows around each are
read off the sorted order, and the collisions of a pair are counted over all lines. Pairs that reach
a count at which a link is hardly ever missed are verified by their cosine in double precision.

Nothing is a row for each pair: what leaves a task is the number of links of each vector and as many
links as keep its components. A pair that meets in several tables counts in the first of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .frames import staged

THRESHOLD = 0.98
#: Tables and lines of each. At the threshold a table misses a pair in two cases of three and all
#: tables together in three of ten thousand, at an angle of 0.15 in one of a hundred thousand.
TABLES, LINES = 20, 20
#: Width of a cell and half width of a window, on lines along which unit vectors deviate by one.
CELL, WINDOW = 3.0, 2.0
COUNTED = 40
#: Most links that the count alone may lose.
MISS = 1e-6
BLOCK_ROWS = 256
BIN_ROWS = 4096
_SEED = 11


def least_count(lines: int = COUNTED, window: float = WINDOW, miss: float = MISS) -> int:
    """The largest count that a pair at the threshold stays below with a probability of at most `miss`.

    A pair at the threshold lies within `window` deviations on a line with the normal probability.
    """
    p, below = erf(window / sqrt(2)), 0.0
    for k in range(lines + 1):
        below += comb(lines, k) * p**k * (1 - p) ** (lines - k)
        if below > miss:
            return k
    return lines


def lines_of(dim: int) -> np.ndarray:
    """Directions of all lines as columns, scaled so that unit vectors deviate by one."""
    rng = np.random.default_rng((_SEED, dim))
    lines = rng.standard_normal((dim, TABLES * LINES))
    return lines * (sqrt(dim) / np.linalg.norm(lines, axis=0))


def cells_of(places: np.ndarray) -> np.ndarray:
    """A 64-bit name of the cell of every vector in every table; the low bits are the table."""
    shift = np.random.default_rng(_SEED).uniform(0, CELL, TABLES * LINES)
    steps = np.floor((places + shift) / CELL).astype(np.int64).view(np.uint64)
    steps = steps.reshape(len(places), TABLES, LINES)
    name = np.zeros(steps.shape[:2], np.uint64)
    with np.errstate(over="ignore"):
        for k in range(LINES):
            name = (name ^ steps[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
            name ^= name >> np.uint64(29)
        return (name << np.uint64(5) | np.arange(TABLES, dtype=np.uint64)).view(np.int64)


def units(raw: pa.Array, kind: str) -> np.ndarray:
    """Vectors of one length from their bytes, in double precision and of unit length."""
    joined = np.frombuffer(b"".join(raw.to_pylist()), kind).astype(np.float64).reshape(len(raw), -1)
    joined = joined / np.abs(joined).max(axis=1, keepdims=True)
    return joined / np.linalg.norm(joined, axis=1, keepdims=True)


def by_length(raw: pa.Array) -> Iterator[np.ndarray]:
    """Positions of the vectors of each length."""
    sizes = np.array([len(x) for x in raw.to_pylist()], np.int64)
    for size in np.unique(sizes):
        yield np.flatnonzero(sizes == size)


def _packed(df: DataFrame, key: str, vector: str, label: str) -> tuple[DataFrame, str]:
    """Rows (id, label, raw): the bytes of the vector, null where it links with nothing."""
    single = "float" in df.schema[vector].dataType.simpleString()
    kind = "<f4" if single else "<f8"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws: list[bytes | None] = []
            for v, name in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                values = None
                if v.is_valid and name is not None and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(kind)
                    if np.isfinite(x).all() and x.any():
                        values = x.tobytes()
                raws.append(values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(raws, pa.binary())], names=["id", "label", "raw"]
            )

    cast = "array<float>" if single else "array<double>"
    rows = df.select(
        F.col(f"`{key}`").cast("long").alias("id"),
        F.col(f"`{vector}`").cast(cast).alias("vector"),
        F.col(f"`{label}`").cast("string").alias("label"),
    )
    return rows.mapInArrow(scan, "id long, label string, raw binary"), kind


def _cells(nodes: DataFrame, kind: str) -> DataFrame:
    """Rows (node, cell): the cells of every node, by label."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in by_length(batch.column(1)):
                for some in np.array_split(at, -(-len(at) // BIN_ROWS)):
                    take = pa.array(some)
                    u = units(batch.column(1).take(take), kind)
                    cells = cells_of(u @ lines_of(u.shape[1]))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(take), pa.array(list(cells), pa.list_(pa.int64()))], names=["node", "cells"]
                    )

    found = nodes.select("node", "raw").mapInArrow(scan, "node long, cells array<long>")
    # Labels and lengths part the cells; a clash of names only brings more rows together.
    return found.select("node", F.explode("cells").alias("cell"))


def collisions(cluster: np.ndarray, places: np.ndarray, window: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of one cluster with the number of lines on which each lies in the window of the other.

    `cluster` must be sorted. Returns (i, j, count) with i < j for all pairs that collide at all.
    """
    n = len(cluster)
    first = np.searchsorted(cluster, cluster)
    size = np.searchsorted(cluster, cluster, side="right") - first
    heads = np.flatnonzero(first == np.arange(n))
    bases = np.zeros(n, np.int64)
    bases[heads] = np.concatenate([np.zeros(1, np.int64), np.cumsum(size[heads].astype(np.int64) ** 2)[:-1]])
    bases = bases[first]
    counts = np.zeros(int((size[heads].astype(np.int64) ** 2).sum()), np.uint8)
    number = np.searchsorted(heads, first)
    reach = 2 * (np.abs(places).max() if n else 0.0) + 4 * window
    for line in places.T:
        # Clusters lie apart on the sorted line, so that no window reaches into another one.
        value = line + number * reach
        order = np.argsort(value)
        ahead = np.searchsorted(value[order], value[order] + window, side="right") - np.arange(n) - 1
        left = np.repeat(np.arange(n), ahead)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(ahead) - ahead, ahead)
        a, b = order[left], order[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        counts[bases[low] + (low - first[low]) * size[low] + high - first[low]] += 1
    slots = np.flatnonzero(counts)
    head = heads[np.searchsorted(bases[heads], slots, side="right") - 1]
    inside = slots - bases[head]
    return head + inside // size[head], head + inside % size[head], counts[slots]


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """As many of the pairs as keep the same components."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        r, s = top(x), top(y)
        if r != s:
            up[s] = r
            out.append((x, y))
    return out


def _links(table: pa.Table, kind: str, threshold: float, least: int) -> pa.Table:
    """Rows (a, null, degree) and links (a, b, 0) that keep the components of one task."""
    cell, label = table["cell"].to_numpy(), table["label"].to_numpy(zero_copy_only=False)
    raw = table["raw"].combine_chunks()
    out: list[tuple[int, int | None, int]] = []
    for at in by_length(raw):
        _, names = np.unique(label[at].astype(str), return_inverse=True)
        pairs = np.stack([cell[at], names], axis=1)
        _, cluster = np.unique(pairs, axis=0, return_inverse=True)
        order = np.argsort(cluster.ravel(), kind="stable")
        at, cluster = at[order], cluster.ravel()[order]
        # Most rows of small clusters meet nobody of their own label.
        _, inverse, size = np.unique(cluster, return_inverse=True, return_counts=True)
        at, cluster = at[size[inverse] > 1], cluster[size[inverse] > 1]
        if not len(at):
            continue
        take = pa.array(at)
        u = units(raw.take(take), kind)
        places = u @ lines_of(u.shape[1])
        i, j, count = collisions(cluster, places[:, :COUNTED], WINDOW * sqrt(2 - 2 * threshold))
        node, copies, side = (table[c].to_numpy()[at] for c in ("node", "copies", "side"))
        passed = (count >= least) & ((side[i] < 0) | (side[i] != side[j]))
        i, j = i[passed], j[passed]
        cells = cells_of(places)
        own = cell[at] & 31
        keep = np.zeros(len(i), bool)
        for low in range(0, len(i), 1 << 14):
            x, y = i[low : low + (1 << 14)], j[low : low + (1 << 14)]
            first = (cells[x] == cells[y]).argmax(axis=1) == own[x]
            keep[low : low + (1 << 14)] = first & (np.einsum("ij,ij->i", u[x], u[y]) >= threshold)
        i, j = i[keep], j[keep]
        degree = np.bincount(i, copies[j], len(at)) + np.bincount(j, copies[i], len(at))
        out += [(int(node[k]), None, int(degree[k])) for k in np.flatnonzero(degree)]
        out += [(x, y, 0) for x, y in forest(node[i], node[j])]
    a, b, d = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "degree": pa.array(d, pa.int64())})


def near_vectors(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """`(key, n_links, component_id, kept)` for every row of `df`.

    Rows of equal label link when the cosine of their vectors is `threshold` or more. `n_links` is
    the number of other rows that link directly, `component_id` the smallest key that links reach,
    and `kept` tells the row of that key. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows without a label, link with nothing; vectors of different length
    do not either. Equal vectors of a label are one node, so rows that repeat a key and its vector
    link, and are all kept if one is. Rows without a key are returned with a null component, no
    links, and kept. Keys must be whole numbers; other columns of `df` are not read. An empty table
    gives an empty one.

    Links are never wrong. One at the threshold is missed with a probability of 3 in 10,000, the others
    less often. Cells that many rows share are cut into blocks of `block_rows`, each pair of blocks
    being a task's; the time for a group of linked vectors grows with its square, as their links are
    counted, its memory does not.
    """
    packed, kind = _packed(df, key, vector, label)
    rows = staged(packed.withColumn("same", F.unhex(F.sha2("raw", 256))), "vectors")
    live = F.col("raw").isNotNull() & F.col("id").isNotNull()
    nodes = staged(
        rows.where(live)
        .groupBy("label", "same")
        .agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.min("raw").alias("raw"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    cells = staged(_cells(nodes, kind), "cells")
    shared = cells.groupBy("cell").agg(F.count("*").alias("held")).where("held > 1")
    parts = F.ceil(F.col("held") / block_rows)
    met = staged(
        cells.join(shared, "cell").select("node", "cell", parts.alias("parts")), "met"
    )
    few = met.where("parts = 1").count()
    bins = max(1, -(-few // BIN_ROWS))
    block = F.pmod(F.xxhash64("node"), F.col("parts"))
    minus, zero = F.lit(-1).cast("long"), F.lit(0).cast("long")

    def task(x, y, side):
        return F.struct(x.alias("x"), y.alias("y"), side.cast("int").alias("side"))

    one = F.array(task(minus, F.pmod(F.xxhash64("cell"), F.lit(bins)), F.lit(-1)))
    many = F.transform(
        F.sequence(zero, F.col("parts") - 1),
        lambda k: task(
            F.least(block, k), F.greatest(block, k), F.when(block == k, -1).otherwise((block > k).cast("int"))
        ),
    )
    tasks = met.select("node", "cell", F.explode(F.when(F.col("parts") == 1, one).otherwise(many)).alias("t"))
    least = least_count()
    found = staged(
        tasks.join(nodes.select("node", "label", "copies", "raw"), "node")
        .select("node", "cell", "label", "copies", "raw", "t.*", F.when(F.col("t.x") < 0, zero).otherwise(F.col("cell")).alias("own"))
        .groupBy("own", "x", "y")
        .applyInArrow(lambda table: _links(table, kind, threshold, least), "a long, b long, degree long"),
        "links",
    )
    roots = connected_components(found.where("b is not null"))
    reach = nodes.select("node", "label", "same", "id", "copies").join(roots, "node", "left")
    reach = reach.withColumn("root", F.coalesce("root", "node"))
    least_id = reach.groupBy("root").agg(F.min("id").alias("component_id"))
    degree = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("degree").alias("degree"))
    known = (
        reach.join(least_id, "root")
        .join(degree, "node", "left")
        .select(
            "label",
            "same",
            "component_id",
            (F.col("copies") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links"),
        )
    )
    alone = rows.where(~live).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    joined = rows.where(live).select("id", "label", "same").join(known, ["label", "same"]).select("id", "n_links", "component_id")
    return joined.unionByName(alone).select(
        F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
