"""The online store: written batches and a base, of which the newest row of a key counts.

Each version of the store names its live folders (`snapshots`). A write adds the rows of its batch, so
it costs the size of the batch. When the batches together hold more rows than a share of the base, they
are merged with it by ranges of the key: the store keeps one row per key and a bounded rest, however
many batches it has seen. A merge leaves batches that were committed meanwhile as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.operators.features import new_arrivals
from demandloom.operators.stores import latest_per_key
from demandloom.schemas import LISTING_VIEW, FeatureView
from demandloom.sources.snapshots import Part, Snapshot, Store
from demandloom.sources.tables import key_index, lookup

ROWS = "rows"
BASE = "base"
#: Batches may hold this share of the base's rows before they are merged with it, and so many of them.
MERGE_SHARE, MERGE_BATCHES = 0.5, 64


def stored_schema(view: FeatureView) -> T.StructType:
    """A row of the view with the batch that wrote it."""
    wrote = [T.StructField("writer", T.StringType()), T.StructField("batch", T.LongType())]
    return T.StructType([*view.schema.fields, *wrote])


def write_online(
    df: DataFrame,
    path: str,
    writer: str,
    batch: int,
    view: FeatureView = LISTING_VIEW,
    merge: bool = True,
    arrival: int | None = None,
) -> Part:
    """Commit the rows of a batch. A batch that runs again takes its own place.

    With `merge` the store is merged when its batches have grown too large. `arrival` takes the batch's
    place where rows of equal stamp are told apart; a constant makes the result independent of when
    they arrived.
    """
    store = Store(df.sparkSession, path)
    order = F.lit(batch if arrival is None else arrival).cast("long")
    rows = df.select(*view.schema.fieldNames(), F.lit(writer).alias("writer"), order.alias("batch"))
    part = store.write(rows, ROWS, writer, batch)
    made = store.transact(lambda base: base.with_parts(part))
    if merge and wants_merge(made):
        merge_online(df.sparkSession, path, view)
    return part


def read_part(spark: SparkSession, path: str, part: Part, view: FeatureView = LISTING_VIEW) -> DataFrame:
    """The rows of one written batch."""
    return spark.read.schema(view.schema).parquet(f"{path}/{part.folder}")


def read_online(
    spark: SparkSession,
    path: str,
    view: FeatureView = LISTING_VIEW,
    ids: DataFrame | None = None,
    version: int | None = None,
) -> DataFrame:
    """The newest row of every key, or of the given ids only, in the newest version or the given one.

    On equal stamps the later batch of a writer goes first, then the larger values. Ids are matched
    before the newest row is looked for, so a lookup of few ids opens few row groups of the base.
    """
    store = Store(spark, path)
    return newest_rows(store.read(ROWS, stored_schema(view), store.snapshot(version)), view, ids)


def newest_rows(rows: DataFrame, view: FeatureView, ids: DataFrame | None = None) -> DataFrame:
    if ids is not None:
        rows = lookup(rows, ids, view.key)
    return _newest(rows, view).select(*view.schema.fieldNames())


def _newest(rows: DataFrame, view: FeatureView) -> DataFrame:
    return latest_per_key(rows, view.key, view.timestamp, "batch", "writer", *view.feature_names, view.label)


def materialize_arrivals(
    features: DataFrame, path: str, writer: str, batch: int, view: FeatureView = LISTING_VIEW
) -> bool:
    """Write rows without an observed label; nothing is written when there are none."""
    arrivals = new_arrivals(features, view.label).select(*view.schema.fieldNames())
    if arrivals.isEmpty():
        return False
    write_online(arrivals, path, writer, batch, view)
    return True


def wants_merge(snapshot: Snapshot) -> bool:
    """Whether the batches beside the base have grown too many or too large."""
    parts = snapshot.of(ROWS)
    base = sum(p.rows for p in parts if p.writer == BASE)
    rest = [p.rows for p in parts if p.writer != BASE]
    return len(rest) > MERGE_BATCHES or (len(rest) > 1 and sum(rest) > MERGE_SHARE * base)


def merge_online(spark: SparkSession, path: str, view: FeatureView = LISTING_VIEW) -> Snapshot:
    """Put one base in the place of all live folders, cut into ranges of the key.

    Batches committed during the merge stay beside the base. If another merge came first, this one
    has no effect.
    """
    store = Store(spark, path)
    seen = store.snapshot()
    parts = seen.of(ROWS)
    newest = _newest(store.read(ROWS, stored_schema(view), seen), view)
    ranges = newest.repartitionByRange(view.key).sortWithinPartitions(view.key)
    base = store.write(ranges, ROWS, BASE, **key_index(view.key))

    def change(now: Snapshot) -> Snapshot:
        if set(parts) - set(now.of(ROWS)):
            return now
        return now.without(parts).with_parts(base)

    return store.transact(change)


def compact_online(
    spark: SparkSession, path: str, target: str, view: FeatureView = LISTING_VIEW
) -> DataFrame:
    """Write the newest row of every key as one batch of a store at a new path and read it back."""
    write_online(read_online(spark, path, view), target, "compaction", 0, view)
    return read_online(spark, target, view)
