"""Batch tables: CSV and Parquet scans, the offline store, idempotent loads, store statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.schemas import FeatureView

#: Ids that a lookup turns into conditions; more are joined.
FEW_IDS = 200


def scan_csv(
    spark: SparkSession, path: str, schema: T.StructType, source: str | None = None
) -> DataFrame:
    """CSV with a header under a fixed schema; a malformed row stops the load.

    Columns are named by the header, which may hold more of them. All files of a folder must have the
    same header: one that differs stops the load, as its values would land in other columns. With
    `source` every row is tagged with where it came from.
    """
    header = spark.read.option("header", True).csv(path).columns
    known = {f.name: f.dataType for f in schema.fields}
    full = T.StructType([T.StructField(c, known.get(c, T.StringType())) for c in header])
    rows = (
        spark.read.option("header", True)
        .option("mode", "FAILFAST")
        .option("enforceSchema", False)
        .schema(full)
        .csv(path)
        .select(*schema.fieldNames())
    )
    return rows if source is None else rows.withColumn("source", F.lit(source))


def scan_projected(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The named columns of a Parquet table."""
    return spark.read.parquet(path).select(*columns)


def scan_jdbc(spark: SparkSession, options: dict[str, str], columns: Sequence[str]) -> DataFrame:
    """The named columns of a database table; `options` are those of Spark's JDBC source."""
    return spark.read.format("jdbc").options(**options).load().select(*columns)


#: Types of a file that a declared type can be read from.
READ_AS = {
    "bigint": ("tinyint", "smallint", "int"),
    "int": ("tinyint", "smallint"),
    "double": ("float", "tinyint", "smallint", "int"),
    "timestamp": ("date",),
}


def scan_evolving(
    spark: SparkSession, path: str, schema: T.StructType, defaults: Mapping[str, object] | None = None
) -> DataFrame:
    """Files of different age in one folder as one table of the declared schema.

    A column that a file lacks is NULL in its rows, or its default; a NULL of a column with a default
    takes it too. A file whose column has a type that the declared one cannot be read from is refused
    by name before any row is read; columns that are not declared are left out. The footers of the files
    are read by Spark's tasks.
    """
    found = spark.read.option("mergeSchema", True).parquet(path).schema
    types = {f.name: f.dataType.simpleString() for f in found.fields}
    wrong = [
        f"{f.name} is {types[f.name]}, not {kind}"
        for f in schema.fields
        if (kind := f.dataType.simpleString()) != types.get(f.name, kind)
        and types[f.name] not in READ_AS.get(kind, ())
    ]
    if wrong:
        raise ValueError(f"files of {path} do not fit: {', '.join(wrong)}")
    rows = spark.read.schema(schema).parquet(path)
    for name, value in (defaults or {}).items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(value).cast(schema[name].dataType)))
    return rows


def scan_offline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_offline(df: DataFrame, path: str, order: str | None = None) -> None:
    """Replace the offline store.

    With `order` its files hold separate ranges of that column and a Bloom filter of it in every row
    group, so `lookup` opens few of them. That costs one shuffle of the store.
    """
    writer = df.write
    if order is not None:
        writer = df.repartitionByRange(order).sortWithinPartitions(order).write.options(**key_index(order))
    writer.mode("overwrite").parquet(path)


def key_index(key: str) -> dict[str, str]:
    """Options of the Parquet writer for Bloom filters of a key, sized by the keys they hold."""
    return {
        f"parquet.bloom.filter.enabled#{key}": "true",
        f"parquet.bloom.filter.adaptive.enabled#{key}": "true",
        "parquet.bloom.filter.adaptive.enabled": "true",
    }


def lookup(table: DataFrame, ids: DataFrame, key: str, few: int = FEW_IDS) -> DataFrame:
    """Rows of the requested ids, read from few row groups of a table written with `key_index`.

    Up to `few` distinct ids become equality conditions, which row groups are skipped by: their ranges
    first, then their Bloom filters. More ids are joined, within the range they span.
    """
    wanted = ids.select(key).distinct()
    first = [r[key] for r in wanted.limit(few + 1).collect()]
    known = [x for x in first if x is not None]
    if len(first) <= few:
        # One by one: longer IN lists are handed to Parquet as a range only.
        return table.where(reduce(or_, [F.col(key) == x for x in known], F.lit(False)))
    low, high = wanted.agg(F.min(key), F.max(key)).first()
    return table.where(F.col(key).between(low, high)).join(wanted, key, "left_semi")


def load_idempotent(
    incoming: DataFrame, existing: DataFrame, key: str | Sequence[str], unique: bool = False
) -> DataFrame:
    """Rows of `incoming` that are not loaded yet: what a load has to append.

    Rows that repeat a key are facts of their own: of each key as many rows are new as `incoming` has
    more than `existing`. NULL is a value like others in a key. With `unique` a key names an entity:
    one row of each new key is left, and keys with a NULL are refused.

    The loaded side is reduced to one row per key before the join, and only rows of keys that are
    loaded already are numbered. Columns must be of types that can be grouped.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if unique:
        return (
            incoming.dropna(subset=keys)
            .dropDuplicates(keys)
            .join(existing.select(*keys).distinct(), keys, "left_anti")
        )
    held = existing.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count(F.lit(1)).alias("__held"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    names = [F.col(f"`{c}`") for c in incoming.columns]
    # Equal rows are one with its count, and the rows of a key are dealt to parts by their hash: a key
    # is numbered by many tasks, which need the sizes of the parts before theirs.
    counted = incoming.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    parts = int(incoming.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = counted.join(held, same, "left").withColumn("__part", F.pmod(F.xxhash64(*names), F.lit(parts)))
    known = found.where(F.col("__held").isNotNull())
    sizes = known.groupBy(*keys, "__part").agg(F.sum("__n").alias("__size"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(k).alias(f"__o{k}") for k in keys],
        F.col("__part").alias("__opart"),
        F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"),
    )
    placed = F.col("__part") == F.col("__opart")
    for k in keys:
        placed = placed & F.col(k).eqNullSafe(F.col(f"__o{k}"))
    upto = Window.partitionBy(*keys, "__part").orderBy(*names).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = known.join(offsets, placed).withColumn("__end", F.col("__offset") + F.sum("__n").over(upto))
    more = F.least(F.col("__n"), F.col("__end") - F.col("__held"))
    fresh = found.where(F.col("__held").isNull()).select(*names, F.col("__n").alias("__more")).unionByName(
        numbered.select(*names, more.alias("__more")).where("__more > 0")
    )
    return fresh.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__more")))).select(*names)


def append_new(
    spark: SparkSession, incoming: DataFrame, path: str, key: str | Sequence[str], unique: bool = False
) -> None:
    """Append the rows a Parquet table does not hold yet; a second run adds nothing."""
    existing = table_or_none(spark, path, incoming.schema)
    if existing is None:
        existing = incoming.limit(0)
    load_idempotent(incoming, existing, key, unique).write.mode("append").parquet(path)


def table_or_none(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame | None:
    """A Parquet table, or None while its folder does not exist."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def store_stats(offline: DataFrame, online: DataFrame, key: str) -> DataFrame:
    """Rows and distinct keys of both stores; one row each."""

    def stats(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys")).select(
            F.lit(name).alias("store"), (F.col("rows") > 0).alias("available"), "rows", "keys"
        )

    return stats(offline, "offline").unionByName(stats(online, "online"))


def file_stats(table: DataFrame) -> DataFrame:
    """Files, bytes and last change of a file-based table, read from file metadata."""
    files = table.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("bytes"),
        F.col("_metadata.file_modification_time").alias("modified"),
    ).distinct()
    return files.agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("bytes").alias("size_bytes"),
        F.max("modified").alias("last_modified"),
    )


def view_summary(spark: SparkSession, view: FeatureView) -> DataFrame:
    """The declared feature view as one row."""
    return spark.createDataFrame(
        [(view.name, view.entity, view.key, view.feature_names, view.label, view.ttl_days)],
        "name string, entity string, entity_key string, features array<string>, label string, ttl_days int",
    )
