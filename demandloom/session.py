"""Session helpers: a builder for stand-alone runs and the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Cut points are held by the driver and offsets are broadcast, so their number has a bound.
MAX_SPLITS = 16_384

_LOCAL_ROOTS: dict[str, str] = {}


def build_session(app: str = "demandloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the library is tested under; `conf` keys use `__` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named in `spark.checkpoint.dir`.

    A machine-local folder is made only for a local master that names none.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if sc.applicationId not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[sc.applicationId] = tempfile.mkdtemp(prefix="demandloom-")
    return _LOCAL_ROOTS[sc.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path below the shared folder."""
    return f"{shared_dir(spark)}/demandloom/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a frame below the shared folder and read it back.

    Used where several jobs read one intermediate result: it is computed once, its plan ends at the
    written files, and a lost executor costs a re-read instead of a recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write if partition_by is None else df.write.partitionBy(partition_by)
    writer.parquet(path)
    schema = df.schema
    read = df.sparkSession.read.schema(schema).parquet(path)
    return read.select(*schema.fieldNames())


def split_count(spark: SparkSession) -> int:
    """How many value ranges a global order is cut into: follows the shuffle width, bounded."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(64, min(MAX_SPLITS, 4 * width))
