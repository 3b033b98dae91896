"""Session settings, the shared work folder and staged tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_local_dirs: dict[str, str] = {}


def get_session(app_name: str = "broadsheet", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every job here relies on.

    The number of shuffle partitions is left to the cluster's own default; AQE
    merges small partitions and splits skewed join partitions at run time.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Streaming state on local disk with its checkpoint in the shared folder, not on the heap.
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables: the one named in ``spark.checkpoint.dir``.

    Only a local master may run without it; a private folder is made then.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="broadsheet-")
    return _local_dirs[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the work folder; never reused, so a retry cannot mix outputs."""
    return os.path.join(work_dir(spark), "broadsheet", spark.sparkContext.applicationId, f"{name}-{uuid.uuid4().hex[:12]}")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table in the work folder and read it back.

    Cuts the lineage with files that outlive any executor, and later readers
    get column pruning on the staged table.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``, on whatever store it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def list_folders(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match ``pattern`` ("*" within a name), on whatever store they lie."""
    target = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return [str(f.getPath().toString()) for f in found or []]


def remove(spark: SparkSession, path: str) -> None:
    """Remove a written folder, on whatever store it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


# Splits of an input that is small enough to be moved for the sake of more tasks.
FEW_SPLITS = 4


def spread(scan: DataFrame) -> DataFrame:
    """Give costly row work all cores when a plain scan has a few splits only.

    A scan of more than ``FEW_SPLITS`` splits is returned as it is, however many
    cores there are, so nothing but a few splits is ever moved.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < min(cores, FEW_SPLITS + 1) else scan


# Bytes of values that a broadcast may hold.
BROADCAST_BYTES = 24 << 20


def value_bytes(df: DataFrame) -> int:
    """Bytes of all values: the lengths of texts, 8 for numbers. Summed on the map side, one row reaches the driver."""
    def size(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(column), F.lit(0)) + 16
        if isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
            return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
        return F.lit(8)

    per_row = sum((size(f) for f in df.schema.fields), F.lit(8))
    return df.agg(F.sum(per_row.cast("bigint"))).first()[0] or 0


def broadcast_if_small(keys: DataFrame) -> DataFrame:
    """Mark a narrow, already written or cached frame for broadcast if its values are few bytes.

    Beyond the limit the join shuffles, and the partitions of the narrow side are hashed:
    the big side, which may hold long texts, is not sorted and nothing of it spills. This
    spares the big side of a join a shuffle the planner cannot rule out by
    itself, since it does not know the size of computed frames beforehand.
    """
    return F.broadcast(keys) if value_bytes(keys) <= BROADCAST_BYTES else keys.hint("shuffle_hash")


def side_by_side(spark: SparkSession, *actions: Callable[[], Any]) -> list[Any]:
    """Run independent actions at the same time, so that small jobs do not wait for each other."""
    with ThreadPoolExecutor(max_workers=len(actions)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(action)) for action in actions]
        return [job.result() for job in running]
