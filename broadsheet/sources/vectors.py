"""The vector table: one parquet sub-folder per run, dimension and metric kept with the dense column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet import schemas
from broadsheet.session import broadcast_if_small, exists, remove

DENSE_METADATA = {"dim": schemas.DENSE_DIM, "metric": schemas.DENSE_METRIC}


def _empty(spark: SparkSession) -> DataFrame:
    columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.VECTOR_POINT.fields]
    return spark.range(0).select(*columns).withMetadata("dense", DENSE_METADATA)


def init_vectors(spark: SparkSession, path: str) -> None:
    """Create the table if it is missing."""
    _empty(spark).write.mode("ignore").parquet(f"{path}/run_id=0")


def drop_vectors(spark: SparkSession, path: str) -> None:
    """Remove every point of every run."""
    _empty(spark).withColumn("run_id", F.lit(0).cast("bigint")).write.mode("overwrite").option(
        "partitionOverwriteMode", "static"
    ).partitionBy("run_id").parquet(path)
    remove(spark, _replaced(path))


def load_vectors(spark: SparkSession, path: str, before_run: int | None = None) -> DataFrame:
    """The points of all runs (only of those before ``before_run`` if given), each id in its latest version."""
    with_run = T.StructType([*schemas.VECTOR_POINT.fields, T.StructField("run_id", T.LongType())])
    until = F.lit(True) if before_run is None else F.col("run_id") < before_run
    points = spark.read.schema(with_run).parquet(path).filter(until)
    if exists(spark, _replaced(path)):
        # Only ids that were ever replaced are joined, not all points grouped by id.
        again = spark.read.schema("id string, run_id bigint").parquet(_replaced(path)).filter(until)
        again = broadcast_if_small(again.groupBy("id").agg(F.max("run_id").alias("_newest")).withColumnRenamed("id", "_id"))
        points = points.join(again, (F.col("id") == F.col("_id")) & (F.col("run_id") < F.col("_newest")), "left_anti")
    return points.drop("run_id")


def _replaced(path: str) -> str:
    return f"{path}-replaced"


def write_vectors(points: DataFrame, path: str, run_id: int, replace: bool = False) -> None:
    """Write one run's points; the same run written again replaces them.

    With ``replace`` the points take the place of earlier ones of the same id. Their
    ids are written first: until the points are there too, readers miss the old ones
    of this run's ids at most, and running it again sets that right.
    """
    shaped = points.select(*[f.name for f in schemas.VECTOR_POINT.fields])
    if replace:
        shaped.select("id").distinct().write.mode("overwrite").parquet(f"{_replaced(path)}/run_id={run_id}")
    shaped.withMetadata("dense", DENSE_METADATA).write.mode("overwrite").parquet(f"{path}/run_id={run_id}")


def compact(spark: SparkSession, path: str, new_path: str) -> None:
    """Write the latest version of every point to a table of one run at ``new_path``."""
    write_vectors(load_vectors(spark, path), new_path, 0)
