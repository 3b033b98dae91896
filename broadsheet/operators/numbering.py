"""Dense surrogate keys without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.session import stage

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def highest(df: DataFrame, column: str) -> int:
    """Largest key in use, 0 for an empty table."""
    return df.agg(F.max(column).alias("top")).first()["top"] or 0


def number_rows(df: DataFrame, order_by: list[str], id_column: str, after: int = 0) -> DataFrame:
    """Add ``id_column`` = ``after`` + 1, 2, 3 ... in the order of ``order_by``.

    The rows are range-partitioned and written once; each partition's offset is
    the row count of the ones before it. Only those counts, one row per
    partition, are looked at as a whole.
    """
    placed = stage(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << _ROW_BITS) - 1)),
        f"numbered-{id_column}",
    )
    counted = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    too_many = F.raise_error(F.lit("a partition holds more rows than can be numbered"))
    counts = counted.select("_part", F.when(F.col("_rows") < 1 << _ROW_BITS, F.col("_rows")).otherwise(too_many).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(id_column, F.lit(after + 1) + F.col("_offset") + F.col("_row"))
        .drop("_part", "_row", "_offset")
    )
