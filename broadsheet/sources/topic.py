"""The item topic: a broker, or a folder of parquet files in the broker's record shape.

``options`` are broker options (``kafka.bootstrap.servers`` ...); without them
the folder at ``path`` is used. Progress lives in the query's checkpoint, which
takes the place of a consumer group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from broadsheet import schemas

TOPIC = "news_raw"


def encode(items: DataFrame) -> DataFrame:
    """Items as JSON records; text outside ASCII stays as it is."""
    return items.select("*", F.to_json(F.struct(*schemas.ITEM.names)).alias("value"))


def _text(records: DataFrame) -> DataFrame:
    return records.withColumn("key", F.col("key").cast("string")).withColumn("value", F.col("value").cast("string"))


# What one batch takes at most, so that the first drain of a long topic is many batches.
OFFSETS_PER_BATCH, FILES_PER_BATCH = 5_000_000, 1000


def read_stream(spark: SparkSession, path: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Records from the earliest offset on, in batches of bounded size (``maxOffsetsPerTrigger`` in ``options`` sets another)."""
    if options:
        source = spark.readStream.format("kafka").option("subscribe", TOPIC).option("startingOffsets", "earliest")
        return _text(source.option("maxOffsetsPerTrigger", OFFSETS_PER_BATCH).options(**options).load())
    return spark.readStream.schema(schemas.TOPIC_RECORD).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(path)


def read_batch(spark: SparkSession, path: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    if options:
        source = spark.read.format("kafka").option("subscribe", TOPIC).option("startingOffsets", "earliest")
        return _text(source.options(**options).load())
    return spark.read.schema(schemas.TOPIC_RECORD).parquet(path)


def write_stream(
    records: DataFrame, checkpoint: str, path: str | None = None, options: dict[str, str] | None = None
) -> StreamingQuery:
    """Send every record there is, then stop."""
    writer = records.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if options:
        return writer.format("kafka").option("topic", TOPIC).options(**options).start()
    return writer.format("parquet").start(path)


def peek(records: DataFrame, n: int = 5) -> DataFrame:
    """First records of the topic."""
    return records.orderBy("offset", "partition").limit(n)
