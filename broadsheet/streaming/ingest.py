"""Topic records -> raw table, one row per URL, first arrival wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from broadsheet import schemas
from broadsheet.functions import urls
from broadsheet.operators.merging import first_per_key
from broadsheet.session import broadcast_if_small, exists, list_folders, new_path, remove, side_by_side

MESSAGE = "url string, title string, author string, publish_date string, _broken string"

# What an absent field becomes.
UNKNOWN_TITLE = "Unknown Title"
UNKNOWN_AUTHOR = "Unknown"

_PARTITION_BITS = 20

RAW = schemas.ARTICLE_METADATA
DEAD = schemas._struct(seq=schemas.LONG, value=schemas.STRING)
KEYS = schemas._struct(url_hash=schemas.STRING, prefix=schemas.STRING, batch_id=schemas.LONG)

# Leading hex digits of a URL key by which a new key table is divided, and the rows of a folder from which on
# ``compact_keys`` takes one digit more: what a batch reads of a folder does not grow with the table.
KEY_DIGITS = 1
FOLDER_KEYS = 1 << 20


def record_id(partition: Column, offset: Column) -> Column:
    """One number for a record. It names the record and orders nothing; fails where partition and offset do not fit."""
    place = offset.cast("bigint")
    fits = (partition < 1 << _PARTITION_BITS) & (place < 1 << (63 - _PARTITION_BITS))
    return F.when(fits, F.shiftleft(place, _PARTITION_BITS) + partition).otherwise(F.raise_error(F.lit("record id out of range")))


def arrival() -> Column:
    """Order of arrival: by time, then by partition and offset."""
    return F.struct("timestamp", "partition", "offset")


def decode(records: DataFrame) -> DataFrame:
    """Fields of each record with defaults; the raw JSON stays in ``content``."""
    item = F.from_json("value", MESSAGE, {"columnNameOfCorruptRecord": "_broken"})
    decoded = records.withColumn("_item", item)
    return decoded.select(
        record_id(F.col("partition"), F.col("offset")).alias("seq"),
        F.col("_item.url").alias("url"),
        F.coalesce("_item.title", F.lit(UNKNOWN_TITLE)).alias("title"),
        F.col("value").alias("content"),
        F.coalesce("_item.author", F.lit(UNKNOWN_AUTHOR)).alias("author"),
        F.col("_item.publish_date").alias("publish_date"),
        (F.col("_item").isNull() | F.col("_item._broken").isNotNull()).alias("broken"),
        "timestamp", "partition", "offset",
    )


def usable(decoded: DataFrame) -> DataFrame:
    """Readable records that have a URL, with its key."""
    good = decoded.filter(~F.col("broken") & (F.coalesce(F.col("url"), F.lit("")) != ""))
    return good.withColumn("url_hash", urls.url_hash(F.col("url")))


def dead_letters(decoded: DataFrame) -> DataFrame:
    return decoded.filter("broken").select("seq", F.col("content").alias("value"))


def _with_batch(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_with_batch(RAW)).parquet(f"{path}/raw")


def read_dead(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_with_batch(DEAD)).parquet(f"{path}/dead")


def init_raw(spark: SparkSession, path: str, digits: int = KEY_DIGITS) -> None:
    """Create the tables that are missing. A raw table without key table gets one, divided by ``digits`` of the keys."""
    for name, schema in (("raw", RAW), ("dead", DEAD)):
        empty = spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
        empty.write.mode("ignore").parquet(f"{path}/{name}/batch_id=-1")
    if not _key_folders(spark, path):
        _write_keys(read_raw(spark, path), f"{path}/keys/digits={digits}/upto=-1", digits)


def _prefix(digits: int) -> Column:
    return F.left("url_hash", F.lit(digits)).alias("prefix")


def _write_keys(rows: DataFrame, folder: str, digits: int, into: bool = False) -> None:
    """Write the keys of ``rows`` (url_hash, batch_id), one file for each prefix and batch.

    With ``into`` they are added to the table, and the same batch again takes its own
    place. A table written as a whole ends with a mark that it is finished.
    """
    keys = rows.select("url_hash", _prefix(digits), "batch_id")
    if keys.rdd.getNumPartitions() > 1:
        keys = keys.repartition("prefix")
    keys.sortWithinPartitions("prefix", "batch_id", "url_hash").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic" if into else "static").partitionBy("prefix", "batch_id").parquet(folder)


def _key_folders(spark: SparkSession, path: str) -> list[tuple[int, int, str]]:
    """(upto, digits, folder) of each finished form of the key table, the one in use last."""
    found = list_folders(spark, f"{path}/keys/digits=*/upto=*/_SUCCESS")
    named = [folder.rsplit("/", 1)[0] for folder in found]
    parts = [dict(piece.split("=", 1) for piece in folder.rsplit("/", 2)[1:]) for folder in named]
    return sorted((int(p["upto"]), int(p["digits"]), folder) for p, folder in zip(parts, named))


def stored_keys(spark: SparkSession, path: str, prefixes: list[str]) -> DataFrame:
    """url_hash, prefix, batch_id of the stored rows whose key starts with one of ``prefixes``; other folders are not even listed."""
    _, _, folder = _key_folders(spark, path)[-1]
    parts = [p for p in (f"{folder}/prefix={prefix}" for prefix in prefixes) if exists(spark, p)]
    if not parts:
        return spark.createDataFrame([], KEYS)
    return spark.read.schema(KEYS).option("basePath", folder).parquet(*parts)


def compact_keys(spark: SparkSession, path: str, digits: int | None = None) -> None:
    """Write the key table anew with one file for each prefix, divided by ``digits``, else by as many as its size asks for.

    No job may be writing to it. The new form takes over when it is finished, then the
    old one goes.
    """
    upto, now, folder = _key_folders(spark, path)[-1]
    keys = spark.read.schema(KEYS).parquet(folder)
    count, last = keys.agg(F.count("*"), F.max("batch_id")).first()
    last = upto if last is None else max(last, upto)
    if digits is None:
        digits = now
        while count > FOLDER_KEYS * 16 ** digits:
            digits += 1
    new = f"{path}/keys/digits={digits}/upto={last}"
    if new == folder:  # nothing came since
        return
    _write_keys(keys.select("url_hash", F.lit(last).cast("bigint").alias("batch_id")), new, digits)
    for *_, old in _key_folders(spark, path)[:-1]:
        remove(spark, old)


def write_batch(path: str):
    """Batch writer: rows whose URL is new, and the unreadable records.

    Each batch owns one sub-folder and compares itself with earlier batches
    only, so a batch that is run again after a failure writes the same rows.
    Of the stored keys only the folders of prefixes that the batch holds are
    listed and read, and they are not shuffled while the batch's keys fit a
    broadcast; article text is moved only for new URLs.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        work = new_path(spark, f"batch-{batch_id}")
        _, digits, folder = _key_folders(spark, path)[-1]
        try:
            # Written to the shared folder, so neither a lost executor nor a second use reads the topic again.
            decode(batch).write.parquet(f"{work}/decoded")
            decoded = spark.read.parquet(f"{work}/decoded")
            rows = usable(decoded)
            order = rows.select("url_hash", arrival().alias("arrival"), "seq")
            first_per_key(order, "url_hash", "arrival").write.parquet(f"{work}/firsts")
            firsts = spark.read.parquet(f"{work}/firsts").select("url_hash", "seq")
            prefixes = [r["prefix"] for r in firsts.select(_prefix(digits)).distinct().collect()]  # at most 16 ** digits
            stored = stored_keys(spark, path, prefixes).filter(F.col("batch_id") < batch_id).select("url_hash")
            known = stored.join(broadcast_if_small(firsts.select("url_hash")), "url_hash", "left_semi")
            firsts.join(known, "url_hash", "left_anti").write.parquet(f"{work}/fresh")
            fresh = spark.read.schema(firsts.schema).parquet(f"{work}/fresh")
            new = rows.join(broadcast_if_small(fresh), ["url_hash", "seq"], "left_semi").select(*RAW.names)
            side_by_side(
                spark,
                lambda: new.write.mode("overwrite").parquet(f"{path}/raw/batch_id={batch_id}"),
                lambda: dead_letters(decoded).write.mode("overwrite").parquet(f"{path}/dead/batch_id={batch_id}"),
                lambda: _write_keys(fresh.withColumn("batch_id", F.lit(batch_id).cast("bigint")), folder, digits, into=True),
            )
        finally:
            remove(spark, work)

    return write


def start(
    records: DataFrame, path: str, checkpoint: str, continuous: str | None = None, delay: str | None = None
) -> StreamingQuery:
    """Ingest ``records``: everything there is and stop, or every ``continuous`` interval until stopped.

    With ``delay``, repeats of a URL within that time are dropped before the exact
    check against the stored table, which then sees fewer rows.
    """
    init_raw(records.sparkSession, path)
    records = recent_only(records, delay) if delay else records
    writer = records.writeStream.foreachBatch(write_batch(path)).option("checkpointLocation", checkpoint)
    when = {"processingTime": continuous} if continuous else {"availableNow": True}
    return writer.trigger(**when).start()


def recent_only(records: DataFrame, delay: str) -> DataFrame:
    """Records without repeats of a URL within ``delay``; state older than that is dropped.

    Records without a usable URL all stay, since each of them may be a dead letter.
    """
    decoded = decode(records)
    url = F.when(~F.col("broken") & (F.coalesce(F.col("url"), F.lit("")) != ""), urls.url_hash(F.col("url")))
    keyed = decoded.select(
        F.coalesce(url, F.concat(F.lit("#"), F.col("seq").cast("string"))).alias("_key"),
        F.col("content").alias("value"), "timestamp", "partition", "offset",
    )
    return keyed.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def reset_raw(spark: SparkSession, path: str) -> None:
    """Empty the raw table and the dead letters. Jobs that write to them must be stopped."""
    for name in ("raw", "dead", "keys"):
        remove(spark, f"{path}/{name}")
    init_raw(spark, path)
