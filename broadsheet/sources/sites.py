"""Site lists: JSON arrays of URLs or of objects with a ``url``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """Seed URLs of every list file under ``path``."""
    files = spark.read.text(path, wholetext=True)
    entries = files.select(F.explode(F.from_json("value", "array<string>")).alias("entry"))
    # A JSON object among strings arrives as its JSON text.
    as_object = F.get_json_object(F.when(F.startswith("entry", F.lit("{")), F.col("entry")), "$.url")
    return entries.select(F.coalesce(as_object, "entry").alias("url"))


def write_sites(lists: DataFrame, path: str) -> None:
    """One file per row; ``lists`` has one text column with a JSON array each."""
    lists.write.option("maxRecordsPerFile", 1).text(path)
