"""Question sets and score tables as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet import schemas

TESTSET = T.StructType([T.StructField("question", schemas.STRING), T.StructField("ground_truth", schemas.STRING)])
_QUOTING = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}
_KEEP_SPACE = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}

BYTE_ORDER_MARK = "﻿"


def read_testset(spark: SparkSession, path: str) -> DataFrame:
    """Question and ground truth; fields may hold commas, quotes and line breaks."""
    return spark.read.options(**_QUOTING, **_KEEP_SPACE).schema(TESTSET).csv(path)


def write_testset(pairs: DataFrame, path: str) -> None:
    pairs.select("question", "ground_truth").write.options(**_QUOTING, **_KEEP_SPACE, quoteAll="true").csv(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """One folder with one file per model; the header opens with a byte-order mark, so the file does.

    A model's scores, a few numbers for each question, go through one task: one file is what is asked for.
    """
    first, *rest = [c for c in scores.columns if c != "model"]
    marked = scores.select("model", F.col(first).alias(BYTE_ORDER_MARK + first), *rest)
    marked.repartition("model").write.partitionBy("model").options(**_QUOTING, **_KEEP_SPACE).csv(path)


def read_scores(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    columns = [f for f in schema.fields if f.name != "model"]
    shape = T.StructType([*columns, T.StructField("model", schemas.STRING)])
    read = spark.read.options(**{**_QUOTING, "enforceSchema": "true"}).schema(shape).csv(path)
    return read.select(*schema.names)
