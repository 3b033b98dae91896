"""The corpus pipeline: good documents, one of each group of near-duplicates, free of benchmark items, mixed and sharded.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept,
and returns a DataFrame, which is written as Parquet and read again as the docs of
the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm import decontamination, mixing, ngram_join, quality, sharding
from broadsheet.llm.folds import held_out
from broadsheet.llm.scratch import Scratch

GOOD = 0.7  # score from which a document stays


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Texts without words are scored like any other; null columns stay null."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    model = quality.fit(docs, labels, "quality")
    return docs.filter(quality.score(model, F.col("text")) >= GOOD)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a Jaccard similarity of 0.8 or more: that with the least doc_id."""
    classes, _ = ngram_join.join(docs, words=5, of=4, out_of=5)
    return ngram_join.one_of_each(docs, classes)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontamination.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontamination.clean(docs, found)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them, in the order of training.

    Rows are whole documents: where a source's target ends inside one, it counts if at
    least half of it is read.
    """
    rows = mixing.training_rows(mixing.mix(docs))
    return rows.filter(F.col("words") * 2 >= F.col("size")).select("doc.*")


def deal_to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot along the curve."""
    return sharding.shard(docs, shards=16)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", deal_to_shards),
]

ORACLE_SQL = None  # a trained classifier decides in the first stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(docs, "pipeline")
    written = None
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        if written is not None:
            scratch.drop(written)
        written = docs
    return docs
