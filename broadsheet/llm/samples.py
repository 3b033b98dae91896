"""Bounded samples of labelled and unlabelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def least_hashed(rows: DataFrame, most: int, *by: str) -> DataFrame:
    """At most ``most`` rows, the same ones each time: those whose columns ``by``, distinct in each row, have the least hashes.

    The rows are counted first, so that little more than ``most`` of them meet in the one task that sorts.
    """
    order, count = F.xxhash64(*by), rows.count()
    if count > 2 * most + 1000:  # hashes are spread evenly: the number under the bound is 2 x most, give or take a few hundred
        under = rows.filter(order < int(2**64 * (2 * most + 1000) / count) - 2**63)
        rows = under if under.count() >= most else rows
    return rows.orderBy(order, *by).limit(most)


def fitting_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """text, label: up to ``most`` labelled and ``most`` unlabelled documents (label null).

    ``labels`` holds one label per doc_id; null labels and null ids are left out, and
    of several labels of an id the least counts. The ids are chosen first, and only
    2 x ``most`` of them are sent to the tasks that read the texts. Of several texts of
    an id the least counts; null ones only where there is no other.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("label"))
    ids = docs.select("doc_id").filter("doc_id is not null").distinct()
    chosen = least_hashed(known.join(ids, "doc_id", "left_semi"), most, "doc_id").select("doc_id", F.col("label").cast("int").alias("label"))
    others = least_hashed(ids.join(known, "doc_id", "left_anti"), most, "doc_id").select("doc_id", F.lit(None).cast("int").alias("label"))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.unionByName(others)), "doc_id")
    return texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
