"""Chunks -> vector points, encoding only chunks that have no point yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.functions import dates, text
from broadsheet.operators import encoders
from broadsheet.session import broadcast_if_small, side_by_side, spread, stage
from broadsheet.sources import vectors as store

Tables = dict[str, DataFrame]


def chunk_export(wh: Tables) -> DataFrame:
    """Chunks with title, URL, date text and distinct authors; a chunk row that occurs twice counts once.

    Authors are gathered per article before any chunk is touched, so a chunk
    meets exactly one row of article data, written beforehand: while that fits a
    broadcast no text is shuffled or sorted.
    """
    authors = (
        wh["fact_article_authors"].join(broadcast_if_small(wh["dim_author"]), "author_id").groupBy("article_id")
        .agg(F.array_join(F.array_sort(F.collect_set("author_name")), ", ").alias("authors"))
    )
    articles = (
        wh["fact_articles"].select("article_id", "url_hash", "title", "time_id")
        .join(wh["article_metadata"].select("url_hash", "url"), "url_hash")
        .join(wh["dim_time"].select("time_id", "date"), "time_id", "left")
        .join(authors, "article_id", "left")
        .select(
            "article_id", "title", "url",
            F.coalesce(F.col("date").cast("string"), F.lit("Unknown")).alias("publish_date"),
            F.coalesce("authors", F.lit("Unknown")).alias("authors"),
        )
    )
    chunks = wh["fact_chunks"].select("article_id", "chunk_index", "content")
    known, again = side_by_side(
        articles.sparkSession, lambda: broadcast_if_small(stage(articles, "articles")), lambda: _repeated(chunks))
    return _once_each(chunks, again).join(known, "article_id")


PLACE = ["article_id", "chunk_index"]


def _repeated(chunks: DataFrame) -> DataFrame | None:
    """Places that occur more than once, found on their two numbers; None if there are none."""
    again = stage(chunks.groupBy(*PLACE).count().filter("count > 1").select(*PLACE), "repeated-chunks")
    return None if again.isEmpty() else broadcast_if_small(again)


def _once_each(chunks: DataFrame, again: DataFrame | None) -> DataFrame:
    """``chunks`` with each row once. Only texts of repeated places are compared, all others stay where they are."""
    if again is None:
        return chunks
    return chunks.join(again, PLACE, "left_anti").unionByName(chunks.join(again, PLACE, "left_semi").dropDuplicates())


def with_point_id(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("id", text.point_id(F.col("article_id"), F.col("chunk_index")))


def not_stored(chunks: DataFrame, points: DataFrame) -> DataFrame:
    """Chunks (with ``id``) whose point is not in the vector table."""
    return chunks.join(points.select("id"), "id", "left_anti")


def build_points(
    chunks: DataFrame,
    dense: Callable[[Column], Column] = encoders.encode_dense,
    sparse: Callable[[Column], Column] = encoders.encode_sparse,
) -> DataFrame:
    """Id, both vectors and the payload of each chunk. The two default encoders share one pass over its tokens."""
    payload = F.struct(
        F.col("article_id").cast("bigint").alias("article_id"), F.col("chunk_index").cast("int").alias("chunk_index"),
        "title", "url", "content", "authors", dates.publish_seconds(F.col("publish_date")).alias("publish_timestamp"),
    )
    if (dense, sparse) == (encoders.encode_dense, encoders.encode_sparse):
        encoded = chunks.select("id", encoders.encode_both(F.col("content")).alias("both"), payload.alias("payload"))
        return encoded.select("id", "both.dense", "both.sparse", "payload")
    return chunks.select(
        "id", dense(F.col("content")).alias("dense"), sparse(F.col("content")).alias("sparse"), payload.alias("payload")
    )


def run_vectorize(
    spark: SparkSession, wh: Tables, path: str, run_id: int, changed: DataFrame | None = None, **encoders_by_name
) -> DataFrame:
    """Add the points of new chunks to the vector table at ``path`` as run ``run_id``.

    With ``changed`` (article_id), the points of those articles' chunks are made anew as well
    and take the place of the stored ones.

    New chunks are chosen on their keys, and only their text is joined. They are
    written before they are encoded: encoding is the costly part, and a lost executor
    then repeats its own share of it and nothing else.
    """
    store.init_vectors(spark, path)
    keys = with_point_id(wh["fact_chunks"].select("article_id", "chunk_index").distinct())
    wanted = not_stored(keys, store.load_vectors(spark, path, before_run=run_id))
    if changed is not None:
        wanted = wanted.unionByName(keys.join(changed.select("article_id").distinct(), "article_id", "left_semi").select(*wanted.columns)).distinct()
    new = stage(wanted.select("article_id", "chunk_index"), "new-keys")
    chunks = wh["fact_chunks"].join(broadcast_if_small(new), ["article_id", "chunk_index"], "left_semi")
    fresh = with_point_id(chunk_export({**wh, "fact_chunks": chunks}))
    store.write_vectors(build_points(spread(stage(fresh, "new-chunks")), **encoders_by_name), path, run_id, replace=changed is not None)
    return store.load_vectors(spark, path)
