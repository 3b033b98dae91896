"""Batch search: a table of queries against the vector table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.functions.text import strip, tokens
from broadsheet.operators import encoders, topk
from broadsheet.session import broadcast_if_small, stage

# Retrieval depth, hits kept after reranking, snippet length.
TOP_K = 50
TOP_RERANK = 5
SNIPPET = 250

DEFAULT_TITLE = "No Title"
DEFAULT_URL = "#"


def accepted_queries(queries: DataFrame) -> DataFrame:
    """Queries with trimmed text; blank ones are left out."""
    return queries.withColumn("query", strip(F.col("query"))).filter(F.length("query") > 0)


def rejected_queries(queries: DataFrame) -> DataFrame:
    return queries.filter(F.coalesce(F.length(strip(F.col("query"))), F.lit(0)) == 0)


def encode_queries(queries: DataFrame, dense=encoders.encode_dense, sparse=encoders.encode_sparse) -> DataFrame:
    """Query vectors; a query without a single token finds nothing and is left out."""
    known = queries.filter(F.size(tokens(F.col("query"))) > 0)
    return known.select(
        "query_id", "query", dense(F.col("query")).alias("vector"), sparse(F.col("query")).alias("sparse")
    )


def dense_hits(points: DataFrame, encoded: DataFrame, k: int = TOP_K) -> DataFrame:
    return topk.dense_topk(points.select("id", F.col("dense").alias("vector")), encoded, k)


def sparse_hits(points: DataFrame, encoded: DataFrame, k: int = TOP_K) -> DataFrame:
    return topk.sparse_topk(points, encoded, k)


def _scaled(hits: DataFrame, name: str) -> DataFrame:
    """Scores of one list spread over 0..1 per query; a list of equal scores becomes 1."""
    whole = Window.partitionBy("query_id")
    low, high = F.min("score").over(whole), F.max("score").over(whole)
    value = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.lit(1.0))
    return hits.select("query_id", "id", value.alias(name))


def fuse(dense: DataFrame, sparse: DataFrame, k: int = TOP_K, dense_share: float = 0.5) -> DataFrame:
    """Weighted sum of both scaled lists; a missing side counts 0. At most k rows per query and side come in."""
    both = _scaled(dense, "d").join(_scaled(sparse, "s"), ["query_id", "id"], "full_outer")
    total = F.coalesce("d", F.lit(0.0)) * dense_share + F.coalesce("s", F.lit(0.0)) * (1 - dense_share)
    return topk.ranked(both.select("query_id", "id", F.round(total, 6).alias("score")), k)


def scan(points: DataFrame, encoded: DataFrame, k: int = TOP_K) -> DataFrame:
    """Both lists and the queries' document counts from one scan of the points, written."""
    corpus = points.select("id", F.col("dense").alias("vector"), "sparse")
    return topk.scan(corpus, encoded.select("query_id", "vector", "sparse"), k, ["dense", "sparse"], counted=True)


def fused(found: DataFrame, k: int = TOP_K) -> DataFrame:
    """The hybrid list of what ``scan`` found."""
    return fuse(topk.best_of(found, "dense", k), topk.best_of(found, "sparse", k), k)


def hybrid_hits(points: DataFrame, encoded: DataFrame, k: int = TOP_K) -> DataFrame:
    return fused(scan(points, encoded, k), k)


_MICRO = 1_000_000


def query_idf(encoded: DataFrame, held: DataFrame) -> DataFrame:
    """Per query: token id -> idf in millionths, from the number of points holding the token (``topk.held_by``)."""
    total = held.filter("token = -1").select("n").scalar()
    asked = encoded.select("query_id", F.explode(F.map_keys("sparse")).alias("token"))
    idf = F.round(F.log(F.lit(1.0) + total / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))) * _MICRO).cast("bigint")
    valued = asked.join(held, "token", "left").select("query_id", "token", idf.alias("idf"))
    return valued.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "idf"))).alias("idf"))


def overlap_score(idf: Column, tokens: Column) -> Column:
    """Share of the query's idf that a chunk with these token ids covers."""
    total = F.aggregate(F.map_values(idf), F.lit(0).cast("bigint"), lambda a, v: a + v)
    shared = F.array_intersect(F.map_keys(idf), tokens)
    covered = F.aggregate(shared, F.lit(0).cast("bigint"), lambda a, t: a + idf[t])
    return F.round(F.when(total > 0, covered / total).otherwise(F.lit(0.0)), 6)


def rerank(
    points: DataFrame, encoded: DataFrame, candidates: DataFrame, k: int = TOP_RERANK,
    scorer: Callable[[Column, Column], Column] | None = None, held: DataFrame | None = None,
) -> DataFrame:
    """Best ``k`` candidates by a costlier score, the retrieval score kept.

    ``scorer`` takes the query and content columns (a pandas UDF for a real
    model); without it the idf-weighted overlap is used, on the counts in ``held``
    (``topk.held_by``; counted here if not given). The overlap is scored on ids
    and token ids, and only the chosen points' payload is read.
    """
    few = broadcast_if_small(stage(candidates.select("query_id", "id", F.col("score").alias("retrieval_score")), "candidates"))
    if scorer is not None:
        joined = points.select("id", "payload").join(few, "id").join(encoded.select("query_id", "query"), "query_id")
        score = scorer(F.col("query"), F.col("payload.content"))
        return topk.ranked(joined.select("query_id", "query", "id", score.alias("score"), "retrieval_score", "payload"), k)
    if held is None:
        held = topk.held_by(topk.scan(points.select("id", "sparse"), encoded.select("query_id", "sparse"), 1, ["sparse"], counted=True))
    held_tokens = points.select("id", F.map_keys("sparse").alias("tokens")).join(few, "id").join(query_idf(encoded, held), "query_id")
    scored = held_tokens.select("query_id", "id", overlap_score(F.col("idf"), F.col("tokens")).alias("score"), "retrieval_score")
    chosen = broadcast_if_small(stage(topk.ranked(scored, k), "reranked"))
    asked = encoded.select("query_id", "query")
    return points.select("id", "payload").join(chosen, "id").join(asked, "query_id").select(
        "query_id", "query", "id", "score", "retrieval_score", "payload", "rank")


def shape_hits(reranked: DataFrame) -> DataFrame:
    """Hits with defaults for absent fields; the rest of the payload becomes metadata."""
    rest = F.create_map(
        F.lit("article_id"), F.col("payload.article_id").cast("string"),
        F.lit("chunk_index"), F.col("payload.chunk_index").cast("string"),
        F.lit("authors"), F.col("payload.authors"),
        F.lit("publish_timestamp"), F.col("payload.publish_timestamp").cast("string"),
    )

    def or_default(column: str, default: str) -> Column:
        value = F.coalesce(F.col(column), F.lit(""))
        return F.when(value == "", F.lit(default)).otherwise(value)

    return reranked.select(
        "query_id", "query", "rank", "id",
        or_default("payload.title", DEFAULT_TITLE).alias("title"),
        F.col("payload.content").alias("content"),
        or_default("payload.url", DEFAULT_URL).alias("url"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.map_filter(rest, lambda _, v: v.isNotNull()).alias("metadata"),
    )


def search(points: DataFrame, queries: DataFrame, k: int = TOP_K, top: int = TOP_RERANK, scorer=None) -> DataFrame:
    """Hits of every accepted query, best first. The encoded queries are written once and read by each step."""
    encoded = stage(encode_queries(accepted_queries(queries)), "encoded-queries")
    found = scan(points, encoded, k)
    return shape_hits(rerank(points, encoded, fused(found, k), top, scorer, topk.held_by(found)))


def hit_lists(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per query with its hits in rank order; a query that found nothing has an empty list.

    A list holds at most the reranked top of one query.
    """
    fields = F.struct("rank", "id", "title", "content", "url", "score", "metadata")
    lists = hits.select("query_id", fields.alias("hit")).groupBy("query_id").agg(F.collect_list("hit").alias("results"))
    ordered = F.array_sort("results", lambda a, b: a["rank"] - b["rank"])
    return queries.join(lists.withColumn("results", ordered), "query_id", "left").withColumn(
        "results", F.coalesce("results", F.array().cast(lists.schema["results"].dataType))
    )


def snippets(hits: DataFrame) -> DataFrame:
    """Title, URL, score with four decimals, head of the content and the number of hits of the query."""
    return hits.select(
        "query_id", "rank", "title", "url",
        F.round("score", 4).alias("score"),
        F.concat(F.left("content", F.lit(SNIPPET)), F.lit("...")).alias("content_snippet"),
        F.count("*").over(Window.partitionBy("query_id")).alias("total_found"),
    )
