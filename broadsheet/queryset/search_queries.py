"""Queries for retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.operators import topk
from broadsheet.plans import search
from broadsheet.queryset import fixtures, sql
from broadsheet.queryset.registry import query
from broadsheet.queryset.vector_queries import token_parts

sql.part("search_queries", """
  SELECT item_id AS query_id, text AS query, text FROM benchmark
  UNION ALL SELECT -1 - item_id, CASE WHEN item_id % 2 = 0 THEN '   ' ELSE '?! ...' END, text FROM benchmark""")
sql.part("accepted", f"""
  SELECT query_id, {sql.strip("query")} AS query, text FROM search_queries WHERE {sql.strip("query")} <> ''""", "search_queries")
token_parts("q", "accepted", "query_id", "query", 1024)


def _ranked(score_sql: str, k: int) -> str:
    return f"""
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({score_sql})
  QUALIFY rank <= {k}"""


sql.part("dense_hits", _ranked("""
  SELECT q.query_id, c.id, round(coalesce(d.dot, 0) / (q.length * c.length), 6) + 0.0 AS score
  FROM (SELECT query_id, sqrt(sum(value::DOUBLE * value)) AS length FROM q_dense GROUP BY query_id) q
  CROSS JOIN (SELECT id, sqrt(sum(value::DOUBLE * value)) AS length FROM c_dense GROUP BY id) c
  LEFT JOIN (SELECT query_id, id, sum(q_dense.value::DOUBLE * c_dense.value::DOUBLE) AS dot
    FROM q_dense JOIN c_dense USING (slot) GROUP BY query_id, id) d ON d.query_id = q.query_id AND d.id = c.id""", 50),
         "q_dense", "c_dense")
sql.part("sparse_hits", _ranked("""
  SELECT query_id, id, round(sum(CAST(round(q_sparse.weight * 1e6) AS BIGINT) * CAST(round(c_sparse.weight * 1e6) AS BIGINT)) / 1e12, 6) AS score
  FROM q_sparse JOIN c_sparse USING (token_id) GROUP BY query_id, id""", 50), "q_sparse", "c_sparse")


def _scaled(name: str) -> str:
    low, high = "min(score) OVER (PARTITION BY query_id)", "max(score) OVER (PARTITION BY query_id)"
    return f"(SELECT query_id, id, CASE WHEN {high} > {low} THEN (score - {low}) / ({high} - {low}) ELSE 1.0 END AS v FROM {name})"


sql.part("hybrid_hits", _ranked(f"""
  SELECT query_id, id, round(coalesce(d.v, 0.0) * 0.5 + coalesce(s.v, 0.0) * 0.5, 6) AS score
  FROM {_scaled("dense_hits")} d FULL JOIN {_scaled("sparse_hits")} s USING (query_id, id)""", 50), "dense_hits", "sparse_hits")
sql.part("idf", """
  SELECT query_id, token_id, CAST(round(ln(1.0 + (SELECT count(*) FROM points) / greatest(coalesce(df, 0), 1)) * 1e6) AS BIGINT) AS idf
  FROM q_sparse LEFT JOIN (SELECT token_id, count(*) AS df FROM c_sparse GROUP BY token_id) USING (token_id)""",
         "q_sparse", "c_sparse", "points")
sql.part("reranked", _ranked("""
  SELECT h.query_id, h.id, h.score AS retrieval_score,
    round(coalesce(sum(idf) FILTER (c.token_id IS NOT NULL), 0) / sum(idf), 6) AS score
  FROM hybrid_hits h JOIN idf USING (query_id) LEFT JOIN c_sparse c ON c.id = h.id AND c.token_id = idf.token_id
  GROUP BY h.query_id, h.id, h.score""", 5), "hybrid_hits", "idf", "c_sparse")
sql.part("hits", """
  SELECT query_id, query, rank, id, CASE WHEN title = '' THEN 'No Title' ELSE title END AS title, content, url, score,
    article_id, chunk_index, authors, publish_timestamp
  FROM reranked JOIN points USING (id) JOIN accepted USING (query_id)""", "reranked", "points", "accepted")


def _plain(hits):
    return hits.select("query_id", "id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("dense_topk", """
  SELECT query_id, id, score, rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id AS id,
      round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) + 0.0 AS score,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY
        round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) + 0.0 DESC, c.vec_id) AS rank
    FROM embeddings q CROSS JOIN embeddings c WHERE q.vec_id % 50 = 0) WHERE rank <= 50""")
def dense_topk(spark, sf_dir):
    """The 50 nearest of all vectors for every vector whose id is divisible by 50."""
    vectors = fixtures.table(spark, sf_dir, "embeddings")
    corpus = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = corpus.filter("id % 50 = 0").withColumnRenamed("id", "query_id")
    return _plain(topk.dense_topk(corpus, asked, search.TOP_K))


@query("text_topk", sql.statement("SELECT query_id, id, score, rank FROM dense_hits", "dense_hits"))
def text_topk(spark, sf_dir):
    """Dense hits of the text queries over all chunks."""
    return _plain(search.dense_hits(fixtures.points(spark, sf_dir), fixtures.encoded_queries(spark, sf_dir)))


@query("sparse_topk", sql.statement("SELECT query_id, id, score, rank FROM sparse_hits", "sparse_hits"))
def sparse_topk(spark, sf_dir):
    return _plain(search.sparse_hits(fixtures.points(spark, sf_dir), fixtures.encoded_queries(spark, sf_dir)))


@query("hybrid_topk", sql.statement("SELECT query_id, id, score, rank FROM hybrid_hits", "hybrid_hits"))
def hybrid_topk(spark, sf_dir):
    return _plain(search.hybrid_hits(fixtures.points(spark, sf_dir), fixtures.encoded_queries(spark, sf_dir)))


@query("rerank_topk", sql.statement("SELECT query_id, id, score, retrieval_score, rank FROM reranked", "reranked"))
def rerank_topk(spark, sf_dir):
    best = search.rerank(
        fixtures.points(spark, sf_dir), fixtures.encoded_queries(spark, sf_dir), fixtures.hybrid(spark, sf_dir))
    return best.select("query_id", "id", "score", "retrieval_score", F.col("rank").cast("bigint").alias("rank"))


@query("search_hits", sql.statement("""
  SELECT query_id, query, rank, id, title, content, url, score, CAST(article_id AS varchar) AS article_id,
    CAST(chunk_index AS varchar) AS chunk_index, authors, CAST(publish_timestamp AS varchar) AS publish_timestamp FROM hits""", "hits"))
def search_hits(spark, sf_dir):
    """The whole search of every query, from text to shaped hits."""
    queries = fixtures.search_queries(spark, sf_dir).select("query_id", "query")
    found = search.search(fixtures.points(spark, sf_dir), queries)
    meta = ["article_id", "chunk_index", "authors", "publish_timestamp"]
    return found.select(
        "query_id", "query", F.col("rank").cast("bigint").alias("rank"), "id", "title", "content", "url", "score",
        *[F.col("metadata")[key].alias(key) for key in meta],
    )


@query("search_empty", sql.statement("""
  SELECT query_id, count(id) AS total FROM accepted LEFT JOIN hits USING (query_id) GROUP BY query_id""", "accepted", "hits"))
def search_empty(spark, sf_dir):
    """Hits per accepted query; a query that finds nothing has 0."""
    lists = fixtures.hit_lists(spark, sf_dir)
    return lists.select("query_id", F.size("results").cast("bigint").alias("total"))


@query("search_snippets", sql.statement("""
  SELECT query_id, rank, title, url, round(score, 4) AS score, concat(substr(content, 1, 250), '...') AS content_snippet,
    count(*) OVER (PARTITION BY query_id) AS total_found FROM hits""", "hits"))
def search_snippets(spark, sf_dir):
    shown = search.snippets(fixtures.hits(spark, sf_dir))
    return shown.withColumn("rank", F.col("rank").cast("bigint"))


@query("query_guard", sql.statement(f"""
  SELECT query_id, {sql.strip("query")} AS query, {sql.strip("query")} <> '' AS accepted FROM search_queries""", "search_queries"))
def query_guard(spark, sf_dir):
    queries = fixtures.search_queries(spark, sf_dir).select("query_id", "query")
    good = search.accepted_queries(queries).withColumn("accepted", F.lit(True))
    bad = search.rejected_queries(queries).select("query_id", F.lit("").alias("query"), F.lit(False).alias("accepted"))
    return good.unionByName(bad)
