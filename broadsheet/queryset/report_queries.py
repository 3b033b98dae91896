"""Queries for reports, chunking and the explorer."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.operators import chunking
from broadsheet.plans import explorer, reports
from broadsheet.queryset import fixtures, sql
from broadsheet.queryset.registry import query

sql.part("writers", """
  SELECT article_id, string_agg(author_name, ' & ' ORDER BY author_name) AS author,
    string_agg(author_name, ', ' ORDER BY author_name) AS authors FROM article_authors GROUP BY article_id""", "article_authors")
sql.part("listing", """
  SELECT article_id AS id, title, url, domain AS source, date AS published_date, author, left(text, 150) || '...' AS snippet
  FROM (SELECT article_id, title, url, domain, date, text FROM loaded) LEFT JOIN writers USING (article_id)""", "loaded", "writers")


@query("article_list", sql.statement(
    "SELECT * FROM listing ORDER BY published_date DESC NULLS FIRST, id DESC LIMIT 10 OFFSET 20", "listing"))
def article_list(spark, sf_dir):
    return reports.article_list(fixtures.warehouse(spark, sf_dir), limit=10, offset=20)


@query("article_search", sql.statement(
    "SELECT * FROM listing WHERE title ILIKE '%EN_and%' ORDER BY published_date DESC NULLS FIRST, id DESC LIMIT 50", "listing"))
def article_search(spark, sf_dir):
    return reports.article_list(fixtures.warehouse(spark, sf_dir), q=" EN_and ", limit=50)


@query("stats_totals", sql.statement("""
  SELECT (SELECT count(*) FROM dim_source) AS total_sources, (SELECT count(*) FROM article_metadata) AS total_articles,
    (SELECT count(*) FROM fact_chunks) AS total_vectors""", "dim_source", "article_metadata", "fact_chunks"))
def stats_totals(spark, sf_dir):
    return reports.stats_totals(fixtures.warehouse(spark, sf_dir))


@query("top_authors", sql.statement("""
  SELECT name, count, CAST(floor(count / max(count) OVER () * 100) AS BIGINT) AS percent FROM (
    SELECT author_name AS name, count(*) AS count FROM fact_article_authors JOIN dim_author USING (author_id)
    GROUP BY author_name ORDER BY count DESC, name LIMIT 5)""", "fact_article_authors", "dim_author"))
def top_authors(spark, sf_dir):
    return reports.top_authors(fixtures.warehouse(spark, sf_dir))


@query("source_distribution", sql.statement(f"""
  SELECT name, value, {sql.percent("value", "sum(value) OVER ()")} AS percent FROM (
    SELECT domain AS name, count(*) AS value FROM fact_articles JOIN dim_source USING (source_id) GROUP BY domain)""",
    "fact_articles", "dim_source"))
def source_distribution(spark, sf_dir):
    return reports.source_distribution(fixtures.warehouse(spark, sf_dir))


@query("daily_trend", sql.statement("""
  SELECT strftime(date, '%d/%m') AS date, count FROM (
    SELECT date, count(*) AS count FROM fact_articles JOIN dim_time USING (time_id) GROUP BY date ORDER BY date DESC LIMIT 7)""",
    "fact_articles", "dim_time"))
def daily_trend(spark, sf_dir):
    return reports.daily_trend(fixtures.warehouse(spark, sf_dir))


@query("latest_articles", sql.statement("""
  SELECT article_id, title, domain AS source, strftime(date, '%d/%m/%Y') AS date
  FROM fact_articles JOIN dim_source USING (source_id) JOIN dim_time USING (time_id) ORDER BY article_id DESC LIMIT 10""",
    "fact_articles", "dim_source", "dim_time"))
def latest_articles(spark, sf_dir):
    return reports.latest_articles(fixtures.warehouse(spark, sf_dir))


@query("monitor_metrics", sql.statement(f"""
  SELECT a AS total_articles, c AS total_chunks, u AS date_errors, {sql.ratio("c", "a", 2)} AS avg_chunks_per_article FROM (
    SELECT (SELECT count(*) FROM fact_articles) AS a, (SELECT count(*) FROM fact_chunks) AS c,
      (SELECT count(*) FROM article_metadata WHERE publish_date = 'Unknown') AS u)""",
    "fact_articles", "fact_chunks", "article_metadata"))
def monitor_metrics(spark, sf_dir):
    return reports.monitor_metrics(fixtures.warehouse(spark, sf_dir))


@query("recent_authors", sql.statement("""
  SELECT article_id, title, string_agg(author_name, ' & ' ORDER BY author_name) AS authors
  FROM fact_articles JOIN fact_article_authors USING (article_id) JOIN dim_author USING (author_id)
  GROUP BY article_id, title ORDER BY article_id DESC LIMIT 20""", "fact_articles", "fact_article_authors", "dim_author"))
def recent_authors(spark, sf_dir):
    return reports.recent_authors(fixtures.warehouse(spark, sf_dir), k=20)


@query("latest_chunks", sql.statement("""
  SELECT chunk_index, content FROM fact_chunks WHERE article_id = (SELECT max(article_id) FROM fact_articles)""",
    "fact_chunks", "fact_articles"))
def latest_chunks(spark, sf_dir):
    chunks = reports.latest_chunks(fixtures.warehouse(spark, sf_dir))
    return chunks.withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


@query("article_chunks", sql.statement("""
  SELECT article_id, concat('idx_', chunk_index) AS chunk_id, content AS text,
    count(*) OVER (PARTITION BY article_id) AS total_chunks FROM fact_chunks""", "fact_chunks"))
def article_chunks(spark, sf_dir):
    """Every article's chunk view."""
    wh = fixtures.warehouse(spark, sf_dir)
    return reports.article_chunks(wh, articles=wh["fact_articles"])


@query("monthly_counts", sql.statement("""
  SELECT year, month, count(*) AS articles FROM fact_articles JOIN dim_time USING (time_id) GROUP BY year, month""",
    "fact_articles", "dim_time"))
def monthly_counts(spark, sf_dir):
    counts = reports.monthly_counts(fixtures.warehouse(spark, sf_dir))
    return counts.select(F.col("year").cast("bigint").alias("year"), F.col("month").cast("bigint").alias("month"), "articles")


@query("date_errors", sql.statement(
    "SELECT seq, title, url FROM article_metadata WHERE publish_date = 'Unknown' ORDER BY seq LIMIT 10", "article_metadata"))
def date_errors(spark, sf_dir):
    return reports.date_errors(fixtures.warehouse(spark, sf_dir))


@query("star_sample", sql.statement("""
  SELECT article_id, title, domain, date FROM fact_articles JOIN dim_source USING (source_id) JOIN dim_time USING (time_id)
  ORDER BY article_id LIMIT 5""", "fact_articles", "dim_source", "dim_time"))
def star_sample(spark, sf_dir):
    return reports.star_sample(fixtures.warehouse(spark, sf_dir))


@query("processed_total", sql.statement("SELECT count(*) AS total_processed FROM fact_articles", "fact_articles"))
def processed_total(spark, sf_dir):
    return reports.processed_total(fixtures.warehouse(spark, sf_dir))


@query("stage_status", sql.statement("""
  SELECT CAST(0 AS INTEGER) AS position, 'pages' AS component, count(*) AS processed FROM pages
  UNION ALL SELECT 1, 'events', count(*) FROM events UNION ALL SELECT 2, 'raw', count(*) FROM article_metadata
  UNION ALL SELECT 3, 'articles', count(*) FROM fact_articles UNION ALL SELECT 4, 'chunks', count(*) FROM fact_chunks
  UNION ALL SELECT 5, 'vectors', count(*) FROM fact_chunks""", "article_metadata", "fact_articles", "fact_chunks"))
def stage_status(spark, sf_dir):
    wh = fixtures.warehouse(spark, sf_dir)
    return reports.stage_status({
        "pages": fixtures.table(spark, sf_dir, "pages"), "events": fixtures.table(spark, sf_dir, "events"),
        "raw": wh["article_metadata"], "articles": wh["fact_articles"], "chunks": wh["fact_chunks"],
        "vectors": fixtures.points(spark, sf_dir),
    })


@query("source_list", sql.statement("SELECT source_id, domain FROM dim_source", "dim_source"))
def source_list(spark, sf_dir):
    return reports.source_list(fixtures.warehouse(spark, sf_dir))


# Chunking.


@query("chunk_split", sql.statement("""
  SELECT article_id, chunk_index, chunk FROM chunk_texts""", "chunk_texts"))
def chunk_split(spark, sf_dir):
    """Recursive split of every loaded article, before trimming."""
    content = fixtures.warehouse(spark, sf_dir)["dim_content"]
    cut = content.select(F.col("content_id").alias("article_id"),
                         F.posexplode(chunking.chunk_column()(F.col("content"))).alias("chunk_index", "chunk"))
    return cut.withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


@query("chunk_trim", r"""
  SELECT doc_id, position, regexp_replace(piece, '^[. ,!?\n\t]+', '') AS piece FROM (
    SELECT doc_id, CAST(generate_subscripts(pieces, 1) - 1 AS BIGINT) AS position, unnest(pieces) AS piece
    FROM (SELECT doc_id, string_split(text, 'e') AS pieces FROM documents))
  WHERE regexp_replace(piece, '^[. ,!?\n\t]+', '') <> ''""")
def chunk_trim(spark, sf_dir):
    """Trimming of given pieces: texts cut at every "e"; gaps stay in the numbering."""
    docs = fixtures.table(spark, sf_dir, "documents").select("doc_id", "text")
    trimmed = chunking.explode_chunks(docs, "text", lambda text: F.split(text, "e"))
    return trimmed.select("doc_id", F.col("chunk_index").cast("bigint").alias("position"), F.col("content").alias("piece"))


@query("chunk_window", """
  SELECT doc_id, i AS chunk_index, substr(text, i * 650 + 1, 800) AS chunk FROM (
    SELECT doc_id, text, unnest(range(0, greatest(length(text) - 151, 0) // 650 + 1)) AS i FROM documents WHERE length(text) > 0)""")
def chunk_window(spark, sf_dir):
    docs = fixtures.table(spark, sf_dir, "documents")
    cut = docs.select("doc_id", F.posexplode(chunking.window_column()(F.col("text"))).alias("chunk_index", "chunk"))
    return cut.withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


@query("chunk_tokens", sql.statement("""
  SELECT chunk_id, CAST(floor(length(content) / 4 + 0.5) AS BIGINT) AS tokens FROM fact_chunks""", "fact_chunks"))
def chunk_tokens(spark, sf_dir):
    chunks = fixtures.warehouse(spark, sf_dir)["fact_chunks"]
    return chunks.select("chunk_id", chunking.token_estimate(F.col("content")).alias("tokens"))


# Explorer.

sql.part("explored", """
  SELECT article_id AS id, title, url_hash, domain AS source, date
  FROM fact_articles LEFT JOIN dim_source USING (source_id) LEFT JOIN dim_time USING (time_id)""",
         "fact_articles", "dim_source", "dim_time")


@query("explore_filter", sql.statement("""
  SELECT * FROM explored WHERE source = 'src4.example.com' ORDER BY date DESC NULLS FIRST, id DESC LIMIT 10""", "explored"))
def explore_filter(spark, sf_dir):
    return explorer.first_of_source(explorer.articles(fixtures.warehouse(spark, sf_dir)), "src4.example.com", 10)


@query("explore_date_range", sql.statement("""
  SELECT * FROM explored WHERE date BETWEEN DATE '2024-03-01' AND DATE '2024-06-30'""", "explored"))
def explore_date_range(spark, sf_dir):
    return explorer.in_date_range(explorer.articles(fixtures.warehouse(spark, sf_dir)), "2024-03-01", "2024-06-30")


@query("explore_defaults", sql.statement("""
  SELECT seq AS id, title, coalesce(CAST(date AS varchar), 'N/A') AS date,
    CASE WHEN author IN ('Unknown', '') THEN 'Tác giả' ELSE author END AS author,
    CASE WHEN substr(content, 1, 150) = '' THEN 'Không có tóm tắt...' ELSE substr(content, 1, 150) END AS snippet
  FROM (SELECT *, CAST(try_strptime(publish_date, '%Y-%m-%d %H:%M:%S') AS DATE) AS date FROM article_raw)""", "article_raw"))
def explore_defaults(spark, sf_dir):
    rows = fixtures.article_raw(spark, sf_dir).select(
        F.col("seq").alias("id"), "title",
        F.try_to_timestamp("publish_date", F.lit("yyyy-MM-dd HH:mm:ss")).cast("date").alias("date"),
        F.when(F.col("author") != "Unknown", F.col("author")).alias("author"),
        F.left("content", F.lit(150)).alias("snippet"),
    )
    return explorer.with_defaults(rows)


@query("explore_page", sql.statement("""
  SELECT *, (SELECT count(*) FROM explored) > 30 AS has_next FROM explored
  ORDER BY date DESC NULLS FIRST, id DESC LIMIT 10 OFFSET 20""", "explored"))
def explore_page(spark, sf_dir):
    return explorer.page(explorer.articles(fixtures.warehouse(spark, sf_dir)), number=3, size=10)


@query("explore_dates", sql.statement("""
  SELECT id, coalesce(strftime(date, '%d/%m/%Y'), 'N/A') AS shown FROM explored""", "explored"))
def explore_dates(spark, sf_dir):
    return explorer.articles(fixtures.warehouse(spark, sf_dir)).select("id", explorer.shown_date(F.col("date")).alias("shown"))


@query("latest_news", sql.statement("""
  SELECT id, title, url, strftime(date, '%Y-%m-%d 00:00') AS published_date
  FROM explored JOIN article_metadata USING (url_hash, title) ORDER BY date DESC NULLS FIRST, id DESC LIMIT 5""",
    "explored", "article_metadata"))
def latest_news(spark, sf_dir):
    return explorer.latest_news(fixtures.warehouse(spark, sf_dir))
