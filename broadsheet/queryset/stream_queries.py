"""Queries for the topic and streaming ingest.

The topic is a folder in the broker's record shape, filled by Spark from the
given tables; each streaming job runs until it has drained it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.functions import urls
from broadsheet.queryset import fixtures, sql
from broadsheet.queryset.registry import query
from broadsheet.session import new_path
from broadsheet.sources import topic
from broadsheet.streaming import ingest

sql.part("records", """
  SELECT event_id AS "offset", CASE WHEN event_id % 97 = 0 THEN left(body, length(body) - 1) ELSE body END AS value, url, title, event_type
  FROM (SELECT *, concat('{', CASE WHEN title IS NULL THEN '' ELSE concat('"title":"', title, '",') END,
      '"content":"', event_type, '","url":"', url, '"}') AS body
    FROM (SELECT event_id, event_type, CASE WHEN event_id % 17 = 0 THEN NULL ELSE concat(event_type, ' ', event_id) END AS title,
        CASE WHEN event_id % 29 = 0 THEN '' ELSE concat('https://ev', (event_id - event_id % 3) % 50, '.example.com/',
          event_id - event_id % 3, '.html') END AS url FROM events))""")
sql.part("decoded", """
  SELECT "offset" * 1048576 AS seq, value AS content, "offset" % 97 = 0 AS broken, CASE WHEN "offset" % 97 = 0 THEN NULL ELSE url END AS url,
    CASE WHEN "offset" % 97 = 0 THEN NULL ELSE coalesce(title, 'Unknown Title') END AS title FROM records""", "records")
sql.part("usable", "SELECT *, sha256(url) AS url_hash FROM decoded WHERE NOT broken AND url <> ''", "decoded")
sql.part("firsts", """
  SELECT * FROM usable QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY seq) = 1""", "usable")


def _topic_path(spark, sf_dir) -> str:
    def make():
        path = new_path(spark, "topic")
        fixtures.news_events(spark, sf_dir).write.parquet(path)
        return path

    return fixtures.once(spark, sf_dir, "topic", make)


def _ingested(spark, sf_dir) -> str:
    """Folder of the raw table after the whole topic was ingested."""

    def make():
        path = new_path(spark, "ingest")
        records = topic.read_stream(spark, _topic_path(spark, sf_dir))
        ingest.start(records, path, new_path(spark, "ingest-progress")).awaitTermination()
        return path

    return fixtures.once(spark, sf_dir, "ingested", make)


_ITEM_JSON = """json_object('title', title, 'content', content, 'url', url, 'source', regexp_extract(url, '^[a-z]+://([^/]*)', 1),
  'author', author, 'publish_date', publish_date)"""


@query("event_encode", sql.statement(f"SELECT seq, CAST({_ITEM_JSON} AS varchar) AS value FROM article_raw", "article_raw"))
def event_encode(spark, sf_dir):
    return topic.encode(fixtures.article_items(spark, sf_dir)).select("seq", "value")


@query("stream_sink", sql.statement(f'SELECT seq AS "offset", CAST({_ITEM_JSON} AS varchar) AS value FROM article_raw', "article_raw"))
def stream_sink(spark, sf_dir):
    """Items streamed into the topic, then read from it."""
    items_path, topic_path = new_path(spark, "items"), new_path(spark, "items-topic")
    items = fixtures.article_items(spark, sf_dir)
    items.write.parquet(items_path)
    stream = spark.readStream.schema(items.schema).parquet(items_path)
    records = topic.encode(stream).select(
        F.lit(None).cast("string").alias("key"), "value", F.lit(topic.TOPIC).alias("topic"), F.lit(0).alias("partition"),
        F.col("seq").alias("offset"), F.current_timestamp().alias("timestamp"),
    )
    topic.write_stream(records, new_path(spark, "items-progress"), topic_path).awaitTermination()
    return topic.read_batch(spark, topic_path).select("offset", "value")


@query("stream_source", sql.statement('SELECT "offset", value FROM records', "records"))
def stream_source(spark, sf_dir):
    """Every record of the topic from the earliest offset on, as a streaming job saw it."""
    out = new_path(spark, "seen")
    records = topic.read_stream(spark, _topic_path(spark, sf_dir)).select("offset", "value")
    progress = new_path(spark, "seen-progress")
    writer = records.writeStream.format("parquet").option("checkpointLocation", progress).trigger(availableNow=True)
    writer.start(out).awaitTermination()
    return spark.read.schema(records.schema).parquet(out)


@query("stream_peek", sql.statement('SELECT "offset", value FROM records ORDER BY "offset" LIMIT 5', "records"))
def stream_peek(spark, sf_dir):
    return topic.peek(topic.read_batch(spark, _topic_path(spark, sf_dir))).select("offset", "value")


def _decoded(spark, sf_dir):
    return ingest.decode(topic.read_batch(spark, _topic_path(spark, sf_dir)))


@query("event_decode", sql.statement("""
  SELECT seq, url, coalesce(title, 'Unknown Title') AS title, 'Unknown' AS author, NULL::varchar AS publish_date, content, broken
  FROM decoded""", "decoded"))
def event_decode(spark, sf_dir):
    """Fields are only compared for readable records; a broken one shows what could be read as NULL."""
    rows = _decoded(spark, sf_dir)
    url = F.when(~F.col("broken"), F.col("url")).alias("url")
    title = F.when(~F.col("broken"), F.col("title")).otherwise(F.lit(ingest.UNKNOWN_TITLE)).alias("title")
    return rows.select("seq", url, title, "author", "publish_date", "content", "broken")


@query("event_filter", sql.statement("SELECT seq, url FROM usable", "usable"))
def event_filter(spark, sf_dir):
    return ingest.usable(_decoded(spark, sf_dir)).select("seq", "url")


@query("url_hash", "SELECT page_id, sha256(url) AS url_hash FROM pages")
def url_hash(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "pages").select("page_id", urls.url_hash(F.col("url")).alias("url_hash"))


@query("stream_dedup", sql.statement("SELECT seq, url_hash, url, title, content FROM firsts", "firsts"))
def stream_dedup(spark, sf_dir):
    """The raw table after ingest: one row per URL, the first arrival."""
    return ingest.read_raw(spark, _ingested(spark, sf_dir)).select("seq", "url_hash", "url", "title", "content")


@query("stream_dead_letter", sql.statement("SELECT seq, content AS value FROM decoded WHERE broken", "decoded"))
def stream_dead_letter(spark, sf_dir):
    return ingest.read_dead(spark, _ingested(spark, sf_dir)).select("seq", "value")


@query("stream_run", sql.statement("""
  SELECT (SELECT count(*) FROM firsts) AS first_run, (SELECT count(*) FROM firsts) AS second_run,
    (SELECT count(DISTINCT url_hash) FROM usable) AS urls""", "firsts", "usable"))
def stream_run(spark, sf_dir):
    """Rows after a drain, and after the same records arrive once more in a restarted job."""
    path, progress, folder = new_path(spark, "rerun"), new_path(spark, "rerun-progress"), new_path(spark, "rerun-topic")
    records = fixtures.news_events(spark, sf_dir)
    records.write.parquet(folder)
    ingest.start(topic.read_stream(spark, folder), path, progress).awaitTermination()
    first = fixtures.once_now(ingest.read_raw(spark, path).agg(F.count("*").alias("first_run")))
    again = F.col("offset") + records.agg(F.max("offset")).scalar() + 1
    records.withColumn("offset", again).write.mode("append").parquet(folder)
    ingest.start(topic.read_stream(spark, folder), path, progress).awaitTermination()
    raw = ingest.read_raw(spark, path)
    return first.select(
        "first_run", raw.agg(F.count("*")).scalar().alias("second_run"), raw.agg(F.countDistinct("url_hash")).scalar().alias("urls"))


@query("stream_watermark_dedup", sql.statement("SELECT DISTINCT url_hash FROM usable", "usable"))
def stream_watermark_dedup(spark, sf_dir):
    """URLs of the raw table after an ingest that drops near repeats before the exact check."""
    path = new_path(spark, "recent")
    records = topic.read_stream(spark, _topic_path(spark, sf_dir))
    ingest.start(records, path, new_path(spark, "recent-progress"), delay="60 days").awaitTermination()
    return ingest.read_raw(spark, path).select("url_hash")
