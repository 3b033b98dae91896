"""Queries for the vector table."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.functions import dates, text
from broadsheet.operators import encoders
from broadsheet.plans import vectorize
from broadsheet.queryset import fixtures, report_queries, sql  # noqa: F401 - report_queries defines shared parts
from broadsheet.queryset.registry import query
from broadsheet.session import new_path, spread, stage
from broadsheet.sources import vectors as store

sql.part("chunk_export", """
  SELECT article_id, chunk_index, content, title, url, coalesce(CAST(date AS varchar), 'Unknown') AS publish_date,
    coalesce(authors, 'Unknown') AS authors
  FROM (SELECT DISTINCT article_id, chunk_index, content FROM fact_chunks)
    JOIN (SELECT article_id, title, url, date FROM loaded) USING (article_id) LEFT JOIN writers USING (article_id)""",
         "fact_chunks", "loaded", "writers")

_DIGEST = "sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(concat('article_', article_id, '_chunk_', chunk_index)))"
_SECONDS = "CAST(coalesce(epoch(try_strptime(left(publish_date, 10), '%Y-%m-%d')), 0) AS BIGINT)"

sql.part("points", f"""
  SELECT *, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-',
      substr('89ab', 1 + (CAST('0x' || substr(h, 17, 1) AS INTEGER) & 3), 1), substr(h, 18, 3), '-', substr(h, 21, 12)) AS id,
    {_SECONDS} AS publish_timestamp
  FROM (SELECT *, {_DIGEST} AS h FROM chunk_export)""", "chunk_export")


def token_parts(prefix: str, source: str, key: str, content: str, dim: int) -> None:
    """SQL parts ``<prefix>_sparse`` and ``<prefix>_dense`` for the texts of ``source``."""
    sql.part(f"{prefix}_tokens", rf"""
      SELECT {key}, token, count(*) AS tf, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % 262144 AS token_id,
        1 - 2 * (CAST('0x' || substr(md5(token), 9, 1) AS BIGINT) % 2) AS sign
      FROM (SELECT {key}, unnest(regexp_extract_all(lower({content}), '[\p{{L}}\p{{N}}]+')) AS token FROM {source})
      GROUP BY {key}, token""", source)
    sql.part(f"{prefix}_sparse", f"""
      SELECT {key}, token_id, max(round(1 + ln(tf), 6)) AS weight FROM {prefix}_tokens GROUP BY {key}, token_id""",
             f"{prefix}_tokens")
    sql.part(f"{prefix}_dense", f"""
      SELECT {key}, slot, CAST(CASE WHEN length > 0 THEN total / length ELSE total END AS FLOAT) AS value FROM (
        SELECT *, sqrt(sum(total * total) OVER (PARTITION BY {key})) AS length FROM (
          SELECT {key}, token_id % {dim} AS slot, CAST(sum(tf * sign) AS BIGINT) AS total FROM {prefix}_tokens
          GROUP BY {key}, token_id % {dim}))""", f"{prefix}_tokens")


token_parts("c", "points", "id", "content", 1024)


def _export(spark, sf_dir):
    return fixtures.once(spark, sf_dir, "chunk_export", lambda: spread(stage(
        vectorize.with_point_id(vectorize.chunk_export(fixtures.warehouse(spark, sf_dir))), "chunk-export")))


@query("chunk_export", sql.statement("SELECT * FROM chunk_export", "chunk_export"))
def chunk_export(spark, sf_dir):
    export = vectorize.chunk_export(fixtures.warehouse(spark, sf_dir))
    return export.withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


@query("point_id", sql.statement("SELECT article_id, chunk_index, id FROM points", "points"))
def point_id(spark, sf_dir):
    chunks = fixtures.warehouse(spark, sf_dir)["fact_chunks"]
    return chunks.select(
        "article_id", F.col("chunk_index").cast("bigint").alias("chunk_index"),
        text.point_id(F.col("article_id"), F.col("chunk_index")).alias("id"),
    )


@query("incremental_chunks", sql.statement(
    "SELECT id FROM points WHERE article_id > (SELECT avg(article_id) FROM fact_articles)", "points", "fact_articles"))
def incremental_chunks(spark, sf_dir):
    """Chunks without a point when the first half of the articles is stored."""
    export = _export(spark, sf_dir)
    middle = fixtures.warehouse(spark, sf_dir)["fact_articles"].agg(F.avg("article_id")).scalar()
    stored = export.filter(F.col("article_id") <= middle)
    return vectorize.not_stored(export, stored).select("id")


@query("encode_dense", sql.statement(
    "SELECT id, slot, value FROM c_dense WHERE value <> 0", "c_dense"))
def encode_dense(spark, sf_dir):
    """Non-zero entries of every chunk's dense vector."""
    # Exploding the expression itself: a named column would also be filtered on, and computed twice.
    entries = _export(spark, sf_dir).select(
        "id", F.posexplode(encoders.encode_dense(F.col("content"))).alias("slot", "value"))
    return entries.filter("value <> 0").withColumn("slot", F.col("slot").cast("bigint"))


@query("encode_sparse", sql.statement("SELECT id, token_id, weight FROM c_sparse", "c_sparse"))
def encode_sparse(spark, sf_dir):
    return _export(spark, sf_dir).select(
        "id", F.explode(encoders.encode_sparse(F.col("content"))).alias("token_id", "weight"))


@query("publish_ts", sql.statement(
    f"SELECT seq, {_SECONDS} AS publish_timestamp FROM article_raw", "article_raw"))
def publish_ts(spark, sf_dir):
    rows = fixtures.article_raw(spark, sf_dir)
    return rows.select("seq", dates.publish_seconds(F.col("publish_date")).alias("publish_timestamp"))


_FLAT = ["article_id", "chunk_index", "title", "url", "content", "authors", "publish_timestamp"]
_POINTS_SQL = f"""
  SELECT p.id, {", ".join("p." + c for c in _FLAT)}, d.slots, s.tokens FROM points p
    LEFT JOIN (SELECT id, count(*) FILTER (value <> 0) AS slots FROM c_dense GROUP BY id) d ON p.id = d.id
    LEFT JOIN (SELECT id, count(*) AS tokens FROM c_sparse GROUP BY id) s ON p.id = s.id"""


def _flat(points):
    """Point id, payload fields, used slots and stored tokens."""
    payload = [F.col(f"payload.{c}").alias(c) for c in _FLAT]
    slots = F.size(F.filter("dense", lambda v: v != 0)).cast("bigint")
    some = F.size("sparse") > 0
    return points.select(
        "id", *payload, F.when(some, slots).alias("slots"), F.when(some, F.size("sparse").cast("bigint")).alias("tokens")
    ).withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


@query("vector_points", sql.statement(_POINTS_SQL, "points", "c_dense", "c_sparse"))
def vector_points(spark, sf_dir):
    return _flat(vectorize.build_points(_export(spark, sf_dir)))


@query("vector_upsert", sql.statement(
    _POINTS_SQL.replace("p.title", "CASE WHEN p.article_id % 2 = 0 THEN concat('v2 ', p.title) ELSE p.title END AS title"),
    "points", "c_dense", "c_sparse"))
def vector_upsert(spark, sf_dir):
    """Points of every second article replaced by new ones of the same id, in a later run of a table of its own."""
    points = fixtures.points(spark, sf_dir)
    titled = F.col("payload").withField("title", F.concat(F.lit("v2 "), F.col("payload.title")))
    updates = points.filter("payload.article_id % 2 = 0").withColumn("payload", titled)
    path = new_path(spark, "vectors-upsert")
    store.write_vectors(points, path, run_id=1)
    store.write_vectors(updates, path, run_id=2, replace=True)
    return _flat(store.load_vectors(spark, path))


@query("vector_init", sql.statement("SELECT 1024 AS dim, 'cosine' AS metric, count(*) AS points FROM points", "points"))
def vector_init(spark, sf_dir):
    """Creating the table again leaves its points; dimension and metric come from the stored column."""
    path = new_path(spark, "vectors-init")
    store.write_vectors(fixtures.points(spark, sf_dir), path, run_id=0)
    store.init_vectors(spark, path)
    kept = spark.read.parquet(path)
    about = kept.schema["dense"].metadata
    return store.load_vectors(spark, path).agg(F.count("*").alias("points")).select(
        F.lit(about["dim"]).alias("dim"), F.lit(about["metric"]).alias("metric"), "points"
    )


@query("vector_reset", sql.statement("SELECT count(*) AS points_before, 0::BIGINT AS points_left FROM points", "points"))
def vector_reset(spark, sf_dir):
    """Points of a copy of the table before and after it is dropped."""
    path = new_path(spark, "vectors-reset")
    store.write_vectors(fixtures.points(spark, sf_dir), path, run_id=1)
    before = fixtures.once_now(store.load_vectors(spark, path).agg(F.count("*").alias("points_before")))
    store.drop_vectors(spark, path)
    left = store.load_vectors(spark, path).agg(F.count("*")).scalar()
    return before.select("points_before", left.alias("points_left"))


@query("vectorize_run", sql.statement(
    "SELECT count(*) AS first_run, count(*) AS second_run, count(DISTINCT id) AS ids FROM points", "points"))
def vectorize_run(spark, sf_dir):
    """Points after the job and after the same job again."""
    path, wh = new_path(spark, "vectors-run"), fixtures.warehouse(spark, sf_dir)
    first = fixtures.once_now(vectorize.run_vectorize(spark, wh, path, 1).agg(F.count("*").alias("first_run")))
    again = vectorize.run_vectorize(spark, wh, path, 2)
    return first.select(
        "first_run", again.agg(F.count("*")).scalar().alias("second_run"), again.agg(F.countDistinct("id")).scalar().alias("ids")
    )
