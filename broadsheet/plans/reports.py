"""Reports over the star schema.

``wh`` is the dict of warehouse tables plus ``article_metadata`` (the raw
table). Page-sized reports pick their rows by key first and join names, text
and URLs to those few rows only.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.functions.text import percent, ratio
from broadsheet.operators import title_index
from broadsheet.session import BROADCAST_BYTES, broadcast_if_small, stage

Tables = dict[str, DataFrame]

SNIPPET = 150


def _dated(wh: Tables) -> DataFrame:
    return wh["fact_articles"].join(wh["dim_time"].select("time_id", "date"), "time_id", "left")


KEY_BYTES = 128  # that a page's row takes at most as a broadcast key; the longest is a digest in hexadecimal digits


def _only(table: DataFrame, page: DataFrame, key: str, rows: int) -> DataFrame:
    """Rows of ``table`` that a page of at most ``rows`` rows needs; the page's keys are broadcast if they must be few."""
    keys = page.select(key)
    return table.join(F.broadcast(keys) if rows * KEY_BYTES <= BROADCAST_BYTES else keys, key, "left_semi")


def _writers_of(wh: Tables, page: DataFrame, rows: int) -> DataFrame:
    """Article id and its author names joined by " & " in name order, for the page's articles."""
    named = _only(wh["fact_article_authors"], page, "article_id", rows).join(wh["dim_author"], "author_id")
    return named.groupBy("article_id").agg(
        F.array_join(F.array_sort(F.collect_list("author_name")), " & ").alias("author")
    )


def behind(date: Column, number: Column, last: tuple[datetime.date | None, int]) -> Column:
    """Rows that come after ``last`` (date, id), newest first with undated rows in front."""
    day, at = last
    if day is None:
        return date.isNotNull() | (number < at)
    return (date < F.lit(day)) | ((date == F.lit(day)) & (number < at))


def article_list(
    wh: Tables, q: str | None = None, limit: int = 10, offset: int = 0, after: tuple[datetime.date | None, int] | None = None
) -> DataFrame:
    """Newest articles with source, date, authors and the head of the text.

    ``q`` matches titles ignoring case; "%" and "_" in it act as wildcards, and titles without
    the letters between them are passed over by the index of titles. ``after`` is the
    (published_date, id) of the last row seen: the next page then costs the same however
    deep it lies, while an ``offset`` makes every task keep offset + limit rows.
    """
    articles = _dated(wh)
    if after is not None:
        articles = articles.filter(behind(F.col("date"), F.col("article_id"), after))
    if q and q.strip():
        found = title_index.candidates(wh["title_grams"], q.strip()) if "title_grams" in wh else None
        if found is not None:
            articles = articles.join(found, "article_id", "left_semi")
        articles = articles.filter(F.col("title").ilike(f"%{q.strip()}%"))
    newest = articles.orderBy(F.desc_nulls_first("date"), F.desc("article_id")).offset(offset).limit(limit)
    page = stage(newest, "article-page")
    head = F.concat(F.left("content", F.lit(SNIPPET)), F.lit("...")).alias("snippet")
    return (
        page.join(_only(wh["dim_source"], page, "source_id", limit), "source_id", "left")
        .join(_writers_of(wh, page, limit), "article_id", "left")
        .join(_only(wh["dim_content"], page, "content_id", limit).select("content_id", head), "content_id", "left")
        .join(_only(wh["article_metadata"], page, "url_hash", limit).select("url_hash", "url"), "url_hash", "left")
        .select(
            F.col("article_id").alias("id"), "title", "url", F.col("domain").alias("source"),
            F.col("date").alias("published_date"), "author", "snippet",
        )
        .orderBy(F.desc_nulls_first("published_date"), F.desc("id"))
    )


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias(name))


def _side_by_side(*one_row: DataFrame) -> DataFrame:
    """One-row, one-column frames as the columns of one row (scalar subqueries)."""
    spark = one_row[0].sparkSession
    return spark.range(1).select(*[df.scalar().alias(df.columns[0]) for df in one_row])


def stats_totals(wh: Tables) -> DataFrame:
    """Sources, raw articles, and chunks (shown as vectors)."""
    return _side_by_side(
        _count(wh["dim_source"], "total_sources"),
        _count(wh["article_metadata"], "total_articles"),
        _count(wh["fact_chunks"], "total_vectors"),
    )


def top_authors(wh: Tables, k: int = 5) -> DataFrame:
    """Authors with most articles and their percentage of the leader, cut to a whole number."""
    counts = wh["fact_article_authors"].groupBy("author_id").agg(F.count("*").alias("count"))
    top = (
        counts.join(wh["dim_author"], "author_id")
        .select(F.col("author_name").alias("name"), "count")
        .orderBy(F.desc("count"), "name").limit(k)
    )
    leader = F.max("count").over(Window.partitionBy())
    return top.select("name", "count", F.floor(F.col("count") / leader * 100).alias("percent"))


def source_distribution(wh: Tables) -> DataFrame:
    """Articles per source with their share of all articles."""
    counts = wh["fact_articles"].groupBy("source_id").agg(F.count("*").alias("value"))
    named = counts.join(wh["dim_source"], "source_id")
    total = named.agg(F.sum("value")).scalar()
    return named.select(
        F.col("domain").alias("name"), "value", percent(F.col("value"), total).alias("percent")
    ).orderBy(F.desc("value"), "name")


def daily_trend(wh: Tables, days: int = 7) -> DataFrame:
    """Articles per day for the latest days that have any, oldest first."""
    counts = wh["fact_articles"].groupBy("time_id").agg(F.count("*").alias("count"))
    dated = counts.join(wh["dim_time"].filter("date IS NOT NULL"), "time_id")
    latest = dated.orderBy(F.desc("date")).limit(days)
    return latest.orderBy("date").select(F.date_format("date", "dd/MM").alias("date"), "count")


def latest_articles(wh: Tables, k: int = 10) -> DataFrame:
    """Newest articles by id with source and date."""
    known = (
        wh["fact_articles"].select("article_id", "title", "source_id", "time_id")
        .join(wh["dim_source"], "source_id").join(wh["dim_time"].select("time_id", "date"), "time_id")
    )
    newest = known.orderBy(F.desc("article_id")).limit(k)
    return newest.select("article_id", "title", F.col("domain").alias("source"), F.date_format("date", "dd/MM/yyyy").alias("date"))


def monitor_metrics(wh: Tables) -> DataFrame:
    """Articles, chunks, chunks per article, raw rows without a date."""
    counts = _side_by_side(
        _count(wh["fact_articles"], "total_articles"),
        _count(wh["fact_chunks"], "total_chunks"),
        _count(wh["article_metadata"].filter("publish_date = 'Unknown'"), "date_errors"),
    )
    return counts.withColumn("avg_chunks_per_article", ratio(F.col("total_chunks"), F.col("total_articles"), 2))


def recent_authors(wh: Tables, k: int = 10) -> DataFrame:
    """Newest articles that have authors, with the author list."""
    written = wh["fact_article_authors"].join(wh["dim_author"].select("author_id"), "author_id", "left_semi")
    ids = wh["fact_articles"].select("article_id").join(written.select("article_id"), "article_id", "left_semi")
    newest = stage(ids.orderBy(F.desc("article_id")).limit(k), "newest-articles")
    titles = _only(wh["fact_articles"].select("article_id", "title"), newest, "article_id", k)
    return titles.join(_writers_of(wh, newest, k), "article_id").select(
        "article_id", "title", F.col("author").alias("authors")
    ).orderBy(F.desc("article_id"))


def latest_chunks(wh: Tables, k: int | None = None) -> DataFrame:
    """Chunks of the newest article, all or the first ``k``."""
    newest = wh["fact_articles"].agg(F.max("article_id")).scalar()
    ordered = wh["fact_chunks"].filter(F.col("article_id") == newest).select("chunk_index", "content").orderBy("chunk_index")
    return ordered.limit(k) if k else ordered


def article_chunks(wh: Tables, articles: DataFrame | None = None, article_id: int | None = None) -> DataFrame:
    """Chunks with their label and the article's chunk count, for one article or the given ones."""
    chunks = wh["fact_chunks"]
    if article_id is not None:
        chunks = chunks.filter(F.col("article_id") == article_id)
    if articles is not None:
        chunks = chunks.join(articles.select("article_id"), "article_id", "left_semi")
    # Counted on the keys alone, so that no text is sorted or sits in a window.
    counts = stage(chunks.groupBy("article_id").agg(F.count("*").alias("total_chunks")), "chunk-counts")
    return chunks.join(broadcast_if_small(counts), "article_id").select(
        "article_id",
        F.concat(F.lit("idx_"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        F.col("content").alias("text"),
        "total_chunks",
    )


def monthly_counts(wh: Tables) -> DataFrame:
    """Articles per year and month, newest first."""
    per_day = wh["fact_articles"].groupBy("time_id").agg(F.count("*").alias("n"))
    return (
        per_day.join(wh["dim_time"], "time_id").groupBy("year", "month").agg(F.sum("n").alias("articles"))
        .orderBy(F.desc("year"), F.desc("month"))
    )


def date_errors(wh: Tables, k: int = 10) -> DataFrame:
    """First raw rows whose date is unknown."""
    unknown = wh["article_metadata"].filter("publish_date = 'Unknown'")
    return unknown.select("seq", "title", "url").orderBy("seq").limit(k)


def star_sample(wh: Tables, k: int = 5) -> DataFrame:
    """Title, domain and date of the first articles."""
    joined = (
        wh["fact_articles"].select("article_id", "title", "source_id", "time_id")
        .join(wh["dim_source"], "source_id").join(wh["dim_time"].select("time_id", "date"), "time_id")
    )
    return joined.select("article_id", "title", "domain", "date").orderBy("article_id").limit(k)


def processed_total(wh: Tables) -> DataFrame:
    return _count(wh["fact_articles"], "total_processed")


def stage_status(stages: dict[str, DataFrame]) -> DataFrame:
    """Rows present after each stage, in stage order."""
    rows = None
    for position, (name, df) in enumerate(stages.items()):
        row = df.agg(F.count("*").alias("processed")).select(
            F.lit(position).alias("position"), F.lit(name).alias("component"), "processed"
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows


def source_list(wh: Tables) -> DataFrame:
    return wh["dim_source"].select("source_id", "domain").orderBy("source_id")
