"""Filters and views of the article explorer, over ``reports.article_list`` shaped rows."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.plans.reports import Tables, behind
from broadsheet.session import broadcast_if_small, stage

ALL_SOURCES = "All Sources"

# What the explorer shows for an absent field.
DEFAULTS = {"source": "Unknown", "date": "N/A", "author": "Tác giả", "snippet": "Không có tóm tắt...", "url": "#"}


def articles(wh: Tables) -> DataFrame:
    """Every article with source and date, unsorted."""
    return (
        wh["fact_articles"].select("article_id", "title", "url_hash", "source_id", "time_id")
        .join(wh["dim_source"], "source_id", "left")
        .join(wh["dim_time"].select("time_id", "date"), "time_id", "left")
        .select(F.col("article_id").alias("id"), "title", "url_hash", F.col("domain").alias("source"), "date")
    )


def first_of_source(rows: DataFrame, source: str = ALL_SOURCES, k: int = 10) -> DataFrame:
    """Newest ``k`` rows of one source, or of all."""
    wanted = rows if source == ALL_SOURCES else rows.filter(F.col("source") == source)
    return wanted.orderBy(F.desc_nulls_first("date"), F.desc("id")).limit(k)


def in_date_range(rows: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Rows dated from ``start`` to ``end``, both included; an empty bound is open."""
    if start:
        rows = rows.filter(F.col("date") >= F.lit(start).cast("date"))
    if end:
        rows = rows.filter(F.col("date") <= F.lit(end).cast("date"))
    return rows


def with_defaults(rows: DataFrame) -> DataFrame:
    """Absent or empty fields as the explorer words them; the date becomes text."""
    out = rows.withColumn("date", F.col("date").cast("string"))
    for column, default in DEFAULTS.items():
        if column in out.columns:
            shown = F.coalesce(F.col(column), F.lit(""))
            out = out.withColumn(column, F.when(shown == "", F.lit(default)).otherwise(shown))
    return out


def page(rows: DataFrame, number: int, size: int, after: tuple[datetime.date | None, int] | None = None) -> DataFrame:
    """Page ``number`` (from 1), with ``has_next`` from one row looked ahead.

    With ``after``, the (date, id) of the last row seen, pages are counted from there, so
    page 1 is the next one and costs the same however deep it lies.
    """
    if after is not None:
        rows = rows.filter(behind(F.col("date"), F.col("id"), after))
    newest = [F.desc_nulls_first("date"), F.desc("id")]
    ahead = rows.orderBy(*newest).offset((number - 1) * size).limit(size + 1)
    # The windows below see at most size + 1 rows.
    placed = ahead.withColumn("_place", F.row_number().over(Window.orderBy(*newest)))
    looked = placed.withColumn("has_next", F.count("*").over(Window.partitionBy()) > size)
    return looked.filter(F.col("_place") <= size).drop("_place")


def shown_date(date: Column) -> Column:
    """dd/MM/yyyy, or the default for an absent date."""
    return F.coalesce(F.date_format(date, "dd/MM/yyyy"), F.lit(DEFAULTS["date"]))


def latest_news(wh: Tables, k: int = 5) -> DataFrame:
    """Newest titles with a date cut to 16 characters."""
    newest = stage(first_of_source(articles(wh), k=k), "latest-news")
    addresses = wh["article_metadata"].select("url_hash", "url").join(
        broadcast_if_small(newest.select("url_hash")), "url_hash", "left_semi")
    shown = F.replace(F.left(F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(16)), F.lit("T"), F.lit(" "))
    return newest.join(addresses, "url_hash", "left").select("id", "title", "url", shown.alias("published_date"))
