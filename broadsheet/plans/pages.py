"""Stored pages -> article items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet import schemas
from broadsheet.functions import authors, dates, html, page_fields, urls
from broadsheet.operators.page_parser import parse
from broadsheet.operators.tail_author import tail_author


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, page: each page parsed once; its markup goes no further."""
    return pages.select("page_id", "url", parse(F.col("html")).alias("page"))


def page_items(pages: DataFrame) -> DataFrame:
    """One item per page with enough text; the page id is kept in front.

    A byline is looked for in the page's own declaration, the known places, the
    last paragraphs, then falls back to a demoted declaration, the meta author
    and the word "Unknown".
    """
    # One row or none for each page: its text is put together once, and then filtered on.
    long = F.inline(F.filter(F.array(F.struct(html.page_text().alias("content"))), lambda row: F.length(row["content"]) >= page_fields.MIN_TEXT))
    owned = parsed(pages).select("*", long).withColumn("own", page_fields.own_byline())
    kept = (F.col("own") != "") & ~authors.demoted(F.col("own"))
    author = F.coalesce(
        F.when(kept, F.col("own")), page_fields.cascade(), tail_author(),
        F.when(authors.demoted(F.col("own")), F.col("own")), page_fields.meta_author(), F.lit("Unknown"),
    )
    return owned.select(
        "page_id", html.page_title().alias("title"), "content", "url",
        urls.authority(F.col("url")).alias("source"), author.alias("author"),
        dates.render_date(page_fields.publish_date(F.col("url"))).alias("publish_date"),
    ).select("page_id", *schemas.ITEM.names)
