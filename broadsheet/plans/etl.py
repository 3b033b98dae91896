"""Raw table -> star schema, loading only what is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.functions import authors, dates, text, urls
from broadsheet.operators import chunking
from broadsheet.operators.merging import add_names, first_per_key
from broadsheet.operators.numbering import highest, number_rows
from broadsheet.session import broadcast_if_small, side_by_side, stage
from broadsheet.sources import warehouse as store

BEFORE_ALL = -(2**63)

ITEM_FIELDS = "author string, publish_date string, content string, _broken string"


def select_new(raw: DataFrame, facts: DataFrame, strict: bool = True) -> DataFrame:
    """Keys of the rows to load: URL not loaded yet, first row of each title.

    Works on three narrow columns, so article text is not shuffled here. With
    ``strict`` a title that is already loaded is left out too, which makes a
    repeated load a no-op; without it such a row under another URL is loaded.
    """
    keys = raw.select("seq", "url_hash", "title")
    fresh = keys.join(facts.select("url_hash"), "url_hash", "left_anti").select("seq", "url_hash", "title")
    if strict:
        # A loaded title takes part as its own first row: one grouping settles both rules.
        loaded = facts.select(F.lit(BEFORE_ALL).alias("seq"), F.lit(None).cast("string").alias("url_hash"), "title")
        fresh = fresh.unionByName(loaded)
    return first_per_key(fresh, "title", "seq").filter(F.col("url_hash").isNotNull())


def parse_items(raw: DataFrame) -> DataFrame:
    """Author, date and body from the raw JSON; ``broken`` marks unreadable JSON."""
    item = F.from_json("content", ITEM_FIELDS, {"columnNameOfCorruptRecord": "_broken"})
    return raw.withColumn("_item", item).select(
        *[c for c in raw.columns if c not in ("content", "author", "publish_date")],
        F.col("_item.author").alias("author"),
        F.col("_item.publish_date").alias("publish_date"),
        F.col("_item.content").alias("content"),
        (F.col("_item").isNull() | F.col("_item._broken").isNotNull()).alias("broken"),
    )


def reject_reason(author: Column, publish_date: Column, title: Column, broken: Column) -> Column:
    """Why a row is not loaded, NULL if it is. The gate comes before the date check."""
    return (
        F.when(broken, "bad_json")
        .when(text.missing(author) | (author == "[]"), "missing_author")
        .when(text.missing(publish_date), "missing_date")
        .when(dates.date_key(publish_date).isNull(), "bad_date")
        .when(title.isNull(), "no_title")
    )


def status_of(reason: Column) -> Column:
    """``skipped`` for rows the gate dropped, ``error`` for unusable ones, ``ok`` otherwise."""
    return (
        F.when(reason.isNull(), "ok")
        .when(F.startswith(reason, F.lit("missing")), "skipped")
        .otherwise("error")
    )


def prepare(rows: DataFrame) -> DataFrame:
    """Cleaned and judged rows; expects the columns of the raw table."""
    reason = reject_reason(F.col("author"), F.col("publish_date"), F.col("title"), F.col("broken"))
    judged = parse_items(rows).withColumn("reason", reason).withColumn("status", status_of(F.col("reason")))
    ok = F.col("status") == "ok"
    return judged.select(
        *[c for c in rows.columns if c not in ("content", "author", "publish_date")],
        "status",
        "reason",
        urls.domain(F.col("url")).alias("domain"),
        F.when(ok, dates.date_key(F.col("publish_date"))).alias("date"),
        F.when(ok, authors.author_list(F.col("author"))).alias("authors"),
        F.when(ok, text.clean_text(F.col("content"))).alias("text"),
    )


def counters(judged: DataFrame) -> DataFrame:
    """Found, processed, skipped and failed rows in one row."""
    return judged.agg(
        F.count("*").alias("found"),
        F.count_if(F.col("status") == "ok").alias("processed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )


def date_parts(dates_df: DataFrame) -> DataFrame:
    return dates_df.select(
        "*", F.dayofmonth("date").alias("day"), F.month("date").alias("month"), F.year("date").alias("year")
    )


def run_etl(
    spark: SparkSession,
    raw: DataFrame,
    path: str,
    run_id: int,
    strict: bool = True,
    chunks=None,
) -> dict[str, DataFrame]:
    """Load the new rows of ``raw`` into the warehouse at ``path`` as run ``run_id``.

    Article text moves once: the rows to load are chosen on keys, joined to the
    text, and written to one staged table that every target table reads.
    """
    store.init_warehouse(spark, path)
    known = store.load_warehouse(spark, path, before_run=run_id)
    facts = known["fact_articles"]

    last_article, last_content = side_by_side(
        spark, lambda: highest(facts, "article_id"), lambda: highest(known["dim_content"], "content_id")
    )
    chosen = number_rows(select_new(raw, facts, strict).select("url_hash", "seq"), ["seq"], "article_id", last_article)
    wanted = raw.join(broadcast_if_small(chosen.select("url_hash", "article_id")), "url_hash")
    judged = stage(prepare(wanted), "etl-judged")
    loaded = judged.filter("status = 'ok'")
    names = loaded.select("article_id", F.explode(F.array_distinct("authors")).alias("author_name"))
    content_id = F.col("article_id") + F.lit(last_content - last_article)

    def dimension(table: str, values: DataFrame, key: str, id_column: str) -> DataFrame:
        new = number_rows(add_names(known[table], values, key), [key], id_column, highest(known[table], id_column))
        new = date_parts(new) if table == "dim_time" else new
        return known[table].unionByName(store.write_run(new, path, table, run_id))

    def content() -> None:
        texts = loaded.select(content_id.alias("content_id"), "url_hash", F.col("text").alias("content"))
        store.write_run(texts, path, "dim_content", run_id)

    def chunk() -> None:
        cut = chunking.explode_chunks(loaded.select("article_id", "text"), "text", chunks or chunking.chunk_column())
        keyed = cut.withColumn("chunk_id", chunking.chunk_key(F.col("article_id"), F.col("chunk_index")))
        store.write_run(keyed, path, "fact_chunks", run_id)

    sources, times, writers, *_ = side_by_side(
        spark,
        lambda: dimension("dim_source", loaded, "domain", "source_id"),
        lambda: dimension("dim_time", loaded, "date", "time_id"),
        lambda: dimension("dim_author", names, "author_name", "author_id"),
        content,
        chunk,
        lambda: store.write_run(judged.filter("status <> 'ok'"), path, "quarantine", run_id),
        lambda: store.write_grams(loaded.select("article_id", "title"), path, run_id),
    )
    # A source or author may own a large share of the rows; while the names fit a broadcast nothing is grouped by them.
    writers, sources = broadcast_if_small(writers), broadcast_if_small(sources.select("domain", "source_id"))
    bridge = names.join(writers, "author_name").select("article_id", "author_id")
    articles = (
        loaded.select("article_id", "url_hash", "title", "domain", "date", F.length("text").alias("content_length"))
        .join(sources, "domain")
        .join(times.select("date", "time_id"), "date")
        .withColumn("content_id", content_id)
    )
    side_by_side(
        spark,
        lambda: store.write_run(bridge, path, "fact_article_authors", run_id),
        lambda: store.write_run(articles, path, "fact_articles", run_id),
    )
    store.write_run(counters(judged), path, store.RUN_LOG, run_id)
    return store.load_warehouse(spark, path)
