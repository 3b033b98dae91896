"""Inputs of the registered queries, all derived from the given tables by Spark.

The warehouse and the vector table are built once per session and data folder
and then read from their files, as any report would read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from broadsheet.functions import urls
from broadsheet.operators import topk
from broadsheet.plans import answers, etl, search, vectorize
from broadsheet.session import broadcast_if_small, new_path, spread, stage
from broadsheet.sources import warehouse as store

_built: dict[tuple, object] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make):
    """Result of ``make()`` kept for this session and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _built:
        _built[key] = make()
    return _built[key]


def once_now(df: DataFrame) -> DataFrame:
    """Evaluate ``df`` at this point, before the folders it reads change."""
    return stage(df, "snapshot")


# Tables with long texts, which get costly row work.
_TEXTS = {"documents", "pages"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan) if name in _TEXTS else scan


def article_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with repeated URLs and titles, unknown authors, unknown and malformed dates."""
    docs = table(spark, sf_dir, "documents")
    uid = F.when(F.col("doc_id") % 10 == 9, F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    which = F.col("doc_id") % 7
    author = (
        F.when(which == 0, "Unknown").when(which == 1, "Nguyễn A, Trần B").when(which == 2, "Lê C và Phạm D")
        .when(which == 3, "Hoàng E (TTXVN) - Vũ F")
        .otherwise(F.concat(F.lit("Writer "), (F.col("doc_id") % 13).cast("string")))
    )

    def two(number):
        return F.lpad(number.cast("string"), 2, "0")

    day = F.concat_ws("-", F.lit("2024"), two(1 + F.col("doc_id") % 12), two(1 + F.col("doc_id") % 28))
    date = (
        F.when(F.col("doc_id") % 11 == 0, "Unknown").when(F.col("doc_id") % 53 == 0, "31/12/2023 10:00")
        .otherwise(F.concat(day, F.lit(" 08:30:00")))
    )
    return docs.withColumn("uid", uid).select(
        F.col("doc_id").alias("seq"),
        F.concat(
            F.lit("https://src"), (F.col("uid") % 20).cast("string"), F.lit(".example.com/"),
            F.col("uid").cast("string"), F.lit(".html"),
        ).alias("url"),
        F.trim(F.left(F.split_part("text", F.lit("."), F.lit(1)), F.lit(80))).alias("title"),
        F.col("text").alias("content"),
        author.alias("author"),
        date.alias("publish_date"),
    )


def article_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``article_raw`` with the source host, as the page job would emit it."""
    return article_raw(spark, sf_dir).withColumn("source", urls.authority(F.col("url")))


def raw_rows(items: DataFrame) -> DataFrame:
    """Items in the shape of the raw table: URL key and the whole item as JSON."""
    body = F.to_json(F.struct("title", "content", "url", "source", "author", "publish_date"))
    return items.select(
        "seq", urls.url_hash(F.col("url")).alias("url_hash"), "url", "title", body.alias("content"), "author", "publish_date"
    )


def article_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw table: one row per URL, first arrival wins."""

    def make():
        # Only URLs that arrive again are looked up, so the text of the others need not move.
        rows = raw_rows(article_items(spark, sf_dir)).filter(F.col("url_hash").isNotNull() & F.col("seq").isNotNull())
        again = rows.groupBy("url_hash").agg(F.min("seq").alias("_first"), F.max("seq").alias("_last")).filter("_first < _last")
        again = broadcast_if_small(stage(again.select(F.col("url_hash").alias("_again"), "_first"), "repeated-urls"))
        later = (F.col("url_hash") == F.col("_again")) & (F.col("seq") > F.col("_first"))
        return stage(rows.join(again, later, "left_anti"), "article_metadata")

    return once(spark, sf_dir, "article_metadata", make)


def warehouse_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the star schema after one load."""

    def make():
        path = new_path(spark, "warehouse")
        etl.run_etl(spark, article_metadata(spark, sf_dir), path, run_id=1)
        return path

    return once(spark, sf_dir, "warehouse_path", make)


def warehouse(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Star schema after one load, plus the raw table."""

    def make():
        tables = store.load_warehouse(spark, warehouse_path(spark, sf_dir))
        return {**tables, "article_metadata": article_metadata(spark, sf_dir)}

    return once(spark, sf_dir, "warehouse", make)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector table of the warehouse's chunks."""
    return once(
        spark, sf_dir, "points",
        lambda: vectorize.run_vectorize(spark, warehouse(spark, sf_dir), new_path(spark, "vectors"), run_id=1),
    )


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as queries, and further ones that are blank or hold no letter."""
    items = table(spark, sf_dir, "benchmark")
    blank = F.when(F.col("item_id") % 2 == 0, "   ").otherwise("?! ...")
    return items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), "text").unionByName(
        items.select((-1 - F.col("item_id")).alias("query_id"), blank.alias("query"), "text"))


def encoded_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = search.accepted_queries(search_queries(spark, sf_dir).select("query_id", "query"))
    return once(spark, sf_dir, "encoded_queries", lambda: stage(search.encode_queries(queries), "encoded-queries"))


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one scan of the points finds for the benchmark queries."""
    return once(spark, sf_dir, "scanned", lambda: search.scan(points(spark, sf_dir), encoded_queries(spark, sf_dir)))


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "hybrid", lambda: stage(search.fused(scanned(spark, sf_dir)), "hybrid"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search hits of the benchmark queries."""

    def make():
        held = topk.held_by(scanned(spark, sf_dir))
        best = search.rerank(points(spark, sf_dir), encoded_queries(spark, sf_dir), hybrid(spark, sf_dir), held=held)
        return stage(search.shape_hits(best), "hits")

    return once(spark, sf_dir, "hits", make)


def hit_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per accepted query with its hits."""
    queries = search.accepted_queries(search_queries(spark, sf_dir))
    return search.hit_lists(queries, hits(spark, sf_dir))


def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model per language of the documents, in language order."""
    langs = table(spark, sf_dir, "documents").select("lang").distinct()
    return langs.select(
        F.row_number().over(Window.orderBy("lang")).alias("position"),  # a handful of languages
        F.concat(F.lit("m_"), F.col("lang")).alias("name"), F.concat("lang", F.lit("-1")).alias("model_id"),
        F.lit("local").alias("provider"),
    )


def models(spark: SparkSession, sf_dir: str) -> list[answers.Model]:
    return once(spark, sf_dir, "models", lambda: answers.registry(model_table(spark, sf_dir)))


_ARTICLES, _REST = (answers.SYSTEM_PROMPT + "\n\n" + answers.HUMAN_PROMPT).split("{context}")
_QUESTION, _CLOSING = _REST.split("{question}")


def _echo():
    def reply(prompts: list[str]) -> list[str]:
        return [p.removesuffix(_CLOSING).rsplit(_QUESTION, 1)[1] for p in prompts]

    return reply


def _lead():
    def reply(prompts: list[str]) -> list[str]:
        return [p.removeprefix(_ARTICLES).rsplit(_QUESTION, 1)[0].split("\n\n[2] ")[0] for p in prompts]

    return reply


def _broken():
    raise ValueError("model is not available")


def generators(registered: list[answers.Model]) -> dict[str, answers.Loader]:
    """The first model repeats the question, the second the first context block, the others cannot be loaded."""
    kinds = [_echo, _lead] + [_broken] * len(registered)
    return {model.name: kind for model, kind in zip(registered, kinds)}


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query with hits answered by every model."""

    def make():
        registered = models(spark, sf_dir)
        with_hits = hit_lists(spark, sf_dir).filter(F.size("results") > 0)
        prompt = answers.prompt(answers.context(F.col("results")), F.col("query"))
        asked = answers.per_model(with_hits.withColumn("prompt", prompt), registered)
        return stage(answers.generate(asked, generators(registered)), "compared")

    return once(spark, sf_dir, "compared", make)


def pages_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with bylines and dates put right after the article tag."""
    dates = ["" for _ in range(6)]
    dates[0] = '<meta property="article:published_time" content="2024-04-06T19:33:00+07:00">'
    dates[1] = '<time datetime="2024-04-07 08:05">x</time>'
    dates[2] = '<span class="date">Thứ hai, 6/4/2024, 17:02</span>'
    dates[3] = '<span class="date">14:29 06/02/2024</span>'
    dates[4] = '<meta name="pubdate" content="31/02/2024 10:00"><span class="date">05/03/2024</span>'
    bylines = ["" for _ in range(7)]
    bylines[0] = '<a rel="author">Nguyễn Văn A</a>'
    bylines[1] = '<span class="author-name">Trần B • 15 phút</span>'
    bylines[2] = '<span class="author">Ban biên tập</span>'
    bylines[3] = '<span class="author">Lê C - 0912 345 678</span>'
    bylines[4] = '<span class="author">15/12/2023</span><meta name="author" content="Phạm D">'
    bylines[5] = '<p style="text-align:right"><strong>Vũ E</strong></p>'
    extra = F.concat(
        F.lit("<article>"),
        F.get(F.array(*map(F.lit, dates)), (F.col("page_id") % 6).cast("int")),
        F.get(F.array(*map(F.lit, bylines)), (F.col("page_id") % 7).cast("int")),
    )
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", F.replace("html", F.lit("<article>"), extra).alias("html"))


def news_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic records in the broker's shape: repeated URLs, absent fields, empty URLs and broken JSON."""
    events = table(spark, sf_dir, "events")
    first = F.col("event_id") - F.col("event_id") % 3
    url = F.when(F.col("event_id") % 29 == 0, F.lit("")).otherwise(
        F.concat(F.lit("https://ev"), (first % 50).cast("string"), F.lit(".example.com/"), first.cast("string"), F.lit(".html"))
    )
    title = F.when(
        F.col("event_id") % 17 != 0, F.concat_ws(" ", F.col("event_type"), F.col("event_id").cast("string"))
    )
    # to_json leaves NULL fields out, so an absent title is really absent.
    body = F.to_json(F.struct(title.alias("title"), F.col("event_type").alias("content"), url.alias("url")))
    return events.select(
        F.lit(None).cast("string").alias("key"),
        F.when(F.col("event_id") % 97 == 0, F.left(body, F.length(body) - 1)).otherwise(body).alias("value"),
        F.lit("news_raw").alias("topic"),
        F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turn right after them."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", F.col("turn").alias("q_turn"), F.col("text").alias("question"))
    told = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("q_turn"), F.col("text").alias("answer")
    )
    return asked.join(told, ["conv_id", "q_turn"])
