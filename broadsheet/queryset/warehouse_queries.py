"""Queries for cleaning, selection and the warehouse load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.functions import authors, dates, text, urls
from broadsheet.operators import merging
from broadsheet.operators.numbering import highest, number_rows
from broadsheet.plans import etl
from broadsheet.queryset import fixtures, sql
from broadsheet.queryset.registry import query
from broadsheet.session import new_path
from broadsheet.sources import warehouse as store

def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixtures.article_metadata(spark, sf_dir)
    chosen = merging.first_per_key(raw.select("seq", "url_hash", "title"), "title", "seq")
    return etl.prepare(raw.join(chosen, ["seq", "url_hash", "title"], "left_semi"))


@query("raw_count", sql.statement("SELECT count(*) AS raw_rows FROM article_metadata", "article_metadata"))
def raw_count(spark, sf_dir):
    return fixtures.article_metadata(spark, sf_dir).agg(F.count("*").alias("raw_rows"))


@query("raw_scan", sql.statement(
    "SELECT url_hash, title, length(content) AS body_chars, url FROM article_metadata", "article_metadata"))
def raw_scan(spark, sf_dir):
    rows = fixtures.article_metadata(spark, sf_dir).select("url_hash", "title", "content", "url")
    return rows.select("url_hash", "title", F.length(F.get_json_object("content", "$.content")).cast("bigint").alias("body_chars"), "url")


_TABLES = ["dim_author", "dim_content", "dim_source", "dim_time", "fact_article_authors", "fact_articles", "fact_chunks"]


def _counted(tables: dict[str, DataFrame], column: str) -> DataFrame:
    rows = None
    for name in _TABLES:
        row = tables[name].agg(F.count("*").alias(column)).select(F.lit(name).alias("table_name"), column)
        rows = row if rows is None else rows.unionByName(row)
    return rows


def _counts_sql(*columns: tuple[str, str]) -> str:
    """Row count per table; each column is (name, expression over the count ``n``)."""
    shown = ", ".join(f"{expr} AS {name}" for name, expr in columns)
    union = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _TABLES)
    return sql.statement(f"SELECT table_name, {shown} FROM ({union})", *_TABLES)


@query("warehouse_init", _counts_sql(("rows_kept", "n")))
def warehouse_init(spark, sf_dir):
    """Creating the tables again over a loaded warehouse keeps every row."""
    path = fixtures.warehouse_path(spark, sf_dir)
    store.init_warehouse(spark, path)
    return _counted(store.load_warehouse(spark, path), "rows_kept")


@query("warehouse_reset", _counts_sql(("rows_before", "n"), ("rows_left", "n - n")))
def warehouse_reset(spark, sf_dir):
    """Rows of a copy of the warehouse before and after it is emptied."""
    path = new_path(spark, "warehouse-reset")
    loaded = fixtures.warehouse(spark, sf_dir)
    for table in store.LOADED:
        store.write_run(loaded[table], path, table, run_id=1)
    store.write_run(store.run_log(spark, fixtures.warehouse_path(spark, sf_dir)), path, store.RUN_LOG, run_id=1)
    before = fixtures.once_now(_counted(store.load_warehouse(spark, path), "rows_before"))
    store.reset_warehouse(spark, path)
    return before.join(_counted(store.load_warehouse(spark, path), "rows_left"), "table_name")


@query("clean_text", f"SELECT doc_id, {sql.clean('text')} AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    docs = fixtures.table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@query("quality_gate", sql.statement(
    "SELECT seq, CASE WHEN author = 'Unknown' THEN 'missing_author' WHEN publish_date = 'Unknown' THEN 'missing_date' "
    "ELSE 'passed' END AS outcome FROM article_metadata", "article_metadata"))
def quality_gate(spark, sf_dir):
    rows = etl.parse_items(fixtures.article_metadata(spark, sf_dir))
    outcome = F.when(text.missing(F.col("author")), "missing_author").when(text.missing(F.col("publish_date")), "missing_date")
    return rows.select("seq", F.coalesce(outcome, F.lit("passed")).alias("outcome"))


@query("author_split", sql.statement(f"""
  SELECT seq, CAST(generate_subscripts(names, 1) - 1 AS BIGINT) AS position, unnest(names) AS author_name
  FROM (SELECT seq, {sql.split_authors("author")} AS names FROM article_raw)""", "article_raw"))
def author_split(spark, sf_dir):
    rows = fixtures.article_raw(spark, sf_dir)
    exploded = rows.select("seq", F.posexplode(authors.author_list(F.col("author"))).alias("position", "author_name"))
    return exploded.withColumn("position", F.col("position").cast("bigint"))


@query("url_domain", "SELECT page_id, CASE WHEN contains(url, '//') THEN split_part(url, '/', 3) ELSE url END AS domain FROM pages")
def url_domain(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "pages").select("page_id", urls.domain(F.col("url")).alias("domain"))


@query("date_key", sql.statement(
    "SELECT seq, CAST(try_strptime(publish_date, '%Y-%m-%d %H:%M:%S') AS DATE) AS date FROM article_raw", "article_raw"))
def date_key(spark, sf_dir):
    return fixtures.article_raw(spark, sf_dir).select("seq", dates.date_key(F.col("publish_date")).alias("date"))


@query("etl_counters", sql.statement("""
  SELECT count(*) AS found, count(*) FILTER (status = 'ok') AS processed, count(*) FILTER (status = 'skipped') AS skipped,
    count(*) FILTER (status = 'error') AS errors FROM judged""", "judged"))
def etl_counters(spark, sf_dir):
    return etl.counters(_judged(spark, sf_dir))


# The first half of the raw rows counts as loaded.
_HALF = "seq <= (SELECT avg(seq) FROM article_metadata)"


def _halves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    raw = fixtures.article_metadata(spark, sf_dir)
    middle = raw.agg(F.avg("seq")).scalar()
    return raw.filter(F.col("seq") <= middle), raw


@query("incremental_articles", sql.statement(
    f"SELECT seq, url_hash FROM article_metadata WHERE url_hash NOT IN (SELECT url_hash FROM article_metadata WHERE {_HALF})",
    "article_metadata"))
def incremental_articles(spark, sf_dir):
    loaded, raw = _halves(spark, sf_dir)
    return raw.select("seq", "url_hash").join(loaded.select("url_hash"), "url_hash", "left_anti").select("seq", "url_hash")


@query("title_dedup", sql.statement("""
  SELECT title, min(seq) AS seq FROM (SELECT seq, title FROM article_raw UNION ALL SELECT seq, NULL FROM article_raw WHERE seq % 50 = 7)
  GROUP BY title""", "article_raw"))
def title_dedup(spark, sf_dir):
    """All titles, and further rows without one."""
    rows = fixtures.article_raw(spark, sf_dir).select("seq", "title")
    rows = rows.unionByName(rows.filter("seq % 50 = 7").select("seq", F.lit(None).cast("string").alias("title")))
    return merging.first_per_key(rows, "title", "seq").select("title", "seq")


def _upsert_names(existing: DataFrame, names: DataFrame, key: str, id_column: str) -> DataFrame:
    """Ids of ``existing`` stay; new names get the next ones in name order."""
    new = number_rows(merging.add_names(existing, names, key), [key], id_column, highest(existing, id_column))
    return existing.unionByName(new.select(*existing.columns))


def _numbered(names: DataFrame, key: str, id_column: str) -> DataFrame:
    return number_rows(names.select(key).distinct(), [key], id_column).select(id_column, key)


def _two_step_sql(source: str, key: str, id_column: str, extra: str = "") -> str:
    """First half numbered first, then the names that only the rest has."""
    first = f"SELECT DISTINCT {key} FROM {source} WHERE seq <= (SELECT avg(seq) FROM article_metadata)"
    return f"""
  SELECT {id_column}, {key}{extra} FROM (
    SELECT row_number() OVER (ORDER BY later, {key}) AS {id_column}, {key}
    FROM (SELECT {key}, min(CASE WHEN {key} IN ({first}) THEN 0 ELSE 1 END) AS later FROM {source} GROUP BY {key}))"""


@query("dim_source", sql.statement(_two_step_sql("judged", "domain", "source_id"), "judged"))
def dim_source(spark, sf_dir):
    rows = _judged(spark, sf_dir).select("seq", "domain")
    middle = fixtures.article_metadata(spark, sf_dir).agg(F.avg("seq")).scalar()
    existing = _numbered(rows.filter(F.col("seq") <= middle), "domain", "source_id")
    return _upsert_names(existing, rows, "domain", "source_id")


@query("dim_time", sql.statement(_two_step_sql(
    "loaded", "date", "time_id", ", day(date) AS day, month(date) AS month, year(date) AS year"), "loaded"))
def dim_time(spark, sf_dir):
    rows = _judged(spark, sf_dir).filter("status = 'ok'").select("seq", "date")
    middle = fixtures.article_metadata(spark, sf_dir).agg(F.avg("seq")).scalar()
    existing = _numbered(rows.filter(F.col("seq") <= middle), "date", "time_id")
    both = etl.date_parts(_upsert_names(existing, rows, "date", "time_id"))
    return both.select("time_id", "date", *[F.col(c).cast("bigint").alias(c) for c in ("day", "month", "year")])


sql.part("named", f"""
  SELECT seq, unnest({sql.split_authors("author")}) AS author_name FROM loaded""", "loaded")


@query("dim_author", sql.statement(_two_step_sql("named", "author_name", "author_id"), "named"))
def dim_author(spark, sf_dir):
    rows = _judged(spark, sf_dir).filter("status = 'ok'").select("seq", F.explode("authors").alias("author_name"))
    middle = fixtures.article_metadata(spark, sf_dir).agg(F.avg("seq")).scalar()
    existing = _numbered(rows.filter(F.col("seq") <= middle), "author_name", "author_id")
    return _upsert_names(existing, rows, "author_name", "author_id")


@query("dim_content", sql.statement("""
  SELECT content_id, url_hash, CASE WHEN seq > (SELECT avg(seq) FROM article_metadata) THEN concat('v2 ', text) ELSE text END AS content
  FROM (SELECT row_number() OVER (ORDER BY seq) AS content_id, * FROM loaded)""", "loaded"))
def dim_content(spark, sf_dir):
    """Content of the later half replaced by a new version; ids stay."""
    rows = _judged(spark, sf_dir).filter("status = 'ok'").select("seq", "url_hash", F.col("text").alias("content"))
    middle = fixtures.article_metadata(spark, sf_dir).agg(F.avg("seq")).scalar()
    existing = number_rows(rows, ["seq"], "content_id").select("content_id", "url_hash", "content")
    updates = rows.filter(F.col("seq") > middle).select("url_hash", F.concat(F.lit("v2 "), F.col("content")).alias("content"))
    return merging.upsert_values(existing, updates, "url_hash", "content_id", ["content"])


def _through_store(spark, table: str, rows: DataFrame, updates: DataFrame) -> DataFrame:
    """``rows`` stored as one run and ``updates`` as a later one that replaces them; what readers then see."""
    path = new_path(spark, f"upsert-{table}")
    store.init_warehouse(spark, path)
    store.write_run(rows, path, table, 1)
    store.write_run(spark.range(1).selectExpr("0L found", "0L processed", "0L skipped", "0L errors"), path, store.RUN_LOG, 1)
    store.replace_rows(spark, path, 2, {table: updates})
    return store.load_warehouse(spark, path)[table]


@query("fact_articles", sql.statement("""
  SELECT article_id, url_hash, CASE WHEN article_id % 2 = 0 THEN concat('v2 ', title) ELSE title END AS title,
    source_id, time_id, content_id, content_length FROM fact_articles""", "fact_articles"))
def fact_articles(spark, sf_dir):
    """Title replaced on conflict, everything else kept."""
    facts = fixtures.warehouse(spark, sf_dir)["fact_articles"]
    updates = facts.filter("article_id % 2 = 0").withColumn("title", F.concat(F.lit("v2 "), F.col("title")))
    merged = _through_store(spark, "fact_articles", facts, updates)
    return merged.withColumn("content_length", F.col("content_length").cast("bigint"))


@query("fact_article_authors", sql.statement("""
  SELECT article_id, CASE WHEN article_id % 3 = 0 THEN (SELECT max(author_id) FROM dim_author) ELSE author_id END AS author_id
  FROM fact_article_authors GROUP BY ALL""", "fact_article_authors", "dim_author"))
def fact_article_authors(spark, sf_dir):
    """The authors of every third article replaced; no pair twice."""
    wh = fixtures.warehouse(spark, sf_dir)
    bridge = wh["fact_article_authors"]
    last = wh["dim_author"].agg(F.max("author_id")).scalar()
    updates = bridge.filter("article_id % 3 = 0").select("article_id", last.alias("author_id")).dropDuplicates()
    return _through_store(spark, "fact_article_authors", bridge, updates)


@query("fact_chunks", sql.statement("""
  SELECT chunk_id, article_id, chunk_index, CASE WHEN article_id % 3 = 0 THEN lower(content) ELSE content END AS content
  FROM fact_chunks""", "fact_chunks"))
def fact_chunks(spark, sf_dir):
    """The chunks of every third article replaced by new ones."""
    chunks = fixtures.warehouse(spark, sf_dir)["fact_chunks"]
    updates = chunks.filter("article_id % 3 = 0").withColumn("content", F.lower("content"))
    merged = _through_store(spark, "fact_chunks", chunks, updates)
    return merged.withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


@query("etl_run", _counts_sql(("first_run", "n"), ("second_run", "n")))
def etl_run(spark, sf_dir):
    """Rows per table after a load and after the same load again."""
    path = new_path(spark, "warehouse-run")
    raw = fixtures.article_metadata(spark, sf_dir)
    first = fixtures.once_now(_counted(etl.run_etl(spark, raw, path, run_id=1), "first_run"))
    second = _counted(etl.run_etl(spark, raw, path, run_id=2), "second_run")
    return first.join(second, "table_name")
