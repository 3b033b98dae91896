"""Warehouse tables as parquet folders, one sub-folder per load run.

A run writes ``<table>/run_id=<n>`` for every table and its run-log row last.
Readers take only runs found in the log, and a repeated run overwrites its own
sub-folders, so a load that was cut off leaves nothing behind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet import schemas
from broadsheet.operators import title_index
from broadsheet.session import broadcast_if_small, exists, remove, side_by_side
from broadsheet.streaming.ingest import reset_raw

LOADED = {**schemas.WAREHOUSE, "quarantine": schemas.QUARANTINE, "title_grams": schemas.TITLE_GRAMS}
RUN_LOG = "run_log"

# Finished runs up to which readers name their folders; beyond, the log is joined. ``compact_warehouse`` makes one of all.
RUNS_NAMED = 256


def _empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def _read(spark: SparkSession, path: str, table: str, schema: T.StructType) -> DataFrame:
    with_run = T.StructType([*schema.fields, T.StructField("run_id", T.LongType())])
    return spark.read.schema(with_run).parquet(f"{path}/{table}")


def init_warehouse(spark: SparkSession, path: str) -> None:
    """Create every table that is missing; tables that are there stay as they are. An older warehouse gets its index of titles."""
    unindexed = exists(spark, f"{path}/fact_articles") and not exists(spark, f"{path}/title_grams")

    def create(table: str, schema: T.StructType):
        return lambda: _empty(spark, schema).write.mode("ignore").parquet(f"{path}/{table}/run_id=0")

    side_by_side(spark, *[create(table, schema) for table, schema in {**LOADED, RUN_LOG: schemas.RUN_LOG}.items()])
    last = run_log(spark, path).agg(F.max("run_id")).first()[0] if unindexed else None
    if last:
        write_grams(load_warehouse(spark, path)["fact_articles"].select("article_id", "title"), path, last)


def reset_warehouse(spark: SparkSession, path: str, raw_path: str | None = None) -> None:
    """Empty every table; ids start again at 1 since they follow the largest one in use.

    With ``raw_path`` the raw table is emptied too; else the next load brings its rows back.
    """
    if raw_path:
        reset_raw(spark, raw_path)
    remove(spark, f"{path}/replaced")

    def clear(table: str, schema: T.StructType):
        with_run = T.StructType([*schema.fields, T.StructField("run_id", T.LongType())])
        writer = _empty(spark, with_run).write.mode("overwrite").option("partitionOverwriteMode", "static")
        return lambda: writer.partitionBy("run_id").parquet(f"{path}/{table}")

    side_by_side(spark, *[clear(table, schema) for table, schema in {**LOADED, RUN_LOG: schemas.RUN_LOG}.items()])
    init_warehouse(spark, path)


def run_log(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, RUN_LOG, schemas.RUN_LOG)


def load_warehouse(spark: SparkSession, path: str, before_run: int | None = None) -> dict[str, DataFrame]:
    """All tables as of the finished runs (only those before ``before_run`` if given)."""
    finished = _finished(spark, path, before_run)
    changed = exists(spark, f"{path}/replaced")
    tables = {}
    for table, schema in LOADED.items():
        if table == "title_grams" and not exists(spark, f"{path}/{table}"):
            continue  # an older warehouse, whose titles are searched without index
        rows = finished(_read(spark, path, table, schema))
        if changed and table in REPLACED_BY:
            rows = _latest(spark, path, table, rows, finished)
        tables[table] = rows.drop("run_id")
    return tables


def _finished(spark: SparkSession, path: str, before_run: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """Rows (with run_id) of finished runs.

    A few runs are named in a filter, which leaves out the other folders before anything
    is read. Many are joined from the log, whose own filter lets the planner do the same
    at run time; no more than ``RUNS_NAMED`` numbers reach the driver either way.
    """
    until = F.lit(True) if before_run is None else F.col("run_id") < before_run
    runs = run_log(spark, path).filter(F.col("run_id") >= 0).filter(until).select("run_id").distinct()
    named = [row["run_id"] for row in runs.limit(RUNS_NAMED + 1).collect()]
    if len(named) > RUNS_NAMED:
        return lambda rows: rows.join(runs, "run_id", "left_semi")
    return lambda rows: rows.filter(F.col("run_id").isin(sorted(named) or [-1]))


def compact_warehouse(spark: SparkSession, path: str, new_path: str) -> None:
    """Write all finished runs as one run to a warehouse at ``new_path``, rows in their latest version, and the log summed up.

    The run has the number of the last one, so later runs follow it. Readers switch to
    ``new_path`` when this is done; the old folder can go then.
    """
    log = run_log(spark, path).filter(F.col("run_id") >= 0)
    last = log.agg(F.max("run_id")).first()[0] or 0
    init_warehouse(spark, new_path)
    tables = load_warehouse(spark, path)
    side_by_side(spark, *[
        (lambda table=table, rows=rows: write_run(_clustered(table, rows), new_path, table, last)) for table, rows in tables.items()])
    sums = [F.coalesce(F.sum(f.name), F.lit(0)).alias(f.name) for f in schemas.RUN_LOG.fields]
    write_run(log.agg(*sums), new_path, RUN_LOG, last)


def write_grams(titles: DataFrame, path: str, run_id: int) -> None:
    """The index of a run's titles (article_id, title)."""
    write_run(_clustered("title_grams", title_index.grams(titles)), path, "title_grams", run_id)


def _clustered(table: str, rows: DataFrame) -> DataFrame:
    """The index by gram, each file a range of its own, so that a search reads few of its row groups; other tables as they are."""
    return rows.repartitionByRange("gram", "article_id").sortWithinPartitions("gram", "article_id") if table == "title_grams" else rows


# Key by which the rows of a table are replaced.
REPLACED_BY = {"dim_content": "content_id", "fact_articles": "article_id", "fact_article_authors": "article_id", "fact_chunks": "article_id"}


def replace_rows(spark: SparkSession, path: str, run_id: int, rows: dict[str, DataFrame]) -> None:
    """Store new versions of rows as run ``run_id``: all earlier rows of a table with the same key give way to them.

    A key is an article's or a content's id, so the authors or chunks of an article are
    replaced together. As with a load, readers see the run when its log row is there,
    which is written last; the same run again replaces itself.
    """
    keys = None
    for table, new in rows.items():
        written = write_run(new, path, table, run_id)
        if table == "fact_articles":
            write_grams(written, path, run_id)  # the old titles' grams only make candidates that the pattern turns down
        own = written.select(F.lit(table).alias("table"), F.col(REPLACED_BY[table]).alias("key")).distinct()
        keys = own if keys is None else keys.unionByName(own)
    if keys is not None:
        keys.write.mode("overwrite").parquet(f"{path}/replaced/run_id={run_id}")
        zeros = spark.range(1).select(*[F.lit(0).cast("bigint").alias(f.name) for f in schemas.RUN_LOG.fields])
        write_run(zeros, path, RUN_LOG, run_id)


def _latest(spark: SparkSession, path: str, table: str, rows: DataFrame, finished: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` (with run_id) without those that a later run has replaced."""
    replaced = spark.read.schema("`table` string, `key` bigint, run_id bigint").parquet(f"{path}/replaced")
    own = finished(replaced.filter(F.col("table") == table))
    newest = own.groupBy(F.col("key").alias("_key")).agg(F.max("run_id").alias("_newest"))
    gone = (F.col(REPLACED_BY[table]) == F.col("_key")) & (F.col("run_id") < F.col("_newest"))
    return rows.join(broadcast_if_small(newest), gone, "left_anti")


def write_run(df: DataFrame, path: str, table: str, run_id: int) -> DataFrame:
    """Write one table's rows of one run and read them back."""
    schema = schemas.RUN_LOG if table == RUN_LOG else LOADED[table]
    typed = df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    target = f"{path}/{table}/run_id={run_id}"
    typed.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.schema(schema).parquet(target)
