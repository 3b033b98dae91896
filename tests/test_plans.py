"""Plans keep the shape that holds at scale."""

import re

from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from broadsheet import session
from broadsheet.operators import encoders, frontier, merging, title_index, topk
from broadsheet.plans import etl, pages, reports, vectorize
from broadsheet.queryset import all_oracles, all_queries, fixtures


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_selection_reads_and_moves_keys_only(spark, sf_dir):
    wh = fixtures.warehouse(spark, sf_dir)
    text = plan(etl.select_new(wh["article_metadata"], wh["fact_articles"]))
    assert "LeftAnti" in text and "content" not in re.findall(r"ReadSchema: (.*)", text)[0]


def test_first_per_key_combines_before_the_shuffle(spark):
    keyed = spark.range(10).select("id", (F.col("id") % 3).cast("string").alias("k"))
    text = plan(merging.first_per_key(keyed, "k", "id"))
    assert text.index("Exchange hashpartitioning(k") < text.index("partial_min(")  # printed from the result down to the scan


def test_export_moves_no_text(spark, sf_dir):
    """Neither sorted nor shuffled, also where a chunk row occurs twice and counts once."""
    wh = fixtures.warehouse(spark, sf_dir)
    export = vectorize.chunk_export(wh)
    assert "Exchange hashpartitioning" not in plan(export) and "Sort" not in plan(export)
    chunks = wh["fact_chunks"]
    one = chunks.limit(1)
    twice = vectorize.chunk_export({**wh, "fact_chunks": chunks.unionByName(one).unionByName(one.withColumn("content", F.lit("other")))})
    assert twice.count() == export.count() + 1


def test_title_search_pushes_its_grams_to_the_index(spark, sf_dir):
    index = plan(title_index.candidates(fixtures.warehouse(spark, sf_dir)["title_grams"], "and_the"))
    assert "PushedFilters: [In(gram, [and,the])" in index and "PartitionFilters: [isnotnull(run_id" in index


def test_rankings_are_cut_before_the_shuffle(spark):
    scored = spark.range(10).select((F.col("id") % 3).alias("query_id"), "id", F.rand(1).alias("score"))
    assert plan(topk.ranked(scored, 5)).count("WindowGroupLimit") == 2


def test_no_report_multiplies_rows(spark, sf_dir):
    wh = fixtures.warehouse(spark, sf_dir)
    for df in (reports.article_list(wh), reports.source_distribution(wh), reports.latest_articles(wh), reports.monitor_metrics(wh)):
        assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)


def test_article_page_never_shuffles_the_texts(spark, sf_dir):
    """The content and raw tables meet the page's keys by broadcast before anything else."""
    text = plan(reports.article_list(fixtures.warehouse(spark, sf_dir)))
    for scan in ("ReadSchema: struct<content_id:bigint,content:string", "ReadSchema: struct<url_hash:string,url:string"):
        above = text[: text.index(scan)].splitlines()[::-1]
        nearest = next(line for line in above if "Join" in line or "Exchange hashpartitioning" in line)
        assert "BroadcastHashJoin" in nearest and "LeftSemi" in nearest


def test_latest_articles_push_columns_to_the_scan(spark, sf_dir):
    text = plan(reports.latest_articles(fixtures.warehouse(spark, sf_dir)))
    assert not any("content_length" in schema or "url_hash" in schema for schema in re.findall(r"ReadSchema: (.*)", text))


def test_a_page_is_parsed_once(spark, sf_dir):
    enriched = fixtures.pages_enriched(spark, sf_dir)
    assert plan(pages.page_items(enriched)).count("ArrowEvalPython") == 1
    assert plan(frontier.page_links(enriched)).count("ArrowEvalPython") == 1


def test_sizes_are_summed_without_a_limit(spark, monkeypatch):
    seen = []
    original = DataFrame.agg
    monkeypatch.setattr(DataFrame, "agg", lambda self, *a: seen.append(out := original(self, *a)) or out)
    session.broadcast_if_small(spark.range(10))
    assert "Limit" not in plan(seen[0])


def test_every_query_has_a_statement():
    assert set(all_queries()) == set(all_oracles())


def test_text_is_not_sorted_where_keys_exceed_a_broadcast(spark, sf_dir, monkeypatch):
    """Beyond the broadcast limit a load, its raw table and an export hash the narrow side, and find the same."""
    def run():
        monkeypatch.setattr(fixtures, "_built", {})
        wh = fixtures.warehouse(spark, sf_dir)
        export = vectorize.chunk_export(wh)
        return export, [sorted(map(tuple, df.collect())) for df in (wh["article_metadata"], wh["fact_articles"], export)]

    _, small = run()
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(session, "value_bytes", lambda df: 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        export, large = run()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = export._jdf.queryExecution().executedPlan().toString()
    assert small == large and "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_raw_table_shuffles_no_text(spark, sf_dir, monkeypatch):
    """Only URLs that arrive again are looked up; rows without an address stay out, the first arrival of each stays in."""
    plans = []

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return session.stage(df, name)

    monkeypatch.setattr(fixtures, "_built", {})
    monkeypatch.setattr(fixtures, "stage", seen)
    rows = fixtures.article_metadata(spark, sf_dir)
    assert rows.groupBy("url_hash").count().filter("count > 1").isEmpty()
    text = dict(plans)["article_metadata"]
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text.split("BroadcastExchange")[0]


def test_points_take_one_pass_over_the_tokens(spark, sf_dir):
    """The default encoders share it and give what each gives alone; others run one by one."""
    row = spark.createDataFrame([(None,), ("",), ("Giá dầu, dầu GIÁ 12",), ("...",)], "content string")
    told = {"title": "t", "url": "u", "authors": "a", "publish_date": "Unknown"}
    few = row.select(F.lit("i").alias("id"), F.lit(1).alias("article_id"), F.lit(0).alias("chunk_index"), "content",
                     *[F.lit(v).alias(k) for k, v in told.items()])
    chunks = few.unionByName(vectorize.with_point_id(vectorize.chunk_export(fixtures.warehouse(spark, sf_dir))).select(*few.columns))
    shared = vectorize.build_points(chunks)
    alone = vectorize.build_points(chunks, lambda text: encoders.encode_dense(text), lambda text: encoders.encode_sparse(text))
    once, twice = (plan(df.filter("id = 'i'")).count("regexp_extract_all") for df in (shared, alone))
    assert (once, shared.schema) == (twice // 2, alone.schema) and once > 0
    assert sorted(map(str, shared.collect())) == sorted(map(str, alone.collect()))
