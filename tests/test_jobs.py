"""Load, vectorize, ingest, search and answer jobs end to end on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from broadsheet.functions import urls
from broadsheet.operators import title_index
from broadsheet.plans import answers, etl, evaluate, reports, search, vectorize
from broadsheet.session import new_path, remove
from broadsheet.sources import evalset, sites, topic, vectors
from broadsheet.sources import warehouse as store
from broadsheet.streaming import ingest


def raw_table(spark, items):
    rows = [
        (i, item["url"], item.get("title"), body if isinstance(body := item.get("raw"), str) else json.dumps(item, ensure_ascii=False))
        for i, item in enumerate(items)
    ]
    df = spark.createDataFrame(rows, "seq bigint, url string, title string, content string")
    return df.select("seq", urls.url_hash(F.col("url")).alias("url_hash"), "url", "title", "content",
                     F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("publish_date"))


def item(url, title, author="Lan, Minh", date="2024-01-05 08:30:00", content="Một. Hai.", **more):
    return {"url": url, "title": title, "author": author, "publish_date": date, "content": content, **more}


ITEMS = [
    item("https://a.com/1", "T1", content="Tin. Ảnh: X. Hết bài"),
    item("https://a.com/2", "T1", author="Khác"),  # same title, later
    item("https://b.com/3", "T2", author="Unknown"),
    item("https://b.com/4", "T2"),  # blocked in the same run by the rejected row above
    item("https://b.com/5", "T3", date=None),
    item("https://b.com/6", "T4", date="31/12/2023 10:00"),
    item("https://b.com/7", "T5", raw="{broken"),
    item("https://b.com/8", "T6", author=["Lan", "Hoa"], date="2024-02-01 00:00:00"),
    item("https://b.com/9", None),
]


@pytest.fixture(scope="module")
def loaded(spark):
    path = new_path(spark, "test-warehouse")
    raw = raw_table(spark, ITEMS)
    return path, raw, etl.run_etl(spark, raw, path, run_id=1)


def test_load_counts_and_quarantine(spark, loaded):
    path, _, wh = loaded
    log = store.run_log(spark, path).filter("found IS NOT NULL").first()
    assert (log["found"], log["processed"], log["skipped"], log["errors"]) == (7, 2, 2, 3)
    reasons = {r["title"]: r["reason"] for r in wh["quarantine"].collect()}
    assert reasons == {"T2": "missing_author", "T3": "missing_date", "T4": "bad_date", "T5": "bad_json", None: "no_title"}


def test_load_fills_the_star(loaded):
    _, _, wh = loaded
    names = {r["author_name"]: r["author_id"] for r in wh["dim_author"].collect()}
    assert names == {"Hoa": 1, "Lan": 2, "Minh": 3}
    facts = {r["title"]: r for r in wh["fact_articles"].collect()}
    assert set(facts) == {"T1", "T6"} and facts["T1"]["content_length"] == len("Tin.  Hết bài")
    pairs = {(r["article_id"], r["author_id"]) for r in wh["fact_article_authors"].collect()}
    assert pairs == {(facts["T1"]["article_id"], 2), (facts["T1"]["article_id"], 3), (facts["T6"]["article_id"], 2), (facts["T6"]["article_id"], 1)}
    assert {(r["domain"], r["source_id"]) for r in wh["dim_source"].collect()} == {("a.com", 1), ("b.com", 2)}


def test_second_load_adds_nothing_unless_not_strict(spark, loaded):
    path, raw, before = loaded
    counts = {t: df.count() for t, df in before.items() if t != "quarantine"}
    again = etl.run_etl(spark, raw, path, run_id=2)
    assert {t: df.count() for t, df in again.items() if t != "quarantine"} == counts
    # Without strict titles the second URL of a loaded title gets in.
    loose = etl.run_etl(spark, raw, path, run_id=3, strict=False)
    assert loose["fact_articles"].count() == counts["fact_articles"] + 1
    # A repeated run replaces its own rows.
    repeated = etl.run_etl(spark, raw, path, run_id=3, strict=False)["fact_articles"]
    ids = [r["article_id"] for r in repeated.collect()]
    assert len(ids) == len(set(ids)) == counts["fact_articles"] + 1


def test_unfinished_run_is_not_read(spark, loaded):
    path, _, wh = loaded
    names = spark.createDataFrame([(99, "Nobody")], "author_id bigint, author_name string")
    store.write_run(names, path, "dim_author", run_id=77)
    assert store.load_warehouse(spark, path)["dim_author"].filter("author_name = 'Nobody'").count() == 0


def test_reset_restarts_ids(spark):
    path = new_path(spark, "test-reset")
    raw = raw_table(spark, ITEMS)
    etl.run_etl(spark, raw, path, run_id=1)
    store.reset_warehouse(spark, path)
    assert all(df.count() == 0 for df in store.load_warehouse(spark, path).values())
    again = etl.run_etl(spark, raw, path, run_id=1)
    assert {r["source_id"] for r in again["dim_source"].collect()} == {1, 2}


def test_vectorize_adds_each_chunk_once_and_search_finds_it(spark):
    path = new_path(spark, "test-vectors")
    raw = raw_table(spark, [
        item("https://a.com/1", "Giá vàng", content="Giá vàng tăng mạnh hôm nay. Thị trường chờ tin."),
        item("https://a.com/2", "Bóng đá", author="Hoa", content="Đội tuyển thắng trận chung kết."),
    ])
    wh = {**etl.run_etl(spark, raw, new_path(spark, "test-wh"), 1), "article_metadata": raw}
    assert vectorize.run_vectorize(spark, wh, path, 1).count() == 2
    points = vectorize.run_vectorize(spark, wh, path, 2)
    assert points.count() == 2
    assert {r["payload"]["publish_timestamp"] for r in points.collect()} == {1704412800}
    queries = spark.createDataFrame([(1, " giá vàng "), (2, "  "), (3, "?!")], "query_id int, query string")
    hits = search.search(points, queries)
    first = hits.filter("rank = 1").collect()
    assert [(r["query_id"], r["title"], r["metadata"]["authors"]) for r in first] == [(1, "Giá vàng", "Lan, Minh")]
    assert first[0]["score"] == 1.0

    @F.pandas_udf("double")
    def longest(query, content):
        return content.str.len().astype(float)

    assert search.search(points, queries, scorer=longest).filter("rank = 1").first()["title"] == "Giá vàng"
    lists = search.hit_lists(search.accepted_queries(queries), hits)
    records = {r["query_id"]: r for r in answers.answer_record(lists, F.lit("x")).collect()}
    assert records[3]["summary"] == answers.NOTHING_FOUND and records[3]["total"] == 0 and records[1]["summary"] == "x"
    vectors.drop_vectors(spark, path)
    assert vectors.load_vectors(spark, path).count() == 0


def write_records(spark, path, rows, start, mode="append"):
    records = [(None, v, "news_raw", 0, start + i) for i, v in enumerate(rows)]
    df = spark.createDataFrame(records, "key string, value string, topic string, partition int, offset bigint")
    df.withColumn("timestamp", F.current_timestamp()).coalesce(1).write.mode(mode).parquet(path)


def test_ingest_keeps_the_first_arrival_over_batches_and_restarts(spark):
    folder, path, progress = (new_path(spark, n) for n in ("test-topic", "test-raw", "test-progress"))
    write_records(spark, folder, ['{"url":"u1","title":"a"}', '{"url":"u1","title":"b"}', "oops", '{"title":"no url"}'], 0)
    ingest.start(topic.read_stream(spark, folder), path, progress).awaitTermination()
    write_records(spark, folder, ['{"url":"u1","title":"c"}', '{"url":"u2","author":null}', '{"url":""}'], 4)
    ingest.start(topic.read_stream(spark, folder), path, progress).awaitTermination()
    rows = {r["url"]: r for r in ingest.read_raw(spark, path).collect()}
    assert {u: r["title"] for u, r in rows.items()} == {"u1": "a", "u2": ingest.UNKNOWN_TITLE}
    assert rows["u2"]["author"] == "Unknown" and rows["u2"]["publish_date"] is None
    assert rows["u1"]["content"] == '{"url":"u1","title":"a"}'
    assert [r["value"] for r in ingest.read_dead(spark, path).collect()] == ["oops"]
    # A batch that is run again writes the same rows.
    ingest.write_batch(path)(topic.read_batch(spark, folder).filter("offset >= 4"), 1)
    assert ingest.read_raw(spark, path).count() == 2


def test_a_batch_reads_the_key_folders_of_its_prefixes_only(spark, monkeypatch):
    folder, path, progress = (new_path(spark, n) for n in ("key-topic", "key-raw", "key-progress"))
    write_records(spark, folder, [f'{{"url":"https://site/{i}"}}' for i in range(300)], 0)
    ingest.start(topic.read_stream(spark, folder), path, progress).awaitTermination()
    key = ingest.read_raw(spark, path).filter("url = 'https://site/7'").first()["url_hash"]
    stored = ingest.stored_keys(spark, path, [key[:1], "z"])
    assert {r["prefix"] for r in stored.collect()} == {key[:1]} and key in {r["url_hash"] for r in stored.collect()}
    assert all(f"prefix={key[:1]}" in file for file in stored.inputFiles())
    assert ingest.stored_keys(spark, path, ["z"]).count() == 0

    def keys(digits=1):
        return sorted(r["url_hash"] for r in ingest.stored_keys(spark, path, [f"{i:0{digits}x}" for i in range(16 ** digits)]).collect())

    want = sorted(r["url_hash"] for r in ingest.read_raw(spark, path).collect())
    assert keys() == want
    # Later batches see keys that were written anew, and divided in another way.
    monkeypatch.setattr(ingest, "FOLDER_KEYS", 10)
    ingest.compact_keys(spark, path)
    assert keys(2) == want and keys(1) == []
    write_records(spark, folder, ['{"url":"https://site/7"}', '{"url":"https://site/new"}'], 300)
    ingest.start(topic.read_stream(spark, folder), path, progress).awaitTermination()
    assert ingest.read_raw(spark, path).count() == 301 and len(keys(2)) == 301
    ingest.compact_keys(spark, path)
    assert len(keys(2)) == 301
    # A raw table from before there were keys gets them.
    remove(spark, f"{path}/keys")
    ingest.init_raw(spark, path)
    assert len(keys()) == 301
    ingest.reset_raw(spark, path)
    assert keys() == []


def test_item_json_keeps_text_outside_ascii(spark):
    df = spark.createDataFrame([("Tiêu đề", "c", "u", "s", "Lan", "d")], "title string, content string, url string, source string, author string, publish_date string")
    assert topic.encode(df).first()["value"].startswith('{"title":"Tiêu đề"')


def test_site_lists(spark):
    path = new_path(spark, "test-sites")
    sites.write_sites(spark.createDataFrame([('["https://a/",\n {"url": "https://b/"}]',), ('["https://c/"]',)], "value string"), path)
    assert {r["url"] for r in sites.read_sites(spark, path).collect()} == {"https://a/", "https://b/", "https://c/"}


def test_question_set_and_score_files(spark, tmp_path):
    rows = [('Theo "A", vì sao?', "Vì 0,0023%\nlà thấp"), ("Hai", "")]
    path = new_path(spark, "test-csv")
    evalset.write_testset(spark.createDataFrame(rows, "question string, ground_truth string"), path)
    got = {(r["question"], r["ground_truth"] or "") for r in evalset.read_testset(spark, path).collect()}
    assert got == set(rows)
    out = str(tmp_path / "scores")
    scores = spark.createDataFrame([("q1", "m1", 0.5), ("q1", "m2", 1.0)], "case_id string, model string, faithfulness double")
    evalset.write_scores(scores, out)
    files = sorted((tmp_path / "scores").glob("model=*/*.csv"))
    assert len(files) == 2 and all(f.read_bytes().startswith(b"\xef\xbb\xbf") for f in files)
    assert sorted(map(tuple, evalset.read_scores(spark, out, scores.schema).collect())) == [("q1", "m1", 0.5), ("q1", "m2", 1.0)]


MODELS = [answers.Model("a", "a-1", "p"), answers.Model("b", "b-1", "p")]


def test_models_resolve_and_fail_alone(spark):
    asked = spark.createDataFrame([("b",), ("a-1",), ("default",), ("",), (None,), ("zzz",)], "identifier string").coalesce(1)
    assert [r["model"] for r in answers.resolve(asked, MODELS).collect()] == ["b", "a", "a", "a", "a", None]
    named_default = [*MODELS, answers.Model("default", "d-1", "p")]
    assert answers.resolve(asked.filter("identifier = 'default'"), named_default).first()["model"] == "default"

    def fails_on_bad(prompts):
        if "bad" in prompts:
            raise RuntimeError("down")
        return [p + "!" for p in prompts]

    def no_model():
        raise OSError("no weights")

    df = answers.per_model(spark.createDataFrame([("q",), ("bad",)], "prompt string").coalesce(1), MODELS)
    rows = {(r["model"], r["prompt"]): r for r in answers.generate(df, {"a": lambda: fails_on_bad, "b": no_model}).collect()}
    assert rows["a", "q"]["response"] == "q!" and rows["a", "q"]["error"] is None
    assert rows["a", "bad"]["response"] is None and rows["a", "bad"]["error"] == "RuntimeError: down"
    assert {rows["b", p]["error"] for p in ("q", "bad")} == {"OSError: no weights"}


def test_ask_records_answers_and_failures(spark):
    hit = "struct<title:string,content:string,url:string>"
    rows = [(1, "q1", "a", [("T", "C", "u")]), (2, "q2", "b", [("T", "C", "u")]), (3, "q3", "a", []), (4, "q4", "x", [("T", "C", "u")])]
    lists = spark.createDataFrame(rows, f"query_id int, query string, identifier string, results array<{hit}>")

    def fails():
        raise RuntimeError("down")

    got = {r["query_id"]: r for r in answers.ask(lists, MODELS, {"a": lambda: lambda ps: [f"<think>{p}</think> yes" for p in ps], "b": fails}).collect()}
    assert (got[1]["summary"], got[1]["total"], got[1]["error"]) == ("yes", 1, None)
    assert (got[2]["summary"], got[2]["total"], got[2]["results"], got[2]["error"]) == (None, 0, [], "RuntimeError: down")
    assert (got[3]["summary"], got[3]["total"]) == (answers.NOTHING_FOUND, 0)
    assert got[4]["summary"] is None and got[4]["error"] == "unknown model: x"


def test_think_sections_are_dropped(values):
    assert values(answers.strip_think, ["<think>a\nb</think> x <THINK>y</think>", "x", None]) == ["x", "x", ""]


def test_scores_of_known_cases(spark):
    df = spark.createDataFrame([
        ("giá vàng", "Vàng tăng. Bạc giảm.", ["không có gì", "vàng tăng mạnh"], "Vàng tăng."),
        ("q", "", [], "."),
    ], "question string, answer string, contexts array<string>, ground_truth string").coalesce(1)
    first, empty = evaluate.scores(df, 1024).collect()
    assert (first["faithfulness"], first["context_recall"], first["context_precision"]) == (0.5, 1.0, 0.5)
    assert (empty["faithfulness"], empty["context_recall"], empty["context_precision"], empty["answer_relevancy"]) == (0.0, 0.0, 0.0, 0.0)


def test_search_term_wildcards_and_paging(spark, loaded):
    _, raw, wh = loaded
    wh = {**wh, "article_metadata": raw}
    assert {r["title"] for r in reports.article_list(wh, q="t_").collect()} >= {"T1", "T6"}
    assert reports.article_list(wh, q="zz").count() == 0
    first = reports.article_list(wh, limit=1).first()
    assert first["title"] == "T6" and first["author"] == "Hoa & Lan" and first["snippet"].endswith("...")


def test_title_search_by_index_finds_what_a_scan_finds(spark, loaded):
    _, raw, _ = loaded
    titles = ["Giá vàng tăng", "GIÁ VÀNG giảm", "giá dầu", "50% off_now", "50 off now", "aXb-aYb", "ab", "", "\\slash", None, "İstanbul ΣΟΦΟΣ"]
    facts = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "article_id bigint, title string")
    index = title_index.grams(facts)
    for q in ["giá vàng", "GIÁ", "giá%tăng", "50\\% off", "off\\_now", "off_now", "a_b", "ab", "%", "vàng%giá", "\\\\slash", "istanbul", "σοφος", "zzz", "iá v_ng t"]:
        want = {r["article_id"] for r in facts.filter(F.col("title").ilike(f"%{q}%")).collect()}
        found = title_index.candidates(index, q)
        chosen = facts if found is None else facts.join(found, "article_id", "left_semi")
        assert {r["article_id"] for r in chosen.filter(F.col("title").ilike(f"%{q}%")).collect()} == want, q
    assert title_index.wanted("ab_cd%e") == [] and title_index.wanted("Vàng\\%") == ["ng%", "vàn", "àng"]


def test_runs_are_named_or_joined_and_made_one(spark, monkeypatch):
    path, new = new_path(spark, "runs"), new_path(spark, "runs-compact")
    for run, url in ((1, "https://a.com/1"), (2, "https://a.com/2"), (3, "https://a.com/3")):
        raw = raw_table(spark, [item(url, f"Title {run}")]).withColumn("seq", F.lit(run).cast("bigint"))
        etl.run_etl(spark, raw, path, run)
    store.write_run(spark.createDataFrame([(9, "cut off")], store.LOADED["dim_source"]), path, "dim_source", 4)  # no log row
    changed = store.load_warehouse(spark, path)["fact_articles"].filter("title = 'Title 2'").withColumn("title", F.lit("Renamed"))
    store.replace_rows(spark, path, 5, {"fact_articles": changed})

    def content(wh):
        return {t: sorted(map(tuple, rows.collect()), key=str) for t, rows in wh.items() if t != "title_grams"}

    want = content(store.load_warehouse(spark, path))
    assert [r[2] for r in want["fact_articles"]] == ["Title 1", "Renamed", "Title 3"] and len(want["dim_source"]) == 1
    monkeypatch.setattr(store, "RUNS_NAMED", 1)
    joined = store.load_warehouse(spark, path)
    assert content(joined) == want
    store.compact_warehouse(spark, path, new)
    monkeypatch.setattr(store, "RUNS_NAMED", 256)
    compact = store.load_warehouse(spark, new)
    assert content(compact) == want
    assert all("run_id=5" in r[0] for r in compact["fact_articles"].select(F.input_file_name()).collect())
    assert store.run_log(spark, new).filter("run_id = 5").first()["found"] == 3
    raw = raw_table(spark, [item("https://a.com/4", "Title 4")])
    assert [r["article_id"] for r in etl.run_etl(spark, raw, new, 6)["fact_articles"].orderBy("article_id").collect()] == [1, 2, 3, 4]
    wh = {**store.load_warehouse(spark, new), "article_metadata": raw}
    assert [r["title"] for r in reports.article_list(wh, q="renam").collect()] == ["Renamed"]
    # A warehouse from before there was an index is searched without, and gets one.
    remove(spark, f"{new}/title_grams")
    old = {**store.load_warehouse(spark, new), "article_metadata": raw}
    assert "title_grams" not in old and reports.article_list(old, q="renam").count() == 1
    store.init_warehouse(spark, new)
    assert store.load_warehouse(spark, new)["title_grams"].filter("gram = 'ren'").count() == 1


def records_at(spark, rows):
    df = spark.createDataFrame(rows, "value string, partition int, offset bigint, timestamp timestamp")
    return df.selectExpr("cast(null as string) key", "value", "'news_raw' topic", "partition", "offset", "timestamp").coalesce(1)


def test_one_row_per_url_however_many_topic_partitions(spark):
    from datetime import datetime

    early, late = datetime(2024, 1, 1), datetime(2024, 1, 2)
    folder, path, progress = (new_path(spark, n) for n in ("wide-topic", "wide-raw", "wide-progress"))
    rows = [('{"url":"u","title":"second"}', 0, 1, late), ('{"url":"u","title":"first"}', 1024, 0, early), ('{"url":"v"}', 5000, 7, late)]
    records_at(spark, rows).write.parquet(folder)
    ingest.start(topic.read_stream(spark, folder), path, progress).awaitTermination()
    got = ingest.read_raw(spark, path).collect()
    assert sorted((r["url"], r["title"]) for r in got) == [("u", "first"), ("v", ingest.UNKNOWN_TITLE)]
    assert len({r["seq"] for r in got}) == 2
    warehouse_path = new_path(spark, "reset-wh")
    store.init_warehouse(spark, warehouse_path)
    store.reset_warehouse(spark, warehouse_path, raw_path=path)
    assert ingest.read_raw(spark, path).count() == 0


def test_near_repeats_are_dropped_before_the_exact_check(spark):
    from datetime import datetime

    folder, path, progress = (new_path(spark, n) for n in ("near-topic", "near-raw", "near-progress"))
    at = datetime(2024, 1, 1)
    rows = [('{"url":"u"}', 0, 0, at), ('{"url":"u"}', 0, 1, at), ("oops", 0, 2, at), ("oops", 0, 3, at), ('{"url":""}', 0, 4, at)]
    records_at(spark, rows).write.parquet(folder)
    ingest.start(topic.read_stream(spark, folder), path, progress, delay="1 day").awaitTermination()
    assert ingest.read_raw(spark, path).count() == 1 and ingest.read_dead(spark, path).count() == 2


def test_more_than_a_thousand_models(spark):
    table = spark.range(1500).selectExpr("cast(id as int) position", "concat('m', id) name", "concat('i', id) model_id", "'p' provider")
    models = answers.registry(table)
    asked = spark.createDataFrame([("m1400",), ("i7",)], "identifier string").coalesce(1)
    assert [r["model"] for r in answers.resolve(asked, models).collect()] == ["m1400", "m7"]


def test_chunk_ids_out_of_range_fail(spark):
    from broadsheet.operators.chunking import chunk_key

    key = chunk_key(F.col("a"), F.col("i")).alias("k")
    assert spark.createDataFrame([(3, 5)], "a bigint, i int").select(key).first()["k"] == (3 << 24) + 5
    with pytest.raises(Exception, match="out of range"):
        spark.createDataFrame([(3, 1 << 24)], "a bigint, i int").select(key).collect()


def test_broadcasts_are_decided_on_bytes(spark):
    from broadsheet import session

    few = spark.createDataFrame([("é" * 10,), (None,)], "s string")
    assert session.value_bytes(few) == 20 + 16 + 16 + 16
    long = spark.range(30).selectExpr("repeat('x', 1000000) s")
    assert session.broadcast_if_small(long) is long and session.broadcast_if_small(few) is not few


def test_changed_rows_are_stored_in_place_of_the_old_ones(spark):
    path = new_path(spark, "changes")
    store.init_warehouse(spark, path)
    chunks = spark.createDataFrame([(1, 1, 0, "a"), (2, 1, 1, "b"), (3, 2, 0, "c")], store.LOADED["fact_chunks"])
    store.write_run(chunks, path, "fact_chunks", 1)
    store.write_run(spark.range(1).selectExpr("3L found", "3L processed", "0L skipped", "0L errors"), path, store.RUN_LOG, 1)
    new = spark.createDataFrame([(1, 1, 0, "A")], store.LOADED["fact_chunks"])
    for _ in range(2):  # the same run again changes nothing
        store.replace_rows(spark, path, 2, {"fact_chunks": new})
        assert {r["content"] for r in store.load_warehouse(spark, path)["fact_chunks"].collect()} == {"A", "c"}
    store.replace_rows(spark, path, 3, {"fact_chunks": spark.createDataFrame([(1, 1, 0, "AA")], store.LOADED["fact_chunks"])})
    assert {r["content"] for r in store.load_warehouse(spark, path)["fact_chunks"].collect()} == {"AA", "c"}
    assert store.load_warehouse(spark, path, before_run=3)["fact_chunks"].count() == 2
    store.reset_warehouse(spark, path)
    assert store.load_warehouse(spark, path)["fact_chunks"].count() == 0


def test_points_of_changed_articles_are_made_anew(spark, loaded):
    _, raw, wh = loaded
    wh = {**wh, "article_metadata": raw}
    path = new_path(spark, "vector-changes")
    first = vectorize.run_vectorize(spark, wh, path, 1).count()
    article = wh["fact_chunks"].agg(F.min("article_id")).first()[0]
    changed = {**wh, "fact_chunks": wh["fact_chunks"].withColumn("content", F.when(F.col("article_id") == article, "NEW").otherwise(F.col("content")))}
    only = spark.createDataFrame([(article,)], "article_id bigint")
    points = vectorize.run_vectorize(spark, changed, path, 2, changed=only)
    assert points.count() == first
    assert {r["c"] for r in points.filter(F.col("payload.article_id") == article).selectExpr("payload.content c").collect()} == {"NEW"}
    vectors.compact(spark, path, path + "-compact")
    assert vectors.load_vectors(spark, path + "-compact").count() == first


def test_pages_by_the_last_row_seen(spark, loaded):
    from datetime import date

    from broadsheet.plans import explorer

    rows = [(i, date(2024, 1, 1 + i % 3) if i % 4 else None) for i in range(20)]
    table = spark.createDataFrame(rows, "id bigint, date date")
    want = sorted(rows, key=lambda r: (r[1] is not None, -(r[1].toordinal() if r[1] else 0), -r[0]))
    got, last, more = [], None, True
    while more:
        part = sorted(explorer.page(table, 1, 6, after=last).collect(), key=lambda r: want.index((r["id"], r["date"])))
        got += [(r["id"], r["date"]) for r in part]
        last, more = (part[-1]["date"], part[-1]["id"]), part[0]["has_next"]
    assert got == want
    _, raw, wh = loaded
    wh = {**wh, "article_metadata": raw}
    every = reports.article_list(wh, limit=100).collect()
    last = (every[0]["published_date"], every[0]["id"])
    assert [r["id"] for r in reports.article_list(wh, limit=100, after=last).collect()] == [r["id"] for r in every[1:]]
