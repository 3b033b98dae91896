"""Every operator and pipeline stage on nulls, empty and long texts, ties, repeated rows, clashing names and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from broadsheet.llm import (
    block_topk, decontamination, licenses, mixing, ngram_join, quality, sharding, substring_dedup, token_counts, toxicity,
)

PROSE = "the quick brown fox jumps over the lazy dog and then it runs far away from the old red barn near the river"
LONG = " ".join(f"w{i % 3001}x{i % 17}" for i in range(60_000))
ROWS = [
    (1, PROSE, "en", "a"), (1, PROSE, "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, " \t\n ", "en", "b"),
    (5, PROSE + " today", "en", "b"), (6, LONG, "de", None), (7, "two words", "en", "a"), (8, "Two  Words", "en", "b"),
    (9, "5 7 9", None, "b"), (None, "a text that has no number of its own but some words", "en", "a"), (10, "é ü 漢字 ß", "fr", ""),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"
CLASHING = ["size", "key", "doc", "shard", "taken", "label", "score", "digest", "text_hash", "n", "first", "place", "target"]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, SCHEMA)
    return plain.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 1), (7, 0, 0), (2, None, None), (None, 1, 1), (1, 1, 0)], "doc_id bigint, quality int, toxic int")


def test_join(docs, none):
    classes, links = ngram_join.join(docs, words=5, of=4, out_of=5)
    rows = classes.collect()
    assert len(rows) == len(ROWS)
    got = {r["doc_id"]: r for r in rows}
    assert got[1]["component_id"] == got[5]["component_id"] == 1
    assert got[8]["component_id"] == 7 and got[7]["size"] == 1  # the same words
    assert [got[i]["size"] for i in (2, 3, 4)] == [0, 0, 0] and got[2]["class_id"] is None and got[3]["component_id"] == 3
    assert got[None]["component_id"] is None and got[6]["component_id"] == 6
    assert links.count() == 1
    left = ngram_join.one_of_each(docs, classes)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 6, 7, 9, 10]
    empty, no_links = ngram_join.join(none)
    assert empty.count() == 0 and no_links.count() == 0


def test_repeated_rows_without_words_all_stay(spark):
    docs = spark.createDataFrame([(1, PROSE), (1, PROSE), (2, ""), (2, ""), (3, None), (3, None)], "doc_id bigint, text string")
    classes, _ = ngram_join.join(docs)
    assert sorted(r["doc_id"] for r in ngram_join.one_of_each(docs, classes).collect()) == [1, 2, 2, 3, 3]


def test_join_of_rows_without_ids(spark):
    rows = [(None, PROSE), (None, PROSE + " now"), (None, "something else altogether, which is not like the others at all")]
    classes, _ = ngram_join.join(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert classes.select("group_id").distinct().count() == 2
    assert all(r["component_id"] is None for r in classes.collect())


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_scores(docs, none, labels, module, label):
    for taught in (labels, labels.limit(0)):
        model = module.fit(docs, taught, label)
        scores = [r["s"] for r in docs.select(module.score(model, F.col("text")).alias("s")).collect()]
        assert len(scores) == len(ROWS) and all(0 <= s <= 1 for s in scores)
    model = module.fit(none, labels, label)
    assert none.select(module.score(model, F.col("text"))).count() == 0


def test_licences(spark, docs, none):
    found = spark.createDataFrame([(1, "x y\nReleased under the MIT License."), (2, None), (3, ""), (1, "All rights reserved.")], "doc_id bigint, text string")
    model = licenses.fit(docs, most=20)
    rows = licenses.scan(found, model).orderBy("doc_id", "place").collect()
    assert [(r["doc_id"], r["place"], r["family"], r["confirmed"]) for r in rows] == [(1, 0, "All rights reserved", True), (1, 1, "MIT", True)]
    assert licenses.scan(none, model).count() == 0


def test_token_counts(docs, none):
    flat = token_counts.flat_files(docs, "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256, block=1000).cache()
    counted = token_counts.counts(flat.filter("data is not null"), 50256)
    named = flat.filter("ordinal is not null").select("file", "ordinal", "doc_id").join(counted, ["file", "ordinal"])
    got = {r["doc_id"]: r["tokens"] for r in named.collect()}
    assert named.count() == len(ROWS) and got[2] == got[3] == 0 and got[6] > 60_000
    assert token_counts.flat_files(none, "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256).count() == 0
    assert token_counts.counts(flat.filter("false"), 50256).count() == 0


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, PROSE), (2, None), (3, ""), (4, "5 7 9"), (5, "nothing of this stands in any of the texts here")], "item_id bigint, text string")
    found = decontamination.leaks(docs, items)
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == [(1, 1), (5, 1)]
    left = decontamination.clean(docs, found)
    assert left.columns == docs.columns and left.count() == len(ROWS) - 3
    assert decontamination.leaks(none, items).count() == 0
    assert decontamination.leaks(docs, items.limit(0)).count() == 0


def test_mix(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and rows[0]["doc"].asDict().keys() == set(docs.columns)
    by_source = {}
    for r in rows:
        one = by_source.setdefault(r["doc"]["source"], [r["source_size"], r["target"], 0])
        one[2] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert set(by_source) == {"a", "b", "", None}
    assert all(abs(target - taken) < 1 for _, target, taken in by_source.values())
    assert mixing.training_rows(mixing.mix(docs)).filter("position < 0 or position > 1").count() == 0
    assert mixing.mix(none).count() == 0


def test_shards(docs, none):
    rows = sharding.shard(docs, shards=5).collect()
    counts = [sum(r["shard"] == s for r in rows) for s in range(5)]
    assert len(rows) == len(ROWS) and max(counts) - min(counts) <= 1
    for s in range(5):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    assert {r["size"] for r in rows if r["doc_id"] in (2, 3)} == {1}
    assert sharding.shard(none).count() == 0


def test_topk(spark):
    vectors = [(0, [1, 2]), (0, [1, 2]), (1, [1, 2]), (2, None), (3, [1, None]), (4, [1]), (5, []), (None, [9, 9]), (6, [1 << 40, 1 << 40]), (50, [1, 1])]
    df = spark.createDataFrame(vectors, "id bigint, vector array<bigint>").withColumn("row", F.lit(0)).withColumn("score", F.lit(1))
    got = block_topk.search(df, F.col("id") % 50 == 0, k=3).collect()
    assert len(got) == 9  # three queries, two of them of one id
    zero = sorted((r["rank"], r["id"], r["score"]) for r in got if r["query_id"] == 0)
    assert zero == [(1, 6, 3 << 40)] * 2 + [(2, 0, 5)] * 2 + [(3, 1, 5)] * 2
    huge = spark.createDataFrame([(0, [1 << 62]), (1, [1 << 62]), (2, [-(1 << 62)])], "id bigint, vector array<bigint>")
    assert [(r["id"], r["score"]) for r in block_topk.search(huge, F.col("id") == 0).orderBy("rank").collect()] == [(1, (1 << 63) - 1), (2, -(1 << 63))]
    assert block_topk.search(df.limit(0), F.lit(True)).count() == 0


def test_scaled(spark):
    rows = spark.createDataFrame([([0.5, -0.001],), ([float("nan")],), ([float("-inf")],), ([None],), (None,), ([],)], "v array<float>")
    assert [r["s"] for r in rows.coalesce(1).select(block_topk.scaled(F.col("v")).alias("s")).collect()] == [[128, -1], None, None, None, None, []]


def test_substring_dedup(docs, none):
    left, removed = substring_dedup.dedup(docs)
    rows = left.collect()
    assert len(rows) == len(ROWS)
    assert {r["text"] for r in rows if r["doc_id"] == 1} == {PROSE}  # repeated rows are one document
    assert {r["doc_id"]: r["text"] for r in rows}[2] is None
    empty, nothing = substring_dedup.dedup(none)
    assert empty.count() == 0 and nothing.count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, none, labels, tmp_path, name, stage):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, PROSE)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    result = stage(spark, docs, str(tmp_path))
    if name != "sharding":
        assert result.columns == docs.columns
    assert 0 < result.count() <= 3 * len(ROWS)
    assert stage(spark, none, str(tmp_path)).count() == 0
