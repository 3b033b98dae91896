"""Numbering, merging, top-k, the frontier and the tail rule."""

import hashlib
import math
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from broadsheet.operators import encoders, frontier, merging, page_parser, topk
from broadsheet.operators.numbering import highest, number_rows
from broadsheet.operators.page_parser import parse
from broadsheet.operators.tail_author import last_nodes, tail_author


def test_numbers_are_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    rows = number_rows(df, ["k"], "n", after=10).collect()
    assert sorted((r["k"], r["n"]) for r in rows) == [(k, k + 11) for k in range(1000)]
    assert highest(df.limit(0), "k") == 0


def test_first_per_key_with_a_hot_key_and_nulls(spark):
    df = spark.range(3000).select(
        F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("title"))
    got = {r["title"]: r["seq"] for r in merging.first_per_key(df, "title", "seq").collect()}
    assert got["hot"] == 0 and got[None] == 2 and len(got) == 1002


def test_null_safe_anti_join(spark):
    new = spark.createDataFrame([("a",), (None,), ("b",)], "title string")
    old = spark.createDataFrame([("a",), (None,)], "title string")
    assert [r["title"] for r in merging.not_yet_in(new, old, ["title"]).collect()] == ["b"]


def test_upsert_keeps_ids(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, k string, v string")
    new = spark.createDataFrame([("b", None)], "k string, v string")
    assert sorted(map(tuple, merging.upsert_values(old, new, "k", "id", ["v"]).collect())) == [(1, "a", "x"), (2, "b", None)]


def _vectors(spark, n, dim, seed, name):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, dim)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, f"{name} bigint, vector array<float>")


def test_dense_topk_equals_brute_force_in_one_block_and_in_many(spark):
    corpus_rows, corpus = _vectors(spark, 60, 4, 1, "id")
    query_rows, queries = _vectors(spark, 11, 4, 2, "query_id")
    want = set()
    for q, qv in query_rows:
        scored = []
        for i, v in corpus_rows:
            length = np.linalg.norm(qv) * np.linalg.norm(v)
            scored.append((-(round(float(np.dot(qv, v) / length), 6) if length else 0.0), i))
        want |= {(q, i, -s + 0.0, rank + 1) for rank, (s, i) in enumerate(sorted(scored)[:7])}
    for block in (100, 4):
        got = topk.dense_topk(corpus.repartition(5), queries, 7, block=block)
        assert {(r["query_id"], r["id"], r["score"] + 0.0, r["rank"]) for r in got.collect()} == want


def test_portions_of_queries_and_floors_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.random(8)], {int(t): round(float(w), 6) for t, w in zip(rng.choice(40, 5, replace=False), rng.random(5) + 1)})
            for i in range(900)]
    corpus = spark.createDataFrame(rows, "id bigint, vector array<float>, sparse map<bigint,double>").repartition(6)
    queries = corpus.filter("id % 50 = 0").withColumnRenamed("id", "query_id")

    def all_of(**how):
        found = topk.scan(corpus, queries, 5, ["dense", "sparse"], counted=True, **how)
        lists = [{tuple(r) for r in topk.best_of(found, name, 5).collect()} for name in ("dense", "sparse")]
        return lists, {tuple(r) for r in topk.held_by(found).collect()}, found.filter("list <> 'held'").count()

    want, held, sent = all_of()
    assert len(want[0]) == 18 * 5 and (-1, 900) in held
    assert {t: n for t, n in held if t >= 0} == {
        t: sum(t in m for *_, m in rows) for t in {t for i, _, m in rows if i % 50 == 0 for t in m}}
    assert all_of(query_bytes=700, block=2)[:2] == (want, held)
    monkeypatch.setattr(topk, "MANY_PARTS", 1)
    monkeypatch.setattr(topk, "SAMPLE", 4)
    assert all_of()[:2] == (want, held) and all_of()[2] < sent


def test_sparse_topk_equals_brute_force(spark):
    rng = np.random.default_rng(3)

    def maps(n):
        return [(i, {int(t): round(float(w), 6) for t, w in zip(rng.choice(30, 6, replace=False), rng.random(6) + 1)}) for i in range(n)]

    corpus_rows, query_rows = maps(80), maps(9)
    corpus = spark.createDataFrame(corpus_rows, "id bigint, sparse map<bigint,double>")
    queries = spark.createDataFrame(query_rows, "query_id bigint, sparse map<bigint,double>")
    want = set()
    for q, qm in query_rows:
        scored = [(-round(sum(qm[t] * m[t] for t in qm if t in m), 6), i) for i, m in corpus_rows if set(qm) & set(m)]
        want |= {(q, i, -s) for s, i in sorted(scored)[:5]}
    for block in (100, 4):
        got = topk.sparse_topk(corpus.repartition(3), queries, 5, block=block).collect()
        assert {(r["query_id"], r["id"], r["score"]) for r in got} == want


def test_colliding_tokens_keep_the_largest_weight(spark):
    entries = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(w).alias("weight")) for i, w in [(1, 1.0), (2, 3.0), (1, 2.0)]])
    assert spark.range(1).select(encoders.max_per_id(entries).alias("m")).first()["m"] == {1: 2.0, 2: 3.0}


def test_sparse_and_dense_defaults(spark):
    df = spark.createDataFrame([("Tin tức tin",), ("",)], "x string").coalesce(1)
    rows = df.select(encoders.encode_sparse(F.col("x")).alias("s"), encoders.encode_dense(F.col("x"), 16).alias("d")).collect()
    assert sorted(rows[0]["s"].values()) == [1.0, 1.693147] and rows[1]["s"] == {}
    assert abs(sum(v * v for v in rows[0]["d"]) - 1) < 1e-6 and rows[1]["d"] == [0.0] * 16


def test_default_encoders_against_counting(spark):
    texts = [None, "", "?! ...", "Giá dầu tăng, giá vàng giảm", "a " * 700 + "b", *(f"tin {i} số {i % 7} " * (i % 4) for i in range(600))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string").coalesce(1)
    rows = df.select("i", encoders.encode_sparse(F.col("x")).alias("s"), encoders.encode_dense(F.col("x"), 16).alias("d")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        counts, sums = Counter(re.findall(r"\w+", (texts[r["i"]] or "").lower())), np.zeros(16)
        want = {}
        for token, tf in counts.items():
            digest = hashlib.md5(token.encode()).hexdigest()
            number = int(digest[:8], 16) % 262144
            want[number] = max(want.get(number, 0), round(math.log(tf) + 1, 6))
            sums[number % 16] += tf * (1 - 2 * (int(digest[8], 16) % 2))
        assert r["s"] == (None if texts[r["i"]] is None else want)
        assert r["d"] == pytest.approx(sums / (np.sqrt((sums * sums).sum()) or 1), abs=1e-6)


def test_encoders_work_on_slices_of_a_batch():
    words = pa.array([["a", "b"]] * 1000 + [None], pa.list_(pa.string()))
    for encode, kind in ((encoders._dense(16), encoders.VECTOR), (encoders._sparse, encoders.SPARSE)):
        sizes = [len(part) for part in encoders._sliced(encode, kind).func(iter([words, words]))]
        assert sum(sizes) == 2002 and max(sizes) <= encoders.SLICE


def test_model_encoder_loads_once_and_batches(spark):
    def load():
        return lambda texts: np.array([[len(t), len(texts)] for t in texts])

    df = spark.range(70).select(F.repeat(F.lit("x"), F.col("id").cast("int")).alias("x")).coalesce(1)
    rows = df.select(encoders.model_encoder(load, batch=32)(F.col("x")).alias("v")).collect()
    assert [r["v"][0] for r in rows] == [float(i) for i in range(70)]
    assert {r["v"][1] for r in rows} == {32.0, 6.0}


def test_frontier_follows_sections_to_the_depth_limit(spark):
    edges = spark.createDataFrame(
        [("s", "a", "section"), ("a", "b", "section"), ("b", "s", "section"), ("a", "x", "article"), ("x", "y", "section"), ("b", "c", "section")],
        "url string, target string, kind string")
    seeds = spark.createDataFrame([("s",)], "url string")
    assert {tuple(r) for r in frontier.walk(edges, seeds).select("url", "depth").collect()} == {("s", 0), ("a", 1), ("b", 2), ("x", 2), ("c", 3)}
    assert {r["url"] for r in frontier.walk(edges, seeds, depth_limit=1).collect()} == {"s", "a"}


def test_tail_prefers_a_named_source_then_bold_text(values):
    pages = {
        "<article><p>Thân bài dài.</p><p>Nguồn: Báo Lao Động</p><p>khác</p></article>": "Báo Lao Động",
        "<article><p><b>Minh Anh</b></p><p>chữ thường</p></article><p><b>Ngoài</b></p>": "Minh Anh",
        '<article><p style="text-align:RIGHT">“Lan Hương”</p></article>': "Lan Hương",
        "<article><p>chữ thường</p></article>": None,
        '<body><div class="author-box">Theo TTXVN</div></body>': "TTXVN",
        None: None,
    }
    assert values(tail_author, list(pages), parse) == list(pages.values())
    many = "<article>" + "<p>x</p>" * 40 + "</article>"
    assert values(lambda x: F.size(last_nodes(x)), [many], parse) == [15]


def test_pages_are_read_in_slices_of_a_batch(spark):
    markup = pa.array([None, *(f"<p>{i}</p>" for i in range(200))])
    parts = list(page_parser._rows.func(iter([markup, markup])))
    assert sum(map(len, parts)) == 402 and max(map(len, parts)) <= page_parser.SLICE
    df = spark.range(300).select("id", F.concat(F.lit("<p>"), "id", F.lit("</p>")).alias("html")).coalesce(1)
    rows = df.select("id", parse(F.col("html")).alias("page")).select("id", F.col("page")[1]["text"].alias("t")).collect()
    assert len(rows) == 300 and all(r["t"] == str(r["id"]) for r in rows)


def test_slices_of_long_pages_are_bounded_by_their_markup(spark):
    """A slice is one page, or at most so many bytes; the rows are those of each page read alone."""
    each = "<p>ảnh</p>" * 1500  # some 18 kB
    pages = [None, each, "", each * 20, "<b>x</b>", *[each] * 40, None]
    markup = pa.array(pages)
    whole = [part for part in page_parser._slices(markup)]
    assert [m for part in whole for m in part.to_pylist()] == pages
    sizes = [sum(len((m or "").encode()) for m in part.to_pylist()) for part in whole]
    assert all(len(part) == 1 or size <= page_parser.SLICE_BYTES for part, size in zip(whole, sizes)) and len(whole) < 12
    read = [rows for part in page_parser._rows.func(iter([markup, markup[:0], markup[3:]])) for rows in part.to_pylist()]
    alone = [page_parser._page(m).to_pylist()[0] for m in pages]
    assert read == alone + alone[3:]


def test_what_reading_pages_holds_does_not_grow_with_their_number():
    """Peak of Python objects: many short pages or many long ones in a batch hold no more than a few do."""
    def peak(page, number):
        markup = pa.array([page] * number)
        tracemalloc.start()
        read = sum(len(part) for part in page_parser._rows.func(iter([markup])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert read == number
        return most

    short = "<p class='a b'>x <a href='/y'>y</a></p>" * 20
    assert peak(short, 320) < 2 * peak(short, 40)
    assert peak(short * 40, 12) < 2 * peak(short * 40, 2)
