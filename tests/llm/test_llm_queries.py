"""The registered queries on the given tables: against their statements, or against plain versions."""

import re
import zlib
from collections import Counter, defaultdict

import check_queries
import duckdb
import pytest

import corpus_pipeline
from broadsheet.llm import token_counts
from broadsheet.llm.queries import ORACLES, QUERIES, SEPARATOR, VOCABULARY

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(duck):
    return {i: (t, lang, source) for i, t, lang, source in duck.sql("SELECT doc_id, text, lang, source FROM documents").fetchall()}


def first_of(number):
    return next(q for name, q in QUERIES.items() if name.startswith(f"op{number}_"))


def test_every_operator_has_one_query():
    assert sorted(int(m[1]) for name in QUERIES if (m := re.match(r"op(\d+)_", name))) == list(range(1, 14))
    assert "pipeline" in QUERIES


@pytest.mark.parametrize("key", list(ORACLES))
def test_query_matches_its_statement(key, spark, sf_dir, duck):
    verdict, _, _, _, note = check_queries.compare(spark, duck, sf_dir, QUERIES[key], ORACLES[key])
    assert verdict == "ok", note


@pytest.mark.parametrize("number, label, least", [(2, "quality", 0.88), (10, "toxic", 0.9)])
def test_classifiers_on_held_out_documents(spark, number, label, least):
    rows = {r["doc_id"]: r for r in first_of(number)(spark, LARGER).collect()}
    truth = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{LARGER}/labels.parquet'").fetchall())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in rows.items())
    limit = 0.7 if number == 2 else 0.3
    assert all(r["predicted"] == (r["score"] >= limit) for r in rows.values())
    held = [(rows[i]["score"], rows[i]["predicted"], y) for i, y in truth.items() if rows[i]["held_out"]]
    assert sum(p == y for _, p, y in held) / len(held) >= least
    good, bad = [s for s, _, y in held if y == 1], [s for s, _, y in held if y == 0]
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) > 0.8


def test_licence_lines(spark, sf_dir, documents):
    lines = {
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT",
        "All rights reserved.": "All rights reserved", "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
        "This work is licensed under the GNU General Public License, version 3.": "GPL",
    }
    want = {(i, n, lines[line]) for i, (t, *_) in documents.items() for n, line in enumerate(t.split("\n")) if line in lines}
    got = {(r["doc_id"], r["place"], r["family"]) for r in first_of(3)(spark, sf_dir).filter("confirmed").collect()}
    assert got == want


def test_token_counts(spark, sf_dir, documents):
    with open(VOCABULARY, "rb") as file:
        encode = token_counts.encoder(file.read())
    got = {r["doc_id"]: r["n_tokens"] for r in first_of(4)(spark, sf_dir).collect()}
    assert got == {i: len(encode.encode_ordinary(t)) for i, (t, *_) in documents.items()} and SEPARATOR == 50256


def plain_leaks(texts, items):
    """Texts with four fifths of an item's five-word windows; the given texts hold no numbers in items, and no names."""
    def windows(text):
        w = re.findall(r"[a-z\u0080-\U0010ffff]+", text.lower())
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    listed, sizes = defaultdict(set), {}
    for item, text in items:
        sizes[item] = len(windows(text))
        for w in windows(text):
            listed[w].add(item)
    found = set()
    for doc, text in texts:
        counts = Counter(i for w in windows(text) for i in listed.get(w, ()))
        found |= {(doc, i) for i, n in counts.items() if n >= 0.8 * sizes[i]}
    return found


def test_leaks(spark):
    con = duckdb.connect()
    texts = con.sql(f"SELECT doc_id, text FROM '{LARGER}/documents.parquet'").fetchall()
    items = con.sql(f"SELECT item_id, text FROM '{LARGER}/benchmark.parquet'").fetchall()
    want = plain_leaks(texts, items)
    assert want and {(r["doc_id"], r["item_id"]) for r in first_of(5)(spark, LARGER).collect()} == want


def test_shards(spark, sf_dir, documents):
    rows = first_of(7)(spark, sf_dir).collect()
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == len(documents) and set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    places = defaultdict(list)
    for r in rows:
        text = documents[r["doc_id"]][0].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), "rows", None)
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_removed_units(spark, sf_dir, documents):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def plain(text):
        return re.findall(r"[^\x20\x09-\x0D]+", text.translate(fold))

    rows = first_of(9)(spark, sf_dir).collect()
    assert len(rows) == len(documents) and sum(r["n_removed"] for r in rows) > 0
    for r in rows:
        text, at, left = documents[r["doc_id"]][0], 0, []
        for s in r["removed"]:
            unit, first = plain(text[s["start"] : s["stop"]]), documents[s["first_doc"]][0]
            line = text[text.rfind("\n", 0, s["start"]) + 1 :].partition("\n")[0]
            assert len(unit) >= 8 or plain(line) == unit  # lines of any length, other units of at least 8 words
            assert (s["first_doc"], s["first_start"]) < (r["doc_id"], s["start"])
            assert plain(first[s["first_start"] :])[: len(unit)] == unit
            left.append(text[at : s["start"]])
            at = max(at, s["stop"])
        assert r["text"] == "".join(left) + text[at:]
    # A line of enough words that stood before is gone.
    seen = set()
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        text = documents[r["doc_id"]][0]
        gone = [(s["start"], s["stop"]) for s in r["removed"]]
        at = 0
        for line in text.split("\n"):
            key = tuple(plain(line))
            if len(key) >= 8 and key in seen:
                words = [(m.start() + at, m.end() + at) for m in re.finditer(r"[^\x20\x09-\x0D]+", line)]
                assert sum(any(a <= x and y <= b for a, b in gone) for x, y in words) >= 0.9 * len(words)
            seen.add(key)
            at += len(line) + 1


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage against a plain version on its own input."""
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    columns, labels = docs.columns, dict(duckdb.sql(f"SELECT doc_id, quality FROM '{LARGER}/labels.parquet'").fetchall())
    items = duckdb.sql(f"SELECT item_id, text FROM '{LARGER}/benchmark.parquet'").fetchall()
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
        stage(spark, docs, LARGER).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
        if name == "quality":
            kept = {i for i, *_ in after}
            assert sum(i in kept for i, q in labels.items() if q == 1) > 0.95 * sum(labels.values())
            assert sum(i in kept for i, q in labels.items() if q == 0) < 0.35 * (len(labels) - sum(labels.values()))
        elif name == "near_duplicates":
            sets = {}
            for i, text, _ in before:
                w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
                sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)])
            listed, root = defaultdict(list), {i: i for i in sets}

            def find(i):
                while root[i] != i:
                    i = root[i]
                return i

            for i, s in sets.items():
                for g in s:
                    listed[g].append(i)
            pairs = {(a, b) for ids in listed.values() if len(ids) < 200 for n, a in enumerate(ids) for b in ids[n + 1 :]}
            for a, b in pairs:
                if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
            assert sorted(i for i, *_ in after) == sorted(i for i in sets if find(i) == i)
        elif name == "decontamination":
            bad = {i for i, _ in plain_leaks([(i, t) for i, t, _ in before], items)}
            assert bad and {i for i, *_ in after} == {i for i, *_ in before} - bad
        elif name == "mixing":
            times = Counter(i for i, *_ in after)
            assert max(times.values()) <= 3 and set(times) <= {i for i, *_ in before}
            size = {i: len(t.split()) for i, t, _ in before}
            assert abs(sum(size[i] * n for i, n in times.items()) / sum(size.values()) - 1) < 0.05
        else:
            counts = Counter(r["shard"] for r in docs.select("shard").collect())
            assert Counter(after) == Counter(before) and max(counts.values()) - min(counts.values()) <= 1
        if name != "sharding":
            assert docs.columns == columns
