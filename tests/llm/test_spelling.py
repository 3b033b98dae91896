"""Spelling variants against comparing all words, with filters in one and in many portions, and the edges."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from broadsheet.llm import spelling
from broadsheet.llm.queries import QUERIES


def plain(counts, times=5):
    """word -> (form, root, n, n_near, form_n), neighbours found under every word with one letter left out."""
    holes = defaultdict(set)
    for word in counts:
        for i in range(len(word)):
            holes[word[:i] + "\0" + word[i + 1 :]].add(word)
    near = defaultdict(set)
    for group in holes.values():
        for a in group:
            near[a] |= group - {a}
    for word in counts:
        for i in range(len(word)):
            other = word[:i] + word[i + 1 :]
            if other in counts:
                near[word].add(other)
                near[other].add(word)
    form = {}
    for word in counts:
        best = min(near[word], key=lambda o: (-counts[o], o), default=None)
        if best is not None and counts[best] > 0 and counts[best] >= times * counts[word]:
            form[word] = best

    def root(word):
        while word in form:
            word = form[word]
        return word

    return {w: (form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items()}


def found(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_query(spark, sf_dir, duck):
    counts = Counter()
    for i, text in duck.sql("SELECT doc_id, text FROM documents").fetchall():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    want = plain({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})
    assert found(QUERIES["op13_spelling_variants"](spark, sf_dir)) == want
    assert sum(w[0] is not None for w in want.values()) > 0


@pytest.mark.parametrize("portion", [64, 1 << 20])
def test_against_all_words(spark, portion):
    chance = random.Random(5)
    counts = {}
    for _ in range(1200):
        word = "".join(chance.choice("abcé") for _ in range(chance.randint(1, 9)))
        counts[word] = chance.choice([0, 1, 1, 2, 7, 30, 160, 900])
    for word in ("x" * 80, "x" * 81, "x" * 79 + "y", "\U0001f600" * 3, "\U0001f600" * 2):
        counts[word] = 3
    rows = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert found(spelling.group_variants(rows, times=5, filter_bytes=portion)) == plain(counts)


def test_edges(spark):
    rows = [("colour", 4), ("colour", 6), ("color", 100), ("colr", 2), ("", 9), (None, 7), ("lonely", None), ("a", 50), ("b", 50), ("ab", 1)]
    words = spark.createDataFrame(rows, "word string, n int").select("*", *[F.lit(0).alias(c) for c in ("form", "root", "edit", "shard", "block")])
    got = found(spelling.group_variants(words))
    assert got == {
        "colour": ("color", "color", 10, 1, 100), "color": (None, "color", 100, 2, None), "colr": ("color", "color", 2, 1, 100),
        "lonely": (None, "lonely", 0, 0, None), "a": (None, "a", 50, 2, None), "b": (None, "b", 50, 2, None), "ab": ("a", "a", 1, 2, 50)}
    assert spelling.group_variants(words.limit(0)).count() == 0
