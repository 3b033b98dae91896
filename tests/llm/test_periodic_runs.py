"""Periodic runs: the automaton against trying every period, the query against a plain version, and the edges."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from broadsheet.llm import periodic_runs
from broadsheet.llm.queries import QUERIES
from broadsheet.llm.words import words


def plain_runs(text, least, exponent):
    """Every period tried at every place."""
    found = set()
    for q in range(1, len(text) // exponent + 1):
        i = 0
        while i + q < len(text):
            j = i
            while j + q < len(text) and text[j] == text[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q) and j > i:
                own = text[i : j + q]
                if all(own[p:] != own[:-p] for p in range(1, q)):
                    found.add((i, j - i + q, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def texts(count):
    chance = random.Random(3)
    for _ in range(count):
        letters, size, text = chance.choice([1, 2, 2, 3, 5]), chance.randint(0, 70), []
        while len(text) < size:
            part = [chance.randrange(letters) for _ in range(chance.randint(1, 12))]
            text += part * chance.choice([1, 1, 2, 4, 5, 7])
        yield text


@pytest.mark.parametrize("least, exponent", [(6, 4), (2, 2), (5, 3)])
def test_against_every_period(least, exponent):
    for text in texts(600):
        want = plain_runs(text, least, exponent)
        assert periodic_runs.repetitions(text, least, exponent) == want
        found = words(pa.array([None, " ".join(map(str, text)), "", " ".join(map(str, text[::-1]))]), cased=True)
        assert periodic_runs._runs_of(found, least, exponent) == [[], want, [], plain_runs(text[::-1], least, exponent)]


def test_long_stretches():
    for period in (1, 40, 7000):
        text = list(range(500)) + [i % period for i in range(30_000)] + list(range(100_000, 100_300))
        assert (500, 30_000, period) in periodic_runs.repetitions(text, 6, 4)
        hashes = np.array(text, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
        ((a, b),) = periodic_runs.stretches(hashes, np.array([0, len(text)]), 6, 4)
        assert a <= 500 and b >= 30_500


def test_query(spark, sf_dir, duck):
    rows = {r["doc_id"]: r for r in QUERIES["op12_periodic_runs"](spark, sf_dir).collect()}
    documents = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    assert len(rows) == len(documents)
    with_runs = 0
    for i, text in documents:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(w), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        number = {word: k for k, word in enumerate(dict.fromkeys(w))}
        runs = plain_runs([number[word] for word in w], 6, 4) if n < 3000 else periodic_runs.repetitions([number[word] for word in w], 6, 4)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        with_runs += bool(runs)
        r = rows[i]
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"]) == (best or (None,) * 3)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
    assert with_runs > 3


def test_edges(spark):
    long = " ".join(f"w{i % 2501}" for i in range(60_000))
    rows = [(1, "a b a b a b a b c"), (1, "a b a b a b a b c"), (2, None), (3, ""), (4, " \t\n "), (5, long), (None, "A a A a A a A a"),
            (6, "no no no no no"), (7, "é é é é é é\r\n"), (8, "x y " * 3 + "x Y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", *[F.lit(0).alias(c) for c in ("runs", "n_words", "collapsed")])
    got = sorted((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.periodic_runs(docs).collect())
    assert got == [
        (0, 8, [(0, 8, 2)], "A a"), (1, 9, [(0, 8, 2)], "a b c"), (1, 9, [(0, 8, 2)], "a b c"), (2, 0, [], ""), (3, 0, [], ""), (4, 0, [], ""),
        (5, 60_000, [(0, 60_000, 2501)], " ".join(f"w{i}" for i in range(2501))), (6, 5, [], "no no no no no"), (7, 6, [(0, 6, 1)], "é"),
        (8, 8, [], "x y x y x y x Y")]
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
