"""The recursive splitter: fixed cases, a brute-force twin and invariants."""

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from broadsheet.operators import chunking


def brute_force(text, size, overlap, separators):
    """Plain statement of the rule with growing and shrinking lists."""
    separator = next((s for s in separators if s == "" or s in text), separators[-1])
    finer = separators[separators.index(separator) + 1:]
    pieces, current = [], ""
    if separator == "":
        pieces = list(text)
    else:
        parts = text.split(separator)
        pieces = [p for p in [parts[0], *(separator + p for p in parts[1:])] if p]
    out, run = [], []

    def merge(run):
        chunks, window = [], []
        for piece in run:
            if window and len("".join(window)) + len(piece) > size:
                chunks.append("".join(window).strip())
                while window and (len("".join(window)) > overlap or len("".join(window)) + len(piece) > size):
                    window.pop(0)
            window.append(piece)
        if window:
            chunks.append("".join(window).strip())
        return [c for c in chunks if c]

    for piece in pieces:
        if len(piece) < size:
            run.append(piece)
            continue
        out += merge(run)
        run = []
        out += brute_force(piece, size, overlap, finer) if finer else [piece]
    return out + merge(run)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=200), st.integers(4, 30))
def test_splitter_equals_brute_force(text, size):
    overlap = size // 4
    assert chunking.split_text(text, size, overlap) == brute_force(text, size, overlap, list(chunking.SEPARATORS))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc .", max_size=5000))
def test_chunks_are_short_and_cover_the_text(text):
    chunks = chunking.split_text(text)
    assert all(0 < len(c) <= chunking.CHUNK_SIZE for c in chunks)
    at = 0
    for chunk in chunks:
        found = text.find(chunk, max(0, at - chunking.CHUNK_OVERLAP - 2))
        assert found >= 0
        assert not text[at:found].strip()
        at = max(at, found + len(chunk))
    assert not text[at:].strip()


def test_index_keeps_the_gap_of_dropped_chunks(spark):
    df = spark.createDataFrame([(1, "x|..!|, y")], "id int, text string")
    rows = chunking.explode_chunks(df, "text", lambda t: F.split(t, r"\|")).orderBy("chunk_index").collect()
    assert [(r["chunk_index"], r["content"]) for r in rows] == [(0, "x"), (2, "y")]


def test_windows_reach_the_end(spark):
    lengths = [0, 1, 799, 800, 801, 1450, 1451, 5000]
    df = spark.createDataFrame([("x" * n,) for n in lengths], "text string")
    got = df.select(F.length("text").alias("n"), chunking.window_column()(F.col("text")).alias("w")).collect()
    for row in got:
        starts = [i * 650 for i in range(len(row["w"]))]
        assert [len(w) for w in row["w"]] == [min(800, row["n"] - s) for s in starts]
        assert row["n"] == 0 or starts[-1] + 800 >= row["n"]
        assert len(starts) < 2 or starts[-2] + 800 < row["n"]


def test_texts_are_cut_in_slices_of_a_batch(spark):
    texts = [None, "", *("word. " * i for i in range(500))]
    parts = list(chunking.chunk_column(40, 10).func(iter([pa.array(texts, pa.string())])))
    assert [c for part in parts for c in part.to_pylist()] == [chunking.split_text(t, 40, 10) for t in texts]
    assert max(map(len, parts)) <= chunking.SLICE
