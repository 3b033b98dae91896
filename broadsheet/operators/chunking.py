"""Cutting article text into overlapping chunks."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Chunk length and overlap in characters, separators from coarse to fine ("" = single characters).
CHUNK_SIZE = 800
CHUNK_OVERLAP = 150
SEPARATORS = ("\n\n", "\n", ".", " ", "")

SLICE = 64  # texts cut at a time

# A chunk id is the article id and the chunk's index side by side; an index beyond the bits fails.
INDEX_BITS = 24


def _pieces(text: str, separator: str) -> list[str]:
    """Cut before every separator, which stays at the head of the next piece."""
    if not separator:
        return list(text)
    starts = [m.start() for m in re.finditer(re.escape(separator), text)]
    bounds = [0, *(s for s in starts if s), len(text)]
    return [text[a:b] for a, b in zip(bounds, bounds[1:]) if a < b]


def _runs(text: str, separators: Sequence[str], size: int) -> Iterator[list[str]]:
    """Runs of neighbouring short pieces; a long piece is cut by the next finer separator."""
    run: list[str] = []
    for piece in _pieces(text, separators[0]):
        if len(piece) < size or len(separators) == 1:
            run.append(piece)
            continue
        if run:
            yield run
            run = []
        yield from _runs(piece, separators[1:], size)
    if run:
        yield run


def _windows(lengths: Sequence[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Piece ranges of the chunks of one run, found on the running total of lengths."""
    ends = [0, *accumulate(lengths)]
    count = len(lengths)
    start = stop = 0
    while stop < count:
        # Longest window from ``start`` that fits; a single piece is always taken.
        stop = max(stop + 1, bisect_right(ends, ends[start] + size) - 1)
        yield start, stop
        if stop < count:
            # Keep the tail that is within the overlap and leaves room for the next piece.
            least = max(ends[stop] - overlap, ends[stop + 1] - size)
            start = min(bisect_left(ends, least, start), stop)


def split_text(
    text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: Sequence[str] = SEPARATORS
) -> list[str]:
    """Chunks of at most ``size`` characters that share up to ``overlap`` characters with their neighbour."""
    chunks = []
    for run in _runs(text or "", separators, size):
        for start, stop in _windows([len(p) for p in run], size, overlap):
            chunk = "".join(run[start:stop]).strip()
            if chunk:
                chunks.append(chunk)
    return chunks


def chunk_column(size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Callable[[Column], Column]:
    """Column function text -> array of chunks, ``SLICE`` texts at a time: what a task holds does not grow with its rows."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def chunks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for start in range(0, len(batch), SLICE):
                texts = batch.slice(start, SLICE).to_pylist()
                yield pa.array([split_text(text, size, overlap) for text in texts], pa.list_(pa.string()))

    return chunks


def window_column(size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Callable[[Column], Column]:
    """Column function text -> array of fixed windows, all native; the last window reaches the end of the text."""
    step = size - overlap

    def windows(text: Column) -> Column:
        last = F.greatest(F.length(text) - F.lit(overlap) - 1, F.lit(0))
        starts = F.sequence(F.lit(0), F.call_function("div", last, F.lit(step)).cast("int"))
        return F.when(
            F.length(text) > 0,
            F.transform(starts, lambda i: F.substring(text, i * F.lit(step) + 1, F.lit(size))),
        ).otherwise(F.array().cast("array<string>"))

    return windows


def trim_chunk(chunk: Column) -> Column:
    """Drop leading dots, commas, question and exclamation marks and plain white space."""
    return F.regexp_replace(chunk, r"^[. ,!?\n\t]+", "")


def explode_chunks(df: DataFrame, text: str, chunks: Callable[[Column], Column]) -> DataFrame:
    """One row per non-empty trimmed chunk; ``chunk_index`` keeps the gaps left by dropped ones."""
    keep = [c for c in df.columns if c != text]
    cut = df.select(*keep, F.posexplode(chunks(F.col(text))).alias("chunk_index", "content"))
    return cut.withColumn("content", trim_chunk("content")).filter(F.length("content") > 0)


def chunk_key(article_id: Column, chunk_index: Column) -> Column:
    """Id of a chunk. Fails for an article with more than 2**24 chunks, or for an article id of more than 39 bits."""
    article = article_id.cast("bigint")
    fits = (chunk_index < 1 << INDEX_BITS) & (article < 1 << (63 - INDEX_BITS))
    return F.when(fits, F.shiftleft(article, INDEX_BITS) + chunk_index).otherwise(F.raise_error(F.lit("chunk id out of range")))


def token_estimate(text: Column) -> Column:
    """Rough token count: a quarter of the characters, rounded half up."""
    return F.floor(F.length(text) / 4 + 0.5)
