"""Exact top-k search by inner product, block at a time.

Vectors stand in blocks by id range. A block keeps, for every component, its
maximum and minimum; with a query these bound the score of any vector of the
block. Each query takes blocks from the highest bound down, scores them through the block's
matrix, and stops when the bounds fall below its k-th score. Segments of blocks and
blocks of queries are dealt to tasks, whose results are k rows per query each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.llm.scratch import Scratch
from broadsheet.operators.numbering import number_rows

BLOCK = 256  # vectors of a block
SEGMENT = 64  # blocks that a task searches
QUERIES = 512  # queries of a task
EXACT = 1 << 53  # whole numbers that a double holds


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows as int64, missing components as 0."""
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products; exact, beyond a bigint's range cut to its ends."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([[min(max(x, low), high) for x in row] for row in exact], dtype=np.int64).reshape(len(a), len(b))


def _search(queries: pd.DataFrame, corpus: pd.DataFrame, k: int) -> pd.DataFrame:
    """Best k rows of a segment for each query: query row, query id, id, score."""
    width = max(max(map(len, queries["vector"])), max(map(len, corpus["vector"])))
    asked = _matrix(queries["vector"], width)
    blocks = [b for _, b in corpus.groupby("block", sort=True)]
    forward = [_matrix(b["vector"], width) for b in blocks]
    upper, lower = np.array([m.max(axis=0) for m in forward]), np.array([m.min(axis=0) for m in forward])
    positive, negative = np.maximum(asked, 0).astype(np.float64), np.minimum(asked, 0).astype(np.float64)
    bound = positive @ upper.astype(np.float64).T + negative @ lower.astype(np.float64).T
    bound += np.abs(bound) * 1e-9  # above rounding, where numbers are too large for whole doubles
    order = np.argsort(-bound, axis=1, kind="stable")
    floor = np.full(len(asked), -np.inf)
    scores = [np.empty(0, np.int64) for _ in asked]
    ids = [np.empty(0, np.int64) for _ in asked]
    rows = queries["row"].to_numpy()
    for turn in range(len(blocks)):
        chosen = order[:, turn]
        active = np.flatnonzero(bound[np.arange(len(asked)), chosen] >= floor)  # equal bounds may hold a smaller id
        if not len(active):
            break
        for number in np.unique(chosen[active]):
            here = active[chosen[active] == number]
            found = _product(asked[here], forward[number])
            names, own = blocks[number]["id"].to_numpy(), blocks[number]["row"].to_numpy()
            for q, line in zip(here, found):
                keep = np.flatnonzero((line >= floor[q]) & (own != rows[q]))
                s, i = np.concatenate([scores[q], line[keep]]), np.concatenate([ids[q], names[keep]])
                best = np.lexsort((i, -s.astype(np.float64) if not len(s) or np.abs(s).max() < EXACT else ~s))[:k]
                scores[q], ids[q] = s[best], i[best]
                if len(best) == k:
                    floor[q] = scores[q][-1]
    lengths = [len(s) for s in scores]
    return pd.DataFrame({
        "row": np.repeat(rows, lengths), "query_id": np.repeat(queries["id"].to_numpy(), lengths),
        "id": np.concatenate(ids).astype(np.int64), "score": np.concatenate(scores).astype(np.int64),
    })


def search(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """The ``k`` best rows for each row that ``is_query`` holds for: query_id, rank, id, score.

    ``vectors``: id (bigint), vector (array of bigint), other columns are not read. A
    query's candidates are all rows but its own; rows that share its id or its vector
    are candidates like any other. Ties go to the smaller id. Rows without id or vector,
    or with a null component, take no part; vectors of different lengths count as filled
    up with zeros. Queries with fewer than k candidates get them all. Scores beyond the
    range of bigint are cut to its ends. An empty table gives an empty one.
    """
    scratch = Scratch(vectors, "block-topk")
    whole = vectors.select("id", "vector", is_query.alias("asked")).filter(
        "id is not null and vector is not null and not exists(vector, x -> x is null)"
    )
    placed = number_rows(whole, ["id"], "row", after=-1)
    blocked = scratch.keep(placed.select(
        "row", "id", "vector", "asked", F.call_function("div", F.col("row"), F.lit(BLOCK).cast("bigint")).alias("block"),
        F.call_function("div", F.col("row"), F.lit(BLOCK * SEGMENT).cast("bigint")).alias("segment"),
    ))
    asked = number_rows(blocked.filter("asked").select("row", "id", "vector"), ["row"], "place", after=-1).select(
        "row", "id", "vector", F.call_function("div", F.col("place"), F.lit(QUERIES).cast("bigint")).alias("part"))
    asked = scratch.keep(asked)
    parts, segments = asked.select("part").distinct(), blocked.select("segment").distinct()
    # Every block of queries meets every segment: rows of two numbers, one for each task to come.
    meetings = scratch.keep(parts.crossJoin(segments))
    left = meetings.join(asked, "part").groupBy("part", "segment")
    right = meetings.join(blocked.drop("asked"), "segment").select(
        F.col("part").alias("with_part"), F.col("segment").alias("in_segment"), "row", "id", "vector", "block").groupBy("with_part", "in_segment")

    def run(queries: pd.DataFrame, corpus: pd.DataFrame) -> pd.DataFrame:
        return _search(queries, corpus, k)

    found = left.cogroup(right).applyInPandas(run, "row bigint, query_id bigint, id bigint, score bigint")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    result = scratch.keep(
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score"))
    scratch.drop(blocked, asked, meetings)
    return result


def scaled(vector: Column, factor: int = 256) -> Column:
    """Components as whole numbers, floor(factor * x); null if a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("bigint")))
