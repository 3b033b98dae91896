"""Exact top-k of a large corpus for many queries.

One scan of the corpus scores each row against all queries, in blocks, for one list
or for several (dense, sparse), and can count the rows that hold the queries' tokens
on the way. Each task keeps its own k best per query and list, so only short rows are
shuffled; no pair is ever written out and no key gathers a group.

Where the corpus has many partitions, the k best of a sample of it come first: a row
below a query's k-th best in the sample is not among its best, so no task sends it, and
about k times the sample's inverse rows are shuffled per query however many tasks there are.

The queries' vectors are broadcast, at most ``QUERY_BYTES`` of them at a time. More
queries mean another scan for each such portion, never fewer results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.operators.numbering import number_rows
from broadsheet.session import stage

BLOCK = 1024  # queries scored together
QUERY_BYTES = 64 << 20  # of query vectors broadcast at a time
SLICE = 512  # corpus rows scored at a time
PAIRS = 1 << 20  # sparse products held at a time

SALTS = 32  # shares in which the tasks' rows of one query are merged first
MANY_PARTS = 256  # partitions from which on a sample of one row in SAMPLE gives floors first
SAMPLE = 64
MARGIN = 1e-5  # by which sums of the same row may differ between two scans

Scorer = Callable[[pa.RecordBatch, int, int], np.ndarray]


class Queries(NamedTuple):
    """Some queries in flat arrays: ids, dense vectors, and sparse entries with the place where each query's begin."""

    ids: pa.Array
    vectors: np.ndarray | None
    first: np.ndarray | None
    tokens: np.ndarray | None
    weights: np.ndarray | None

    def block(self, start: int, stop: int) -> Queries:
        if self.first is None:
            return Queries(self.ids[start:stop], self.vectors[start:stop], None, None, None)
        low, high = self.first[start], self.first[stop]
        vectors = None if self.vectors is None else self.vectors[start:stop]
        return Queries(self.ids[start:stop], vectors, self.first[start : stop + 1] - low, self.tokens[low:high], self.weights[low:high])


class _Best:
    """Running k best (score, id) per query; ties go to the lower id."""

    def __init__(self, queries: int, k: int, positive: bool):
        self.k, self.positive = k, positive
        self.floor = np.full(queries, -np.inf)  # score a row must reach to count
        self.scores = [np.empty(0) for _ in range(queries)]
        self.ids: list[np.ndarray | None] = [None] * queries

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        wanted = scores >= self.floor
        if self.positive:
            wanted &= scores > 0
        for q in np.flatnonzero(wanted.any(axis=0)):
            keep = np.flatnonzero(wanted[:, q])
            all_scores = np.concatenate([self.scores[q], scores[keep, q]])
            all_ids = ids[keep] if self.ids[q] is None else np.concatenate([self.ids[q], ids[keep]])
            order = np.lexsort((all_ids, -all_scores))[: self.k]
            self.scores[q], self.ids[q] = all_scores[order], all_ids[order]
            if len(order) == self.k:
                self.floor[q] = all_scores[order[-1]]


def _dense_scorer(queries: Queries) -> Scorer:
    matrix = queries.vectors.astype(np.float64)
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    unit = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0).T

    def score(batch: pa.RecordBatch, start: int, stop: int) -> np.ndarray:
        flat = batch.column("vector").slice(start, stop - start).flatten().to_numpy(zero_copy_only=False)
        block = flat.astype(np.float64).reshape(stop - start, -1)
        length = np.sqrt((block * block).sum(axis=1, keepdims=True))
        return np.round(np.divide(block @ unit, length, out=np.zeros((len(block), unit.shape[1])), where=length > 0), 6) + 0.0

    return score


# Weights have six decimals; whole millionths keep sums exact and independent of their order.
_MICRO = 1e6


def _sparse_scorer(queries: Queries) -> Scorer:
    count = len(queries.ids)
    query = np.repeat(np.arange(count), np.diff(queries.first))
    value = np.rint(queries.weights * _MICRO)
    order = np.argsort(queries.tokens, kind="stable")
    token, query, value = queries.tokens[order], query[order], value[order]

    def score(batch: pa.RecordBatch, start: int, stop: int) -> np.ndarray:
        ids = batch.column("ids").slice(start, stop - start)
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        weights = np.rint(batch.column("weights").slice(start, stop - start).flatten().to_numpy(zero_copy_only=False) * _MICRO)
        row = np.repeat(np.arange(stop - start), np.diff(ids.offsets.to_numpy()))
        low, high = np.searchsorted(token, flat, "left"), np.searchsorted(token, flat, "right")
        hits = np.flatnonzero(high > low)
        flat_scores = np.zeros((stop - start) * count)
        spans = (high - low)[hits]
        for part in _portions(spans):
            chosen, width = hits[part], spans[part]
            first = np.repeat(np.cumsum(width) - width, width)
            posting = np.arange(width.sum()) - first + np.repeat(low[chosen], width)
            target = np.repeat(row[chosen], width) * count + query[posting]
            flat_scores += np.bincount(target, np.repeat(weights[chosen], width) * value[posting], len(flat_scores))
        return np.round(flat_scores.reshape(stop - start, count) / (_MICRO * _MICRO), 6)

    return score


def _portions(spans: np.ndarray) -> Iterator[slice]:
    """Cut the matches into portions of about ``PAIRS`` products."""
    if not len(spans):
        return
    block = (np.cumsum(spans) - 1) // PAIRS
    edges = [0, *np.flatnonzero(np.diff(block)) + 1, len(spans)]
    yield from (slice(a, b) for a, b in zip(edges, edges[1:]))


_SCORERS = {"dense": _dense_scorer, "sparse": _sparse_scorer}
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}


class _Held:
    """How many rows hold each of the queries' tokens, and how many rows there are (under token -1)."""

    def __init__(self, queries: Queries):
        self.tokens = np.unique(queries.tokens)
        self.counts, self.rows = np.zeros(len(self.tokens), np.int64), 0

    def add(self, batch: pa.RecordBatch) -> None:
        flat = batch.column("ids").flatten().to_numpy(zero_copy_only=False)
        self.rows += batch.num_rows
        if len(self.tokens):
            place = np.minimum(np.searchsorted(self.tokens, flat), len(self.tokens) - 1)
            self.counts += np.bincount(place[self.tokens[place] == flat], minlength=len(self.tokens))

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([[-1], self.tokens]), np.concatenate([[self.rows], self.counts])


def _scan(corpus: DataFrame, queries: Queries, k: int, lists: list[str], block: int, floors: dict[str, np.ndarray] | None,
          counted: bool, types: tuple[str, str]) -> tuple[DataFrame, Broadcast]:
    """list, query_id, id, score: per-task best rows; and with ``counted`` list "held", token, n."""
    shared = corpus.sparkSession.sparkContext.broadcast((queries, floors))
    query_type, id_type = types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, known = shared.value
        total = len(asked.ids)
        parts = [(start, asked.block(start, min(start + block, total))) for start in range(0, total, block)]
        work = []
        for name in lists:
            for start, part in parts:
                best = _Best(len(part.ids), k, name == "sparse")
                if known is not None:
                    best.floor = known[name][start : start + len(part.ids)].copy()
                work.append((name, part, _SCORERS[name](part), best))
        held = _Held(asked) if counted else None
        for batch in batches:
            ids = np.asarray(batch.column("id").to_pylist())
            if held is not None:
                held.add(batch)
            for start in range(0, batch.num_rows, SLICE):
                stop = min(start + SLICE, batch.num_rows)
                for _, _, scorer, best in work:
                    best.add(ids[start:stop], scorer(batch, start, stop))

        def rows(name: str, query_ids: pa.Array, found: list, scores: np.ndarray, tokens=None, counts=None) -> pa.RecordBatch:
            size = len(scores) if tokens is None else len(tokens)
            return pa.record_batch(
                [pa.array([name] * size, pa.string()), query_ids if tokens is None else pa.nulls(size, _ARROW[query_type]),
                 pa.array(found, _ARROW[id_type]) if tokens is None else pa.nulls(size, _ARROW[id_type]),
                 pa.array(scores, pa.float64()) if tokens is None else pa.nulls(size, pa.float64()),
                 pa.nulls(size, pa.int64()) if tokens is None else pa.array(tokens), pa.nulls(size, pa.int64()) if tokens is None else pa.array(counts)],
                names=["list", "query_id", "id", "score", "token", "n"])

        for name, part, _, best in work:
            sizes = [len(x) for x in best.scores]
            found = [i for ids in best.ids if ids is not None for i in ids.tolist()]
            yield rows(name, part.ids.take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), found, np.concatenate(best.scores))
        if held is not None:
            yield rows("held", None, None, None, *held.table())

    return corpus.mapInArrow(run, f"list string, query_id {query_type}, id {id_type}, score double, token bigint, n bigint"), shared


def ranked(scored: DataFrame, k: int, by: str = "query_id", score: str = "score", id_column: str = "id") -> DataFrame:
    """Best ``k`` rows per query with their rank; ties go to the lower id."""
    order = Window.partitionBy(by).orderBy(F.desc(score), id_column)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """Best ``k`` of all tasks' rows. A query gets k rows from every task, so they are merged in shares first."""
    share = Window.partitionBy("query_id", F.pmod(F.xxhash64("id"), F.lit(SALTS))).orderBy(F.desc("score"), "id")
    fewer = found.withColumn("_place", F.row_number().over(share)).filter(F.col("_place") <= k).drop("_place")
    return ranked(fewer, k)


def _collected(queries: DataFrame, lists: list[str], query_type: str) -> Queries:
    """The rows of one portion."""
    table = queries.toArrow()
    ids = table.column("query_id").combine_chunks().cast(_ARROW[query_type])
    vectors = first = tokens = weights = None
    if "dense" in lists:
        flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        vectors = flat.reshape(len(ids), -1) if len(ids) else np.empty((0, 1))
    if "sparse" in lists:
        own = table.column("ids").combine_chunks()
        first = np.concatenate([[0], np.cumsum(own.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        tokens = own.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        weights = table.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return Queries(ids, vectors, first, tokens, weights)


def _portions_of(queries: DataFrame, lists: list[str], most: int) -> Iterator[DataFrame]:
    """``queries`` in portions of about ``most`` bytes; almost always one."""
    size = F.lit(16)
    if "dense" in lists:
        size = size + 8 * F.size("vector")
    if "sparse" in lists:
        size = size + 16 * F.size("ids")
    count, total = queries.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    if total <= most:
        yield queries
        return
    each = max(1, count * most // total)
    numbered = stage(number_rows(queries, ["query_id"], "_n"), "numbered-queries")
    for start in range(1, count + 1, each):
        yield numbered.filter((F.col("_n") >= start) & (F.col("_n") < start + each)).drop("_n")


def _floors(corpus: DataFrame, queries: Queries, k: int, lists: list[str], block: int, types: tuple[str, str]) -> dict[str, np.ndarray]:
    """Each query's k-th best score in a sample of the corpus: no row below it is among the k best. One number per query and list."""
    sampled = corpus.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0)
    found, shared = _scan(sampled, queries, k, lists, block, None, False, types)
    place = {q: i for i, q in enumerate(queries.ids.to_pylist())}
    floors = {name: np.full(len(place), -np.inf) for name in lists}
    for name in lists:
        for r in _merged(found.filter(F.col("list") == name), k).filter(F.col("rank") == k).select("query_id", "score").collect():
            floors[name][place[r["query_id"]]] = r["score"] - MARGIN
    shared.destroy()
    return floors


def scan(corpus: DataFrame, queries: DataFrame, k: int, lists: list[str], counted: bool = False, block: int = BLOCK,
         query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The one scan, written: list, query_id, id, score of rows among which are the k best of each list; list "held": token, n; portion.

    Corpus: id, and vector or sparse (a map); queries: query_id (distinct), and the same. The rows
    of one list are what ``best_of`` takes; those of "held" are summed by ``held_by``.
    """
    def shaped(df: DataFrame, key: str) -> DataFrame:
        columns: list[str | Column] = [key]
        if "dense" in lists:
            columns.append("vector")
        if "sparse" in lists:
            columns += [F.map_keys("sparse").alias("ids"), F.map_values("sparse").alias("weights")]
        return df.select(*columns)

    types = dict(queries.dtypes)["query_id"], dict(corpus.dtypes)["id"]
    rows, found = shaped(corpus, "id"), None
    many = corpus.rdd.getNumPartitions() >= MANY_PARTS
    for number, portion in enumerate(_portions_of(shaped(queries, "query_id"), lists, query_bytes)):
        asked = _collected(portion, lists, types[0])
        floors = _floors(rows, asked, k, lists, block, types) if many else None
        passed, shared = _scan(rows, asked, k, lists, block, floors, counted, types)
        one = stage(passed.withColumn("portion", F.lit(number)), "scan")
        shared.destroy()
        found = one if found is None else found.unionByName(one)
    return found


def best_of(found: DataFrame, name: str, k: int) -> DataFrame:
    """query_id, id, score, rank of one list."""
    return _merged(found.filter(F.col("list") == name).select("query_id", "id", "score"), k)


def held_by(found: DataFrame) -> DataFrame:
    """token, n: how many rows hold each token of the queries; token -1 has the number of all rows."""
    # Each portion of the queries counts for itself, so a token of two portions has two equal sums.
    counts = found.filter("list = 'held'").groupBy("portion", "token").agg(F.sum("n").alias("n"))
    return counts.groupBy("token").agg(F.max("n").alias("n"))


def dense_topk(corpus: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Cosine neighbours. Corpus: id, vector; queries: query_id, vector -> query_id, id, score, rank."""
    return best_of(scan(corpus, queries, k, ["dense"], False, block, query_bytes), "dense", k)


def sparse_topk(corpus: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Largest inner products. Corpus: id, sparse map; queries: query_id, sparse map. Zero scores are no hits."""
    return best_of(scan(corpus, queries, k, ["sparse"], False, block, query_bytes), "sparse", k)
