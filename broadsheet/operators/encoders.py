"""Dense and sparse text vectors: deterministic defaults and the hook for real models."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet import schemas
from broadsheet.functions.text import TOKEN_SPACE, let, tokens

VECTOR = T.ArrayType(T.FloatType())
SPARSE = T.MapType(T.LongType(), T.DoubleType())
BOTH = T.StructType([T.StructField("dense", VECTOR), T.StructField("sparse", SPARSE)])
ENCODE_BATCH = 32
SLICE = 256  # texts encoded at a time by the default encoders


def max_per_id(entries: Column) -> Column:
    """Map from (id, weight) entries; the largest weight wins where two tokens share an id."""

    def last_of_each(ordered: Column) -> Column:
        return F.filter(ordered, lambda e, i: ~F.coalesce(F.get(ordered, i + 1)["id"] == e["id"], F.lit(False)))

    return F.map_from_entries(let(F.array_sort(entries), last_of_each))


def _sliced(encode: Callable[[pa.ListArray], pa.Array], kind: T.DataType) -> Callable[[Column], Column]:
    """Column function tokens -> vectors, ``SLICE`` texts at a time: what a task holds does not grow with its rows."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for start in range(0, len(batch), SLICE):
                yield encode(batch.slice(start, SLICE))

    return run


TokenRows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _token_rows(words: pa.ListArray) -> TokenRows:
    """Row and number of every token; id and sign of each number. A token's md5 is computed once for all texts of the slice."""
    lengths = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    known = words.flatten().dictionary_encode()
    raw = b"".join(hashlib.md5(w, usedforsecurity=False).digest() for w in known.dictionary.cast(pa.binary()).to_pylist())
    digests = np.frombuffer(raw, np.uint8).reshape(-1, 16)
    ids = digests[:, :4].copy().view(">u4").ravel().astype(np.int64) % TOKEN_SPACE
    signs = 1 - 2 * ((digests[:, 4] >> 4) & 1).astype(np.int64)
    return np.repeat(np.arange(len(words)), lengths), known.indices.to_numpy(zero_copy_only=False).astype(np.int64), ids, signs


def _sparse(words: pa.ListArray, rows: TokenRows | None = None) -> pa.Array:
    """Per text: token id -> 1 + ln(tf), in the order of ids; the largest weight wins where two tokens share an id."""
    row, token, ids, _ = rows or _token_rows(words)
    pairs, tf = np.unique(row * max(len(ids), 1) + token, return_counts=True)
    row, token = np.divmod(pairs, max(len(ids), 1))
    weights, place = np.round(np.log(tf) + 1, 6), row * TOKEN_SPACE + ids[token]
    order = np.lexsort((weights, place))
    place, weights = place[order], weights[order]
    last = np.append(place[1:] != place[:-1], True)[: len(place)]
    place, weights = place[last], weights[last]
    ends = np.searchsorted(place // TOKEN_SPACE, np.arange(len(words) + 1)).astype(np.int32)
    absent = np.append(words.is_null().to_numpy(zero_copy_only=False), False)
    return pa.MapArray.from_arrays(pa.array(ends, pa.int32(), mask=absent), place % TOKEN_SPACE, weights)


def encode_sparse(text: Column) -> Column:
    """Token id -> 1 + ln(tf). A null text has no map."""
    return _sliced(_sparse, SPARSE)(tokens(text))


def _dense(dim: int) -> Callable[..., pa.Array]:
    def pool(words: pa.ListArray, rows: TokenRows | None = None) -> pa.Array:
        row, token, ids, signs = rows or _token_rows(words)
        sums = np.bincount(row * dim + (ids % dim)[token], weights=signs[token], minlength=len(words) * dim)
        sums = sums.astype(np.float64, copy=False).reshape(-1, dim)  # whole numbers where there are no tokens at all
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        unit = np.divide(sums, norm, out=sums, where=norm > 0).astype(np.float32)
        return pa.ListArray.from_arrays(np.arange(0, unit.size + 1, dim, dtype=np.int32), unit.ravel())

    return pool


def encode_dense(text: Column, dim: int = schemas.DENSE_DIM) -> Column:
    """Unit-length hashed bag of tokens. A text without tokens, or null, has zeros."""
    return _sliced(_dense(dim), VECTOR)(tokens(text))


def encode_both(text: Column, dim: int = schemas.DENSE_DIM) -> Column:
    """``dense`` and ``sparse``, as the two encoders give them: the tokens are cut, sent to Python and hashed once for both."""
    pool = _dense(dim)

    def encode(words: pa.ListArray) -> pa.Array:
        rows = _token_rows(words)
        return pa.StructArray.from_arrays([pool(words, rows), _sparse(words, rows)], ["dense", "sparse"])

    return _sliced(encode, BOTH)(tokens(text))


def model_encoder(load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = ENCODE_BATCH) -> Callable[[Column], Column]:
    """Column function for a real model.

    ``load`` runs once per Python worker and returns a function from a list of
    texts to a matrix with one row per text.
    """

    @F.pandas_udf(VECTOR)
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for series in texts:
            rows: list[np.ndarray] = []
            for start in range(0, len(series), batch):
                part = series.iloc[start : start + batch].fillna("").tolist()
                rows.extend(np.asarray(model(part), dtype=np.float32))
            yield pd.Series(rows, index=series.index, dtype=object)

    return encode
