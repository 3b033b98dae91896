"""Words and shingles of many texts at once, as 64-bit hashes in flat numpy arrays.

A word is a run of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return; A-Z count as a-z, unless case is to tell. Texts come as Arrow string columns
and are read from their buffers, so no Python object is made for a word. A null
text has no words, like an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE = 1 << 20  # bytes hashed at a time; bounds the memory of one long text too
_ROWS = 64  # places of a byte in its word that are told apart by the table alone
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _tables(cased: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes separate words; a random value for each place in a word and byte, A-Z like a-z unless ``cased``."""
    separates = np.zeros(256, bool)
    separates[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    values = mix((np.arange(_ROWS * 256, dtype=np.uint64) + np.uint64(1)) * _STEP).reshape(_ROWS, 256)
    if not cased:
        values[:, 65:91] = values[:, 97:123]
    return separates, values.ravel()


class Words(NamedTuple):
    """Words of a run of texts. ``first``: place of each text's first word, and the total at the end."""

    hashes: np.ndarray
    first: np.ndarray
    start: np.ndarray  # byte offsets into ``data``
    stop: np.ndarray
    data: np.ndarray
    offsets: np.ndarray  # byte offsets of the texts

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(column: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of rows with about ``most`` bytes of text each; one row at least."""
    _, offsets = buffers(column)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, min(stop, len(column))
        start = stop


def _hashed(data: np.ndarray, start: np.ndarray, stop: np.ndarray, cased: bool = False) -> np.ndarray:
    """Hash of each word: the sum of its bytes' values, scrambled."""
    _, values = _tables(cased)
    out = np.empty(len(start), np.uint64)
    sizes = stop - start
    ends = np.cumsum(sizes)
    low = 0
    while low < len(start):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PIECE, "right")))
        size = sizes[low:high]
        begin = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(begin, size)
        letters = data[place + np.repeat(start[low:high], size)]
        value = values[((place & (_ROWS - 1)) << 8) | letters]
        if size.max() > _ROWS:
            value = value * ((place // _ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        out[low:high] = np.add.reduceat(value, begin)
        low = high
    return mix(out + sizes.astype(np.uint64) * _STEP)


@lru_cache(maxsize=1)
def letter_classes() -> np.ndarray:
    """Classes for words of letters alone (1, bytes of other alphabets included) and of digits alone (2)."""
    classes = np.zeros(256, np.uint8)
    classes[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    classes[48:58] = 2
    return classes


def words(column: pa.Array, classes: np.ndarray | None = None, cased: bool = False) -> Words:
    """Words of every text of the column. ``classes`` of bytes, if given: a word is a run of one class, 0 separates."""
    if classes is None:
        classes = (~_tables()[0]).astype(np.uint8)
    data, offsets = buffers(column)
    kind = np.zeros(len(data) + 2, np.uint8)
    kind[1:-1] = classes[data]
    here = kind[1:-1]
    begins = (here != 0) & (here != kind[:-2])
    ends = (here != 0) & (here != kind[2:])
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    begins[edge] = here[edge] != 0  # a text ends a word, wherever it is cut
    ends[edge - 1] = here[edge - 1] != 0
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    return Words(_hashed(data, start, stop, cased), first, start, stop, data, offsets)


def prefixes(found: Words, size: int) -> np.ndarray:
    """Hash of each word's first ``size`` bytes; 0 for shorter words."""
    _, values = _tables()
    out = np.zeros(len(found.start), np.uint64)
    long = np.flatnonzero(found.stop - found.start >= size)
    for place in range(size):
        out[long] += values[(place << 8) | found.data[found.start[long] + place].astype(np.int64)]
    out[long] = mix(out[long] + np.uint64(size * 0x9E3779B97F4A7C15 % (1 << 64)))
    return out


def shingles(found: Words, k: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, where each text's begin, and the summed ``weights`` (whole numbers) of their words.

    A text with 1 to k - 1 words has one shingle, its whole sequence; a text
    without words has none.
    """
    counts = np.diff(found.first)
    h = found.hashes
    weights = np.zeros(len(h), np.int64) if weights is None else weights
    if len(h) >= k:
        value, total = h[: len(h) - k + 1].copy(), weights[: len(h) - k + 1].copy()
        for j in range(1, k):
            value = value * _STEP + h[j : len(h) - k + 1 + j]
            total += weights[j : len(h) - k + 1 + j]
        owner = found.owner()
        whole = owner[: len(owner) - k + 1] == owner[k - 1 :]
        value, total = value[whole], total[whole]
    else:
        value, total = np.empty(0, np.uint64), np.empty(0, np.int64)
    full = np.maximum(counts - k + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = []
        for i in short:
            state = np.array([counts[i]], np.uint64)
            for word in h[found.first[i] : found.first[i + 1]]:
                state = mix(state) * _STEP + word
            extra.append(state[0])
        where = np.concatenate([[0], np.cumsum(full)])[short]
        value, total = np.insert(value, where, np.array(extra, np.uint64)), np.insert(total, where, 0)
        full[short] = 1
    return mix(value), np.concatenate([[0], np.cumsum(full)]), total


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for start, stop in runs(column):
        values, first, _ = shingles(words(column.slice(start, stop - start)), k)
        for i in range(stop - start):
            yield np.unique(values[first[i] : first[i + 1]])
