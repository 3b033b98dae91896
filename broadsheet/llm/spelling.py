"""Spelling variants: edits of every word are probed against Bloom filters, and what they let through meets the vocabulary.

Two words are near if one code point is inserted, deleted or replaced. For each pair
only one side generates the edit that leads to the other: the longer word deletes a
code point, of two words of equal length the one with the smaller code point
replaces it. The vocabulary is put into blocked Bloom filters, one shard for each
length, of 16 bits a word, so an edit is one look at one block of 64 bytes. Edits
that pass, the true ones and about one in a thousand others, are shuffled to an
exact join with the vocabulary.

The filters are broadcast in portions of at most ``FILTER_BYTES``. A larger
vocabulary takes more passes over itself, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.scratch import Scratch
from broadsheet.llm.words import mix
from broadsheet.session import broadcast_if_small, spread

FILTER_BYTES = 32 << 20  # of filters broadcast at a time
BITS = 16  # of filter for each word
PROBES = 7  # bits set for each word in its block
LONGEST = 64  # longer words share one shard
EDITS = 1 << 20  # edits held at a time

_BLOCK = 512  # bits of a block
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _values(place: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Random value of a code point at a place of a word; the hash of a word is made from their sum."""
    return mix((place.astype(np.uint64) << np.uint64(21) | code.astype(np.uint64)) * _STEP + _STEP)


def _hashed(total: np.ndarray, length: int) -> np.ndarray:
    return mix(total + np.uint64(length) * _STEP)


def _by_length(words: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Words of equal length together: the length, their rows, and their code points as a matrix."""
    texts = np.asarray(words.to_pylist(), dtype=object)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    for length in np.unique(sizes):
        rows = np.flatnonzero(sizes == length)
        yield int(length), rows, np.frombuffer("".join(texts[rows]).encode("utf-32-le"), np.uint32).reshape(len(rows), int(length))


def _shard(length: int) -> int:
    return min(length, LONGEST)


def _block(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """Block of each hash within its shard."""
    return ((hashes >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def _marks(hashes: np.ndarray) -> np.ndarray:
    """The block pattern of each hash: eight 64-bit words with ``PROBES`` bits set."""
    out = np.zeros((len(hashes), _BLOCK // 64), np.uint64)
    row = np.arange(len(hashes))
    bits = mix(hashes + _STEP)
    for _ in range(PROBES):
        bit = bits & np.uint64(_BLOCK - 1)
        out[row, (bit >> np.uint64(6)).astype(np.int64)] |= np.uint64(1) << (bit & np.uint64(63))
        bits >>= np.uint64(9)
    return out


def _passes(hashes: np.ndarray, block: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Whether all bits of a hash are set in its block of ``held``."""
    found = np.ones(len(hashes), bool)
    bits = mix(hashes + _STEP)
    for _ in range(PROBES):
        bit = bits & np.uint64(_BLOCK - 1)
        found &= (held[block, (bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
        bits >>= np.uint64(9)
    return found


class _Layout:
    """Blocks of each shard, numbered through."""

    def __init__(self, words_by_shard: dict[int, int]):
        self.blocks, self.first, self.total = {}, {}, 0
        for shard, count in sorted(words_by_shard.items()):
            self.blocks[shard], self.first[shard] = -(-count * BITS // _BLOCK), self.total
            self.total += self.blocks[shard]

    def place(self, hashes: np.ndarray, length: int) -> np.ndarray | None:
        """Number of each hash's block, None if no word has that length."""
        shard = _shard(length)
        return self.first[shard] + _block(hashes, self.blocks[shard]) if shard in self.blocks else None


def _filters(vocabulary: DataFrame, layout: _Layout) -> DataFrame:
    """block, bits_0 to bits_7: the filters, words of one block combined on the map side first."""
    names = [f"bits_{i}" for i in range(_BLOCK // 64)]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, _, codes in _by_length(batch.column("word")):
                hashes = _hashed(_values(np.arange(length), codes).sum(axis=1, dtype=np.uint64), length)
                bits = _marks(hashes).view(np.int64)
                yield pa.record_batch([pa.array(layout.place(hashes, length)), *[pa.array(bits[:, i]) for i in range(bits.shape[1])]],
                                      names=["block", *names])

    marked = vocabulary.select("word").mapInArrow(mark, "block bigint, " + ", ".join(f"{n} bigint" for n in names))
    return marked.groupBy("block").agg(*[F.bit_or(n).alias(n) for n in names])


def _edits(length: int, codes: np.ndarray, letters: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]]:
    """hashes, length, row, place and letter (0: deleted) of all edits of words of one length that this side generates."""
    place = np.arange(length)
    at = _values(place, codes)
    total = at.sum(axis=1, dtype=np.uint64)
    # Of equal neighbours the last one is deleted, so that an edit comes once.
    row, gone = np.nonzero(np.concatenate([codes[:, 1:] != codes[:, :-1], np.ones((len(codes), 1), bool)], axis=1))
    if length > 1:
        before = np.cumsum(at, axis=1, dtype=np.uint64) - at
        moved = _values(np.maximum(place - 1, 0), codes)
        behind = moved.sum(axis=1, dtype=np.uint64)[:, None] - np.cumsum(moved, axis=1, dtype=np.uint64)
        yield _hashed(before[row, gone] + behind[row, gone], length - 1), length - 1, row, gone, np.zeros(len(row), np.uint32)
    row, spot, letter = np.nonzero(letters[None, None, :] > codes[:, :, None])
    new = _values(place[:, None], letters[None, :])
    yield _hashed(total[row] - at[row, spot] + new[spot, letter], length), length, row, spot, letters[letter]


def _positives(vocabulary: DataFrame, layout: _Layout, filters: DataFrame, letters: np.ndarray, low: int, high: int) -> tuple[DataFrame, Broadcast]:
    """word, n, edit: the edits that the blocks ``low`` to ``high`` - 1 let through; the broadcast blocks, to be destroyed."""
    rows = filters.filter(f"block >= {low} and block < {high}").toArrow()  # at most FILTER_BYTES and the blocks' numbers
    held = np.zeros((high - low, _BLOCK // 64), np.uint64)
    for i in range(held.shape[1]):
        held[rows.column("block").to_numpy() - low, i] = rows.column(f"bits_{i}").to_numpy().view(np.uint64)
    shared = vocabulary.sparkSession.sparkContext.broadcast(held)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            texts, counts = batch.column("word").to_pylist(), batch.column("n")
            for length, rows, codes in _by_length(batch.column("word")):
                step = max(1, EDITS // (length * (len(letters) + 1)))
                for start in range(0, len(rows), step):
                    for hashes, size, row, spot, letter in _edits(length, codes[start : start + step], letters):
                        block = layout.place(hashes, size)
                        if block is None:
                            continue
                        here = np.flatnonzero((block >= low) & (block < high))
                        passed = here[_passes(hashes[here], block[here] - low, bits)]
                        of = rows[start + row[passed]]
                        edits = [texts[r][:p] + (chr(c) if c else "") + texts[r][p + 1 :]
                                 for r, p, c in zip(of.tolist(), spot[passed].tolist(), letter[passed].tolist())]
                        yield pa.record_batch([batch.column("word").take(pa.array(of)), counts.take(pa.array(of)), pa.array(edits, pa.string())],
                                              names=["word", "n", "edit"])

    return vocabulary.mapInArrow(probe, "word string, n bigint, edit string"), shared


def near_words(vocabulary: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """word, n, other, other_n: all ordered pairs of near words.

    ``vocabulary``: word (distinct, not null, not empty), n; a written table, since it is read several times.
    """
    scratch = Scratch(vocabulary, "near-words")
    sizes = vocabulary.groupBy(F.least(F.length("word"), F.lit(LONGEST)).alias("shard")).count().collect()  # at most LONGEST rows
    layout = _Layout({r["shard"]: r["count"] for r in sizes})
    # The alphabet: no more rows than there are code points, some ninety for Latin words.
    letters = np.array(sorted(ord(r[0]) for r in vocabulary.select(F.explode(F.split("word", ""))).distinct().collect() if r[0]), np.uint32)
    filters = scratch.keep(_filters(vocabulary, layout))
    rows, found, passed = spread(vocabulary.select("word", "n")), None, []
    step = max(1, filter_bytes * 8 // _BLOCK)
    for low in range(0, layout.total, step):
        positives, shared = _positives(rows, layout, filters, letters, low, min(low + step, layout.total))
        passed.append(scratch.keep(positives))
        shared.destroy()
        found = passed[-1] if found is None else found.unionByName(passed[-1])
    scratch.drop(filters)
    if found is None:
        found = vocabulary.select("word", "n", F.lit("").alias("edit")).limit(0)
    exact = found.join(vocabulary.select(F.col("word").alias("edit"), F.col("n").alias("edit_n")), "edit")

    def side(word: str, n: str, other: str, other_n: str) -> Column:
        return F.struct(F.col(word).alias("word"), F.col(n).alias("n"), F.col(other).alias("other"), F.col(other_n).alias("other_n"))

    return exact.select(F.explode(F.array(side("word", "n", "edit", "edit_n"), side("edit", "edit_n", "word", "n"))).alias("p")).select("p.*")


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root: where the chain of forms ends. Every round doubles the steps, and a form is some times as frequent as its word."""
    reached = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = scratch.keep(reached.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further"))
        if longer.filter("further is not null").isEmpty():
            return longer.select("word", "root")
        reached = longer.select("word", "root")


def group_variants(vocabulary: DataFrame, times: int = 5, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """word, n, n_near, form, form_n, root: one row per word.

    ``vocabulary``: word, n (how often it occurs); other columns are not read. Rows without
    word or with an empty one take no part, a null n counts 0, and rows that repeat a word
    are one word with the sum of their n. ``form``: the near word of largest n, of equal
    ones the first in code-point order, if its n is at least ``times`` (2 or more) times
    the word's own and above 0, else null. ``root``: the end of the chain of forms, the word itself if
    it has none. Words of any length and alphabet are allowed. An empty table gives an
    empty one.
    """
    scratch = Scratch(vocabulary, "variants")
    clean = vocabulary.filter("word <> ''").groupBy("word").agg(F.sum(F.coalesce("n", F.lit(0))).cast("bigint").alias("n"))
    words = scratch.keep(clean)
    # A word has no more near words than edits, so no group grows with the vocabulary.
    best = near_words(words, filter_bytes).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form"))).alias("best"))
    taken = (-F.col("best.minus") >= F.col("n") * times) & (F.col("best.minus") < 0)
    judged = scratch.keep(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(taken, F.col("best.form")).alias("form"), F.when(taken, -F.col("best.minus")).alias("form_n"),
    ))
    roots = _roots(judged.filter("form is not null").select("word", "form"), scratch)
    return judged.join(broadcast_if_small(roots), "word", "left").withColumn("root", F.coalesce("root", "word"))
