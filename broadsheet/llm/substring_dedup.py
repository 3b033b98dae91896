"""Substring deduplication by hashing units of lines.

Texts are cut into units at line ends and sentence ends; short sentences are mostly
joined with the next one, so a unit has some words to tell it by, and long stretches
without an end are cut behind words picked by their hash. All cuts depend on the words
around them only, so a passage is cut alike wherever it stands. A short line is a unit of its
own, and runs of short lines are also cut once more as if they were one line, so a passage
that is set in narrow lines is found where its lines end elsewhere too. Units are normalised
(A-Z as a-z, white space as one), hashed, and grouped over all texts. The first occurrence
in the order of doc_id and place stays, the others are removed, with the offsets that they
had in the original text. A sentence that goes on, without a full stop, into a
capitalised word is also looked up from there, which finds passages pasted into the
middle of a sentence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from broadsheet.llm.scratch import Scratch
from broadsheet.llm.words import Words, mix, runs, words
from broadsheet.session import broadcast_if_small

LEAST = 8  # words of a unit that is no whole line


def _joined(first: np.ndarray, sizes: np.ndarray, hard: np.ndarray, last: np.ndarray, least: int) -> np.ndarray:
    """First word of each unit, from the first words and sizes of sentences. ``hard``: sentences that begin a line; ``last``: hash of the last word.

    A sentence may end a unit if it has ``least`` words, and a shorter one if its last word's
    hash says so, the rarer the shorter it is; it does end one that has ``least`` words by then.
    """
    opens = hard.copy()
    every = np.maximum(-(-2 * least // sizes), 1)
    opens[1:] |= ((sizes >= least) | (last % every.astype(np.uint64) == 0))[:-1]
    units = np.flatnonzero(opens)
    end = first[-1] + sizes[-1]
    kept, size = [], 0
    for place, (begins, words_) in enumerate(zip(hard[units].tolist(), np.diff(np.append(first[units], end)).tolist())):
        if begins or size >= least:  # a unit that is still too short takes in the next one of its line
            kept.append(place)
            size = 0
        size += words_
    units = units[kept]
    total = np.diff(np.append(first[units], end))
    return first[units[hard[units] | (total >= least)]]  # what is left over at the end of a line goes with the unit before


def _sentences(line: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words that begin a sentence; ``ends``: words that end one."""
    sentence = line.copy()
    sentence[1:] |= ends[:-1]
    return sentence


def _cuts(hashes: np.ndarray, line: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and word behind the last of every unit. Those under ``least`` words are whole lines."""
    n = len(hashes)
    sentence = _sentences(line, ends)
    first = np.flatnonzero(sentence)
    behind = np.concatenate([first[1:], [n]])
    picked = np.flatnonzero((hashes[:-1] % np.uint64(2 * least) == 0) & (np.repeat(behind - first, behind - first)[:-1] >= 4 * least))
    pieces = sentence
    pieces[picked + 1] = True
    cuts = np.flatnonzero(pieces)
    after = np.concatenate([cuts[1:], [n]])
    units = _joined(cuts, after - cuts, line[cuts], hashes[after - 1], least)
    return units, np.concatenate([units[1:], [n]])


def _short_runs(line: np.ndarray, fresh: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of runs of two or more lines under ``least`` words each, and which of these words begin a run."""
    first = np.flatnonzero(line)
    sizes = np.diff(np.append(first, len(line)))
    short = sizes < least
    goes_on = np.zeros(len(first), bool)
    goes_on[1:] = short[1:] & short[:-1] & ~fresh[first[1:]]
    several = goes_on.copy()
    several[:-1] |= goes_on[1:]
    begins = np.zeros(len(line), bool)
    begins[first[several & ~goes_on]] = True
    inside = np.flatnonzero(np.repeat(several, sizes))
    return inside, begins[inside]


def _units(found: Words, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, word behind the last, and digest of every unit, of those of runs of short lines, and of the ends of sentences that count as well."""
    n = len(found.hashes)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    data, start, stop, owner = found.data, found.start, found.stop, found.owner()
    lines = np.concatenate([[0], np.cumsum((data == 10) | (data == 13))])[start]
    fresh = np.ones(n, bool)
    fresh[1:] = owner[1:] != owner[:-1]
    line = fresh.copy()
    line[1:] |= lines[1:] != lines[:-1]
    last, before = data[stop - 1], data[np.maximum(stop - 2, start)]
    ends = np.isin(last, np.frombuffer(b".!?", np.uint8)) | (np.isin(last, np.frombuffer(b"\"')]", np.uint8)) & np.isin(before, np.frombuffer(b".!?", np.uint8)))
    low, high = _cuts(found.hashes, line, ends, least)
    inside, begins = _short_runs(line, fresh, least)
    if len(inside):
        begin, end = _cuts(found.hashes[inside], begins, ends[inside], least)
        long = end - begin >= least
        low, high = np.concatenate([low, inside[begin[long]]]), np.concatenate([high, inside[end[long] - 1] + 1])
    sentence = _sentences(line, ends)
    first = np.flatnonzero(sentence)
    behind = np.concatenate([first[1:], [n]])
    letter = data[start]
    second = data[np.minimum(start + 1, len(data) - 1)]
    capital = ((letter >= 65) & (letter <= 90)) | ((letter == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    inner = capital & ~sentence
    inner[1:] &= ~capital[:-1]
    place = np.flatnonzero(inner)
    within = np.searchsorted(first, place, "right") - 1
    final = np.ones(len(place), bool)
    final[:-1] = within[1:] != within[:-1]  # the last such word of a sentence
    tails, until = place[final], behind[within[final]]
    long = until - tails >= least
    low, high = np.concatenate([low, tails[long]]), np.concatenate([high, until[long]])
    return low, high, _digests(found.hashes, low, high)


def _digests(hashes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Digest of the words in each span, in their order."""
    out = np.empty(len(low), np.uint64)
    for a in range(0, len(low), 1 << 14):
        size = (high - low)[a : a + (1 << 14)]
        begin = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(begin, size)
        word = hashes[place + np.repeat(low[a : a + len(size)], size)]
        out[a : a + len(size)] = np.add.reduceat(mix(word + mix(place.astype(np.uint64))), begin) + size.astype(np.uint64)
    return mix(out)


def _unit_rows(docs: DataFrame, least: int) -> DataFrame:
    """digest, doc_id, text_hash, start and stop (characters) of every unit."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for a, b in runs(column):
                found = words(column.slice(a, b - a))
                low, high, digests = _units(found, least)
                owner = np.searchsorted(found.first, low, "right") - 1
                characters = np.concatenate([[0], np.cumsum((found.data & 0xC0) != 0x80)])
                base = characters[found.offsets[owner]]
                index = pa.array(owner + a)
                yield pa.record_batch(
                    [pa.array(digests.view(np.int64)), batch.column("doc_id").take(index), batch.column("text_hash").take(index),
                     pa.array((characters[found.start[low]] - base).astype(np.int32)),
                     pa.array((characters[found.stop[high - 1]] - base).astype(np.int32))],
                    names=["digest", "doc_id", "text_hash", "start", "stop"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(make, f"digest bigint, doc_id {kind}, text_hash bigint, start int, stop int")


@F.arrow_udf(StringType())
def _cut(text: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for value, removed in zip(text.to_pylist(), spans.to_pylist()):
        if value is not None and removed:
            pieces, at = [], 0
            for span in removed:
                pieces.append(value[at : max(at, span["start"])])
                at = max(at, span["stop"])
            value = "".join(pieces) + value[at:]
        out.append(value)
    return pa.array(out, pa.string())


def dedup(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Remove lines of any length, and units of at least ``least`` words, that occur before, in another text or in the same one.

    ``docs``: doc_id, text; other columns are not read. Returns two frames:

    * one row per document: doc_id, text (what is left, separators included), removed: array
      of (start, stop, first_doc, first_start), in order, with offsets in characters of
      the original text, stop behind the last, and the occurrence that stays.
    * the removed units, one row each: doc_id, text_hash, start, stop, digest, first_doc, first_start.

    The earliest occurrence is that of the least doc_id, then of the least offset; rows
    without doc_id come first. Null and empty texts stay as they are and have no units.
    Rows that repeat a doc_id with the same text are one document and all get its
    result; with another text they are another one, in order of the text's hash. Empty
    tables give empty frames.
    """
    scratch = Scratch(docs, "substring-dedup")
    units = _unit_rows(docs, least)
    place = F.struct("doc_id", "text_hash", "start")
    repeated = scratch.keep(
        units.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last")
        .select("digest", "first")
    )
    removed = scratch.keep(
        units.join(broadcast_if_small(repeated), "digest")
        .filter(~place.eqNullSafe(F.col("first")))
        .select("doc_id", "text_hash", "start", "stop", "digest", F.col("first.doc_id").alias("first_doc"), F.col("first.start").alias("first_start"))
        .distinct()
    )
    scratch.drop(repeated)
    spans = removed.groupBy(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash")).agg(
        F.sort_array(F.collect_list(F.struct("start", "stop", "first_doc", "first_start"))).alias("removed"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")), "left")
    none = F.array().cast(dict(spans.dtypes)["removed"])
    return joined.select("doc_id", _cut("text", "removed").alias("text"), F.coalesce("removed", none).alias("removed")), removed
