"""Runs of words that repeat with a period: a suffix automaton whose paths to the root are coloured by last occurrence.

The words of a stretch are put into a suffix automaton. Its links form a tree in
which the ancestors of a prefix's state are the prefix's suffixes. Words are then
appended one after another: the path from the new prefix to the root is accessed,
as in a link-cut tree, and takes the new end as its colour. The path falls into
segments of one colour, the end of the last occurrence. Where the deepest suffix of
a segment is at least as long as the distance from that end to the new one, a
square ends here; it is one place of the run with the same start and period, which
grows with every word that keeps the period.

A path is a splay tree by depth, of one colour, kept at its root, so an access
costs the logarithm of the stretch on average, and a stretch of n words n log n.

Only stretches that can hold a run are put through this. A run of period q and
exponent e repeats all its groups of k <= q words at distance q, (e - 1) q - k + 1 in a
row, so the stretch is found, for q between two powers of two, as that many groups in
a row that each have an equal one at most that far before. That is a necessary
condition: no run is lost, and running text is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from broadsheet.llm.words import Words, mix, runs as pieces, words

GROUP = 8  # words compared as one group at most
_FAR = np.iinfo(np.int64).max
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _automaton(text: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Length and link of every state, and the state of every prefix. State 1 is the root, 0 is none."""
    length, link, after, prefix = [0, 0], [0, 0], [{}, {}], []
    last = 1
    for word in text:
        state = len(length)
        length.append(length[last] + 1)
        link.append(1)
        after.append({})
        p = last
        while p and word not in after[p]:
            after[p][word] = state
            p = link[p]
        if p:
            q = after[p][word]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                after.append(after[q].copy())
                while p and after[p].get(word) == q:
                    after[p][word] = clone
                    p = link[p]
                link[q] = link[state] = clone
        prefix.append(state)
        last = state
    return length, link, prefix


def _rotate(x: int, up: list[int], left: list[int], right: list[int], colour: list[int]) -> None:
    """Lift ``x`` over its parent in the splay tree; the colour stays at the tree's root."""
    p = up[x]
    g = up[p]
    if left[g] == p:
        left[g] = x
    elif right[g] == p:
        right[g] = x
    else:
        colour[x] = colour[p]
    if left[p] == x:
        moved = left[p] = right[x]
        right[x] = p
    else:
        moved = right[p] = left[x]
        left[x] = p
    if moved:
        up[moved] = p
    up[p], up[x] = x, g


def repetitions(text: list[int], least: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in ``text`` of at least ``least`` words and ``exponent`` >= 2 periods, by start and period."""
    length, up, prefix = _automaton(text)
    count = len(length)
    left, right, colour = [0] * count, [0] * count, [-1] * count
    found: dict[tuple[int, int], int] = {}
    for end, state in enumerate(prefix):
        below, x = 0, state
        while x:
            p = up[x]
            while p and (left[p] == x or right[p] == x):
                g = up[p]
                if g and (left[g] == p or right[g] == p):
                    _rotate(p if (left[g] == p) == (left[p] == x) else x, up, left, right, colour)
                _rotate(x, up, left, right, colour)
                p = up[x]
            before = colour[x]
            if before >= 0:
                period = end - before
                if length[x] >= (exponent - 1) * period:
                    found[end - length[x] - period + 1, period] = end
            if right[x]:
                colour[right[x]] = before  # the rest of the old path keeps its colour
            right[x] = below
            below, x = x, p
        colour[below] = end
    kept = ((start, end - start + 1, period) for (start, period), end in found.items())
    return sorted((r for r in kept if r[1] >= least), key=lambda r: (r[0], r[2]))


def _back(groups: np.ndarray) -> np.ndarray:
    """How far before each value its last equal lies."""
    order = np.argsort(groups, kind="stable")
    equal = np.flatnonzero(groups[order[1:]] == groups[order[:-1]])
    out = np.full(len(groups), _FAR)
    out[order[equal + 1]] = order[equal + 1] - order[equal]
    return out


def stretches(hashes: np.ndarray, first: np.ndarray, least: int, exponent: int) -> list[tuple[int, int]]:
    """Stretches (start, stop) of words, apart from each other, such that every run of every text lies in one."""
    sizes = np.diff(first)
    longest = int(sizes.max(initial=0))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    groups = mix(hashes ^ mix((owner.astype(np.uint64) + np.uint64(1)) * _STEP))  # texts share no group
    k, low, back, found = 1, 1, _back(groups), []
    while low * exponent <= longest:
        high = 2 * low - 1  # periods low to high
        need = max(1, (exponent - 1) * low - k + 1, least - high - k + 1)
        near = np.concatenate([[False], back <= high, [False]])
        edges = np.flatnonzero(near[1:] != near[:-1])
        begin, end = edges[::2], edges[1::2]
        for a, b in zip(begin[end - begin >= need], end[end - begin >= need]):
            text = owner[a]
            found.append((max(int(first[text]), int(a) - high), min(int(first[text + 1]), int(b) + k - 1)))
        low *= 2
        if k < GROUP:
            whole = owner[: len(owner) - 2 * k + 1] == owner[2 * k - 1 :] if len(owner) >= 2 * k else np.empty(0, bool)
            groups = mix(groups[: len(whole)] * _STEP + groups[k : k + len(whole)])
            k *= 2
            back = np.full(len(hashes), _FAR)
            part = _back(groups)
            back[: len(whole)][whole] = part[whole]
    merged: list[tuple[int, int]] = []
    for start, stop in sorted(found):
        if merged and start < merged[-1][1]:
            merged[-1] = merged[-1][0], max(merged[-1][1], stop)
        else:
            merged.append((start, stop))
    return merged


def _runs_of(found: Words, least: int, exponent: int) -> list[list[tuple[int, int, int]]]:
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(found.first) - 1)]
    for start, stop in stretches(found.hashes, found.first, least, exponent):
        text = int(np.searchsorted(found.first, start, "right")) - 1
        at = start - int(found.first[text])
        _, numbers = np.unique(found.hashes[start:stop], return_inverse=True)
        out[text] += [(at + s, n, q) for s, n, q in repetitions(numbers.tolist(), least, exponent)]
    return out


def _joined(found: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each text with one space between."""
    size = found.stop - found.start + 1
    size[~kept] = 0
    words_before = np.concatenate([[0], np.cumsum(kept)])
    last = np.flatnonzero(kept)[words_before[found.first[1:]][words_before[found.first[1:]] > words_before[found.first[:-1]]] - 1]
    size[last] -= 1  # no space behind a text's last word
    total = np.concatenate([[0], np.cumsum(size)])
    chosen = np.flatnonzero(kept)
    place = np.arange(total[-1]) - np.repeat(total[chosen], size[chosen])
    length = np.repeat((found.stop - found.start)[chosen], size[chosen])
    source = np.minimum(np.repeat(found.start[chosen], size[chosen]) + place, max(len(found.data) - 1, 0))
    data = np.where(place < length, found.data[source], np.uint8(32)).astype(np.uint8) if total[-1] else np.empty(0, np.uint8)
    offsets = total[found.first].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, in words from 0), collapsed: one row per document.

    ``docs``: doc_id, text; other columns are not read. A word is a run of bytes other than
    ASCII white space, A differs from a, and words are compared by 64-bit hashes. A run is a
    longest stretch with smallest period q of at least ``least`` words and ``exponent`` (2 or
    more) times q words; runs are in order of start and period. ``collapsed`` has the words
    that no run holds behind its first q, with one space between. Null and empty texts have
    no words, no runs and an empty ``collapsed``. Equal rows give equal results, an empty
    table an empty one.

    Rows stay where they are: nothing is shuffled. Memory grows with the longest stretch
    of one text that repeats itself.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in pieces(batch.column("text")):
                found = words(batch.column("text").slice(start, stop - start), cased=True)
                runs = _runs_of(found, least, exponent)
                kept = np.ones(len(found.hashes), bool)
                for text, own in enumerate(runs):
                    for s, n, q in own:
                        kept[found.first[text] + s + q : found.first[text] + s + n] = False
                listed = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in own] for own in runs], _RUNS)
                yield pa.record_batch(
                    [batch.column("doc_id").slice(start, stop - start), pa.array(np.diff(found.first), pa.int64()), listed,
                     _joined(found, kept).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        find, f"doc_id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
