"""N-gram Jaccard join: all pairs of texts whose shingle sets overlap enough, and their components.

Equal sets are one class; only classes are compared. A class is looked up under
the rarest of its shingles: two sets that reach the threshold share one of the
first ``n - ceil(threshold * n) + 1`` in any common order, so no link is lost. All
classes that share such a shingle go to the tiles of the least class among them.
Tiles are cut by size band, and once more by hash where they would hold too many
classes or shingles. Inside a tile, bitmaps of hashed shingles bound every
pair's overlap from above by their bit counts; what may still reach the
threshold is settled by intersecting the sorted arrays.

Sets are compared by 64-bit hashes of their shingles. Only sets that share a
rare shingle with another one are ever moved in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.components import connected
from broadsheet.llm.scratch import Scratch
from broadsheet.llm.words import mix, runs, shingle_sets, shingles
from broadsheet.llm.words import words as word_runs
from broadsheet.session import broadcast_if_small, stage

WORD_COUNTERS, SHINGLE_COUNTERS = 1 << 16, 1 << 18
_FINE = 64  # steps of a power of two in estimates
TILE_SETS, TILE_SHINGLES = 1024, 1 << 22  # a tile holds about twice as many at most
BAND = 1.5  # ratio of sizes in a band
SMALL_BITS, BITS = 2, 16  # bitmap bits for each shingle, in the first look and in the second
ROWS = 2000  # rows of an Arrow batch that are written

_TILE = ["hub", "band", "low", "high"]


class _Frequency:
    """Estimates how often a shingle occurs, from counters of words and of shingles over all texts.

    The estimate only orders shingles, so its errors cost time, never links. It is
    the larger of what the words' frequencies suggest and of what the shingle's
    counter holds above the common level.
    """

    def __init__(self, counters: np.ndarray):
        words, found = counters[:WORD_COUNTERS], counters[WORD_COUNTERS:]
        total = max(int(words.sum()), 1)
        self.word = np.rint(_FINE * np.log2(np.maximum(words, 1) / total)).astype(np.int64)
        self.total = int(_FINE * np.log2(total))
        above = np.maximum(found - 1.25 * found.mean(), 0)
        self.above = np.rint(_FINE * np.log2(above + 2.0**-40)).astype(np.int64)

    def of_words(self, hashes: np.ndarray) -> np.ndarray:
        return self.word[hashes % np.uint64(WORD_COUNTERS)]

    def classes(self, found: np.ndarray, of_words: np.ndarray) -> np.ndarray:
        """Small numbers, rising with the estimate."""
        estimate = np.maximum(of_words + self.total, self.above[found % np.uint64(SHINGLE_COUNTERS)])
        return np.clip(estimate // (_FINE // 4) + 160, 0, 255).astype(np.uint64)


def _frequency(docs: DataFrame, words: int) -> _Frequency:
    """Count words and shingles of all texts by hash. What reaches the driver is a counter each, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(WORD_COUNTERS + SHINGLE_COUNTERS, np.int64)
        for batch in batches:
            column = batch.column(0)
            for start, stop in runs(column):
                found = word_runs(column.slice(start, stop - start))
                counters[:WORD_COUNTERS] += np.bincount((found.hashes % np.uint64(WORD_COUNTERS)).astype(np.int64), minlength=WORD_COUNTERS)
                values, _, _ = shingles(found, words)
                counters[WORD_COUNTERS:] += np.bincount((values % np.uint64(SHINGLE_COUNTERS)).astype(np.int64), minlength=SHINGLE_COUNTERS)
        used = np.flatnonzero(counters)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(counters[used])], names=["counter", "n"])

    counted = docs.select("text").mapInArrow(count, "counter int, n bigint").groupBy("counter").agg(F.sum("n").alias("n"))
    total = np.zeros(WORD_COUNTERS + SHINGLE_COUNTERS, np.int64)
    found = counted.toArrow()
    total[found["counter"].to_numpy()] = found["n"].to_numpy()
    return _Frequency(total)


def _least_overlap(size, of: int, out_of: int):
    """Shingles that a set of this size shares with any set that it is linked to, at least."""
    return -(-size * of // out_of)


def _sets(docs: DataFrame, words: int, of: int, out_of: int) -> DataFrame:
    """doc_id, hash of the text, size, digest of the set, the rare shingles under which it is looked up, and a small bitmap.

    A task lists the shingles and the bitmap of equal sets once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_frequency(docs, words))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, seen = shared.value, set()
        for batch in batches:
            column = batch.column("text")
            for start, stop in runs(column):
                found = word_runs(column.slice(start, stop - start))
                values, first, weights = shingles(found, words, frequency.of_words(found.hashes))
                sizes, digests, keys, maps = [], [], [], []
                for i in range(stop - start):
                    one, where = np.unique(values[first[i] : first[i + 1]], return_index=True)
                    n, digest = len(one), _digest(one)
                    sizes.append(n)
                    digests.append(digest)
                    if n == 0 or digest in seen:
                        keys.append(np.empty(0, np.int64))
                        maps.append(None)
                        continue
                    seen.add(digest)
                    maps.append(_bitmap(one, _length(n, SMALL_BITS)).tobytes())
                    classes = frequency.classes(one, weights[first[i] : first[i + 1]][where])
                    order = np.argsort(classes << np.uint64(56) | one >> np.uint64(8), kind="stable")
                    keys.append(one[order[: n - _least_overlap(n, of, out_of) + 1]].view(np.int64))
                yield pa.record_batch(
                    [batch.column("doc_id").slice(start, stop - start), batch.column("text_hash").slice(start, stop - start),
                     pa.array(sizes, pa.int64()), pa.array(digests, pa.int64()), pa.array(keys, pa.list_(pa.int64())),
                     pa.array(maps, pa.binary())],
                    names=["doc_id", "text_hash", "size", "digest", "keys", "bits"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(make, f"doc_id {kind}, text_hash bigint, size bigint, digest bigint, keys array<bigint>, bits binary")


def _digest(found: np.ndarray) -> int:
    """One number for a set; equal sets have the same."""
    total = np.add.reduce(mix(found ^ np.uint64(0x5851F42D4C957F2D)), keepdims=True) + np.uint64(len(found))
    return int(mix(total).view(np.int64)[0])


def _arrays(docs: DataFrame, words: int) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: list[np.ndarray] = []
            for found in shingle_sets(batch.column(0), words):
                kept.append(found)
                if len(kept) == ROWS:
                    yield _packed(kept)
                    kept = []
            yield _packed(kept)

    def _packed(kept: list[np.ndarray]) -> pa.RecordBatch:
        return pa.record_batch(
            [pa.array([_digest(x) for x in kept], pa.int64()), pa.array([len(x) for x in kept], pa.int64()),
             pa.array([x.view(np.int64) for x in kept], pa.list_(pa.int64()))],
            names=["digest", "size", "shingles"],
        )

    return docs.select("text").mapInArrow(make, "digest bigint, size bigint, shingles array<bigint>")


def _length(size: int, per_shingle: int) -> int:
    """Bits of a bitmap, a power of two."""
    bits = 64
    while bits < per_shingle * size:
        bits *= 2
    return bits


def _bitmap(found: np.ndarray, bits: int) -> np.ndarray:
    flags = np.zeros(bits, np.uint8)
    flags[(found & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def _folded(maps: list[np.ndarray]) -> np.ndarray:
    """Bitmaps as one matrix, the longer ones folded to the shortest: bits that fall together are joined."""
    words = min(map(len, maps))
    return np.array([np.bitwise_or.reduce(m.reshape(-1, words), axis=0) for m in maps])


class _Pairs:
    """The pairs of a tile that may be linked by size and by their bitmaps' bit counts."""

    def __init__(self, tile: pa.Table, maps: list[np.ndarray], of: int, out_of: int):
        self.sizes, self.of, self.out_of = tile["size"].to_numpy(), of, out_of
        self.block, self.guest = tile["block"].to_numpy(), tile["guest"].to_numpy()
        self.cross = self.block.min() != self.block.max()
        self.maps = _folded(maps)
        self.ones = np.bitwise_count(self.maps).sum(axis=1, dtype=np.int64)

    def after(self, i: int, wanted: np.ndarray | None = None) -> np.ndarray:
        """Rows behind row ``i``, in order of size, that may be linked to it."""
        sizes = self.sizes
        end = np.searchsorted(sizes, sizes[i] * self.out_of // self.of, "right")  # beyond, sizes differ too much
        others = np.arange(i + 1, end)
        keep = ~(self.guest[i] & self.guest[others])
        if self.cross:
            keep &= self.block[others] != self.block[i]
        if wanted is not None:
            keep &= wanted[others]
        others = others[keep]
        both = np.bitwise_count(self.maps[others] & self.maps[i]).sum(axis=1, dtype=np.int64)
        most = np.minimum(sizes[i] - self.ones[i] + both, sizes[others] - self.ones[others] + both)
        return others[most * (self.of + self.out_of) >= self.of * (sizes[i] + sizes[others])]


def _per_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The tiles of a partition that is sorted by tile, size and digest; equal sets of a tile once."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        edges = _edges(rest, _TILE)
        for low, high in zip(edges[:-2], edges[1:-1]):
            yield _once(rest.slice(low, high - low))
        rest = rest.slice(edges[-2])
    if rest is not None and rest.num_rows:
        yield _once(rest)


def _edges(table: pa.Table, columns: list[str]) -> list[int]:
    """Where the values of the columns change, with both ends."""
    changes = np.zeros(max(table.num_rows - 1, 0), bool)
    for name in columns:
        values = table[name].to_numpy()
        changes |= values[1:] != values[:-1]
    return [0, *(np.flatnonzero(changes) + 1).tolist(), table.num_rows]


def _once(tile: pa.Table) -> pa.Table:
    return tile.take(pa.array(_edges(tile, ["digest"])[:-1])).combine_chunks()


def _hopeful(tile: pa.Table, of: int, out_of: int) -> np.ndarray:
    """Which rows of a tile small bitmaps allow a link."""
    pairs = _Pairs(tile, [np.frombuffer(x.as_buffer(), np.uint64) for x in tile["bits"]], of, out_of)
    marked = np.zeros(tile.num_rows, bool)
    for i in range(tile.num_rows - 1):
        found = pairs.after(i)
        marked[found] = True
        marked[i] |= len(found) > 0
    return marked


def _linked(tile: pa.Table, of: int, out_of: int, every: bool) -> list[tuple[int, int, int]]:
    """Links inside a tile: digest, digest, shared shingles. Unless ``every``, only as many as join all that belong together."""
    sets = [x.values.to_numpy().view(np.uint64) for x in tile["shingles"]]
    ids, sizes = tile["digest"].to_numpy(), tile["size"].to_numpy()
    bits = _length(max(map(len, sets)), BITS)
    pairs = _Pairs(tile, [_bitmap(x, bits) for x in sets], of, out_of)
    group = np.arange(len(ids))
    links = []
    for i in range(len(ids) - 1):
        for j in pairs.after(i, None if every else group != group[i]):
            if not every and group[j] == group[i]:
                continue
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if shared * (of + out_of) >= of * (sizes[i] + sizes[j]):
                links.append((ids[i], ids[j], shared))
                group[group == group[j]] = group[i]
    return links


def _band(size):
    return F.floor(F.log(BAND, size)).cast("int")


def _bands(of: int, out_of: int):
    """The bands of all sets that are no larger and may be linked to one of this size."""
    return F.sequence(_band(F.ceil(F.col("size") * of / out_of)), _band(F.col("size")))


def _tiles(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Deal the members of each hub and band to tiles."""
    sized = members.join(sizes, "digest")
    total = sized.groupBy("hub", "band").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    parts = total.select("hub", "band", F.greatest(F.ceil(F.col("n") / TILE_SETS), F.ceil(F.col("s") / TILE_SHINGLES)).alias("parts"))
    placed = (
        sized.join(parts, ["hub", "band"])
        .withColumn("block", F.pmod(F.xxhash64("digest"), F.col("parts")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    )
    return placed.select(
        "hub", "band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "block", (F.col("band") != _band(F.col("size"))).alias("guest"), "digest", "size",
    )


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_TILE).sortWithinPartitions(*_TILE, "size", "digest")


def _hopefuls(tiles: DataFrame, maps: DataFrame, of: int, out_of: int) -> DataFrame:
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _per_tile(batches):
            if tile.num_rows > 1:
                yield from tile.select(["hub", "band", "digest"]).filter(pa.array(_hopeful(tile, of, out_of))).to_batches()

    return _dealt(tiles.join(maps, "digest")).mapInArrow(look, "hub bigint, band int, digest bigint").distinct()


def _links(tiles: DataFrame, arrays: DataFrame, of: int, out_of: int, every: bool) -> DataFrame:
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _per_tile(batches):
            found = _linked(tile, of, out_of, every) if tile.num_rows > 1 else []
            if found:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b", "shared"])

    return _dealt(tiles.join(arrays.select("digest", "shingles"), "digest")).mapInArrow(link, "a bigint, b bigint, shared bigint")


def join(docs: DataFrame, words: int = 5, of: int = 4, out_of: int = 5, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """Link texts whose distinct ``words``-word shingles reach a Jaccard similarity of ``of / out_of``.

    ``docs`` needs doc_id and text; other columns, whatever their names, are not
    read. Returns two frames:

    * one row per document: doc_id, text_hash, size (shingles of its set), class_id (equal
      for equal sets), group_id (equal for sets that links lead to), component_id (least
      doc_id of its group).
    * links between classes: a, b, shared, with class ids a and b. With ``every`` all
      links, else enough of them to join every component.

    Null and empty texts, and texts of white space only, have size 0, no class and
    their own doc_id as component. Texts with fewer words than a shingle are one
    shingle. Rows that repeat a doc_id are kept as they are; each takes part with
    its own text. A row without doc_id takes part too; a component without any
    doc_id has none. Empty tables give empty frames.
    """
    scratch = Scratch(docs, "ngram-join")
    sets = scratch.keep(_sets(docs, words, of, out_of))
    keyed = sets.filter("size > 0").select("digest", "size", F.explode("keys").alias("shingle")).select(
        "digest", F.explode(_bands(of, out_of)).alias("band"), "shingle")
    keyed = keyed.select("digest", "band", F.xxhash64("shingle", "band").alias("key"))
    shared = (
        keyed.groupBy("key").agg(F.min("digest").alias("hub"), F.max("digest").alias("last"))
        .filter("hub <> last").select("key", "hub")
    )
    members = scratch.keep(keyed.join(shared, "key").select("hub", "band", "digest").distinct())
    maps = sets.filter("bits is not null").select("digest", "size", "bits")
    tiles = _tiles(members, maps.select("digest", "size").distinct())
    hopeful = scratch.keep(_hopefuls(tiles, maps.select("digest", "bits"), of, out_of))
    scratch.drop(members)
    members = hopeful
    firsts = (
        sets.select("doc_id", "digest").join(members.select("digest").distinct(), "digest", "left_semi")
        .groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    )
    firsts = scratch.keep(firsts)
    wanted = broadcast_if_small(firsts)
    rows = docs.select("doc_id", "text")
    texts = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi")
    arrays = scratch.keep(_arrays(texts, words).filter("size > 0"))
    tiles = _tiles(members, arrays.select("digest", "size").distinct())
    links = scratch.keep(_links(tiles, arrays, of, out_of, every).dropDuplicates(["a", "b"]))
    scratch.drop(members, firsts, arrays)
    roots = connected(links.select("a", "b"))
    classed = (
        sets.filter("size > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
        .join(roots.withColumnRenamed("node", "digest"), "digest", "left")
        .select("digest", "doc_id", F.coalesce("root", "digest").alias("root"))
    )
    classed = scratch.keep(classed)
    least = classed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = classed.join(least, "root").select(F.col("digest").alias("class_id"), F.col("root").alias("group_id"), "component_id")
    rows = sets.select("doc_id", "text_hash", "size", F.when(F.col("size") > 0, F.col("digest")).alias("class_id"))
    result = scratch.keep(
        rows.join(named, "class_id", "left")
        .withColumn("component_id", F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
        .select("doc_id", "text_hash", "size", "class_id", "group_id", "component_id")
    )
    scratch.drop(sets, classed)
    return result, links


def one_of_each(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``docs`` without all but one document of each group in ``classes``, as ``join`` returns them; all columns kept.

    The least doc_id stays, of several of its texts the one with the least hash, of equal
    rows any. Documents without words are in no group and stay.
    """
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
    groups = classes.filter("size > 0").groupBy("group_id").agg(F.min(rank).alias("best"), F.count("*").alias("n")).filter("n > 1")
    ranked = classes.join(broadcast_if_small(stage(groups, "groups")), "group_id")
    others = ranked.filter(rank != F.col("best")).select(F.col("doc_id").alias("_other_id"), F.col("text_hash").alias("_other_hash")).distinct()
    others = broadcast_if_small(stage(others, "others"))
    rows = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    same = F.col("_id").eqNullSafe(F.col("_other_id")) & (F.col("_hash") == F.col("_other_hash"))
    kept = rows.join(others, same, "left_anti")
    again = classes.filter("size > 0").groupBy(F.col("doc_id").alias("_again_id"), F.col("text_hash").alias("_again_hash")).count()
    again = stage(again.filter("count > 1").select("_again_id", "_again_hash"), "again")
    if not again.isEmpty():  # equal rows with words, which no key tells apart
        again = broadcast_if_small(again)
        same = F.col("_id").eqNullSafe(F.col("_again_id")) & (F.col("_hash") == F.col("_again_hash"))
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["_id", "_hash"]))
    return kept.select("_doc.*")
