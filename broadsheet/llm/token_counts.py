"""Token counts of documents in flat token files, found by a scan for separators.

A flat file is nothing but token ids, with an end-of-document id behind each document
and no index. It is read in blocks. In each block the separators are found at once;
where documents run across blocks, the boundaries are stitched by a prefix scan over
the blocks' totals, first inside groups of blocks, then over the groups.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16  # tokens of a block
GROUP = 1024  # blocks of a group
# The pattern by which the vocabulary's own tokenizer splits text before merging (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(vocabulary: bytes):
    """Byte-level BPE of a rank file: lines of a base64 token and its id."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def flat_files(docs: DataFrame, vocabulary_path: str, separator: int, block: int = BLOCK) -> DataFrame:
    """Write every task's documents as one flat file: file, block, data (uint16, little endian), and rows that name the documents.

    Rows with ``data`` are the blocks, of ``block`` tokens each but the last; rows without are
    (file, doc_id, ordinal): the documents in the order of the file. A null text is an
    empty document. The vocabulary is read once and sent to the tasks.
    """
    with open(vocabulary_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = dict(docs.dtypes)["doc_id"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, encode = TaskContext.get().partitionId(), encoder(shared.value)
        end = np.array([separator], np.uint16)
        held, size, blocks, ordinal, id_type = [], 0, 0, 0, None

        def row(data: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch(
                [pa.array([number], pa.int32()), pa.array([blocks], pa.int64()), pa.array([data.astype("<u2").tobytes()], pa.binary()),
                 pa.nulls(1, id_type), pa.nulls(1, pa.int64())], names=["file", "block", "data", "doc_id", "ordinal"])

        for batch in batches:
            id_type = batch.column("doc_id").type
            n = batch.num_rows
            yield pa.record_batch(
                [pa.array(np.full(n, number, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), batch.column("doc_id"),
                 pa.array(np.arange(ordinal, ordinal + n))], names=["file", "block", "data", "doc_id", "ordinal"])
            ordinal += n
            for text in batch.column("text"):
                ids = encode.encode_to_numpy(text.as_py() or "", disallowed_special=()).astype(np.uint16)
                held += [ids, end]
                size += len(ids) + 1
                if size >= block:
                    all_ = np.concatenate(held)
                    while len(all_) >= block:
                        yield row(all_[:block])
                        blocks, all_ = blocks + 1, all_[block:]
                    held, size = [all_], len(all_)
        if size:
            yield row(np.concatenate(held))

    schema = f"file int, block bigint, data binary, doc_id {kind}, ordinal bigint"
    return docs.select("doc_id", "text").mapInArrow(write, schema)


def read_flat(spark, path: str, width: int = 2, block: int = BLOCK) -> DataFrame:
    """Blocks of flat files that lie in a folder: file (path), block, data. A file is loaded whole, so it may have 2 GB at most."""
    files = spark.read.format("binaryFile").load(path)
    step = block * width
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("length") / step) - 1, F.lit(0)))
    cut = files.filter("length > 0").select(F.col("path").alias("file"), "content", F.explode(starts).alias("block"))
    return cut.select("file", "block", F.substring("content", (F.col("block") * step + 1).cast("int"), F.lit(step)).alias("data"))


def _marks(blocks: DataFrame, separator: int, dtype: str) -> DataFrame:
    """For each block its number of tokens and the places of its separators."""
    kind = dict(blocks.dtypes)["file"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(x.as_py(), dtype) for x in batch.column("data")]
            places = [np.flatnonzero(t == separator) for t in tokens]
            yield pa.record_batch(
                [batch.column("file"), batch.column("block"), pa.array([len(t) for t in tokens], pa.int64()), pa.array(places, pa.list_(pa.int64()))],
                names=["file", "block", "n", "places"])

    return blocks.select("file", "block", "data").mapInArrow(find, f"file {kind}, block bigint, n bigint, places array<bigint>")


def counts(blocks: DataFrame, separator: int, dtype: str = "<u2") -> DataFrame:
    """file, ordinal, tokens: the length of every document of every file, separators not counted.

    ``blocks``: file, block (numbered from 0 in the file's order), data (ids of ``dtype``).
    Two separators in a row enclose an empty document. Tokens behind the last
    separator are a last document; a file that ends with a separator has none there.
    Blocks may be of any length, empty ones too. Empty tables give an empty result.
    """
    group = F.call_function("div", F.col("block"), F.lit(GROUP).cast("bigint"))
    marked = _marks(blocks, separator, dtype).withColumn("part", group)
    before = Window.partitionBy("file", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    local = marked.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn(
        "documents", F.coalesce(F.sum(F.size("places")).over(before), F.lit(0)))
    local = local.withColumn("end", F.col("offset") + F.element_at(F.when(F.size("places") > 0, F.col("places")), -1) + 1)
    local = local.withColumn("last", F.max("end").over(before))
    groups = local.groupBy("file", "part").agg(
        F.sum("n").alias("n"), F.sum(F.size("places")).alias("found"), F.max("end").alias("end"))
    earlier = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn(
        "so_far", F.coalesce(F.sum("found").over(earlier), F.lit(0)))
    placed = placed.withColumn("reached", F.coalesce(F.max(F.col("base") + F.col("end")).over(earlier), F.lit(0)))
    stitched = local.join(placed.select("file", "part", "base", "so_far", "reached"), ["file", "part"])
    start = F.coalesce(F.col("base") + F.col("last"), F.col("reached"))  # behind the last separator before the block
    ends = F.transform("places", lambda p: p + F.col("base") + F.col("offset"))
    starts = F.concat(F.array(start), F.transform("places", lambda p: p + F.col("base") + F.col("offset") + 1))
    lengths = F.transform(ends, lambda e, i: e - F.get(starts, i))
    closed = stitched.filter(F.size("places") > 0).select(
        "file", (F.col("so_far") + F.col("documents")).alias("first"), F.posexplode(lengths).alias("i", "tokens"),
    ).select("file", (F.col("first") + F.col("i")).alias("ordinal"), "tokens")
    whole = placed.groupBy("file").agg(
        F.sum("n").alias("n"), F.sum("found").alias("ordinal"), F.max(F.coalesce(F.col("base") + F.col("end"), F.lit(0))).alias("end"))
    rest = whole.filter("n > end").select("file", "ordinal", (F.col("n") - F.col("end")).alias("tokens"))
    return closed.unionByName(rest)
