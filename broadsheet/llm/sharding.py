"""Sharding along a Hilbert curve over document metadata, cut into runs of equal row counts.

Source, language and size are quantised to cells of about equally many rows each, the
first two by the order of their whole values, the cells of a row are turned into its index on the curve, and
the sorted rows are cut into runs. A run then covers a compact region of all
dimensions, so the minima and maxima of its files rule it out for filters on any
of them. Column functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.operators.numbering import number_rows
from broadsheet.session import broadcast_if_small, stage

BITS = 5  # bits of each dimension's cell number
OWN = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def hilbert_index(cells: Column, dims: int, bits: int = BITS) -> Column:
    """Place on the Hilbert curve of a point given as an array of ``dims`` cell numbers of ``bits`` bits.

    The public transposition algorithm for any number of dimensions, as folds
    over the bits and the dimensions.
    """
    masks = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)])
    axes = F.array(*[F.lit(i) for i in range(dims)])

    def turned(point: Column, mask: Column, i: Column) -> Column:
        low = mask - 1
        inverted = F.get(point, i).bitwiseAND(mask) != 0
        swap = F.get(point, F.lit(0)).bitwiseXOR(F.get(point, i)).bitwiseAND(low)
        return F.transform(
            point,
            lambda x, k: F.when(inverted, F.when(k == 0, x.bitwiseXOR(low)).otherwise(x))
            .otherwise(F.when((k == 0) | (k == i), x.bitwiseXOR(swap)).otherwise(x)),
        )

    point = F.aggregate(masks, cells, lambda p, mask: F.aggregate(axes, p, lambda q, i: turned(q, mask, i)))
    # Gray code: each axis takes up the ones before it.
    grayed = F.transform(
        F.array(point), lambda p: F.transform(axes, lambda i: F.aggregate(F.slice(p, F.lit(1), i + 1), F.lit(0), lambda a, x: a.bitwiseXOR(x)))
    )[0]

    def finished(p: Column) -> Column:
        last = F.get(p, F.lit(dims - 1))
        flip = F.aggregate(masks, F.lit(0), lambda t, mask: F.when(last.bitwiseAND(mask) != 0, t.bitwiseXOR(mask - 1)).otherwise(t))
        return F.transform(F.array(flip), lambda t: F.transform(p, lambda x: x.bitwiseXOR(t)))[0]

    transposed = F.transform(F.array(grayed), finished)[0]

    def woven(p: Column) -> Column:
        each = [
            F.shiftleft(F.shiftright(F.get(p, F.lit(i)), b).bitwiseAND(1).cast("bigint"), b * dims + dims - 1 - i)
            for b in range(bits) for i in range(dims)
        ]
        return reduce(lambda a, b: a.bitwiseOR(b), each)

    return F.transform(F.array(transposed), woven)[0]


def _value_cells(docs: DataFrame, column: str, bits: int) -> DataFrame:
    """``column``_value and ``column``_cell: how many of its quantiles each distinct value reaches, in the order of the whole text; null is the least.

    The values are range-partitioned; each partition's offset is the row count of the ones before it.
    """
    parts, value = 1 << bits, f"{column}_value"
    counted = docs.groupBy(F.col(column).cast("string").alias(value)).agg(F.count("*").alias("n"))
    placed = stage(counted.repartitionByRange(value).withColumn("_part", F.spark_partition_id()), f"values-{column}")
    sums = placed.groupBy("_part").agg(F.sum("n").alias("rows"))
    total = F.lit(sums.agg(F.sum("rows").alias("total")).first()["total"] or 1).cast("bigint")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_offset"))
    reached = F.col("_offset") + F.sum("n").over(Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    cell = F.least(F.call_function("div", reached * parts, total), F.lit(parts - 1).cast("bigint")).cast("int")
    return stage(placed.join(F.broadcast(offsets), "_part").select(value, cell.alias(f"{column}_cell")), f"cells-{column}")


def _cells(rows: DataFrame, dims: list[str], bits: int) -> list[Column]:
    """Cell number of each dimension: how many of its quantiles a value reaches."""
    parts = 1 << bits
    wanted = [i / parts for i in range(1, parts)]
    found = rows.agg(*[F.percentile_approx(d, wanted, 10_000).alias(d) for d in dims]).first()  # parts - 1 numbers each
    cells = []
    for d in dims:
        bounds = F.array(*[F.lit(b).cast("bigint") for b in found[d] or []])
        cells.append(F.size(F.filter(bounds, lambda b, v=F.col(d): b <= v)))
    return cells


def shard(docs: DataFrame, shards: int = 16, bits: int = BITS, carry: list[str] | None = None) -> DataFrame:
    """Deal documents to ``shards`` runs along the curve: the columns of ``docs`` (or those named in ``carry``) plus size, text_crc32, law, shard, slot, grown_shard.

    ``docs`` needs doc_id, text, lang and source. Where ``carry`` leaves out the text, it is
    read once to be measured and goes no further. The law is ``rows``: row counts of
    the shards are at most one apart; slot counts from 0 within a shard along the
    curve; grown_shard is null, since another shard count cuts anew. Size is the
    text's UTF-8 bytes plus 1 (1 for null), text_crc32 null for a null text.

    Equal texts follow each other on the curve, wherever they come from: all of them
    are placed by the least source and language among them, so a group is cut only
    where a shard ends. Null and empty texts are such groups too. Rows that are equal
    in all columns are separate rows. Null sources and languages come first. Columns
    of ``docs`` named like the added ones are replaced; other columns are kept. An
    empty table gives an empty one.
    """
    kept = [c for c in (docs.columns if carry is None else carry) if c not in OWN]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), F.col("doc_id").alias("order_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("text_hash"),
        F.col("source").cast("string").alias("source_of"), F.col("lang").cast("string").alias("lang_of"),
    )
    if "text" not in kept:
        rows = stage(rows, "sharding-sizes")
    for column in ("source", "lang"):
        values = broadcast_if_small(_value_cells(docs, column, bits))
        rows = rows.join(values, F.col(f"{column}_of").eqNullSafe(F.col(f"{column}_value"))).drop(f"{column}_of", f"{column}_value")
    copies = (
        rows.groupBy("text_hash", "size", F.coalesce("text_crc32", F.lit(-1)).alias("crc"))
        .agg(F.count("*").alias("n"), F.min("source_cell").alias("s"), F.min("lang_cell").alias("l"))
        .filter("n > 1")
        .select(F.col("text_hash").alias("h"), F.col("size").alias("z"), F.col("crc").alias("c"), "s", "l")
    )
    cells = [F.col("source_cell"), F.col("lang_cell"), *_cells(rows.select("size"), ["size"], bits)]
    together = broadcast_if_small(copies)
    placed = rows.join(
        together,
        (F.col("text_hash") == F.col("h")) & (F.col("size") == F.col("z")) & (F.coalesce("text_crc32", F.lit(-1)) == F.col("c")), "left",
    ).select(
        "doc", "order_id", "size", "text_crc32", "text_hash",
        F.coalesce("s", "source_cell").alias("source_cell"), F.coalesce("l", "lang_cell").alias("lang_cell"),
    )
    curved = placed.select(
        "doc", "order_id", "size", "text_crc32", "text_hash", hilbert_index(F.array(*cells), len(cells), bits).alias("curve"),
    )
    ranked = number_rows(curved, ["curve", "text_hash", "size", "order_id"], "place", after=-1)
    total = F.lit(ranked.count()).cast("bigint")
    cut = ranked.withColumn("shard", F.call_function("div", F.col("place") * shards, total).cast("int"))
    return cut.select(
        *[F.col("doc").getField(c).alias(c) for c in kept],
        "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("place") - F.call_function("div", F.col("shard").cast("bigint") * total + (shards - 1), F.lit(shards).cast("bigint"))).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write(sharded: DataFrame, path: str) -> None:
    """Store each shard as its own folder of files, each file a run of the curve."""
    sharded.write.partitionBy("shard").parquet(path)
