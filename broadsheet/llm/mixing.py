"""Mixing sources to target weights by a curriculum: what each document gives, and when in training.

Each source's weight varies over the course of training, from 0 to 1. Its schedule
is integrated, and a take that starts at some share of the source's demand is put
where the integral reaches that share. Sorting by that position gives the order of
training. Column functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.session import stage

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096  # shares in which the running sums of a source are taken

# Weight over time as (time, factor) points, joined by straight lines; one for each weight of the cycle.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.25)))


def position(share: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """The time at which the integral of the schedule reaches ``share`` of its whole."""
    whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:]))
    result, reached = F.lit(schedule[-1][0]), whole
    for (t0, w0), (t1, w1) in reversed(list(zip(schedule, schedule[1:]))):
        area = (t1 - t0) * (w0 + w1) / 2
        reached -= area
        rest = F.greatest(share * whole - reached, F.lit(0.0))
        bend = (w1 - w0) / (2 * (t1 - t0))
        here = F.least(t0 + 2 * rest / (w0 + F.sqrt(F.greatest(w0 * w0 + 4 * bend * rest, F.lit(0.0)))), F.lit(t1)) if w0 or w1 else F.lit(t0)
        if not w0 and w1:
            here = F.least(t0 + F.sqrt(rest) * sqrt(1 / bend), F.lit(t1))
        result = F.when(share * whole < reached + area, here).otherwise(result)
    return result


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: int) -> DataFrame:
    """``sizes``: source, source_size -> target, cycle (number of its weight). One row per source.

    Sources in the order of their code points, null last, weigh ``weights`` in turn.
    The demand is ``share`` of all sizes; a target that would exceed ``most`` times its
    source stops there, and the rest is shared anew by weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    ranked = sizes.withColumn("cycle", (F.row_number().over(order) - 1) % len(weights))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("cycle") + 1)
    capped = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    demand = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (demand - before) / F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing))
    levels = capped.withColumn("level", level)
    # The first source in this order that its level does not fill; levels fall from there on.
    reached = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(everything)
    return levels.withColumn("reached", reached).select(
        "source", "source_size", "cycle",
        F.coalesce(F.least(F.col("cap").cast("double"), F.col("reached") * F.col("weight")), F.lit(0.0)).alias("target"),
    )


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: int = 3,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, buckets: int = BUCKETS, carry: Sequence[str] | None = None,
) -> DataFrame:
    """What the mix takes of each document: doc (its columns, or those named in ``carry``, with doc_id among them), size, source_size, target, taken, takes.

    ``docs`` needs doc_id, text and source; its columns travel in the struct ``doc``, so
    their names may clash with the others. Where ``carry`` leaves out the text, it is read once
    to be counted and goes no further. Size is the text's number of words, 0 for
    null, empty and blank texts. A source's documents stand in a fixed random order (by
    the digest of doc_id) and are read through, again and again, until its target (in
    whole words) is reached; the last document is cut there. ``takes`` holds one (copy,
    words, position) for each time a document is read, with the position in training
    where that reading starts; it is empty for documents that are not reached or have no
    words. No document is read more than ``most`` times, so taken is at most that many
    times its size. Rows that repeat a doc_id are separate documents. A null source is
    a source of its own; null doc_ids come first in the order. An empty table gives an
    empty one.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    part = ["source_key", "unnamed", "bucket"]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("doc"),
        F.coalesce("source", F.lit("")).alias("source_key"), F.col("source").isNull().alias("unnamed"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), key.alias("key"),
    ).withColumn("bucket", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint") * buckets, 32).cast("int"))
    if carry is not None and "text" not in carry:
        rows = stage(rows, "mixing-sizes")
    sums = rows.groupBy(*part).agg(F.sum("size").alias("bucket_size"))
    sized = sums.groupBy("source_key", "unnamed").agg(F.sum("bucket_size").alias("source_size"))
    source = F.when(~F.col("unnamed"), F.col("source_key"))
    sources = targets(sized.select(source.alias("source"), "source_size"), weights, share, most).select(
        F.coalesce("source", F.lit("")).alias("source_key"), F.col("source").isNull().alias("unnamed"), "source_size", "target", "cycle")
    up_to = Window.partitionBy("source_key", "unnamed").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*part, F.coalesce(F.sum("bucket_size").over(up_to), F.lit(0)).alias("start"))
    named = starts.join(sources, ["source_key", "unnamed"])
    inside = Window.partitionBy(*part).orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    found = (
        rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(named, part)
        .withColumn("before", F.col("start") + F.col("inside"))
        .withColumn("demand", F.floor("target"))
    )
    offset = F.col("before")

    def words(copy: Column) -> Column:
        return F.greatest(F.least(F.col("demand") - copy * F.col("source_size") - offset, F.col("size")), F.lit(0).cast("bigint"))

    def when(copy: Column) -> Column:
        part = (copy * F.col("source_size") + offset) / F.col("demand")
        places = [F.when(F.col("cycle") == i, position(part, s)) for i, s in enumerate(schedules)]
        return F.coalesce(*places)

    copies = F.array(*[F.lit(i).cast("bigint") for i in range(most)])
    takes = F.filter(
        F.transform(copies, lambda c: F.struct(c.cast("int").alias("copy"), words(c).alias("words"), F.when(words(c) > 0, when(c)).alias("position"))),
        lambda t: t["words"] > 0,
    )
    return found.withColumn("takes", takes).select(
        "doc", "size", "source_size", "target",
        F.aggregate("takes", F.lit(0).cast("bigint"), lambda a, t: a + t["words"]).alias("taken"), "takes",
    )


def in_order(mixed: DataFrame) -> DataFrame:
    """The documents of a mix, range-sorted by the position where they are first read, unread ones last."""
    order = [F.get(F.col("takes")["position"], F.lit(0)).asc_nulls_last(), F.xxhash64("doc.doc_id")]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order)


def training_rows(mixed: DataFrame) -> DataFrame:
    """One row for each reading of a document, range-sorted into the order of training: doc, size, copy, words, position."""
    order = ["position", "copy", F.xxhash64("doc.doc_id")]
    return mixed.select("doc", "size", F.explode("takes").alias("take")).select("doc", "size", "take.*").repartitionByRange(*order).sortWithinPartitions(*order)
