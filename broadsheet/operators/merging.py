"""Insert-if-absent, replace-by-key and first-wins selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_yet_in(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``existing``; NULL keys compare as equal."""
    known = existing.select(*[F.col(k).alias(f"_known_{k}") for k in keys])
    same = F.lit(True)
    for key in keys:
        same = same & new[key].eqNullSafe(known[f"_known_{key}"])
    return new.join(known, same, "left_anti")


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the lowest ``order`` for each key.

    A minimum over a struct is combined on the map side, so a key that holds a
    large share of the rows sends one row per task. NULL forms one group.
    """
    others = [c for c in df.columns if c not in (key, order)]
    best = df.groupBy(key).agg(F.min(F.struct(order, *others)).alias("_best"))
    return best.select(key, "_best.*").select(*df.columns)


def add_names(existing: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Distinct values of ``key`` in ``names`` that ``existing`` lacks."""
    return names.select(key).distinct().join(existing.select(key), key, "left_anti")


def replace_by_key(existing: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` without the updated keys, plus ``updates``."""
    return existing.join(updates.select(*keys).distinct(), keys, "left_anti").unionByName(updates)


def upsert_values(existing: DataFrame, updates: DataFrame, key: str, id_column: str, values: list[str]) -> DataFrame:
    """Rows of ``existing`` with ``values`` taken from ``updates`` where the key is there; ids stay as they are.

    ``updates`` holds one row per key. New keys are not part of the result; they
    still need an id (see ``numbering.number_rows``).
    """
    fresh = updates.select(key, F.lit(True).alias("_hit"), *[F.col(v).alias(f"_new_{v}") for v in values])
    merged = existing.join(fresh, key, "left")
    for value in values:
        merged = merged.withColumn(value, F.when(F.col("_hit"), F.col(f"_new_{value}")).otherwise(F.col(value)))
    return merged.select(*existing.columns)
