"""Title search: trigrams of the lower-cased titles choose candidates, the pattern itself decides."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 3
# Letters that have several lower-case forms, or whose form depends on their place.
_UNSURE = "İΣσςı"


def grams(titles: DataFrame) -> DataFrame:
    """gram, article_id: every three letters in a row of a title, once each. ``titles``: article_id, title; null and short titles have none."""
    low = F.lower("title")
    starts = F.sequence(F.lit(1), F.length(low) - (GRAM - 1))
    cut = F.when(F.length(low) >= GRAM, F.array_distinct(F.transform(starts, lambda i: F.substr(low, i, F.lit(GRAM)))))
    return titles.select(F.explode(cut).alias("gram"), "article_id")


def wanted(pattern: str) -> list[str]:
    """Trigrams that a title must have to match ``pattern`` ("%", "_", "\\\\" before either): those of its pieces without wildcards.

    A pattern without three known letters in a row asks for none. The number is bounded by the pattern's length.
    """
    pieces = [""]
    for part in re.findall(r"\\.|.", pattern, re.DOTALL):
        if part in ("%", "_"):
            pieces.append("")
        else:
            pieces[-1] += part[1:] if len(part) == 2 else part
    found = {p[i : i + GRAM] for p in pieces for i in range(len(p) - GRAM + 1)}
    sure = (g for g in found if not set(g) & set(_UNSURE) and all(len(c.lower()) == 1 for c in g))
    return sorted({g.lower() for g in sure})


def candidates(index: DataFrame, pattern: str) -> DataFrame | None:
    """article_id of the titles with all trigrams of ``pattern``; None if it asks for none, so that all titles are candidates.

    The index is sorted by gram, so only row groups that can hold one of the pattern's are read.
    """
    asked = wanted(pattern)
    if not asked:
        return None
    held = index.filter(F.col("gram").isin(asked)).select("gram", "article_id").distinct()
    return held.groupBy("article_id").count().filter(F.col("count") == len(asked)).select("article_id")
