"""Which documents are held out from learning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out() -> Column:
    """Every fourth document by the checksum of its id; documents without id are learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
