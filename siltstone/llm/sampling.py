"""Bounded samples for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that pass the first choice by hash, against those wanted.
SPARE = 1.3


def smallest_hashes(rows: DataFrame, having: str, key: str, wanted: int, *columns: str) -> DataFrame:
    """At most ``wanted`` of the rows with ``having``: those with the smallest hash of ``key``, the same at each run.

    The share to look at follows from the number of all rows (known without reading them), so the task that
    makes the choice gets about ``SPARE * wanted`` rows, however large the table.
    """
    count = rows.count()
    mark = F.xxhash64(key)
    if count > SPARE * wanted:
        rows = rows.where(F.pmod(mark, F.lit(1 << 40)) < int((1 << 40) * SPARE * wanted / count))
    return rows.where(having).select(F.pmod(mark, F.lit(1 << 40)).alias("_order"), key, *columns).orderBy("_order", key).limit(wanted).select(*columns)
