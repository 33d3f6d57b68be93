"""Global numbers of rows in an order, without sorting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.plans.lineage import cut


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with a column number from 0 in the given order: parts are ordered by range and numbered by their offsets."""
    ordered = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")))
    sizes = ordered.groupBy("_p").agg(F.count("*").alias("n"), F.min("_m").alias("_first"))
    # One row for each part, so this window is small.
    offsets = sizes.select("_p", "_first", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("_offset"))
    return ordered.join(F.broadcast(offsets), "_p").withColumn("number", F.col("_offset") + F.col("_m") - F.col("_first")).drop("_p", "_m", "_first", "_offset")
