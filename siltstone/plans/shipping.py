"""The package on executors: where it is not installed there, its files go with the session."""

from __future__ import annotations

import os
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session as one archive, once; operators that run Python call it themselves.

    The archive is made in the driver's own folder for the session; Spark serves it to the executors.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(root):  # an archive, if the package itself is in one, is shipped already
        at = os.path.join(context._temp_dir, "siltstone.zip")
        with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, names in os.walk(root):
                for name in sorted(names):
                    if name.endswith(".py"):
                        whole = os.path.join(folder, name)
                        out.write(whole, os.path.join("siltstone", os.path.relpath(whole, root)))
        context.addPyFile(at)
    _SHIPPED.add(context.applicationId)


def map_arrow(rows, function, schema):
    """``rows.mapInArrow`` with the package at hand on the executors."""
    ship(rows.sparkSession)
    return rows.mapInArrow(function, schema)


def group_arrow(groups, function, schema):
    """``groups.applyInArrow`` likewise."""
    ship(groups._df.sparkSession)
    return groups.applyInArrow(function, schema)
