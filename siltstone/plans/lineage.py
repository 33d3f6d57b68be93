"""Cutting lineage in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which is made the session's checkpoint folder.

    Where none is set, a local session (as in tests) gets a folder of its own. On a
    cluster that is an error: a folder of one machine is none of the others'.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    set_already = context._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return shared or set_already.get()
    if not shared:
        if not (context.master.startswith("local[") or context.master == "local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="siltstone-checkpoint-")
    context.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, kept in the checkpoint folder: later steps neither recompute them nor lose them with an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, as a compressed columnar table in the same folder: for rows that are wide or of which later steps read few columns."""
    spark = df.sparkSession
    at = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


@contextmanager
def fixed_partitioning(spark: SparkSession) -> Iterator[None]:
    """Within it, what is cut keeps its partitioning: an adaptive plan would hide it, and every later join would shuffle the rows again."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
