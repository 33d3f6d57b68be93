"""Sinks: Markdown files, asset files, checkpoint and report documents under a folder that all executors share."""

from __future__ import annotations

import errno
import json
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.plans.shipping import map_arrow

#: Kinds of failure of a written file.
NO_SPACE, DENIED, IO, TOO_LARGE, FETCH = "no_space", "permission", "io", "too_large", "fetch"
WRITTEN = "path string, bytes long, state string, message string"


def write_file(path: str, data: bytes) -> None:
    """Writes a file as a whole: under another name first, then renamed."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    other = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with open(other, "wb") as f:
            f.write(data)
        os.replace(other, path)
    except BaseException:
        if os.path.exists(other):
            os.remove(other)
        raise


def _kind(e: OSError) -> str:
    return {errno.ENOSPC: NO_SPACE, errno.EACCES: DENIED, errno.EPERM: DENIED}.get(e.errno, IO)


def inside(root: str, path: str) -> str:
    """The file's full name; a path that leaves the folder is an error."""
    whole = os.path.normpath(os.path.join(root, path))
    if os.path.commonpath([os.path.abspath(root), os.path.abspath(whole)]) != os.path.abspath(root):
        raise PermissionError(errno.EACCES, "path leaves the folder", path)
    return whole


def last_of_path(documents: DataFrame, order: str) -> DataFrame:
    """Of the rows of ``documents(path, ...)`` with one path the one with the greatest ``order``, as if each had been written over the one before."""
    best = F.struct(order, *(c for c in documents.columns if c not in (order, "path")))
    return documents.where("path IS NOT NULL").groupBy("path").agg(F.max(best).alias("_x")).select(*(F.col("path") if c == "path" else F.col("_x")[c].alias(c) for c in documents.columns))


def _report(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["path", "bytes", "state", "message"])


def save_texts(documents: DataFrame, root: str, order: str = "result_id", dry: bool = False) -> DataFrame:
    """Writes ``documents(path, text, ...)`` as UTF-8 files, each in its task; (path, bytes, state, message) of each, state "written", "planned" (``dry``) or a kind of failure.

    Nothing is written before the rows are asked for; writing again gives the
    same files, so a lost task does no harm. Rows without text give no file.
    A full disk ends the task's writing: its other files have state "no_space".
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = False
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = text.encode("utf-8", "replace")
                state, message = "planned" if dry else "written", None
                if full:
                    state = NO_SPACE
                elif not dry:
                    try:
                        write_file(inside(root, path), data)
                    except OSError as e:
                        state, message = _kind(e), str(e)
                        full = state == NO_SPACE
                rows.append((path, len(data), state, message))
            yield _report(rows)

    chosen = last_of_path(documents.where("text IS NOT NULL").select("path", order, "text"), order).select("path", "text")
    return map_arrow(chosen, write, WRITTEN)


def pending_assets(wanted: DataFrame, saved: DataFrame) -> DataFrame:
    """Rows (asset_url, path) of ``wanted`` that ``saved(asset_url)`` does not have; each address once."""
    return wanted.where("asset_url IS NOT NULL").dropDuplicates(["asset_url"]).join(saved.select("asset_url").distinct(), "asset_url", "left_anti")


def save_assets(assets: DataFrame, root: str, fetch: Callable[[str], bytes], limit_mb: float | None = 50.0) -> DataFrame:
    """Writes ``assets(asset_url, path)`` with what ``fetch`` gives for each address; (path, bytes, state, message), state also "present" for files that were there.

    One asset's failure ends no other's. Of several addresses with one path the least is written.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size, state, message = 0, "written", None
                try:
                    whole = inside(root, path)
                    if os.path.exists(whole):
                        size, state = os.path.getsize(whole), "present"
                    else:
                        data = fetch(url)
                        size = len(data)
                        if limit_mb is not None and size / 1048576 > limit_mb:
                            state = TOO_LARGE
                        else:
                            write_file(whole, data)
                except OSError as e:
                    state, message = (_kind(e) if e.errno in (errno.ENOSPC, errno.EACCES, errno.EPERM) else FETCH), str(e)
                except Exception as e:  # noqa: BLE001 - whatever a fetch raises
                    state, message = FETCH, f"{type(e).__name__}: {e}"
                rows.append((path, size, state, message))
            yield _report(rows)

    own = assets.where("path IS NOT NULL AND asset_url IS NOT NULL").groupBy("path").agg(F.min("asset_url").alias("asset_url")).select("asset_url", "path")
    return map_arrow(own, write, WRITTEN)


def write_table(rows: DataFrame, at: str, records_per_file: int = 0) -> None:
    """Writes rows as Parquet with at most so many records in a file (0: no limit); the folder is replaced as a whole."""
    rows.write.mode("overwrite").option("maxRecordsPerFile", records_per_file).parquet(at)


def writer_summary(written: DataFrame) -> DataFrame:
    """One row (files, bytes, failures, mean_bytes) over the reports of all writers; no file gives a NULL mean."""
    done = F.col("state") == "written"
    return written.agg(F.count_if(done).alias("files"), F.coalesce(F.sum(F.when(done, F.col("bytes"))), F.lit(0)).alias("bytes"), F.count_if(~F.col("state").isin("written", "present", "planned")).alias("failures"), F.avg(F.when(done, F.col("bytes"))).alias("mean_bytes"))


def save_document(row: dict, path: str) -> None:
    """Writes a small document (a report, a checkpoint's head) as one JSON file."""
    write_file(path, json.dumps(row, indent=2, sort_keys=True, default=str).encode())
