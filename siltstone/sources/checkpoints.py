"""Checkpoint documents and tables: reading, versions, and writing as one version."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.plans.shipping import map_arrow

VERSION = 1
SCHEMA = (
    "version int, config_name string, config_hash string, created_at string, last_updated string, "
    "pages map<string, struct<url: string, content_hash: string, last_scraped: string, status_code: int, file_path: string, etag: string, last_modified: string>>, "
    "queue array<array<string>>, stats map<string, bigint>"
)


def read_json(documents: DataFrame) -> DataFrame:
    """Parsed checkpoint documents of ``documents(name, json)``; broken ones, other versions and missing fields give no row."""
    parsed = documents.select("name", F.from_json("json", SCHEMA).alias("c"))
    return parsed.where(f"c.version = {VERSION} AND c.config_name IS NOT NULL AND c.config_hash IS NOT NULL AND c.created_at IS NOT NULL").select("name", "c.*")


def pages(checkpoints: DataFrame) -> DataFrame:
    rows = checkpoints.select("name", F.explode("pages").alias("key", "p"))
    return rows.select("name", F.col("key").alias("url"), "p.content_hash", F.try_to_timestamp("p.last_scraped").alias("last_scraped"), "p.status_code", "p.file_path", "p.etag", "p.last_modified")


def queue(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.select("name", F.posexplode("queue").alias("position", "q")).select("name", "position", F.get("q", 0).alias("url"), F.get("q", 1).alias("parent_url"))


def config_hash(config: dict) -> str:
    """SHA-256 of what decides which pages a crawl visits; the order of starts and domains does not matter."""
    own = {k: config.get(k) for k in ("name", "include", "exclude", "depth_limit", "link_selectors")}
    own |= {k: sorted(config.get(k) or ()) for k in ("start_urls", "allowed_domains")}
    return hashlib.sha256(json.dumps(own, sort_keys=True).encode()).hexdigest()


def save(folder: str, version: int, pages_: DataFrame, queue_: DataFrame, metadata: DataFrame) -> str:
    """Writes the three tables under one version; metadata is last, so a version without it was never finished."""
    at = f"{folder}/v{version:010d}"
    pages_.write.mode("overwrite").parquet(f"{at}/pages")
    queue_.write.mode("overwrite").parquet(f"{at}/queue")
    metadata.write.mode("overwrite").parquet(f"{at}/metadata")
    return at


def load(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.option("mergeSchema", "true").parquet(f"{at}/{x}") for x in ("pages", "queue", "metadata"))


def read_legacy(documents: DataFrame) -> DataFrame:
    """Documents of the time before entity tags: the same form, the marks missing and NULL; statistics may be missing too."""
    return read_json(documents).withColumn("stats", F.coalesce("stats", F.create_map().cast("map<string,bigint>")))


def metadata(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.select("name", "version", "config_name", "config_hash", F.try_to_timestamp("created_at").alias("created_at"), F.try_to_timestamp("last_updated").alias("last_updated"), "stats")


def to_json(pages_: DataFrame) -> DataFrame:
    """(url, json) of saved pages, one document a page: what :func:`pages` reads as an entry of the map."""
    fields = ("url", "content_hash", "last_scraped", "status_code", "file_path", "etag", "last_modified")
    return pages_.where("url IS NOT NULL").select("url", F.to_json(F.struct(*(F.col(c) for c in fields if c in pages_.columns))).alias("json"))


class TableBackend:
    """A checkpoint under a folder of versions: the newest finished one is read, and each save writes the next."""

    def __init__(self, spark: SparkSession, folder: str, config: dict):
        self.spark, self.folder, self.hash = spark, folder.rstrip("/"), config_hash(config)

    def _path(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """Numbers of the finished versions."""
        system, path = self._path()
        if not system.exists(path):
            return []
        names = [x.getPath().getName() for x in system.listStatus(path)]
        done = [n for n in names if n.startswith("v") and n[1:].isdigit() and system.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/metadata/_SUCCESS"))]
        return sorted(int(n[1:]) for n in done)

    def load(self) -> tuple[DataFrame, DataFrame] | None:
        """(pages, queue) of the newest version; None if there is none or it was written under another configuration."""
        found = self.versions()
        if not found:
            return None
        pages_, queue_, head = load(self.spark, f"{self.folder}/v{found[-1]:010d}")
        return (pages_, queue_) if head.where(F.col("config_hash") == self.hash).limit(1).count() else None

    def save(self, pages_: DataFrame, queue_: DataFrame, stats: dict[str, int] | None = None) -> str:
        found = self.versions()
        entries = [F.lit(k) if i == 0 else F.lit(v).cast("bigint") for k, v in (stats or {}).items() for i in (0, 1)]
        head = self.spark.range(1).select(F.lit(VERSION).alias("version"), F.lit(self.hash).alias("config_hash"), F.current_timestamp().alias("last_updated"), F.create_map(*entries).cast("map<string,bigint>").alias("stats"))
        return save(self.folder, (found[-1] if found else 0) + 1, pages_, queue_, head)

    def urls(self) -> DataFrame | None:
        found = self.load()
        return None if found is None else found[0].select("url").distinct()


def read_sqlite(spark: SparkSession, path: str, table: str, rows_per_part: int = 100_000) -> DataFrame:
    """A table (pages, queue or metadata) of a checkpoint in an SQLite file that every executor can open: each task reads its own range of rows."""
    import sqlite3

    if table not in ("pages", "queue", "metadata"):
        raise ValueError(f"unknown table: {table}")
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        names = [r[1] for r in db.execute(f"PRAGMA table_info({table})")]
        last = db.execute(f"SELECT coalesce(max(rowid), 0) FROM {table}").fetchone()[0]
    schema = ", ".join(f"{n} {'long' if n in ('status_code', 'position', 'version', 'id') else 'string'}" for n in names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as own:
                    rows = own.execute(f"SELECT {', '.join(names)} FROM {table} WHERE rowid > ? AND rowid <= ?", (part * rows_per_part, (part + 1) * rows_per_part)).fetchall()
                kinds = [pa.int64() if n in ("status_code", "position", "version", "id") else pa.string() for n in names]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    parts = max(1, -(-last // rows_per_part))
    return map_arrow(spark.range(0, parts, 1, min(parts, 1000)), read, schema)
