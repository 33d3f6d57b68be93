"""Sitemap entries: parsing, validation, ordering and loading into a frontier."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import urls
from siltstone.plans.order import numbered
from siltstone.plans.shipping import map_arrow

# Change frequencies of the sitemap protocol.
CHANGE_FREQUENCIES = ("always", "hourly", "daily", "weekly", "monthly", "yearly", "never")


def _values(xml: Column, name: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(xml, rf"(?is)<(?:\w+:)?{name}\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</(?:\w+:)?{name}\s*>", 1)), F.lit(""))


def parse(documents: DataFrame, element: str = "url") -> DataFrame:
    """Entries (source, pos, loc, lastmod, changefreq, priority) of ``documents(source, xml)``, leniently.

    Entries without loc are dropped; bad times, frequencies and priorities become NULL; malformed or NULL XML gives what can be read.
    With ``element`` "sitemap" the entries of an index.
    """
    found = documents.select("source", F.posexplode(F.regexp_extract_all("xml", F.lit(rf"(?is)<(?:\w+:)?{element}\b[^>]*>.*?</(?:\w+:)?{element}\s*>"), F.lit(0))).alias("pos", "x"))
    x = F.col("x")
    raw = found.select("source", "pos", _values(x, "loc").alias("loc"), _values(x, "lastmod").alias("lastmod"), F.lower(_values(x, "changefreq")).alias("changefreq"), _values(x, "priority").try_cast("double").alias("priority"))
    return raw.where("loc IS NOT NULL").select(
        "source",
        "pos",
        F.replace(F.col("loc"), F.lit("&amp;"), F.lit("&")).alias("loc"),
        F.try_to_timestamp("lastmod").alias("lastmod"),
        F.when(F.col("changefreq").isin(*CHANGE_FREQUENCIES), F.col("changefreq")).alias("changefreq"),
        F.when(F.col("priority").between(0, 1), F.col("priority")).alias("priority"),
    )


def valid(entries: DataFrame, *columns: str) -> DataFrame:
    """Entries with a location; frequency and priority NULL where they are not valid. ``columns`` are kept as they are."""
    return entries.where("loc IS NOT NULL AND trim(loc) <> ''").select(
        F.trim("loc").alias("loc"),
        "lastmod",
        F.when(F.lower("changefreq").isin(*CHANGE_FREQUENCIES), F.lower("changefreq")).alias("changefreq"),
        F.when(F.col("priority").between(0, 1), F.col("priority")).alias("priority"),
        *columns,
    )


def strict(entries: DataFrame) -> DataFrame:
    """``entries`` as read by :func:`parse` from all of a table; a document without an entry that can be read is an error when it is reached."""
    return entries.withColumn("loc", F.coalesce(F.nullif(F.trim("loc"), F.lit("")), F.raise_error(F.lit("sitemap entry without location")).cast("string")))


def decompressed(documents: DataFrame) -> DataFrame:
    """(source, xml) of ``documents(source, content)`` with raw bytes: those whose address ends in .gz are unpacked, and stay as they are if that fails."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if content is not None and source and urlsplit(source).path.endswith(".gz"):
                    try:
                        content = gzip.decompress(content)
                    except (OSError, EOFError, zlib.error):
                        pass
                texts.append(None if content is None else content.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["source", "xml"])

    return map_arrow(documents.select("source", F.col("content").cast("binary")), unpack, "source string, xml string")


def resolve_index(documents: DataFrame, roots: DataFrame, depth_limit: int | None = None) -> DataFrame:
    """Sitemaps (source, depth) reached from ``roots(source)`` through index files, at any depth unless one is given; a cycle is visited once."""
    from siltstone.operators.crawl import breadth_first

    edges = parse(documents, "sitemap").select(F.col("source").alias("src"), F.col("loc").alias("dst")).distinct()
    return breadth_first(roots.select(F.col("source").alias("url")), edges, depth_limit).select(F.col("url").alias("source"), "depth")


def load(entries: DataFrame, max_urls: int | None = None, position: str | None = None) -> DataFrame:
    """(url, priority, place) to visit, place from 0: by priority (missing counts as 0.5, the greatest first) and then by ``position``.

    The limit comes before repeats are dropped; each normalised url stands where it stands first. Without a column of positions the location decides ties.
    """
    order = F.col(position) if position else F.col("loc")
    own = valid(entries.withColumn("_pos", order), "_pos").select(F.coalesce("priority", F.lit(0.5)).alias("priority"), "loc", "_pos")
    if max_urls is not None:
        own = own.orderBy(F.col("priority").desc(), "_pos", "loc").limit(max_urls)
    best = own.groupBy(urls.normalize(F.col("loc")).alias("url")).agg(F.min(F.struct((-F.col("priority")).alias("k"), "_pos", "loc")).alias("first"))
    return numbered(best.select("url", (-F.col("first.k")).alias("priority"), "first"), "first").select("url", "priority", F.col("number").alias("place"))


def discover(robots: DataFrame) -> DataFrame:
    """(origin, sitemap) of the Sitemap lines of ``robots(origin, text)``; an origin without any gets /sitemap.xml."""
    lines = robots.select("origin", F.explode_outer(F.split("text", r"\r?\n")).alias("line"))
    named = lines.where(F.lower(F.trim("line")).startswith("sitemap:")).select("origin", F.trim(F.regexp_replace("line", r"(?i)^\s*sitemap:", "")).alias("sitemap")).distinct()
    rest = robots.select("origin").distinct().join(named, "origin", "left_anti").select("origin", F.concat("origin", F.lit("/sitemap.xml")).alias("sitemap"))
    return named.unionByName(rest)


def freshness(entries: DataFrame, results: DataFrame) -> DataFrame:
    """(url, state) of sitemap pages: missing (never fetched), outdated (changed since the last fetch) or current."""
    listed = valid(entries).groupBy(urls.normalised_address(F.col("loc"))["url"].alias("url")).agg(F.max("lastmod").alias("lastmod"))
    fetched = results.groupBy(urls.normalised_address(F.col("url"))["url"].alias("url")).agg(F.max("fetched_at").alias("at"))
    state = F.when(F.col("at").isNull(), "missing").when(F.col("lastmod") > F.col("at"), "outdated").otherwise("current")
    return listed.join(fetched, "url", "left").select("url", state.alias("state"))


def duplicates(entries: DataFrame) -> DataFrame:
    """Entries after the first (by priority, then time) of each location."""
    order = Window.partitionBy("loc").orderBy(F.col("priority").desc_nulls_last(), F.col("lastmod").desc_nulls_last())
    return valid(entries).withColumn("n", F.row_number().over(order)).where("n > 1").drop("n")
