"""Saved crawl state: upsert, staleness, conditional requests and change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import urls


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key with the greatest ``order``; NULLs are least. One aggregate with partial results, no sort of a hot key."""
    whole = F.struct(*(F.col(c) for c in order), *(F.col(c) for c in rows.columns if c not in order))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(whole).alias("_row")).select(*(F.col("_row")[c].alias(c) for c in rows.columns))


def upsert(old: DataFrame, new: DataFrame, key: str = "url", time: str = "last_scraped") -> DataFrame:
    """State after the new rows: of each key the latest, and of equal times the new one. Missing columns become NULL."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, key, time, "_new").drop("_new")


def staleness(wanted: DataFrame, state: DataFrame, now: Column, max_age_days: int | None) -> DataFrame:
    """``wanted(url, ...)`` with a column fetch: unknown pages and those saved too long ago or at an unknown time; without an age limit only unknown ones."""
    saved = state.groupBy("url").agg(F.max("last_scraped").alias("_at"), F.count("*").alias("_n"))
    age = (F.unix_micros(now) - F.unix_micros("_at")) / 86_400_000_000
    known = F.lit(False) if max_age_days is None else F.coalesce(age > max_age_days, F.lit(True))
    return wanted.join(saved, "url", "left").withColumn("fetch", F.when(F.col("_n").isNull(), F.lit(True)).otherwise(known)).drop("_at", "_n")


def conditional_headers(wanted: DataFrame, state: DataFrame) -> DataFrame:
    """``wanted(url, ...)`` with a map column headers for conditional requests."""
    saved = latest(state.select("url", "last_scraped", "etag", "last_modified"), "url", "last_scraped")
    pairs = F.filter(
        F.array(F.struct(F.lit("If-None-Match").alias("k"), F.col("_etag").alias("v")), F.struct(F.lit("If-Modified-Since").alias("k"), F.col("_modified").alias("v"))),
        lambda x: x["v"].isNotNull() & (x["v"] != ""),
    )
    joined = wanted.join(saved.select("url", F.col("etag").alias("_etag"), F.col("last_modified").alias("_modified")), "url", "left")
    return joined.withColumn("headers", F.map_from_entries(pairs)).drop("_etag", "_modified")


def changes(results: DataFrame, state: DataFrame) -> DataFrame:
    """(url, change) of the latest fetch of each page against the saved state: new, changed, unchanged or gone."""
    page = urls.normalised_address(F.col("url"))["url"]
    now = latest(results.where("fetched_at IS NOT NULL").select(page.alias("url"), "fetched_at", "result_id", "status_code", "content_hash"), "url", "fetched_at", "result_id")
    before = latest(state.select(page.alias("url"), "last_scraped", "content_hash"), "url", "last_scraped", "content_hash").select("url", F.col("content_hash").alias("old"), F.lit(True).alias("known"))
    kind = (
        F.when(F.col("status_code").isin(404, 410), "gone")
        .when(F.col("known").isNull(), "new")
        .when((F.col("status_code") == 304) | F.lower("content_hash").eqNullSafe(F.lower("old")), "unchanged")
        .otherwise("changed")
    )
    return now.join(before, "url", "left").select("url", kind.alias("change"))
