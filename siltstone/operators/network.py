"""Tables of names, answers and waiting requests: name cache, answer cache, response windows, queue bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import urls


def is_expired(expires_at: Column, now: Column) -> Column:
    """Is the entry's time over? An entry without end never expires."""
    return F.coalesce(now > expires_at, F.lit(False))


def seconds_left(expires_at: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(expires_at) - F.unix_micros(now)) / 1e6)


def names_to_resolve(addresses: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """(host) of ``addresses(url)`` for which ``cache(host, ip, expires_at)`` has no entry that holds."""
    wanted = addresses.select(urls.host(F.col("url")).alias("host")).where("host <> ''").distinct()
    return wanted.join(cache.where(~is_expired(F.col("expires_at"), now)).select("host").distinct(), "host", "left_anti")


def lookup_summary(lookups: DataFrame) -> DataFrame:
    """One row (lookups, hits, hit_percent, mean_ms) of ``lookups(hit, ms)``; the mean is over misses, zero without any."""
    total, hits = F.count("*"), F.count_if("hit")
    return lookups.agg(total.alias("lookups"), hits.alias("hits"), F.coalesce(F.try_divide(hits * 100.0, total), F.lit(0.0)).alias("hit_percent"), F.coalesce(F.avg(F.when(~F.col("hit"), F.col("ms"))), F.lit(0.0)).alias("mean_ms"))


def cached_answers(answers: DataFrame, now: Column, ttl_seconds: int = 3600) -> DataFrame:
    """Of each url of ``answers(url, fetched_at, ...)`` the latest answer that is not older than ``ttl_seconds``."""
    fresh = answers.where((F.unix_micros(now) - F.unix_micros("fetched_at")).between(0, ttl_seconds * 1_000_000))
    best = F.struct("fetched_at", *(c for c in fresh.columns if c not in ("fetched_at", "url")))
    return fresh.where("url IS NOT NULL").groupBy("url").agg(F.max(best).alias("_x")).select(*(F.col("url") if c == "url" else F.col("_x")[c].alias(c) for c in answers.columns))


def response_windows(answers: DataFrame, last: int = 100) -> DataFrame:
    """``answers(key, t, id, seconds)`` with the mean of each key's last answers up to that one (by t, then id)."""
    return answers.withColumn("mean_seconds", F.avg("seconds").over(Window.partitionBy("key").orderBy("t", "id").rowsBetween(1 - last, 0)))


def fast_streaks(answers: DataFrame, fast_seconds: float = 0.2) -> DataFrame:
    """``answers(key, t, id, status, seconds)`` with the number of fast good answers in a row up to each (by t, then id)."""
    order = Window.partitionBy("key").orderBy("t", "id")
    fast = F.coalesce(F.col("status").between(200, 299) & (F.col("seconds") < fast_seconds), F.lit(False))
    islands = answers.withColumn("_fast", fast).withColumn("_island", F.sum((~F.col("_fast")).cast("int")).over(order))
    count = F.sum(F.col("_fast").cast("int")).over(Window.partitionBy("key", "_island").orderBy("t", "id"))
    return islands.withColumn("streak", count.cast("int")).drop("_fast", "_island")


def queue_depths(moves: DataFrame) -> DataFrame:
    """``moves(t, id, change, bytes)`` of one queue by hour, with its depth and bytes at the hour's end and the greatest of both so far.

    Changes are added up by hour first, so the running sums see one row an hour.
    """
    hours = moves.groupBy(F.date_trunc("hour", "t").alias("hour")).agg(F.sum("change").alias("change"), F.sum(F.col("bytes") * F.col("change")).alias("bytes"))
    so_far = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    sums = hours.select("hour", F.sum("change").over(so_far).alias("depth"), F.sum("bytes").over(so_far).alias("queued_bytes"))
    return sums.withColumn("max_depth", F.max("depth").over(so_far)).withColumn("max_bytes", F.max("queued_bytes").over(so_far))


def memory_state(used_share: Column) -> Column:
    """What a task does at a share of used memory: go on, warn or stop. An unknown share goes on."""
    return F.when(used_share > 0.95, "stop").when(used_share > 0.80, "warn").otherwise("go")


def progress(results: DataFrame, queued: Column) -> DataFrame:
    """One row (done, total, percent): pages done and what waits; nothing at all is done to a hundred per cent."""
    done = F.count("*")
    total = done + F.coalesce(F.max(queued), F.lit(0))
    return results.agg(done.alias("done"), total.alias("total"), F.coalesce(F.round(F.try_divide(done * 100.0, total), 2), F.lit(100.0)).alias("percent"))
