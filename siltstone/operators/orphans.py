"""References to records that are missing, withdrawn or late, by kind and month.

Keys are dictionary-encoded as integers. For each range of 32,768 keys and
month there are compressed bitmaps of the referenced keys and of the parents'
changes: a list of places where few bits are set, the bits themselves else.
Each task makes them of its own rows, so only they are shuffled. Running over
the months gives the keys that have a good parent all month long, and
referenced AND NOT good are the keys to look at. Their references alone are
then compared with the parents' exact times: by key and hour, so that a hot
key is spread over its hours.

Results for special input: references without time or target and parents
without time or key do not count; repeated rows change nothing; of several
parents at one time the one with the greatest id is the latest; empty tables
give no parents or no references.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.urls import normalised_address
from siltstone.plans.lineage import cut, keep
from siltstone.plans.shipping import group_arrow, map_arrow

#: How much later than the reference its parent may come.
GRACE = "7 days"
WITHDRAWN = (404, 410)
#: Keys of one range, and from how many set bits on a bitmap is kept as bits.
RANGE = 1 << 15
DENSE = 2048
#: Rows from which a task makes bitmaps at once.
_HELD = 1 << 20
_BITMAP_BYTES = RANGE // 8
REFERENCED, ENDS_GOOD, ENDS_BAD, ANY_BAD = range(4)


def _month(time: Column) -> Column:
    return (F.year(time) * 12 + F.month(time)).cast("int")


def compressed(places: np.ndarray) -> bytes:
    """Bitmap of sorted distinct places: two bytes for each, or all bits if they are dense."""
    if len(places) < DENSE:
        return places.astype("<u2").tobytes()
    bits = np.zeros(RANGE, bool)
    bits[places] = True
    return np.packbits(bits, bitorder="little").tobytes()


def set_places(bits: np.ndarray, data: bytes) -> None:
    """Sets the bits of a compressed bitmap in ``bits``."""
    if len(data) == _BITMAP_BYTES:
        bits |= np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little").view(bool)
    else:
        bits[np.frombuffer(data, "<u2")] = True


def _bitmaps(rows: DataFrame) -> DataFrame:
    """(bucket, _month, what, bits) of ``rows(_key, _month, what)``, of each task's rows by themselves."""

    def make(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        key, month, what = (np.concatenate(x) for x in zip(*held, strict=True))
        bucket, place = (key - 1) >> 15, (key - 1) & (RANGE - 1)
        order = np.lexsort((place, what, month, bucket))
        bucket, month, what, place = bucket[order], month[order], what[order], place[order]
        group = np.concatenate(([True], (np.diff(bucket) != 0) | (np.diff(month) != 0) | (np.diff(what) != 0)))
        new = group | np.concatenate(([True], np.diff(place) != 0))
        bucket, month, what, place, group = bucket[new], month[new], what[new], place[new], group[new]
        starts = np.flatnonzero(group)
        data = [compressed(x) for x in np.split(place, starts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int64()), pa.array(month[starts], pa.int32()), pa.array(what[starts], pa.int32()), pa.array(data, pa.binary())], ["bucket", "_month", "what", "bits"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(i).to_numpy() for i in range(3)])
                size += batch.num_rows
            if size >= _HELD:
                yield make(held)
                held, size = [], 0
        if held:
            yield make(held)

    return map_arrow(rows.select("_key", "_month", "what"), build, "bucket long, _month int, what int, bits binary")


def _and_not(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Of one key range: (id, month) of the bits that survive referenced AND NOT good, months in order."""
    months: dict[int, dict[int, list[bytes]]] = {}
    for month, what, bits in zip(*(table.column(c).to_pylist() for c in ("_month", "what", "bits")), strict=True):
        months.setdefault(month, {}).setdefault(what, []).append(bits)
    good = np.zeros(RANGE, bool)
    ids, at = [], []
    for month in sorted(months):
        own = []
        for what in range(4):
            bits = np.zeros(RANGE, bool)
            for data in months[month].get(what, ()):
                set_places(bits, data)
            own.append(bits)
        left = np.flatnonzero(own[REFERENCED] & ~(good & ~own[ANY_BAD]))
        good = (good | own[ENDS_GOOD]) & ~own[ENDS_BAD]
        ids.append(left)
        at.append(np.full(len(left), month, np.int32))
    first = key[0].as_py() * RANGE + 1
    return pa.table({"_key": pa.array(np.concatenate(ids).astype(np.int64) + first), "_month": pa.array(np.concatenate(at), pa.int32())})


def orphan_references(references: DataFrame, parents: DataFrame, grace: str = GRACE) -> DataFrame:
    """Rows of ``references(target, t, ...)`` without a good parent at ``t`` plus ``grace``.

    ``parents(target, time, rank, good)``: a parent counts from ``time`` on;
    of those that count, the one with the greatest (time, rank) is the latest and decides by ``good``.
    """
    references = keep(references.where(F.col("target").isNotNull() & F.col("t").isNotNull()))
    parents = parents.where(F.col("target").isNotNull() & F.col("time").isNotNull()).select("target", "time", "rank", "good").withColumn("time", F.col("time") - F.expr(f"interval {grace}"))
    # Numbers from 1; kept, since numbering again could number otherwise. A key's number holds its part and its place there.
    keys = keep(references.select("target").distinct().select("target", (F.monotonically_increasing_id() + 1).alias("_key")))
    refs = references.join(keys, "target").withColumn("_month", _month(F.col("t")))
    times_of = keep(refs.select("_key", "t", "_month").distinct())
    known = keep(parents.join(keys, "target").select("_key", "time", "rank", "good"))
    by_month = (
        known.groupBy("_key", _month(F.col("time")).alias("_month"))
        .agg(F.max(F.struct("time", "rank", "good")).alias("latest"), F.bool_or(~F.col("good")).alias("any_bad"))
        .select("_key", "_month", F.array_compact(F.array(F.when(F.col("latest.good"), F.lit(ENDS_GOOD)).otherwise(F.lit(ENDS_BAD)), F.when(F.col("any_bad"), F.lit(ANY_BAD)))).alias("what"))
    )
    marks = times_of.select("_key", "_month", F.lit(REFERENCED).alias("what")).unionByName(by_month.select("_key", "_month", F.explode("what").alias("what")))
    left = cut(group_arrow(_bitmaps(marks).groupBy("bucket"), _and_not, "_key long, _month int"))
    times = times_of.join(left, ["_key", "_month"], "left_semi").select("_key", "t").withColumn("_hour", F.date_trunc("hour", "t"))
    events = known.join(left.select("_key").distinct(), "_key", "left_semi").withColumn("_hour", F.date_trunc("hour", "time"))
    at_end = events.groupBy("_key", "_hour").agg(F.max(F.struct("time", "rank", "good")).alias("latest"))
    hours = at_end.unionByName(times.select("_key", "_hour").distinct().withColumn("latest", F.lit(None).cast(at_end.schema["latest"].dataType)))
    before = Window.partitionBy("_key").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        hours.groupBy("_key", "_hour")
        .agg(F.max("latest").alias("latest"))
        .select("_key", "_hour", F.last(F.col("latest.good"), ignorenulls=True).over(before).alias("carried"))
    )
    both = times.select("_key", "_hour", F.col("t").alias("time"), F.lit(None).cast("long").alias("rank"), F.lit(None).cast("boolean").alias("good"), F.lit(1).alias("kind")).unionByName(
        events.select("_key", "_hour", "time", "rank", "good", F.lit(0).alias("kind"))
    )
    within = Window.partitionBy("_key", "_hour").orderBy("time", "kind", "rank").rowsBetween(Window.unboundedPreceding, 0)
    state = both.withColumn("state", F.last("good", ignorenulls=True).over(within)).where("kind = 1").select("_key", "_hour", F.col("time").alias("t"), "state")
    orphans = state.join(carried, ["_key", "_hour"]).where(~F.coalesce("state", "carried", F.lit(False))).select("_key", "t")
    found = orphans.join(keys, "_key").select("target", "t")
    return references.join(found, ["target", "t"], "left_semi")


def _month_name(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM")


def _once(column: Column, name: str) -> Column:
    """A generated column: it is computed once, however often its fields are used."""
    return F.explode(F.array(column)).alias(name)


def page_references(results: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """(ref_kind, ref_key, t, target) of links to the own host and of checkpoint rows."""
    own = normalised_address(F.col("url"))["host"]
    rows = results.where("fetched_at IS NOT NULL").select(F.col("result_id").cast("string").alias("ref_key"), F.col("fetched_at").alias("t"), own.alias("own"), "links")
    links = rows.select("ref_key", "t", "own", F.explode(F.array_distinct("links")).alias("link")).where(F.col("link").rlike(r"(?i)^\s*https?://"))
    links = links.select("ref_key", "t", "own", _once(normalised_address(F.col("link")), "a"))
    links = links.where(F.col("a.host") == F.col("own")).select(F.lit("links").alias("ref_kind"), "ref_key", "t", F.col("a.url").alias("target"))
    saved = checkpoint.select(normalised_address(F.col("url"))["url"].alias("target"), F.col("last_scraped").alias("t"))
    return links.unionByName(saved.select(F.lit("checkpoint").alias("ref_kind"), F.col("target").alias("ref_key"), "t", "target"))


def page_parents(results: DataFrame) -> DataFrame:
    """(target, time, rank, good) of fetched pages under their normalised url and final_url."""
    named = results.select("result_id", "fetched_at", "status_code", F.explode(F.array_distinct(F.array(normalised_address(F.col("url"))["url"], normalised_address(F.col("final_url"))["url"]))).alias("target"))
    good = ~F.coalesce(F.col("status_code").isin(*WITHDRAWN), F.lit(False))
    return named.select("target", F.col("fetched_at").alias("time"), F.col("result_id").alias("rank"), good.alias("good"))


def orphans_by_month(results: DataFrame, checkpoint: DataFrame, assets: DataFrame) -> DataFrame:
    """Distinct (ref_kind, ref_month, ref_key, target) of all orphan references of the crawl tables.

    Pages and assets go the same way together; a sign before the key keeps their names apart.
    """
    page, asset = F.lit("p"), F.lit("a")
    named = results.where("fetched_at IS NOT NULL").select(F.col("result_id").cast("string").alias("ref_key"), F.col("fetched_at").alias("t"), F.explode(F.array_distinct("assets")).alias("target"))
    named = named.where(F.col("target").rlike(r"(?i)^https?://")).select(F.lit("assets").alias("ref_kind"), "ref_key", "t", "target")
    references = page_references(results, checkpoint).distinct().withColumn("target", F.concat(page, "target")).unionByName(named.withColumn("target", F.concat(asset, "target")))
    # An asset is never withdrawn: its first saving decides.
    saved = assets.where(F.col("output_path").isNotNull()).groupBy(F.concat(asset, "asset_url").alias("target")).agg(F.min("saved_at").alias("time"))
    parents = page_parents(results).withColumn("target", F.concat(page, "target")).unionByName(saved.select("target", "time", F.lit(0).cast("long").alias("rank"), F.lit(True).alias("good")))
    found = orphan_references(references, parents)
    return found.select("ref_kind", _month_name(F.col("t")).alias("ref_month"), "ref_key", F.expr("substr(target, 2)").alias("target")).distinct()
