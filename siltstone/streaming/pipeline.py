"""The same steps under Structured Streaming: landing folder, event windows and rate limits."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.functions import pages, paths, urls
from siltstone.operators import state
from siltstone.plans.lineage import ensure_checkpoint_dir


def landing(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = 100, bytes_per_trigger: str | None = None) -> DataFrame:
    """Fetched pages as they land; the files or bytes of one trigger bound a batch (one of the two), which is what holds a fast producer back."""
    source = spark.readStream.schema(schema)
    source = source.option("maxBytesPerTrigger", bytes_per_trigger) if bytes_per_trigger else source.option("maxFilesPerTrigger", files_per_trigger)
    return source.parquet(folder)


def saved_pages(results: DataFrame) -> DataFrame:
    """Checkpoint rows of fetched pages, batch or stream."""
    return results.where("html IS NOT NULL AND html <> ''").select(
        urls.normalised_address(F.col("url"))["url"].alias("url"), pages.content_hash(F.col("html")).alias("content_hash"), F.col("fetched_at").alias("last_scraped"), "status_code", paths.document_path(F.col("url")).alias("file_path"), "etag", "last_modified"
    )


def upsert_into(stream: DataFrame, folder: str, checkpoint: str, parts: int = 64):
    """Query that keeps the state table under ``folder``, in ``parts`` parts by a hash of the address.

    A batch reads and rewrites only the parts that it touches: each part has
    versions named by the batch that wrote them, and a list of the current ones
    is written last, under the batch's number. A repeated batch starts from the
    list before it and writes the same versions again; what an unfinished batch
    left is in no list. Versions that the two newest lists do not name are removed.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = state.latest(batch, "url", "last_scraped").withColumn("_part", F.pmod(F.xxhash64("url"), F.lit(parts)).cast("int")).persist()
        touched = sorted(r[0] for r in new.select("_part").distinct().collect())
        before = current_parts(spark, folder, number - 1)
        old_paths = [f"{folder}/part={p}/v{before[p]}" for p in touched if p in before]
        rows = new
        if old_paths:
            old = spark.read.parquet(*old_paths)
            rows = state.upsert(old, new.drop("_part")).withColumn("_part", F.pmod(F.xxhash64("url"), F.lit(parts)).cast("int"))
        at = f"{folder}/batch-{number}"
        rows.repartition("_part").write.mode("overwrite").partitionBy("_part").parquet(at)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        system = path(folder).getFileSystem(conf)
        for p in touched:
            target = path(f"{folder}/part={p}/v{number}")
            system.delete(target, True)
            system.mkdirs(target.getParent())
            system.rename(path(f"{at}/_part={p}"), target)
        system.delete(path(at), True)
        now = before | dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(now.items()), "part int, version long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/_list/v{number}")
        # The list before stays, so a repeated batch can start from it; what only older lists name goes.
        older = current_parts(spark, folder, number - 2)
        for p in touched:
            if p in older and older[p] != before.get(p):
                system.delete(path(f"{folder}/part={p}/v{older[p]}"), True)
        new.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def current_parts(spark: SparkSession, folder: str, number: int) -> dict[int, int]:
    """Version of each part after batch ``number``; at most as many entries as there are parts."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_list/v{number}")
    if number < 0 or not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return {}
    return {r[0]: r[1] for r in spark.read.parquet(f"{folder}/_list/v{number}").collect()}


def current_state(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """The state table after batch ``number``."""
    found = current_parts(spark, folder, number)
    if not found:
        raise ValueError("no batch was finished")
    return spark.read.parquet(*(f"{folder}/part={p}/v{v}" for p, v in sorted(found.items())))


def tumbling_counts(events: DataFrame, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Events and values by window and type, of batch or stream."""
    rows = events.withWatermark("ts", lateness) if events.isStreaming else events
    counted = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "events", "total")


def sliding_counts(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", lateness: str = "2 hours") -> DataFrame:
    rows = events.withWatermark("ts", lateness) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), "events")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "2 hours") -> DataFrame:
    """Sessions of each user: runs of events closer than the gap."""
    rows = events.withWatermark("ts", lateness) if events.isStreaming else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), "events")


def token_bucket(times: list[float], rate: float, burst: float, tokens: float | None = None, last: float | None = None) -> tuple[list[bool], float, float | None]:
    """Whether each request (in order of time) finds a token; the tokens and time to go on from."""
    tokens = burst if tokens is None else tokens
    out = []
    for t in times:
        if last is not None:
            tokens = min(burst, tokens + max(0.0, t - last) * rate)
        last = t if last is None else max(last, t)
        out.append(tokens >= 1)
        if out[-1]:
            tokens -= 1
    return out, tokens, last


def rate_limited(events: DataFrame, rate: float, burst: float) -> DataFrame:
    """(user_id, requests, allowed) of a stream under a token bucket for each user, kept in the state store."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = kept.get if kept.exists else (burst, None)
        asked = allowed = 0
        for frame in frames:
            times = sorted(frame["ts"].astype("int64") / 1e9 if frame["ts"].dtype.kind == "i" else frame["ts"].map(lambda t: t.timestamp()))
            ok, tokens, last = token_bucket(times, rate, burst, tokens, last if last is None or last >= 0 else None)
            asked += len(ok)
            allowed += sum(ok)
        kept.update((float(tokens), float(last) if last is not None else -1.0))
        yield pd.DataFrame({"user_id": [key[0]], "requests": [asked], "allowed": [allowed]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, requests long, allowed long", "tokens double, last double", "update", GroupStateTimeout.NoTimeout)


# Limits and factors of the adaptive rate.
LEAST_RATE, MOST_RATE, START_RATE = 0.5, 100.0, 10.0
REFUSED, OVERLOADED, FASTER, SLOWER = 0.5, 0.7, 1.1, 0.95
FAST_SECONDS, SLOW_SECONDS, FAST_IN_A_ROW = 0.2, 2.0, 20


def adaptive_step(status: int, seconds: float, rate: float, fast: int, least: float = LEAST_RATE, most: float = MOST_RATE) -> tuple[float, int]:
    """(rate, fast answers in a row) after one more answer."""
    if status == 429:
        rate, fast = rate * REFUSED, 0
    elif status == 503:
        rate, fast = rate * OVERLOADED, 0
    elif 200 <= status < 300 and seconds < FAST_SECONDS:
        fast += 1
        if fast >= FAST_IN_A_ROW:
            rate, fast = rate * FASTER, 0
    else:
        fast = 0
        if seconds > SLOW_SECONDS:
            rate *= SLOWER
    return min(most, max(least, rate)), fast


def adaptive_rate(statuses: list[tuple[int, float]], rate: float = START_RATE, least: float = LEAST_RATE, most: float = MOST_RATE) -> float:
    """Rate after answers (status, seconds): halved by 429, 0.7 times by 503, a tenth more after 20 fast ones in a row, a twentieth less when slow."""
    fast = 0
    for status, seconds in statuses:
        rate, fast = adaptive_step(status, seconds, rate, fast, least, most)
    return rate


def adaptive_limits(answers: DataFrame) -> DataFrame:
    """(host, answers, rate) of a stream ``answers(host, t, status, seconds)``: each host's rate, kept with its streak in the state store.

    Answers of one batch are taken in order of time; NULL statuses and times count as failures without end.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        rate, fast, seen = kept.get if kept.exists else (START_RATE, 0, 0)
        rows = pd.concat(list(frames)).sort_values(["t", "status"], kind="stable")
        for status, seconds in zip(rows["status"].fillna(0), rows["seconds"].fillna(float("inf")), strict=True):
            rate, fast = adaptive_step(int(status), float(seconds), rate, fast)
        seen += len(rows)
        kept.update((float(rate), int(fast), int(seen)))
        yield pd.DataFrame({"host": [key[0]], "answers": [seen], "rate": [rate]})

    return answers.groupBy("host").applyInPandasWithState(step, "host string, answers long, rate double", "rate double, fast int, seen long", "update", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame) -> DataFrame:
    """Runs a streaming aggregation over all that is there now; its result is a table in the shared folder, replaced as a whole by each batch."""
    spark = stream.sparkSession
    at = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/result")

    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/result")
