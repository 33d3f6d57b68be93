"""Reports: counters, errors with examples, asset and sitemap summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import pages, paths, urls


def crawl_stats(results: DataFrame) -> DataFrame:
    """One row of counters over all fetches; an empty table gives zeros."""
    ok = F.col("status_code") < 400
    return results.agg(
        F.count_if(ok & (F.col("status_code") != 304)).alias("pages_crawled"),
        F.count_if(F.col("status_code") >= 400).alias("pages_failed"),
        F.count_if(F.col("status_code") == 304).alias("not_modified"),
        F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.sum(F.size("assets").cast("long")), F.lit(0)).alias("assets_found"),
        F.coalesce(F.max("queue_size"), F.lit(0)).alias("max_queue"),
    )


def error_counts(results: DataFrame) -> DataFrame:
    return results.where("status_code >= 400").groupBy(F.concat(F.lit("HTTP "), F.col("status_code").cast("string")).alias("type")).agg(F.count("*").alias("errors"))


def error_examples(results: DataFrame, examples: int = 3) -> DataFrame:
    """(type, errors, examples, more): the first ``examples`` urls of each type by result_id.

    Each part keeps its own first ones before the shuffle, so a frequent type is not gathered.
    """
    rows = results.where("status_code >= 400").select(F.concat(F.lit("HTTP "), F.col("status_code").cast("string")).alias("type"), "result_id", "url")
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("type", F.pmod(F.xxhash64("result_id"), F.lit(64))).orderBy("result_id"))).where(F.col("n") <= examples)
    first = ranked.groupBy("type").agg(F.slice(F.array_sort(F.collect_list(F.struct("result_id", F.substring("url", 1, 80).alias("url")))), 1, examples).alias("x"))
    counts = rows.groupBy("type").agg(F.count("*").alias("errors"))
    return counts.join(first, "type").select("type", "errors", F.array_join(F.transform("x", lambda e: e["url"]), "\n").alias("examples"), F.greatest(F.lit(0).cast("long"), F.col("errors") - examples).alias("more"))


def asset_summary(results: DataFrame) -> DataFrame:
    """Distinct assets and references by kind."""
    found = results.select(F.explode("assets").alias("url"))
    return found.groupBy(pages.asset_type(F.col("url")).alias("asset_type")).agg(F.count_distinct("url").alias("assets"), F.count("*").alias("uses"))


def host_summary(results: DataFrame) -> DataFrame:
    """Fetches, distinct pages, bytes and average size by host."""
    named = results.select(urls.normalised_address(F.col("url")).alias("a"), "html", "status_code")
    return named.groupBy(F.col("a.host").alias("host")).agg(
        F.count("*").alias("fetches"),
        F.count_distinct("a.url").alias("pages"),
        F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).alias("bytes"),
        F.round(F.try_divide(F.sum(F.octet_length("html")), F.count("html")), 3).alias("mean_bytes"),
        F.count_if(F.col("status_code") >= 400).alias("failed"),
    )


def path_collisions(results: DataFrame) -> DataFrame:
    """(path, pages): document paths that several distinct pages would share."""
    pages_ = results.select(urls.normalised_address(F.col("url"))["url"].alias("url")).where("url IS NOT NULL").distinct()
    return pages_.groupBy(paths.document_path(F.col("url")).alias("path")).agg(F.count("*").alias("pages")).where("pages > 1")


def preview(results: DataFrame) -> DataFrame:
    """(result_id, url, output_path, title, asset_count): what a crawl would write."""
    return results.where("html IS NOT NULL AND html <> ''").select(
        "result_id", "url", paths.document_path(F.col("url")).alias("output_path"), pages.title(F.col("html")).alias("title"), F.size(F.coalesce(F.col("assets"), F.array().cast("array<string>"))).alias("asset_count")
    )


def status_rollup(results: DataFrame) -> DataFrame:
    """Fetches by month and status, with sums of months and of all."""
    rows = results.select(F.date_format("fetched_at", "yyyy-MM").alias("month"), F.col("status_code").cast("string").alias("status"))
    return rows.rollup("month", "status").agg(F.count("*").alias("fetches"), F.grouping_id().alias("level"))


def saved_path_collisions(checkpoint: DataFrame) -> DataFrame:
    """(path, pages): saved files that several distinct pages of ``checkpoint(url, file_path)`` claim."""
    own = checkpoint.where("url IS NOT NULL AND file_path IS NOT NULL").select(urls.normalised_address(F.col("url"))["url"].alias("url"), F.col("file_path").alias("path")).distinct()
    return own.groupBy("path").agg(F.count("*").alias("pages")).where("pages > 1")


def preview_totals(previewed: DataFrame) -> DataFrame:
    """One row (pages, assets, paths) of what :func:`preview` lists."""
    return previewed.agg(F.count("*").alias("pages"), F.coalesce(F.sum(F.col("asset_count").cast("long")), F.lit(0)).alias("assets"), F.count_distinct("output_path").alias("paths"))


def preview_document(previewed: DataFrame) -> DataFrame:
    """(line) JSON of each previewed page, to be written as text."""
    return previewed.select(F.to_json(F.struct("url", "output_path", "title", "asset_count")).alias("line"))


def size_text(size: Column) -> Column:
    """Size as people read it: KB below a tenth of a megabyte, else MB."""
    mb = size / 1048576
    return F.when(mb < 0.1, F.concat(F.format_number(size / 1024, 1), F.lit(" KB"))).otherwise(F.concat(F.format_number(mb, 1), F.lit(" MB")))


def summary(results: DataFrame) -> DataFrame:
    """Counters of a crawl with its length, pages a second and size; a crawl of no length has no rate."""
    span = (F.max(F.unix_micros("fetched_at")) - F.min(F.unix_micros("fetched_at"))) / 1e6
    done = F.count_if((F.col("status_code") < 400) & (F.col("status_code") != 304))
    size = F.coalesce(F.sum(F.octet_length("html")), F.lit(0))
    return results.agg(
        done.alias("pages_crawled"), F.count_if(F.col("status_code") >= 400).alias("pages_failed"), size.alias("total_bytes"), F.coalesce(span, F.lit(0.0)).alias("seconds"), F.try_divide(done, span).alias("pages_per_second"), size_text(size).alias("size")
    )


def page_count(checkpoint: DataFrame) -> DataFrame:
    """One row (pages): distinct normalised addresses of a saved state."""
    return checkpoint.agg(F.count_distinct(urls.normalize(F.col("url"))).alias("pages"))


def ordered_pages(checkpoint: DataFrame) -> DataFrame:
    """Saved pages in order of address, then time: ordered by ranges, never in one task."""
    return checkpoint.where("url IS NOT NULL").orderBy("url", "last_scraped")
