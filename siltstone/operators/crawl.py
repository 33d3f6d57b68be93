"""Frontier expansion over an already fetched web: levels of a breadth-first search with anti-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import pages as html
from siltstone.functions import urls
from siltstone.operators.rules import Rules, follow, is_html
from siltstone.plans.lineage import cut, fixed_partitioning
from siltstone.plans.order import numbered


def edges_of(results: DataFrame) -> DataFrame:
    """Distinct (src, dst) of fetched pages and their safe links, both normalised. Pages without url or links give none."""
    pages = results.where("url IS NOT NULL").select(F.explode(F.array(urls.normalize(F.col("url")))).alias("src"), "links").where("src IS NOT NULL")
    rows = pages.select("src", F.explode(F.array_distinct("links")).alias("link")).where(urls.is_safe_scheme(F.col("link")))
    # Generated columns are computed once, however often the filters behind them use them.
    return rows.select("src", F.explode(F.array(urls.normalize(F.col("link")))).alias("dst")).where("dst IS NOT NULL").distinct()


def breadth_first(seeds: DataFrame, edges: DataFrame, depth_limit: int | None = None) -> DataFrame:
    """(url, depth, parent) of all that ``seeds(url)`` reach over ``edges(src, dst)``: the least depth, and of its parents the least.

    Without a limit levels go on until one is empty. Edges and every level are
    partitioned by address once and kept in the checkpoint folder, so a level
    shuffles only what it finds, never the edges or what was seen, and plans
    do not grow with depth.
    """
    spark = seeds.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with fixed_partitioning(spark):
        edges = cut(edges.select("src", "dst").repartition(parts, "src"))
        first = seeds.where("url IS NOT NULL").select("url").distinct().select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"))
        frontier = seen = cut(first.repartition(parts, "url"))
        depth = 0
        while depth_limit is None or depth < depth_limit:
            depth += 1
            found = frontier.select(F.col("url").alias("src")).join(edges, "src").groupBy(F.col("dst").alias("url")).agg(F.min("src").alias("parent"))
            frontier = cut(found.join(seen.select("url"), "url", "left_anti").select("url", F.lit(depth).alias("depth"), "parent"))
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier)
    return seen


def seeds_of(starts: DataFrame | None = None, queue: DataFrame | None = None, sitemap: DataFrame | None = None) -> DataFrame:
    """Frontier (url, parent) of start addresses ``starts(url)``, a saved queue ``queue(url, parent_url)`` and sitemap addresses ``sitemap(url)``.

    Each normalised address once; a parent that the queue knows is kept. Blank and NULL addresses give nothing.
    """
    parts = [x.select(urls.normalize(F.col("url")).alias("url"), F.lit(None).cast("string").alias("parent")) for x in (starts, sitemap) if x is not None]
    if queue is not None:
        parts.append(queue.select(urls.normalize(F.col("url")).alias("url"), F.col("parent_url").alias("parent")))
    if not parts:
        raise ValueError("no source of addresses")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.where("url IS NOT NULL").groupBy("url").agg(F.min("parent").alias("parent"))


def crawl(results: DataFrame, seeds: DataFrame, rules: Rules, max_pages: int | None = None) -> DataFrame:
    """Pages reached from the seeds by links that the rules follow; exact limit in order of (depth, url)."""
    edges = edges_of(results)
    edges = edges.where(follow(F.col("dst"), rules))
    reached = breadth_first(seeds.select(urls.normalize(F.col("url")).alias("url")), edges, rules.depth_limit)
    return reached.orderBy("depth", "url").limit(max_pages) if max_pages is not None else reached


def unvisited(results: DataFrame, frontier: DataFrame, checkpoint: DataFrame, now: Column, max_age_days: int | None, least_points: int = 30) -> DataFrame:
    """The scan router: fetched pages of ``frontier(url)`` that the checkpoint does not hold fresh, each with the route it goes by.

    (result_id, host, route) as of :func:`routes`, over both routes together.
    """
    wanted = not_checkpointed(frontier.select("url").distinct(), checkpoint, now, max_age_days)
    own = results.withColumn("_at", urls.normalize(F.col("url"))).join(wanted.select(F.col("url").alias("_at")), "_at", "left_semi").drop("_at")
    return routes(own, least_points)


def not_checkpointed(frontier: DataFrame, checkpoint: DataFrame, now: Column, max_age_days: int | None) -> DataFrame:
    """Frontier without what the checkpoint holds and is not older than ``max_age_days``; NULL keeps all that it holds out."""
    fresh = checkpoint if max_age_days is None else checkpoint.where(F.col("last_scraped") >= now - F.expr(f"interval {max_age_days} days"))
    return frontier.join(fresh.select(urls.normalize(F.col("url")).alias("url")).distinct(), "url", "left_anti")


def routes(results: DataFrame, least_points: int = 30, forced_hosts: tuple[str, ...] = ()) -> DataFrame:
    """(result_id, host, route) with route "http" or "js": once a page of a host needs scripts, its later pages go the same way.

    Stickiness is the host's first such fetch (one aggregate), compared with each
    page's own time, so no host is sorted in one task.
    """
    rows = html.with_quality(results.where("html IS NOT NULL AND html <> ''").select("result_id", "fetched_at", "url", "html"))
    judged = rows.select("result_id", "fetched_at", urls.host(F.col("url")).alias("host"), "q")
    weak = html.needs_js(F.col("q")) | (html.quality_points(F.col("q")) < least_points) | F.col("host").isin(*forced_hosts)
    judged = cut(judged.select("result_id", "fetched_at", "host", F.coalesce(weak, F.lit(False)).alias("weak")))  # narrow, and read twice
    first = judged.where("weak").groupBy("host").agg(F.min(F.struct("fetched_at", "result_id")).alias("first"))
    later = F.struct("fetched_at", "result_id") > F.col("first")
    return judged.join(first, "host", "left").select("result_id", "host", F.when(F.col("weak") | F.coalesce(later, F.lit(False)), "js").otherwise("http").alias("route"))


def fetched_pages(results: DataFrame) -> DataFrame:
    """Rows that count as fetched pages: html content, status below 400, not 304."""
    return results.where(is_html(F.col("content_type")) & (F.col("status_code") < 400) & (F.col("status_code") != 304))


def queue_positions(frontier: DataFrame) -> DataFrame:
    """(position, url, parent) from 0, in order of (depth, url)."""
    return numbered(frontier.select("depth", "url", "parent"), "depth", "url").select(F.col("number").alias("position"), "url", "parent")
