"""More queries of the core operators: rewriting, conversion, robots, sitemaps, checkpoints, sinks, network tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import pages, paths, rewriting, urls
from siltstone.operators import convert, crawl, network, reports, rules, sitemaps, state, transforms
from siltstone.sources import checkpoints, files

LAYOUT = rewriting.Layout(("docs.ivedfeld.example", "wiltane-11.example", "learn.marlume-12.example"), strip_prefix="/v1")
NOW = "2025-12-01"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _now() -> Column:
    return F.lit(NOW).cast("timestamp")


# --- rewriting and conversion ------------------------------------------------------------------


def _link_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(result_id, url, text): a Markdown text of each page's links and assets."""
    link = lambda mark: lambda x: F.concat(F.lit(mark), F.lit("[see]("), x, F.lit(") and"))
    rows = table(spark, folder, "crawl_results").where("url IS NOT NULL")
    lines = F.concat(F.transform(F.coalesce("links", F.array().cast("array<string>")), link("")), F.transform(F.coalesce("assets", F.array().cast("array<string>")), link("!")), F.array(F.lit("![up](../x.png) ![own](img/a.png) [mail](mailto:a@b.example) [in](/v1/guide/)")))
    return rows.select("result_id", F.trim("url").alias("url"), F.array_join(lines, "\n").alias("text"))


def links_rewritten(spark: SparkSession, folder: str) -> DataFrame:
    return _link_texts(spark, folder).select("result_id", rewriting.rewrite(F.col("text"), F.col("url"), LAYOUT).alias("text"))


def links_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Links to own pages by page, and how many of the files they mean are there."""
    rows = _link_texts(spark, folder).groupBy("url").agg(F.max(F.struct("result_id", "text")).alias("x")).select("url", "x.text")
    return rewriting.link_graph(rows, LAYOUT).groupBy("url").agg(F.count("*").alias("links"), F.count_if("saved").alias("saved"))


def links_broken(spark: SparkSession, folder: str) -> DataFrame:
    """Links to files that no document has, for documents under their saved paths."""
    saved = table(spark, folder, "checkpoint_pages").where("file_path IS NOT NULL").select(F.xxhash64("file_path").alias("doc_id"), F.col("file_path").alias("path")).distinct()
    text = F.concat(F.lit("[a]("), F.regexp_replace("path", r"\.md$", ""), F.lit(") [b]("), F.regexp_replace("path", "e", "i"), F.lit(") [c](https://x.example/) ![d](none.png)"))
    found = transforms.broken_links(saved.withColumn("text", text))
    return saved.join(found, "doc_id").select("path", "target")


def pages_converted(spark: SparkSession, folder: str) -> DataFrame:
    """The composed conversion: its paths, titles, heads and failures (the Markdown itself is another query's)."""
    rows = convert.documents(table(spark, folder, "crawl_results"), LAYOUT, remove=("nav", "footer", "header", "aside"))
    head = F.regexp_extract("text", r"(?s)^(---\nscraped_at: .*?\n---\n)\n", 1)
    return rows.select("result_id", "path", "title", "category", "error", F.nullif(F.regexp_extract(head, r"\nurl: ([^\n]*)", 1), F.lit("")).alias("head_url"), (F.col("bytes") > 0).alias("written"))


def pages_failed(spark: SparkSession, folder: str) -> DataFrame:
    """Failures of the conversion by category and type."""
    rows = convert.documents(table(spark, folder, "crawl_results"), LAYOUT, limit_mb=0.005)
    return convert.error_rows(rows).groupBy("category", "type").agg(F.count("*").alias("errors"))


def errors_expanded(spark: SparkSession, folder: str) -> DataFrame:
    return convert.expanded(reports.error_counts(table(spark, folder, "crawl_results"))).groupBy("type").agg(F.count("*").alias("rows"), F.sum("number").alias("numbers"))


def frontmatter_heads(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").where("text IS NOT NULL AND title IS NOT NULL AND scraped_at IS NOT NULL AND url IS NOT NULL")
    made = pages.frontmatter(F.col("text"), F.col("title"), F.col("url"), F.date_format("scraped_at", "yyyy-MM-dd"))
    return rows.select("doc_id", F.substring_index(made, "\n---\n\n", 1).alias("head"))


def files_planned(spark: SparkSession, folder: str) -> DataFrame:
    """What the sink of Markdown files would write; of several documents with one path the last."""
    rows = table(spark, folder, "documents").where("url IS NOT NULL").select("doc_id", paths.document_path(F.col("url")).alias("path"), "text")
    return files.save_texts(rows, "/unused", "doc_id", dry=True).select("path", "bytes", "state")


def files_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Averages of written files, taken from the saved assets."""
    rows = table(spark, folder, "asset_rows").select(F.length("asset_url").cast("long").alias("bytes"), F.when(F.col("output_path").isNull(), "fetch").otherwise("written").alias("state"))
    return files.writer_summary(rows).select("files", "bytes", "failures", F.round("mean_bytes", 6).alias("mean_bytes"))


def assets_pending(spark: SparkSession, folder: str) -> DataFrame:
    wanted = table(spark, folder, "crawl_results").select(F.explode("assets").alias("asset_url"))
    return files.pending_assets(wanted, table(spark, folder, "asset_rows").where("output_path IS NOT NULL")).select("asset_url")


def images_optimised(spark: SparkSession, folder: str) -> DataFrame:
    """Images that an optimiser would get, and what it saved if each lost a sixth less forty bytes."""
    rows = table(spark, folder, "asset_rows").where("output_path IS NOT NULL").select(F.col("output_path").alias("path"), (F.length("output_path") * 10).alias("bytes"))
    chosen = transforms.images_to_optimise(rows, ("png", "jpg"), 100)
    return transforms.bytes_saved(chosen.select(F.col("bytes").alias("old_bytes"), (F.col("bytes") - F.floor(F.col("bytes") / 6) + 40).alias("new_bytes")))


# --- robots and sitemaps -----------------------------------------------------------------------


def _origins(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "crawl_results").select(F.concat(F.lit("https://"), urls.normalised_address(F.col("url"))["host"]).alias("origin")).where("origin <> 'https://'").distinct()


def _robots(spark: SparkSession, folder: str) -> DataFrame:
    """A robots file for each origin whose name has an even length."""
    text = F.concat(F.lit("User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /v1/ # old\nAllow: /v1/api\nDisallow: /*release*k$\nSITEMAP: "), "origin", F.lit("/map.xml\r\nSitemap: "), "origin", F.lit("/news.xml"))
    return _origins(spark, folder).where(F.length("origin") % 2 == 0).select("origin", text.alias("text"))


def robots_pages(spark: SparkSession, folder: str) -> DataFrame:
    wanted = table(spark, folder, "crawl_results").select(urls.normalize(F.col("url")).alias("url")).where("url LIKE 'https://%'").distinct()
    return rules.robots_allowed(wanted, rules.robots_rules(_robots(spark, folder))).select("url", "robots_allowed")


def sitemap_discover(spark: SparkSession, folder: str) -> DataFrame:
    text = _robots(spark, folder)
    return sitemaps.discover(_origins(spark, folder).join(text, "origin", "left"))


def _sitemap_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Each entry as a document of its own, with a frequency that no sitemap knows for long addresses, and bad priorities for short ones."""
    optional = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"\n <{name}> "), value, F.lit(f"</{name}>"))).otherwise(F.lit(""))
    rows = table(spark, folder, "sitemap_entries").where("loc IS NOT NULL").distinct()
    freq = F.when(F.length("loc") > 60, F.lit("sometimes")).otherwise(F.upper("changefreq"))
    priority = F.when(F.length("loc") < 40, F.lit("1.5")).otherwise(F.col("priority").cast("string"))
    entry = F.concat(F.lit("<url><loc>"), F.replace(F.trim("loc"), F.lit("&"), F.lit("&amp;")), F.lit("</loc>"), optional("lastmod", F.date_format("lastmod", "yyyy-MM-dd")), optional("changefreq", freq), optional("priority", priority), F.lit("</url>"))
    return rows.select(F.trim("loc").alias("source"), F.concat(F.lit('<?xml version="1.0"?><urlset>'), entry, F.lit("<url><priority>0.1</priority></url></urlset>")).alias("xml"))


def sitemap_parse(spark: SparkSession, folder: str) -> DataFrame:
    return sitemaps.parse(_sitemap_documents(spark, folder)).select("loc", F.date_format("lastmod", "yyyy-MM-dd").alias("lastmod"), "changefreq", "priority")


def sitemap_index(spark: SparkSession, folder: str) -> DataFrame:
    """Sitemaps reached through index files: each address's index names those one segment deeper, and itself."""
    deep = table(spark, folder, "sitemap_entries").where("loc IS NOT NULL").select(F.split(F.trim("loc"), "/").alias("p")).where("size(p) >= 5")
    pair = deep.select(F.explode(F.transform(F.sequence(F.lit(3), F.size("p") - 1), lambda k: F.struct(F.array_join(F.slice("p", 1, k), "/").alias("a"), F.array_join(F.slice("p", 1, k + 1), "/").alias("b")))).alias("x")).select("x.a", "x.b").distinct()
    both = pair.unionByName(pair.select(F.col("b").alias("a"), F.col("b")))
    documents = both.groupBy("a").agg(F.sort_array(F.collect_set("b")).alias("b")).select(F.col("a").alias("source"), F.concat(F.lit("<sitemapindex>"), F.array_join(F.transform("b", lambda x: F.concat(F.lit("<sitemap><loc>"), F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>")).alias("xml"))
    roots = deep.select(F.array_join(F.slice("p", 1, 3), "/").alias("source")).distinct()
    return sitemaps.resolve_index(documents, roots)


def sitemap_order(spark: SparkSession, folder: str) -> DataFrame:
    """The first two hundred addresses by priority, each with its place."""
    return sitemaps.load(table(spark, folder, "sitemap_entries").where("loc IS NOT NULL"), max_urls=200)


# --- checkpoints and frontier ------------------------------------------------------------------


def checkpoint_pages_read(spark: SparkSession, folder: str) -> DataFrame:
    """Saved pages written as checkpoint documents and read back; every third document has another version and is left out."""
    rows = table(spark, folder, "checkpoint_pages").where("url IS NOT NULL").distinct()
    entry = F.to_json(F.map_from_arrays(F.array("url"), F.array(F.struct("url", "content_hash", F.date_format("last_scraped", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_scraped"), "status_code", "file_path", "etag"))))
    version = F.when(F.length("url") % 3 == 0, F.lit("2")).otherwise(F.lit("1"))
    text = F.concat(F.lit('{"version": '), version, F.lit(', "config_name": "c", "config_hash": "h", "created_at": "2025-01-01T00:00:00Z", "queue": [["'), "url", F.lit('", null]], "pages": '), entry, F.lit("}"))
    read = checkpoints.pages(checkpoints.read_json(rows.select(F.col("url").alias("name"), text.alias("json"))))
    return read.select("url", "content_hash", F.unix_micros("last_scraped").alias("saved_us"), "status_code", "file_path", "etag", "last_modified")


def queue_order(spark: SparkSession, folder: str) -> DataFrame:
    rows = sitemaps.valid(table(spark, folder, "sitemap_entries")).select(urls.normalize(F.col("loc")).alias("url")).distinct()
    frontier = rows.select("url", (F.length("url") % 5).alias("depth"), F.lit(None).cast("string").alias("parent"))
    return crawl.queue_positions(frontier).select("position", "url")


def frontier_union(spark: SparkSession, folder: str) -> DataFrame:
    """Start addresses, the sitemap and a saved queue as one frontier."""
    queue = table(spark, folder, "crawl_results").where("status_code >= 500").select("url", F.col("final_url").alias("parent_url"))
    starts = table(spark, folder, "documents").select("url").where("doc_id % 10 = 0")
    return crawl.seeds_of(starts, queue, table(spark, folder, "sitemap_entries").select(F.col("loc").alias("url")))


def frontier_routed(spark: SparkSession, folder: str) -> DataFrame:
    """The scan router over the sitemap's pages that the checkpoint does not hold fresh."""
    frontier = sitemaps.load(table(spark, folder, "sitemap_entries")).select("url")
    return crawl.unvisited(table(spark, folder, "crawl_results"), frontier, table(spark, folder, "checkpoint_pages"), _now(), 120).select("result_id", "host")


def pages_ordered(spark: SparkSession, folder: str) -> DataFrame:
    return reports.ordered_pages(table(spark, folder, "checkpoint_pages")).select("url", F.unix_micros("last_scraped").alias("saved_us"))


def pages_counted(spark: SparkSession, folder: str) -> DataFrame:
    return reports.page_count(table(spark, folder, "checkpoint_pages"))


def paths_relative(spark: SparkSession, folder: str) -> DataFrame:
    """Links of each page as relative paths between files, and what kind of link each is."""
    rows = table(spark, folder, "crawl_results").where("url IS NOT NULL").select(F.trim("url").alias("url"), F.explode(F.array_distinct(F.concat("links", "assets"))).alias("link")).distinct()
    here, link = paths.document_path(F.col("url")), F.col("link")
    return rows.select("url", "link", paths.relative_path(here, paths.document_path(link)).alias("to_page"), paths.assets_relative(here, paths.asset_path(link)).alias("to_asset"), paths.is_internal(link, list(LAYOUT.allowed_domains)).alias("internal"), paths.is_asset(link).alias("asset"))


def html_base(spark: SparkSession, folder: str) -> DataFrame:
    """Base addresses of pages, every second one with a base tag put in."""
    rows = table(spark, folder, "crawl_results").where("html <> '' AND final_url IS NOT NULL")
    page = F.when(F.col("result_id") % 2 == 0, F.concat(F.lit("<!-- <base href='/no/'> --><BASE target=x href=\"/base/\"><base href='/late/'>"), "html")).otherwise(F.col("html"))
    return rows.select("result_id", pages.base_url(page, F.trim("final_url")).alias("base"))


# --- reports and network -----------------------------------------------------------------------


def report_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = reports.summary(table(spark, folder, "crawl_results"))
    return rows.select("pages_crawled", "pages_failed", "total_bytes", F.round("seconds", 3).alias("seconds"), F.round("pages_per_second", 9).alias("pages_per_second"), "size")


def report_saved_collisions(spark: SparkSession, folder: str) -> DataFrame:
    return reports.saved_path_collisions(table(spark, folder, "checkpoint_pages"))


def report_preview_totals(spark: SparkSession, folder: str) -> DataFrame:
    return reports.preview_totals(reports.preview(table(spark, folder, "crawl_results")))


def report_progress(spark: SparkSession, folder: str) -> DataFrame:
    return network.progress(table(spark, folder, "crawl_results"), F.col("queue_size"))


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    """The events as answers of servers."""
    status = F.when(F.col("event_type") == "error", 503).when(F.col("event_type") == "signup", 429).otherwise(200)
    return table(spark, folder, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("t"), F.col("event_id").alias("id"), status.alias("status"), (F.col("value") / 100).alias("seconds"))


def network_windows(spark: SparkSession, folder: str) -> DataFrame:
    return network.response_windows(_answers(spark, folder), 100).select("id", F.round("mean_seconds", 11).alias("mean_seconds"))


def network_streaks(spark: SparkSession, folder: str) -> DataFrame:
    return network.fast_streaks(_answers(spark, folder)).select("id", "streak")


def network_queue(spark: SparkSession, folder: str) -> DataFrame:
    moves = table(spark, folder, "events").select(F.col("ts").alias("t"), F.col("event_id").alias("id"), F.when(F.col("event_type").isin("view", "click"), 1).otherwise(-1).alias("change"), (F.col("user_id") + 1).alias("bytes"))
    return network.queue_depths(moves).select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "depth", "queued_bytes", "max_depth", "max_bytes")


def network_lookups(spark: SparkSession, folder: str) -> DataFrame:
    rows = network.lookup_summary(table(spark, folder, "events").select((F.col("event_type") != "error").alias("hit"), F.col("value").alias("ms")))
    return rows.select("lookups", "hits", F.round("hit_percent", 6).alias("hit_percent"), F.round("mean_ms", 6).alias("mean_ms"))


def network_names(spark: SparkSession, folder: str) -> DataFrame:
    """Host names of the sitemap that no saved page of the last ninety days resolves."""
    saved = table(spark, folder, "checkpoint_pages").select(urls.host(F.trim("url")).alias("host"), F.lit("ip").alias("ip"), (F.col("last_scraped") + F.expr("interval 30 days")).alias("expires_at"))
    latest = saved.groupBy("host").agg(F.max("ip").alias("ip"), F.min("expires_at").alias("expires_at"))
    return network.names_to_resolve(table(spark, folder, "crawl_results").select(F.trim("url").alias("url")), latest, _now())


def network_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Fetches of the last sixty days that an answer cache would still give."""
    rows = table(spark, folder, "crawl_results").select("url", "fetched_at", "result_id", "status_code")
    return network.cached_answers(rows, _now(), 60 * 86400).select("url", "result_id")


def state_header_values(spark: SparkSession, folder: str) -> DataFrame:
    wanted = table(spark, folder, "crawl_results").select("url").where("url IS NOT NULL").distinct()
    rows = state.conditional_headers(wanted, table(spark, folder, "checkpoint_pages").select("url", "last_scraped", "etag", "last_modified"))
    return rows.select("url", F.col("headers")["If-None-Match"].alias("etag"), F.col("headers")["If-Modified-Since"].alias("modified"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        links_rewritten, links_graph, links_broken, pages_converted, pages_failed, errors_expanded, frontmatter_heads, files_planned, files_summary, assets_pending, images_optimised,
        robots_pages, sitemap_discover, sitemap_parse, sitemap_index, sitemap_order, checkpoint_pages_read, queue_order, frontier_union, frontier_routed, pages_ordered, pages_counted,
        paths_relative, html_base, report_summary, report_saved_collisions, report_preview_totals, report_progress, network_windows, network_streaks, network_queue, network_lookups, network_names, network_cache, state_header_values,
    ]
    return {f.__name__: f for f in own}
