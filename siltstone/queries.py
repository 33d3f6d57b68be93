"""Queries of the core operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import markdown, pages, paths, urls
from siltstone.operators import crawl, orphans, reports, rules, sitemaps, state
from siltstone.streaming import pipeline


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphans_by_month(table(spark, folder, "crawl_results"), table(spark, folder, "checkpoint_pages"), table(spark, folder, "asset_rows"))


def _address(u: str) -> str:
    """SQL expression of the normalised address of ``u``."""
    head = f"lower(regexp_extract({u}, '^\\s*([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1))"
    tail = f"regexp_extract({u}, '^\\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*?)\\s*(?:#.*)?$', 1)"
    return f"(regexp_replace(regexp_replace({head}, '^(http://[^:]*):(80)?$', '\\1'), '^(https://[^:]*):(443)?$', '\\1') || {tail})"


def _host(u: str) -> str:
    return f"lower(regexp_extract({u}, '^\\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


P4_SQL = f"""
WITH refs AS (
  SELECT 'links' AS ref_kind, CAST(result_id AS VARCHAR) AS ref_key, fetched_at AS t, {_address('link')} AS target
  FROM (SELECT result_id, fetched_at, url, unnest(links) AS link FROM crawl_results)
  WHERE regexp_matches(link, '^\\s*[hH][tT][tT][pP][sS]?://') AND {_host('link')} = {_host('url')} AND fetched_at IS NOT NULL
  UNION
  SELECT 'checkpoint', {_address('url')}, last_scraped, {_address('url')} FROM checkpoint_pages WHERE last_scraped IS NOT NULL AND url IS NOT NULL
), parents AS (
  SELECT {_address('url')} AS target, fetched_at AS time, result_id, status_code FROM crawl_results WHERE fetched_at IS NOT NULL
  UNION SELECT {_address('final_url')}, fetched_at, result_id, status_code FROM crawl_results WHERE fetched_at IS NOT NULL AND final_url IS NOT NULL
), judged AS (
  SELECT r.ref_kind, r.ref_key, r.t, r.target, arg_max(p.status_code, {{'a': p.time, 'b': p.result_id}}) AS status, count(p.result_id) AS n
  FROM refs r LEFT JOIN parents p ON p.target = r.target AND p.time <= r.t + INTERVAL 7 DAY
  GROUP BY ALL
), asset_refs AS (
  SELECT DISTINCT CAST(result_id AS VARCHAR) AS ref_key, fetched_at AS t, target
  FROM (SELECT result_id, fetched_at, unnest(assets) AS target FROM crawl_results)
  WHERE regexp_matches(target, '^[hH][tT][tT][pP][sS]?://') AND fetched_at IS NOT NULL
), saved AS (
  SELECT asset_url, min(saved_at) AS first FROM asset_rows WHERE output_path IS NOT NULL AND saved_at IS NOT NULL GROUP BY asset_url
)
SELECT DISTINCT ref_kind, strftime(t AT TIME ZONE 'UTC', '%Y-%m') AS ref_month, ref_key, target FROM judged WHERE n = 0 OR status IN (404, 410)
UNION
SELECT DISTINCT 'assets', strftime(t AT TIME ZONE 'UTC', '%Y-%m'), ref_key, target
FROM asset_refs LEFT JOIN saved ON asset_url = target WHERE first IS NULL OR first > t + INTERVAL 7 DAY
"""


# --- URL functions -----------------------------------------------------------------------------

_TRIM = "regexp_replace({u}, '^\\s+|\\s+$', '', 'g')"


def _norm(u: str) -> str:
    """SQL of ``urls.normalize``: default port, repeated segments and fragment dropped."""
    t = _TRIM.format(u=u)
    scheme = f"lower(regexp_extract({t}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
    authority = f"regexp_extract({t}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"
    rest = f"regexp_replace({t}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?', '')"
    path = f"regexp_extract({rest}, '^([^?#]*)', 1)"
    query = f"regexp_extract({rest}, '^[^?#]*(\\?[^#]*)', 1)"
    user = f"regexp_extract({authority}, '^(.*@)', 1)"
    host = f"lower(regexp_replace(regexp_replace({authority}, '^.*@', ''), ':[0-9]*$', ''))"
    port = f"regexp_extract({authority}, ':([0-9]*)$', 1)"
    shown = f"CASE WHEN {port} = '' OR ({scheme} = 'http' AND {port} = '80') OR ({scheme} = 'https' AND {port} = '443') OR regexp_matches({port}, '^0+$') THEN '' ELSE ':' || {port} END"
    parts = f"string_split({path}, '/')"
    dedup = f"array_to_string(list_filter({parts}, lambda x, i: x = '' OR i = 1 OR x <> {parts}[i - 1]), '/')"
    return f"CASE WHEN {t} <> '' THEN (CASE WHEN {scheme} = '' THEN '' ELSE {scheme} || ':' END) || (CASE WHEN {authority} = '' THEN '' ELSE '//' || {user} || {host} || {shown} END) || {dedup} || {query} END"


def url_normalize(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "crawl_results").select("url").unionByName(table(spark, folder, "sitemap_entries").select(F.col("loc").alias("url")))
    return rows.where("url IS NOT NULL").distinct().select("url", urls.normalize(F.col("url")).alias("normal"))


def url_links(spark: SparkSession, folder: str) -> DataFrame:
    links = table(spark, folder, "crawl_results").select(F.explode("links").alias("link")).distinct()
    return links.select(
        "link", urls.is_safe_scheme(F.col("link")).alias("safe"), urls.host(F.col("link")).alias("host"), urls.strip_query(F.col("link")).alias("bare"), urls.origin(F.col("link")).alias("origin")
    )


def url_parts(spark: SparkSession, folder: str) -> DataFrame:
    u = F.col("url")
    return table(spark, folder, "documents").where("url IS NOT NULL").select("doc_id", urls.scheme(u).alias("scheme"), urls.host(u).alias("host"), urls.path(u).alias("path"), paths.document_path(u).alias("file"))


# --- rules -------------------------------------------------------------------------------------

RULES = rules.Rules(
    allowed_domains=("example",),
    include=(rules.PathPattern("/v1/"), rules.PathPattern("/guide*", "glob"), rules.PathPattern("/(?:api|faq|howto)/", "regex")),
    exclude=(rules.PathPattern(r".*/private-", "regex"),),
)
_RULES_SQL = "regexp_matches({h}, '(^|\\.)example$') AND NOT regexp_matches({p}, '^.*/private-') AND (starts_with({p}, '/v1/') OR starts_with({p}, '/guide') OR regexp_matches({p}, '^/(?:api|faq|howto)/'))"


def rules_follow(spark: SparkSession, folder: str) -> DataFrame:
    links = table(spark, folder, "crawl_results").select(F.explode("links").alias("link")).distinct()
    return links.select("link", rules.follow(F.col("link"), RULES).alias("follow"))


def rules_status(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("status_code")
    return table(spark, folder, "crawl_results").select(
        "result_id", rules.is_html(F.col("content_type")).alias("is_html"), rules.is_retryable(s).alias("retry"), rules.status_class(s).alias("class"), rules.is_too_large(F.octet_length("html").cast("string"), 0.005).alias("large")
    )


# --- html --------------------------------------------------------------------------------------

_RAW_SQL = "'(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<noscript\\b[^>]*>.*?</noscript\\s*>|<template\\b[^>]*>.*?</template\\s*>'"
_BODY_SQL = f"regexp_replace(coalesce(html, ''), {_RAW_SQL}, '', 'g')"


def html_title(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "crawl_results").where("html IS NOT NULL").select("result_id", pages.title(F.col("html")).alias("title"), pages.content_hash(F.col("html")).alias("hash"), pages.estimated_size(F.col("html")).alias("queued"))


def html_quality(spark: SparkSession, folder: str) -> DataFrame:
    rows = pages.with_quality(table(spark, folder, "crawl_results").select("result_id", "html"))
    return rows.select("result_id", "q.*", pages.needs_js(F.col("q")).alias("needs_js"), pages.quality_points(F.col("q")).alias("points"))


_TAG_SQL = "'<[a-zA-Z](?:[^>\"'']|\"[^\"]*\"|''[^'']*'')*>'"
_ANY_TAG_SQL = "'<[a-zA-Z/!?](?:[^>\"'']|\"[^\"]*\"|''[^'']*'')*>'"


def _tags(names: str) -> str:
    """SQL: start tags with one of the names."""
    return f"list_filter(tags, lambda t: list_contains({names.split()!r}, lower(regexp_extract(t, '^<([a-zA-Z0-9-]+)', 1))))"


def _some_tag(test: str) -> str:
    """SQL: is there a start tag that fits the test?"""
    return f"len(list_filter(tags, lambda t: {test})) > 0"


#: A tag without its quoted values, and a tag with all its quotes double.
_BARE = "regexp_replace(lower(t), '\"[^\"]*\"|''[^'']*''', '\"\"', 'g')"
_QUOTED = "replace(lower(t), '''', '\"')"
_NOTICES = ("%javascript%required%", "%enable%javascript%", "%javascript%disabled%", "%browser%not%support%", "%please%enable%js%")
QUALITY_SQL = f"""
WITH b AS (SELECT result_id, coalesce(html, '') AS page, {_BODY_SQL} AS body FROM crawl_results),
t AS (SELECT *, regexp_extract_all(body, {_TAG_SQL}) AS tags FROM b), q AS (
  SELECT result_id,
    CAST(length(trim(regexp_replace(regexp_replace(body, {_ANY_TAG_SQL}, ' ', 'g'), '\\s+', ' ', 'g'))) AS INTEGER) AS text_length,
    CAST(len(list_filter({_tags('a')}, lambda t: regexp_matches({_BARE}, '\\shref[\\s=>]'))) AS INTEGER) AS link_count,
    CAST(len({_tags('h1 h2 h3 h4 h5 h6')}) AS INTEGER) AS heading_count,
    CAST(len({_tags('p')}) AS INTEGER) AS paragraph_count,
    len({_tags('main')}) > 0 OR {_some_tag("contains(" + _QUOTED + ", ' role=\"main\"')")} AS has_main_content,
    len({_tags('article')}) > 0 AS has_article,
    len(list_filter(['loading', 'please wait', 'spinner', 'skeleton', 'initializing', 'fetching'], lambda w: contains(lower(substring(page, 1, 5000)), w))) > 0 AS has_loading_indicators,
    len(list_filter(string_split(lower(page), '<noscript')[2:], lambda s: len(list_filter(string_split(split_part(s, '</noscript', 1), chr(10)), lambda l: {' OR '.join(f"l LIKE '{n}'" for n in _NOTICES)})) > 0)) > 0 AS has_noscript_warning,
    {_some_tag("contains(" + _QUOTED + ", ' id=\"root\"') OR contains(" + _QUOTED + ", ' id=\"__next\"') OR regexp_matches(" + _BARE + ", '\\sid=(root|__next)[\\s>]|\\sdata-reactroot[\\s=/>]')")} AS has_react_root,
    {_some_tag("regexp_matches(" + _BARE + ", '\\sdata-v-app[\\s=/>]')")} AS has_vue_app,
    {_some_tag("regexp_matches(" + _BARE + ", '\\s(ng-version|_ngcontent-)[\\s=/>]')")} AS has_angular_app
  FROM t)
SELECT *, has_noscript_warning OR (has_loading_indicators AND text_length < 500) OR ((has_react_root OR has_vue_app OR has_angular_app) AND text_length < 300 AND paragraph_count < 2)
    OR (text_length < 100 AND link_count < 3 AND heading_count = 0) AS needs_js,
  CAST(CASE WHEN text_length >= 2000 THEN 40 WHEN text_length >= 500 THEN 30 WHEN text_length >= 100 THEN 10 ELSE 0 END
    + CASE WHEN has_main_content OR has_article THEN 15 ELSE 0 END
    + CASE WHEN heading_count >= 3 THEN 15 WHEN heading_count >= 1 THEN 10 ELSE 0 END
    + CASE WHEN paragraph_count >= 5 THEN 15 WHEN paragraph_count >= 2 THEN 10 ELSE 0 END
    + CASE WHEN link_count >= 5 THEN 15 WHEN link_count >= 2 THEN 10 ELSE 0 END AS INTEGER) AS points
FROM q
"""


def html_links(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "crawl_results").where("html <> ''").select("result_id", F.explode(pages.hrefs(F.col("html"))).alias("href"))
    return rows.groupBy("result_id").agg(F.count("*").alias("anchors"), F.count_distinct("href").alias("targets"), F.count_if(F.col("href").startswith("/")).alias("rooted"))


def html_resolved_links(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct normalised http(s) links of each page, resolved against its final address."""
    rows = table(spark, folder, "crawl_results").where("html <> ''").select("result_id", F.col("final_url").alias("base"), F.explode(F.array_distinct(pages.hrefs(F.col("html")))).alias("href"))
    absolute = rows.where("base IS NOT NULL AND trim(href) <> ''").select("result_id", F.explode(F.array(urls.join(F.trim(F.col("base")), F.col("href")))).alias("u"))
    return absolute.where(urls.is_safe_scheme(F.col("u"))).select("result_id", urls.normalize(F.col("u")).alias("link")).distinct()


def html_assets(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "crawl_results").where("html <> '' AND final_url IS NOT NULL")
    return rows.select("result_id", F.explode(pages.assets(F.col("html"), F.trim(F.col("final_url")))).alias("asset"))


def html_without_scripts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "crawl_results").where("html <> ''").select("result_id", F.sha2(pages.without_scripts(F.col("html")), 256).alias("hash"))


def markdown_clean(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(pages.clean_markdown(F.col("text")), 256).alias("hash"), pages.frontmatter_title(F.col("text")).alias("title"))


# --- crawl and state ---------------------------------------------------------------------------


def _seeds(results: DataFrame) -> DataFrame:
    """The first page of each host as loaded."""
    return results.groupBy(urls.normalised_address(F.col("url"))["host"].alias("host")).agg(F.min(F.struct("result_id", "url")).alias("x")).select(F.col("x.url").alias("url"))


def crawl_depths(spark: SparkSession, folder: str) -> DataFrame:
    results = table(spark, folder, "crawl_results")
    return crawl.crawl(results, _seeds(results), rules.Rules(allowed_domains=("example",), depth_limit=3)).select("url", "depth", "parent")


CRAWL_SQL = f"""
WITH RECURSIVE edges AS (
  SELECT DISTINCT src, dst FROM (SELECT {_norm('url')} AS src, {_norm('link')} AS dst FROM (SELECT url, unnest(links) AS link FROM crawl_results) WHERE regexp_matches(link, '^\\s*[hH][tT][tT][pP][sS]?:'))
  WHERE src IS NOT NULL AND regexp_matches(lower(regexp_extract(dst, '^[a-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '(^|\\.)example$')
), seeds AS (SELECT DISTINCT {_norm('url')} AS url FROM (SELECT arg_min(url, result_id) AS url FROM crawl_results GROUP BY {_host('url')})),
walk AS (SELECT url, 0 AS depth FROM seeds UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = url WHERE depth < 3),
least AS (SELECT url, min(depth) AS depth FROM walk GROUP BY url)
SELECT l.url, CAST(l.depth AS INTEGER) AS depth, CASE WHEN l.depth > 0 THEN (SELECT min(p.url) FROM least p JOIN edges e ON e.src = p.url WHERE e.dst = l.url AND p.depth = l.depth - 1) END AS parent FROM least l
"""


def crawl_routes(spark: SparkSession, folder: str) -> DataFrame:
    return crawl.routes(table(spark, folder, "crawl_results"))


ROUTES_SQL = f"""
WITH judged AS (SELECT r.result_id, r.fetched_at, {_host('r.url')} AS host, q.needs_js OR q.points < 30 AS weak FROM crawl_results r JOIN ({QUALITY_SQL}) q USING (result_id) WHERE r.html <> ''),
first AS (SELECT host, arg_min({{'a': fetched_at, 'b': result_id}}, {{'a': fetched_at, 'b': result_id}}) AS f FROM judged WHERE weak GROUP BY host)
SELECT result_id, judged.host AS host, CASE WHEN weak OR coalesce({{'a': fetched_at, 'b': result_id}} > f, false) THEN 'js' ELSE 'http' END AS route FROM judged LEFT JOIN first ON first.host = judged.host
"""


def frontier_resume(spark: SparkSession, folder: str) -> DataFrame:
    wanted = sitemaps.load(table(spark, folder, "sitemap_entries")).select("url")
    return crawl.not_checkpointed(wanted, table(spark, folder, "checkpoint_pages"), F.lit("2025-12-01").cast("timestamp"), 120)


def state_upsert(spark: SparkSession, folder: str) -> DataFrame:
    saved = table(spark, folder, "checkpoint_pages").select("url", "last_scraped", "status_code")
    fetched = table(spark, folder, "crawl_results").select("url", F.col("fetched_at").alias("last_scraped"), "status_code")
    return state.upsert(saved, fetched).select("url", F.unix_micros("last_scraped").alias("saved_us"))


def state_stale(spark: SparkSession, folder: str) -> DataFrame:
    wanted = table(spark, folder, "crawl_results").select("url").where("url IS NOT NULL").distinct()
    return state.staleness(wanted, table(spark, folder, "checkpoint_pages"), F.lit("2025-12-01").cast("timestamp"), 90)


def state_headers(spark: SparkSession, folder: str) -> DataFrame:
    wanted = table(spark, folder, "sitemap_entries").select(F.col("loc").alias("url")).where("url IS NOT NULL").distinct()
    rows = state.conditional_headers(wanted, table(spark, folder, "crawl_results").select("url", F.col("fetched_at").alias("last_scraped"), "etag", "last_modified"))
    return rows.select("url", F.size("headers").alias("headers"))


def state_changes(spark: SparkSession, folder: str) -> DataFrame:
    return state.changes(table(spark, folder, "crawl_results"), table(spark, folder, "checkpoint_pages"))


CHANGES_SQL = f"""
WITH now AS (SELECT {_address('url')} AS url, arg_max({{'s': status_code, 'h': content_hash}}, {{'a': fetched_at, 'b': result_id}}) AS x FROM crawl_results WHERE fetched_at IS NOT NULL AND url IS NOT NULL GROUP BY 1),
before AS (SELECT u AS url, h AS old FROM (SELECT {_address('url')} AS u, content_hash AS h, row_number() OVER (PARTITION BY {_address('url')} ORDER BY last_scraped DESC NULLS LAST, content_hash DESC NULLS LAST) AS n FROM checkpoint_pages WHERE url IS NOT NULL) WHERE n = 1)
SELECT now.url AS url, CASE WHEN x.s IN (404, 410) THEN 'gone' WHEN before.url IS NULL THEN 'new' WHEN x.s = 304 OR lower(x.h) IS NOT DISTINCT FROM lower(old) THEN 'unchanged' ELSE 'changed' END AS change
FROM now LEFT JOIN before ON before.url = now.url
"""


# --- reports and sitemaps ----------------------------------------------------------------------


def report_stats(spark: SparkSession, folder: str) -> DataFrame:
    return reports.crawl_stats(table(spark, folder, "crawl_results"))


def report_errors(spark: SparkSession, folder: str) -> DataFrame:
    return reports.error_counts(table(spark, folder, "crawl_results"))


def report_error_examples(spark: SparkSession, folder: str) -> DataFrame:
    return reports.error_examples(table(spark, folder, "crawl_results"))


def report_assets(spark: SparkSession, folder: str) -> DataFrame:
    return reports.asset_summary(table(spark, folder, "crawl_results"))


_ASSET_SQL = "CASE WHEN regexp_matches(lower(u), '\\.(?:png|jpg|jpeg|gif|svg|webp)') THEN 'image' WHEN contains(lower(u), '.css') THEN 'css' WHEN contains(lower(u), '.js') THEN 'javascript' WHEN regexp_matches(lower(u), '\\.(?:woff2?|ttf|eot)') THEN 'font' ELSE 'unknown' END"


def report_hosts(spark: SparkSession, folder: str) -> DataFrame:
    return reports.host_summary(table(spark, folder, "crawl_results"))


def report_collisions(spark: SparkSession, folder: str) -> DataFrame:
    """Paths that several pages would share if only the first folder counted."""
    rows = table(spark, folder, "crawl_results").select(F.regexp_replace("url", r"^(https?://[^/]+/[^/]+/).*$", "$1").alias("url"))
    return reports.path_collisions(rows)


def _file(u: str) -> str:
    p = f"regexp_replace(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '(?:^|/)\\.\\.?(/|$)', '\\1', 'g')"
    bare = f"regexp_replace({p}, '^/+|/+$', '', 'g')"
    return f"CASE WHEN {bare} = '' THEN 'docs/index.md' WHEN ends_with({p}, '/') THEN 'docs/' || {bare} || '/index.md' ELSE 'docs/' || {bare} || '.md' END"


def report_preview(spark: SparkSession, folder: str) -> DataFrame:
    return reports.preview(table(spark, folder, "crawl_results"))


_TITLE_SQL = "coalesce(nullif(trim(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')), ''), 'Untitled')"


def report_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return reports.status_rollup(table(spark, folder, "crawl_results"))


def sitemap_load(spark: SparkSession, folder: str) -> DataFrame:
    return sitemaps.load(table(spark, folder, "sitemap_entries"))


def sitemap_freshness(spark: SparkSession, folder: str) -> DataFrame:
    return sitemaps.freshness(table(spark, folder, "sitemap_entries"), table(spark, folder, "crawl_results"))


def assets_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct http(s) assets that no page's saving has written."""
    found = table(spark, folder, "crawl_results").select(F.explode("assets").alias("asset_url")).where(urls.is_safe_scheme(F.col("asset_url"))).distinct()
    saved = table(spark, folder, "asset_rows").where("output_path IS NOT NULL").select("asset_url").distinct()
    return found.join(saved, "asset_url", "left_anti").select("asset_url", paths.asset_path(F.col("asset_url")).alias("path"))


def markdown_convert(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown of all pages with the navigation parts removed."""
    rows = markdown.convert(table(spark, folder, "crawl_results"), remove=("nav", "footer", "header", "aside"))
    return rows.select("result_id", F.length("markdown").alias("characters"), F.size(markdown.link_targets(F.col("markdown"))).alias("links"))


def markdown_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links and code blocks of the Markdown documents."""
    text = F.col("text")
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.size(markdown.link_targets(text)).alias("links"), F.size(markdown.image_targets(text)).alias("images"), F.array_join(markdown.code_languages(text), ",").alias("languages"))


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a stream; the pattern lets the table be one file or a folder of files."""
    return spark.readStream.schema(table(spark, folder, "events").schema).parquet(f"{folder}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    rows = pipeline.run_to_end(pipeline.tumbling_counts(_events(spark, folder)))
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "events", F.round("total", 4).alias("total"))


def stream_sliding(spark: SparkSession, folder: str) -> DataFrame:
    return pipeline.run_to_end(pipeline.sliding_counts(_events(spark, folder))).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "events")


def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return pipeline.run_to_end(pipeline.sessions(_events(spark, folder))).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("events").alias("longest"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        p4_found, url_normalize, url_links, url_parts, rules_follow, rules_status, html_title, html_quality, html_links, html_resolved_links, html_assets, html_without_scripts,
        markdown_clean, crawl_depths, crawl_routes, frontier_resume, state_upsert, state_stale, state_headers, state_changes, report_stats, report_errors,
        report_error_examples, report_assets, report_hosts, report_collisions, report_preview, report_rollup, sitemap_load, sitemap_freshness, assets_missing,
        markdown_convert, markdown_links, stream_tumbling, stream_sliding, stream_sessions,
    ]
    return {f.__name__: f for f in own}


def _join(base: str, ref: str) -> str:
    """SQL of ``urls.join`` for references without dot segments."""
    head = f"regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
    path = f"regexp_extract({base}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    folder = f"coalesce(nullif(regexp_replace({path}, '[^/]*$', ''), ''), '/')"
    return (
        f"CASE WHEN {ref} = '' THEN {base} WHEN regexp_matches({ref}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {ref} WHEN starts_with({ref}, '//') THEN regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) || ':' || {ref}"
        f" WHEN starts_with({ref}, '/') THEN {head} || {ref} WHEN starts_with({ref}, '#') THEN regexp_replace({base}, '#.*$', '') || {ref} WHEN starts_with({ref}, '?') THEN {head} || {path} || {ref} ELSE {head} || {folder} || {ref} END"
    )


_HREFS = f"""SELECT result_id, trim(final_url) AS base, trim(regexp_replace(regexp_replace(unnest(regexp_extract_all({_BODY_SQL}, '(?is)<a\\s[^>]*?\\bhref\\s*=\\s*(?:"[^"]*"|''[^'']*''|[^\\s>]*)')), '(?is)^<a\\s[^>]*?\\bhref\\s*=\\s*', ''), '^["'']|["'']$', '', 'g')) AS href
    FROM crawl_results WHERE html <> '' AND final_url IS NOT NULL"""


def _attribute(name: str) -> str:
    """SQL: value of a tag's attribute in any notation, its first."""
    x = f"regexp_extract(t, '(?i)[\\s\"''/]{name}\\s*=\\s*(\"[^\"]*\"|''[^'']*''|[^\\s\"''>]+)', 1)"
    return f"trim(CASE WHEN starts_with({x}, '\"') OR starts_with({x}, '''') THEN substr({x}, 2, length({x}) - 2) ELSE {x} END)"


def oracle_sql() -> dict[str, str]:
    address, host = _address, _host
    return {
        "p4_found": P4_SQL,
        "url_normalize": f"SELECT DISTINCT url, {_norm('url')} AS normal FROM (SELECT url FROM crawl_results UNION ALL SELECT loc FROM sitemap_entries) WHERE url IS NOT NULL",
        "url_links": f"""SELECT DISTINCT link, regexp_matches(trim(link), '^[hH][tT][tT][pP][sS]?:') AS safe,
            lower(regexp_replace(regexp_replace(regexp_extract(link, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')) AS host,
            regexp_replace(link, '\\?[^#]*', '', 'g') AS bare,
            lower(regexp_extract(link, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || '://' || lower(regexp_extract(link, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)) AS origin
            FROM (SELECT unnest(links) AS link FROM crawl_results)""",
        "url_parts": f"SELECT doc_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, {host('url')} AS host, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS path, {_file('url')} AS file FROM documents WHERE url IS NOT NULL",
        "rules_follow": "SELECT link, " + _RULES_SQL.format(h="h", p="p") + f""" AS follow FROM (SELECT DISTINCT link,
            lower(regexp_replace(regexp_replace(regexp_extract(link, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')) AS h,
            regexp_extract(link, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS p FROM (SELECT unnest(links) AS link FROM crawl_results))""",
        "rules_status": """SELECT result_id, coalesce(contains(lower(content_type), 'text/html'), false) AS is_html, coalesce(status_code IN (429, 500, 502, 503, 504), false) AS retry,
            CASE WHEN status_code = 304 THEN 'not_modified' WHEN status_code >= 400 THEN 'failed' WHEN status_code IS NULL THEN 'unknown' ELSE 'ok' END AS class,
            coalesce(octet_length(encode(html)) / 1048576.0 > 0.005, false) AS large FROM crawl_results""",
        "html_title": f"SELECT result_id, {_TITLE_SQL} AS title, sha256(html) AS hash, CAST(floor(octet_length(encode(html)) * 1.05) AS BIGINT) AS queued FROM crawl_results WHERE html IS NOT NULL",
        "html_quality": QUALITY_SQL,
        "html_links": f"""SELECT result_id, count(*) AS anchors, count(DISTINCT href) AS targets, count(*) FILTER (starts_with(href, '/')) AS rooted FROM (
            SELECT result_id, regexp_replace(regexp_replace(unnest(regexp_extract_all({_BODY_SQL}, '(?is)<a\\s[^>]*?\\bhref\\s*=\\s*(?:"[^"]*"|''[^'']*''|[^\\s>]*)')), '(?is)^<a\\s[^>]*?\\bhref\\s*=\\s*', ''), '^["'']|["'']$', '', 'g') AS href
            FROM crawl_results WHERE html <> '') GROUP BY result_id""",
        "html_resolved_links": f"SELECT DISTINCT result_id, {_norm('u')} AS link FROM (SELECT result_id, {_join('base', 'href')} AS u FROM ({_HREFS}) WHERE href <> '') WHERE regexp_matches(u, '^[hH][tT][tT][pP][sS]?:')",
        "html_assets": f"""WITH t AS (SELECT result_id, trim(final_url) AS base, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?i)<(?:img|script|link)\\s(?:[^>"'']|"[^"]*"|''[^'']*'')*>')) AS t FROM crawl_results WHERE html <> '' AND final_url IS NOT NULL),
            v AS (SELECT result_id, base, lower(regexp_extract(t, '^<([a-zA-Z]+)', 1)) AS tag, {_attribute('src')} AS src, {_attribute('href')} AS href, {_attribute('rel')} AS rel FROM t),
            a AS (SELECT result_id, base, CASE WHEN tag = 'link' THEN href ELSE src END AS src FROM v WHERE tag <> 'link' OR lower(rel) = 'stylesheet')
            SELECT DISTINCT result_id, {_join('base', 'src')} AS asset FROM a WHERE src <> ''""",
        "html_without_scripts": "SELECT result_id, sha256(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<noscript\\b[^>]*>.*?</noscript\\s*>', '', 'g')) AS hash FROM crawl_results WHERE html <> ''",
        "markdown_clean": r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(l, '\n{3,}', chr(10) || chr(10), 'g'), '\s+$', '') || chr(10)) AS hash,
            nullif(regexp_replace(trim(regexp_extract(regexp_extract(replace(text, chr(13) || chr(10), chr(10)), '(?s)^---\n(.*?)\n---\n', 1), '(?m)^title:[ ]*(.*)$', 1)), '^["'']|["'']$', '', 'g'), '') AS title
            FROM (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '[ \t]+$', '') AS l FROM documents WHERE text IS NOT NULL)""",
        "crawl_depths": CRAWL_SQL,
        "crawl_routes": ROUTES_SQL,
        "frontier_resume": f"""SELECT DISTINCT {_norm('loc')} AS url FROM sitemap_entries WHERE loc IS NOT NULL AND trim(loc) <> '' AND {_norm('loc')} NOT IN
            (SELECT {_norm('url')} FROM checkpoint_pages WHERE url IS NOT NULL AND last_scraped >= TIMESTAMPTZ '2025-12-01 00:00:00+00' - INTERVAL 120 DAY)""",
        "state_upsert": "SELECT url, epoch_us(max(t)) AS saved_us FROM (SELECT url, last_scraped AS t FROM checkpoint_pages UNION ALL SELECT url, fetched_at FROM crawl_results) WHERE url IS NOT NULL GROUP BY url",
        "state_stale": """SELECT w.url AS url, CASE WHEN s.url IS NULL THEN true WHEN t IS NULL THEN true ELSE (epoch_us(TIMESTAMPTZ '2025-12-01 00:00:00+00') - epoch_us(t)) / 86400000000.0 > 90 END AS fetch
            FROM (SELECT DISTINCT url FROM crawl_results WHERE url IS NOT NULL) w LEFT JOIN (SELECT url, max(last_scraped) AS t FROM checkpoint_pages GROUP BY url) s ON s.url = w.url""",
        "state_headers": """SELECT w.url AS url, CAST((CASE WHEN coalesce(etag, '') <> '' THEN 1 ELSE 0 END) + (CASE WHEN coalesce(last_modified, '') <> '' THEN 1 ELSE 0 END) AS INTEGER) AS headers
            FROM (SELECT DISTINCT loc AS url FROM sitemap_entries WHERE loc IS NOT NULL) w LEFT JOIN (
            SELECT url, etag, last_modified FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC NULLS LAST, etag DESC NULLS LAST, last_modified DESC NULLS LAST) AS n FROM crawl_results) WHERE n = 1) s ON s.url = w.url""",
        "state_changes": CHANGES_SQL,
        "report_stats": """SELECT count(*) FILTER (status_code < 400 AND status_code <> 304) AS pages_crawled, count(*) FILTER (status_code >= 400) AS pages_failed, count(*) FILTER (status_code = 304) AS not_modified,
            CAST(coalesce(sum(octet_length(encode(html))), 0) AS BIGINT) AS total_bytes, CAST(coalesce(sum(len(assets)), 0) AS BIGINT) AS assets_found, coalesce(max(queue_size), 0) AS max_queue FROM crawl_results""",
        "report_errors": "SELECT 'HTTP ' || status_code AS type, count(*) AS errors FROM crawl_results WHERE status_code >= 400 GROUP BY 1",
        "report_error_examples": """SELECT 'HTTP ' || status_code AS type, count(*) AS errors, array_to_string(list_slice(list(substring(url, 1, 80) ORDER BY result_id), 1, 3), chr(10)) AS examples, greatest(0, count(*) - 3) AS more
            FROM crawl_results WHERE status_code >= 400 GROUP BY 1""",
        "report_assets": f"SELECT {_ASSET_SQL} AS asset_type, count(DISTINCT u) AS assets, count(*) AS uses FROM (SELECT unnest(assets) AS u FROM crawl_results) GROUP BY 1",
        "report_hosts": f"""SELECT {host('url')} AS host, count(*) AS fetches, count(DISTINCT {address('url')}) AS pages, CAST(coalesce(sum(octet_length(encode(html))), 0) AS BIGINT) AS bytes,
            round(sum(octet_length(encode(html))) / CAST(count(html) AS DOUBLE), 3) AS mean_bytes, count(*) FILTER (status_code >= 400) AS failed FROM crawl_results GROUP BY 1""",
        "report_collisions": f"SELECT {_file('url')} AS path, count(*) AS pages FROM (SELECT DISTINCT {address('url')} AS url FROM (SELECT regexp_replace(url, '^(https?://[^/]+/[^/]+/).*$', '\\1') AS url FROM crawl_results) WHERE url IS NOT NULL) GROUP BY 1 HAVING count(*) > 1",
        "report_preview": f"SELECT result_id, url, {_file('url')} AS output_path, {_TITLE_SQL} AS title, CAST(coalesce(len(assets), 0) AS INTEGER) AS asset_count FROM crawl_results WHERE html <> ''",
        "report_rollup": """SELECT strftime(fetched_at AT TIME ZONE 'UTC', '%Y-%m') AS month, CAST(status_code AS VARCHAR) AS status, count(*) AS fetches,
            CAST(grouping(strftime(fetched_at AT TIME ZONE 'UTC', '%Y-%m'), CAST(status_code AS VARCHAR)) AS BIGINT) AS level FROM crawl_results
            GROUP BY ROLLUP (strftime(fetched_at AT TIME ZONE 'UTC', '%Y-%m'), CAST(status_code AS VARCHAR))""",
        "sitemap_load": f"""SELECT url, p AS priority, row_number() OVER (ORDER BY p DESC, pos, loc) - 1 AS place FROM (
            SELECT *, row_number() OVER (PARTITION BY url ORDER BY p DESC, pos, loc) AS n FROM (
            SELECT {_norm('trim(loc)')} AS url, trim(loc) AS loc, loc AS pos, coalesce(CASE WHEN priority BETWEEN 0 AND 1 THEN priority END, 0.5) AS p FROM sitemap_entries WHERE trim(loc) <> '')) WHERE n = 1""",
        "sitemap_freshness": f"""SELECT l.url AS url, CASE WHEN f.url IS NULL OR t IS NULL THEN 'missing' WHEN m > t THEN 'outdated' ELSE 'current' END AS state
            FROM (SELECT {address('trim(loc)')} AS url, max(lastmod) AS m FROM sitemap_entries WHERE loc IS NOT NULL AND trim(loc) <> '' GROUP BY 1) l
            LEFT JOIN (SELECT {address('url')} AS url, max(fetched_at) AS t FROM crawl_results GROUP BY 1) f ON f.url = l.url""",
        "markdown_links": r"""SELECT doc_id, CAST(len(list_filter(regexp_extract_all(text, '!?\[[^\]]+\]\([^)]+\)'), lambda x: NOT starts_with(x, '!'))) AS INTEGER) AS links, CAST(len(regexp_extract_all(text, '!\[[^\]]*\]\([^)]+\)')) AS INTEGER) AS images,
            array_to_string(regexp_extract_all(text, '(?ms)^```(\w+)\n.*?^```', 1), ',') AS languages FROM documents WHERE text IS NOT NULL""",
        "stream_tumbling": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
        "stream_sliding": "SELECT strftime(time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(CAST(15 * k AS INTEGER)), '%Y-%m-%d %H:%M') AS start, count(*) AS events FROM events, range(4) r(k) WHERE ts IS NOT NULL GROUP BY 1",
        "stream_sessions": """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL),
            s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2)
            SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1""",
        "assets_missing": """SELECT u AS asset_url, 'assets/' || regexp_replace(regexp_replace(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '(?:^|/)\\.\\.?(/|$)', '\\1', 'g'), '^/+', '') AS path
            FROM (SELECT DISTINCT unnest(assets) AS u FROM crawl_results) WHERE regexp_matches(trim(u), '^[hH][tT][tT][pP][sS]?:') AND u NOT IN (SELECT asset_url FROM asset_rows WHERE output_path IS NOT NULL AND asset_url IS NOT NULL)""",
    }
