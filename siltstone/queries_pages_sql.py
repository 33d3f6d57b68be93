"""SQL that checks the queries of ``queries_pages``."""

from __future__ import annotations

from siltstone.queries import _TITLE_SQL, _address, _file, _host, _norm


def _path(u: str) -> str:
    return f"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def _safe_path(u: str) -> str:
    """Path without parent steps."""
    return rf"regexp_replace({_path(u)}, '(?:^|/)\.\.?(/|$)', '\1', 'g')"


def _document(u: str, prefix: str) -> str:
    p = f"CASE WHEN starts_with({_safe_path(u)}, '{prefix}') THEN substr({_safe_path(u)}, {len(prefix) + 1}) ELSE {_safe_path(u)} END"
    bare = f"trim({p}, '/')"
    return f"(CASE WHEN {bare} = '' THEN 'docs/index.md' WHEN ends_with({p}, '/') THEN 'docs/' || {bare} || '/index.md' ELSE 'docs/' || {bare} || '.md' END)"


def _asset(u: str, prefix: str) -> str:
    p = f"CASE WHEN starts_with({_safe_path(u)}, '{prefix}') THEN substr({_safe_path(u)}, {len(prefix) + 1}) ELSE {_safe_path(u)} END"
    return f"('assets/' || ltrim({p}, '/'))"


def _relative(source: str, target: str) -> str:
    """Relative path by the longest common list of folders."""
    here, there = f"string_split({source}, '/')[1:-2]", f"string_split({target}, '/')"
    common = f"coalesce(list_max(list_filter(range(0, len({here}) + 1), lambda k: k < len({there}) AND {here}[1:k] = {there}[1:k])), 0)"
    return f"(repeat('../', CAST(len({here}) - {common} AS INTEGER)) || array_to_string({there}[{common} + 1:], '/'))"


_DOMAINS = "('docs.ivedfeld.example', 'wiltane-11.example', 'learn.marlume-12.example')"
_ENDINGS = "png jpg jpeg gif svg webp ico bmp css scss sass less js mjs ts woff woff2 ttf eot otf map".split()
_AUTHORITY = "regexp_replace(lower(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), '^www\\.', '')"
_ENDS = f"list_contains({_ENDINGS!r}, regexp_extract(lower({_path('{u}')}), '\\.([a-z0-9]+)$', 1))"


def _internal(u: str, prefix: str = "") -> str:
    rooted = f"starts_with({u}, '{prefix}')" if prefix else "true"
    return f"(CASE WHEN starts_with({u}, '/') AND NOT starts_with({u}, '//') THEN {rooted} ELSE {_AUTHORITY.format(u=u)} IN {_DOMAINS} END)"


_TEXTS = """(SELECT result_id, trim(url) AS url, array_to_string(list_concat(list_concat(list_transform(coalesce(links, []), lambda x: '[see](' || x || ') and'),
  list_transform(coalesce(assets, []), lambda x: '![see](' || x || ') and')), ['![up](../x.png) ![own](img/a.png) [mail](mailto:a@b.example) [in](/v1/guide/)']), chr(10)) AS text FROM crawl_results WHERE url IS NOT NULL)"""

# Links are taken out one by one, mapped as rows and put back by their number.
_PAGE_NEW = f"""CASE WHEN regexp_matches(t, '^(https?://|/)') AND {_internal('t', '/v1')} THEN {_relative(_document('url', '/v1'), _document('t', '/v1'))} ELSE t END"""
_WHOLE = "(CASE WHEN regexp_matches(t, '^(https?:)?//') OR starts_with(t, '/') THEN t ELSE 'https://docs.ivedfeld.example/' || regexp_replace(t, '^(\\./)+', '') END)"
_OTHER = "(regexp_matches(lower(t), '^[a-z][a-z0-9+.-]*:') AND NOT regexp_matches(lower(t), '^https?:'))"
_IMAGE_NEW = f"""CASE WHEN NOT starts_with(t, '../') AND NOT {_OTHER} AND {_ENDS.format(u='t')} THEN {_relative(_document('url', '/v1'), _asset(_WHOLE, '/v1'))} ELSE t END"""
REWRITTEN = f"""
WITH m AS MATERIALIZED (SELECT result_id, url, text, regexp_extract_all(text, '!?\\[[^\\]]*\\]\\([^)]+\\)') AS links, string_split_regex(text, '!?\\[[^\\]]*\\]\\([^)]+\\)') AS between FROM {_TEXTS}),
l AS MATERIALIZED (SELECT result_id, url, n, link, regexp_extract(link, '\\(([^)]*)\\)$', 1) AS t FROM (SELECT result_id, url, unnest(links) AS link, unnest(range(1, len(links) + 1)) AS n FROM m)),
mapped AS (SELECT result_id, list(regexp_extract(link, '^(.*\\]\\()[^)]*\\)$', 1) || CASE WHEN starts_with(link, '!') THEN {_IMAGE_NEW} ELSE {_PAGE_NEW} END || ')' ORDER BY n) AS links FROM l GROUP BY 1)
SELECT m.result_id, array_to_string(list_transform(range(1, len(between) + 1), lambda i: between[i] || coalesce(mapped.links[i], '')), '') AS text FROM m JOIN mapped USING (result_id)
"""

GRAPH = f"""
WITH last AS MATERIALIZED (SELECT url, arg_max(text, result_id) AS text FROM {_TEXTS} GROUP BY url),
l AS (SELECT DISTINCT url, t FROM (SELECT url, regexp_extract(unnest(regexp_extract_all(text, '!?\\[[^\\]]*\\]\\([^)]+\\)')), '^[^!].*\\(([^)]*)\\)$', 1) AS t FROM last) WHERE regexp_matches(t, '^(https?://|/)')),
own AS (SELECT url, {_document('t', '/v1')} AS file FROM l WHERE {_internal('t', '/v1')}), files AS (SELECT DISTINCT {_document('url', '/v1')} AS file FROM last)
SELECT url, count(*) AS links, count(files.file) AS saved FROM own LEFT JOIN files USING (file) GROUP BY url
"""

BROKEN = """
WITH f AS MATERIALIZED (SELECT DISTINCT file_path AS path FROM checkpoint_pages WHERE file_path IS NOT NULL),
l AS (SELECT path, unnest([regexp_replace(path, '\\.md$', ''), regexp_replace(path, 'e', 'i', 'g')]) AS target FROM f),
c AS (SELECT path, target, trim(regexp_replace(regexp_replace(target, '[?#].*$', ''), '^(\\./)+', ''), '/') AS bare FROM l WHERE NOT regexp_matches(target, '^([a-zA-Z][\\w+.-]*:|//|#)') AND target <> '' AND NOT contains(target, ')'))
SELECT DISTINCT path, target FROM c WHERE bare NOT IN (SELECT path FROM f) AND bare || '/index.md' NOT IN (SELECT path FROM f) AND bare || '.md' NOT IN (SELECT path FROM f)
"""


def _category(limit: float) -> str:
    return f"CASE WHEN status_code >= 400 THEN 'http' WHEN content_type IS NULL OR NOT contains(lower(content_type), 'text/html') THEN 'content_type' WHEN octet_length(encode(html)) > {limit} * 1048576 THEN 'size' WHEN coalesce(html, '') = '' THEN 'empty' END"


CONVERTED = f"""
SELECT result_id, {_document('trim(url)', '/v1')} AS path, CASE WHEN html <> '' THEN {_TITLE_SQL} END AS title, {_category(10)} AS category, CASE WHEN status_code >= 400 THEN 'HTTP ' || status_code END AS error,
  CASE WHEN {_category(10)} IS NULL THEN trim(url) END AS head_url, CASE WHEN {_category(10)} IS NULL THEN true END AS written
FROM crawl_results WHERE status_code IS NULL OR status_code <> 304
"""
FAILED = f"SELECT category, CASE WHEN category = 'http' THEN 'HTTP ' || status_code ELSE category END AS type, count(*) AS errors FROM (SELECT {_category(0.005)} AS category, status_code FROM crawl_results WHERE status_code IS NULL OR status_code <> 304) WHERE category IS NOT NULL GROUP BY 1, 2"

_SIMPLE = "regexp_matches({t}, '^[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}} ._/()-]*$') AND NOT regexp_matches(lower({t}), '^(true|false|yes|no|null|on|off|[0-9.]+)$') AND NOT ends_with({t}, ' ')"


def _yaml(t: str) -> str:
    return f"CASE WHEN {_SIMPLE.format(t=t)} THEN {t} ELSE '''' || replace({t}, '''', '''''') || '''' END"


_ROBOTS = "(SELECT origin FROM (SELECT DISTINCT 'https://' || " + _host("url") + " AS origin FROM crawl_results WHERE url IS NOT NULL) WHERE origin <> 'https://')"
_PQ = "regexp_replace(url, '^https://[^/?#]*', '')"
ROBOTS = f"""
SELECT url, CASE WHEN length(o) % 2 = 1 THEN true WHEN starts_with(p, '/v1/api') THEN true WHEN p LIKE '/%release%k' THEN false WHEN starts_with(p, '/v1/') THEN false ELSE true END AS robots_allowed
FROM (SELECT url, lower(regexp_extract(url, '^(https://[^/?#]*)', 1)) AS o, {_PQ} AS p FROM (SELECT DISTINCT {_norm('url')} AS url FROM crawl_results) WHERE url LIKE 'https://%')
"""

_DEEP = "(SELECT string_split(trim(loc), '/') AS p FROM sitemap_entries WHERE loc IS NOT NULL)"
INDEX = f"""
WITH d AS (SELECT p FROM {_DEEP} WHERE len(p) >= 5), steps AS (SELECT array_to_string(p[1:k], '/') AS source, k - 3 AS depth FROM (SELECT p, unnest(range(3, len(p) + 1)) AS k FROM d) WHERE array_to_string(p[1:k], '/') NOT LIKE '%/' OR true)
SELECT source, CAST(min(depth) AS INTEGER) AS depth FROM steps GROUP BY source
"""

ORDER = f"""
WITH e AS (SELECT trim(loc) AS loc, loc AS pos, coalesce(CASE WHEN priority BETWEEN 0 AND 1 THEN priority END, 0.5) AS p FROM sitemap_entries WHERE trim(loc) <> ''),
top AS (SELECT * FROM e ORDER BY p DESC, pos, loc LIMIT 200),
best AS (SELECT {_norm('loc')} AS url, p, pos, loc, row_number() OVER (PARTITION BY {_norm('loc')} ORDER BY p DESC, pos, loc) AS n FROM top)
SELECT url, p AS priority, row_number() OVER (ORDER BY p DESC, pos, loc) - 1 AS place FROM best WHERE n = 1
"""

_ANSWERS = "(SELECT user_id AS key, ts AS t, event_id AS id, CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 429 ELSE 200 END AS status, value / 100 AS seconds FROM events)"


def oracle_sql() -> dict[str, str]:
    u = "trim(url)"
    return {
        "links_rewritten": REWRITTEN,
        "links_graph": GRAPH,
        "links_broken": BROKEN,
        "pages_converted": CONVERTED,
        "pages_failed": FAILED,
        "errors_expanded": "SELECT 'HTTP ' || status_code AS type, count(*) AS rows, CAST(count(*) * (count(*) + 1) // 2 AS BIGINT) AS numbers FROM crawl_results WHERE status_code >= 400 GROUP BY 1",
        "frontmatter_heads": f"SELECT doc_id, '---' || chr(10) || 'scraped_at: ' || {_yaml(chr(39).join(['strftime(scraped_at AT TIME ZONE ', 'UTC', ', ', '%Y-%m-%d', ')']))} || chr(10) || 'title: ' || {_yaml('title')} || chr(10) || 'url: ' || url AS head FROM documents WHERE text IS NOT NULL AND title IS NOT NULL AND scraped_at IS NOT NULL AND url IS NOT NULL",
        "files_planned": f"SELECT path, octet_length(encode(text)) AS bytes, 'planned' AS state FROM (SELECT {_file('url')} AS path, arg_max(text, doc_id) AS text FROM documents WHERE url IS NOT NULL AND text IS NOT NULL GROUP BY 1)",
        "files_summary": "SELECT count(output_path) AS files, CAST(coalesce(sum(length(asset_url)) FILTER (output_path IS NOT NULL), 0) AS BIGINT) AS bytes, count(*) FILTER (output_path IS NULL) AS failures, round(avg(length(asset_url)) FILTER (output_path IS NOT NULL), 6) AS mean_bytes FROM asset_rows",
        "assets_pending": "SELECT DISTINCT a AS asset_url FROM (SELECT unnest(assets) AS a FROM crawl_results) WHERE a IS NOT NULL AND a NOT IN (SELECT asset_url FROM asset_rows WHERE output_path IS NOT NULL AND asset_url IS NOT NULL)",
        "images_optimised": "SELECT count(*) AS images, count(*) FILTER (b // 6 > 40) AS smaller, CAST(coalesce(sum(b // 6 - 40) FILTER (b // 6 > 40), 0) AS BIGINT) AS saved FROM (SELECT length(output_path) * 10 AS b FROM asset_rows WHERE regexp_matches(lower(output_path), '\\.(png|jpg)$')) WHERE b >= 100",
        "robots_pages": ROBOTS,
        "sitemap_discover": f"SELECT origin, unnest(CASE WHEN length(origin) % 2 = 0 THEN [origin || '/map.xml', origin || '/news.xml'] ELSE [origin || '/sitemap.xml'] END) AS sitemap FROM {_ROBOTS}",
        "sitemap_parse": """SELECT trim(loc) AS loc, strftime(lastmod AT TIME ZONE 'UTC', '%Y-%m-%d') AS lastmod, CASE WHEN length(loc) <= 60 THEN lower(changefreq) END AS changefreq, CASE WHEN length(loc) >= 40 THEN priority END AS priority
            FROM (SELECT DISTINCT loc, lastmod, changefreq, priority FROM sitemap_entries WHERE loc IS NOT NULL)""",
        "sitemap_index": INDEX,
        "sitemap_order": ORDER,
        "checkpoint_pages_read": """SELECT url, content_hash, epoch_us(date_trunc('second', last_scraped)) AS saved_us, status_code, file_path, etag, CAST(NULL AS VARCHAR) AS last_modified
            FROM (SELECT DISTINCT * FROM checkpoint_pages WHERE url IS NOT NULL) WHERE length(url) % 3 <> 0""",
        "queue_order": f"SELECT row_number() OVER (ORDER BY length(url) % 5, url) - 1 AS position, url FROM (SELECT DISTINCT {_norm('trim(loc)')} AS url FROM sitemap_entries WHERE trim(loc) <> '')",
        "frontier_union": f"""SELECT url, min(parent) AS parent FROM (SELECT {_norm('url')} AS url, NULL AS parent FROM documents WHERE doc_id % 10 = 0
            UNION ALL SELECT {_norm('loc')}, NULL FROM sitemap_entries UNION ALL SELECT {_norm('url')}, final_url FROM crawl_results WHERE status_code >= 500) WHERE url IS NOT NULL GROUP BY url""",
        "frontier_routed": f"""SELECT r.result_id, {_host('r.url')} AS host FROM crawl_results r WHERE r.html <> '' AND {_norm('r.url')} IN (SELECT {_norm('loc')} FROM sitemap_entries WHERE trim(loc) <> '')
            AND {_norm('r.url')} NOT IN (SELECT {_norm('url')} FROM checkpoint_pages WHERE url IS NOT NULL AND last_scraped >= TIMESTAMPTZ '2025-12-01 00:00:00+00' - INTERVAL 120 DAY)""",
        "pages_ordered": "SELECT url, epoch_us(last_scraped) AS saved_us FROM checkpoint_pages WHERE url IS NOT NULL ORDER BY url, last_scraped NULLS FIRST",
        "pages_counted": f"SELECT count(DISTINCT {_norm('url')}) AS pages FROM checkpoint_pages",
        "paths_relative": f"""SELECT url, link, {_relative('h', 'p')} AS to_page, {_relative('h', 'a')} AS to_asset, internal, asset FROM (
            SELECT {u} AS url, link, {_document(u, '')} AS h, {_document('link', '')} AS p, {_asset('link', '')} AS a, {_internal('link')} AS internal, {_ENDS.format(u='link')} AS asset
            FROM (SELECT DISTINCT {u} AS url, unnest(list_concat(links, assets)) AS link FROM crawl_results WHERE url IS NOT NULL))""",
        "html_base": r"SELECT result_id, CASE WHEN result_id % 2 = 0 THEN regexp_extract(trim(final_url), '^([A-Za-z]+://[^/?#]*)', 1) || '/base/' ELSE trim(final_url) END AS base FROM crawl_results WHERE html <> '' AND final_url IS NOT NULL",
        "report_summary": """SELECT *, CASE WHEN total_bytes < 104857.6 THEN format('{:,.1f}', total_bytes / 1024) || ' KB' ELSE format('{:,.1f}', total_bytes / 1048576) || ' MB' END AS size FROM (
            SELECT count(*) FILTER (status_code < 400 AND status_code <> 304) AS pages_crawled, count(*) FILTER (status_code >= 400) AS pages_failed, CAST(coalesce(sum(octet_length(encode(html))), 0) AS BIGINT) AS total_bytes,
            round((epoch_us(max(fetched_at)) - epoch_us(min(fetched_at))) / 1e6, 3) AS seconds, round(count(*) FILTER (status_code < 400 AND status_code <> 304) / ((epoch_us(max(fetched_at)) - epoch_us(min(fetched_at))) / 1e6), 9) AS pages_per_second FROM crawl_results)""",
        "report_saved_collisions": f"SELECT file_path AS path, count(DISTINCT {_address('url')}) AS pages FROM checkpoint_pages WHERE url IS NOT NULL AND file_path IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {_address('url')}) > 1",
        "report_preview_totals": f"SELECT count(*) AS pages, CAST(sum(coalesce(len(assets), 0)) AS BIGINT) AS assets, count(DISTINCT {_file('url')}) AS paths FROM crawl_results WHERE html <> ''",
        "report_progress": "SELECT count(*) AS done, count(*) + max(queue_size) AS total, round(count(*) * 100.0 / (count(*) + max(queue_size)), 2) AS percent FROM crawl_results",
        "network_windows": f"SELECT a.id AS id, round(avg(a.seconds) OVER (PARTITION BY a.key ORDER BY a.t, a.id ROWS 99 PRECEDING), 11) AS mean_seconds FROM {_ANSWERS} a",
        "network_streaks": f"""SELECT a.id AS id, CAST(n - coalesce(max(CASE WHEN NOT ok THEN n END) OVER (PARTITION BY key ORDER BY n), 0) AS INTEGER) AS streak
            FROM (SELECT *, status = 200 AND seconds < 0.2 AS ok, row_number() OVER (PARTITION BY key ORDER BY t, id) AS n FROM {_ANSWERS}) a""",
        "network_queue": """WITH m AS (SELECT date_trunc('hour', ts) AS h, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE -1 END AS c, user_id + 1 AS b FROM events), g AS (SELECT h, sum(c) AS c, sum(c * b) AS b FROM m GROUP BY h),
            s AS (SELECT h, CAST(sum(c) OVER (ORDER BY h) AS BIGINT) AS depth, CAST(sum(b) OVER (ORDER BY h) AS BIGINT) AS queued_bytes FROM g)
            SELECT strftime(h, '%Y-%m-%d %H') AS hour, depth, queued_bytes, max(depth) OVER (ORDER BY h) AS max_depth, max(queued_bytes) OVER (ORDER BY h) AS max_bytes FROM s""",
        "network_lookups": "SELECT count(*) AS lookups, count(*) FILTER (event_type <> 'error') AS hits, round(count(*) FILTER (event_type <> 'error') * 100.0 / count(*), 6) AS hit_percent, round(avg(value) FILTER (event_type = 'error'), 6) AS mean_ms FROM events",
        "network_names": f"""SELECT DISTINCT {_host('url')} AS host FROM crawl_results WHERE {_host('url')} <> '' AND {_host('url')} NOT IN
            (SELECT h FROM (SELECT {_host('url')} AS h, min(last_scraped) + INTERVAL 30 DAY AS e FROM checkpoint_pages GROUP BY 1) WHERE h IS NOT NULL AND (e IS NULL OR e >= TIMESTAMPTZ '2025-12-01 00:00:00+00'))""",
        "network_cache": """SELECT url, result_id FROM (SELECT url, result_id, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, result_id DESC) AS n FROM crawl_results
            WHERE url IS NOT NULL AND fetched_at BETWEEN TIMESTAMPTZ '2025-12-01 00:00:00+00' - INTERVAL 60 DAY AND TIMESTAMPTZ '2025-12-01 00:00:00+00') WHERE n = 1""",
        "state_header_values": """SELECT w.url AS url, nullif(etag, '') AS etag, nullif(last_modified, '') AS modified FROM (SELECT DISTINCT url FROM crawl_results WHERE url IS NOT NULL) w
            LEFT JOIN (SELECT url, etag, last_modified FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY last_scraped DESC NULLS LAST, etag DESC NULLS LAST, last_modified DESC NULLS LAST) AS n FROM checkpoint_pages) WHERE n = 1) s ON s.url = w.url""",
    }


