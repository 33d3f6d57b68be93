"""Column expressions over the html and Markdown of a page, all JVM-side.

Raw-text elements (script, style, noscript, template) and comments are dropped
before tags are counted, so markup inside them is never counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import urls

_RAW = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<noscript\b[^>]*>.*?</noscript\s*>|<template\b[^>]*>.*?</template\s*>"
#: What follows a tag's name up to its end; a sign ">" in a quoted value does not end it.
_ATTRS = r"""[^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+"""
_ANY_TAG = r"<[a-zA-Z/!?]" + _ATTRS + ">"
_START_TAG = r"<[a-zA-Z]" + _ATTRS + ">"
_SCRIPTS = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<noscript\b[^>]*>.*?</noscript\s*>"

# Character references that titles use.
_REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))

# Patterns of loading signs and of notices that scripts are needed.
LOADING = r"(?i)loading\.{0,3}|please wait|spinner|skeleton|initializing|fetching"
NOSCRIPT = r"(?i)javascript.*required|enable.*javascript|javascript.*disabled|browser.*not.*support|please.*enable.*js"
LOADING_CHARS = 5000


def markup(html: Column) -> Column:
    """The html without raw-text elements and comments."""
    return F.regexp_replace(html, _RAW, "")


def without_scripts(html: Column) -> Column:
    """The html without script, style and noscript elements."""
    return F.regexp_replace(html, _SCRIPTS, "")


def unescape(text: Column) -> Column:
    for reference, sign in _REFERENCES:
        text = F.replace(text, F.lit(reference), F.lit(sign))
    return text


def title(html: Column) -> Column:
    """Text of the first title, or "Untitled"."""
    found = F.trim(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("Untitled"))


def visible_text(html: Column) -> Column:
    """Text without tags, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(markup(html), _ANY_TAG, " "), r"\s+", " "))


def base_url(html: Column, fallback: Column) -> Column:
    """Address of the first base tag resolved against the page's own, else the page's own."""
    found = F.trim(F.regexp_extract(markup(html), r"(?is)<base\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]*)", 1))
    return F.when(found == "", fallback).otherwise(urls.join(fallback, found))


def _value(tag: Column, name: str) -> Column:
    """Value of a start tag's attribute: quoted either way or bare; empty if it has none."""
    found = F.regexp_extract(tag, rf"""(?is)[\s"'/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.trim(F.regexp_replace(found, r"""^["']|["']$""", ""))


def hrefs(html: Column) -> Column:
    """Raw href values of all a elements, in order."""
    quoted = F.regexp_extract_all(markup(html), F.lit(r"(?is)<a\s[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'[^']*'|[^\s>]*)"), F.lit(0))
    return F.transform(quoted, lambda x: F.regexp_replace(F.regexp_replace(x, r"(?is)^<a\s[^>]*?\bhref\s*=\s*", ""), r"^[\"']|[\"']$", ""))


def links(html: Column, address: Column) -> Column:
    """Sorted distinct normalised http(s) links of a page, resolved against its base tag or else its own address."""
    base = base_url(html, F.trim(address))
    absolute = F.transform(F.filter(hrefs(html), lambda x: F.trim(x) != ""), lambda x: urls.join(base, x))
    return F.array_sort(F.array_distinct(F.transform(F.filter(absolute, urls.is_safe_scheme), urls.normalize)))


def assets(html: Column, base: Column) -> Column:
    """Sorted distinct absolute addresses of images, style sheets and scripts, in any notation of attributes; any scheme."""
    page = F.regexp_replace(html, r"(?is)<!--.*?-->", "")
    tags = F.regexp_extract_all(page, F.lit(r"(?is)<(?:img|script|link)\s" + _ATTRS + ">"), F.lit(0))
    sheets = F.filter(tags, lambda x: x.rlike(r"(?i)^<link") & (F.lower(_value(x, "rel")) == "stylesheet"))
    found = F.concat(F.transform(F.filter(tags, lambda x: ~x.rlike(r"(?i)^<link")), lambda x: _value(x, "src")), F.transform(sheets, lambda x: _value(x, "href")))
    return F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda x: x != ""), lambda x: urls.join(base, x))))


def with_quality(rows: DataFrame, html: str = "html") -> DataFrame:
    """``rows`` with a struct column q of :func:`quality`.

    Generated columns are computed once, however often they are used: first the markup, then its start tags, then the counts.
    """
    marked = rows.select("*", F.explode(F.array(markup(F.coalesce(F.col(html), F.lit(""))))).alias("_body"))
    tagged = marked.select("*", F.explode(F.array(start_tags(F.col("_body")))).alias("_tags"))
    return tagged.select("*", F.explode(F.array(quality(F.col(html), F.col("_body"), F.col("_tags")))).alias("q")).drop("_body", "_tags")


def start_tags(body: Column) -> Column:
    """All start tags of markup in one text, each behind the sign U+0001: counts then look at tags only."""
    return F.concat(F.lit("\x01"), F.array_join(F.regexp_extract_all(body, F.lit(_START_TAG), F.lit(0)), "\x01"))


def noscript_warning(html: Column) -> Column:
    """Does a noscript element say that scripts are needed? The words must stand in one line."""
    bodies = F.regexp_extract_all(html, F.lit(r"(?is)<noscript\b[^>]*>(.*?)(?:</noscript\s*>|$)"), F.lit(1))
    return F.when(html.rlike("(?i)<noscript"), F.exists(bodies, lambda x: x.rlike(NOSCRIPT))).otherwise(F.lit(False))


def quality(html: Column, body: Column | None = None, tags: Column | None = None) -> Column:
    """Struct of content counts and framework marks; blank html gives zeros. ``body`` is the html's markup, ``tags`` its start tags, if they are known."""
    page = F.coalesce(html, F.lit(""))
    body = markup(page) if body is None else body
    tags = start_tags(body) if tags is None else tags
    visible = F.trim(F.regexp_replace(F.regexp_replace(body, _ANY_TAG, " "), r"\s+", " "))

    def count(pattern: str) -> Column:
        return F.regexp_count(tags, F.lit("(?i)\x01<" + pattern)).cast("int")

    return F.struct(
        F.length(visible).alias("text_length"),
        count(r"a\s(?:[^\x01]*[\s\"'/])?href[\s=>]").alias("link_count"),
        count(r"h[1-6][\s/>]").alias("heading_count"),
        count(r"p[\s/>]").alias("paragraph_count"),
        tags.rlike(r"(?i)\x01<main[\s/>]|\srole\s*=\s*[\"']?main[\"'\s/>]").alias("has_main_content"),
        tags.rlike(r"(?i)\x01<article[\s/>]").alias("has_article"),
        F.substring(page, 1, LOADING_CHARS).rlike(LOADING).alias("has_loading_indicators"),
        noscript_warning(page).alias("has_noscript_warning"),
        tags.rlike(r"(?i)\sid\s*=\s*[\"']?(?:root|__next)[\"'\s/>]|\sdata-reactroot[\s=/>]").alias("has_react_root"),
        tags.rlike(r"(?i)\sdata-v-app[\s=/>]").alias("has_vue_app"),
        tags.rlike(r"(?i)\sng-version[\s=/>]|\s_ngcontent-[\s=/>]").alias("has_angular_app"),
    )


# The limits of the next two functions.
def needs_js(q: Column) -> Column:
    """Does the page wait for scripts?"""
    framework = q["has_react_root"] | q["has_vue_app"] | q["has_angular_app"]
    return (
        q["has_noscript_warning"]
        | (q["has_loading_indicators"] & (q["text_length"] < 500))
        | (framework & (q["text_length"] < 300) & (q["paragraph_count"] < 2))
        | ((q["text_length"] < 100) & (q["link_count"] < 3) & (q["heading_count"] == 0))
    )


def quality_points(q: Column) -> Column:
    """Quality in hundredths, at most 100."""

    def steps(value: Column, *limits: tuple[int, int]) -> Column:
        out = F.lit(0)
        for limit, points in sorted(limits):
            out = F.when(value >= limit, F.lit(points)).otherwise(out)
        return out

    return (
        steps(q["text_length"], (2000, 40), (500, 30), (100, 10))
        + F.when(q["has_main_content"] | q["has_article"], F.lit(15)).otherwise(0)
        + steps(q["heading_count"], (3, 15), (1, 10))
        + steps(q["paragraph_count"], (5, 15), (2, 10))
        + steps(q["link_count"], (5, 15), (2, 10))
    ).cast("int")


def clean_markdown(text: Column) -> Column:
    """No trailing blanks, at most one empty line in a row, one line end at the end."""
    lines = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t]+(?=\n|$)", "")
    return F.concat(F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"\s+$", ""), F.lit("\n"))


def _yaml(text: Column) -> Column:
    plain = text.rlike(r"^[\p{L}\p{N}][\p{L}\p{N} ._/()-]*$") & ~text.rlike(r"(?i)^(?:true|false|yes|no|null|on|off|[0-9.]+)$") & ~text.rlike(r"\s$")
    return F.when(plain, text).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'")))


def frontmatter(text: Column, of_title: Column, url: Column, scraped_at: Column) -> Column:
    """Markdown with a YAML head of scraped_at, title and url; the time is given, so equal input gives equal output."""
    return F.concat(F.lit("---\nscraped_at: "), _yaml(scraped_at), F.lit("\ntitle: "), _yaml(of_title), F.lit("\nurl: "), url, F.lit("\n---\n\n"), text)


def frontmatter_title(text: Column) -> Column:
    """Title of the YAML head, without quotes; NULL if there is none."""
    head = F.regexp_extract(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"(?s)^---\n(.*?)\n---\n", 1)
    return F.nullif(F.regexp_replace(F.trim(F.regexp_extract(head, r"(?m)^title:[ ]*(.*)$", 1)), "^['\"]|['\"]$", ""), F.lit(""))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def asset_type(url: Column) -> Column:
    """Kind of an asset by marks in its address, images first."""
    low = F.lower(url)
    return (
        F.when(low.rlike(r"\.(?:png|jpg|jpeg|gif|svg|webp)"), "image")
        .when(low.contains(".css"), "css")
        .when(low.contains(".js"), "javascript")
        .when(low.rlike(r"\.(?:woff2?|ttf|eot)"), "font")
        .otherwise("unknown")
    )


def estimated_size(text: Column) -> Column:
    """Bytes of a queued result, with five per cent for what surrounds it."""
    return F.floor(F.octet_length(text) * 1.05).cast("long")
