"""Fetched pages to documents: one row a page, with what went wrong as a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import markdown, pages
from siltstone.functions.rewriting import Layout, rewrite
from siltstone.operators.rules import is_html, is_too_large
from siltstone.operators.transforms import Registry

#: What a page can fail by, in order of the checks.
CATEGORIES = ("http", "content_type", "size", "empty", "conversion", "plugin")


def outcome(status: Column, content_type: Column, length: Column, html: Column, limit_mb: float) -> Column:
    """Category of what keeps a page from being converted; NULL if nothing does. An answer 304 is no failure and is left to the caller."""
    return (
        F.when(status >= 400, "http")
        .when(~is_html(content_type), "content_type")
        .when(is_too_large(length, limit_mb), "size")
        .when(F.coalesce(html, F.lit("")) == "", "empty")
    )


def documents(
    results: DataFrame, layout: Layout, scraped_at: Column | None = None, keep: tuple[str, ...] = (), remove: tuple[str, ...] = (), frontmatter: bool = True, hooks: Registry | None = None, limit_mb: float = 10.0
) -> DataFrame:
    """(result_id, url, path, title, text, bytes, category, error) of each fetched page of ``results``.

    Title, selected content, Markdown, cleaning, head, links and the hooks of
    post_convert follow each other; a page that fails has its category and
    message and no text, and ends nothing. ``results`` is read twice: the
    conversion needs its html only, so no html goes through a shuffle of the rest.
    Rows with status 304 are not there. ``scraped_at`` is the fetch time if it is not given.
    """
    fetched = results.where("status_code IS NULL OR status_code <> 304")
    kind = outcome(F.col("status_code"), F.col("content_type"), F.octet_length("html").cast("string"), F.col("html"), limit_mb)
    rows = fetched.select("result_id", F.trim("url").alias("url"), F.col("fetched_at"), "status_code", F.when(F.col("html") != "", pages.title(F.col("html"))).alias("title"), kind.alias("category"))
    converted = markdown.convert(fetched.where(kind.isNull()), keep, remove)
    when = F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss'Z'") if scraped_at is None else scraped_at
    joined = rows.join(converted, "result_id", "left")
    text = pages.clean_markdown(F.col("markdown"))
    if frontmatter:
        text = pages.frontmatter(text, F.col("title"), F.col("url"), F.coalesce(when, F.lit("unknown")))
    out = joined.withColumn("text", rewrite(text, F.col("url"), layout))
    category = F.coalesce("category", F.when(F.col("error").isNotNull(), "conversion"))
    error = F.coalesce("error", F.when(F.col("category") == "http", F.concat(F.lit("HTTP "), F.col("status_code").cast("string"))))
    out = out.select("result_id", "url", layout.document(F.col("url")).alias("path"), "title", "text", category.alias("category"), error.alias("error"))
    if hooks is not None:
        out = hooks.convert(out)
    return out.select("result_id", "url", "path", "title", "text", F.octet_length("text").cast("long").alias("bytes"), "category", "error")


def error_rows(converted: DataFrame) -> DataFrame:
    """(category, type, url, message): one row for each failed page."""
    failed = converted.where("category IS NOT NULL")
    return failed.select("category", F.coalesce(F.regexp_extract("error", r"^(HTTP \d+|\w+)", 1), "category").alias("type"), "url", F.substring("error", 1, 80).alias("message"))


def expanded(counts: DataFrame) -> DataFrame:
    """One row (type, number) for each of the errors of ``counts(type, errors)``, numbered from 1; counts of NULL or less than one give none."""
    return counts.where("errors >= 1").select("type", F.explode(F.sequence(F.lit(1).cast("long"), F.col("errors").cast("long"))).alias("number"))
