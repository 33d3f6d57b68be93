"""Rules that say which addresses are followed, compiled to one boolean column."""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import urls


@dataclass(frozen=True)
class PathPattern:
    """``kind`` is "regex" (from the start of the path), "glob" (whole path) or "prefix"."""

    pattern: str
    kind: str = "prefix"

    def matches(self, of_path: Column) -> Column:
        if self.kind == "prefix":
            return of_path.startswith(self.pattern)
        if self.kind == "glob":
            return of_path.rlike("^" + fnmatch.translate(self.pattern).replace(r"\Z", r"\z") + "$")
        if self.kind == "regex":
            return of_path.rlike(f"^(?:{self.pattern})")
        raise ValueError(f"unknown kind of pattern: {self.kind}")


@dataclass(frozen=True)
class Rules:
    allowed_domains: tuple[str, ...] = ()
    include: tuple[PathPattern, ...] = ()
    exclude: tuple[PathPattern, ...] = ()
    depth_limit: int | None = None


def is_allowed_domain(url: Column, domains: tuple[str, ...]) -> Column:
    """Is the host one of the domains or below one? No host is never allowed."""
    host = urls.host(url)
    out = F.lit(False)
    for domain in domains:
        out = out | (host == domain.lower()) | host.endswith("." + domain.lower())
    return (host != "") & out


def follow(url: Column, rules: Rules, depth: Column | None = None) -> Column:
    """Should the address be followed? Domain, depth, excluded paths, included paths; excluding wins."""
    of_path = urls.path(url)
    out = is_allowed_domain(url, rules.allowed_domains)
    if depth is not None and rules.depth_limit is not None:
        out = out & (depth <= rules.depth_limit)
    for pattern in rules.exclude:
        out = out & ~pattern.matches(of_path)
    if rules.include:
        some = F.lit(False)
        for pattern in rules.include:
            some = some | pattern.matches(of_path)
        out = out & some
    return F.coalesce(out, F.lit(False))


def is_html(content_type: Column) -> Column:
    return F.coalesce(F.lower(content_type).contains("text/html"), F.lit(False))


def is_too_large(content_length: Column, limit_mb: float) -> Column:
    """Is the stated length above the limit? A missing or invalid length is not."""
    return F.coalesce(content_length.try_cast("bigint") / 1048576 > limit_mb, F.lit(False))


def is_retryable(status: Column) -> Column:
    return F.coalesce(status.isin(429, 500, 502, 503, 504), F.lit(False))


def status_class(status: Column) -> Column:
    return F.when(status == 304, "not_modified").when(status >= 400, "failed").when(status.isNull(), "unknown").otherwise("ok")


def retry_delay(attempt: Column, backoff: float = 2.0, longest: float = 120.0) -> Column:
    """Seconds before the attempt (from 1) is made again, without jitter."""
    return F.least(F.lit(longest), F.pow(F.lit(backoff), attempt))


def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """Rows (origin, allow, pattern, length) of ``robots(origin, text)`` for one agent's groups.

    Lines are split and numbered; a group's agents hold until the next agent line that follows a rule.
    NULL or empty text gives no rules, which allows all.
    """
    lines = robots.select("origin", F.posexplode(F.split("text", r"\r?\n")).alias("no", "line"))
    clean = lines.select("origin", "no", F.trim(F.regexp_replace("line", "#.*$", "")).alias("line")).where(F.col("line").contains(":"))
    parsed = clean.select("origin", "no", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("field"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))
    in_order = Window.partitionBy("origin").orderBy("no")
    starts = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(in_order), F.lit("")) != "user-agent")
    grouped = parsed.where(F.col("field").isin("user-agent", "allow", "disallow")).withColumn("group", F.sum(starts.cast("int")).over(in_order))
    agents = grouped.where("field = 'user-agent'").groupBy("origin", "group").agg(F.max((F.lower("value") == agent.lower()).cast("int")).alias("own"))
    rules = grouped.where("field <> 'user-agent' AND value <> ''").join(agents.where("own = 1"), ["origin", "group"])
    return rules.select("origin", (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"), F.length("value").alias("length"))


def robots_allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages(url, ...)`` with a column robots_allowed: the longest matching rule decides, allowing wins a tie, no rule allows.

    The rules of an origin are gathered into one array (a robots file's size), so pages are joined once, by origin, and never multiplied.
    """
    listed = rules.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct((-F.col("length")).alias("k"), (~F.col("allow")).alias("forbids"), "pattern"))).alias("rules"))
    keyed = pages.withColumn("origin", urls.origin(F.col("url"))).join(listed, "origin", "left")
    target = F.concat(urls.path(F.col("url")), urls.query(F.col("url")))

    def regex(p: Column) -> Column:
        quoted = F.regexp_replace(p, r"([\\.\[\]{}()+?^|])", r"\\$1")
        return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*", ".*"))

    first = F.get(F.filter("rules", lambda r: F.regexp_like(target, regex(r["pattern"]))), 0)
    return keyed.withColumn("robots_allowed", F.coalesce(~first["forbids"], F.lit(True))).drop("rules", "origin")
