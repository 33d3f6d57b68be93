"""Mapping of addresses to file paths, and relative paths between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import urls

# Endings of asset files.
ASSET_ENDINGS = "png jpg jpeg gif svg webp ico bmp css scss sass less js mjs ts woff woff2 ttf eot otf map".split()
INDEX = "index.md"


def document_path(url: Column, strip_prefix: str = "", root: str = "docs", index: str = INDEX) -> Column:
    """Path of a page's Markdown file; query and fragment do not matter. Parent steps are dropped, so no path leaves the root."""
    whole = F.regexp_replace(urls.path(url), r"(?:^|/)\.\.?(?=/|$)", "")
    if strip_prefix:
        whole = F.when(whole.startswith(strip_prefix), whole.substr(F.lit(len(strip_prefix) + 1), F.length(whole))).otherwise(whole)
    folder = whole.endswith("/")
    bare = F.regexp_replace(whole, r"^/+|/+$", "")
    return F.when(bare == "", F.lit(f"{root}/{index}")).when(folder, F.concat(F.lit(f"{root}/"), bare, F.lit(f"/{index}"))).otherwise(F.concat(F.lit(f"{root}/"), bare, F.lit(".md")))


def asset_path(url: Column, strip_prefix: str = "", root: str = "assets") -> Column:
    """Path of an asset's file; the host does not matter."""
    whole = F.regexp_replace(urls.path(url), r"(?:^|/)\.\.?(?=/|$)", "")
    if strip_prefix:
        whole = F.when(whole.startswith(strip_prefix), whole.substr(F.lit(len(strip_prefix) + 1), F.length(whole))).otherwise(whole)
    return F.concat(F.lit(f"{root}/"), F.regexp_replace(whole, r"^/+", ""))


def relative_path(source: Column, target: Column) -> Column:
    """Path of the target file as seen from the source file's folder."""
    here = F.slice(F.split(source, "/"), F.lit(1), F.size(F.split(source, "/")) - 1)
    there = F.split(target, "/")
    both = F.least(F.size(here), F.size(there) - 1)
    common = F.aggregate(
        F.sequence(F.lit(1), F.greatest(both, F.lit(1))),
        F.lit(0),
        lambda n, i: F.when((i <= both) & (n == i - 1) & (F.get(here, i - 1) == F.get(there, i - 1)), i).otherwise(n),
    )
    return F.concat(F.repeat(F.lit("../"), F.size(here) - common), F.array_join(F.slice(there, common + 1, F.size(there)), "/"))


def assets_relative(document: Column, asset: Column) -> Column:
    """Path of an asset as seen from a document, both under the same base folder."""
    return relative_path(document, asset)


def is_internal(link: Column, allowed_domains: list[str], strip_prefix: str = "") -> Column:
    """Does the link lead to a page that is saved? A leading "www." does not matter; subdomains do."""
    authority = F.regexp_replace(F.lower(urls.authority(link)), r"^www\.", "")
    own = [d.lower().removeprefix("www.") for d in allowed_domains]
    rooted = link.startswith("/") & ~link.startswith("//")
    return F.when(rooted, link.startswith(strip_prefix) if strip_prefix else F.lit(True)).otherwise(authority.isin(own) if own else F.lit(False))


def is_asset(link: Column) -> Column:
    return F.lower(urls.path(link)).rlike(r"\.(?:" + "|".join(ASSET_ENDINGS) + r")$")
