"""Links of Markdown texts made relative to the files that a crawl writes, as column expressions.

A text is cut at its links; each link is mapped by itself and the pieces are
joined again, so nothing is exploded and no Python runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import paths

_LINK = r"(?<!!)\[[^\]]+\]\([^)]+\)"
_IMAGE = r"!\[[^\]]*\]\([^)]+\)"


@dataclass(frozen=True)
class Layout:
    """Folders under one base folder, and the addresses that belong to the site."""

    allowed_domains: tuple[str, ...] = ()
    docs: str = "docs"
    assets: str = "assets"
    strip_prefix: str = ""
    index: str = paths.INDEX

    def document(self, url: Column) -> Column:
        return paths.document_path(url, self.strip_prefix, self.docs, self.index)

    def asset(self, url: Column) -> Column:
        return paths.asset_path(url, self.strip_prefix, self.assets)

    def folders(self, base: str, site: str | None = None) -> dict[str, str]:
        """Folders of a site's files: base, then the site's own if it has one, then documents and assets."""
        root = base.rstrip("/") + (f"/{site.strip('/')}" if site else "")
        return {"root": root, "docs": f"{root}/{self.docs}", "assets": f"{root}/{self.assets}"}


def _mapped(text: Column, pattern: str, new_target: Callable[[Column], Column]) -> Column:
    """The text with the target of each match of ``pattern`` (a link whose target stands in its last parentheses) replaced; NULL keeps a link."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def one(link: Column) -> Column:
        target = F.regexp_extract(link, r"(?s)\(([^)]*)\)$", 1)
        head = F.regexp_extract(link, r"(?s)^(.*\]\()[^)]*\)$", 1)
        return F.coalesce(F.concat(head, new_target(target), F.lit(")")), link)

    pieces = F.zip_with(between, F.transform(found, one), lambda piece, link: F.concat(piece, F.coalesce(link, F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)


def document_links(text: Column, source_url: Column, layout: Layout) -> Column:
    """Links to saved pages become relative paths (a fragment is lost with the address); all others stay."""
    here = layout.document(source_url)

    def new(target: Column) -> Column:
        web = target.rlike(r"^https?://") | target.startswith("/")
        return F.when(web & paths.is_internal(target, list(layout.allowed_domains), layout.strip_prefix), paths.relative_path(here, layout.document(target)))

    return _mapped(text, _LINK, new)


def image_links(text: Column, source_url: Column, layout: Layout) -> Column:
    """Images with an asset's ending become relative paths to their files; a relative target without parent steps belongs to the site's root."""
    here = layout.document(source_url)
    root = f"https://{layout.allowed_domains[0]}/" if layout.allowed_domains else ""

    def new(target: Column) -> Column:
        web = target.rlike(r"^(?:https?:)?//") | target.startswith("/")
        whole = F.when(web, target).otherwise(F.concat(F.lit(root), F.regexp_replace(target, r"^(?:\./)+", "")))
        other = target.rlike(r"(?i)^(?!https?:)[a-z][a-z0-9+.-]*:")
        return F.when(~target.startswith("../") & ~other & paths.is_asset(target), paths.relative_path(here, layout.asset(whole)))

    return _mapped(text, _IMAGE, new)


def rewrite(text: Column, source_url: Column, layout: Layout) -> Column:
    """Images first, then links to pages. A NULL text or address gives NULL or leaves the text as it is."""
    return F.when(source_url.isNull(), text).otherwise(document_links(image_links(text, source_url, layout), source_url, layout))


def link_graph(documents: DataFrame, layout: Layout) -> DataFrame:
    """(url, target, file, saved) of each distinct link of ``documents(url, text)`` to an own page: the file it means, and whether a document has it."""
    own = documents.where("url IS NOT NULL")
    links = own.select("url", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<!!)\[[^\]]+\]\(([^)]+)\)"), F.lit(1)))).alias("target"))
    web = F.col("target").rlike(r"^https?://") | F.col("target").startswith("/")
    links = links.where(web & paths.is_internal(F.col("target"), list(layout.allowed_domains), layout.strip_prefix)).withColumn("file", layout.document(F.col("target")))
    files = own.select(layout.document(F.col("url")).alias("file")).distinct().withColumn("saved", F.lit(True))
    return links.join(files, "file", "left").select("url", "target", "file", F.coalesce("saved", F.lit(False)).alias("saved"))


