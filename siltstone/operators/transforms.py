"""Hooks over the pipeline: named transforms of columns or tables, applied in order."""

from __future__ import annotations

import importlib
import importlib.util
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import markdown
from siltstone.plans.shipping import ship

_FENCE = re.compile(r"```(\w+)\n(.*?)```", re.S)
HOOKS = ("pre_crawl", "post_fetch", "post_convert", "post_save", "post_crawl")


@dataclass
class Registry:
    """Transforms by hook. Those of post_convert map a Markdown column to a Markdown column; the others map a table to a table."""

    transforms: dict[str, list[tuple[str, Callable]]] = field(default_factory=lambda: {h: [] for h in HOOKS})
    errors: list[str] = field(default_factory=list)

    def add(self, hook: str, name: str, transform: Callable) -> None:
        if hook not in self.transforms:
            raise ValueError(f"unknown hook: {hook}")
        self.transforms[hook].append((name, transform))

    def load(self, modules: list[str]) -> None:
        """Calls ``register(registry)`` of each module, named by its import path or as a .py file; one that fails is noted and left out."""
        for name in modules:
            try:
                if name.endswith(".py"):
                    spec = importlib.util.spec_from_file_location(re.sub(r"\W", "_", name), name)
                    module = importlib.util.module_from_spec(spec)
                    spec.loader.exec_module(module)
                else:
                    module = importlib.import_module(name)
                module.register(self)
            except Exception as e:  # noqa: BLE001 - a broken plugin must not end the run
                self.errors.append(f"{name}: {e}")

    def markdown(self, text: Column) -> Column:
        for _, transform in self.transforms["post_convert"]:
            text = transform(text)
        return text

    def convert(self, documents: DataFrame) -> DataFrame:
        """``documents(text, error, category, ...)`` after the hooks of post_convert, each on its own: where one fails in a row, that row keeps its last good text and has the error.

        A transform marked by :func:`python_transform` runs row by row under a guard; columns of the built-in functions do not fail by row.
        """
        for name, transform in self.transforms["post_convert"]:
            if not getattr(transform, "_by_row", False):
                try:
                    documents = documents.withColumn("text", transform(F.col("text")))
                except Exception as e:  # noqa: BLE001
                    self.errors.append(f"{name}: {e}")
                continue
            guarded = documents.withColumn("_new", _guard(transform, name)(F.col("text")))
            failed = F.col("_new.error").isNotNull()
            documents = guarded.select(
                *(c for c in documents.columns if c not in ("text", "error", "category")),
                F.when(failed, F.col("text")).otherwise(F.col("_new.text")).alias("text"),
                F.when(failed, F.coalesce("category", F.lit("plugin"))).otherwise(F.col("category")).alias("category"),
                F.when(failed, F.concat_ws("; ", "error", "_new.error")).otherwise(F.col("error")).alias("error"),
            )
        return documents

    def table(self, hook: str, rows: DataFrame) -> DataFrame:
        """``rows`` after the hook's transforms; one that fails when its plan is made is noted and left out."""
        for name, transform in self.transforms[hook]:
            try:
                rows = transform(rows)
            except Exception as e:  # noqa: BLE001
                self.errors.append(f"{name}: {e}")
        return rows


def python_transform(function: Callable[[str], str]) -> Callable[[str], str]:
    """Marks a function from Markdown to Markdown as a transform of single rows."""
    function._by_row = True
    return function


def _ship_active() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)


def _guard(function: Callable[[str], str], name: str) -> Callable[[Column], Column]:
    def one(text: str | None) -> tuple[str | None, str | None]:
        try:
            return (None if text is None else function(text)), None
        except Exception as e:  # noqa: BLE001 - a row must not end the run
            return None, f"{name}: {type(e).__name__}: {e}"

    def batches(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([one(x) for x in part], columns=["text", "error"])

    _ship_active()
    return F.pandas_udf(batches, "text string, error string")


def mark_broken(documents: DataFrame, ignored: str | None = None) -> DataFrame:
    """``documents(doc_id, path, text)`` with a comment behind each link whose file no document has."""
    broken = broken_links(documents, ignored).groupBy("doc_id").agg(F.collect_set("target").alias("_broken"))
    joined = documents.join(broken, "doc_id", "left")
    pattern = r"(?<!!)\[[^\]]+\]\([^)]+\)"
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))

    def one(link: Column) -> Column:
        target = F.regexp_extract(link, r"\(([^)]*)\)$", 1)
        return F.when(F.array_contains("_broken", target), F.concat(link, F.lit(" <!-- BROKEN LINK: "), target, F.lit(" -->"))).otherwise(link)

    pieces = F.zip_with(F.split("text", pattern, -1), F.transform(found, one), lambda piece, link: F.concat(piece, F.coalesce(link, F.lit(""))))
    return joined.withColumn("text", F.when(F.col("_broken").isNull(), F.col("text")).otherwise(F.array_join(pieces, ""))).drop("_broken")


def highlighted(text: Column) -> Column:
    """Markdown with its fenced code in known languages as HTML; needs the package pygments, and other code stays."""

    def paint(code: str, language: str) -> str | None:
        from pygments import highlight
        from pygments.formatters import HtmlFormatter
        from pygments.lexers import get_lexer_by_name
        from pygments.util import ClassNotFound

        try:
            return highlight(code, get_lexer_by_name(language), HtmlFormatter())
        except ClassNotFound:
            return None

    def all_of(one: str | None) -> str | None:
        return None if one is None else _FENCE.sub(lambda m: paint(m[2], m[1]) or m[0], one)

    def batches(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(all_of)

    _ship_active()
    return F.pandas_udf(batches, "string")(text)


def images_to_optimise(assets: DataFrame, endings: tuple[str, ...] = ("jpg", "jpeg", "png", "webp"), least_bytes: int = 0) -> DataFrame:
    """Rows of ``assets(path, bytes)`` whose ending is allowed and that are not small: what a program for images would be given."""
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return assets.where(ending.isin(*endings) & (F.col("bytes") >= least_bytes))


def bytes_saved(optimised: DataFrame) -> DataFrame:
    """One row (images, smaller, saved) of ``optimised(old_bytes, new_bytes)``: only images that became smaller count as saved."""
    less = F.col("new_bytes") < F.col("old_bytes")
    return optimised.agg(F.count("*").alias("images"), F.count_if(less).alias("smaller"), F.coalesce(F.sum(F.when(less, F.col("old_bytes") - F.col("new_bytes"))), F.lit(0)).alias("saved"))


def broken_links(documents: DataFrame, ignored: str | None = None) -> DataFrame:
    """(doc_id, target) of Markdown links to files that no document has: ``documents(doc_id, path, text)``.

    A target may name the file, its folder's index or its name without ending; fragments and web addresses are not checked.
    """
    links = documents.select("doc_id", F.explode(F.array_distinct(markdown.link_targets(F.col("text")))).alias("target"))
    links = links.where(~F.col("target").rlike(r"^(?:[a-zA-Z][\w+.-]*:|//|#)"))
    if ignored:
        links = links.where(~F.col("target").rlike(ignored))
    bare = F.regexp_replace(F.regexp_replace("target", r"[?#].*$", ""), r"^(?:\./|/)+|/+$", "")
    candidates = links.select("doc_id", "target", F.explode(F.array(bare, F.concat(bare, F.lit("/index.md")), F.concat(bare, F.lit(".md")))).alias("path"))
    found = candidates.join(documents.select("path").distinct(), "path", "left_semi").select("doc_id", "target").distinct()
    return links.join(found, ["doc_id", "target"], "left_anti").distinct()
