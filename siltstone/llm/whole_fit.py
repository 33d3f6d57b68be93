"""Word weights of the main body, counted over all pages.

What :func:`siltstone.llm.main_body.fit` counts by site of a list of pages, as
grouped counts of a table of any size: each page is read once for its lines;
lines go by 64-bit hashes of tag and words, and the text of a line is kept once
for each ``KNOWN_LINES`` lines and titles. The driver gets the counted
vocabulary and the names of the large sites.

A line that stands both linked and unlinked counts as unlinked. The order of
rows and their partitions change nothing; equal rows count each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.html_blocks import blocks, is_linked, plain
from siltstone.llm.main_body import ARTICLE_WORDS, BOILERPLATE_TAGS, BOILERPLATE_TIMES, BOILERPLATE_TITLES, IN_ARTICLE_TAGS, LETTER_WORDS, OWN_TAGS, SAMPLE_PAGES, SEEDS, host_of, host_words, seed_counts, titles_needed, weights_of
from siltstone.plans.lineage import keep
from siltstone.plans.shipping import map_arrow

#: Lines and titles of lines that a task remembers, so that it gives them once; beyond, it begins anew.
KNOWN_LINES = 200_000

_LINES = pa.schema([("page", pa.int64()), ("line", pa.int64()), ("own", pa.int32()), ("linked", pa.bool_()), ("title", pa.int64()), ("site", pa.int64()), ("needed", pa.int64()), ("tag", pa.string()), ("words", pa.string())])


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _lines_of(url: str | None, page: str) -> tuple[str | None, dict[tuple[str, str], list[int]]]:
    """Title of a page, and for each line (tag, words): words in it that may be the page's own, and whether it stands as a link only."""
    site = host_words(url)
    title = None
    lines: dict[tuple[str, str], list[int]] = {}
    for tag, raw, _ in blocks(page):
        words = LETTER_WORDS.findall(plain(raw).lower())
        if not site.isdisjoint(words):
            words = ["" if w in site else w for w in words]
        # Each word ends in a blank: a line of one word of the site is not an empty line.
        text = " ".join(words) + " " if words else ""
        if title is None and tag in ("h1", "h2"):
            title = text
        linked = is_linked(raw)
        line = lines.setdefault((tag, text), [0, 1])
        if not linked:
            line[1] = 0
            if tag in OWN_TAGS:
                line[0] += len(words)
    return title, lines


class _Known:
    """What a task has told of a line: its titles by site, whether there are several, whether it stood unlinked, whether it is boilerplate whatever else is seen."""

    __slots__ = ("first", "key", "repeated", "several", "titles", "unlinked")

    def __init__(self, key: int, title: int):
        self.key, self.first, self.titles = key, title, {}
        self.several = self.unlinked = self.repeated = False


def _lines_finder(large: dict[str, int]):
    """Finds rows of lines by page (none for the pages that cannot help to fit), with titles and texts where they are new to the task; ``large`` has the pages of each site for which more titles are needed than for others."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], _Known] = {}
        size = 0
        for batch in batches:
            rows: list[list] = [[] for _ in _LINES]
            for number, url, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                title, lines = _lines_of(url, page)
                mark = 0 if title is None else _hash(title)
                host = host_of(url)
                site, needed = _hash(host), titles_needed(large.get(host, 0))
                helps = sum(own for own, _ in lines.values()) >= ARTICLE_WORDS
                if size > KNOWN_LINES:
                    known, size = {}, 0
                for line, (own, linked) in lines.items():
                    state = known.get(line)
                    fresh = state is None
                    if state is None:
                        state = known[line] = _Known(_hash(f"{line[0]} {line[1]}"), mark)
                        size += 1
                    state.several |= mark != state.first
                    told = not state.repeated and mark not in state.titles.get(site, ())
                    if told:
                        titles = state.titles.setdefault(site, set())
                        titles.add(mark)
                        state.repeated = len(titles) >= needed
                        size += 1
                    told = told or not (linked or state.unlinked)
                    state.unlinked |= not linked
                    if helps or told:
                        values = (number if helps else None, state.key, 0 if state.several else own, bool(linked), mark if told else None, site if told else None, needed if told else None, line[0] if fresh else None, line[1] if fresh else None)
                        for column, value in zip(rows, values, strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _LINES, strict=True)], schema=_LINES)

    return find


def site_pages(pages: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of all ``pages(url)``, and pages of each site for which more than ``BOILERPLATE_TITLES`` titles are needed: at most one site in ``SAMPLE_PAGES`` pages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts = Counter(host for batch in batches for host in map(host_of, batch.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(hosts.keys(), pa.string()), pa.array(hosts.values(), pa.int64())], ["site", "pages"])

    counted = map_arrow(pages.select("url"), count, "site string, pages long").groupBy("site").agg(F.sum("pages").alias("pages"))
    of_large = F.when(F.col("pages") > SAMPLE_PAGES, F.col("site"))
    rows = counted.groupBy(of_large.alias("site")).agg(F.sum("pages").alias("pages")).collect()
    return sum(n for _, n in rows), {site: n for site, n in rows if site is not None}


def counts_on(results: DataFrame) -> tuple[int, Counter, Counter, Counter, Counter]:
    """Number of pages; words of articles and of boilerplate, tags of either, over all pages of ``results(url, html)``."""
    pages = results.where("html <> ''").select(F.monotonically_increasing_id().alias("page"), "url", "html")
    number, large = site_pages(results.where("html <> ''"))
    lines = keep(map_arrow(pages, _lines_finder(large), "page long, line long, own int, linked boolean, title long, site long, needed long, tag string, words string"))
    told = lines.where("title IS NOT NULL").select("line", "site", "title", "needed", "linked", "tag", F.when(F.col("words").isNotNull(), F.xxhash64("words")).alias("of_words"))
    same = [F.min("linked").alias("linked"), F.max("tag").alias("tag"), F.max("of_words").alias("of_words")]
    by_title = told.repartition("line").groupBy("line", "site", "title").agg(F.max("needed").alias("needed"), *same)
    by_site = by_title.groupBy("line", "site").agg((F.count("*") >= F.max("needed")).alias("repeated"), F.min("title").alias("first"), F.max("title").alias("last"), *same)
    kinds = keep(by_site.groupBy("line").agg(F.max("repeated").alias("repeated"), (F.min("first") == F.max("last")).alias("single"), *same))
    helping = (
        lines.where("page IS NOT NULL AND own > 0").select("page", "line", "own").join(kinds.where("single").select("line"), "line")
        .groupBy("page").agg(F.sum("own").alias("own")).where(F.col("own") >= ARTICLE_WORDS).select("page")
    )
    seen = lines.where("page IS NOT NULL").select("page", "line", "linked").join(helping, "page").groupBy("line").agg(F.min("linked").alias("linked"))
    in_articles = kinds.where(F.col("tag").isin(*IN_ARTICLE_TAGS) & ~F.col("linked")).select("of_words")
    repeated = kinds.where("repeated").select("line", "of_words").join(in_articles, "of_words", "left_anti").select("line", F.lit(True).alias("repeated"))
    kind = (
        F.when(F.col("single") & ~F.col("linked") & F.col("tag").isin(*OWN_TAGS), "article")
        .when(F.col("repeated") & (F.col("linked") | F.col("tag").isin(*BOILERPLATE_TAGS)), "boilerplate")
        .when(~F.col("linked"), "neither")
    )
    marked = seen.join(kinds.select("line", "single", "tag"), "line").join(repeated, "line", "left").select("line", "tag", kind.alias("kind")).where("kind IS NOT NULL")
    texts = lines.where("words IS NOT NULL").select("line", "words")
    whole = marked.join(texts, "line").groupBy("line", "kind", "tag").agg(F.max("words").alias("words"))
    # A line of neither kind counts by its tag alone.
    parts = F.concat(F.array(F.concat(F.lit("<"), "tag", F.lit(">"))), F.when(F.col("kind") != "neither", F.split("words", " ")).otherwise(F.array()))
    counted = whole.select("kind", F.explode(parts).alias("part")).where("part <> ''").groupBy("kind", "part").count().toArrow()
    article, boilerplate, article_tags, boilerplate_tags = Counter(), Counter(), Counter(), Counter()
    for of, part, n in zip(*(counted.column(i).to_pylist() for i in range(3)), strict=True):
        if part[0] == "<":
            (boilerplate_tags if of == "boilerplate" else article_tags)[part[1:-1]] += n
        elif of == "boilerplate":
            boilerplate[part] += n * BOILERPLATE_TIMES
        else:
            article[part] += n
    return number, article, boilerplate, article_tags, boilerplate_tags


def fit_on_all(results: DataFrame, seeds: Iterable[str] = SEEDS) -> tuple[int, dict[str, float]]:
    """Number of pages with html of ``results(url, html)``, and the weights that :func:`siltstone.llm.main_body.fit` gives for them, by site."""
    number, article, boilerplate, article_tags, boilerplate_tags = counts_on(results)
    return number, weights_of(article + seed_counts(seeds, number), boilerplate, article_tags, boilerplate_tags)
