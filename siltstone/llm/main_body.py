"""Main body of web pages: maximum-scoring block region.

Words score positive where they are typical of articles and negative where
they are typical of boilerplate; every tag has its cost, and each kind of tag
its log-odds. All these weights are fitted on a bounded sample of pages
labelled by how often their lines recur under different titles
(``SAMPLE_PAGES``, the only bound; every page is scored). One linear scan finds
the contiguous region of the highest sum. What has to come out has gaps
(prompts, contents lists and bylines stand inside articles), so the same sum
decides once more for each block of the region: its tag and words by
themselves must score above zero.

Results for special input: NULL or empty html, or html without blocks, gives
no main body. Ties between regions go to the first. Equal rows give equal
results. The model is fitted on whatever pages there are; without any page
all words count as unknown, and unknown words speak for an article.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm.html_blocks import BLOCK_TAGS, HEADINGS, LINK_ON, Block, blocks, is_linked, plain
from siltstone.llm.placeholders import is_placeholder
from siltstone.llm.residue_seeds import ERROR_TEXTS, FILLER_TEXTS, SCRIPT_TEXTS
from siltstone.llm.sampling import smallest_hashes
from siltstone.plans.shipping import map_arrow

#: Pages whose lines are labelled for fitting: those with the smallest hash of their id.
SAMPLE_PAGES = 2000
#: A line under so many different titles is boilerplate.
BOILERPLATE_TITLES = 4
#: Lines with these tags may be an article's own; unlinked lines with these stand in articles; lines with these may be boilerplate without being links.
OWN_TAGS = ("p", "li", "pre", "dd", "h1", "h2", "h3")
IN_ARTICLE_TAGS = ("h1", "h2", "h3", "td", "dd")
BOILERPLATE_TAGS = ("p", "li", "h4", "h5", "h6")
#: Counted by site, a line is boilerplate from so many titles on, one in so many of the site's pages at least: as many as ``BOILERPLATE_TITLES`` in ``SAMPLE_PAGES``.
SITE_PAGES = SAMPLE_PAGES // BOILERPLATE_TITLES
#: Times that a word of boilerplate counts.
BOILERPLATE_TIMES = 3
#: A page helps to fit only if it has so many words in lines of its own.
ARTICLE_WORDS = 40
#: Shares of the two word models that belong to words never seen.
UNSEEN_ARTICLE, UNSEEN_BOILERPLATE = 0.3, 0.02
WEIGHT_LIMIT = 3.0
SEEDS = (*ERROR_TEXTS, *SCRIPT_TEXTS, *FILLER_TEXTS)
SEED_TIMES = 10
LINK_WEIGHT = -4.0
#: An entry that repeats a heading of the page (contents list, breadcrumb): never kept, but it may stand within the article.
ENTRY_WEIGHT = -0.2
#: Lowest score of one block in the scan, so that a byline or prompt does not cut the title off.
LOWEST = -4.0
TITLE_WEIGHT = 8.0
#: A block that is one unfilled placeholder stands in the article's place.
PLACEHOLDER_WEIGHT = 3.0
#: Cost of every tag that begins a block.
TAG_COST = -0.3
#: Lines of each tag that are counted before any is seen, so that an unseen tag speaks neither way.
TAG_PRIOR = 5.0
#: Cells, terms and code are no boilerplate, so their words are not weighed.
TABLE_TAGS = frozenset(["td", "th", "dt", "pre"])
#: Cost of what lies between two blocks.
BETWEEN = -0.05

LETTER_WORDS = re.compile(r"[^\W\d_]+")
WORDS = re.compile(r"[^\W_]+")
_HOST = re.compile(r"^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)


def host_words(url: str | None) -> frozenset[str]:
    """Words of the host name: they name the site, so they are no words of its lines."""
    found = _HOST.match(url or "")
    return frozenset(LETTER_WORDS.findall(found[1].lower())) if found else frozenset()


def host_of(url: str | None) -> str:
    """Host name in small letters, empty if there is none."""
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def titles_needed(pages: int) -> int:
    """Titles of one site, with so many pages, under which a line has to stand to be boilerplate."""
    return max(BOILERPLATE_TITLES, -(-pages // SITE_PAGES))


def fit(pages: Iterable[tuple[str | None, list[Block]]], seeds: Iterable[str] = SEEDS, by_site: bool = False) -> dict[str, float]:
    """Word weights from (url, blocks) pairs; positive weights speak for the article.

    ``seeds`` are texts that count as main body where they stand in an article's place (error messages, filler).
    ``by_site`` is for any number of pages: it counts the titles of boilerplate in each site by itself
    (:func:`titles_needed`), for over all sites every line that can recur does so by chance once there are enough
    pages, and the seeds keep their share (:func:`seed_share`).
    """
    site_pages: Counter = Counter()
    site_titles: dict[tuple[str, tuple[str, ...]], dict[str, set]] = defaultdict(lambda: defaultdict(set))
    titles: dict[tuple[str, tuple[str, ...]], set] = defaultdict(set)
    parsed = []
    in_articles = set()
    for url, page in pages:
        site = host_words(url)
        lines = []
        title = None
        for block in page:
            words = tuple("" if w in site else w for w in LETTER_WORDS.findall(plain(block.raw).lower()))
            if title is None and block.tag in ("h1", "h2"):
                title = words
            lines.append((block.tag, words, is_linked(block.raw)))
        parsed.append(lines)
        host = host_of(url)
        site_pages[host] += 1
        for tag, words, linked in lines:
            titles[tag, words].add(title)
            if by_site:
                site_titles[tag, words][host].add(title)
            if not linked and tag in IN_ARTICLE_TAGS:
                in_articles.add(words)
    article = seed_counts(seeds, site_pages.total() if by_site else 0)
    boilerplate: Counter = Counter()
    article_tags: Counter = Counter()
    boilerplate_tags: Counter = Counter()
    seen = set()
    for lines in parsed:
        own = [x for x in lines if not x[2] and x[0] in OWN_TAGS and len(titles[x[0], x[1]]) == 1]
        if sum(len(words) for _, words, _ in own) < ARTICLE_WORDS:
            continue
        for line in lines:
            tag, words, linked = line
            if (tag, words) in seen:
                continue
            seen.add((tag, words))
            n = len(titles[tag, words])
            if n == 1 and not linked and tag in OWN_TAGS:
                article.update(words)
            elif (any(len(x) >= titles_needed(site_pages[h]) for h, x in site_titles[tag, words].items()) if by_site else n >= BOILERPLATE_TITLES) and words not in in_articles and (linked or tag in BOILERPLATE_TAGS):
                boilerplate.update(words * BOILERPLATE_TIMES)
                boilerplate_tags[tag] += 1
                continue
            if not linked:
                article_tags[tag] += 1
    article.pop("", 0)
    boilerplate.pop("", 0)
    return weights_of(article, boilerplate, article_tags, boilerplate_tags)


def seed_share(pages: int) -> float:
    """Times that fixed texts count among so many pages: once for each ``SAMPLE_PAGES``, for no page need hold what they stand for."""
    return max(1.0, pages / SAMPLE_PAGES)


def seed_counts(seeds: Iterable[str], pages: int) -> Counter:
    """Words of the texts that count as main body, among so many pages."""
    article: Counter = Counter()
    for text in seeds:
        article.update(LETTER_WORDS.findall(text.lower()))
    times = round(SEED_TIMES * seed_share(pages))
    return Counter({word: n * times for word, n in article.items()})


def weights_of(article: Counter, boilerplate: Counter, article_tags: Counter, boilerplate_tags: Counter) -> dict[str, float]:
    """Word and tag weights from counts."""
    tags = {f"<{tag}>": _tag_weight(article_tags[tag], article_tags.total(), boilerplate_tags[tag], boilerplate_tags.total()) for tag in BLOCK_TAGS}
    size = len(article.keys() | boilerplate.keys()) or 1
    total_a, total_b = sum(article.values()) or 1, sum(boilerplate.values()) or 1
    weights = {}
    for word in article.keys() | boilerplate.keys():
        a = (1 - UNSEEN_ARTICLE) * article[word] / total_a + UNSEEN_ARTICLE / size
        b = (1 - UNSEEN_BOILERPLATE) * boilerplate[word] / total_b + UNSEEN_BOILERPLATE / size
        weights[word] = max(-WEIGHT_LIMIT, min(WEIGHT_LIMIT, math.log(a / b)))
    return weights | tags


def _tag_weight(article: int, articles: int, boilerplate: int, boilerplates: int) -> float:
    """Log-odds of a tag in articles against boilerplate, with the cost that every tag has."""
    share = (articles + 1) / (articles + boilerplates + 2)
    odds = math.log((article + TAG_PRIOR * share) / (boilerplate + TAG_PRIOR * (1 - share))) - math.log(share / (1 - share))
    return max(-WEIGHT_LIMIT, min(WEIGHT_LIMIT, odds)) + TAG_COST


def unseen_weight() -> float:
    return min(WEIGHT_LIMIT, math.log(UNSEEN_ARTICLE / UNSEEN_BOILERPLATE))


class _Weights(dict):
    def __missing__(self, word: str) -> float:
        return unseen_weight()


class Extractor:
    """Finds the main body of a page by given word weights."""

    def __init__(self, weights: dict[str, float]):
        self.weights = _Weights(weights)
        self.unseen = unseen_weight()
        self.tags = {tag: weights.get(f"<{tag}>", TAG_COST) for tag in BLOCK_TAGS}

    def scores(self, page: list[Block], site: frozenset[str]) -> list[float]:
        weight = self.weights.__getitem__
        find = LETTER_WORDS.findall
        tag_weight = self.tags
        out = []
        texts = [None if b.tag in TABLE_TAGS else plain(b.raw) for b in page]
        names = [b.tag for b in page]
        headings = {" ".join(t.split()) for b, t in zip(page, texts, strict=True) if b.tag in HEADINGS}
        title = names.index("h1") if "h1" in names else names.index("h2") if "h2" in names else -1
        for i, (tag, raw, _) in enumerate(page):
            text = texts[i]
            if text is None:
                # Code has words of its own, none of which is known to boilerplate.
                out.append(tag_weight[tag] + (self.unseen * len(find(raw)) if tag == "pre" else 0.0))
                continue
            if tag == "li" and " ".join(text.split()) in headings:
                out.append(ENTRY_WEIGHT)
                continue
            if LINK_ON in raw and is_linked(raw):
                out.append(LINK_WEIGHT)
                continue
            if len(text) <= 80 and is_placeholder(text.strip()):
                out.append((TITLE_WEIGHT if i == title else tag_weight[tag]) + PLACEHOLDER_WEIGHT)
                continue
            words = find(text.lower())
            score = TITLE_WEIGHT if i == title else tag_weight[tag]
            if words:
                score += sum(map(weight, words))
                for w in site:
                    if w in words:
                        score -= weight(w) * words.count(w)
            elif tag in ("p", "li"):
                score -= 0.5 if text.strip() else 0.0
            out.append(score)
        return out

    def body(self, page: list[Block], url: str | None) -> list[int]:
        """Places (from 0) of the main body's blocks."""
        scores = self.scores(page, host_words(url))
        best, best_from, best_to = 0.0, 0, -1
        now, start = 0.0, 0
        for i, score in enumerate(scores):
            if now <= 0:
                now, start = 0.0, i
            now += (score if score > LOWEST else LOWEST) + BETWEEN
            if now > best:
                best, best_from, best_to = now, start, i
        return [i for i in range(best_from, best_to + 1) if scores[i] > 0]


def fit_on(results: DataFrame, sample_pages: int = SAMPLE_PAGES) -> dict[str, float]:
    """Fits the weights on at most ``sample_pages`` pages of ``results(result_id, url, html)``."""
    rows = smallest_hashes(results, "html <> ''", "result_id", sample_pages, "url", "html").toArrow()
    return fit(zip(rows.column("url").to_pylist(), map(blocks, rows.column("html").to_pylist()), strict=True))


def main_body(results: DataFrame, weights: dict[str, float]) -> DataFrame:
    """One row (result_id, block_no) for each main-body block of ``results(result_id, url, html)``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(weights)
        for batch in batches:
            ids: list[int] = []
            numbers: list[int] = []
            for rid, url, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = extractor.body(blocks(page), url)
                ids += [rid] * len(found)
                numbers += [i + 1 for i in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32())], ["result_id", "block_no"])

    return map_arrow(results.where("html <> ''").select("result_id", "url", "html"), find, "result_id long, block_no int")


def body_text(results: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(result_id, text) of each page of ``results(result_id, url, html)`` with html: the blocks of its main body, one a line; a page without one has empty text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(weights)
        for batch in batches:
            texts = []
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = blocks(page)
                texts.append("\n".join(" ".join(plain(found[i].raw).split()) for i in extractor.body(found, url)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["result_id", "text"])

    return map_arrow(results.where("html <> ''").select("result_id", "url", "html"), find, "result_id long, text string")
