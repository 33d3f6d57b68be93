"""Pages of template residue, filler, error messages and script notices.

Character n-gram models for filler, for error and script notices, for
unfilled placeholders and for natural prose are fitted on fixed seed texts and
on all pages: word weights of the main body are counted first (``whole_fit``),
then the n-grams of every body that they give. Every page is scored whole by
likelihood-ratio windows; its texts are found once, for fitting and scoring. Those for filler and notices (``WINDOW``
characters) run over the main body, and the share that they cover decides; a
page without main body is scored by all it shows, what it shows without
scripts included, and one that shows nothing at all is an empty shell. Those
for placeholders (``NARROW`` characters, over the characters and over their
kinds, for the names of fields are anyone's) run over the title and all text
outside code, in blocks or not; where they find something, the notation is
checked exactly (texts in which no notation stands at all are left out first). The flags of ``content_quality`` are weak evidence: a page
that has one is found from a slightly smaller share on.

Results for special input: NULL or empty html is never found (there is no
page to judge). Equal rows give equal results. Very long pages are scored in
full. A missing row of flags, or a NULL flag, changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.html_blocks import HEADINGS, blocks, blocks_and_rest, is_linked, noscript_of, plain, split_tags, title_of, without_code, without_title
from siltstone.llm.main_body import SEEDS, WORDS, Extractor, fit, seed_share
from siltstone.llm.placeholders import examples, has_placeholder
from siltstone.llm.residue_seeds import ERROR_TEXTS, FILLER_TEXTS, PROSE_TEXTS, SCRIPT_TEXTS
from siltstone.llm.whole_fit import fit_on_all
from siltstone.plans.lineage import keep
from siltstone.plans.shipping import map_arrow

GRAM = 4
BUCKETS = 1 << 16
#: Share of each model that is spread evenly, so that n-grams unknown to all models decide nothing.
SPREAD = 0.1
WINDOW, NARROW = 32, 8
#: Nats by which a narrow window must be likelier under the model of placeholders, and under that of their kinds of characters.
LIKE_PLACEHOLDER, OF_PLACEHOLDER_KIND = 15.0, 4.0
#: Characters around a window for placeholders that are checked with it; more than the longest placeholder.
AROUND = 100
#: Share of the body in residue windows from which a page is found, and from which it is if a flag speaks for it.
COVERAGE, FLAGGED_COVERAGE = 0.5, 0.45
#: A body from so many words on is natural prose for fitting.
PROSE_WORDS = 40
#: Bodies of failed requests (status 400 and more) up to so many words are error messages for fitting.
ERROR_WORDS = 60


class Models(NamedTuple):
    """Word weights of the main body; log-likelihood ratios against prose by n-gram bucket: of errors and filler, of placeholders, and of the kinds of characters in placeholders."""

    weights: dict[str, float]
    ratios: np.ndarray
    placeholder: np.ndarray
    kinds: np.ndarray


#: Bytes as the models see them: upper-case ASCII letters lowered, digits alike, white space as blanks.
_BYTES = bytes(ord(chr(i).lower()) if i < 128 and chr(i).isupper() else 48 if 48 <= i < 58 else 32 if i in (9, 10, 13) else i for i in range(256))


#: Kinds of characters: letters alike, digits alike, white space alike, other signs as they are.
_KINDS = bytes(97 if i >= 128 or chr(i).isalpha() else 48 if 48 <= i < 58 else 32 if i in (9, 10, 13) else i for i in range(256))


def gram_buckets(text: str | bytes, table: bytes = _BYTES) -> np.ndarray:
    """Bucket of each n-gram (of ``GRAM`` = 4) bytes."""
    data = np.frombuffer((text.encode("utf-8", "replace") if isinstance(text, str) else text).translate(table), np.uint8)
    if len(data) < GRAM:
        return np.zeros(0, np.uint32)
    wide = data.astype(np.uint32)
    value = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
    value *= np.uint32(0x9E3779B1)
    value ^= value >> np.uint32(15)
    value *= np.uint32(0x85EBCA6B)
    value >>= np.uint32(32 - BUCKETS.bit_length() + 1)
    return value


def _model(counts: np.ndarray) -> np.ndarray:
    return (1 - SPREAD) * counts / max(1, counts.sum()) + SPREAD / BUCKETS


def _counts(texts: Iterable[str], table: bytes = _BYTES) -> np.ndarray:
    return np.bincount(gram_buckets(" ".join(" ".join(texts).split()), table), minlength=BUCKETS)


class Shown(NamedTuple):
    """What a page shows, apart from code: the text around which a placeholder's notation stands (None if none does), the main body (None if there is none), and else what stands outside links.

    The body has one line for each block, without other white space; lines of headings begin with a tab.
    """

    fields: str | None
    body: str | None
    bare: str | None


def shown_of(page: str, url: str | None, extractor: Extractor) -> Shown:
    found, rest = blocks_and_rest(split_tags(page))
    outside = [x for x in (*(b.before for b in found), rest) if x and not x.isspace()]
    shown = without_code("\n".join([b.raw for b in found if b.tag != "pre"]))
    text = "\n".join([title_of(page), shown, *map(without_code, outside)])
    fields = text if has_placeholder(f"  {text}  ") else None
    body = extractor.body(found, url)
    if body:
        return Shown(fields, "\n".join([("\t" if found[i].tag in HEADINGS else "") + " ".join(plain(found[i].raw).split()) for i in body]), None)
    # Without main body: all that is shown outside links, and what is shown without scripts.
    bare = blocks_and_rest(split_tags(without_title(page)))
    texts = [plain(x) for x in (*(b.before for b in bare[0]), bare[1])]
    texts += [plain(b.raw) for b in found if not is_linked(b.raw) and b.tag in ("h1", "h2", "pre", "td")]
    texts += [plain(x) for x in noscript_of(page)]
    return Shown(fields, None, " ".join(" ".join(texts).split()))


#: Rows of the n-gram counts.
PROSE, PROSE_KINDS, ERRORS = range(3)


def gram_counts(bodies: Iterable[tuple[int | None, str | None]]) -> np.ndarray:
    """N-grams by bucket, a row for each of prose, its kinds of characters, and error messages, in (status_code, body) pairs."""
    counts = np.zeros((3, BUCKETS), np.int64)
    waiting: tuple[list[np.ndarray], ...] = ([], [], [])

    def add() -> None:
        for row, grams in zip(counts, waiting, strict=True):
            if grams:
                row += np.bincount(np.concatenate(grams), minlength=BUCKETS)
                grams.clear()

    size = 0
    for status, body in bodies:
        if body is None:
            continue
        words = len(WORDS.findall(body))
        text = " ".join(body.split())
        if status is not None and status >= 400:
            if words <= ERROR_WORDS:
                waiting[ERRORS].append(gram_buckets(text))
        elif words >= PROSE_WORDS:
            waiting[PROSE].append(gram_buckets(text))
            waiting[PROSE_KINDS].append(gram_buckets(text, _KINDS))
        size += len(text)
        if size > BUCKETS:
            add()
            size = 0
    add()
    return counts


def models_of(weights: dict[str, float], counts: np.ndarray, pages: int) -> Models:
    """Models from the word weights and the n-gram counts of so many pages; where there are none, the fixed texts alone make them."""
    share = seed_share(pages)
    base = np.log(_model(counts[PROSE] + share * _counts(PROSE_TEXTS)))
    errors = _model(counts[ERRORS] + share * _counts([*ERROR_TEXTS, *SCRIPT_TEXTS] * 3))
    ratios = np.stack([np.log(errors) - base, np.log(_model(_counts(FILLER_TEXTS))) - base]).astype(np.float32)
    unfilled = examples()
    kinds = np.log(_model(_counts(unfilled, _KINDS))) - np.log(_model(counts[PROSE_KINDS] + share * _counts(PROSE_TEXTS, _KINDS)))
    return Models(weights, ratios, (np.log(_model(_counts(unfilled))) - base).astype(np.float32), kinds.astype(np.float32))


def fit_models(pages: list[tuple[str | None, str | None, int | None]]) -> Models:
    """Models from (url, html, status_code) of pages in memory; without any page the fixed texts alone make them."""
    pages = [row for row in pages if row[1]]
    weights = fit(((url, blocks(page)) for url, page, _ in pages), SEEDS, by_site=True)
    extractor = Extractor(weights)
    return models_of(weights, gram_counts((status, shown_of(page, url, extractor).body) for url, page, status in pages), len(pages))


def _window_starts(ratios: np.ndarray, width: int, least: float = 0.0) -> np.ndarray:
    """Starts of the windows of ``width`` n-grams whose ratios sum up to more than ``least`` nats."""
    sums = np.cumsum(ratios, dtype=np.float64)
    window = sums[width - 1 :].copy()
    window[1:] -= sums[: len(ratios) - width]
    return np.flatnonzero(window > least)


def residue_share(text: str, ratios: np.ndarray) -> float:
    """Share of the text that lies in windows for which an error or filler model is likelier than prose."""
    grams = gram_buckets(text)
    n = len(grams)
    if not n:
        return 0.0
    width = min(WINDOW, n)
    best = 0
    for row in ratios:
        starts = _window_starts(row[grams], width)
        if len(starts):
            # Windows have one width, so the covered length is the sum of the steps, each at most a window.
            best = max(best, int(np.minimum(np.diff(starts), width).sum()) + width)
    return best / n


def unfilled_parts(text: str, models: Models) -> list[str]:
    """Parts of a text around windows for which a model of placeholders is likelier than prose."""
    data = f"  {text}  ".encode("utf-8", "replace")
    grams = gram_buckets(data)
    if not len(grams):
        return []
    width = min(NARROW, len(grams))
    starts = np.union1d(_window_starts(models.placeholder[grams], width, LIKE_PLACEHOLDER), _window_starts(models.kinds[gram_buckets(data, _KINDS)], width, OF_PLACEHOLDER_KIND))
    if not len(starts):
        return []
    edges = np.flatnonzero(np.diff(starts) > 2 * AROUND) + 1
    firsts, lasts = starts[np.concatenate(([0], edges))], starts[np.concatenate((edges - 1, [len(starts) - 1]))]
    return [data[max(0, a - AROUND) : b + width + AROUND].decode("utf-8", "ignore") for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True)]


def shown_score(shown: Shown, models: Models) -> float:
    """How much of what a page shows is residue, from 0 to 1: 1 if it is an unfilled placeholder or nothing at all, else its covered share."""
    if shown.fields is not None and any(map(has_placeholder, unfilled_parts(shown.fields, models))):
        return 1.0
    if shown.body is None:
        return residue_share(shown.bare, models.ratios) if WORDS.search(shown.bare) else 1.0
    # The title may be the article's whose place the text has taken, or part of the message.
    whole = " ".join(shown.body.split())
    text = " ".join(x for x in shown.body.split("\n") if not x.startswith("\t")) if "\t" in shown.body else whole
    text = " ".join(text.split()) or whole
    share = residue_share(text, models.ratios)
    return max(share, residue_share(whole, models.ratios)) if 0 < share < COVERAGE and text is not whole else share


def residue_score(page: str, url: str | None, models: Models, extractor: Extractor) -> float:
    return shown_score(shown_of(page, url, extractor), models)


def is_residue(page: str, url: str | None, models: Models, extractor: Extractor) -> bool:
    return residue_score(page, url, models, extractor) >= COVERAGE


def shown_texts(results: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(result_id, status_code, fields, body, bare) of each page of ``results(result_id, url, html, status_code)`` with html; see :class:`Shown`."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(weights)
        for batch in batches:
            rows = [shown_of(page, url, extractor) for url, page in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            texts = [pa.array([row[i] for row in rows], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *texts], ["result_id", "status_code", *Shown._fields])

    pages = results.where("html <> ''").select(F.col("result_id").cast("long"), F.col("status_code").cast("int"), "url", "html")
    return map_arrow(pages, find, "result_id long, status_code int, fields string, body string, bare string")


def fit_models_on(results: DataFrame) -> Models:
    """Fits on all pages of ``results(result_id, url, html, status_code)``."""
    return fit_and_show(results)[0]


def fit_and_show(results: DataFrame) -> tuple[Models, DataFrame]:
    """Models fitted on all pages of ``results(result_id, url, html, status_code)``, and what the pages show, kept for scoring."""
    pages, weights = fit_on_all(results)
    shown = keep(shown_texts(results, weights))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = gram_counts(pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        models, buckets = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(models, pa.int32()), pa.array(buckets, pa.int32()), pa.array(counts[models, buckets], pa.int64())], ["model", "bucket", "n"])

    counted = map_arrow(shown.where("body IS NOT NULL").select("status_code", "body"), count, "model int, bucket int, n long").groupBy("model", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((3, BUCKETS), np.int64)
    counts[counted.column("model").to_numpy(), counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    return models_of(weights, counts, pages), shown


def residue_scores(shown: DataFrame, models: Models, least: float = 0.0) -> DataFrame:
    """(result_id, score) of each page of :func:`shown_texts` with a score of ``least`` or more."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, *texts = (batch.column(i).to_pylist() for i in range(4))
            rows = [(rid, shown_score(Shown(*row), models)) for rid, *row in zip(ids, *texts, strict=True)]
            rows = [r for r in rows if r[1] >= least]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64())], ["result_id", "score"])

    return map_arrow(shown.select("result_id", *Shown._fields), find, "result_id long, score double")


def residue_pages(results: DataFrame, models: Models, quality: DataFrame | None = None) -> DataFrame:
    """One row (result_id) for each page of ``results(result_id, url, html, status_code)`` that is residue; ``quality(result_id, has_noscript_warning, has_loading_indicators)`` may speak for it."""
    return residue_shown(shown_texts(results, models.weights), models, quality)


def residue_shown(shown: DataFrame, models: Models, quality: DataFrame | None = None) -> DataFrame:
    """The same of what pages show (:func:`shown_texts`). Only the ids of pages that come near meet the flags."""
    if quality is None:
        return residue_scores(shown, models, COVERAGE).select("result_id")
    flagged = quality.where("has_noscript_warning OR has_loading_indicators").select("result_id").distinct().withColumn("_flag", F.lit(True))
    near = residue_scores(shown, models, FLAGGED_COVERAGE).join(flagged, "result_id", "left")
    return near.where((F.col("score") >= COVERAGE) | F.col("_flag")).select("result_id")
