"""Evaluation passages that stand in a corpus: q-gram lemma filter and banded alignment.

Texts become their words (maximal runs of letters or digits, lower-cased)
joined by blanks. A shared run of ``min_words`` words is at least as long as
the shortest such run of the passages, so by the q-gram lemma it shares at
least ``length + 1 - q * (edits + 1)`` q-grams whose diagonals (place in the document
less place in the passage) fall into one band. Bands overlap by half, so no
run is split between two, and within a band hits that do not overlap are
stretches of their own. What meets the bound is aligned word by word within
the band: the longest run of equal words that needs at most ``edits`` changed,
added or left out words decides. With ``edits`` 0 that is an unbroken run.

All passages are one stated query set: they are held by every task, in blocks
of at most ``BLOCK_BYTES`` bytes; a larger set takes several passes over the corpus.

Results for special input: NULL or empty text or passage shares nothing;
passages under ``min_words`` words cannot be found; equal documents each get
their own rows; an empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.main_body import WORDS
from siltstone.plans.shipping import map_arrow

MIN_WORDS = 13
#: Bounds of the q-gram length, and how many q-grams a run should share at least.
MIN_Q, MAX_Q, MARGIN = 8, 40, 8
EDITS = 0
#: Width of a diagonal band in bytes; half of it is the step between bands.
BAND = 16
BLOCK_BYTES = 8_000_000
_FILTER_BITS = 22
#: Bytes of text that are looked up at once.
_CHUNK = 1 << 21


class Passages(NamedTuple):
    """Passages by their q-grams; ``q`` is as long as the shortest run of words allows, ``bound`` the q-grams that run must share."""

    q: int
    bound: int
    ids: list[int]
    texts: list[bytes]
    known: np.ndarray
    grams: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    places: np.ndarray


def words_text(text: str) -> bytes:
    return " ".join(WORDS.findall(text.lower())).encode("utf-8", "replace")


def gram_keys(data: np.ndarray, q: int) -> np.ndarray:
    """64-bit key of each run of ``q`` bytes, a multiple of 8."""
    if len(data) < q:
        return np.zeros(0, np.uint64)
    value = data[: len(data) - 1].astype(np.uint64)
    value |= data[1:].astype(np.uint64) << np.uint64(8)
    value = value[:-2] | value[2:] << np.uint64(16)
    value = value[:-4] | value[4:] << np.uint64(32)
    count = len(data) - q + 1
    key = value[:count].copy()
    for k in range(8, q, 8):
        key *= np.uint64(0x9E3779B97F4A7C15)
        key ^= value[k : k + count]
    key *= np.uint64(0xC2B2AE3D27D4EB4F)
    return key


def index_passages(passages: list[tuple[int, str | None]], min_words: int = MIN_WORDS, edits: int = EDITS) -> Passages:
    ids, texts, grams, items, places = [], [], [], [], []
    shortest = 1 << 30
    for item, passage in passages:
        text = words_text(passage or "")
        ends = np.append(np.flatnonzero(np.frombuffer(text, np.uint8) == 32), len(text))
        if len(ends) < min_words:
            continue
        starts = np.concatenate(([0], ends[:-1] + 1))
        shortest = min(shortest, int((ends[min_words - 1 :] - starts[: len(ends) - min_words + 1]).min()))
        ids.append(item)
        texts.append(text)
    q = max(MIN_Q, min(MAX_Q, (shortest - MARGIN) // (edits + 1) // 8 * 8))
    bound = max(1, shortest + 1 - q * (edits + 1))
    for number, text in enumerate(texts):
        keys = gram_keys(np.frombuffer(text, np.uint8), q)
        grams.append(keys)
        items.append(np.full(len(keys), number))
        places.append(np.arange(len(keys)))
    all_keys = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
    order = np.argsort(all_keys, kind="stable")
    unique, starts = np.unique(all_keys[order], return_index=True)
    known = np.zeros(1 << _FILTER_BITS, bool)
    known[all_keys >> np.uint64(64 - _FILTER_BITS)] = True
    gather = lambda x: np.concatenate(x)[order] if x else np.zeros(0, np.int64)
    return Passages(q, bound, ids, texts, known, unique, np.append(starts, len(all_keys)), gather(items), gather(places))


def longest_run(a: list[bytes], b: list[bytes], band: int) -> int:
    """Longest run of equal words on the diagonals within ``band`` of the main one."""
    best = 0
    for diagonal in range(-band, band + 1):
        run = 0
        for x, y in zip(a[max(0, diagonal) :], b[max(0, -diagonal) :], strict=False):
            run = run + 1 if x == y else 0
            if run > best:
                best = run
    return best


def edited_run(a: list[bytes], b: list[bytes], band: int, edits: int) -> int:
    """Most equal words of a run that needs at most ``edits`` changed, added or left out words, aligned within ``band`` of the main diagonal.

    ``before[d][k]`` is the best run that ends at the place before on diagonal d with k edits; it begins anew wherever that is better.
    """
    width = 2 * band + 1
    before = [[0] * (edits + 1) for _ in range(width)]
    best = 0
    for i, word in enumerate(a):
        now = [[0] * (edits + 1) for _ in range(width)]
        for d in range(width):
            j = i + d - band
            if not 0 <= j < len(b):
                continue
            for k in range(edits + 1):
                if word == b[j]:
                    run = before[d][k] + 1
                else:
                    run = before[d][k - 1] if k else 0
                if k:
                    if d + 1 < width:
                        run = max(run, before[d + 1][k - 1])  # a word of the text more
                    if d:
                        run = max(run, now[d - 1][k - 1])  # a word of the passage more
                now[d][k] = run
                if run > best:
                    best = run
        before = now
    return best


def _aligned(text: bytes, passage: bytes, first: int, last: int, at_first: int, at_last: int, edits: int, reach: int) -> int:
    """Longest run where ``text[first:last]`` lies over ``passage[at_first:at_last]``, up to ``reach`` bytes around it; cut words are completed."""
    back = min(reach, first, at_first)
    first, at_first = first - back, at_first - back
    last, at_last = min(len(text), last + reach), min(len(passage), at_last + reach)
    first, at_first = text.rfind(b" ", 0, first + 1) + 1, passage.rfind(b" ", 0, at_first + 1) + 1
    end, at_end = text.find(b" ", last), passage.find(b" ", at_last)
    a = text[first : end if end >= 0 else len(text)].split(b" ")
    b = passage[at_first : at_end if at_end >= 0 else len(passage)].split(b" ")
    band = BAND // 2 + edits + 1
    return edited_run(a, b, band, edits) if edits else longest_run(a, b, band)


def find_leaks(texts: list[bytes], index: Passages, min_words: int = MIN_WORDS, edits: int = EDITS) -> list[tuple[int, int]]:
    """(number of text, number of passage) of each leak."""
    if not index.ids:
        return []
    q, bound = index.q, index.bound
    joined = b"\n".join(texts)
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    data = np.frombuffer(joined, np.uint8)
    at_parts, key_parts = [], []
    for start in range(0, max(1, len(data)), _CHUNK):
        keys = gram_keys(data[start : start + _CHUNK + q - 1], q)
        hit = np.flatnonzero(index.known[keys >> np.uint64(64 - _FILTER_BITS)])
        at_parts.append(hit + start)
        key_parts.append(keys[hit])
    at, keys = np.concatenate(at_parts), np.concatenate(key_parts)
    slot = np.minimum(np.searchsorted(index.grams, keys), len(index.grams) - 1)
    real = index.grams[slot] == keys
    at, slot = at[real], slot[real]
    count = index.starts[slot + 1] - index.starts[slot]
    at_each = np.repeat(at, count)
    entry = np.arange(len(at_each)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(index.starts[slot], count)
    item, place = index.items[entry], index.places[entry]
    doc = np.searchsorted(offsets, at_each, side="right") - 1
    inside = at_each - offsets[doc]
    blanks = np.concatenate(([0], np.cumsum(data == 32, dtype=np.int32)))
    diagonal = inside - place + (1 << 20)
    found: set[tuple[int, int]] = set()
    for shift in (0, BAND // 2):
        band = (diagonal + shift) // BAND
        order = np.lexsort((inside, band, item, doc))
        d, i, b = doc[order], item[order], band[order]
        change = (np.diff(d) != 0) | (np.diff(i) != 0) | (np.diff(b) != 0)
        if not edits:
            # A run without edits has a q-gram at each byte, so hits that do not overlap are different stretches.
            change |= np.diff(inside[order]) > q
        change = np.flatnonzero(change) + 1
        if not len(order):
            return []
        starts, ends = np.concatenate(([0], change)), np.append(change, len(order))
        enough = ends - starts >= bound
        # A region must also hold enough words.
        spot = at_each[order]
        enough &= blanks[np.minimum(spot[ends - 1] + q, len(data))] - blanks[spot[starts]] >= min_words - 1 - edits
        for s, e in zip(starts[enough], ends[enough], strict=True):
            key = (int(d[s]), int(i[s]))
            if key in found:
                continue
            own = order[s:e]
            spots = place[own]
            run = _aligned(texts[key[0]], index.texts[key[1]], int(inside[own[0]]), int(inside[own[-1]]) + q, int(spots.min()), int(spots.max()) + q, edits, (edits + 1) * q if edits else 0)
            if run >= min_words:
                found.add(key)
    return sorted(found)


def leaked_items(documents: DataFrame, passages: DataFrame, min_words: int = MIN_WORDS, block_bytes: int = BLOCK_BYTES, edits: int = EDITS) -> DataFrame:
    """One row (doc_id, item_id) for each document of ``documents(doc_id, text)`` and item of ``passages(item_id, passage)`` that share a run of ``min_words`` equal words with at most ``edits`` edits.

    Passages are spread over as many blocks as their bytes ask for, by a hash of
    their text, so no task sees them all while they are divided; one block at a time is on the driver.
    """
    spark = documents.sparkSession
    items = passages.where("passage IS NOT NULL").select("item_id", "passage").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("passage")), F.lit(0))).first()[0]
    count = -(-size // block_bytes)
    out = None
    for number in range(count):
        own = items if count == 1 else items.where(F.pmod(F.xxhash64("passage", "item_id"), F.lit(count)) == number)
        index = spark.sparkContext.broadcast(index_passages([tuple(r) for r in own.collect()], min_words, edits))
        found = _search(documents, index, min_words, edits)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return documents.select("doc_id").where("false").select("doc_id", F.lit(0).cast("long").alias("item_id"))
    return out


def _search(documents: DataFrame, index, min_words: int, edits: int) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages: Passages = index.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [words_text(t) for t in batch.column(1).to_pylist()]
            pairs = sorted({(ids[d], passages.ids[i]) for d, i in find_leaks(texts, passages, min_words, edits)})
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in pairs], pa.int64()), pa.array([i for _, i in pairs], pa.int64())], ["doc_id", "item_id"])

    return map_arrow(documents.where("text <> ''").select("doc_id", "text"), search, "doc_id long, item_id long")
