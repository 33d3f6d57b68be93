"""Lines repeated across one site's pages.

The words of each line are cut into content-defined chunks: a rolling hash
over ``SPAN`` words ends a chunk where its low bits are zero, so equal word
runs give equal chunks wherever they stand. What has to be cut are blocks, so
a line's ends are cut points too, and a chunk's hash tells whether it begins
or ends its line: a short line is one chunk that no part of a longer line equals.
Distinct pages (normalised urls) are counted by site and chunk. A line all of
whose chunks are excessive is a candidate; a line of one chunk has its exact
count thereby, and for lines of several chunks an exact count of the whole
line, among candidates only, decides.

A line is a block h1-h6, p or li with at least ``MIN_WORDS`` words of letters,
lower-cased; it is cut if it stands on ``MIN_PAGES`` and on ``MIN_SHARE`` of
the site's pages.

Results for special input: NULL or empty html and urls without host give no
lines and do not count as pages; equal rows and repeated fetches of one url
count once; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.urls import normalised_address
from siltstone.llm.html_blocks import LINE_TAGS, blocks, plain
from siltstone.llm.main_body import LETTER_WORDS
from siltstone.plans.lineage import keep
from siltstone.plans.shipping import map_arrow

MIN_WORDS = 3
MIN_PAGES = 5
MIN_SHARE = 0.1
#: Words under the rolling hash, and how often (once in so many places) it ends a chunk.
SPAN = 4
CHUNK_EVERY = 16
_BASE, _MASK = 0x100000001B3, (1 << 64) - 1
_DROP = pow(_BASE, SPAN, 1 << 64)

_HASHES: dict[str, int] = {}


def _hash(word: str) -> int:
    if len(_HASHES) > 200_000:
        _HASHES.clear()
    value = _HASHES[word] = xxhash.xxh64_intdigest(word)
    return value


def chunk_ends(words: list[str]) -> list[int]:
    """Ends of the content-defined chunks of a line; the last is the line's length."""
    get = _HASHES.get
    each = [get(w) or _hash(w) for w in words]
    ends = []
    rolling = 0
    for i, value in enumerate(each):
        rolling = rolling * _BASE + value
        if i >= SPAN:
            rolling -= _DROP * each[i - SPAN]
        rolling &= _MASK
        if i >= SPAN - 1 and (rolling >> 40) % CHUNK_EVERY == 0 and i + SPAN < len(each):
            ends.append(i + 1)
    ends.append(len(each))
    return ends


def chunk_hashes(words: list[str]) -> list[int]:
    """Signed 64-bit hash of each chunk of a line, its seed telling whether the chunk begins (1) or ends (2) the line."""
    start = 0
    out = []
    for end in chunk_ends(words):
        edges = (start == 0) | (end == len(words)) << 1
        out.append(xxhash.xxh3_64_intdigest(" ".join(words[start:end]), edges) - (1 << 63))
        start = end
    return out


_SCHEMA = "result_id long, site long, page long, line_nos array<int>, lines array<long>, chunks array<array<long>>"


def page_lines(results: DataFrame) -> DataFrame:
    """One row for each page of ``results(result_id, url, html)``: its lines (block numbers), line hashes and chunk hashes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, list[int]] | None] = {}
        for batch in batches:
            numbers, hashes, chunks = [], [], []
            for page in batch.column(3).to_pylist():
                of_page, of_lines, of_chunks = [], [], []
                for i, block in enumerate(blocks(page)):
                    if block.tag not in LINE_TAGS:
                        continue
                    raw = block.raw
                    if raw in known:
                        line = known[raw]
                    else:
                        words = LETTER_WORDS.findall(plain(raw).lower())
                        line = None
                        if len(words) >= MIN_WORDS:
                            cut = chunk_hashes(words)
                            line = (cut[0] if len(cut) == 1 else xxhash.xxh3_64_intdigest(" ".join(words), 3) - (1 << 63), cut)
                        if len(raw) < 200:
                            if len(known) > 50_000:
                                known.clear()
                            known[raw] = line
                    if line:
                        of_page.append(i + 1)
                        of_lines.append(line[0])
                        of_chunks.append(line[1])
                numbers.append(of_page)
                hashes.append(of_lines)
                chunks.append(of_chunks)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(numbers, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64())), pa.array(chunks, pa.list_(pa.list_(pa.int64())))],
                ["result_id", "site", "page", "line_nos", "lines", "chunks"],
            )

    address = normalised_address(F.col("url"))
    pages = results.where("html <> ''").select("result_id", address["host"].alias("host"), address["url"].alias("address"), "html").where("host <> ''")
    return map_arrow(pages.select("result_id", F.xxhash64("host").alias("site"), F.xxhash64("address").alias("page"), "html"), make, _SCHEMA)


def _excessive(marked: DataFrame, sizes: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    """(site, mark) on enough of the site's distinct pages. Two aggregates, each combined before its shuffle; no key is gathered."""
    on = marked.distinct().groupBy("site", "mark").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    return on.join(sizes, "site").where(F.col("pages") >= min_share * F.col("site_pages")).select("site", "mark")


def repeated_lines(results: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, splits: int = 16) -> DataFrame:
    """One row (result_id, block_no) for each block whose line is excessive on its site.

    The excessive marks of one site are few (at most the lines of an average
    page divided by ``min_share``), so they go to the site's pages as one
    array, repeated for ``splits`` parts of a site: a hot site is spread over
    as many tasks. The array is compared once for each page, not for each line.
    """
    lines = keep(page_lines(results))
    sizes = lines.select("site", "page").distinct().groupBy("site").agg(F.count("*").alias("site_pages"))
    chunk_marks = lines.select("site", "page", F.explode(F.array_distinct(F.flatten("chunks"))).alias("mark"))
    bad = _excessive(chunk_marks, sizes, min_pages, min_share).groupBy("site").agg(F.collect_set("mark").alias("bad"))
    salted = lines.withColumn("part", F.pmod(F.xxhash64("result_id"), F.lit(splits)).cast("int"))
    bad_parts = bad.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    joined = salted.join(bad_parts, ["site", "part"]).withColumn("rare", F.array_except(F.flatten("chunks"), "bad")).drop("bad")
    candidates = (
        joined.select("result_id", "site", "page", "rare", F.explode(F.arrays_zip("line_nos", "lines", "chunks")).alias("x"))
        .where(~F.arrays_overlap("x.chunks", "rare"))
        .select("result_id", "site", "page", F.col("x.line_nos").alias("block_no"), F.col("x.lines").alias("mark"), (F.size("x.chunks") > 1).alias("several"))
    )
    single = candidates.where(~F.col("several")).select("result_id", "block_no")
    several = candidates.where("several")
    whole = _excessive(several.select("site", "page", "mark"), sizes, min_pages, min_share)
    kept = whole.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    exact = several.withColumn("part", F.pmod(F.xxhash64("result_id"), F.lit(splits)).cast("int")).join(kept, ["site", "mark", "part"]).select("result_id", "block_no")
    return single.unionByName(exact)


def without_repeated_lines(results: DataFrame, found: DataFrame) -> DataFrame:
    """(result_id, removed, text) of each page of ``results(result_id, html)``: the texts of its blocks, one in a row, without those of ``found(result_id, block_no)``.

    Pages without html give no row; a page all of whose blocks were found has empty text.
    """
    cut_from = found.groupBy("result_id").agg(F.collect_set("block_no").alias("cut"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, texts = [], []
            for page, cut in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                gone = set(cut or ())
                removed.append(len(gone))
                texts.append("\n".join(" ".join(plain(b.raw).split()) for i, b in enumerate(blocks(page)) if i + 1 not in gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int32()), pa.array(texts, pa.string())], ["result_id", "removed", "text"])

    pages = results.where("html <> ''").select("result_id", "html").join(cut_from, "result_id", "left").select("result_id", "html", "cut")
    return map_arrow(pages, make, "result_id long, removed int, text string")
