"""Near-duplicate pages by a prefix-tree join over word n-grams.

A page takes part with the set of ``GRAM`` consecutive words of its main body.
Sets are put into one global order (rare n-grams first, by counts over all
pages), and only the first part of each set, which any similar set must meet,
goes into the tree. A node of the tree holds the sets that pass through one
n-gram; it is traversed by set size, and a branch ends where sizes or the
remaining lengths can no longer reach the similarity. Pairs that come to a
node over the same edge have met at the node before it and are not formed
again. What remains is bounded by parity bitmaps and then compared exactly.

Equal sets are one node of the join, so any number of copies costs no pairs.
A node that could exceed ``NODE_ROWS`` rows is cut into blocks that meet pair
by pair in different tasks; nothing is capped.

N-grams are 32-bit hashes: two of a pair's few hundred n-grams collide with a
probability of about one in a hundred thousand, and then change the overlap by one.

Results for special input: NULL or empty html and bodies under ``MIN_WORDS``
words take no part; equal rows under different ids are duplicates of each
other; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.html_blocks import blocks, plain
from siltstone.llm.main_body import WORDS, Extractor
from siltstone.plans.components import connected_components
from siltstone.plans.lineage import cut, keep
from siltstone.plans.shipping import group_arrow, map_arrow

GRAM = 3
SIMILARITY = 0.7
MIN_WORDS = 50
#: Buckets of the n-gram counts: a fixed size at any scale. Counts only set the order; shared buckets lose nothing.
COUNT_BUCKETS = 1 << 20
_SLOTS = 64
#: A node of the tree with more rows is cut into blocks.
NODE_ROWS = 50_000
#: Pairs that a task holds before it passes them on.
PAIRS_HELD = 1 << 20
#: Members of a class that pair up in one task.
CLASS_PART = 2_000
BITS = 512

_WORD_HASHES: dict[str, int] = {}


def _word_hash(word: str) -> int:
    if len(_WORD_HASHES) > 200_000:
        _WORD_HASHES.clear()
    value = _WORD_HASHES[word] = xxhash.xxh64_intdigest(word)
    return value


def gram_set(words: list[str], gram: int = GRAM) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the runs of ``gram`` words."""
    get = _WORD_HASHES.get
    each = np.array([get(w) or _word_hash(w) for w in words], np.uint64)
    count = len(each) - gram + 1
    if count < 1:
        return np.zeros(0, np.uint32)
    value = each[:count].copy()
    for k in range(1, gram):
        value *= np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
        value += each[k : count + k]
    value *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((value >> np.uint64(32)).astype(np.uint32))


def parity_bits(grams: np.ndarray) -> np.ndarray:
    """``BITS`` parities as 64-bit integers: two sets differ in at least as many n-grams as in parities."""
    at = (grams * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS.bit_length() + 1)
    return np.packbits(np.bincount(at, minlength=BITS).astype(np.uint8) & 1).view(np.int64)


_BODY_SCHEMA = "result_id long, sig long, n int, grams binary, " + ", ".join(f"b{i} long" for i in range(BITS // 64))


def bodies(results: DataFrame, weights: dict[str, float], gram: int = GRAM, min_words: int = MIN_WORDS) -> DataFrame:
    """N-gram sets of main bodies of ``results(result_id, url, html)``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(weights)
        for batch in batches:
            ids, sigs, sizes, sets, bits = [], [], [], [], []
            for rid, url, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = blocks(page)
                words = WORDS.findall(" ".join([plain(found[i].raw) for i in extractor.body(found, url)]).lower())
                if len(words) < min_words:
                    continue
                grams = gram_set(words, gram)
                data = grams.tobytes()
                ids.append(rid)
                sigs.append(xxhash.xxh3_64_intdigest(data) - (1 << 63))
                sizes.append(len(grams))
                sets.append(data)
                bits.append(parity_bits(grams))
            table = np.stack(bits) if bits else np.zeros((0, BITS // 64), np.int64)
            columns = [pa.array(ids, pa.int64()), pa.array(sigs, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sets, pa.binary())]
            columns += [pa.array(np.ascontiguousarray(table[:, i])) for i in range(BITS // 64)]
            yield pa.RecordBatch.from_arrays(columns, ["result_id", "sig", "n", "grams", *(f"b{i}" for i in range(BITS // 64))])

    return map_arrow(results.where("html <> ''").select("result_id", "url", "html"), make, _BODY_SCHEMA)


def gram_counts(sets: DataFrame) -> np.ndarray:
    """Number of sets by n-gram bucket, over all rows of ``sets(grams)``; ``COUNT_BUCKETS`` numbers at any scale."""
    width = COUNT_BUCKETS // _SLOTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNT_BUCKETS, np.int64)
        for batch in batches:
            data = b"".join(batch.column(0).to_pylist())
            counts += np.bincount(np.frombuffer(data, np.uint32) & np.uint32(COUNT_BUCKETS - 1), minlength=COUNT_BUCKETS)
        slots = [(s, counts[s * width : (s + 1) * width]) for s in range(_SLOTS)]
        slots = [(s, c) for s, c in slots if c.any()]
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in slots], pa.int32()), pa.array([c.tobytes() for _, c in slots], pa.binary())], ["slot", "counts"])

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for data in table.column("counts").to_pylist():
            total += np.frombuffer(data, np.int64)
        return pa.table({"slot": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    rows = group_arrow(map_arrow(sets.select("grams"), count, "slot int, counts binary").groupBy("slot"), add, "slot int, counts binary").collect()
    out = np.zeros(COUNT_BUCKETS, np.int64)
    for slot, data in rows:
        out[slot * width : (slot + 1) * width] = np.frombuffer(data, np.int64)
    return np.minimum(out, 0xFFFFFFFF).astype(np.uint32)


_TREE_SCHEMA = "gram long, block int, sig long, n int, pos int, edge int"


def tree_rows(sets: DataFrame, counts: np.ndarray, similarity: float = SIMILARITY, node_rows: int = NODE_ROWS) -> DataFrame:
    """The sets' places in the prefix tree: one row for each n-gram of the prefix that another set may have.

    ``edge`` is the n-gram before it in the set's order.
    """
    shared = sets.sparkSession.sparkContext.broadcast(counts)  # COUNT_BUCKETS numbers, whatever the input

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        seen: set[int] = set()
        for batch in batches:
            parts: list[tuple[np.ndarray, ...]] = []
            for sig, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if sig in seen:
                    continue
                seen.add(sig)
                grams = np.frombuffer(data, np.uint32)
                n = len(grams)
                count = counts[grams & np.uint32(COUNT_BUCKETS - 1)]
                order = np.argsort(count.astype(np.uint64) << np.uint64(32) | grams)
                first = order[: n - math.ceil(similarity * n - 1e-9) + 1]
                keys, often = grams[first], count[first]
                edges = np.concatenate((np.zeros(1, np.uint32), keys[:-1])).view(np.int32)
                keep = np.flatnonzero(often > 1)
                if len(keep):
                    parts.append((keys[keep].astype(np.int64), often[keep], np.full(len(keep), sig), np.full(len(keep), n, np.int32), keep.astype(np.int32), edges[keep]))
            if not parts:
                continue
            gram, often, sig, n, pos, edge = (np.concatenate(x) for x in zip(*parts, strict=True))
            block = np.zeros(len(gram), np.int32)
            hot = np.flatnonzero(often > node_rows)
            if len(hot):
                splits = np.minimum(-(-often[hot].astype(np.int64) // node_rows), 1 << 14)
                own = _split_of(sig[hot], splits)
                times = np.repeat(np.arange(len(hot)), splits)
                other = np.arange(len(times)) - np.repeat(np.cumsum(splits) - splits, splits)
                low, high = np.minimum(own[times], other), np.maximum(own[times], other)
                more = hot[times]
                cold = np.setdiff1d(np.arange(len(gram)), hot, assume_unique=True)
                gram, sig, n, pos, edge = (np.concatenate((x[cold], x[more])) for x in (gram, sig, n, pos, edge))
                # Block 0 is an uncut node; the splits of a cut node follow from its n-gram alone.
                block = np.concatenate((block[cold], (low << 15 | high).astype(np.int32) + 1))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram, block, sig, n, pos, edge)], ["gram", "block", "sig", "n", "pos", "edge"])

    return map_arrow(sets.select("sig", "grams"), place, _TREE_SCHEMA)


def _split_of(sig: np.ndarray, splits: np.ndarray) -> np.ndarray:
    return ((sig.astype(np.uint64) >> np.uint64(17)) % splits.astype(np.uint64)).astype(np.int64)


def node_pairs(gram, block, sig, n, pos, edge, similarity: float, splits=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets that meet in a node, of rows ordered by (gram, block, n, sig), about ``PAIRS_HELD`` at a time.

    Step d compares each row with the d-th after it; a row leaves the
    traversal once the sizes are too far apart, so all nodes are traversed together.
    """
    left, right, held = [], [], 0
    rows = np.arange(len(gram))
    step = 0
    size = len(gram)
    while len(rows):
        step += 1
        rows = rows[rows + step < size]
        other = rows + step
        on = (gram[rows] == gram[other]) & (block[rows] == block[other]) & (n[rows] >= similarity * n[other] - 1e-9)
        rows, other = rows[on], other[on]
        need = np.ceil(similarity / (1 + similarity) * (n[rows] + n[other]) - 1e-9)
        keep_ = (np.minimum(n[rows] - pos[rows], n[other] - pos[other]) >= need) & ((edge[rows] != edge[other]) | (pos[rows] == 0) | (pos[other] == 0)) & (sig[rows] != sig[other])
        if splits is not None:
            cut = block[rows] > 0
            across = (block[rows] - 1 >> 15) != (block[rows] - 1 & 0x7FFF)
            keep_ &= ~(cut & across & (_split_of(sig[rows], splits[rows]) == _split_of(sig[other], splits[rows])))
        left.append(np.minimum(sig[rows[keep_]], sig[other[keep_]]))
        right.append(np.maximum(sig[rows[keep_]], sig[other[keep_]]))
        held += len(left[-1])
        if held >= PAIRS_HELD:
            yield np.concatenate(left), np.concatenate(right)
            left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def tree_pairs(rows: DataFrame, counts: np.ndarray, similarity: float = SIMILARITY, node_rows: int = NODE_ROWS) -> DataFrame:
    """Candidate pairs (sig_a, sig_b) from the tree's rows, each at least once."""
    shared = rows.sparkSession.sparkContext.broadcast(counts)
    columns = ["gram", "block", "sig", "n", "pos", "edge"]

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value

        def meet(data: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            gram, block = data[0], data[1]
            splits = None
            if block.any():
                splits = np.maximum(1, -(-counts[gram.astype(np.uint32) & np.uint32(COUNT_BUCKETS - 1)].astype(np.int64) // node_rows))
                splits = np.minimum(splits, 1 << 14)
            for a, b in node_pairs(*data, similarity, splits):
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
                yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], ["sig_a", "sig_b"])

        held: list[list[np.ndarray]] = []
        for batch in batches:
            data = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            if not len(data[0]):
                continue
            changes = np.flatnonzero((np.diff(data[0]) != 0) | (np.diff(data[1]) != 0))
            if held and (held[-1][0][-1] != data[0][0] or held[-1][1][-1] != data[1][0]):
                yield from meet([np.concatenate(x) for x in zip(*held, strict=True)])
                held = []
            if not len(changes):
                held.append(data)
                continue
            end = changes[-1] + 1
            held.append([x[:end] for x in data])
            yield from meet([np.concatenate(x) for x in zip(*held, strict=True)])
            held = [[x[end:] for x in data]]
        if held:
            yield from meet([np.concatenate(x) for x in zip(*held, strict=True)])

    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(parts, "gram", "block").sortWithinPartitions("gram", "block", "n", "sig").select(*columns)
    return map_arrow(ordered, traverse, "sig_a long, sig_b long").distinct()


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, grams_a, grams_b = (batch.column(i).to_pylist() for i in range(4))
        sizes = []
        for x, y in zip(grams_a, grams_b, strict=True):
            x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            common = len(np.intersect1d(x, y, assume_unique=True))
            sizes.append(common / (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sizes, pa.float64())], ["a", "b", "similarity"])


def similar_sets(sets: DataFrame, similarity: float = SIMILARITY, node_rows: int = NODE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, similarity) between representatives, and the representative of each ``sig``.

    ``sets`` should be a kept table: it is read several times, some columns at a time.
    """
    counts = gram_counts(sets)
    bits = [f"b{i}" for i in range(BITS // 64)]
    own = sets.groupBy("sig").agg(F.min("result_id").alias("rep"), F.first("n").alias("n"), *(F.first(b).alias(b) for b in bits))
    pairs = tree_pairs(tree_rows(sets, counts, similarity, node_rows), counts, similarity, node_rows)
    a = own.select(F.col("sig").alias("sig_a"), F.col("rep").alias("a"), F.col("n").alias("n_a"), *(F.col(b).alias(f"a_{b}") for b in bits))
    b = own.select(F.col("sig").alias("sig_b"), F.col("rep").alias("b"), F.col("n").alias("n_b"), *(F.col(b).alias(f"b_{b}") for b in bits))
    differing = sum((F.bit_count(F.col(f"a_{x}").bitwiseXOR(F.col(f"b_{x}"))) for x in bits), F.lit(0))
    near = pairs.join(a, "sig_a").join(b, "sig_b").where(differing <= (1 - similarity) / (1 + similarity) * (F.col("n_a") + F.col("n_b")) + 1e-6).select("a", "b")
    grams = sets.select("result_id", "grams")
    full = (
        near.join(grams.select(F.col("result_id").alias("a"), F.col("grams").alias("grams_a")), "a")
        .join(grams.select(F.col("result_id").alias("b"), F.col("grams").alias("grams_b")), "b")
        .select("a", "b", "grams_a", "grams_b")
    )
    links = map_arrow(full, _overlaps, "a long, b long, similarity double").where(F.col("similarity") >= similarity - 1e-12)
    return links, own.select("sig", "rep")


def near_duplicate_classes(results: DataFrame, weights: dict[str, float], similarity: float = SIMILARITY) -> DataFrame:
    """One row (result_id, class_id, links) for each result that takes part: the class is its least result_id, links are the other results that it is similar to itself, equal ones too."""
    sets = keep(bodies(results, weights))
    links, own = similar_sets(sets, similarity)
    links = cut(links.select("a", "b"))
    classes = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    owners = sets.select("result_id", "sig").join(own, "sig")
    copies = owners.groupBy("rep").agg(F.count("*").alias("copies"))
    ends = links.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    others = ends.join(copies.select(F.col("rep").alias("other"), "copies"), "other").groupBy("rep").agg(F.sum("copies").alias("others"))
    of_rep = copies.join(classes.select(F.col("node").alias("rep"), "component"), "rep", "left").join(others, "rep", "left")
    of_rep = of_rep.select("rep", F.coalesce("component", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    return owners.select("result_id", "rep").join(of_rep, "rep").select("result_id", "class_id", "links")


def class_pairs(classes: DataFrame, part: int = CLASS_PART) -> DataFrame:
    """All pairs (result_id_a < result_id_b) of a class; a class goes to as many tasks as it has ``part`` members."""
    sizes = classes.groupBy("class_id").count().where("count > 1").select("class_id", F.ceil(F.col("count") / part).cast("int").alias("splits"))
    kept = classes.select("class_id", "result_id").join(sizes, "class_id")
    a = kept.select("class_id", F.col("result_id").alias("result_id_a"), F.pmod(F.xxhash64("result_id"), F.col("splits")).cast("int").alias("split"))
    b = kept.select("class_id", F.col("result_id").alias("result_id_b"), F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"))
    return a.join(b, ["class_id", "split"]).where("result_id_a < result_id_b").select("result_id_a", "result_id_b")
