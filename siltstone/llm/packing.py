"""Filling containers of fixed capacity: hierarchical residual packing.

Each part of a group packs its items by best fit (largest first). Containers
at least ``FULL`` full are closed; the others become items of the next round,
where several parts' rests meet in one part and are packed by best fit again,
until a group is one part or a round saves nothing. A part holds at most ``PART_ITEMS``
items, so a hot group is packed by many tasks.

An item is a whole document; one above the capacity is cut into pieces of the
capacity and a rest. Sizes are tokens of a public tokenizer, whose file is a
parameter; a document counts at least one token, so that a container holds no
more members than its capacity.

Results for special input: NULL text counts as empty; a NULL group value is a
group of its own; values are compared as they are; equal documents are
separate items; ties go to the smaller doc_id; NULL or non-positive capacities
and empty tables give no containers.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.plans.lineage import cut
from siltstone.plans.shipping import group_arrow, map_arrow

# Fixed value: the pre-split pattern of the public byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
FULL = 0.98
PART_ITEMS = 20_000
#: Rounds end where one leaves more than this share of its items as open containers.
NO_SAVING = 0.995
#: Most rounds; each packs a group into fewer parts, so none comes near it. What is left open then stays as it is, and no item is lost.
MAX_ROUNDS = 20


def token_counter(path: str):
    """Function from texts to token numbers, of a vocabulary file of ranks."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def count(texts: list[str | None]) -> list[int]:
        return [len(encoding.encode_ordinary(t)) if t else 0 for t in texts]

    return count


def token_sizes(documents: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, lang, source, tokens) of ``documents(doc_id, lang, source, text)``; ``tokenizer`` is a vocabulary file that every executor can read."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(tokenizer)
        for batch in batches:
            sizes = count(batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sizes, pa.int64())], ["doc_id", "lang", "source", "tokens"])

    return map_arrow(documents.select("doc_id", "lang", "source", "text"), measure, "doc_id long, lang string, source string, tokens long")


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Number of the container of each size, given largest first: the fullest container with room, else a new one."""
    room: list[tuple[int, int]] = []
    out = []
    opened = 0
    for size in sizes:
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, number = room.pop(at)
        else:
            left, number = capacity, opened
            opened += 1
        out.append(number)
        if left > size:
            insort(room, (left - size, number))
    return out


_MEMBERS = "array<struct<doc_id: bigint, piece_no: int, tokens: bigint>>"
_MEMBER_TYPE = pa.struct([("doc_id", pa.int64()), ("piece_no", pa.int32()), ("tokens", pa.int64())])
_BIN_SCHEMA = f"pack_id int, capacity long, value string, size long, members {_MEMBERS}"


def _pack_part(table: pa.Table) -> pa.Table:
    if not table.num_rows:
        return table.select(["pack_id", "capacity", "value", "size", "members"])
    size = table.column("size").to_numpy()
    capacity = table.column("capacity")[0].as_py()
    members = table.column("members").combine_chunks()
    first = members.values.field("doc_id").to_numpy()[members.offsets.to_numpy()[:-1]]
    piece = members.values.field("piece_no").to_numpy()[members.offsets.to_numpy()[:-1]]
    order = np.lexsort((piece, first, -size))
    bins = np.array(best_fit(size[order].tolist(), capacity))
    by_bin = np.argsort(bins, kind="stable")
    taken = members.take(pa.array(order[by_bin]))
    number = bins[by_bin]
    edges = np.concatenate(([0], np.flatnonzero(np.diff(number)) + 1, [len(number)]))
    offsets = taken.offsets.to_numpy()[edges].astype(np.int32)
    fields = [taken.values.field(i) for i in range(3)]
    values = pa.StructArray.from_arrays(fields, fields=list(_MEMBER_TYPE))
    joined = pa.ListArray.from_arrays(pa.array(offsets), values, type=pa.list_(pa.field("element", _MEMBER_TYPE)))
    sums = np.add.reduceat(size[order[by_bin]], edges[:-1])
    n = len(sums)
    return pa.table(
        {
            "pack_id": pa.array([table.column("pack_id")[0].as_py()] * n, pa.int32()),
            "capacity": pa.array([capacity] * n, pa.int64()),
            "value": pa.array([table.column("value")[0].as_py()] * n, pa.string()),
            "size": pa.array(sums, pa.int64()),
            "members": joined,
        }
    )


def _one_round(items: DataFrame, counts: DataFrame, part_items: int) -> DataFrame:
    """Packs items by parts of their group; ``counts(pack_id, value, n)`` sets the number of parts."""
    keyed = items.join(counts, (items["pack_id"] == counts["c_pack"]) & items["value"].eqNullSafe(counts["c_value"])).drop("c_pack", "c_value")
    parted = keyed.withColumn("part", F.pmod(F.xxhash64(F.col("members")[0]["doc_id"], F.col("members")[0]["piece_no"]), F.col("parts")).cast("int")).drop("parts")
    return group_arrow(parted.groupBy("pack_id", "value", "part"), _pack_part, _BIN_SCHEMA)


def _parts(counted: DataFrame, part_items: int) -> DataFrame:
    return counted.select(F.col("pack_id").alias("c_pack"), F.col("value").alias("c_value"), F.greatest(F.lit(1), F.ceil(F.col("n") / part_items)).cast("int").alias("parts"))


def pack(sizes: DataFrame, packs: DataFrame, full: float = FULL, part_items: int = PART_ITEMS) -> DataFrame:
    """One row (pack_id, container_id, doc_id, piece_no, tokens) for each document or piece and row of ``packs``.

    ``sizes(doc_id, lang, source, tokens)``; ``packs(pack_id, capacity_tokens, fill_within)``.
    """
    packs = packs.where("capacity_tokens > 0").select(F.col("pack_id").cast("int").alias("pack_id"), F.col("capacity_tokens").cast("long").alias("capacity"), "fill_within").distinct()
    value = F.when(F.col("fill_within") == "lang", F.col("lang")).when(F.col("fill_within") == "source", F.col("source")).otherwise(F.lit("all"))
    # The stated containers' kinds are a handful of rows, so each meets all documents.
    spark = sizes.sparkSession
    kinds = [tuple(r) for r in packs.collect()]
    if not kinds:
        return spark.createDataFrame([], "pack_id int, container_id string, doc_id long, piece_no int, tokens long")
    listed = F.array(*(F.struct(F.lit(p).cast("int").alias("pack_id"), F.lit(c).cast("long").alias("capacity"), F.lit(w).alias("fill_within")) for p, c, w in kinds))
    sizes = cut(sizes)  # read in every round, and counting tokens is the dear part
    rows = sizes.select("*", F.explode(listed).alias("k")).select("doc_id", "lang", "source", "tokens", "k.*").withColumn("value", value)
    rows = rows.withColumn("weight", F.greatest(F.lit(1).cast("long"), F.col("tokens")))
    pieces = rows.withColumn("piece_no", F.explode(F.sequence(F.lit(1), F.ceil(F.col("weight") / F.col("capacity")).cast("int"))))
    size = F.least(F.col("capacity"), F.col("weight") - (F.col("piece_no") - 1) * F.col("capacity"))
    member = F.struct("doc_id", "piece_no", F.when(F.col("tokens") == 0, F.lit(0).cast("long")).otherwise(size).alias("tokens"))
    items = pieces.select("pack_id", "capacity", "value", size.alias("size"), F.array(member).alias("members"))
    closed, left, before = None, items, None
    for _ in range(MAX_ROUNDS):
        counted = left.groupBy("pack_id", "value").agg(F.count("*").alias("n"))
        most, total = counted.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not total or (before is not None and total > NO_SAVING * before):
            break
        # The parts follow from what is left, so the tree narrows by itself: what the parts of one round leave open meets in fewer parts.
        bins = cut(_one_round(left, _parts(counted, part_items), part_items))
        before = total
        left = bins.where(F.col("size") < full * F.col("capacity"))
        done = bins.where(F.col("size") >= full * F.col("capacity"))
        closed = done if closed is None else closed.unionByName(done)
        if most <= part_items:
            break  # each group was one part
    if closed is None:
        return spark.createDataFrame([], "pack_id int, container_id string, doc_id long, piece_no int, tokens long")
    bins = closed.unionByName(left)
    first = F.array_min(F.transform("members", lambda m: F.struct(m["doc_id"], m["piece_no"])))
    named = bins.select("pack_id", F.concat_ws("-", "pack_id", first["doc_id"], first["piece_no"]).alias("container_id"), F.explode("members").alias("m"))
    return named.select("pack_id", "container_id", "m.doc_id", "m.piece_no", "m.tokens")
