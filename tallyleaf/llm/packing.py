"""Best-fit packing by hierarchical residuals.

Every partition packs its own items best-fit, largest first. Bins that are nearly full are final;
the others become items themselves, as large as their contents, and meet in fewer partitions,
where the same is done again, in tasks of about ITEMS_PER_TASK bins. After a round, bins that no
other open bin can need are final too; the rest goes up the tree, to at most half as many tasks,
until one has seen all that is left. So no two open bins that fit together stay apart.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, word_ids

#: Free tokens that a nearly full bin has at most; bins per task of the tree.
SLACK, ITEMS_PER_TASK = 16, 200_000


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item, and what each bin holds. Items go into the fullest bin that takes them.

    Bins are kept by free room, and a bit mask says which amounts of room exist.
    """
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, fill, bins, offsets = 0, [], [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        room -= size
        by_room[room].append(b)
        rooms |= 1 << room
    return bins, offsets, fill


def _numbers(round_no: int, bins: np.ndarray) -> np.ndarray:
    """Bin numbers that no other task and round gives."""
    return (np.int64(round_no) << 58) | (np.int64(TaskContext.get().partitionId()) << 30) | bins.astype(np.int64)


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every whole text (null: empty) with its end id, packed within partitions.

    Rows: key, piece, start, length, ids_crc32, bin, offset, fill (of the whole bin), with ``ids``
    (packed, unsigned 32 bits) if asked for. Documents of one key and text that come twice are
    packed twice, and those without a key like any other.
    """
    common.ready(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    last = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids.encoder(vocabulary).encode
        keys, piece, start, length, crc, ids_of = [], [], [], [], [], []
        for batch in batches:
            texts = batch["text"].cast(pa.binary())
            for low, high in word_ids.batches(texts):
                for k, ids in zip(batch["key"].slice(low, high - low).to_pylist(), encode(texts.slice(low, high - low).to_pylist()), strict=True):
                    ids += last
                    for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        keys.append(k)
                        piece.append(p)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids_of.append(part)
        bins, offsets, fill = best_fit(length, capacity)
        bins = np.array(bins, dtype=np.int64)
        columns = [pa.array(keys, batch["key"].type) if keys else pa.array([], pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array(_numbers(0, bins)), pa.array(offsets, pa.int64()), pa.array(np.array(fill, dtype=np.int64)[bins])]
        names = ["key", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"]
        if keys:
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(ids_of, pa.binary())] if with_ids else [])], names=[*names, *(["ids"] if with_ids else [])])

    return rows.mapInArrow(run, f"key {kind}, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long" + ", ids binary" * with_ids)


def mergeable(bins: DataFrame, capacity: int) -> DataFrame:
    """Of the bins that a round left, as many as merging them further can need.

    No two bins of one task fit together, so each task leaves at most one that is no more than half
    full, and one of any two bins that fit together is such a bin. Each of these needs one partner
    at most: of the fuller bins, as many of each fill as there are half-full ones do. These are taken
    from shares of a fill first, as one fill can hold most bins.
    """
    half = bins.where(2 * F.col("fill") <= capacity)
    found = half.agg(F.count("*").alias("n"), F.min("fill").alias("least")).first()
    if not found.n:
        return bins.limit(0)
    partners = bins.where((2 * F.col("fill") > capacity) & (F.col("fill") <= capacity - found.least))
    first = lambda rows, *by: rows.withColumn("_nth", F.row_number().over(W.partitionBy(*by).orderBy("bin"))).where(F.col("_nth") <= found.n).drop("_nth")
    shares = F.pmod(F.xxhash64("bin"), F.lit(common.partitions(bins.sparkSession)))
    return half.union(first(first(partners.withColumn("_share", shares), "fill", "_share").drop("_share"), "fill"))


def merge_bins(bins: DataFrame, capacity: int, folder: str) -> DataFrame | None:
    """Where bins (bin, fill) go: rows (bin, sequence, shift), for those that move at all.

    Each round's rows are written to the folder, so that later rounds read one fixed outcome.
    """
    moved, round_no = None, 0
    n = bins.count()
    groups = -(-n // ITEMS_PER_TASK)
    while n > 1:
        round_no += 1

        def run(batches: Iterator[pa.RecordBatch], round_no: int = round_no) -> Iterator[pa.RecordBatch]:
            got = [(b["bin"].to_numpy(), b["fill"].to_numpy()) for b in batches]
            if not got:
                return
            numbers, sizes = np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])
            order = np.argsort(numbers)  # the outcome depends on the set of items alone
            numbers, sizes = numbers[order], sizes[order]
            into, shifts, fill = best_fit(sizes.tolist(), capacity)
            into = np.array(into, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(_numbers(round_no, into)), pa.array(shifts, pa.int64()), pa.array(np.array(fill, dtype=np.int64)[into])], names=["bin", "sequence", "shift", "fill"])

        packed = bins.select("bin", "fill").repartition(groups, "bin").mapInArrow(run, "bin long, sequence long, shift long, fill long")
        step = common.kept(packed, f"{folder}/round-{round_no}")
        hop = step.select("bin", "sequence", "shift")
        if moved is None:
            moved = hop
        else:
            onward = hop.select(F.col("bin").alias("sequence"), F.col("sequence").alias("next"), F.col("shift").alias("more"))
            moved = common.kept(moved.join(onward, "sequence", "left").select("bin", F.coalesce("next", "sequence").alias("sequence"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")), f"{folder}/moved-{round_no}")
        if groups == 1:
            break
        bins = mergeable(step.where((F.col("shift") == 0) & (F.col("fill") < capacity - SLACK)).select(F.col("sequence").alias("bin"), "fill"), capacity)
        n = bins.count()
        groups = min(-(-n // ITEMS_PER_TASK), (groups + 1) // 2)
    return moved


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack documents: rows of token_pieces with ``sequence_id`` and final ``offset``.

    Sequences have no gaps and at most ``capacity`` ids; only documents longer than that are cut.
    An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = common.shared_folder(spark, "packing")
    pieces = common.kept(token_pieces(docs, vocabulary, end_id, capacity, key, text, with_ids), f"{folder}/pieces")
    open_bins = pieces.where((F.col("offset") == 0) & (F.col("fill") < capacity - SLACK)).select("bin", "fill")
    moved = merge_bins(open_bins, capacity, folder)
    if moved is None:
        return pieces.withColumnRenamed("bin", "sequence_id").drop("fill")
    placed = pieces.join(moved, "bin", "left")
    return placed.withColumn("sequence_id", F.coalesce("sequence", "bin")).withColumn("offset", F.col("offset") + F.coalesce("shift", F.lit(0))).drop("bin", "sequence", "shift", "fill")


def digest_rows(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    return pack(docs, vocabulary, end_id, capacity).select(F.col("key").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
