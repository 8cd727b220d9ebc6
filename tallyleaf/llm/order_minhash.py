"""Document fingerprints by Order MinHash: sensitive to edit distance, as order counts.

A text's k-mers of code points are numbered by occurrence, so that a repeated one counts as
another. For each of several hash functions the few smallest (k-mer, number) pairs are selected, put
back into text order, and the tuple of their k-mers is hashed to one entry of the signature. The
likeness of two texts is the share of equal entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Letters in a k-mer (a power of two), k-mers in a tuple, entries of a signature.
KMER, TUPLE, ENTRIES = 8, 2, 48
#: k-mers of a long text that are looked at in one go.
BLOCK = 1 << 20
R = np.uint64(0x9E3779B97F4A7C15)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


#: R to the powers 1, 2, 4: of stretches of so many code points.
POWERS = [np.uint64(pow(int(R), n, 1 << 64)) for n in (1, 2, 4)]
#: One odd multiplier per function: on mixed values each gives another order.
FUNCTIONS = _mixed(np.arange(1, ENTRIES + 1, dtype=np.uint64) * R) | np.uint64(1)


def kmers(text: str) -> np.ndarray:
    """Hashes of a text's k-mers, by place; a shorter text is one k-mer, an empty one has none. Long texts are hashed in blocks."""
    if 0 < len(text) < KMER:
        h = _points(text)
        total = np.array([len(h)], dtype=np.uint64)
        for i in range(len(h)):
            total = _mixed(total * R + h[i : i + 1])
        return total
    out = np.empty(max(0, len(text) - KMER + 1), dtype=np.uint64)
    for at in range(0, len(out), BLOCK):
        h = _points(text[at : at + BLOCK + KMER - 1])
        n = 1
        for power in POWERS:
            h = h[:-n] + h[n:] * power
            n *= 2
        out[at : at + BLOCK] = _mixed(h)
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)


def numbered(h: np.ndarray) -> np.ndarray:
    """Hashes of (k-mer, how many equal ones stand before it).

    Sorting place and leading bits of the hash in one number is the fast way; where these bits make
    unequal hashes look alike, as in very long texts, whole hashes are sorted.
    """
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    keys = np.sort((h >> bits << bits) | np.arange(len(h), dtype=np.uint64))
    order, lead = (keys & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), keys >> bits
    group = h[order]
    if ((lead[1:] == lead[:-1]) & (group[1:] != group[:-1])).any():
        order = np.argsort(h, kind="stable")
        group = h[order]
    at = np.arange(len(h))
    starts = np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), at, 0))
    times = np.empty(len(h), dtype=np.uint64)
    times[order] = (at - starts).astype(np.uint64)
    return np.where(times == 0, h, _mixed(h + times * R))


def _smallest(x: np.ndarray, places: np.ndarray, want: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(function, value, place) of those values x * f that can be among the ``want`` smallest of n, by function.

    About 14 values of each function are below the limit; a function with too few is looked at whole.
    """
    limit = np.uint64(min(2**64 - 1, 2**64 // n * 14))
    found, step = [], max(1, (1 << 21) // max(1, len(x)))
    for low in range(0, ENTRIES, step):
        f = FUNCTIONS[low : low + step]
        values = x[None, :] * f[:, None]
        flat = np.flatnonzero(values.ravel() <= limit) if n > 28 else np.arange(values.size)
        rows, at = np.divmod(flat, len(x))
        found.append((rows + low, values.ravel()[flat], places[at]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _candidates(h: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _smallest, of all numbered k-mers; those of a long text are numbered and looked at by ranges of their hash, which equal ones share."""
    n = len(h)
    if n <= BLOCK:
        return _smallest(numbered(h), np.arange(n), want, n)
    bits = (n // BLOCK).bit_length() + 1
    parts = []
    for b in range(1 << bits):
        places = np.flatnonzero(h >> np.uint64(64 - bits) == np.uint64(b))
        # One k-mer can make up a range: its numbers are dealt out without sorting it.
        if len(places):
            parts += [_smallest(x, places[at : at + BLOCK], want, n) for at, x in _numbered_blocks(h, places)]
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _numbered_blocks(h: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Hashes at places, numbered as by numbered(), a block at a time; how often each k-mer came is carried on."""
    seen: dict[int, int] = {}
    for at in range(0, len(places), BLOCK):
        mine = h[places[at : at + BLOCK]]
        kinds, back = np.unique(mine, return_inverse=True)
        order = np.argsort(back, kind="stable")
        sizes = np.bincount(back)
        times = np.empty(len(mine), dtype=np.uint64)
        times[order] = np.arange(len(mine)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        if len(places) > BLOCK:
            before = np.array([seen.get(k, 0) for k in kinds.tolist()], dtype=np.uint64)
            times += before[back]
            seen.update(zip(kinds.tolist(), (before + sizes.astype(np.uint64)).tolist(), strict=True))
        yield at, np.where(times == 0, mine, _mixed(mine + times * R))


def signature(text: str) -> np.ndarray:
    """ENTRIES unsigned 16-bit hashes. Texts without a k-mer have those of the empty tuple.

    A text of n letters takes about 10 n bytes besides itself.
    """
    h = kmers(text)
    n = len(h)
    if n == 0:
        return np.zeros(ENTRIES, dtype=np.uint16)
    want = min(TUPLE, n)
    rows, values, places = _candidates(h, want)
    few = np.flatnonzero(np.bincount(rows, minlength=ENTRIES) < want)
    if len(few):
        whole = numbered(h)
        keep = ~np.isin(rows, few)
        rows = np.concatenate([rows[keep], np.repeat(few, n)])
        values = np.concatenate([values[keep], *(whole * FUNCTIONS[i] for i in few)])
        places = np.concatenate([places[keep], np.tile(np.arange(n), len(few))])
    order = np.lexsort((places, values, rows))
    rows, places = rows[order], places[order]
    first = np.searchsorted(rows, np.arange(ENTRIES))
    chosen = np.sort(places[first[:, None] + np.arange(want)], axis=1)
    total = np.full(ENTRIES, n if n < TUPLE else 0, dtype=np.uint64)
    for i in range(want):
        total = _mixed(total * R + h[chosen[:, i]])
    return (total >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and fingerprint (hex) of every whole text, null as empty; no shuffle. Other columns aren't read."""
    common.ready(docs.sparkSession)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([signature(t or "").tobytes().hex() for t in texts.to_pylist()], pa.string())

    return docs.select(key, F.arrow_udf(run, "string")(F.col(text).cast("string")).alias("fingerprint"))


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows in buckets by descending key, each bucket followed by a guest: the first row of the next one.

    Columns bucket, guest, key, text, sorted within partitions. Null keys come last; after the last row of all
    comes the first. A key that holds many rows (or null) is dealt to several buckets, by the texts and by the
    input's partitions; within a bucket equal keys are in the order of their texts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    bounds = common.order_bounds(rows, "key", common.partitions(spark), repeats=True)
    heavy = len(set(bounds)) < len(bounds)
    rows = rows.withColumn("bucket", common.spread_bucket(F.col("key"), F.crc32("text"), F.spark_partition_id(), bounds) if heavy else common.order_bucket(F.col("key"), bounds))
    # One row of each bucket, its first: that with the largest key, and of these the smallest text.
    tops = rows.groupBy("bucket").agg(F.max("key").alias("top"))
    numbers = sorted(tops.collect(), key=lambda r: -r.bucket)
    hosts = spark.createDataFrame([(numbers[i - 1].bucket, r.bucket, r.top) for i, r in enumerate(numbers)], "host int, bucket int, top long")
    met = rows.join(F.broadcast(hosts), "bucket").where(F.col("key").eqNullSafe(F.col("top")))
    guests = met.groupBy("host", "key").agg(F.min("text").alias("text")).select("key", "text", F.col("host").alias("bucket"), F.lit(True).alias("guest"))
    both = rows.select("key", "text", "bucket", F.lit(False).alias("guest")).union(guests)
    return both.repartitionById(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", "guest", F.desc_nulls_last("key"), "text")


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, whose last half begins the next document.

    Rows: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A
    table of one row is followed by itself, an empty one gives none. Repeated rows all come back.
    Keys are integers, or texts of integers. Texts of any length are read whole. Other columns aren't read.
    """
    common.ready(docs.sparkSession)
    placed = with_next(docs, key, text)
    schema = "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, done = None, []
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("bucket", "guest", "key")]
            for i, (bucket, guest, k) in enumerate(zip(*columns, strict=True)):
                t = batch["text"][i].as_py()
                mark = signature(t)
                if waiting is not None and waiting[0] == bucket:
                    done.append(_compared(*waiting[1:], t, mark))
                waiting = None if guest else (bucket, k, t, mark)
                if len(done) >= 2_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) if n == "key" else pa.array(c) for n, c in zip(names, zip(*done, strict=True), strict=True)], names=names)
                    done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) if n == "key" else pa.array(c) for n, c in zip(names, zip(*done, strict=True), strict=True)], names=names)

    return placed.mapInArrow(run, schema)


def _compared(key: int | None, text: str, mark: np.ndarray, following: str, next_mark: np.ndarray) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    edited_mark = signature(edited)
    return key, len(text), hashlib.sha256(edited.encode()).hexdigest(), mark.tobytes().hex(), edited_mark.tobytes().hex(), likeness(mark, edited_mark), likeness(mark, next_mark)


def digest_rows(docs: DataFrame) -> DataFrame:
    return compare_edited(docs).withColumnRenamed("key", "doc_id")
