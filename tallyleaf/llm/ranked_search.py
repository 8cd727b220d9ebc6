"""Ranked lexical search by branch and bound over a hierarchical max tree.

Documents are tokenized once; of each, the query terms in it are kept with their counts. Stretches of
SEGMENT documents are searched as ranges of ranges: for every term a tree holds the largest
weight that a document of a range gives it, FANOUT ranges to a range. For each item, a search starts at
the top and always opens the range with the highest sum of its terms' bounds, down to
documents, until no range left can reach the item's limit; ranges that just reach it are opened too, as an equal
score with a smaller id ranks higher.

Two passes over all segments: in the first every task searches the best segment of each item, which gives limits
(the 50th best score); in the second all segments are searched under these limits. A task holds one
segment and the heads of the lists.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, word_ids

#: Documents returned for an item, documents in a segment (FANOUT ** LEVELS), ranges in a range.
TOP, SEGMENT, FANOUT, LEVELS = 50, 2_048, 8, 3
#: Most terms that items searched at once have together: a segment takes 4 bytes for each of them and each document.
BLOCK_TERMS = 8_000
#: Bytes that part terms: ASCII other than letters and digits. Letters become small.
_SIGNS = bytes(b for b in range(128) if not chr(b).isalnum())
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + _SIGNS, bytes(range(97, 123)) + b" " * len(_SIGNS))


def terms(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text, in order: ASCII letters, in lower case, digits and all other characters beyond ASCII."""
    # Split by one blank, as bytes.split() alone would do the same for ASCII whitespace only.
    return text.translate(_PLAIN).split()


@dataclass
class Queries:
    """Items searched at once: their numbers, term indexes and weights; the vocabulary's order is that of ``vocabulary``."""

    vocabulary: list[bytes]
    ids: list = field(default_factory=list)
    terms: list[np.ndarray] = field(default_factory=list)
    weights: np.ndarray | None = None
    n_docs: int = 0
    n_terms: int = 0


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (item, terms): distinct terms of every item; rows that share an id are one item, null texts have none."""

    @F.arrow_udf("array<binary>")
    def split(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(set(terms(t))) if t else [] for t in texts.cast(pa.binary()).to_pylist()], pa.list_(pa.binary()))

    rows = items.select(F.col(f"`{key}`").alias("item"), split(F.col(f"`{text}`").cast("string")).alias("t"))
    return rows.groupBy("item").agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("terms")).where(F.size("terms") > 0)


def postings(docs: DataFrame, vocabulary: list[bytes], key: str, text: str) -> DataFrame:
    """Rows (doc, n, terms, times) of documents with a term: its number of terms, and the counts of those in the vocabulary."""
    place = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = place.value
        for batch in batches:
            texts = batch["text"].cast(pa.binary())
            for low, high in word_ids.batches(texts):
                keys, sizes, found, times, ends = [], [], [], [], [0]
                for k, t in zip(batch["doc"].slice(low, high - low).to_pylist(), texts.slice(low, high - low).to_pylist(), strict=True):
                    counted = Counter(terms(t)) if t else None
                    if not counted:
                        continue
                    mine = sorted((known[w], n) for w, n in counted.items() if w in known)
                    keys.append(k)
                    sizes.append(counted.total())
                    found += [i for i, _ in mine]
                    times += [n for _, n in mine]
                    ends.append(len(found))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (found, times)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch["doc"].type), pa.array(sizes, pa.int64()), *lists], names=["doc", "n", "terms", "times"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(run, "doc long, n long, terms array<int>, times array<int>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Segment:
    """Documents of one segment, and for each term the largest saturated count in every range of each level."""

    def __init__(self, batch: pa.RecordBatch, q: Queries):
        self.docs = batch["doc"]
        n = batch["n"].to_numpy()
        m = 50 + (50 * n * q.n_docs) // q.n_terms
        lists = batch["terms"]
        sizes = np.diff(lists.offsets.to_numpy())
        doc = np.repeat(np.arange(len(n)), sizes)
        tf = batch["times"].flatten().to_numpy().astype(np.int64)
        # At most a million each: 32 bits do.
        values = ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])).astype(np.int32)
        used = -(-max(1, len(n)) // FANOUT**LEVELS) * FANOUT**LEVELS
        self.levels = [np.zeros((len(q.vocabulary), used), dtype=np.int32)]
        self.levels[0][lists.flatten().to_numpy(), doc] = values
        for _ in range(LEVELS):
            last = self.levels[-1]
            self.levels.append(last.reshape(len(last), -1, FANOUT).max(axis=2))
        self.rank = _ranks(self.docs)

    def bound(self, q: Queries, item: int) -> int:
        """The highest sum of bounds of any top range."""
        t = q.terms[item]
        return int((q.weights[t] @ self.levels[-1][t].astype(np.int64)).max())

    def search(self, q: Queries, item: int, best: list[tuple], top: int, limit: int, tag: int) -> None:
        """Best first, into the heap ``best`` of (score, -rank, tag, place), with at most ``top`` entries; scores under the limit are left out."""
        t = q.terms[item]
        w = q.weights[t]
        tops = (w @ self.levels[-1][t].astype(np.int64)).tolist()
        queue = [(-b, LEVELS, i) for i, b in enumerate(tops) if b > 0]
        heapq.heapify(queue)
        while queue:
            minus, level, i = heapq.heappop(queue)
            # Ranges with just the limit are opened: a document there may tie.
            if -minus < max(limit, best[0][0] if len(best) == top else 1):
                break
            low = i * FANOUT
            below = (w @ self.levels[level - 1][t, low : low + FANOUT].astype(np.int64)).tolist()
            if level > 1:
                for j, b in enumerate(below):
                    if b > 0:
                        heapq.heappush(queue, (-b, level - 1, low + j))
                continue
            for j, score in enumerate(below):
                if score > 0 and score >= limit:
                    entry = (score, self.rank[low + j], tag, low + j)
                    if len(best) < top:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)


def _ranks(docs: pa.Array) -> list[int]:
    """Larger for documents that come first among equal scores: smaller ids, those without one before all."""
    return [-d if d is not None else 1 << 64 for d in docs.to_pylist()]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of SEGMENT documents."""
    waiting, rows = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, SEGMENT - rows)
            waiting.append(part)
            rows += part.num_rows
            batch = batch.slice(part.num_rows)
            if rows == SEGMENT:
                yield pa.concat_batches(waiting)
                waiting, rows = [], 0
    if waiting:
        yield pa.concat_batches(waiting)


def searched(index: DataFrame, q: Queries, top: int, limits: dict[int, int] | None) -> DataFrame:
    """Rows (i, doc, score): each task's best documents for every item, by item number.

    Without limits a task searches one segment for each item, the one with the highest bound so far when it is
    met; with them it searches all, and leaves out scores under an item's limit.
    """
    shared = index.sparkSession.sparkContext.broadcast((q, limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, limits = shared.value
        best: list[list[tuple]] = [[] for _ in q.ids]
        highest = [0] * len(q.ids)
        for tag, batch in enumerate(_segments(batches)):
            segment = Segment(batch, q)
            for i in range(len(q.ids)):
                if limits is None:
                    bound = segment.bound(q, i)
                    if bound <= highest[i]:
                        continue
                    highest[i] = bound
                segment.search(q, i, best[i], top, 1 if limits is None else max(1, limits.get(i, 1)), tag)
        rows = [(i, -rank if rank < 1 << 64 else None, score) for i, heap in enumerate(best) for score, rank, _, _ in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["i", "doc", "score"])

    return index.mapInArrow(run, "i int, doc long, score long")


def _order() -> list[Column]:
    return [F.desc("score"), F.col("doc").asc_nulls_first()]


def _top(found: DataFrame, top: int) -> DataFrame:
    """The best of each item, with their rank; tasks rank their own first."""
    return found.withColumn("rank", F.row_number().over(W.partitionBy("i").orderBy(*_order()))).where(F.col("rank") <= top)


def _block(docs: DataFrame, items: list, top: int, key: str, text: str, folder: str) -> DataFrame:
    """Rows (i, rank, doc, score) for items (item, terms)."""
    vocabulary = sorted({t for r in items for t in map(bytes, r.terms)})
    place = {t: i for i, t in enumerate(vocabulary)}
    q = Queries(vocabulary, [r.item for r in items], [np.array(sorted(place[bytes(t)] for t in r.terms)) for r in items])
    index = common.kept(postings(docs, vocabulary, key, text), f"{folder}/index")
    told = index.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    q.n_docs, q.n_terms = told.docs, told.terms or 1
    # One row for each term of the vocabulary.
    df = {r.term: r.n for r in index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    q.weights = np.array([weight(q.n_docs, df.get(i, 0)) for i in range(len(vocabulary))], dtype=np.int64)
    first = common.kept(_top(searched(index, q, top, None), top), f"{folder}/first")
    limits = {r.i: r.score for r in first.where(F.col("rank") == top).select("i", "score").collect()}
    return common.kept(_top(searched(index, q, top, limits), top), f"{folder}/found")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Rows (item, rank, doc, score): each item's ``top`` highest-scoring documents with a score above 0.

    Equal scores rank by ascending id, documents without one first; repeated rows are documents each. Null and
    empty texts have no terms: they count nowhere and are never found, and items without terms find
    nothing. Rows of items that share an id (or have none) are one item. Texts of any length are read
    whole; document keys are integers, or texts of integers. Empty tables give no rows. Other columns aren't
    read. Items are a query set: their terms are held on the driver, ``block_terms`` at once.
    """
    spark = common.ready(docs.sparkSession)
    folder = common.shared_folder(spark, "search")
    asked = common.kept(item_terms(items, item_key, item_text), f"{folder}/items")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // block_terms))
    kind = asked.schema["item"].dataType.simpleString()
    out = spark.createDataFrame([], f"item {kind}, rank int, doc long, score long")
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).orderBy("item").collect()
        if mine:
            found = _block(docs, mine, top, key, text, f"{folder}/block-{b}")
            names = spark.createDataFrame([(i, r.item) for i, r in enumerate(mine)], f"i int, item {kind}")
            out = out.union(found.join(F.broadcast(names), "i").select("item", "rank", "doc", "score"))
    return out


def digest_rows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score; nulls, ties and other cases as in search()."""
    return search(docs, items).select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")
