"""Prices of row pairs, from the innermost arrays outwards.

A row of an array is known by a hash of its place. For every level of arrays inside the rows, from the deepest, pairs of
rows with an equal value are made by a join and counted by an aggregate; the arrays of one pair of
outer rows are matched, and what their matching is worth goes into the price of that pair, by another
aggregate. Only the matching itself runs in Python, group by group of sorted batches.

All joins and aggregates have the document and a hash of the array among their keys: leaves that are dealt by these
two once (flat rows of small arrays) are moved by none of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyleaf.functions import addresses as A
from tallyleaf.sources import tables

from . import assignment

DOC = "doc_id"
#: Where a leaf lies, in all keys.
PLACE = (DOC, "block")


def is_ordered(node: Column, ordered: DataFrame | Sequence[Sequence[str]] | bool) -> Column:
    """Whether an array, by node key, keeps its order."""
    if isinstance(ordered, bool):
        return F.lit(ordered)
    return F.array_contains(F.lit([]).cast("array<array<string>>") if not ordered else F.array(*[F.array(*map(F.lit, x)) if x else F.array().cast("array<string>") for x in ordered]), node)


def placed(leaves: DataFrame, ordered) -> DataFrame:
    """Leaves (doc_id, array, element, rel, canon) with hashes: depth (arrays inside the row that are to be matched), levels
    (row and slot of the rows it is in, from outside), value (of its place and canon), rel_hash and content."""
    prefixes = A.array_prefixes(F.col("rel"))
    whole = lambda p: A.node_key(F.concat("array", F.array(F.lit(A.INDEX)), p))
    # Under an ordered array everything is compared by place.
    first = F.array_position(F.transform(prefixes, lambda p: is_ordered(whole(p), ordered)), F.lit(True)).cast("int")
    found = leaves.withColumns({"_paths": prefixes, "depth": F.when(first > 0, first - 1).otherwise(F.size(prefixes))})
    end = lambda k: F.when(k == 0, 0).otherwise(F.size(F.get("_paths", k - 1)) + 1)
    step = lambda k: F.slice("rel", F.lit(1), end(k))
    levels = F.transform(F.sequence(F.lit(0), F.col("depth")), lambda k: F.struct(F.xxhash64("array", "element", step(k)).alias("row"), F.xxhash64("array", A.node_key(step(k))).alias("slot")))
    rest = F.slice("rel", end(F.col("depth")) + 1, F.size("rel"))
    hashed = found.withColumns({"levels": levels, "_rest": rest})
    return hashed.select(DOC, F.xxhash64("array").alias("block"), "array", "element", "depth", "levels", F.xxhash64("array", F.element_at("levels", -1)["slot"], F.size("_rest"), "_rest", "canon").alias("value"), F.xxhash64("_rest").alias("rel_hash"), F.xxhash64("_rest", "canon").alias("content"))


def placed_flat(leaves: DataFrame) -> DataFrame:
    """As placed, of leaves with no arrays inside the rows that are to be matched: without a look at their steps."""
    none = F.array().cast("array<string>")
    hashed = leaves.withColumns({"depth": F.lit(0), "_slot": F.xxhash64("array", none), "_row": F.xxhash64("array", "element", none)})
    return hashed.select(DOC, F.xxhash64("array").alias("block"), "array", "element", "depth", F.array(F.struct(F.col("_row").alias("row"), F.col("_slot").alias("slot"))).alias("levels"), F.xxhash64("array", "_slot", F.size("rel"), "rel", "canon").alias("value"), F.xxhash64("rel").alias("rel_hash"), F.xxhash64("rel", "canon").alias("content"))


def _part(hash_: Column) -> Column:
    """A hash as a number that many of can be summed."""
    return F.shiftrightunsigned(hash_, 24)


def rows_at(leaves: DataFrame, k: int, deeper: DataFrame | None) -> DataFrame:
    """Rows of level k of placed leaves: doc_id, block, row, slot, up (the row around it), rels, content; array and element of outermost rows."""
    at = F.get("levels", F.lit(k))
    own = F.col("depth") == k
    found = leaves.where(F.col("depth") >= k).groupBy(*PLACE, at["row"].alias("row")).agg(
        F.first(at["slot"]).alias("slot"),
        F.first(F.get("levels", F.lit(k - 1))["row"] if k else F.col("block")).alias("up"),
        F.collect_set(F.when(own, F.col("rel_hash"))).alias("rels"),
        F.sum(F.when(own, _part(F.col("content"))).otherwise(0)).alias("content"),
        *([] if k else [F.first("array").alias("array"), F.first("element").alias("element")]),
    )
    if deeper is None:
        return found
    inside = deeper.groupBy(*PLACE, F.col("up").alias("row")).agg(F.sum(_part(F.xxhash64("slot", "content"))).alias("inside"))
    return found.join(inside, [*PLACE, "row"], "left").withColumn("content", F.xxhash64("content", F.coalesce("inside", F.lit(0)))).drop("inside")


def _side(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(*PLACE, *[F.col(c).alias(f"{name}_{c}") for c in rows.columns if c not in (*PLACE, "slot")], *(["slot"] if name == "gold" else []))


def priced(pred: DataFrame, gold: DataFrame, k: int, pred_rows: DataFrame, gold_rows: DataFrame, inner: DataFrame | None) -> DataFrame:
    """Pairs of rows of level k with an equal value in or below them, with matched, shared and weight, and what rows_at says of both."""
    values = lambda df, name: df.where(F.col("depth") == k).select(*PLACE, "value", F.get("levels", F.lit(k))["row"].alias(name))
    met = values(pred, "pred_row").join(values(gold, "gold_row"), [*PLACE, "value"]).groupBy(*PLACE, "pred_row", "gold_row").agg(F.count("*").alias("matched"))
    if inner is not None:
        both = met.withColumn("shared", F.lit(0).cast("bigint")).union(inner.select(*PLACE, "pred_row", "gold_row", "matched", "shared"))
        met = both.groupBy(*PLACE, "pred_row", "gold_row").agg(F.sum("matched").alias("matched"), F.sum("shared").alias("shared"))
    joined = met.join(_side(pred_rows, "pred"), [*PLACE, "pred_row"]).join(_side(gold_rows, "gold"), [*PLACE, "gold_row"])
    shared = F.size(F.array_intersect("pred_rels", "gold_rels")).cast("bigint") + (F.col("shared") if inner is not None else 0)
    # One more than all leaves of the array that can be shared: what matches counts first.
    scale = pred.groupBy(*PLACE).agg((F.count("*") + 1).alias("scale"))
    return joined.withColumn("shared", shared).join(scale, list(PLACE)).withColumn("weight", F.col("matched") * F.col("scale") + F.col("shared")).drop("pred_rels", "gold_rels", "scale")


def _changes(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Places of a batch whose keys aren't those before them."""
    found = np.zeros(max(0, batch.num_rows - 1), dtype=bool)
    for k in keys:
        found |= pc.not_equal(batch[k].slice(1), batch[k].slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(found) + 1


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole groups, from batches sorted by their keys, with the places where groups begin."""
    waiting: list[pa.RecordBatch] = []

    def joined() -> tuple[pa.RecordBatch, np.ndarray]:
        whole = waiting[0] if len(waiting) == 1 else pa.concat_batches(waiting)
        return whole, np.concatenate([[0], _changes(whole, keys)])

    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = _changes(batch, keys)
        last = int(cuts[-1]) if len(cuts) else 0
        if last or (waiting and any(waiting[-1][k][-1] != batch[k][0] for k in keys)):
            if last:
                waiting.append(batch.slice(0, last))
            yield joined()
            waiting = []
        waiting.append(batch.slice(last))
    if waiting:
        yield joined()


def matching(p: np.ndarray, g: np.ndarray, weight: np.ndarray, p_content: np.ndarray, g_content: np.ndarray) -> tuple[list[int], list[int]]:
    """Places of the pairs of a group that are made, and the larger sides of components that weren't solved exactly.

    Rows are ordered by content, so the outcome doesn't depend on their order.
    """
    n = len(p)
    if n == 1 or (len(set(p.tolist())) == n == len(set(g.tolist()))):
        return list(range(n)), []

    def numbers(rows: np.ndarray, content: np.ndarray) -> list[int]:
        order = {x: i for i, (_, x) in enumerate(sorted(set(zip(content.tolist(), rows.tolist(), strict=True))))}
        return [order[x] for x in rows.tolist()]

    at = {x: i for i, x in enumerate(zip(numbers(p, p_content), numbers(g, g_content), strict=True))}
    pairs, inexact = assignment.assign(dict(zip(at, weight.tolist(), strict=True)))
    return [at[x] for x in pairs], inexact


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch[c].to_numpy() for c in ("pred_row", "gold_row", "weight", "pred_content", "gold_content")]


@contextmanager
def co_located(spark: SparkSession):
    """While a table is written: joins take sides that are dealt by some of their keys alike as they are."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _tasks(df: DataFrame) -> int:
    """Tasks that groups are dealt to: a set number, as matching is more work than its bytes say."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def inside_matched(prices: DataFrame) -> DataFrame:
    """What the arrays inside pairs of outer rows are worth: doc_id, block, pred_row, gold_row (the outer ones), matched, shared, large."""
    keys = (*PLACE, "pred_up", "gold_up", "slot")
    kind = prices.schema[DOC].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in whole_groups(batches, keys):
            columns, ends = _columns(batch), np.append(starts[1:], batch.num_rows)
            sums = [np.add.reduceat(batch[c].to_numpy(), starts) for c in ("matched", "shared")]
            large: list[int | None] = [None] * len(starts)
            for i in np.flatnonzero(ends - starts > 1).tolist():
                low, high = int(starts[i]), int(ends[i])
                made, inexact = matching(*(c[low:high] for c in columns))
                for total, c in zip(sums, ("matched", "shared"), strict=True):
                    total[i] = batch[c].to_numpy()[low:high][made].sum()
                large[i] = max(inexact, default=None)
            heads = batch.take(pa.array(starts))
            yield pa.RecordBatch.from_arrays([heads[DOC], heads["block"], heads["pred_up"], heads["gold_up"], pa.array(sums[0]), pa.array(sums[1]), pa.array(large, pa.int32())], names=[*PLACE, "pred_row", "gold_row", "matched", "shared", "large"])

    wanted = prices.select(*keys, "pred_row", "gold_row", "pred_content", "gold_content", "matched", "shared", "weight")
    return wanted.repartition(_tasks(wanted), *keys).sortWithinPartitions(*keys).mapInArrow(run, f"{DOC} {kind}, block long, pred_row long, gold_row long, matched long, shared long, large int")


def groups_matched(edges: DataFrame, *keys: str, dealt: bool = False) -> DataFrame:
    """Pairs (doc_id, array, pred, gold, large) of outermost rows, from their edges; each group of keys is matched by itself.

    ``dealt`` says that each group is in one partition already.

    A row with ``large`` and no pair says that a component of that size wasn't solved exactly.
    """
    kind = edges.schema[DOC].dataType.simpleString()
    names = [DOC, "array", "pred", "gold", "large"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in whole_groups(batches, keys):
            columns, ends = _columns(batch), np.append(starts[1:], batch.num_rows)
            made, large = [], []
            for low, high in zip(starts.tolist(), ends.tolist(), strict=True):
                pairs, inexact = matching(*(c[low:high] for c in columns)) if high - low > 1 else ([0], [])
                made += [low + i for i in pairs]
                large += [(low, n) for n in inexact]
            found = batch.select(names[:-1]).take(pa.array(made, pa.int64()))
            yield pa.RecordBatch.from_arrays([*found.columns, pa.nulls(len(made), pa.int32())], names=names)
            if large:
                told = batch.select(names[:2]).take(pa.array([i for i, _ in large], pa.int64()))
                yield pa.RecordBatch.from_arrays([*told.columns, *[pa.nulls(len(large), pa.string())] * 2, pa.array([n for _, n in large], pa.int32())], names=names)

    wanted = edges.select(DOC, "array", "pred", "gold", *[k for k in keys if k != DOC], "pred_row", "gold_row", "pred_content", "gold_content", "weight")
    placed_ = wanted if dealt else wanted.repartition(_tasks(wanted), *keys)
    return placed_.sortWithinPartitions(*keys).mapInArrow(run, f"{DOC} {kind}, array array<string>, pred string, gold string, large int")


def edges(gold: DataFrame, pred: DataFrame, ordered, folder: str, nested: bool, dealt: bool = False) -> tuple[DataFrame, list[DataFrame]]:
    """(edges of outermost rows, blocks inside that weren't solved exactly): doc_id, array, pred, gold, rows, contents, matched, shared, weight.

    ``dealt``: leaves of flat rows are dealt by array first, once.
    """
    g, p = (placed(df, ordered) if nested else placed_flat(df) for df in (gold, pred))
    if dealt:
        g, p = (df.repartition(_tasks(df), *PLACE) for df in (g, p))
    depth, blocks = 0, []
    if nested:
        g, p = tables.kept(g, f"{folder}/gold"), tables.kept(p, f"{folder}/pred")
        depth = max(df.agg(F.max("depth")).first()[0] or 0 for df in (g, p))
    inner, rows = None, [None, None]
    # What lies in rows below, first.
    below: list[list[DataFrame]] = []
    for k in range(depth, -1, -1):
        rows = [rows_at(df, k, deeper) for df, deeper in zip((p, g), rows, strict=True)]
        if nested:
            rows = [tables.kept(df, f"{folder}/{name}-rows-{k}") for df, name in zip(rows, ("pred", "gold"), strict=True)]
        below.append(rows)
    for k in range(depth, -1, -1):
        found = priced(p, g, k, *below[depth - k], inner)
        if k:
            inner = tables.kept(inside_matched(found), f"{folder}/inside-{k}")
            blocks.append(inner.where("large is not null").select(DOC, "large"))
    named = found.select(DOC, "block", F.col("gold_array").alias("array"), F.col("pred_element").alias("pred"), F.col("gold_element").alias("gold"), "pred_row", "gold_row", "pred_content", "gold_content", "matched", "shared", "weight")
    return named, blocks
