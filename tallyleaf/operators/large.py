"""Pairing of rows in large arrays: components found in Spark, and best-first rounds for those that are too large to solve.

An array in which rows share common values with very many others is crowded: pairs are made from its rare values, common
ones are only counted for pairs already met, and rows that are left are paired by the common values themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyleaf.sources import tables

from . import assignment, pricing
from .components import components

DOC = "doc_id"
NAMES = [DOC, "array", "pred", "gold", "large"]


def _alone(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges whose rows have no other one, the rest)."""
    partners = edges.withColumns({"_p": F.count("*").over(W.partitionBy(DOC, "pred_row")), "_g": F.count("*").over(W.partitionBy(DOC, "gold_row"))})
    return partners.where("_p = 1 and _g = 1").drop("_p", "_g"), partners.where("_p > 1 or _g > 1").drop("_p", "_g")


def solvable(n: Column, m: Column, pairs: Column) -> Column:
    """As assignment.solvable, of columns."""
    cells = n.cast("double") * m
    dense = (cells <= assignment.MAX_CELLS_DENSE) & (cells * assignment.BYTES_PER_CELL <= pairs * assignment.BYTES_PER_PAIR)
    return (F.least(n, m) <= assignment.MAX_EXACT_SIDE) & ((cells <= assignment.MAX_CELLS) | dense)


def best_first(edges: DataFrame, folder: str) -> DataFrame:
    """Pairs of edges (doc_id, pred_row, gold_row, weight, contents), as if taken heaviest first where both rows are free.

    In rounds: an edge that comes before all others of both its rows is taken, and what these rows have goes.
    Edges of one weight come in the order of a hash of their rows' contents, so that rounds are few.
    """
    order = F.struct((-F.col("weight")).alias("w"), F.xxhash64("pred_content", "gold_content", "pred_row", "gold_row").alias("h"), "pred_row", "gold_row")
    left, taken, n = tables.kept(edges.withColumn("_order", order), f"{folder}/left-0"), None, 0
    while not left.isEmpty():
        n += 1
        first = lambda side: left.groupBy(DOC, side).agg(F.min("_order").alias("_first"))  # noqa: E731, B023
        mine = left.join(first("pred_row"), [DOC, "pred_row"]).where(F.col("_order") == F.col("_first")).drop("_first")
        both = mine.join(first("gold_row"), [DOC, "gold_row"]).where(F.col("_order") == F.col("_first")).drop("_first")
        both = tables.kept(both, f"{folder}/taken-{n}")
        taken = both if taken is None else taken.union(both)
        free = left.join(both.select(DOC, "pred_row"), [DOC, "pred_row"], "left_anti").join(both.select(DOC, "gold_row"), [DOC, "gold_row"], "left_anti")
        left = tables.kept(free, f"{folder}/left-{n}")
    return (left if taken is None else taken).drop("_order")


def matched(edges: DataFrame, folder: str) -> DataFrame:
    """Best pairs (doc_id, array, pred, gold, large) of large arrays, from their edges: each connected component is a task's work by itself."""
    edges = tables.kept(edges, f"{folder}/edges")
    alone, rest = _alone(edges)
    alone = alone.select(DOC, "array", "pred", "gold", F.lit(None).cast("int").alias("large"))
    rest = rest.withColumns({"a": F.xxhash64(F.lit("pred"), DOC, "pred_row"), "b": F.xxhash64(F.lit("gold"), DOC, "gold_row")})
    rest = tables.kept(rest, f"{folder}/competing")
    of = components(rest.select("a", "b"), f"{folder}/components").withColumnRenamed("node", "a")
    labelled = tables.kept(rest.join(of, "a"), f"{folder}/labelled")
    sides = [labelled.select(DOC, "component", row).distinct().groupBy(DOC, "component").agg(F.count("*").alias(name)) for row, name in (("pred_row", "n"), ("gold_row", "m"))]
    sizes = labelled.groupBy(DOC, "component").agg(F.count("*").alias("pairs")).join(sides[0], [DOC, "component"]).join(sides[1], [DOC, "component"])
    over = tables.kept(sizes.where(~solvable(F.col("n"), F.col("m"), F.col("pairs"))), f"{folder}/too-large")
    exact = labelled.join(over.select(DOC, "component"), [DOC, "component"], "left_anti")
    found = alone.union(pricing.groups_matched(exact, DOC, "component"))
    if over.isEmpty():
        return found
    too_large = labelled.join(over.select(DOC, "component"), [DOC, "component"], "left_semi")
    pairs = best_first(too_large, f"{folder}/best-first").select(DOC, "array", "pred", "gold", F.lit(None).cast("int").alias("large"))
    told = over.join(labelled.groupBy(DOC, "component").agg(F.first("array").alias("array")), [DOC, "component"]).select(DOC, "array", F.lit(None).cast("string").alias("pred"), F.lit(None).cast("string").alias("gold"), F.greatest("n", "m").cast("int").alias("large"))
    return found.union(pairs).union(told)


def crowded(gold: DataFrame, pred: DataFrame, scale: DataFrame, limit: int, folder: str) -> DataFrame:
    """Pairs (doc_id, array, pred, gold, large) of crowded arrays of leaves (doc_id, array, element, rel, canon).

    No more than ``limit`` pairs of an array are made from its rare values. The outcome counts as inexact.
    """
    leaf = lambda df: df.select(DOC, "array", "element", F.xxhash64("array").alias("block"), F.xxhash64("array", "element").alias("row"), F.xxhash64("array", F.size("rel"), "rel", "canon").alias("value"), F.xxhash64("rel").alias("rel_hash")).distinct()
    g, p = tables.kept(leaf(gold), f"{folder}/gold"), tables.kept(leaf(pred), f"{folder}/pred")
    counts = lambda df, name: df.groupBy(DOC, "block", "value").agg(F.count("*").alias(name))
    both = counts(g, "g").join(counts(p, "p"), [DOC, "block", "value"])
    each = both.join(both.groupBy(DOC, "block").agg(F.count("*").alias("values")), [DOC, "block"])
    kinds = tables.kept(each.select(DOC, "value", (F.col("g") * F.col("p") <= F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("values")))).alias("rare")), f"{folder}/values")

    def rows(df: DataFrame, name: str) -> DataFrame:
        said = df.join(kinds, [DOC, "value"], "left")
        common = F.array_sort(F.collect_set(F.when(~F.col("rare"), F.col("value"))))
        found = said.groupBy(DOC, "row").agg(F.first("array").alias("array"), F.first("block").alias("block"), F.first("element").alias(name), F.collect_set("rel_hash").alias("rels"), F.sum(F.shiftrightunsigned("value", 24)).alias("content"), common.alias("common"))
        return tables.kept(found, f"{folder}/{name}-rows")

    gold_rows, pred_rows = rows(g, "gold"), rows(p, "pred")
    rare = kinds.where("rare").select(DOC, "value")
    side = lambda df, name: df.join(rare, [DOC, "value"]).select(DOC, "value", F.col("row").alias(f"{name}_row"))
    met = side(p, "pred").join(side(g, "gold"), [DOC, "value"]).groupBy(DOC, "pred_row", "gold_row").agg(F.count("*").alias("matched"))
    named = lambda df, name: df.select(DOC, F.col("row").alias(f"{name}_row"), *([F.col("array")] if name == "gold" else []), name, *[F.col(c).alias(f"{name}_{c}") for c in ("rels", "content", "common")])
    joined = met.join(named(pred_rows, "pred"), [DOC, "pred_row"]).join(named(gold_rows, "gold"), [DOC, "gold_row"]).join(scale, DOC)
    weight = (F.col("matched") + F.size(F.array_intersect("pred_common", "gold_common"))) * F.col("scale") + F.size(F.array_intersect("pred_rels", "gold_rels"))
    edges = joined.select(DOC, "array", "pred", "gold", "pred_row", "gold_row", "pred_content", "gold_content", weight.alias("weight"))
    done = tables.kept(matched(edges, f"{folder}/rare"), f"{folder}/rare-pairs")

    # What is left: rows with the same common values, then with one of them, in the order of the values' hashes.
    most = max(df.agg(F.max(F.size("common"))).first()[0] or 0 for df in (gold_rows, pred_rows))
    for i in range(-1, most):
        pairs = []
        for df, name in ((pred_rows, "pred"), (gold_rows, "gold")):
            free = df.join(done.where(F.col(name).isNotNull()).select(DOC, "array", name), [DOC, "array", name], "left_anti").where(F.size("common") > max(i, 0))
            same = F.xxhash64("block", "common") if i < 0 else F.get("common", F.lit(i))
            nth = F.row_number().over(W.partitionBy(DOC, "same").orderBy("content", name))
            pairs.append(free.withColumn("same", same).withColumn("nth", nth).select(DOC, "same", "nth", name, *(["array"] if name == "gold" else [])))
        more = pairs[0].join(pairs[1], [DOC, "same", "nth"]).select(DOC, "array", "pred", "gold", F.lit(None).cast("int").alias("large"))
        done = done.union(tables.kept(more, f"{folder}/same-{i + 1}"))
    numbers = lambda df: df.groupBy(DOC, "array").agg(F.count("*").cast("int").alias("n"))
    rows_of = numbers(gold_rows).union(numbers(pred_rows)).groupBy(DOC, "array").agg(F.max("n").alias("large"))
    return done.union(rows_of.select(DOC, "array", F.lit(None).cast("string").alias("pred"), F.lit(None).cast("string").alias("gold"), "large"))
