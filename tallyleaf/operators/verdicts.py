"""Verdicts and scores: two sides of leaves joined on their addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyleaf.functions import addresses as A

DOC = "doc_id"
RESULTS = ("matched", "misread", "unfound", "fabricated", "invented_item", "invented_field")
ERRORS = RESULTS[1:]
SKIPPED = "skipped_open_map"


def classify_extra(address: Column, offered: Column) -> Column:
    """Why only the prediction has an address: an element without partner, a slot on offer, or neither."""
    return F.when(F.exists(address, lambda s: s.startswith(A.LABEL)), "invented_item").when(offered, "fabricated").otherwise("invented_field")


def verdicts(gold: DataFrame, pred: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per address of either side: doc_id, address, gold_raw, pred_raw, gold_canon, pred_canon, result.

    ``tasks``: as many as the sides are dealt to; otherwise the session says it.
    """
    g = gold.select(DOC, "address", F.col("raw").alias("gold_raw"), F.col("canon").alias("gold_canon"))
    p = pred.select(DOC, "address", F.col("raw").alias("pred_raw"), F.col("canon").alias("pred_canon"), "offered")
    if tasks:
        g, p = (df.repartition(tasks, DOC, "address") for df in (g, p))
    return judged(g.join(p, [DOC, "address"], "full_outer"))


def judged(both: DataFrame) -> DataFrame:
    """Verdicts of rows with both sides of an address: doc_id, address, gold_raw, pred_raw, gold_canon, pred_canon, offered."""
    result = F.when(F.col("pred_canon").isNull(), "unfound").when(F.col("gold_canon").isNull(), classify_extra(F.col("address"), F.coalesce("offered", F.lit(False)))).when(F.col("gold_canon") == F.col("pred_canon"), "matched").otherwise("misread")
    return both.select(DOC, "address", "gold_raw", "pred_raw", "gold_canon", "pred_canon", result.alias("result"))


def with_skipped(judged: DataFrame, skipped: DataFrame) -> DataFrame:
    """Verdicts with a row for each open map."""
    return judged.unionByName(skipped.select(DOC, "address", F.lit(SKIPPED).alias("result")), allowMissingColumns=True)


def in_reading_order(judged: DataFrame) -> DataFrame:
    """By document, open maps first, then by address."""
    return judged.orderBy(DOC, F.col("result") != SKIPPED, "address")


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 if b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def ratios(scores: DataFrame) -> DataFrame:
    """Add accuracy, precision, recall, f1 and the shares of addresses found and read right to counts."""
    c = F.col
    shared = c("matched") + c("misread")
    with_shares = scores.withColumns({
        "accuracy": ratio(c("matched"), c("total")),
        "precision": ratio(c("matched"), c("asserted")),
        "recall": ratio(c("matched"), shared + c("unfound")),
        "addresses_found": ratio(shared, c("total")),
        "addresses_read_right": ratio(c("matched"), shared),
    })
    return with_shares.withColumn("f1", ratio(2 * c("precision") * c("recall"), c("precision") + c("recall")))


def row_counts(judged: DataFrame) -> DataFrame:
    """Array elements with a keyed child, by side and on both: doc_id, gold_rows, pred_rows, matched_rows."""
    inside = judged.select(DOC, "address", F.col("gold_canon").isNotNull().alias("g"), F.col("pred_canon").isNotNull().alias("p")).where(A.index_count(F.col("address")) > 0)
    places = F.filter(F.sequence(F.lit(1), F.size("address") - 1), lambda i: A.is_index(F.get("address", i - 1)) & F.get("address", i).startswith(A.KEY))
    element = inside.where(F.size("address") > 1).select(DOC, "g", "p", F.explode(F.transform(places, lambda i: F.slice("address", F.lit(1), i))).alias("element"))
    sides = element.groupBy(DOC, "element").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    return sides.groupBy(DOC).agg(F.count_if("g").alias("gold_rows"), F.count_if("p").alias("pred_rows"), F.count_if(F.col("g") & F.col("p")).alias("matched_rows"))


def counts(judged: DataFrame, keys: tuple[str, ...] = (DOC,)) -> DataFrame:
    """Number of addresses with each verdict, of all, and of those that the prediction has."""
    c = F.col("result")
    return judged.where(c != SKIPPED).groupBy(*keys).agg(*[F.count_if(c == r).alias(r) for r in RESULTS], F.count("*").alias("total"), F.count("pred_canon").alias("asserted"))


def tallied(judged: DataFrame) -> DataFrame:
    """counts and row_counts of each document, from one pass over its verdicts."""
    c = F.col
    places = F.filter(F.sequence(F.lit(1), F.size("address") - 1), lambda i: A.is_index(F.get("address", i - 1)) & F.get("address", i).startswith(A.KEY))
    elements = F.when(F.size("address") > 1, F.transform(places, lambda i: F.slice("address", F.lit(1), i)))
    placed = judged.where(c("result") != SKIPPED).select(DOC, "result", c("gold_canon").isNotNull().alias("g"), c("pred_canon").isNotNull().alias("p"), F.posexplode_outer(elements).alias("_nth", "element"))
    # An address counts once, with its outermost element.
    once = F.coalesce("_nth", F.lit(0)) == 0
    sums = [*RESULTS, "total", "asserted"]
    by_element = placed.groupBy(DOC, "element").agg(*[F.count_if(once & (c("result") == r)).alias(r) for r in RESULTS], F.count_if(once).alias("total"), F.count_if(once & c("p")).alias("asserted"), F.max("g").alias("g"), F.max("p").alias("p"))
    inside = c("element").isNotNull()
    rows = {"gold_rows": inside & c("g"), "pred_rows": inside & c("p"), "matched_rows": inside & c("g") & c("p")}
    return by_element.groupBy(DOC).agg(*[F.sum(x).alias(x) for x in sums], *[F.count_if(x).alias(name) for name, x in rows.items()])


def scores(docs: DataFrame, judged: DataFrame, blocks: DataFrame | None = None, skipped: DataFrame | None = None) -> DataFrame:
    """One row for each of docs (doc_id and what else it has), also for those without an address."""
    out = docs.join(tallied(judged), DOC, "left").fillna(0, [*RESULTS, "total", "asserted", "gold_rows", "pred_rows", "matched_rows"])
    out = ratios(out)
    if blocks is not None:
        large = blocks.groupBy(DOC).agg(F.sort_array(F.collect_set("large"), asc=False).alias("approximated"))
        out = out.join(large, DOC, "left").withColumn("matching_exact", F.col("approximated").isNull()).withColumn("approximated", F.coalesce("approximated", F.array().cast("array<int>")))
    if skipped is not None:
        shown = skipped.groupBy(DOC).agg(F.transform(F.array_sort(F.collect_set("address")), A.show).alias("skipped_open_maps"))
        out = out.join(shown, DOC, "left").withColumn("skipped_open_maps", F.coalesce("skipped_open_maps", F.array().cast("array<string>")))
    return out
