"""Connected components of a graph that is a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyleaf.sources import tables


def components(links: DataFrame, folder: str) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b), for all nodes of links.

    Every node is linked to the smallest of its neighbours, in turn from its larger and its smaller side, until
    nothing changes: about the logarithm of the longest way in rounds. Each round's table is written.
    """
    edges = tables.kept(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), f"{folder}/links-0")
    told = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before, step = told(edges), 0
    while before[0]:
        step += 1
        sides = edges.union(edges.select("v", "u").toDF("u", "v"))
        heads = tables.kept(sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("head")), f"{folder}/heads-{step}")
        up = tables.kept(sides.where("v > u").join(heads, "u").select(F.col("v").alias("u"), F.col("head").alias("v")).where("u != v").distinct(), f"{folder}/up-{step}")
        low = up.groupBy("u").agg(F.min("v").alias("low"))
        edges = tables.kept(up.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u != v").union(low).distinct(), f"{folder}/links-{step}")
        after = told(edges)
        if after == before:
            break
        before = after
    return edges.toDF("node", "component").union(edges.select("v", "v").distinct())
