"""Profiles of gold documents and of their pages."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyleaf.functions.addresses import INDEX, key_step

COLUMNS = ("pages", "scanned", "gold_chars", "table_rows", "num_values", "num_null", "max_depth")
#: A document is scanned if its first pages have fewer characters of text than this, on average.
SCANNED_CHARS, PAGES_LOOKED_AT = 50, 3


def _places(node: Any, at: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], Any]]:
    """Every value below a node, containers too, with its node key."""
    yield at, node
    if isinstance(node, dict):
        for k, v in node.items():
            yield from _places(v, (*at, key_step(k)))
    elif isinstance(node, list):
        for v in node:
            yield from _places(v, (*at, INDEX))


def _profile(node: Any) -> dict:
    """Counts over the places of a document: rows by table, scalars, nulls, and most names on the way to a scalar."""
    tables: Counter = Counter()
    depths, nulls = [0], 0
    for at, x in _places(node):
        if isinstance(x, list) and x and all(isinstance(r, dict) for r in x):
            tables[at] += len(x)
        elif not isinstance(x, dict | list):
            depths.append(sum(step != INDEX for step in at))
            nulls += x is None
    return {"table_rows": sorted(tables.values(), reverse=True), "num_values": len(depths) - 1, "num_null": nulls, "max_depth": max(depths)}


def gold_stats(gold: Column) -> Column:
    """Struct of gold_chars, table_rows (rows per table, largest first), num_values, num_null, max_depth of JSON texts."""
    kind = pa.struct([("gold_chars", pa.int64()), ("table_rows", pa.list_(pa.int64())), ("num_values", pa.int64()), ("num_null", pa.int64()), ("max_depth", pa.int64())])

    @F.arrow_udf("gold_chars long, table_rows array<long>, num_values long, num_null long, max_depth long")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            if t is None:
                out.append(None)
                continue
            node = json.loads(t)
            out.append({"gold_chars": len(json.dumps(node, ensure_ascii=False, separators=(",", ":")))} | _profile(node))
        return pa.array(out, kind)

    return run(gold)


def page_stats(pages: DataFrame) -> DataFrame:
    """pages and scanned per doc_id, from rows (doc_id, page from 1, text). A document without pages has no row."""
    first = F.col("page") <= PAGES_LOOKED_AT
    chars = F.sum(F.when(first, F.length(F.coalesce("text", F.lit(""))))).alias("_chars")
    found = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), chars, F.count_if(first).alias("_looked"))
    return found.select("doc_id", "pages", (F.coalesce("_chars", F.lit(0)) < SCANNED_CHARS * F.col("_looked")).alias("scanned"))


def described(manifest: DataFrame, golds: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """The manifest with the profile's columns after its own; those of the same names are replaced."""
    own = manifest.drop(*COLUMNS)
    stats = golds.select("doc_id", gold_stats(F.col("gold")).alias("s")).select("doc_id", "s.*")
    paged = page_stats(pages) if pages is not None else golds.select("doc_id", F.lit(None).cast("long").alias("pages"), F.lit(None).cast("boolean").alias("scanned"))
    return own.join(paged, "doc_id", "left").join(stats, "doc_id", "left").select(*[F.col(f"`{c}`") for c in own.columns], *COLUMNS)
