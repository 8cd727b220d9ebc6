"""Grading: documents with gold, prediction and schema texts to verdicts, scores and summaries."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any, NamedTuple, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyleaf.functions import addresses as A
from tallyleaf.operators import align, flatten, schemas, small, summaries, verdicts
from tallyleaf.sources import runs, tables

DOC = "doc_id"
#: What scores depend on besides the texts; another version scores everything again.
SCORER = "1"


class Graded(NamedTuple):
    verdicts: DataFrame
    scores: DataFrame
    summary: DataFrame


def known_arrays(docs: DataFrame) -> DataFrame:
    """Distinct (node, name) of the arrays that schemas declare or documents hold, before and after preparation."""
    declared = docs.select("schema").distinct().select(F.explode(schemas.slots_and_arrays(F.col("schema"))["arrays"]).alias("node"))
    held = [docs.select(F.explode(flatten.flattened(F.col(c), F.lit(None).cast("string"), side, wanted=("arrays",))["arrays"]).alias("node")) for c, side in (("gold", "gold"), ("pred", "pred"), ("pred", "gold"))]
    out = declared
    for h in held:
        out = out.union(h)
    return out.distinct().select("node", A.format_node(F.col("node")).alias("name"))


def resolve_order(order: bool | Iterable[str], docs: DataFrame) -> bool | list[list[str]]:
    """Names of arrays whose order matters, as node keys. A name that fits no array is an error."""
    if isinstance(order, bool):
        return order
    if isinstance(order, str):
        raise TypeError(f"order takes a list of array names, such as [{order!r}], not one text")
    names = list(order)
    if any(not isinstance(n, str) for n in names):
        raise TypeError("array names are texts, such as 'invoice.lines' or 'matrix[*]'")
    if not names:
        return False
    arrays = known_arrays(docs)
    found = arrays.where(F.col("name").isin(names)).collect()
    missing = sorted(set(names) - {r.name for r in found})
    if missing:
        near = [r.name for r in arrays.select("name").distinct().orderBy("name").limit(12).collect()]
        raise ValueError(f"no array is named {missing[0]!r}; there are: {', '.join(near) or 'none'}")
    return [list(r.node) for r in found]


def judged(docs: DataFrame, order: bool | Iterable[str] = False, absent="default", levels: int | None = None, dealt: bool = False) -> tuple[DataFrame, DataFrame]:
    """(verdicts, blocks paired best-first) of docs: doc_id, gold, pred, schema (JSON texts).

    A null prediction answers nothing. ``levels`` is the depth of arrays if it is known; 0 spares the search for them.
    ``dealt`` says that documents are in as many tasks as they need: those that are small are judged where they are.
    """
    spark = tables.ready(docs.sparkSession)
    nodes = resolve_order(order, docs)
    blocks = spark.createDataFrame([], f"{DOC} {docs.schema[DOC].dataType.simpleString()}, large int")
    if levels == 0:
        return verdicts.verdicts(*(flatten.leaves(docs, side, "schema", side, absent) for side in ("gold", "pred"))), blocks
    few, others, values = align.sorted_out(docs)
    found = None
    if few is not None:
        if not dealt and values >= tables.ROWS_OF_A_TASK:
            few = few.select(DOC, "gold", "pred", "schema").repartition(tables.tasks_for(spark, values), DOC)
        found = verdicts.judged(small.both_sides(few, nodes, absent))
    if others is not None:
        more, blocks = _judged_apart(others, nodes, absent, levels)
        found = more if found is None else found.union(more)
    return found, blocks


def _judged_apart(docs: DataFrame, nodes: bool | list[list[str]], absent, levels: int | None) -> tuple[DataFrame, DataFrame]:
    """As judged, of documents of any size: leaves are dealt, whichever document they are of."""
    spark = docs.sparkSession
    gold = flatten.leaves(docs, "gold", "schema", "gold", absent)
    pred = flatten.leaves(docs, "pred", "schema", "pred", absent)
    folder = tables.work_folder(spark, "grade")
    gold, pred = tables.kept(gold, f"{folder}/gold"), tables.kept(pred, f"{folder}/pred")
    counts = [df.count() for df in (gold, pred)]
    gold, pred = (tables.spread(df, n, f"{folder}/{name}-spread", DOC, "address") for df, n, name in zip((gold, pred), counts, ("gold", "pred"), strict=True))
    moved, blocks = align.aligned(gold, pred, nodes, levels, sum(counts))
    # What is returned is planned by the caller: a number of tasks that its session doesn't have goes with it.
    tasks = tables.tasks_for(spark, sum(counts))
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return verdicts.verdicts(gold, moved, tasks if tasks > own else None), blocks


def grade(docs: DataFrame, order: bool | Iterable[str] = False, absent="default", levels: int | None = None) -> Graded:
    """Verdicts, scores and summary of docs: doc_id, suite, gold, pred, schema."""
    per_address, blocks = judged(docs, order, absent, levels)
    skipped = flatten.skipped(docs, {"gold": "gold", "pred": "pred"}, "schema")
    per_document = verdicts.scores(docs.select(DOC, "suite"), per_address, blocks, skipped)
    return Graded(verdicts.with_skipped(per_address, skipped), per_document, summaries.summary(per_document))


def grade_cached(docs: DataFrame, cache: str, order: bool | Iterable[str] = False, absent: str = "default", levels: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(scores, summary) of docs, where a score in the cache folder counts as long as gold, prediction, schema and
    the way of scoring are the same. What is scored now is added to the cache."""
    spark = docs.sparkSession
    way = json.dumps([SCORER, order if isinstance(order, bool) else sorted(order), absent])
    before = runs.newest(spark, cache)
    todo = runs.marked(docs, way) if before is None else runs.stale(docs, before, way)
    if not todo.isEmpty():
        todo = tables.kept(todo, f"{tables.work_folder(spark, 'stale')}/docs")
        scored = grade(todo.drop("fingerprint"), order, absent, levels).scores.drop("suite")
        runs.add_call(scored.join(todo.select(DOC, "fingerprint"), DOC), cache, before)
    cached = runs.newest(spark, cache)
    found = runs.marked(docs, way).select(DOC, "suite", "fingerprint").join(cached, [DOC, "fingerprint"]).drop("fingerprint", "call")
    return found, summaries.summary(found)


class Scorer(Protocol):
    """A scorer of one's own: each method sees one document, the summary sees the table of lines."""

    #: Spark types of the numbers that score() gives, such as "keys_found double".
    fields: str

    def score(self, pred: Any, gold: Any) -> dict: ...

    def score_failure(self, gold: Any) -> dict: ...

    def summarize(self, lines: DataFrame) -> DataFrame: ...


def grade_with(docs: DataFrame, scorer: Scorer, partial: bool = False) -> tuple[DataFrame, DataFrame]:
    """(lines, summary) of docs (doc_id, suite, gold, pred) by another scorer; a null prediction is a failure.

    Documents are scored where they are, in Arrow batches, without a shuffle. An error of the scorer stops the grading; in
    a partial one the document counts as a failure, and lines have a column ``failure`` that says not_scored.
    """
    tables.ready(docs.sparkSession)
    rows = docs.select(DOC, "suite", "gold", "pred")
    lines = f"{DOC} {rows.schema[DOC].dataType.simpleString()}, suite string, {scorer.fields}" + ", failure string" * partial
    kinds = docs.sparkSession.createDataFrame([], lines).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                gold = json.loads(r["gold"])
                cause = "no_answer" if r["pred"] is None else None
                try:
                    found = scorer.score(json.loads(r["pred"]), gold) if cause is None else None
                except Exception:
                    if not partial:
                        raise
                    found, cause = None, "not_scored"
                found = scorer.score_failure(gold) if found is None else found
                out.append({DOC: r[DOC], "suite": r["suite"]} | found | ({"failure": cause} if partial else {}))
            yield pa.RecordBatch.from_pylist(out, kinds)

    scored = rows.mapInArrow(run, lines)
    return scored, scorer.summarize(scored)


def with_fields(scores: DataFrame, docs: DataFrame, *fields: str) -> DataFrame:
    """Scores, or verdicts, with further columns of the documents' table."""
    return scores.join(docs.select(DOC, *fields), DOC, "left")


def score_one(spark, pred: str | None, gold: str, schema: str, order: bool | Iterable[str] = False, absent="default", suite: str = summaries.DEFAULT_SUITE) -> tuple[dict, list[dict]]:
    """Scores and verdicts, in reading order, of one document."""
    docs = spark.createDataFrame([("document", suite, gold, pred, schema)], "doc_id string, suite string, gold string, pred string, schema string")
    found = grade(docs, order, absent)
    rows = verdicts.in_reading_order(found.verdicts).withColumn("address", A.show(F.col("address")))
    return found.scores.first().asDict(), [r.asDict() for r in rows.collect()]
