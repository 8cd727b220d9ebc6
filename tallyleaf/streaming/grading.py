"""Predictions graded as they arrive: the last answer of a document counts, once.

Every micro-batch adds its scores as a call of a folder, and the running sums by suite: those of the batch before,
less what its answers replace, plus what they score. A batch that runs again replaces its own outcome only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyleaf.operators import summaries
from tallyleaf.operators.verdicts import ERRORS, ratio
from tallyleaf.plans import grade
from tallyleaf.sources import runs, tables

RATES = tuple(f"{e}_rate" for e in ERRORS)
SUMMED = (*summaries.MEANS, *RATES)


def latest(rows: DataFrame, by: str | None) -> DataFrame:
    """One answer (doc_id, pred) of each document: the last by that column; of those that it can't tell apart the one with the greatest text."""
    order = F.struct(*([F.col(by)] if by else []), F.col("pred").isNotNull().alias("said"), "pred")
    return rows.groupBy("doc_id").agg(F.max_by("pred", order).alias("pred"))


def _sums(scores: DataFrame, sign: int) -> DataFrame:
    """Rows (suite, rows, sums of ratios and error rates), as decimals: such sums are exact in any order."""
    rates = scores.withColumns({f"{e}_rate": ratio(F.col(e), F.col("total")) for e in ERRORS})
    sums = [(sign * F.sum(F.col(c).cast("decimal(18,12)"))).cast("decimal(38,12)").alias(c) for c in SUMMED]
    return rates.groupBy("suite").agg((sign * F.count("*")).alias("rows"), *sums)


def _added(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("suite").agg(F.sum("rows").alias("rows"), *[F.sum(c).cast("decimal(38,12)").alias(c) for c in SUMMED])


def grade_stream(predictions: DataFrame, documents: DataFrame, folder: str, checkpoint: str, order=False, once: bool = True, by: str | None = None) -> StreamingQuery:
    """Grade a stream of (doc_id, pred) against documents (doc_id, suite, gold, schema); scores and sums go to a folder.

    ``by`` is a column of the stream that orders the answers of one batch; later batches count over earlier ones.
    """
    spark = documents.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        scored = grade.grade(documents.join(latest(rows, by), "doc_id"), order).scores
        scored = tables.kept(scored, f"{tables.work_folder(spark, 'stream')}/scores")
        runs.compact(spark, f"{folder}/scores", number)
        before = runs.newest(spark, f"{folder}/scores", number)
        sums = [_sums(scored, 1)]
        if before is not None:
            sums.append(_sums(before.join(scored.select("doc_id"), "doc_id", "left_semi"), -1))
        if (old := runs.last_call(spark, f"{folder}/sums", number)) is not None:
            sums.append(old)
        _added(sums).write.mode("overwrite").parquet(f"{folder}/sums/call={number}")
        scored.write.mode("overwrite").parquet(f"{folder}/scores/call={number}")

    writer = predictions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def scores(spark: SparkSession, folder: str) -> DataFrame | None:
    """The score of each document's last answer; None if nothing has been graded."""
    return runs.newest(spark, f"{folder}/scores")


def summary(spark: SparkSession, folder: str) -> DataFrame | None:
    """Means overall and by suite, as summaries.summary() has them, from the running sums: no score is read."""
    sums = runs.last_call(spark, f"{folder}/sums")
    if sums is None:
        return None
    means = lambda df: df.select("grain", "suite", "rows", *[(F.col(c) / F.col("rows")).cast("double").alias(c) for c in SUMMED])
    by_suite = sums.where("rows > 0")
    overall = by_suite.agg(F.sum("rows").alias("rows"), *[F.sum(c).alias(c) for c in SUMMED]).where("rows > 0")
    every = overall.select(F.lit("overall").alias("grain"), F.lit(None).cast("string").alias("suite"), "rows", *SUMMED).union(by_suite.select(F.lit("suite").alias("grain"), "suite", "rows", *SUMMED))
    return means(every).orderBy("grain", "suite")
