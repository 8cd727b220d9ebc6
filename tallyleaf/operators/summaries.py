"""Means over documents: overall, by suite, and the mean of suite means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .verdicts import ERRORS, ratio

MEANS = ("accuracy", "precision", "recall")
DEFAULT_SUITE = "other"


def mean(x: Column) -> Column:
    """Mean of ratios as a double, from their first twelve decimals: such sums are exact, so the order of rows doesn't matter."""
    return F.avg(x.cast("decimal(18,12)")).cast("double")


def means() -> list[Column]:
    """Aggregates: number of documents, mean ratios, mean rate of each kind of error."""
    return [F.count("*").alias("rows"), *[mean(F.col(m)).alias(m) for m in MEANS], *[mean(ratio(F.col(e), F.col("total"))).alias(f"{e}_rate") for e in ERRORS]]


def summary(scores: DataFrame) -> DataFrame:
    """One row overall and one per suite, in the order of their names; column grain says which."""
    found = scores.rollup("suite").agg(F.grouping("suite").alias("_all"), *means())
    return found.select(F.when(F.col("_all") == 1, "overall").otherwise("suite").alias("grain"), "suite", *[c for c in found.columns if c not in ("suite", "_all")]).orderBy("grain", "suite")


def checked_summary(scores: DataFrame) -> DataFrame:
    """As summary, but refuses an empty table and lines without a suite or an accuracy."""
    bad = scores.agg(F.count("*").alias("n"), F.count_if(F.col("suite").isNull() | F.col("accuracy").isNull()).alias("bad")).first()
    if not bad.n:
        raise ValueError("there is nothing to summarize")
    if bad.bad:
        raise ValueError(f"{bad.bad} score lines lack a suite or an accuracy")
    return summary(scores)


def unified(scores: DataFrame) -> DataFrame:
    """Mean over suites of their mean accuracy: a suite counts as much as any other."""
    by_suite = scores.groupBy("suite").agg(mean(F.col("accuracy")).alias("accuracy"))
    return by_suite.agg(F.count("*").alias("suites"), mean(F.col("accuracy")).alias("unified"))


def coverage(lines: DataFrame, failure: str = "failure", partial: bool = False) -> DataFrame:
    """Documents, answers, share answered, failures by cause (a null cause is an answer), and, in a partial grading that
    left documents unfinished (no_answer or not_scored), that it did and the first of their ids."""
    c = F.col(failure)
    left = c.isin("no_answer", "not_scored")
    causes = [F.count_if(c == x).alias(x) for x in ("system", "unusable", "no_answer", "not_scored")]
    some = [(F.count_if(left) > 0).alias("partial"), F.when(F.count_if(left) > 0, F.array(F.min(F.when(left, F.col("doc_id"))))).alias("examples")] if partial else [F.lit(False).alias("partial"), F.lit(None).cast("array<string>").alias("examples")]
    return lines.agg(F.count("*").alias("documents"), F.count_if(c.isNull()).alias("answered"), ratio(F.count_if(c.isNull()), F.count("*")).alias("coverage"), *causes, *some)


def total_cost(lines: DataFrame) -> DataFrame:
    """Sums of what answers cost and, where lines have them, of tokens; unknown ones left out."""
    tokens = [F.sum(c).alias(c) for c in ("input_tokens", "output_tokens") if c in lines.columns]
    return lines.agg(F.sum("usd").alias("usd"), F.count("usd").alias("known"), F.count_if(F.col("usd").isNull()).alias("unknown"), *tokens)
