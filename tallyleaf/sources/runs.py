"""Run folders: records, scores, details and summary, and the cache that says what to score again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyleaf.functions.addresses import show

from . import tables

#: Most files that the details of one suite are dealt to.
DETAIL_FILES = 64
#: Calls after which a snapshot of the newest rows is written.
COMPACTED = 16


def score_lines(scores: DataFrame) -> DataFrame:
    """Scores as lines: everything that identifies a document under ``row``."""
    about = [c for c in ("suite", "pages", "scanned", "gold_chars", "table_rows", "num_values", "num_null", "max_depth") if c in scores.columns]
    return scores.select("doc_id", F.struct(*about).alias("row"), *[c for c in scores.columns if c not in (*about, "doc_id")])


def write_scores(scores: DataFrame, folder: str) -> None:
    score_lines(scores).write.mode("overwrite").json(f"{folder}/scores")


def write_details(verdicts: DataFrame, docs: DataFrame, folder: str) -> None:
    """One verdict per address, with its document's suite, in directories by suite; a document's verdicts stand in a row."""
    rows = verdicts.join(docs.select("doc_id", "suite"), "doc_id").withColumns({"address": show(F.col("address")), "document": F.col("doc_id"), "of_suite": F.col("suite")})
    placed = rows.repartition("of_suite", F.pmod(F.xxhash64("doc_id"), F.lit(DETAIL_FILES)))
    placed.sortWithinPartitions("of_suite", "doc_id", "address").write.mode("overwrite").partitionBy("of_suite").json(f"{folder}/details")


def _number(path: str) -> int:
    return int(path.rsplit("=", 1)[1])


def _parts(spark, path: str, below: int | None) -> tuple[str | None, list[str]]:
    """Of a folder of calls: the newest snapshot, and the calls after it; only those below a number, if one is given."""
    fits = lambda found: sorted((p for p in found if below is None or _number(p) < below), key=_number)
    snapshot = next(reversed(fits(tables.committed(spark, f"{path}/snapshot=*"))), None)
    calls = fits(tables.committed(spark, f"{path}/call=*"))
    return snapshot, [c for c in calls if snapshot is None or _number(c) > _number(snapshot)]


def newest(spark, path: str, below: int | None = None) -> DataFrame | None:
    """Of a folder with one directory for each call, the newest row of each document; None if no call has come to its end yet.

    Reads the newest snapshot and what was called after it. ``below`` leaves out calls from that number on.
    """
    snapshot, calls = _parts(spark, path, below)
    if snapshot is None and not calls:
        return None
    rows = None if snapshot is None else spark.read.parquet(snapshot)
    if calls:
        tails = spark.read.option("mergeSchema", True).option("basePath", path).parquet(*calls)
        rows = tails if rows is None else rows.unionByName(tails, allowMissingColumns=True)
    return rows.groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "doc_id"]), "call").alias("r")).select("doc_id", "r.*")


def compact(spark, path: str, below: int | None = None, calls: int = COMPACTED) -> None:
    """Write the newest rows as a snapshot if so many calls came after the last one. Calls stay; a snapshot that isn't finished doesn't count."""
    _, found = _parts(spark, path, below)
    if len(found) >= calls:
        number = _number(found[-1])
        newest(spark, path, number + 1).write.mode("overwrite").parquet(f"{path}/snapshot={number}")


def last_call(spark, path: str, below: int | None = None) -> DataFrame | None:
    """The rows of the last call alone."""
    calls = _parts(spark, path, below)[1]
    return spark.read.parquet(calls[-1]) if calls else None


def next_call(before: DataFrame | None) -> int:
    """The number of the next call of such a folder, from its newest rows."""
    return 0 if before is None else before.agg(F.max("call")).first()[0] + 1


def add_call(df: DataFrame, path: str, before: DataFrame | None) -> None:
    """Write rows as the next call of such a folder."""
    number = next_call(before)
    df.write.mode("overwrite").parquet(f"{path}/call={number}")
    compact(df.sparkSession, path)


def summary_object(summary: DataFrame, covered: DataFrame) -> DataFrame:
    """One row: documents, headline and what it is, failures by cause, coverage, means overall and by suite, and, if documents are unfinished, how many and which."""
    means = F.struct(*[c for c in summary.columns if c not in ("grain", "suite")])
    one = summary.agg(F.max(F.when(F.col("grain") == "overall", means)).alias("overall"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("grain") == "suite", F.struct(F.col("suite"), means))))).alias("suites"))
    left = F.struct("no_answer", "not_scored", F.col("examples").alias("e.g."))
    about = [F.col("overall.rows").alias("rows"), F.col("overall.accuracy").alias("headline"), F.lit("accuracy").alias("headline_is"), F.struct("system", "unusable", "no_answer", "not_scored").alias("failed"), "coverage", F.when(F.col("partial"), left).alias("partial")]
    return one.crossJoin(covered).select(*about, "overall", "suites")


def write_summary(summary: DataFrame, folder: str, covered: DataFrame) -> None:
    """That object as a file of JSON."""
    summary_object(summary, covered).coalesce(1).write.mode("overwrite").json(f"{folder}/summary")


def fingerprint(*parts: Column) -> Column:
    """Hash of all that a score depends on; nulls differ from empty texts."""
    marked = [F.when(p.isNull(), "n").otherwise(F.concat(F.lit("v"), F.length(p).cast("string"), F.lit(":"), p)) for p in parts]
    return F.sha2(F.concat(*marked), 256)


def marked(docs: DataFrame, scorer: str = "1") -> DataFrame:
    """Documents with the fingerprint of all that their score depends on."""
    return docs.withColumn("fingerprint", fingerprint(F.col("gold"), F.col("pred"), F.col("schema"), F.lit(scorer)))


def stale(docs: DataFrame, cache: DataFrame, scorer: str = "1") -> DataFrame:
    """Documents whose prediction, gold, schema or scorer isn't that of their cached score, with the fingerprint."""
    return marked(docs, scorer).join(cache.select("doc_id", "fingerprint"), ["doc_id", "fingerprint"], "left_anti")


def pending(manifest: DataFrame, records: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Documents without a record; with retry_failed also those whose failure may pass."""
    done = records if not retry_failed else records.where(~F.coalesce(F.col("error.transient"), F.lit(False)))
    return manifest.join(done.select("doc_id"), "doc_id", "left_anti")


def transient(kind: Column, status: Column) -> Column:
    """Whether a failure may pass: time-outs, unreachable systems, 429 and 5xx; never a schema that can't be expressed."""
    return F.coalesce((kind != "dialect") & (kind.isin("timeout", "unreachable") | (status == 429) | status.between(500, 599)), F.lit(False))


def first_rows(manifest: DataFrame, n: int, by: str = "ordinal") -> DataFrame:
    """The first n documents in manifest order."""
    return manifest.orderBy(by).limit(n)


def sampled(manifest: DataFrame, n: int, by: str = "ordinal") -> DataFrame:
    """n documents, evenly spaced over the manifest's order: the rows at floor(i * rows / n). The order is numbered from 0 without gaps."""
    rows = manifest.count()
    if n >= rows:
        return manifest
    at = F.col(by).cast("long")
    return manifest.where(F.floor((at + 1) * n / rows) > F.floor(at * n / rows)) if n > 0 else manifest.limit(0)


def chosen(manifest: DataFrame, rows: dict) -> DataFrame:
    """The documents that a run asks for: all, or those of one of limit (the first n; 0: all), sample (n evenly spaced) and only (ids)."""
    given = {k: v for k, v in rows.items() if v not in (None, 0, [])}
    if unknown := set(given) - {"limit", "sample", "only"}:
        raise ValueError(f"rows has no {min(unknown)!r}: it takes limit, sample or only")
    if len(given) > 1:
        raise ValueError(f"rows takes one of {' and '.join(sorted(given))}")
    for way, value in given.items():
        if way == "only":
            return only(manifest, [value] if isinstance(value, str) else list(value))
        if not isinstance(value, int) or isinstance(value, bool) or value < 0:
            raise ValueError(f"rows.{way} is a number of documents, not {value!r}")
        return first_rows(manifest, value) if way == "limit" else sampled(manifest, value)
    return manifest


def only(manifest: DataFrame, ids: list[str]) -> DataFrame:
    """Documents with the ids; unknown ids are an error."""
    found = manifest.where(F.col("doc_id").isin(ids))
    missing = sorted(set(ids) - {r.doc_id for r in found.select("doc_id").collect()})
    if missing:
        raise ValueError(f"the manifest has no document {missing[0]!r}")
    return found
