"""Manifests of documents, and the golds and predictions they point to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NEEDED = ("doc_id", "suite", "doc_path", "gt_path", "schema")
DEFAULT_SUITE = "other"


def default_suite(suite: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(suite), F.lit("")), F.lit(DEFAULT_SUITE))


def problems(manifest: DataFrame) -> DataFrame:
    """Rows (doc_id, problem) that make a manifest unfit; none if it is fine. One pass over the rows, and one aggregate for ids."""
    twice = manifest.groupBy(F.lower("doc_id").alias("low")).agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n > 1")
    schema = F.schema_of_variant(F.try_parse_json("schema"))
    outside = lambda c: F.col(c).rlike(r"^/|(^|/)\.\.(/|$)")
    tests = {
        "no id": F.col("doc_id").isNull() | (F.col("doc_id") == ""),
        "the id has a slash": F.contains("doc_id", F.lit("/")),
        "the schema isn't a non-empty object": schema.isNull() | ~schema.startswith("OBJECT<") | (schema == "OBJECT<>"),
        "a path leads out of the dataset": F.coalesce(outside("doc_path"), F.lit(False)) | F.coalesce(outside("gt_path"), F.lit(False)),
    }
    found = manifest.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(test, F.lit(text)) for text, test in tests.items()]))).alias("problem"))
    return found.union(twice.select("doc_id", F.lit("the id comes twice, if case is ignored")))


def checked(manifest: DataFrame) -> DataFrame:
    """The manifest with default suites, other columns as they are; raises on the first problem, by id."""
    lacking = [c for c in NEEDED if c not in manifest.columns]
    if lacking:
        raise ValueError(f"the manifest has no {', '.join(lacking)}")
    kinds = dict(manifest.dtypes)
    for c in ("doc_id", "suite", "schema"):
        if kinds[c] not in ("string", "void"):
            raise TypeError(f"{c} isn't text but {kinds[c]}")
    if manifest.isEmpty():
        raise ValueError("the manifest has no rows")
    bad = problems(manifest).orderBy(F.asc_nulls_first("doc_id"), "problem").first()
    if bad is not None:
        raise ValueError(f"{bad.doc_id}: {bad.problem}")
    return manifest.withColumn("suite", default_suite(F.col("suite")))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows of Parquet files with ``ordinal``, their number from 0 without gaps, by file and place in it: from counts per file, without a sort."""
    placed = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != "ordinal"], F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    # One row for each file.
    files = placed.groupBy("_file").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_file")) - F.col("_n")
    return placed.join(F.broadcast(files.select("_file", before.alias("_before"))), "_file").withColumn("ordinal", F.col("_before") + F.col("_place")).drop("_file", "_place", "_before")


def read(spark: SparkSession, dataset: str, name: str = "manifest.parquet") -> DataFrame:
    """A dataset's manifest, checked, with the place of every document in it."""
    return checked(numbered(spark.read.parquet(f"{dataset.rstrip('/')}/{name}")))


def json_files(spark: SparkSession, folder: str, column: str) -> DataFrame:
    """Rows (doc_id, column) of the files <doc_id>.json below a folder; a byte order mark is taken off."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return files.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("doc_id"), F.regexp_replace("value", "^﻿", "").alias(column))


def is_object(text: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT<"), F.lit(False))


def with_golds(manifest: DataFrame, golds: DataFrame) -> DataFrame:
    """The manifest with column gold; the first document, by id, without a readable object fails."""
    joined = manifest.join(golds, "doc_id", "left")
    bad = joined.where(~is_object(F.col("gold"))).agg(F.min("doc_id").alias("doc_id")).first()
    if bad.doc_id is not None:
        raise ValueError(f"{bad.doc_id}: its gold is missing or no JSON object")
    return joined


def with_predictions(manifest: DataFrame, predictions: DataFrame) -> DataFrame:
    """The manifest with columns pred (null if there is no usable answer) and failure (no_answer, unusable or null)."""
    joined = manifest.join(predictions, "doc_id", "left")
    fine = is_object(F.col("pred"))
    return joined.withColumn("failure", F.when(F.col("pred").isNull(), "no_answer").when(~fine, "unusable")).withColumn("pred", F.when(fine, F.col("pred")))


def write_new(df: DataFrame, path: str, sources: tuple[str, ...] = ()) -> None:
    """Write a table that wasn't there, never over what it was made from."""
    clean = lambda p: p.rstrip("/").removeprefix("file://")
    if clean(path) in map(clean, sources):
        raise ValueError("the output would replace its source")
    df.write.mode("errorifexists").parquet(path)


def documents(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Binary documents: path, bytes, content."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return found.select("path", F.col("length").alias("bytes"), "content")
