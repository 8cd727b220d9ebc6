"""The corpus pipeline: language ID, quality rules, near-duplicates, packing.

Every stage reads what its predecessor kept, from Parquet in the shared folder. An empty table stays
empty in all of them, texts of any length are processed whole, and further columns of documents pass
through the first three, also where their names are those of helpers inside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyleaf.llm import common, language_id, line_rules, near_dups, packing
from tallyleaf.llm.queries import CAPACITY, PACK_END_ID, WORD_BPE


#: Words in a shingle, and percent of the union that two near-duplicates share at least.
SHINGLE_WORDS, PERCENT = 5, 80
#: Different texts that have to have a line before it is boilerplate: copies are left for near-duplicate removal.
TEXT_LIMIT = 10


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known and not ambiguous; learnt from those that aren't held out.

    Null and empty texts, and those without a letter, go. Repeated rows fare alike. If nothing can be learnt, all go.
    """
    return language_id.keep_identified(docs)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and keep enough of their words, without the lines that are removed.

    Null and empty texts go. Repeated rows are judged alike, and all stay or go.
    """
    return line_rules.keep_good(docs, text_limit=TEXT_LIMIT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group.

    Empty texts and rows without an id stay; of rows that share an id all stay or go.
    """
    return near_dups.keep_first(docs, SHINGLE_WORDS, PERCENT)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences. Null and empty texts are one piece of the end id alone; repeated rows are packed each."""
    return packing.digest_rows(docs, WORD_BPE, PACK_END_ID, CAPACITY)


STAGES = [("language_id", identify), ("quality_rules", filter_quality), ("near_duplicates", drop_near_duplicates), ("packing", pack)]

#: Learning and packing can't be said in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents table."""
    common.ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = common.shared_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = common.kept(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
