"""Queries over the operators, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import common, exact_dedup, language_id, line_rules, merkle, near_dups, order_minhash, packing, preference, ranked_search, token_files, trie_bpe, url_rules, warc

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Production parameters.
END_ID, PACK_END_ID, CAPACITY = 2, 0, 2048


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return common.ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.shared_folder(spark, "tokens")
    return token_files.digest_rows(_table(spark, sf_dir, "documents"), folder, BYTE_BPE, END_ID)


def op2_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest_rows(_table(spark, sf_dir, "documents"))


def op3_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_bpe.round_trip(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op4_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest_rows(_table(spark, sf_dir, "documents"), WORD_BPE, PACK_END_ID, CAPACITY)


def op5_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest_rows(_table(spark, sf_dir, "pages"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.digest_rows(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op7_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.digest_rows(_table(spark, sf_dir, "conversations"))


def op8_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.digest_rows(_table(spark, sf_dir, "documents"))


def op9_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.digest_rows(_table(spark, sf_dir, "documents"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.digest_rows(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest_rows(_table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.digest_rows(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.digest_rows(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_token_files, op2_language_codes, op3_trie_bpe, op4_residual_packing, op5_warc_zstd, op6_url_rules, op7_preference_format, op8_line_rules, op9_bottom_k, op10_order_minhash, op11_merkle_manifest, op12_ranked_search, op13_exact_dedup)
    }


def oracle_sql() -> dict[str, str]:
    from . import oracle

    return oracle.SQL
