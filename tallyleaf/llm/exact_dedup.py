"""Exact deduplication by skew-safe combining.

1. Every row's normalised text is hashed once; rows are kept with their digest, without the text.
   Digests that only one row has are settled by that: their texts don't travel.
2. Texts of repeated digests are deduplicated where they are (the partial aggregate of each task), then
   merged by digest and salt, then the winners of a digest's salts are combined. The text itself is in
   the key of every stage, so contents are compared in full. A digest has one salt for each
   ``per_salt`` rows: a group that holds a third of all rows goes to as many tasks as it needs.
3. Rows find their group by digest and salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows of a digest for each of its salts, and the most digests that can have several: these are broadcast.
ROWS_PER_SALT, MAX_SALTED = 4_096, 100_000
#: Repeated digests that are broadcast, to leave out other texts: 32 bytes each. If there are more, all texts travel once.
MAX_REPEATED = 200_000
#: What is deleted before texts are compared.
BLANKS = " \t\n\x0b\x0c\r"


def normal(text: Column) -> Column:
    """The text without blanks; null as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), BLANKS, "")


def _digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_chars, digest, row): one for every row, ``row`` a number of its own once the table is written."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("key"), F.length(whole).cast("long").alias("n_chars"), _digest(normal(F.col(text))).alias("digest"), F.monotonically_increasing_id().alias("row"))


def _best() -> Column:
    """The row that stays: most code points, then the smallest key; one without a key only if no other is as long."""
    return F.struct("n_chars", F.col("key").isNotNull().alias("keyed"), F.bitwise_not("key").alias("low"))


def winners(contents: DataFrame, folder: str) -> DataFrame:
    """Rows (digest, norm, size, best) of distinct contents; contents: digest, norm, salt, salts, n_chars, key.

    Tasks deduplicate their own rows first, then those of one digest and salt meet, then, for digests
    with several salts, the winners of salts.
    """
    # Written, as both kinds of digests are read from it.
    salted = common.kept(contents.groupBy("digest", "norm", "salt", "salts").agg(F.count("*").alias("size"), F.max(_best()).alias("best")), f"{folder}/salt-winners")
    one = salted.where("salts = 1").select("digest", "norm", "size", "best")
    several = salted.where("salts > 1").groupBy("digest", "norm").agg(F.sum("size").alias("size"), F.max("best").alias("best"))
    return one.union(several)


def groups(docs: DataFrame, repeated: DataFrame, salted: DataFrame, filtered: bool, folder: str, key: str, text: str) -> DataFrame:
    """Rows (digest, size, best), one for each repeated digest, from whole texts."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.length(whole).cast("long").alias("n_chars"), normal(F.col(text)).alias("norm")).withColumn("digest", _digest(F.col("norm")))
    if filtered:
        rows = rows.join(F.broadcast(repeated.select("digest")), "digest", "left_semi")
    spread = rows.join(F.broadcast(salted), "digest", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    # A task has one winner of a content, so its salt can be the task's.
    found = winners(spread.withColumn("salt", F.when(F.col("salts") > 1, F.spark_partition_id() % F.col("salts")).otherwise(0)), folder)
    once = found.groupBy("digest").agg(F.count("*").alias("contents"), F.first("size").alias("size"), F.first("best").alias("best"))
    clash = F.raise_error(F.lit("two contents have one digest"))
    return once.select("digest", F.when(F.col("contents") == 1, F.col("size")).otherwise(clash.cast("long")).alias("size"), "best")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", per_salt: int = ROWS_PER_SALT, max_repeated: int = MAX_REPEATED) -> DataFrame:
    """Rows (key, keep_id, group_size, kept, digest) for every row.

    Texts are equal if they are so without blanks; null counts as empty, and texts of any length are
    read whole. Of equal ones the row with the most code points stays, then that with the smallest
    key; of rows that share these, one. Rows without a key are deduplicated like others, and stay only
    if none as long has a key: keep_id is null then. An empty table gives no rows. Keys are integers, or texts
    of integers. Other columns aren't read.
    """
    spark = common.ready(docs.sparkSession)
    folder = common.shared_folder(spark, "exact-dedup")
    rows = common.kept(digests(docs, key, text), f"{folder}/rows")
    repeated = common.kept(rows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"), f"{folder}/repeated")
    told = repeated.agg(F.count("*").alias("digests"), F.sum("n").alias("rows")).first()
    # At most MAX_SALTED digests can have more rows than that.
    per_salt = max(per_salt, -(-(told.rows or 0) // MAX_SALTED))
    salted = common.kept(repeated.where(F.col("n") > per_salt).select("digest", F.ceil(F.col("n") / per_salt).cast("int").alias("salts")), f"{folder}/salted")
    filtered = told.digests <= max_repeated
    # Without a filter, texts that are alone make groups too.
    found = common.kept(groups(docs, repeated, salted, filtered, folder, key, text), f"{folder}/groups")

    spread = rows.join(F.broadcast(salted), "digest", "left").withColumn("salt", F.when(F.col("salts") > 1, F.col("row") % F.col("salts")).otherwise(0)).drop("salts")
    by_salt = found.join(F.broadcast(salted), "digest", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)).cast("long") - 1))).drop("salts")
    met = spread.join(by_salt, ["digest", "salt"], "left").drop("salt")
    alone = F.col("size").isNull()
    placed = met.select("key", "n_chars", "digest", "row", F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.when(alone, F.col("key")).otherwise(F.bitwise_not("best.low")).alias("keep_id"), F.when(alone, F.col("n_chars")).otherwise(F.col("best.n_chars")).alias("most"))
    placed = common.kept(placed, f"{folder}/placed")
    stays = F.col("key").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("most"))
    # Rows of one key and length that tie: the first of them stays.
    tied = placed.where(stays & (F.col("group_size") > 1)).groupBy("digest").agg(F.min("row").alias("first"), F.count("*").alias("ties")).where("ties > 1").select("digest", "first")
    tied = common.kept(tied, f"{folder}/tied")
    if tied.isEmpty():
        return placed.select("key", "keep_id", "group_size", stays.alias("kept"), "digest")
    late = common.kept(placed.where(stays).select("digest", "row").join(tied, "digest").where("row != first").select("row"), f"{folder}/late")
    return placed.join(late.withColumn("late", F.lit(True)), "row", "left").select("key", "keep_id", "group_size", (stays & F.col("late").isNull()).alias("kept"), "digest")


def digest_rows(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; nulls, ties and other cases as in deduplicated()."""
    return deduplicated(docs).select(F.col("key").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))

