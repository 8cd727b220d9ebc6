"""Helpers that the operators share: the shared folder, kept tables, partitioning by order."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SMALLEST = int(np.iinfo(np.int64).min)
_OWN_FOLDER: list[str] = []
_MADE: list[str] = []


#: Bytes of an Arrow batch that goes to a Python worker, and Spark's own default, in place of which it is set.
ARROW_BYTES, _DEFAULT_ARROW_BYTES = "16m", 64 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, and get texts in smaller batches unless the session sets a size."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB") == str(_DEFAULT_ARROW_BYTES):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH", ""), home) if x)
    return spark


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir.

    Only on one machine, as in tests, a local temporary folder serves where that setting is missing.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        if not _OWN_FOLDER:
            _OWN_FOLDER.append("file://" + tempfile.mkdtemp(prefix="tallyleaf-"))
        root = _OWN_FOLDER[0]
    _MADE.append(f"{root.rstrip('/')}/tallyleaf/{label}-{uuid.uuid4().hex}")
    return _MADE[-1]


def kept(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it again: cuts the lineage, and survives the loss of executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete folders through Spark's own file system layer."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clean(spark: SparkSession) -> None:
    """Delete all folders that operators made in this session; results that aren't written elsewhere can't be read after that."""
    while _MADE:
        dropped(spark, _MADE.pop())


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many more underscores as no column of the table has it; case doesn't count."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def let(value: Column, body) -> Column:
    """Bind a value once inside one expression, so that it isn't computed again at each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_sample(df: DataFrame, key: str, text: str, rows: int, chars: int) -> list[str]:
    """At most so many texts, those whose keys have the smallest hashes, and of each at most so many
    characters in a row from a place that the hash gives; empty ones go.

    The first pass reads keys alone and sends so many hashes from each task; the second cuts the texts.
    """
    mark = F.xxhash64(F.col(key))
    marks = df.select(mark.alias("mark")).orderBy("mark").limit(rows).collect()
    if not marks:
        return []
    place = F.pmod(mark, F.greatest(F.lit(1), F.length(text) - chars + 1)).cast("int") + 1
    cut = df.where((mark <= marks[-1].mark) & (F.length(text) > 0)).select(mark.alias("mark"), F.substring(F.col(text), place, F.lit(chars)).alias("t"))
    return [r.t for r in cut.orderBy("mark", "t").limit(rows).collect()]


def order_bounds(df: DataFrame, key: str, n: int, repeats: bool = False) -> list[int]:
    """At most n - 1 splitting values of an integer key; reads that column alone.

    With repeats null counts as the smallest value, and a value that holds many rows comes as often as it
    has n-ths of them, so that its rows can be dealt to as many buckets.
    """
    if n < 2:
        return []
    at = [i / n for i in range(1, n)]
    values = F.coalesce(F.col(key), F.lit(SMALLEST)) if repeats else F.col(key)
    row = df.agg(F.percentile_approx(values, F.array(*map(F.lit, at)), F.lit(max(10_000, 4 * n))).alias("b")).first()
    return sorted(row.b or []) if repeats else sorted(set(row.b or []))


def dealt_buckets(keys: pa.Array, bounds: np.ndarray, contents: list[bytes]) -> np.ndarray:
    """Buckets, from 0 and in the order of keys, by order_bounds with repeats; rows of a repeated bound are dealt by their contents."""
    values = keys.fill_null(SMALLEST).to_numpy(zero_copy_only=False)
    low, place = (np.searchsorted(bounds, values, side=s) for s in ("left", "right"))
    for i in np.flatnonzero(place - low > 1).tolist():
        place[i] = low[i] + 1 + zlib.crc32(contents[i]) % (place[i] - low[i])
    return place.astype(np.int32)


def order_bucket(key: Column, bounds: list[int]) -> Column:
    """The bucket, from 0, of each key: number of bounds that aren't above it; null: 0."""
    edges = np.array(bounds, dtype=np.int64)

    @F.arrow_udf("int")
    def bucket(ids: pa.Array) -> pa.Array:
        values = ids.fill_null(SMALLEST).to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(edges, values, side="right").astype(np.int32))

    return bucket(key.cast("long"))


def spread_bucket(key: Column, content: Column, part: Column, bounds: list[int]) -> Column:
    """As order_bucket, by order_bounds with repeats: rows of a repeated bound are dealt by content and part, which needn't tell them apart."""
    edges = np.array(bounds, dtype=np.int64)

    @F.arrow_udf("int")
    def bucket(ids: pa.Array, contents: pa.Array, parts: pa.Array) -> pa.Array:
        values = ids.fill_null(SMALLEST).to_numpy(zero_copy_only=False)
        low, high = (np.searchsorted(edges, values, side=s) for s in ("left", "right"))
        dealt = contents.to_numpy(zero_copy_only=False) + parts.to_numpy(zero_copy_only=False)
        return pa.array(np.where(high - low > 1, low + 1 + dealt % np.maximum(high - low, 1), high).astype(np.int32))

    return bucket(key.cast("long"), content.cast("long"), part.cast("long"))
