"""Tables kept in a folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_MADE: list[str] = []
#: Rows that one task works on, and bytes of a shuffle that one takes at most where tasks are joined: leaves are packed to a tenth there.
ROWS_OF_A_TASK, SHUFFLED_BYTES = 250_000, 8 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it."""
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH", ""), home) if x)
    return spark


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir; a local one only on one machine where that isn't set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="tallyleaf-"))
        root = _LOCAL[0]
    _MADE.append(f"{root.rstrip('/')}/tallyleaf/{label}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clean(spark: SparkSession) -> None:
    """Delete all folders that were made in this session; results that aren't written elsewhere can't be read after that."""
    while _MADE:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def kept(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it again, which cuts its lineage."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for a number of rows: as many as the session's shuffles have at least; a task's rows don't grow with the table."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_OF_A_TASK))


@contextmanager
def sized(spark: SparkSession, rows: int) -> Iterator[None]:
    """While tables of that many rows are written: shuffles have as many tasks as rows need, and few bytes each."""
    wanted = {"spark.sql.shuffle.partitions": str(tasks_for(spark, rows))}
    advised = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    # Unless the session says it.
    if spark.conf.get(advised, None) is None:
        wanted[advised] = str(SHUFFLED_BYTES)
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def spread(df: DataFrame, rows: int, path: str, *keys: str) -> DataFrame:
    """A kept table of that many rows, dealt anew by keys to the cores at least if a few files hold it."""
    files, cores = len(df.inputFiles()), df.sparkSession.sparkContext.defaultParallelism
    if rows < ROWS_OF_A_TASK or files >= max(cores, rows // ROWS_OF_A_TASK):
        return df
    return kept(df.repartition(max(cores, -(-rows // ROWS_OF_A_TASK)), *keys), path)


def _located(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    # Without check sums beside local files, which people may edit.
    checked = spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.ChecksumFileSystem").isInstance(system)
    return where, system.getRawFileSystem() if checked else system


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system its path names."""
    where, system = _located(spark, path)
    return system.exists(where)


def committed(spark: SparkSession, pattern: str) -> list[str]:
    """Folders that match a pattern and that Spark has written to the end."""
    where, system = _located(spark, f"{pattern}/_SUCCESS")
    return sorted(f.getPath().getParent().toString() for f in system.globStatus(where) or ())


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file."""
    where, system = _located(spark, path)
    stream = system.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file, and its folder if there is none."""
    where, system = _located(spark, path)
    stream = system.create(where, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()


def dropped(spark: SparkSession, path: str) -> None:
    where, system = _located(spark, path)
    system.delete(where, True)
