"""What the operators of this subpackage share: tables in the shared folder, vocabularies, row keys."""

from __future__ import annotations

import base64
import ctypes
import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir.

    Only where the session names none and runs on one machine (tests), a temporary folder is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isDefined():
            named = jsc.getCheckpointDir().get()
        elif jsc.isLocal():
            named = tempfile.mkdtemp(prefix="seriesloom-")
            spark.sparkContext.setCheckpointDir(named)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    file_system, at = _file_system(spark, path)
    file_system.deleteOnExit(at)
    return path


def _file_system(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: a lost executor costs no recomputation of it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(table: DataFrame) -> None:
    """Deletes what stored() wrote, when nothing will read it again."""
    file_system, at = _file_system(table.sparkSession, table.stored_at)
    file_system.delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """At most so many rows stand in a batch between the JVM and Python workers: whole texts, which both hold outside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def row_key(*cols: str) -> Column:
    """A key of 128 bits for what a row holds: equal rows have the same, at any time and on any executor."""
    parts = [F.coalesce(F.col(c).cast("binary"), F.lit(b"\x00null")) if c == "text" else F.coalesce(F.col(c).cast("string"), F.lit("\x00null")).cast("binary") for c in cols]
    lengths = [F.coalesce(F.length(F.col(c).cast("string")), F.lit(-1)).cast("string").cast("binary") for c in cols]
    return F.unhex(F.md5(F.concat(*[x for p in zip(lengths, parts, strict=True) for x in (p[0], F.lit(b":"), p[1])])))


def returned() -> None:
    """Gives memory that a task of this Python worker no longer needs back to the machine; the worker lives on for others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def vocabulary(name: str) -> str:
    """The path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN
