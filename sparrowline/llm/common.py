"""What the operators share: reading tables, shared scratch folders, Arrow."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of an Arrow batch handed to Python. Documents may be long, so
#: both are bounded: Spark's default is 10,000 rows of any size. A batch holds at
#: least one row, whatever its size.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to those bounds. Frames are lazy, so every operator
    sets the same values and none puts others back."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder that the cluster names in
    `spark.checkpoint.dir`. A folder of our own is set only where that is
    unset (tests, a single machine)."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file:///tmp/checkpoints/{sc.applicationId}"
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there,
    and a lost executor costs no recomputation of what came before."""
    path = shared_dir(df.sparkSession, name)
    if _passing:
        _passing[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_passing: list[list[str]] = []


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that `cut` writes in this block are deleted when it ends, so
    only what is read later may be written outside of it."""
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            remove(spark, path)


def settled(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> tuple[DataFrame, str]:
    """What `build` gives, written and read back, and where it lies; the
    tables that were cut on the way are gone by then."""
    with passing_tables(spark):
        df, path = build(), shared_dir(spark, name)
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def source_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of the bytes below `df` (file sizes for scans)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def tasks_for(df: DataFrame, mb: int = 24) -> int:
    """Tasks so that each gets about `mb` MB of source files, and at least as
    many as the session's number of shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(100_000, max(least, -(-source_bytes(df) // (mb << 20))))


def utf8(col: str | None = "text") -> F.Column:
    """The column's text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


LONG, STR, BIN = T.LongType(), T.StringType(), T.BinaryType()


def schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])
