"""Batch sources: raw impression files, change logs, staged Parquet."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The raw columns, in the order their digest is taken.
RAW_COLUMNS = [
    "timestamp", "uid", "campaign", "conversion", "conversion_timestamp", "conversion_id", "attribution", "click",
    "click_pos", "click_nb", "cost", "cpo", "time_since_last_click", *(f"cat{i}" for i in range(1, 10)),
]
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
CHANGE_SCHEMA = "campaign_id string, advertiser_id string, campaign_vertical string, budget_tier string, bid_strategy string, daily_budget_usd string, changed_at string, change_reason string"


def read_raw(spark: SparkSession, root: str, day: str | None = None) -> DataFrame:
    """All raw rows below `root`, or one day's, as text, with each row's file
    and day. The day is the table's partition column, so a single day is
    pruned by its folder; files of other names are left out."""
    table = f"{root}/impressions"
    layout = {"basePath": table, "sep": "\t", "header": True, "pathGlobFilter": "*.tsv.gz"}
    rows = spark.read.options(**layout).csv(table, schema=T.StructType([*RAW_SCHEMA, T.StructField("dt", T.DateType())]))
    if day is not None:
        rows = rows.where(F.col("dt") == F.lit(day).cast("date"))
    return rows.select(*RAW_COLUMNS, F.col("_metadata.file_path").alias("source_file"), F.col("dt").cast("string").alias("source_dt"))


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """The change log, typed; empty text is null."""
    c = spark.read.schema(CHANGE_SCHEMA).option("header", True).option("nullValue", "").csv(path)
    return c.select(
        F.col("campaign_id").try_cast("bigint").alias("campaign_id"), F.col("advertiser_id").try_cast("bigint").alias("advertiser_id"),
        *[F.lower(x).alias(x) for x in ("campaign_vertical", "budget_tier", "bid_strategy")],
        F.col("daily_budget_usd").try_cast("decimal(12,2)").alias("daily_budget_usd"), F.col("changed_at").try_cast("timestamp").alias("changed_at"), "change_reason",
    )


def reference_set(changes: DataFrame, key: str = "campaign_id") -> DataFrame:
    return changes.select(F.col(key).cast("bigint").alias(key)).where(F.col(key).isNotNull()).distinct()


def read_stage(spark: SparkSession, path: str, schema: T.StructType, day: str | None = None) -> DataFrame:
    """Staged Parquet, one day's partition or all, each column cast to the
    schema, with the file it came from."""
    df = spark.read.parquet(path)
    if day is not None:
        df = df.where(F.col("dt") == F.lit(day).cast("date"))
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema], F.col("_metadata.file_path").alias("raw_source_file"))


def input_bytes(spark: SparkSession, path: str) -> int:
    """Bytes below a path, through Hadoop's file system; 0 if it is missing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def file_count(df: DataFrame) -> int:
    return len(df.inputFiles())


def is_ready(spark: SparkSession, root: str, day: str) -> bool:
    """Whether the day's folder has its _SUCCESS marker."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/impressions/dt={day}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def wait_until_ready(spark: SparkSession, root: str, day: str, *, timeout: float = 6 * 3600, every: float = 300, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> None:
    """Ask for the day's marker until it is there; TimeoutError after
    `timeout` seconds. The last wait is cut short so the limit holds."""
    end = clock() + timeout
    while not is_ready(spark, root, day):
        left = end - clock()
        if left <= 0:
            raise TimeoutError(f"{root}: {day} is not there after {timeout} s")
        sleep(min(every, left))


def first_rows(df: DataFrame, n: int | None = None) -> Iterator[dict]:
    """Rows as dicts, at most `n`, one partition at a time: neither the driver
    nor an executor holds more than one."""
    for row in (df if n is None else df.limit(n)).toLocalIterator(prefetchPartitions=True):
        yield row.asDict()


def date_spine(spark: SparkSession, first: date | str, end: date | str, name: str = "date_day") -> DataFrame:
    """A row for each day from `first` to the day before `end`."""
    days = F.sequence(F.lit(str(first)).cast("date"), F.date_sub(F.lit(str(end)).cast("date"), 1))
    return spark.range(1, numPartitions=1).select(F.explode(days).alias(name))


def kafka_options(servers: str, topic: str, *, starting: str = "earliest", most_per_trigger: int = 200_000) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting, "maxOffsetsPerTrigger": str(most_per_trigger), "failOnDataLoss": "true"}


def kafka_stream(spark: SparkSession, servers: str, topic: str, **more) -> DataFrame:
    """Needs Spark's Kafka package on the class path."""
    return spark.readStream.format("kafka").options(**kafka_options(servers, topic, **more)).load()


def kafka_sink_options(servers: str, topic: str) -> dict[str, str]:
    """A producer that neither loses nor doubles what a task writes once."""
    return {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", "kafka.enable.idempotence": "true", "kafka.compression.type": "zstd"}


def write_kafka(records: DataFrame, servers: str, topic: str) -> None:
    """Records (key, value, headers if there) to a topic. A delivery error
    fails the task. Needs Spark's Kafka package on the class path."""
    columns = [c for c in ("key", "value", "headers") if c in records.columns]
    records.select(*columns).write.format("kafka").options(**kafka_sink_options(servers, topic)).save()


# The columns of Kafka's source.
KAFKA_SCHEMA = T.StructType([
    T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType()), T.StructField("topic", T.StringType()), T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()), T.StructField("timestamp", T.TimestampType()), T.StructField("timestampType", T.IntegerType()),
])


def record_files_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files with Kafka's columns, one file for each micro-batch."""
    return spark.readStream.schema(KAFKA_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def record_partition(key: Column, n: int = 6) -> Column:
    """The partition of a record: the first 32 bits of the key's MD5, mod n."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % n).cast("int")


HEADERS = "array<struct<key:string,value:binary>>"


def kafka_shaped(records: DataFrame, order: list[str], *, partitions: int = 6, headers: dict[str, str] | None = None) -> DataFrame:
    """Records (key, value, topic, timestamp) as a broker would hold them:
    the partition of the key, offsets from 0 in each partition, a broker time
    that ascends by a microsecond a record, and headers. `order` is the order
    of arrival, unique to a row, its first column a time.

    Offsets need no task to see a whole partition: rows are numbered by
    partition and hour, and shifted by the counts of the hours before."""
    rows = records.withColumn("partition", record_partition(F.col("key"), partitions)).withColumn("_hour", F.floor(F.unix_seconds(F.col(order[0]).cast("timestamp")) / 3600))
    counts = rows.groupBy("partition", "_hour").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("partition").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select("partition", "_hour", F.coalesce(before, F.lit(0)).alias("_shift"))
    nth = F.row_number().over(Window.partitionBy("partition", "_hour").orderBy(*order)) - 1
    numbered = rows.withColumn("_nth", nth).join(shifts, ["partition", "_hour"]).withColumn("offset", F.col("_shift") + F.col("_nth"))
    at = F.timestamp_micros(F.unix_micros(F.col("timestamp").cast("timestamp")) + F.col("offset"))
    said = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).cast("binary").alias("value")) for k, v in (headers or {}).items()]).cast(HEADERS)
    others = [F.col(f"`{c}`") for c in records.columns if c not in ("key", "value", "topic", "timestamp")]
    return numbered.select("key", "value", "topic", "partition", "offset", at.alias("timestamp"), F.lit(0).alias("timestampType"), said.alias("headers"), *others)
