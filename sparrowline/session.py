"""Sessions with the settings the engine relies on."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

BASE = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    "spark.sql.adaptive.enabled": "true",
}
#: The clean job before and after tuning.
MODES = {
    "baseline": {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"},
    "tuned": {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.autoBroadcastJoinThreshold": "10485760"},
}
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    return b.config(map=BASE | conf).getOrCreate()


def pin(spark: SparkSession) -> SparkSession:
    """Set what results depend on, on a session made elsewhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """These settings inside the block; afterwards what was there before."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def warehouse_name(target: str, schema: str | None, default: str) -> str:
    """Schema routing: production uses the schema itself, others prefix it."""
    if not schema:
        return default
    return schema.strip() if target == "prod" else f"{default}_{schema.strip()}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below the cluster's
    `spark.checkpoint.dir`, or a local one where that is unset and the master
    is local (tests)."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if not root and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = root or f"file:///tmp/checkpoints/{sc.applicationId}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
