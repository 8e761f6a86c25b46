"""Typed cleaning of raw impressions with reason-coded quarantine."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import MODES, settings
from ..sources import raw as R
from .joins import bounded
from .layout import layout, target_files


def typed(raw: DataFrame, anchor_epoch: int) -> DataFrame:
    """Raw text to typed columns; `-1` is null where it means 'not applicable'."""
    has = set(raw.columns)
    whole = lambda c, kind="bigint": S.unless_sentinel(S.clean_cast(c, kind))
    lineage = [c for c in ("source_file", "source_dt") if c in has]
    return raw.select(
        S.row_key(R.RAW_COLUMNS).alias("impression_id"), S.instant(S.clean_cast("timestamp", "bigint"), anchor_epoch).alias("event_ts"), S.whole_text("uid").alias("user_id"),
        S.clean_cast("campaign", "bigint").alias("campaign_id"), S.flag("click").alias("is_click"), S.flag("conversion").alias("is_conversion_path"),
        S.instant(whole("conversion_timestamp"), anchor_epoch).alias("conversion_ts"), whole("conversion_id").alias("conversion_id"), S.flag("attribution").alias("is_attributed"),
        whole("click_pos", "int").alias("click_pos"), whole("click_nb", "int").alias("click_nb"), S.clean_cast("cost", "decimal(18,8)").alias("cost"),
        whole("cpo", "decimal(18,6)").alias("cpo"), whole("time_since_last_click").alias("time_since_last_click_s"), *[F.trim(f"cat{i}").alias(f"cat{i}") for i in range(1, 10)], *lineage,
    )


def row_rules() -> list[tuple[str, Column]]:
    """Reasons in the order they are tried."""
    c = F.col
    # The names of the reasons.
    return [
        ("bad_timestamp", c("event_ts").isNull()), ("bad_uid", c("user_id").isNull()), ("bad_campaign", c("campaign_id").isNull()),
        ("bad_flag", c("is_click").isNull() | c("is_conversion_path").isNull()), ("bad_cost", c("cost").isNull() | (c("cost") < 0)),
    ]


def classify(df: DataFrame) -> DataFrame:
    day = F.to_date("event_ts")
    if "source_dt" in df.columns:
        day = F.coalesce(day, F.col("source_dt").try_cast("date"))
    return df.withColumn("reject_reason", S.first_failure(row_rules())).withColumn("dt", day)


def check_reference(df: DataFrame, known: DataFrame, key: str = "campaign_id", reason: str = "unknown_campaign", broadcast: bool = True) -> DataFrame:
    """Rows with no earlier reason whose key is not in `known` get `reason`.
    `known` has one row a key. A reference list within the bound is broadcast;
    a larger one, or without `broadcast`, is joined by Spark's own choice."""
    small = known.select(F.col(key).alias("_k"), F.lit(True).alias("_known"))
    joined = df.join(bounded(small) if broadcast else small, F.col(key) == F.col("_k"), "left")
    return joined.withColumn("reject_reason", F.when(F.col("reject_reason").isNull() & F.col("_known").isNull(), reason).otherwise(F.col("reject_reason"))).drop("_k", "_known")


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected)"""
    return df.where("reject_reason is null").drop("reject_reason", "source_dt"), df.where("reject_reason is not null")


def dedupe(df: DataFrame, key: str = "impression_id") -> DataFrame:
    return df.dropDuplicates([key])


@dataclass
class CleanReport:
    rows_in: int
    rows_quarantined: int
    rows_out: int
    files_out: int
    reasons: dict[str, int]

    @property
    def duplicates_removed(self) -> int:
        return self.rows_in - self.rows_quarantined - self.rows_out

    def to_json(self) -> str:
        return json.dumps(self.__dict__ | {"duplicates_removed": self.duplicates_removed}, sort_keys=True)


def clean_days(
    spark: SparkSession, raw_root: str, clean_root: str, *, day: str | None, anchor_epoch: int, known: DataFrame | None = None, mode: str = "tuned", days: int = 1, ratio: float = 1.1, target_mb: int = 128
) -> CleanReport:
    """Clean one day or all days: good rows to `clean_root`/impressions,
    others to /quarantine, by day, replacing only the days present. Tuned mode
    deals each day to as many files as its bytes need, sorted within; a day's
    rejects lie together, in more files only where they are many."""
    with settings(spark, MODES[mode] | {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
        size = R.input_bytes(spark, f"{raw_root}/impressions" + (f"/dt={day}" if day else ""))
        rows = classify(typed(R.read_raw(spark, raw_root, day), anchor_epoch))
        if known is not None:
            rows = check_reference(rows, known, broadcast=mode == "tuned")
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            good, bad = split(rows)
            good = dedupe(good)
            if mode == "tuned":
                good = layout(good, target_files(size / max(days, 1), ratio, target_mb))
            good.write.mode("overwrite").partitionBy("dt").parquet(f"{clean_root}/impressions")
            bad.hint("rebalance", "dt").write.mode("overwrite").partitionBy("dt").parquet(f"{clean_root}/quarantine")
            reasons = {r["reject_reason"]: r["count"] for r in rows.groupBy("reject_reason").count().collect()}
        finally:
            rows.unpersist()
        written = spark.read.parquet(f"{clean_root}/impressions")
        written = written.where(F.col("dt") == F.lit(day).cast("date")) if day else written
        n_in = sum(reasons.values())
        return CleanReport(n_in, n_in - reasons.pop(None, 0), written.count(), R.file_count(written), reasons)
