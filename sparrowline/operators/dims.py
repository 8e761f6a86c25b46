"""Dimensions: dates, segments, and slowly changing campaigns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.raw import date_spine

FIRST, LAST = "1900-01-01", "9999-12-31"


def dim_date(spark: SparkSession, first: str, end: str) -> DataFrame:
    d = F.col("date_day")
    return date_spine(spark, first, end).select(
        S.date_key(d).alias("date_key"), d, (F.weekday(d) + 1).alias("day_of_week_iso"), F.dayname(d).alias("day_name"), F.to_date(F.date_trunc("week", d)).alias("week_start"),
        F.weekofyear(d).alias("iso_week"), F.to_date(F.date_trunc("month", d)).alias("month_start"), F.monthname(d).alias("month_name"), F.quarter(d).alias("quarter"), F.year(d).alias("year"),
        (F.weekday(d) + 1).isin(6, 7).alias("is_weekend"), (F.datediff(d, F.lit(first).cast("date")) + 1).alias("dataset_day_number"),
    )


def dim_segment(facts: DataFrame, code: str = "device_segment_code") -> DataFrame:
    """A row for each segment but 'unknown', and the unknown member."""
    seen = facts.where(F.col(code) != "unknown").select(F.col(code).alias("device_segment_code")).distinct()
    known = seen.select(S.surrogate_key(F.col("device_segment_code")).alias("device_key"), "device_segment_code", F.concat(F.lit("segment_"), F.col("device_segment_code")).alias("device_segment_label"), F.lit(False).alias("is_unknown"))
    one = facts.sparkSession.range(1, numPartitions=1).select(F.lit(S.UNKNOWN_KEY).alias("device_key"), F.lit("unknown").alias("device_segment_code"), F.lit("Unknown segment").alias("device_segment_label"), F.lit(True).alias("is_unknown"))
    return known.unionByName(one)


def keep_last(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in an order, found before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def scd2(changes: DataFrame, *, key: str, at: str, attributes: list[str], sk: str, unknown: dict | None = None) -> DataFrame:
    """Versions with half-open validity from a change log that is unique in
    (key, at). A key's first version reaches back to FIRST."""
    w = Window.partitionBy(key).orderBy(at)
    kind = changes.schema[at].dataType.simpleString()
    day = lambda x: F.lit(x).cast(kind)
    v = changes.withColumn("_next", F.lead(at).over(w)).withColumn("version_number", F.row_number().over(w))
    out = v.select(
        S.surrogate_key(F.col(key), F.col(at)).alias(sk), key, *attributes, F.when(F.col("version_number") == 1, day(FIRST)).otherwise(F.col(at)).alias("valid_from"),
        F.coalesce("_next", day(LAST)).alias("valid_to"), F.col("_next").isNull().alias("is_current"), "version_number",
    )
    if unknown is None:
        return out
    fixed = {sk: S.UNKNOWN_KEY, "valid_from": FIRST, "valid_to": LAST, "is_current": True, "version_number": 1} | unknown
    one = changes.sparkSession.range(1, numPartitions=1).select(*[F.lit(fixed.get(f.name)).cast(f.dataType).alias(f.name) for f in out.schema])
    return out.unionByName(one)
