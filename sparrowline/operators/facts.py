"""Facts, last-click attribution, and the daily performance mart."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from .joins import interval_join, unknown_member


def stage_impressions(clean: DataFrame) -> DataFrame:
    return clean.withColumns({"event_date": F.to_date("event_ts"), "is_attributed": F.coalesce("is_attributed", F.lit(False)), "device_segment_code": F.coalesce(F.nullif(F.col("cat1"), F.lit("")), F.lit("unknown"))})


def fct_impressions(staged: DataFrame, campaigns: DataFrame, segments: DataFrame) -> DataFrame:
    """Each impression with the campaign version in force at its time and its
    segment; unknown members where there is none."""
    facts = interval_join(staged, campaigns.where("campaign_id <> -1"), "campaign_id", "event_ts", ["campaign_sk"])
    # segments are the distinct values of one low-cardinality column; Spark broadcasts them by their size
    facts = facts.join(segments.select("device_segment_code", "device_key"), "device_segment_code", "left")
    plain = ["user_id", "cost", "is_click", "is_conversion_path", "conversion_id", "conversion_ts", "is_attributed", "click_pos", "click_nb", "cpo", "time_since_last_click_s"]
    return facts.select("impression_id", "event_ts", S.date_key(F.col("event_date")).alias("date_key"), unknown_member(F.col("campaign_sk")).alias("campaign_sk"), "campaign_id", unknown_member(F.col("device_key")).alias("device_key"), *[c for c in plain if c in staged.columns])


def fct_clicks(impressions: DataFrame) -> DataFrame:
    return impressions.where("is_click").select(S.surrogate_key(F.col("impression_id")).alias("click_id"), "impression_id", F.col("event_ts").alias("click_ts"), "date_key", "campaign_sk", "campaign_id", "device_key", "user_id", *[c for c in ("click_pos", "click_nb") if c in impressions.columns], "cost", "conversion_id")


def fct_conversions(impressions: DataFrame) -> DataFrame:
    """A row for each conversion: last-click credit, else last touch.

    One aggregate does it: the credited touch is the greatest by (clicked,
    time, smaller id), the last touch by (time, smaller id), so the path is
    shuffled once, with partial results first."""
    path = impressions.where("conversion_id is not null and event_ts <= conversion_ts")
    touch = F.struct("impression_id", "campaign_sk", "campaign_id", "device_key", "is_click", *[c for c in ("cpo",) if c in impressions.columns])
    # ids are compared downwards by taking the least struct of negated times
    late = -F.unix_micros(F.col("event_ts").cast("timestamp"))
    credit = F.min(F.struct((~F.col("is_click")).cast("int").alias("a"), late.alias("b"), F.col("impression_id").alias("c"), touch.alias("t"))).alias("credit")
    last = F.min(F.struct(late.alias("b"), F.col("impression_id").alias("c"))).alias("last")
    agg = path.groupBy("conversion_id").agg(
        credit, last, F.max("conversion_ts").alias("conversion_ts"), F.min("user_id").alias("user_id"), F.count("*").alias("path_impressions"), F.count_if("is_click").alias("path_clicks"),
        F.bool_or("is_attributed").alias("is_attributed"), F.min("event_ts").alias("first_touch_ts"), F.sum("cost").alias("path_cost"),
    )
    t = "credit.t."
    return agg.select(
        "conversion_id", "conversion_ts", S.date_key(F.to_date("conversion_ts")).alias("conversion_date_key"), "user_id", F.col(t + "impression_id").alias("credited_impression_id"),
        F.col(t + "campaign_sk").alias("credited_campaign_sk"), F.col(t + "campaign_id").alias("credited_campaign_id"), F.col(t + "device_key").alias("credited_device_key"), F.col(t + "is_click").alias("credited_by_click"),
        F.col("last.c").alias("last_touch_impression_id"), F.col("is_attributed").alias("is_attributed_to_source"), "path_impressions", "path_clicks", "path_cost",
        *([F.col(t + "cpo").alias("cpo")] if "cpo" in impressions.columns else []), S.seconds_between(F.col("first_touch_ts"), F.col("conversion_ts")).alias("seconds_first_touch_to_conversion"),
    )


def mart_campaign_daily(impressions: DataFrame, conversions: DataFrame, dates: DataFrame, campaigns: DataFrame) -> DataFrame:
    """A row for each campaign and day. Delivery counts by the day of the
    impression, conversions by their own day and credited campaign; attributes
    are those in force at the end of the day. Days outside `dates` drop out."""
    delivery = impressions.groupBy("campaign_id", "date_key").agg(F.count("*").alias("impressions"), F.count_if("is_click").alias("clicks"), F.sum("cost").alias("spend"), F.countDistinct("user_id").alias("reached_users"))
    credited = conversions.groupBy(F.col("credited_campaign_id").alias("campaign_id"), F.col("conversion_date_key").alias("date_key")).agg(F.count("*").alias("conversions"), F.count_if("is_attributed_to_source").alias("attributed_conversions"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    both = delivery.join(credited, ["campaign_id", "date_key"], "full").select("campaign_id", "date_key", *map(zero, ("impressions", "clicks", "spend", "reached_users", "conversions", "attributed_conversions")))
    dated = both.join(dates.select("date_key", "date_day"), "date_key")
    kind = campaigns.schema["valid_from"].dataType
    dated = dated.withColumn("_end", F.date_add("date_day", 1).cast(kind))
    attributes = [c for c in ("campaign_sk", "advertiser_id", "campaign_vertical", "budget_tier", "bid_strategy") if c in campaigns.columns]
    x = interval_join(dated, campaigns.where("campaign_id <> -1"), "campaign_id", "_end", attributes, closed_end=True)
    c = F.col
    return x.select(
        S.surrogate_key(c("campaign_id"), c("date_key")).alias("campaign_day_id"), "date_key", "date_day", "campaign_id", *attributes, "impressions", "clicks", "conversions", "attributed_conversions", "reached_users", "spend",
        S.ratio_or_zero(c("clicks"), c("impressions")).alias("ctr"), S.ratio_or_zero(c("conversions"), c("clicks")).alias("cvr"), S.ratio_or_zero(c("spend"), c("clicks")).alias("cpc"),
        (S.ratio_or_zero(c("spend"), c("impressions")) * 1000).alias("cpm"), S.ratio_or_null(c("spend"), c("attributed_conversions")).alias("cpa"),
    )


def replace_batches(spark: SparkSession, table: DataFrame, path: str, *, event_time: str, first: str, end: str, lookback: int = 1, day: str = "dt") -> None:
    """Rebuild the days [first - lookback, end) of a table partitioned by day,
    and only those. Days without rows now are emptied too; which these are is
    observed while the rows are written."""
    since, stop = date.fromisoformat(first) - timedelta(lookback), date.fromisoformat(end)
    days = [str(since + timedelta(k)) for k in range((stop - since).days)]
    at = F.to_date(event_time)
    rows = table.where((at >= F.lit(since)) & (at < F.lit(stop))).withColumn(day, at)
    seen = Observation()
    observed = rows.observe(seen, *[F.count_if(F.col(day) == F.lit(d).cast("date")).alias(d) for d in days]) if days else rows
    observed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
    for d in days:
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{day}={d}")
        fs = gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not seen.get[d] and fs.exists(gone):
            fs.delete(gone, True)
