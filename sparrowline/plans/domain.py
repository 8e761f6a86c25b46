"""The ad domain over the driver's tables: which columns play which part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import dims, facts
from ..session import pin
from ..sources.raw import RAW_COLUMNS

ANCHOR, ANCHOR_EPOCH, END = "2024-01-01", 1_704_067_200, "2024-01-31"
#: Every n-th event gets a fault when it is written as raw text.
FAULTS = {"timestamp": 97, "uid": 89, "campaign": 83, "click": 79, "cost": 73}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as clean impressions. A touch belongs to the next purchase of
    its user, a conversion. It is sought on the touch's day, by user and day;
    where that has none left, the first one of a later day is looked up in a
    table with a row for each user and day."""
    e = events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    buy = F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))
    today = F.first(buy, ignorenulls=True).over(Window.partitionBy("k", "day").orderBy("ts", "event_id").rowsBetween(0, Window.unboundedFollowing))
    after = F.min("buy").over(Window.partitionBy("k").orderBy("day").rowsBetween(1, Window.unboundedFollowing))
    later = e.groupBy("k", "day").agg(F.min(buy).alias("buy")).select("k", "day", after.alias("later"))
    e = e.withColumn("today", today).join(later, ["k", "day"]).where("event_type <> 'purchase' and event_type <> 'signup'")
    e = e.withColumns({"conversion_id": F.coalesce("today.event_id", "later.event_id"), "conversion_ts": F.coalesce("today.ts", "later.ts")})
    return e.select(
        F.sha2(F.col("event_id").cast("string"), 256).alias("impression_id"), F.col("ts").alias("event_ts"), F.col("k").cast("string").alias("user_id"), F.col("user_id").alias("campaign_id"),
        (F.col("event_type") == "click").alias("is_click"), F.col("conversion_id").isNotNull().alias("is_conversion_path"), "conversion_ts", "conversion_id", (F.pmod("k", F.lit(3)) == 0).alias("is_attributed"),
        F.col("value").cast("decimal(18,8)").alias("cost"), F.when(F.col("k") % 10 != 0, (F.col("k") % 6).cast("string")).alias("cat1"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda *v: F.get(F.array(*map(F.lit, v)), (F.col("k") % len(v)).cast("int"))
    return events(spark, sf_dir).where("event_type = 'signup'").select(
        F.col("user_id").alias("campaign_id"), (F.col("user_id") % 97 + 1000).alias("advertiser_id"), pick("retail", "travel", "finance").alias("campaign_vertical"), pick("low", "medium", "high", "enterprise").alias("budget_tier"),
        pick("manual_cpc", "target_cpa").alias("bid_strategy"), F.col("value").cast("decimal(12,2)").alias("daily_budget_usd"), F.col("ts").alias("changed_at"), F.lit("change").alias("change_reason"),
    )


ATTRIBUTES = ["advertiser_id", "campaign_vertical", "budget_tier", "bid_strategy", "daily_budget_usd", "change_reason"]
UNKNOWN = {"campaign_id": -1, "campaign_vertical": "unknown", "budget_tier": "unknown", "bid_strategy": "unknown"}


class Star:
    """The star schema over one data folder; each part is a lazy frame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.staged = facts.stage_impressions(impressions(spark, sf_dir))
        self.campaigns = dims.scd2(changes(spark, sf_dir), key="campaign_id", at="changed_at", attributes=ATTRIBUTES, sk="campaign_sk", unknown=UNKNOWN)
        self.segments = dims.dim_segment(self.staged)
        self.dates = dims.dim_date(spark, ANCHOR, END)
        self.impressions = facts.fct_impressions(self.staged, self.campaigns, self.segments)
        self.clicks = facts.fct_clicks(self.impressions)
        self.conversions = facts.fct_conversions(self.impressions)
        self.mart = facts.mart_campaign_daily(self.impressions, self.conversions, self.dates, self.campaigns)


def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw text rows with faults, and event_id."""
    e = events(spark, sf_dir)

    def fault(name: str, good: Column, bad: str) -> Column:
        return F.when(F.col("event_id") % FAULTS[name] == 0, bad).otherwise(good).alias(name)

    text = lambda c: c.cast("string")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")) - ANCHOR_EPOCH
    buys = F.col("event_type") == "purchase"
    values = {
        "timestamp": fault("timestamp", text(seconds), "3.5"), "uid": fault("uid", text(F.col("k")), "abc"), "campaign": fault("campaign", F.concat(F.lit(" "), text(F.col("user_id"))), ""), "conversion": text(buys.cast("int")),
        "conversion_timestamp": F.when(buys, text(seconds + 60)).otherwise("-1"), "conversion_id": F.when(buys, text(F.col("event_id"))).otherwise("-1"), "attribution": F.when(F.col("k") % 3 == 0, "1").otherwise("0"),
        "click": fault("click", text((F.col("event_type") == "click").cast("int")), "x"), "click_pos": F.lit("-1"), "click_nb": text(F.col("k") % 4 - 1), "cost": fault("cost", text(F.col("value").cast("decimal(18,8)")), "-0.5"), "cpo": F.lit("-1"),
        "time_since_last_click": F.when(F.col("k") % 2 == 0, text(F.col("k"))).otherwise("-1"),
    } | {f"cat{i}": F.concat(text(F.col("k") % (5 + i)), F.lit(" ")) for i in range(1, 10)}
    return e.select("event_id", *[values[c].alias(c) for c in RAW_COLUMNS])
