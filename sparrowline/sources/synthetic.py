"""Generated raw impressions, made by Spark from row numbers.

Rows come in visits: a user sees `STEPS` impressions of one campaign, `PACE`
seconds apart. A visit may end in a conversion, whose path are all its
impressions. Every value is a function of the row or visit number and the
seed, so a row is the same on every run and partitioning. Faults and repeats
are put in at given rates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .raw import RAW_COLUMNS

DAYS, STEPS, PACE = 30, 4, 90
#: A few campaigns take a share of all visits between them, each half of the one before.
HOT_CAMPAIGNS, HOT_SHARE = 6, 0.4
CATEGORY_SIZES = [5, 16, 40, 75, 130, 220, 400, 800, 1500]
# The accepted tiers; the other names are made up.
TIERS = ["low", "medium", "high", "enterprise"]
VERTICALS = ["books", "garden", "music", "sport", "tools", "toys"]
STRATEGIES = ["even_pacing", "fixed_price", "second_price"]
FAULTY = {"timestamp": "12.75", "campaign": "", "cost": "-1.5", "click": "maybe", "uid": "u?"}


def _draw(seed: int, what: str, *by: Column) -> Column:
    """A number in [0, 1), the same for the same seed, name and columns."""
    return F.pmod(F.xxhash64(F.lit(f"{seed}/{what}"), *by), F.lit(1 << 32)) / float(1 << 32)


def _whole(x: Column) -> Column:
    return F.floor(x).cast("long")


def raw_impressions(spark: SparkSession, rows: int, *, n_campaigns: int = 400, n_users: int = 20_000, seed: int = 7, conversions: float = 0.05, duplicates: int = 200, malformed: int = 50_000) -> DataFrame:
    """RAW_COLUMNS as text; one row in `duplicates` occurs twice, and one in
    `malformed` has a fault, each column of FAULTY in turn."""
    r, visit, step = F.col("id"), _whole(F.col("id") / STEPS), F.pmod("id", F.lit(STEPS))
    draw = lambda what, *by: _draw(seed, what, *(by or (visit,)))
    # hot campaigns by the leading zero bits of a draw, the rest evenly
    hot = F.least(_whole(-F.log2(1 - draw("which"))), F.lit(HOT_CAMPAIGNS - 1))
    campaign = F.when(draw("hot") < HOT_SHARE, hot).otherwise(HOT_CAMPAIGNS + _whole(draw("which") * (n_campaigns - HOT_CAMPAIGNS))) + 5_000
    # busier towards noon: the mean of two draws
    begins = F.pmod(visit, F.lit(DAYS)) * 86_400 + _whole((draw("hour1") + draw("hour2")) / 2 * (86_400 - STEPS * PACE))
    at = begins + step * PACE
    clicked = lambda s: draw("click", visit, s) < F.lit(0.5) / (s + 1)
    converts = draw("converts") < conversions
    clicks = sum((clicked(F.lit(s)).cast("int") for s in range(1, STEPS)), clicked(F.lit(0)).cast("int"))
    last_click = F.greatest(*[F.when(clicked(F.lit(s)), s).otherwise(-1) for s in range(STEPS)])
    since = F.greatest(*[F.when(clicked(F.lit(s)) & (step > s), s).otherwise(-1) for s in range(STEPS)])
    credited = converts & (step == last_click)
    text = lambda c: c.cast("string")
    some = lambda when, c: F.when(when, text(c)).otherwise("-1")
    cost = F.pow(F.lit(2.0), draw("cost", r) * 4) * 0.0004
    values = {
        "timestamp": text(at), "uid": text(100 + _whole(F.pow(draw("user"), F.lit(2)) * n_users)), "campaign": text(campaign), "conversion": text(converts.cast("int")),
        "conversion_timestamp": some(converts, begins + STEPS * PACE + _whole(F.pow(draw("delay"), F.lit(3)) * 4 * 86_400)), "conversion_id": some(converts, visit), "attribution": text(credited.cast("int")), "click": text(clicked(step).cast("int")),
        "click_pos": some(converts & clicked(step), step), "click_nb": some(converts, clicks), "cost": F.format_string("%.8f", cost), "cpo": F.when(credited, F.format_string("%.6f", cost * 40)).otherwise("-1"),
        "time_since_last_click": some(since >= 0, (step - since) * PACE),
    } | {f"cat{i}": text(_whole(draw(f"cat{i}", r) * n)) for i, n in enumerate(CATEGORY_SIZES, 1)}
    fault = F.when(F.pmod(r, F.lit(malformed)) == malformed // 2, F.pmod(_whole(r / malformed), F.lit(len(FAULTY))))
    for k, (c, bad) in enumerate(FAULTY.items()):
        values[c] = F.when(fault == k, bad).otherwise(values[c])
    base = spark.range(rows).select("id", *[values[c].alias(c) for c in RAW_COLUMNS])
    copies = F.when(F.pmod("id", F.lit(duplicates)) == 1, 2).otherwise(1)
    return base.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).select(*RAW_COLUMNS)


def land(raw: DataFrame, root: str, *, anchor_epoch: int, rows_per_part: int = 400_000) -> None:
    """Write raw rows as gzipped TSV by day, in order of time, parts of at
    most `rows_per_part` rows; rows without a numeric time go to the folder of
    rejects. Ranges of time are dealt to tasks, so a large day has many. The
    markers come last."""
    ts = F.col("timestamp").try_cast("double")
    good = raw.where(ts.isNotNull()).withColumn("dt", F.to_date(F.timestamp_seconds(F.floor(ts) + anchor_epoch)))
    tasks = max(int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-good.count() // rows_per_part))
    tsv = {"sep": "\t", "header": True, "emptyValue": "", "compression": "gzip"}
    ordered = good.repartitionByRange(tasks, "dt", ts).sortWithinPartitions("dt", ts)
    ordered.write.mode("overwrite").partitionBy("dt").options(**tsv, maxRecordsPerFile=rows_per_part, extension="tsv").csv(f"{root}/impressions")
    raw.where(ts.isNull()).write.mode("overwrite").options(**tsv).csv(f"{root}/impressions_rejected")
    mark_days(raw.sparkSession, f"{root}/impressions")


def mark_days(spark: SparkSession, path: str) -> None:
    """A _SUCCESS marker in each day's folder, after all data are there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for s in fs.listStatus(p):
        if s.isDirectory() and s.getPath().getName().startswith("dt="):
            fs.create(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"), True).close()


def campaign_changes(spark: SparkSession, campaigns: DataFrame, *, anchor: str, seed: int = 7) -> DataFrame:
    """The change log of these campaigns: each is created at the anchor and
    then, in some of the weeks that follow, one of its attributes moves on to
    the next of its values."""
    key = F.col("campaign_id")
    draw = lambda what, *by: _draw(seed, what, key, *by)
    kinds = F.array(F.lit("tier"), F.lit("strategy"), F.lit("budget"))
    weeks = F.transform(F.sequence(F.lit(1), F.lit(DAYS // 7)), lambda w: F.struct(w.alias("week"), F.get(kinds, F.pmod(F.xxhash64(F.lit(seed), key, w), F.lit(6)).cast("int")).alias("kind")))
    moves = F.filter(weeks, lambda m: m["kind"].isNotNull())
    first = F.array(F.struct(F.lit(0).alias("week"), F.lit("created").alias("kind")))
    rows = campaigns.select(key, moves.alias("moves")).withColumn("m", F.explode(F.concat(first, F.col("moves"))))
    moved = lambda kind: F.size(F.filter("moves", lambda m: (m["kind"] == kind) & (m["week"] <= F.col("m.week"))))
    value = lambda what, values, kind: F.get(F.array(*map(F.lit, values)), F.pmod(_whole(draw(what) * len(values)) + moved(kind), F.lit(len(values))).cast("int"))
    seconds = F.unix_seconds(F.lit(anchor).cast("timestamp")) + F.col("m.week") * 7 * 86_400 + F.when(F.col("m.week") > 0, _whole(draw("time", F.col("m.week")) * 86_400)).otherwise(0)
    budget = F.round((20 + draw("budget") * 500) * F.pow(F.lit(1.25), moved("budget")), 2)
    return rows.select(
        key, _whole(draw("advertiser") * 60).alias("advertiser_id"), F.get(F.array(*map(F.lit, VERTICALS)), _whole(draw("vertical") * len(VERTICALS)).cast("int")).alias("campaign_vertical"), value("tier", TIERS, "tier").alias("budget_tier"),
        value("strategy", STRATEGIES, "strategy").alias("bid_strategy"), budget.cast("decimal(12,2)").alias("daily_budget_usd"), F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("changed_at"),
        F.when(F.col("m.kind") == "created", "created").otherwise(F.concat("m.kind", F.lit("_moved"))).alias("change_reason"),
    )
