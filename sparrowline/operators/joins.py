"""Join strategies for skewed keys, and joins on validity intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_join(facts: DataFrame, dim: DataFrame, keys: list[str]) -> DataFrame:
    return facts.join(dim.hint("merge"), keys, "left")


#: Most bytes of a side that is broadcast.
BROADCAST_BYTES = 64 << 20


def bounded(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`df` marked for broadcast if the optimiser's estimate of its size is
    within the bound (it estimates filters and aggregates from above), else as
    it is: Spark then joins by what it measures at run time. No job runs."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most_bytes else df


def broadcast_join(facts: DataFrame, dim: DataFrame, keys: list[str], most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast of a side within the bound; beyond it the merge join, whose
    skewed partitions Spark splits."""
    side = bounded(dim, most_bytes)
    return facts.join(side, keys, "left") if side is not dim else merge_join(facts, dim, keys)


def hot_keys(facts: DataFrame, keys: list[str], multiple: float = 5.0) -> DataFrame:
    """Keys with more than `multiple` times the mean number of rows. There are
    fewer than (number of keys) / multiple of them."""
    counts = facts.groupBy(*keys).agg(F.count("*").alias("_n"))
    mean = counts.agg(F.avg("_n")).first()[0] or 0.0
    return counts.where(F.col("_n") > F.lit(multiple * mean)).select(*keys)


def salted_join(facts: DataFrame, dim: DataFrame, keys: list[str], *, row_key: str, hot: DataFrame, salts: int = 16) -> DataFrame:
    """Rows of hot keys are spread over `salts` copies of their dim row; other
    keys are left alone."""
    mark = hot.select(*keys).distinct().withColumn("_hot", F.lit(True))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(row_key), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    left = facts.join(mark, keys, "left").withColumn("_salt", salt).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = dim.join(mark, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")


def aqe_join(facts: DataFrame, dim: DataFrame, keys: list[str]) -> DataFrame:
    """A merge join whose skewed partitions are split at run time: the merge
    join under the session's adaptive execution, which must be on."""
    if facts.sparkSession.conf.get("spark.sql.adaptive.enabled") != "true":
        raise ValueError("spark.sql.adaptive.enabled is off")
    return merge_join(facts, dim, keys)


def skew_stats(facts: DataFrame, key: str, multiple: float = 5.0, top: int = 10) -> DataFrame:
    """One row: keys, rows, mean, share of the largest key and of the `top`
    largest, number of hot keys. Counts by key are the only shuffle."""
    counts = facts.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.count("*").alias("keys"), F.sum("n").alias("rows"), F.avg("n").alias("mean_rows"), F.max("n").alias("top1"))
    largest = counts.orderBy(F.desc("n"), key).limit(top).agg(F.sum("n").alias("top_n"))
    hot = counts.crossJoin(F.broadcast(total.select("mean_rows"))).where(F.col("n") > multiple * F.col("mean_rows")).agg(F.count("*").alias("hot_keys"))
    # each side has one row
    both = total.crossJoin(largest).crossJoin(hot)
    share = lambda c: F.round(F.col(c) / F.col("rows"), 9)
    return both.select("keys", "rows", F.round("mean_rows", 6).alias("mean_rows"), share("top1").alias("top1_share"), share("top_n").alias("top10_share"), "hot_keys")


def interval_join(facts: DataFrame, versions: DataFrame, key: str, at: str, columns: list[str], *, valid_from: str = "valid_from", valid_to: str = "valid_to", closed_end: bool = False) -> DataFrame:
    """Each fact with the version of its key valid at its time (half-open), or
    nulls. With `closed_end`, the version valid at the end of an interval:
    from < at <= to. An equi-join with the range as residual condition."""
    v = versions.select(F.col(key).alias("_k"), F.col(valid_from).alias("_from"), F.col(valid_to).alias("_to"), *columns)
    t = F.col(at)
    inside = (F.col("_from") < t) & (F.col("_to") >= t) if closed_end else (t >= F.col("_from")) & (t < F.col("_to"))
    return facts.join(v, (F.col(key) == F.col("_k")) & inside, "left").drop("_k", "_from", "_to")


def calendar_asof(changes: DataFrame, days: DataFrame, *, key: str, at: str, day: str = "dt") -> DataFrame:
    """For each day and key the last change up to that day. Changes become
    intervals of days by `lead`, and each interval lists its days, so no key
    meets a day it had no state on."""
    c = changes.withColumn("_day", F.to_date(at))
    # ties in time go to the row with the greatest hash, the same on every run
    order = F.desc(at), F.desc(F.xxhash64(*[F.col(f"`{x}`") for x in changes.columns]))
    last = c.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_day").orderBy(*order))).where("_r = 1").drop("_r")
    end = F.lead("_day").over(Window.partitionBy(key).orderBy("_day"))
    first, stop = days.agg(F.min(day), F.max(day)).first()
    until = F.least(F.coalesce(F.date_sub(end, 1), F.lit(stop)), F.lit(stop))
    spans = last.withColumn("_until", until).withColumn("_since", F.greatest("_day", F.lit(first))).where("_since <= _until")
    rows = spans.withColumn(day, F.explode(F.sequence("_since", "_until"))).drop("_day", "_until", "_since")
    return rows.join(F.broadcast(days.select(day).distinct()), day, "left_semi")


def unknown_member(value: Column, unknown: str = "-1") -> Column:
    return F.coalesce(value, F.lit(unknown))
