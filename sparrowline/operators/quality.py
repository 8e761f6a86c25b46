"""Data tests as violations: each returns a DataFrame with a row for each
failure, with `check` and `detail`; none means it holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _violations(df: DataFrame, check: str, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.coalesce(detail.cast("string"), F.lit("null")).alias("detail"))


def not_null(df: DataFrame, col: str) -> DataFrame:
    return _violations(df.where(F.col(col).isNull()), f"not_null:{col}", F.lit(None))


def unique(df: DataFrame, *cols: str) -> DataFrame:
    many = df.where(F.coalesce(*cols).isNotNull()).groupBy(*cols).agg(F.count("*").alias("_n")).where("_n > 1")
    return _violations(many, f"unique:{'+'.join(cols)}", F.concat_ws("|", *[F.col(c).cast("string") for c in cols]))


def relationship(child: DataFrame, col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    p = parent.select(F.col(parent_col).alias("_p"))
    return _violations(child.where(F.col(col).isNotNull()).join(p, F.col(col) == F.col("_p"), "left_anti"), f"relationship:{col}", F.col(col))


def accepted_values(df: DataFrame, col: str, values: list) -> DataFrame:
    return _violations(df.where(F.col(col).isNotNull() & ~F.col(col).isin(*values)), f"accepted_values:{col}", F.col(col))


def accepted_range(df: DataFrame, col: str, least=None, most=None) -> DataFrame:
    out = F.lit(False)
    if least is not None:
        out = out | (F.col(col) < least)
    if most is not None:
        out = out | (F.col(col) > most)
    return _violations(df.where(out), f"accepted_range:{col}", F.col(col))


def holds(df: DataFrame, name: str, condition: str | Column) -> DataFrame:
    """Rows where the condition is not true (null fails)."""
    c = F.expr(condition) if isinstance(condition, str) else condition
    return _violations(df.where(~F.coalesce(c, F.lit(False))), f"holds:{name}", F.lit(None))


def scd2_integrity(dim: DataFrame, key: str) -> DataFrame:
    """Gaps and overlaps between versions, and keys without exactly one
    current version."""
    nxt = F.lead("valid_from").over(Window.partitionBy(key).orderBy("valid_from"))
    torn = dim.withColumn("_next", nxt).where(F.col("_next").isNotNull() & (F.col("_next") != F.col("valid_to")))
    current = dim.groupBy(key).agg(F.count_if("is_current").alias("_n")).where("_n <> 1")
    return _violations(torn, "scd2:gap_or_overlap", F.col(key)).unionByName(_violations(current, "scd2:current", F.concat(F.col(key).cast("string"), F.lit(" has "), F.col("_n").cast("string"))))


def mart_reconciles(mart: DataFrame, facts: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Totals of the mart against the facts; each side is one row."""
    m = mart.agg(F.sum("impressions").alias("mi"), F.sum("clicks").alias("mc"), F.sum("spend").alias("ms"))
    f = facts.agg(F.count("*").alias("fi"), F.count_if("is_click").alias("fc"), F.sum("cost").alias("fs"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = m.crossJoin(f)
    bad = (zero("mi") != zero("fi")) | (zero("mc") != zero("fc")) | (F.abs(zero("ms") - zero("fs")) > tolerance)
    return _violations(both.where(bad), "mart_reconciles", F.concat_ws("|", "mi", "fi", "mc", "fc"))


def unknown_members(facts: DataFrame, col: str = "campaign_sk") -> DataFrame:
    return _violations(facts.where(F.col(col) == "-1"), f"unknown:{col}", F.col("impression_id"))


def reconcile_paths(batch: DataFrame, stream: DataFrame, today: Column, key: str = "impression_id", day: str = "dt") -> DataFrame:
    """Days that both paths have, but today, with ids that only one has."""
    days = batch.select(day).distinct().intersect(stream.select(day).distinct())
    b = batch.join(days, day, "left_semi").select(F.col(key).alias("b"), F.col(day).alias("bd"))
    s = stream.join(days, day, "left_semi").select(F.col(key).alias("s"), F.col(day).alias("sd"))
    both = b.join(s, F.col("b") == F.col("s"), "full").withColumn(day, F.coalesce("bd", "sd")).where(F.col(day) < today)
    out = both.groupBy(day).agg(F.count_if(F.col("s").isNull()).alias("missing_in_stream"), F.count_if(F.col("b").isNull()).alias("missing_in_batch"))
    return out.where("missing_in_stream + missing_in_batch > 0")


def freshness(df: DataFrame, loaded_at: str, now: Column, warn_seconds: int, error_seconds: int) -> DataFrame:
    """One row: max_loaded_at, age_seconds, status (pass, warn or error)."""
    last = df.agg(F.max(loaded_at).alias("max_loaded_at"))
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("max_loaded_at").cast("timestamp"))
    status = F.when(F.col("max_loaded_at").isNull() | (age > error_seconds), "error").when(age > warn_seconds, "warn").otherwise("pass")
    return last.select("max_loaded_at", age.alias("age_seconds"), status.alias("status"))


def slo(batch_metrics: DataFrame, max_p95_seconds: float = 120.0, max_dlq_rate: float = 0.01) -> DataFrame:
    """By hour: whether the latency and the share of dead letters hold."""
    h = batch_metrics.groupBy(F.date_trunc("hour", "_recorded_at").alias("hour")).agg(F.max("latency_p95_s").alias("p95_s"), F.try_divide(F.sum("rows_dlq"), F.sum("rows_in")).alias("dlq_rate"))
    return h.withColumn("ok", (F.coalesce("p95_s", F.lit(0.0)) <= max_p95_seconds) & (F.coalesce("dlq_rate", F.lit(0.0)) <= max_dlq_rate))


@dataclass
class Check:
    name: str
    violations: DataFrame
    severity: str = "error"


def run_checks(checks: list[Check], store: str | None = None) -> dict[str, tuple[str, int]]:
    """Each check's outcome (pass, warn or error) and count; failing rows are
    written below `store`."""
    out = {}
    for c in checks:
        n = c.violations.count()
        out[c.name] = ("pass" if not n else c.severity, n)
        if n and store:
            c.violations.write.mode("overwrite").parquet(f"{store}/{c.name}")
    return out
