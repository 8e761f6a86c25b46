"""A contract as ordered rules over parsed records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import first_failure
from ..operators.joins import bounded
from .contract import Contract

CORRUPT = "_corrupt_record"


def parse(records: DataFrame, contract: Contract) -> DataFrame:
    """Kafka-shaped records with their value as text and its fields."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    j = records.withColumn("_raw", F.col("value").cast("string")).withColumn("_j", F.from_json("_raw", contract.spark_schema(CORRUPT), options))
    return j.select("*", "_j.*").drop("_j")


def rules(contract: Contract, known: bool = False) -> list[tuple[str, Column]]:
    """(reason, predicate) in the order they are tried. A comparison with null
    fails no row. A version that is no number fails its pattern, not the job."""
    bad = F.col(CORRUPT).isNotNull()
    nothing = F.coalesce(*[F.col(f.name).cast("string") for f in contract.fields]).isNull()
    major = F.split_part("schema_version", F.lit("."), F.lit(1)).try_cast("int")
    out = [("invalid_json", bad & nothing), ("type_mismatch", bad), ("unsupported_schema_version", major != contract.major)]
    out += [(f"missing_required:{f.name}", F.col(f.name).isNull()) for f in contract.fields if f.required]
    for f in contract.fields:
        if f.minimum is not None:
            out.append((f"constraint:{f.name}:minimum", F.col(f.name) < f.minimum))
        if f.pattern is not None:
            out.append((f"constraint:{f.name}:pattern", ~F.col(f.name).rlike(f.pattern)))
    if known:
        out.append(("quality:campaign_known", F.col("_known").isNull()))
    late = F.col("produced_at") + F.make_dt_interval(secs=F.lit(contract.max_skew_seconds))
    return [*out, ("quality:not_from_future", F.col("event_ts") > late)]


def enforcer(contract: Contract, campaigns: DataFrame | None = None) -> Callable[[DataFrame], DataFrame]:
    """`enforce` for many frames: rules and reference list are prepared once."""
    reason = first_failure(rules(contract, campaigns is not None))
    ref = None if campaigns is None else bounded(campaigns.select(F.col("campaign_id").alias("_c"), F.lit(True).alias("_known")))

    def judge(records: DataFrame) -> DataFrame:
        df = parse(records, contract)
        if ref is not None:
            df = df.join(ref, F.col("campaign_id") == F.col("_c"), "left")
        return df.withColumn("reject_reason", reason).drop("_c", "_known", CORRUPT)

    return judge


def enforce(records: DataFrame, contract: Contract, campaigns: DataFrame | None = None) -> DataFrame:
    """Parsed records with `reject_reason`, null where all rules hold.
    `campaigns`: one row for each known campaign_id, a reference list; it is
    broadcast if its size is within the bound."""
    return enforcer(contract, campaigns)(records)
