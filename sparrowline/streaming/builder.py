"""Event streams with known outcomes, built from typed rows.

`to_events` writes clean impressions as contract events, with the batch path's
ids; `build_stream` puts in faults, repeats and late records at given rates and
says what must become of each record. Which rows are hit follows from a digest
of the seed and the row's id, so a stream is the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.cleaning import classify, split, typed
from .contract import Contract

# The kinds of faults, in turn, by the reason each must get.
FAULT_REASONS = ["invalid_json", "missing_required:user_id", "type_mismatch", "constraint:cost:minimum", "quality:campaign_known", "quality:not_from_future", "unsupported_schema_version"]
#: A campaign that no reference list holds.
NO_CAMPAIGN = (1 << 53) - 1


def to_events(raw: DataFrame, contract: Contract, anchor_epoch: int, *, version: str | None = None, delay_seconds: float = 2.0) -> DataFrame:
    """The contract's fields of each usable raw row, and no row for others.
    `impression_id` is the digest of the raw columns, as in the batch path."""
    good, _ = split(classify(typed(raw, anchor_epoch)))
    made = good.withColumns({"schema_version": F.lit(version or contract.version), "produced_at": F.timestamp_micros(F.unix_micros("event_ts") + int(delay_seconds * 1_000_000))})
    return made.select(*[F.col(f.name) for f in contract.fields])


def draw(seed: int, what: str, key: Column, digits: int = 1) -> Column:
    """A number in [0, 2^32) from an MD5 digest: its `digits`-th eight."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.lit(what), key.cast("string"))), 8 * digits - 7, 8), 16, 10).cast("long")


def _hit(seed: int, what: str, key: Column, rate: float) -> Column:
    return draw(seed, what, key) < F.lit(int(rate * (1 << 32)))


def payload(events: DataFrame, contract: Contract, fault: Column) -> Column:
    """An event as JSON text, with its fault. Times are ISO 8601 in UTC."""
    is_ = lambda reason: F.coalesce(fault == reason, F.lit(False))
    late = F.timestamp_micros(F.unix_micros("produced_at") + 3_600_000_000)
    odd = {
        "event_ts": F.when(is_("quality:not_from_future"), late).otherwise(F.col("event_ts")), "user_id": F.when(~is_("missing_required:user_id"), F.col("user_id")), "cost": F.when(is_("constraint:cost:minimum"), F.lit(-0.5)).otherwise(F.col("cost")).cast("decimal(18,8)"),
        "campaign_id": F.when(is_("quality:campaign_known"), F.lit(NO_CAMPAIGN)).otherwise(F.col("campaign_id")), "schema_version": F.when(is_("unsupported_schema_version"), F.lit("2.0.0")).otherwise(F.col("schema_version")),
    }
    kinds = {f.name: f.kind for f in contract.fields}
    fields = [(S.iso_text(odd.get(n, F.col(n))) if k == "timestamp" else odd.get(n, F.col(n))).alias(n) for n, k in kinds.items() if n in events.columns]
    text = F.to_json(F.struct(*fields))
    wrong = F.regexp_replace(text, r'"campaign_id":-?\d+', '"campaign_id":"none"')
    return F.when(is_("invalid_json"), F.substring(text, 1, 40)).when(is_("type_mismatch"), wrong).otherwise(text)


def build_stream(events: DataFrame, contract: Contract, *, id_col: str = "impression_id", fault_rate: float = 0.01, dup_rate: float = 0.01, late_rate: float = 0.005, seed: int = 11, hold_seconds: int = 40 * 86_400) -> DataFrame:
    """Records: key, value, topic, timestamp, and of each its id, `copy` (0,
    or 1 for a repeat), `expected` (a reject reason, `duplicate`, `late` or
    `valid`) and `arrives_at`. A late record is valid but held back for
    `hold_seconds`; (arrives_at, id, copy) is the order of arrival."""
    key = F.col(id_col)
    kinds = F.array(*map(F.lit, FAULT_REASONS))
    fault = F.when(_hit(seed, "fault", key, fault_rate), F.get(kinds, (draw(seed, "fault", key, 2) % len(FAULT_REASONS)).cast("int")))
    rows = events.withColumn("_fault", fault).withColumn("_late", F.col("_fault").isNull() & _hit(seed, "late", key, late_rate))
    rows = rows.withColumn("copy", F.explode(F.when(_hit(seed, "repeat", key, dup_rate), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    arrives = F.timestamp_micros(F.unix_micros("produced_at") + F.when(F.col("_late"), hold_seconds * 1_000_000).otherwise(0))
    expected = F.coalesce("_fault", F.when(F.col("copy") > 0, "duplicate"), F.when(F.col("_late"), "late"), F.lit("valid"))
    return rows.select(
        key, "copy", expected.alias("expected"), arrives.alias("arrives_at"), F.col(contract.key).cast("string").cast("binary").alias("key"),
        payload(rows, contract, F.col("_fault")).cast("binary").alias("value"), F.lit(contract.topic).alias("topic"), arrives.alias("timestamp"),
    )
