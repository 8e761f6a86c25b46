"""Registered queries of the streaming path, over events written as
Kafka-shaped record files in the shared scratch folder.

Each query runs its stream to the end and returns the resulting table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import ROCKSDB, scratch
from ..sources.raw import KAFKA_SCHEMA, record_files_stream, record_partition
from ..streaming import pipeline
from ..streaming.contract import IMPRESSION_EVENT, Contract, FieldSpec, evolution
from ..streaming.rules import enforce
from ..streaming.store import KeyedStore
from . import domain as D

# Every n-th event carries a fault; the first that divides its id counts.
FAULTS = [(97, "invalid_json"), (89, "missing_required:user_id"), (83, "type_mismatch"), (79, "constraint:cost:minimum"), (73, "quality:campaign_known"), (71, "quality:not_from_future"), (67, "unsupported_schema_version"), (61, "constraint:impression_id:pattern")]
FILES = 4


def _kind(event_id: Column) -> Column:
    return S.first_failure([(reason, event_id % n == 0) for n, reason in FAULTS])


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON records with Kafka's columns, event_id and `expected`,
    the reason that each must be rejected for."""
    e = D.events(spark, sf_dir).withColumn("expected", _kind(F.col("event_id")))
    faulty = lambda reason: F.coalesce(F.col("expected") == reason, F.lit(False))
    at = F.col("ts").cast("timestamp")
    made = at + F.expr("INTERVAL 2 SECONDS")
    text = F.to_json(F.struct(
        F.when(faulty("unsupported_schema_version"), "2.0.0").otherwise("1.0.0").alias("schema_version"), F.when(faulty("constraint:impression_id:pattern"), "none").otherwise(F.sha2(F.col("event_id").cast("string"), 256)).alias("impression_id"),
        S.iso_text(F.when(faulty("quality:not_from_future"), made + F.expr("INTERVAL 1 HOUR")).otherwise(at)).alias("event_ts"), S.iso_text(made).alias("produced_at"), F.when(~faulty("missing_required:user_id"), F.col("k").cast("string")).alias("user_id"),
        F.when(faulty("quality:campaign_known"), 1_000_001).otherwise(F.col("user_id")).alias("campaign_id"), (F.col("event_type") == "click").alias("is_click"), (F.col("event_type") == "purchase").alias("is_conversion_path"),
        F.when(faulty("constraint:cost:minimum"), -0.5).otherwise(F.col("value")).cast("decimal(18,8)").alias("cost"), F.lit("c1").alias("cat1"),
    ))
    text = F.when(faulty("invalid_json"), F.substring(text, 1, 40)).when(faulty("type_mismatch"), F.regexp_replace(text, r'"campaign_id":\d+', '"campaign_id":"none"')).otherwise(text)
    key = F.col("user_id").cast("string")
    return e.select("event_id", "expected", key.cast("binary").alias("key"), text.cast("binary").alias("value"), F.lit(IMPRESSION_EVENT.topic).alias("topic"), record_partition(key).alias("partition"), F.col("event_id").alias("offset"), made.alias("timestamp"), F.lit(0).alias("timestampType"))


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "events").select(F.col("user_id").alias("campaign_id")).distinct()


def feed(parts: list[DataFrame], folder: str) -> None:
    """One file for each part. The file source orders by modification time,
    and each is written after the one before is done."""
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(folder)


def _parts(spark: SparkSession, rows: DataFrame) -> list[DataFrame]:
    """Rows (event_id, ...) in FILES ranges of ids, and each range's every
    50th row again in the next one."""
    top = rows.agg(F.max("event_id")).first()[0] or 0
    size = top // FILES + 1
    again = rows.where(F.col("event_id") % 50 == 0)
    return [rows.where(F.floor(F.col("event_id") / size) == i).unionByName(again.where(F.floor(F.col("event_id") / size) == i - 1)) for i in range(FILES)]


def _raw_run(spark: SparkSession, sf_dir: str, deliveries: int = 1, restarts: bool = False) -> KeyedStore:
    """The raw query over all files, in several deliveries under checkpoints
    of their own, or with `restarts` under one, half of the files at a time
    and then once more."""
    folder, store = scratch(spark, "records"), KeyedStore(spark, scratch(spark, "tables"))
    parts = [p.select(*KAFKA_SCHEMA.fieldNames()) for p in _parts(spark, records(spark, sf_dir).drop("expected"))]
    known = campaigns(spark, sf_dir)
    one = scratch(spark, "checkpoint")
    fed = [parts[: FILES // 2], parts[FILES // 2 :], []] if restarts else [parts, *[[]] * (deliveries - 1)]
    for now in fed:
        feed(now, folder)
        q = pipeline.start("raw", record_files_stream(spark, folder), pipeline.raw_writer(store, IMPRESSION_EVENT, known), one if restarts else scratch(spark, "checkpoint"))
        pipeline.watch(spark, [q])
    return store


CASE = "CASE " + " ".join(f"WHEN event_id % {n} = 0 THEN '{r}'" for n, r in FAULTS) + " END"
RAW_SQL = f"""WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, {CASE} AS reason FROM events)
SELECT sha256(CAST(event_id AS VARCHAR)) AS impression_id, ts AS event_ts, CAST(k AS VARCHAR) AS user_id, user_id AS campaign_id, event_type = 'click' AS is_click, CAST(value AS DOUBLE) AS cost, CAST(ts AS DATE) AS dt, '1.0.0' AS schema_version, event_id AS _kafka_offset FROM e WHERE reason IS NULL"""


def contract_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = enforce(records(spark, sf_dir), IMPRESSION_EVENT, campaigns(spark, sf_dir))
    return judged.select("event_id", "reject_reason")



def _cases() -> dict[str, Contract]:
    from dataclasses import replace

    base = IMPRESSION_EVENT
    edit = lambda name, **k: tuple(replace(f, **k) if f.name == name else f for f in base.fields)
    plus = lambda **k: (*base.fields, FieldSpec("extra", "string", **k))
    less = tuple(f for f in base.fields if f.name != "cat9")
    return {
        "unchanged": base, "optional_added": replace(base, version="1.1.0", fields=plus()), "no_bump": replace(base, fields=plus()), "removed": replace(base, version="1.1.0", fields=less), "required_added": replace(base, version="1.1.0", fields=plus(required=True)),
        "retyped": replace(base, version="1.1.0", fields=edit("campaign_id", kind="string")), "widened": replace(base, version="1.1.0", fields=edit("click_pos", kind="long")), "now_required": replace(base, version="1.1.0", fields=edit("cat1", required=True)), "now_optional": replace(base, version="1.1.0", fields=edit("cost", required=False)),
        "tightened": replace(base, version="1.1.0", fields=edit("campaign_id", minimum=5)), "key_changed": replace(base, version="1.1.0", key="user_id"), "major_same_topic": replace(base, version="2.0.0", fields=less), "major_new_topic": replace(base, version="2.0.0", topic="ad.impressions.v2", fields=less),
    }


EVOLUTION_SQL = """SELECT * FROM (VALUES ('unchanged', true, ''), ('optional_added', true, ''), ('no_bump', false, 'needs_higher_version'), ('removed', false, 'removed:cat9|needs_major_version'), ('required_added', false, 'required_added:extra|needs_major_version'),
('retyped', false, 'retyped:campaign_id|needs_major_version'), ('widened', true, ''), ('now_required', false, 'required_now:cat1|needs_major_version'), ('now_optional', false, 'optional_now:cost|needs_major_version'), ('tightened', false, 'minimum_raised:campaign_id|needs_major_version'),
('key_changed', false, 'key_changed|needs_major_version'), ('major_same_topic', false, 'removed:cat9|needs_new_topic'), ('major_new_topic', true, 'removed:cat9')) t(name, ok, why)"""


def contract_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(name, *(lambda r: (r[0], "|".join(r[1])))(evolution(IMPRESSION_EVENT, c))) for name, c in _cases().items()]
    return spark.createDataFrame(rows, "name string, ok boolean, why string")


def _raw_result(df: DataFrame) -> DataFrame:
    return df.select("impression_id", F.col("event_ts").cast("timestamp_ntz").alias("event_ts"), "user_id", "campaign_id", "is_click", F.col("cost").cast("double").alias("cost"), "dt", "schema_version", "_kafka_offset")


def stream_raw_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw_result(_raw_run(spark, sf_dir).read("impressions_stream"))


def stream_replay_noop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything delivered twice, under a new checkpoint."""
    return _raw_result(_raw_run(spark, sf_dir, deliveries=2).read("impressions_stream"))


def stream_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stopped after half of the files, resumed from its checkpoint, and
    resumed again without new files. Batches that the store has seen are
    counted too: a restart takes up where the last run ended."""
    store = _raw_run(spark, sf_dir, restarts=True)
    batches = store.read("stream_batch_metrics").count()
    return _raw_result(store.read("impressions_stream")).withColumn("batches", F.lit(batches).cast("bigint"))


def stream_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw_run(spark, sf_dir).read("impressions_dlq").select("kafka_offset", "kafka_key", "reject_reason")


def stream_batch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _raw_run(spark, sf_dir).read("stream_batch_metrics")
    return m.select("batch_id", "rows_in", "rows_valid", "rows_dlq", "rows_duplicate_in_batch", F.col("min_event_ts").cast("timestamp_ntz").alias("min_event_ts"), F.round("dlq_rate", 6).alias("dlq_rate"))


def _simple_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.timestamp_millis(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000))
    return D.events(spark, sf_dir).select("event_id", F.col("event_id").cast("string").alias("impression_id"), at.alias("event_ts"), F.col("user_id").alias("campaign_id"), F.col("k").cast("string").alias("user_id"), (F.col("event_type") == "click").alias("is_click"), (F.col("event_type") == "purchase").alias("is_conversion_path"), F.col("value").cast("decimal(18,8)").alias("cost"))


def _minutes(spark: SparkSession, parts: list[DataFrame], delay: str, width: str, users: bool = False) -> DataFrame:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    folder, store = scratch(spark, "events"), KeyedStore(spark, scratch(spark, "tables"))
    feed(parts, folder)
    source = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = pipeline.start("minutes", pipeline.windowed(source, delay=delay, width=width, approximate_users=users), pipeline.minutes_writer(store), scratch(spark, "checkpoint"))
    q.awaitTermination()
    out = store.read("campaign_minute_metrics")
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.select("campaign_id", ntz("window_start"), ntz("window_end"), "impressions", "clicks", "conversion_path_impressions", F.col("spend").cast("double").alias("spend"))


DELAY, WIDTH = "10 minutes", "1 hour"


def _late_parts(rows: DataFrame) -> list[DataFrame]:
    """FILES ranges of ids; every 40th row is held back to the last file, and
    every 50th is sent again with the next."""
    held = F.col("event_id") % 40 == 0
    parts = _parts(rows.sparkSession, rows.where(~held))
    parts[-1] = parts[-1].unionByName(rows.where(held))
    return parts


def stream_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minutes(spark, _parts(spark, _simple_events(spark, sf_dir)), DELAY, WIDTH)


def stream_minutes_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minutes(spark, _late_parts(_simple_events(spark, sf_dir)), DELAY, WIDTH)


def _minutes_sql(late: bool) -> str:
    """The watermark's rules written out: batch b's watermark is the greatest
    time of earlier batches less the delay; a row counts unless it lies before
    the watermark of the batch before its own; a window is final once its end
    is not after the last watermark."""
    held = "event_id % 40 = 0" if late else "false"
    return f"""WITH e AS (SELECT event_id, user_id AS campaign_id, date_trunc('millisecond', ts) AS et, event_type, value, CAST(floor(event_id / ((SELECT max(event_id) FROM events WHERE NOT ({held})) // {FILES} + 1)) AS INTEGER) AS f0 FROM events),
fed AS (SELECT *, CASE WHEN {held} THEN {FILES - 1} ELSE f0 END AS b FROM e UNION ALL SELECT *, f0 + 1 AS b FROM e WHERE NOT ({held}) AND event_id % 50 = 0 AND f0 < {FILES - 1}),
mx AS (SELECT b, max(et) AS m FROM fed GROUP BY b), wm AS (SELECT b, coalesce((SELECT max(m) FROM mx y WHERE y.b < x.b) - INTERVAL 10 MINUTE, TIMESTAMP '1970-01-01') AS w FROM (SELECT unnest(range(0, {FILES + 1})) AS b) x),
kept AS (SELECT fed.*, row_number() OVER (PARTITION BY event_id ORDER BY fed.b) AS k FROM fed JOIN wm ON wm.b = greatest(fed.b - 1, 0) WHERE et >= wm.w),
g AS (SELECT campaign_id, time_bucket(INTERVAL 1 HOUR, et) AS window_start, count(*) AS impressions, CAST(count_if(event_type = 'click') AS BIGINT) AS clicks, CAST(count_if(event_type = 'purchase') AS BIGINT) AS conversion_path_impressions, CAST(sum(CAST(value AS DECIMAL(18,8))) AS DOUBLE) AS spend FROM kept WHERE k = 1 GROUP BY 1, 2)
SELECT campaign_id, window_start, window_start + INTERVAL 1 HOUR AS window_end, impressions, clicks, conversion_path_impressions, spend FROM g WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(w) FROM wm)"""


def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both queries with the listener; a row for each micro-batch."""
    folder, store = scratch(spark, "records"), KeyedStore(spark, scratch(spark, "tables"))
    feed([p.select(*KAFKA_SCHEMA.fieldNames()) for p in _parts(spark, records(spark, sf_dir).drop("expected"))], folder)
    pipeline.run(spark, lambda: record_files_stream(spark, folder), store, IMPRESSION_EVENT, scratch(spark, "checkpoint"), campaigns=campaigns(spark, sf_dir))
    return store.read("stream_query_progress").where("num_input_rows > 0").select("query_name", "batch_id", "num_input_rows")


_BATCHES = f"""WITH e AS (SELECT event_id, ts, {CASE} AS reason, CAST(floor(event_id / ((SELECT max(event_id) FROM events) // {FILES} + 1)) AS BIGINT) AS f0 FROM events),
fed AS (SELECT *, f0 AS b FROM e UNION ALL SELECT *, f0 + 1 FROM e WHERE event_id % 50 = 0 AND f0 < {FILES - 1})"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (contract_reasons, contract_evolution, stream_raw_upsert, stream_replay_noop, stream_restart, stream_dead_letters, stream_batch_metrics, stream_minutes, stream_minutes_late, stream_progress)}
ORACLES: dict[str, str] = {
    "contract_reasons": f"SELECT event_id, {CASE} AS reject_reason FROM events",
    "contract_evolution": EVOLUTION_SQL,
    "stream_raw_upsert": RAW_SQL,
    "stream_replay_noop": RAW_SQL,
    "stream_restart": f"SELECT *, CAST({FILES} AS BIGINT) AS batches FROM ({RAW_SQL})",
    "stream_progress": _BATCHES + " SELECT q AS query_name, b AS batch_id, count(*) AS num_input_rows FROM fed, (VALUES ('raw'), ('minutes')) n(q) GROUP BY 1, 2",
    "stream_dead_letters": f"SELECT event_id AS kafka_offset, CAST(user_id AS VARCHAR) AS kafka_key, {CASE} AS reject_reason FROM events WHERE {CASE} IS NOT NULL",
    "stream_batch_metrics": _BATCHES + " SELECT b AS batch_id, count(*) AS rows_in, CAST(count_if(reason IS NULL) AS BIGINT) AS rows_valid, CAST(count_if(reason IS NOT NULL) AS BIGINT) AS rows_dlq, CAST(count_if(reason IS NULL) - count(DISTINCT CASE WHEN reason IS NULL THEN event_id END) AS BIGINT) AS rows_duplicate_in_batch, min(CASE WHEN reason IS NULL THEN ts END) AS min_event_ts, round(count_if(reason IS NOT NULL)::DOUBLE / count(*), 6) AS dlq_rate FROM fed GROUP BY 1",
    "stream_minutes": _minutes_sql(False),
    "stream_minutes_late": _minutes_sql(True),
}
