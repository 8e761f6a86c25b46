"""Registered queries of jobs, stores, projects and their bookkeeping: each runs
the operation on the driver's tables and returns what it left behind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..operators import cleaning, masking, quality
from ..session import pin, scratch, warehouse_name
from ..sources import raw as R
from ..sources.synthetic import land
from ..streaming import builder, pipeline
from ..streaming.contract import IMPRESSION_EVENT
from ..streaming.rules import enforce
from ..streaming.store import KeyedStore, merge_sql
from . import daily
from . import domain as D
from . import sql as Q

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query(f"""WITH {Q.CLEAN}, d AS (SELECT CASE WHEN reject_reason = 'bad_timestamp' THEN DATE '2024-01-01' ELSE CAST(ts AS DATE) END AS dt, reject_reason FROM cln)
SELECT dt, CAST(count_if(reject_reason IS NULL) AS BIGINT) AS rows_out, CAST(count_if(reject_reason IS NOT NULL) AS BIGINT) AS quarantined, true AS ready, true AS has_bytes FROM d GROUP BY 1""")
def clean_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events landed as gzipped files by day, cleaned, and counted in the
    tables that the job wrote; with each day's marker and size."""
    root = scratch(pin(spark), "landed")
    land(D.raw_text(spark, sf_dir).select(*R.RAW_COLUMNS), root, anchor_epoch=D.ANCHOR_EPOCH)
    cleaning.clean_days(spark, root, f"{root}/clean", day=None, anchor_epoch=D.ANCHOR_EPOCH, days=30)
    good, bad = (spark.read.parquet(f"{root}/clean/{t}").groupBy("dt").agg(F.count("*").alias("n")) for t in ("impressions", "quarantine"))
    days = [str(r.dt) for r in good.select("dt").distinct().orderBy("dt").collect()]
    marks = spark.createDataFrame([(d, R.is_ready(spark, root, d), R.input_bytes(spark, f"{root}/impressions/dt={d}") > 0) for d in days], "d string, ready boolean, has_bytes boolean")
    both = good.withColumnRenamed("n", "rows_out").join(bad.withColumnRenamed("n", "quarantined"), "dt", "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return both.join(marks, both["dt"] == marks["d"].cast("date"), "left").select("dt", zero("rows_out"), zero("quarantined"), "ready", "has_bytes")


@query("SELECT event_id, CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS missing FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-05'")
def stage_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(pin(spark), "stage")
    D.table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("event_id"), F.col("value").cast("decimal(12,2)").cast("string").alias("value"), F.to_date("ts").alias("dt")).write.partitionBy("dt").parquet(path)
    staged = R.read_stage(spark, path, T.StructType.fromDDL("event_id long, value decimal(12,2), missing string"), "2024-01-05")
    return staged.where("raw_source_file like '%dt=2024-01-05%'").select("event_id", F.col("value").cast("double").alias("value"), "missing")


@query(f"WITH {Q.CHG} SELECT campaign_id, advertiser_id, campaign_vertical, budget_tier, bid_strategy, CAST(daily_budget_usd AS DOUBLE) AS daily_budget_usd, date_trunc('second', changed_at) AS changed_at FROM chg")
def change_log_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(pin(spark), "changes")
    c = D.changes(spark, sf_dir)
    c.withColumns({"budget_tier": F.upper("budget_tier"), "changed_at": F.date_format("changed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "daily_budget_usd": F.col("daily_budget_usd").cast("string")}).write.option("header", True).csv(path)
    return R.read_changes(spark, path).select("campaign_id", "advertiser_id", "campaign_vertical", "budget_tier", "bid_strategy", F.col("daily_budget_usd").cast("double").alias("daily_budget_usd"), F.col("changed_at").cast("timestamp_ntz").alias("changed_at"))


@query("SELECT event_id, event_type FROM events ORDER BY ts, event_id LIMIT 50")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.first_rows(D.table(spark, sf_dir, "events").orderBy("ts", "event_id").select("event_id", "event_type"), 50)
    return spark.createDataFrame([(r["event_id"], r["event_type"]) for r in rows], "event_id long, event_type string")


@query("SELECT CAST(ts AS DATE) AS day, row_number() OVER (ORDER BY CAST(ts AS DATE)) AS nth FROM (SELECT DISTINCT CAST(ts AS DATE) AS ts FROM events)")
def ordered_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = D.table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct().orderBy("day").collect()  # a row for each day
    return spark.createDataFrame([(r.day, k) for k, r in enumerate(days, 1)], "day date, nth long")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def truncate_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = KeyedStore(pin(spark), scratch(spark, "reload"))
    c = D.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    store.replace("customers", c.withColumn("c_acctbal", F.lit(0.0)).unionByName(c))
    store.replace("customers", c)
    return store.read("customers")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE 'X' END AS status FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def staged_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed upserts by bucket; one staged change fails half way and leaves
    nothing behind, the next overwrites some rows and adds others."""
    store = KeyedStore(pin(spark), scratch(spark, "merge"))
    o = D.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    put = {"keys": ("o_orderkey",), "bucket": "cast(o_orderkey div 4000 as string)"}
    store.upsert("orders", o.where("o_orderkey % 2 = 0").withColumn("status", F.lit("X")), **put)
    try:
        with store.change() as c:
            c.upsert("orders", o.withColumn("status", F.lit("BAD")), update=True, **put)
            raise InterruptedError
    except InterruptedError:
        pass
    store.upsert("orders", o.where("o_orderkey % 3 = 0"), update=True, **put)
    return store.read("orders")


_DRAW = "CAST(('0x' || substr(md5('11/{what}/' || impression_id), {at}, 8)) AS BIGINT)"
_FAULTS = ", ".join(f"'{r}'" for r in builder.FAULT_REASONS)


def _written(df: DataFrame, name: str) -> DataFrame:
    """Records as files, as a stream's source has them."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(builder.to_events(D.raw_text(spark, sf_dir), IMPRESSION_EVENT, D.ANCHOR_EPOCH), "events")


@query(f"""WITH {Q.CLEAN},
g AS (SELECT *, CASE WHEN {_DRAW.format(what="fault", at=1)} < 429496729 THEN ([{_FAULTS}])[{_DRAW.format(what="fault", at=9)} % 7 + 1] END AS fault FROM cln WHERE reject_reason IS NULL),
l AS (SELECT *, fault IS NULL AND {_DRAW.format(what="late", at=1)} < 128849018 AS late FROM g),
c AS (SELECT impression_id, user_id, 0 AS copy, fault, late, ts FROM l UNION ALL SELECT impression_id, user_id, 1, fault, late, ts FROM l WHERE {_DRAW.format(what="repeat", at=1)} < 214748364),
a AS (SELECT *, CAST(('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8)) AS BIGINT) % 6 AS p, date_trunc('second', ts) + CASE WHEN late THEN INTERVAL 40 DAY ELSE INTERVAL 0 DAY END AS came FROM c)
SELECT impression_id, CAST(copy AS INTEGER) AS copy, coalesce(fault, CASE WHEN copy > 0 THEN 'duplicate' WHEN late THEN 'late' END, 'valid') AS expected, CAST(p AS INTEGER) AS partition, row_number() OVER (PARTITION BY p ORDER BY came, impression_id, copy) - 1 AS "offset" FROM a""")
def stream_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    records = builder.build_stream(events, IMPRESSION_EVENT, fault_rate=0.1, dup_rate=0.05, late_rate=0.03, seed=11)
    return R.kafka_shaped(records, ["arrives_at", "impression_id", "copy"], headers={"contract": IMPRESSION_EVENT.name}).select("impression_id", "copy", "expected", "partition", "offset")


@query(f"""WITH {Q.CLEAN}, g AS (SELECT CASE WHEN {_DRAW.format(what="fault", at=1)} < 429496729 THEN ([{_FAULTS}])[{_DRAW.format(what="fault", at=9)} % 7 + 1] ELSE 'none' END AS reason FROM cln WHERE reject_reason IS NULL)
SELECT reason AS expected, reason AS judged, count(*) AS n FROM g GROUP BY 1""")
def stream_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each built record's expected reason beside the one it gets."""
    events = _events(spark, sf_dir)
    records = builder.build_stream(events, IMPRESSION_EVENT, fault_rate=0.1, dup_rate=0.0, late_rate=0.03, seed=11)
    known = events.select("campaign_id").distinct()
    judged = enforce(_written(R.kafka_shaped(records.withColumnRenamed("impression_id", "id"), ["arrives_at", "id", "copy"]), "records"), IMPRESSION_EVENT, known)
    reason = F.when(F.col("expected").isin("valid", "late"), "none").otherwise(F.col("expected"))
    return judged.groupBy(reason.alias("expected"), F.coalesce("reject_reason", F.lit("none")).alias("judged")).agg(F.count("*").alias("n"))


@query(f"WITH {Q.CLEAN} SELECT impression_id, true AS in_batch, true AS in_stream FROM cln WHERE reject_reason IS NULL")
def paths_share_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same raw rows through the batch path and as events through the
    contract: an id of one is an id of the other."""
    raw = D.raw_text(spark, sf_dir)
    good, _ = cleaning.split(cleaning.classify(cleaning.typed(raw, D.ANCHOR_EPOCH)))
    records = builder.build_stream(_events(spark, sf_dir), IMPRESSION_EVENT, fault_rate=0, dup_rate=0, late_rate=0)
    landed = _written(R.kafka_shaped(records.withColumnRenamed("impression_id", "id"), ["arrives_at", "id", "copy"]), "records")
    events = pipeline.accepted(enforce(landed, IMPRESSION_EVENT), IMPRESSION_EVENT)
    b, s = cleaning.dedupe(good).select(F.col("impression_id").alias("b")), events.select(F.col("impression_id").alias("s")).distinct()
    return b.join(s, F.col("b") == F.col("s"), "full").select(F.coalesce("b", "s").alias("impression_id"), F.col("b").isNotNull().alias("in_batch"), F.col("s").isNotNull().alias("in_stream"))


@query(f"WITH {Q.MART} SELECT campaign_day_id, date_day, campaign_id, campaign_sk, budget_tier, impressions, CAST(clicks AS BIGINT) AS clicks, conversions, CAST(spend AS DOUBLE) AS spend, reached_users FROM mart")
def star_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star schema built as a project: views, tables and what they need."""
    root = scratch(pin(spark), "project")
    D.impressions(spark, sf_dir).write.parquet(f"{root}/clean")
    D.changes(spark, sf_dir).write.parquet(f"{root}/changes")
    daily.star(spark, f"{root}/models", f"{root}/clean", f"{root}/changes", D.ANCHOR, D.END).build("mart_campaign_daily")
    return spark.table("mart_campaign_daily").select("campaign_day_id", "date_day", "campaign_id", "campaign_sk", "budget_tier", "impressions", "clicks", "conversions", F.col("spend").cast("double").alias("spend"), "reached_users")


@query("""SELECT date_trunc('hour', ts) AS hour, max(value) AS p95_s, round(sum(CASE WHEN event_id % 97 = 0 THEN user_id ELSE 0 END)::DOUBLE / sum(user_id), 9) AS dlq_rate,
max(value) <= 120 AND sum(CASE WHEN event_id % 97 = 0 THEN user_id ELSE 0 END)::DOUBLE / sum(user_id) <= 0.01 AS ok FROM events WHERE user_id > 0 GROUP BY 1""")
def slo_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as if each were a batch's metrics."""
    e = D.table(spark, sf_dir, "events").where("user_id > 0")
    m = e.select(F.col("ts").alias("_recorded_at"), F.col("value").alias("latency_p95_s"), F.col("user_id").alias("rows_in"), F.when(F.col("event_id") % 97 == 0, F.col("user_id")).otherwise(0).alias("rows_dlq"))
    return quality.slo(m, IMPRESSION_EVENT.slo["freshness_p95_seconds"], IMPRESSION_EVENT.slo["max_dlq_rate_per_hour"]).withColumn("dlq_rate", F.round("dlq_rate", 9))


@query("""WITH l AS (SELECT *, epoch_us(TIMESTAMP '2024-02-01') / 1e6 - epoch_us(ts) / 1e6 AS s FROM events)
SELECT 'raw' AS query_name, count(*) AS rows_in, round(quantile_cont(CASE WHEN event_id % 10 <> 0 THEN s END, 0.5), 3) AS latency_p50_s, round(quantile_cont(CASE WHEN event_id % 10 <> 0 THEN s END, 0.95), 3) AS latency_p95_s, max(CASE WHEN event_id % 10 <> 0 THEN ts END) AS max_event_ts FROM l""")
def stream_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    judged = D.table(spark, sf_dir, "events").select(at.alias("timestamp"), at.alias("event_ts"), F.col("event_id").cast("string").alias("impression_id"), F.when(F.col("event_id") % 10 == 0, "invalid_json").alias("reject_reason"))
    m = pipeline.batch_metrics(judged, "raw", 0, now=F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return m.select("query_name", "rows_in", F.round("latency_p50_s", 3).alias("latency_p50_s"), F.round("latency_p95_s", 3).alias("latency_p95_s"), F.col("max_event_ts").cast("timestamp_ntz").alias("max_event_ts"))


@query("""SELECT 'accepted_values:event_type' AS "check", event_type AS detail, 'warn' AS outcome FROM events WHERE event_type = 'error' UNION ALL SELECT 'unique:user_id', CAST(user_id AS VARCHAR), 'error' FROM events GROUP BY user_id HAVING count(*) > 1""")
def stored_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of which two don't hold; their rows as they were stored."""
    folder, e = scratch(pin(spark), "failures"), D.table(spark, sf_dir, "events")
    kinds = quality.Check("kinds", quality.accepted_values(e, "event_type", ["click", "purchase", "signup", "view"]), "warn")
    found = quality.run_checks([kinds, quality.Check("users", quality.unique(e, "user_id")), quality.Check("ids", quality.unique(e, "event_id"))], folder)
    parts = [spark.read.parquet(f"{folder}/{name}").withColumn("outcome", F.lit(outcome)) for name, (outcome, n) in found.items() if n]
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]


@query("""SELECT a AS role, b AS needed, a = b OR (a = 'PII_READER' AND b = 'ANALYST') OR (a = 'ADMIN' AND b IN ('ANALYST', 'TRANSFORMER', 'LOADER')) AS may, a IN ('PII_READER', 'TRANSFORMER', 'LOADER') AS clear
FROM (VALUES ('ADMIN'), ('ANALYST'), ('LOADER'), ('PII_READER'), ('TRANSFORMER')) x(a), (VALUES ('ADMIN'), ('ANALYST'), ('LOADER'), ('PII_READER'), ('TRANSFORMER')) y(b)""")
def role_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = sorted(masking.INHERITS)
    one = masking.tag(spark.createDataFrame([("5",)], "user_id string"), user_id="pseudonymous")
    clear = {r: masking.mask(one, r, "s").first().user_id == "5" for r in roles}
    return spark.createDataFrame([(a, b, masking.may_use(a, b), clear[a]) for a in roles for b in roles], "role string, needed string, may boolean, clear boolean")


# The event's fields, in order, with their types and whether they are required.
_FIELDS = "schema_version string y, impression_id string y, event_ts timestamp y, produced_at timestamp y, user_id string y, campaign_id bigint y, is_click boolean y, is_conversion_path boolean y, cost decimal(18.8) y, conversion_ts timestamp n, conversion_id bigint n, is_attributed boolean n, click_pos int n, click_nb int n, cpo decimal(18.6) n, time_since_last_click_s bigint n, cat1 string n, cat2 string n, cat3 string n, cat4 string n, cat5 string n, cat6 string n, cat7 string n, cat8 string n, cat9 string n"


@query(f"SELECT split_part(trim(f), ' ', 1) AS name, replace(split_part(trim(f), ' ', 2), '.', ',') AS type, split_part(trim(f), ' ', 3) = 'y' AS required, true AS nullable FROM (SELECT unnest(string_split('{_FIELDS}', ',')) AS f)")
def contract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    needed = set(IMPRESSION_EVENT.json_schema()["required"])
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), f.name in needed, f.nullable) for f in IMPRESSION_EVENT.spark_schema()], "name string, type string, required boolean, nullable boolean")


@query("""SELECT * FROM (VALUES ('core', 'prod', 'core'), ('core', 'dev', 'x_core'), (NULL, 'dev', 'x')) t(schema, target, name)""")
def schema_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(s, t, warehouse_name(t, s, "x")) for s, t in (("core", "prod"), ("core", "dev"), (None, "dev"))], "schema string, target string, name string")


@query("""SELECT 'insert' AS kind, 'MERGE INTO t t USING s s ON t.a = s.a AND t.b = s.b WHEN NOT MATCHED THEN INSERT (a, b, c) VALUES (s.a, s.b, s.c)' AS statement UNION ALL
SELECT 'update', 'MERGE INTO t t USING s s ON t.a = s.a AND t.b = s.b WHEN MATCHED THEN UPDATE SET t.c = s.c WHEN NOT MATCHED THEN INSERT (a, b, c) VALUES (s.a, s.b, s.c)'""")
def merge_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, merge_sql("t", "s", ["a", "b", "c"], ["a", "b"], k == "update")) for k in ("insert", "update")], "kind string, statement string")


@query("""SELECT event_id, ts + INTERVAL 2 HOUR AS east, ts - INTERVAL 5 HOUR - INTERVAL 30 MINUTE AS west, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, true AS now_agrees FROM events""")
def zone_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = lambda zone: F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("ts"))
    today = F.current_date() == F.to_date(F.current_timestamp())
    return D.table(spark, sf_dir, "events").select("event_id", moved("+02:00").alias("east"), moved("-05:30").alias("west"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("seconds"), (today & (F.current_timestamp() > F.col("ts").cast("timestamp"))).alias("now_agrees"))


@query("""SELECT CAST(ts AS DATE) AS dt, count(*) AS n, true AS one_file_each FROM events GROUP BY 1""")
def bucketed_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events dealt to four files a day by a hash of their id: all rows are
    there, and each id's file is the one its hash names."""
    from ..operators.layout import layout

    path = scratch(pin(spark), "layout")
    e = D.table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("dt"), F.col("ts").alias("event_ts"), F.col("user_id").alias("campaign_id"))
    layout(e, 4, key="event_id").write.partitionBy("dt").parquet(path)
    back = spark.read.parquet(path).withColumns({"file": F.col("_metadata.file_path"), "b": S.bucket(F.col("event_id"), 4)})
    files = back.groupBy("dt", "b").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))
    return files.groupBy("dt").agg(F.sum("n").alias("n"), (F.max("files") == 1).alias("one_file_each"))
