"""Registered queries, each beside the SQL it is checked against.

Results keep to what both engines print alike: decimals and sums as double,
counts as bigint, ratios rounded, ties broken by a unique id.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import cleaning, dims, facts, joins, masking, quality
from ..session import scratch
from . import domain as D
from . import sql as Q
from . import operations, streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = streams.QUERIES | operations.QUERIES
ORACLES: dict[str, str] = streams.ORACLES | operations.ORACLES


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def doubles(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in cols})


RATIOS = """round(CASE WHEN impressions = 0 THEN 0 ELSE clicks::DOUBLE / impressions END, 6) AS ctr, round(CASE WHEN clicks = 0 THEN 0 ELSE spend::DOUBLE / clicks END, 6) AS cpc,
round(CASE WHEN impressions = 0 THEN 0 ELSE spend::DOUBLE / impressions END * 1000, 6) AS cpm"""


@query(f"""WITH {Q.IMP}, d AS (SELECT campaign_id, CAST(event_ts AS DATE) AS day, count(*) AS impressions, CAST(count_if(is_click) AS BIGINT) AS clicks, CAST(sum(cost) AS DOUBLE) AS spend, count(DISTINCT user_id) AS reached_users FROM imp GROUP BY 1, 2)
SELECT *, {RATIOS} FROM d""")
def daily_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.impressions(spark, sf_dir).groupBy("campaign_id", F.to_date("event_ts").alias("day")).agg(F.count("*").alias("impressions"), F.count_if("is_click").alias("clicks"), F.sum("cost").cast("double").alias("spend"), F.countDistinct("user_id").alias("reached_users"))
    c = F.col
    out = d.withColumns({"ctr": S.ratio_or_zero(c("clicks"), c("impressions")), "cpc": S.ratio_or_zero(c("spend"), c("clicks")), "cpm": S.ratio_or_zero(c("spend"), c("impressions")) * 1000})
    return rounded(out, "ctr", "cpc", "cpm")


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.classify(cleaning.typed(D.raw_text(spark, sf_dir), D.ANCHOR_EPOCH))


@query(f"""WITH {Q.CLEAN} SELECT impression_id, date_trunc('second', ts) AS event_ts, CAST(k AS VARCHAR) AS user_id, user_id AS campaign_id, event_type = 'click' AS is_click, buys AS is_conversion_path, CASE WHEN buys THEN date_trunc('second', ts) + INTERVAL 60 SECOND END AS conversion_ts,
CASE WHEN buys THEN event_id END AS conversion_id, k % 3 = 0 AS is_attributed, CAST(NULL AS INTEGER) AS click_pos, CAST(nullif(k % 4 - 1, -1) AS INTEGER) AS click_nb, CAST(CAST(value AS DECIMAL(18,8)) AS DOUBLE) AS cost, CASE WHEN k % 2 = 0 THEN k END AS time_since_last_click_s, CAST(k % 6 AS VARCHAR) AS cat1, CAST(k % 14 AS VARCHAR) AS cat9, CAST(ts AS DATE) AS dt FROM cln WHERE reject_reason IS NULL""")
def clean_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = cleaning.split(_classified(spark, sf_dir))
    good = cleaning.dedupe(good)
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return good.select("impression_id", ntz("event_ts"), "user_id", "campaign_id", "is_click", "is_conversion_path", ntz("conversion_ts"), "conversion_id", "is_attributed", "click_pos", "click_nb", F.col("cost").cast("double").alias("cost"), "time_since_last_click_s", "cat1", "cat9", "dt")


@query(f"WITH {Q.CLEAN} SELECT CASE WHEN reject_reason IS NULL AND user_id % 7 = 0 THEN 'unknown_campaign' ELSE coalesce(reject_reason, 'valid') END AS reason, count(*) AS n FROM cln GROUP BY 1")
def quarantine_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = D.table(spark, sf_dir, "events").select(F.col("user_id").alias("campaign_id")).distinct().where("campaign_id % 7 <> 0")
    judged = cleaning.check_reference(_classified(spark, sf_dir), known)
    return judged.groupBy(F.coalesce("reject_reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {Q.CLEAN}, again AS (SELECT impression_id, reject_reason FROM cln UNION ALL SELECT impression_id, reject_reason FROM cln WHERE event_id % 5 = 0)
SELECT (SELECT count(*) FROM again) AS rows_in, count_if(reject_reason IS NOT NULL)::BIGINT AS quarantined, count(DISTINCT CASE WHEN reject_reason IS NULL THEN impression_id END) AS rows_out, (count_if(reject_reason IS NULL) - count(DISTINCT CASE WHEN reject_reason IS NULL THEN impression_id END))::BIGINT AS duplicates_removed FROM again""")
def row_key_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = D.raw_text(spark, sf_dir)
    rows = cleaning.classify(cleaning.typed(raw.unionByName(raw.where("event_id % 5 = 0")), D.ANCHOR_EPOCH))
    good, bad = cleaning.split(rows)
    one = good.agg(F.count("*").alias("g")).crossJoin(bad.agg(F.count("*").alias("quarantined"))).crossJoin(cleaning.dedupe(good).agg(F.count("*").alias("rows_out")))
    return one.select((F.col("g") + F.col("quarantined")).alias("rows_in"), "quarantined", "rows_out", (F.col("g") - F.col("rows_out")).alias("duplicates_removed"))


@query("SELECT CASE WHEN p_partkey IS NULL THEN 'unknown_part' ELSE 'valid' END AS reason, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS quantity FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 5 <> 0) p ON l_partkey = p_partkey GROUP BY 1")
def reference_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey")).where("l_partkey % 5 <> 0")
    rows = D.table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity").withColumn("reject_reason", F.lit(None).cast("string"))
    judged = cleaning.check_reference(rows, known, "l_partkey", "unknown_part", broadcast=False)
    return judged.groupBy(F.coalesce("reject_reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(12,2)")).cast("double").alias("quantity"))


JOIN_SQL = "SELECT p_brand, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1"


def _join(strategy: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = D.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), "l_orderkey", "l_linenumber", "l_extendedprice")
        parts = D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_brand")
        return strategy(lines, parts).groupBy("p_brand").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("price"))

    return run


for _name, _strategy in {
    "join_merge": lambda a, b: joins.merge_join(a, b, ["part"]),
    "join_broadcast": lambda a, b: joins.broadcast_join(a, b, ["part"]),
    "join_aqe": lambda a, b: joins.aqe_join(a, b, ["part"]),
    "join_salted": lambda a, b: joins.salted_join(a, b, ["part"], row_key="l_orderkey", hot=joins.hot_keys(a, ["part"], 1.3), salts=16),
}.items():
    QUERIES[_name], ORACLES[_name] = _join(_strategy), JOIN_SQL


@query("""WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), m AS (SELECT avg(n) AS mean FROM c)
SELECT count(*) AS keys, CAST(sum(n) AS BIGINT) AS rows, round(avg(n), 6) AS mean_rows, round(max(n)::DOUBLE / sum(n), 9) AS top1_share, round((SELECT sum(n) FROM (SELECT n FROM c ORDER BY n DESC, l_partkey LIMIT 10))::DOUBLE / sum(n), 9) AS top10_share, CAST((SELECT count(*) FROM c, m WHERE n > 1.3 * mean) AS BIGINT) AS hot_keys FROM c""")
def skew_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.skew_stats(D.table(spark, sf_dir, "lineitem"), "l_partkey", 1.3)


@query(f"WITH {Q.IMP} SELECT campaign_id, count(*) AS impressions, CAST(sum(cost) AS DOUBLE) AS spend FROM imp GROUP BY 1 ORDER BY spend DESC, campaign_id LIMIT 20")
def topk_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.impressions(spark, sf_dir).groupBy("campaign_id").agg(F.count("*").alias("impressions"), F.sum("cost").cast("double").alias("spend")).orderBy(F.desc("spend"), "campaign_id").limit(20)


@query(f"""WITH {Q.CHG}, days AS (SELECT CAST(range AS DATE) AS dt FROM range(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)),
r AS (SELECT dt, campaign_id, budget_tier, bid_strategy, row_number() OVER (PARTITION BY campaign_id, dt ORDER BY changed_at DESC) AS k FROM chg, days WHERE CAST(changed_at AS DATE) <= dt) SELECT dt, campaign_id, budget_tier, bid_strategy FROM r WHERE k = 1""")
def calendar_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = joins_days(spark)
    return joins.calendar_asof(D.changes(spark, sf_dir), days, key="campaign_id", at="changed_at").select("dt", "campaign_id", "budget_tier", "bid_strategy")


def joins_days(spark: SparkSession) -> DataFrame:
    from ..sources.raw import date_spine

    return date_spine(spark, D.ANCHOR, D.END, "dt")


@query("""SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, d AS date_day, CAST(isodow(d) AS INTEGER) AS day_of_week_iso, left(dayname(d), 3) AS day_name, CAST(date_trunc('week', d) AS DATE) AS week_start, CAST(week(d) AS INTEGER) AS iso_week, CAST(date_trunc('month', d) AS DATE) AS month_start, left(monthname(d), 3) AS month_name,
CAST(quarter(d) AS INTEGER) AS quarter, CAST(year(d) AS INTEGER) AS year, isodow(d) IN (6, 7) AS is_weekend, CAST(date_diff('day', DATE '2024-01-01', d) + 1 AS INTEGER) AS dataset_day_number FROM (SELECT CAST(range AS DATE) AS d FROM range(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY))""")
def dim_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims.dim_date(spark, D.ANCHOR, D.END)


@query(f"WITH {Q.IMP} SELECT DISTINCT md5(seg) AS device_key, seg AS device_segment_code, 'segment_' || seg AS device_segment_label, false AS is_unknown FROM imp WHERE seg <> 'unknown' UNION ALL SELECT '-1', 'unknown', 'Unknown segment', true")
def dim_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.Star(spark, sf_dir).segments


@query(f"""WITH {Q.CHG} SELECT campaign_sk, campaign_id, advertiser_id, campaign_vertical, budget_tier, bid_strategy, CAST(daily_budget_usd AS DOUBLE) AS daily_budget_usd, 'change' AS change_reason, strftime(valid_from, '%Y-%m-%d %H:%M:%S') AS valid_from, strftime(valid_to, '%Y-%m-%d %H:%M:%S') AS valid_to, is_current, CAST(version_number AS INTEGER) AS version_number FROM dimc
UNION ALL SELECT '-1', -1, NULL, 'unknown', 'unknown', 'unknown', NULL, NULL, '1900-01-01 00:00:00', '9999-12-31 00:00:00', true, 1""")
def dim_campaign_scd2(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    # the open end, year 9999, is beyond what pandas holds as a time
    return doubles(D.Star(spark, sf_dir).campaigns, "daily_budget_usd").withColumns({"valid_from": text("valid_from"), "valid_to": text("valid_to")})


@query("SELECT o_custkey, o_orderdate, o_orderkey, lower(o_orderpriority) AS o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def change_log_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = dims.keep_last(D.table(spark, sf_dir, "orders"), ["o_custkey", "o_orderdate"], F.desc("o_orderkey"))
    return last.select("o_custkey", "o_orderdate", "o_orderkey", F.lower("o_orderpriority").alias("o_orderpriority"))


FACT = ["impression_id", "event_ts", "date_key", "campaign_sk", "campaign_id", "device_key", "user_id", "cost", "is_click", "conversion_id", "conversion_ts", "is_attributed"]
FACT_SQL = "SELECT impression_id, event_ts, date_key, campaign_sk, campaign_id, device_key, user_id, CAST(cost AS DOUBLE) AS cost, is_click, conversion_id, conversion_ts, is_attributed FROM fct"


@query(f"WITH {Q.FCT} {FACT_SQL}")
def fct_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(D.Star(spark, sf_dir).impressions, "cost").select(*FACT)


@query(f"WITH {Q.FCT} SELECT md5(impression_id) AS click_id, impression_id, event_ts AS click_ts, date_key, campaign_sk, campaign_id, device_key, user_id, CAST(cost AS DOUBLE) AS cost, conversion_id FROM fct WHERE is_click")
def fct_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(D.Star(spark, sf_dir).clicks, "cost")


@query(f"WITH {Q.CONV} SELECT * EXCLUDE (raw_seconds) FROM conv")
def fct_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(D.Star(spark, sf_dir).conversions, "path_cost")


@query(f"""WITH {Q.MART} SELECT * REPLACE (CAST(spend AS DOUBLE) AS spend, CAST(clicks AS BIGINT) AS clicks, CAST(attributed_conversions AS BIGINT) AS attributed_conversions), {RATIOS}, round(CASE WHEN clicks = 0 THEN 0 ELSE conversions::DOUBLE / clicks END, 6) AS cvr, round(CASE WHEN attributed_conversions = 0 THEN NULL ELSE spend::DOUBLE / attributed_conversions END, 6) AS cpa FROM mart""")
def mart_campaign_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(doubles(D.Star(spark, sf_dir).mart, "spend"), "ctr", "cvr", "cpc", "cpm", "cpa")


@query(f"WITH {Q.FCT} {FACT_SQL}")
def microbatch_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table built day by day, with one day spoilt and rebuilt."""
    full, path = D.Star(spark, sf_dir).impressions, scratch(spark, "microbatch")
    facts.replace_batches(spark, full, path, event_time="event_ts", first=D.ANCHOR, end=D.END, lookback=0)
    facts.replace_batches(spark, full.where("date_key = 20240110").withColumn("cost", F.col("cost") * 0), path, event_time="event_ts", first="2024-01-10", end="2024-01-11", lookback=0)
    facts.replace_batches(spark, full, path, event_time="event_ts", first="2024-01-10", end="2024-01-11", lookback=1)
    return doubles(spark.read.parquet(path), "cost").select(*FACT)


@query("""SELECT o_custkey, round(CASE WHEN count_if(o_orderstatus = 'P') = 0 THEN 0 ELSE count(*)::DOUBLE / count_if(o_orderstatus = 'P') END, 6) AS or_zero, round(count(*)::DOUBLE / nullif(count_if(o_orderstatus = 'P'), 0), 6) AS or_null FROM orders GROUP BY 1""")
def safe_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("p"))
    return rounded(g.select("o_custkey", S.ratio_or_zero(F.col("n"), F.col("p")).alias("or_zero"), S.ratio_or_null(F.col("n"), F.col("p")).alias("or_null")), "or_zero", "or_null")


@query("""SELECT event_id, CAST(ts AS DATE) AS day, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS date_key, CAST(isodow(ts) AS INTEGER) AS dow, CAST(date_trunc('week', ts) AS DATE) AS week, CAST(week(ts) AS INTEGER) AS iso_week, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso, date_diff('second', TIMESTAMP '2024-01-01', ts) AS since, CAST(ts AS DATE) + 1 AS tomorrow, ts + INTERVAL 300 SECOND AS later FROM events""")
def date_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("ts")
    return D.table(spark, sf_dir, "events").select(
        "event_id", F.to_date(t).alias("day"), S.date_key(F.to_date(t)).alias("date_key"), (F.weekday(t) + 1).alias("dow"), F.to_date(F.date_trunc("week", t)).alias("week"), F.weekofyear(t).alias("iso_week"), S.iso_text(t).alias("iso"),
        S.seconds_between(F.lit(D.ANCHOR).cast("timestamp"), t).alias("since"), F.date_add(F.to_date(t), 1).alias("tomorrow"), (t + F.expr("INTERVAL 300 SECONDS")).alias("later"),
    )


@query("""SELECT event_id, trim('  ' || event_type || ' ') AS trimmed, concat_ws('-', event_type, CAST(user_id AS VARCHAR)) AS joined, length(props) AS n, nullif(event_type, 'view') AS but_view, regexp_extract(props, '([0-9]+)', 1) AS digits, NOT regexp_matches(event_type, '^s') AS no_s, split_part(CAST(ts AS VARCHAR), '-', 1) AS part, lower(upper(event_type)) AS low, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'x' ELSE '7' END AS BIGINT) AS tried FROM events""")
def string_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return D.table(spark, sf_dir, "events").select(
        "event_id", F.trim(F.concat(F.lit("  "), c("event_type"), F.lit(" "))).alias("trimmed"), F.concat_ws("-", "event_type", c("user_id").cast("string")).alias("joined"), F.length("props").cast("bigint").alias("n"), F.nullif(c("event_type"), F.lit("view")).alias("but_view"),
        F.regexp_extract("props", "([0-9]+)", 1).alias("digits"), (~c("event_type").rlike("^s")).alias("no_s"), F.split(c("ts").cast("string"), "-")[0].alias("part"), F.lower(F.upper("event_type")).alias("low"), S.clean_cast(F.when(c("event_id") % 3 == 0, " x").otherwise(" 7"), "bigint").alias("tried"),
    )


@query("""SELECT event_id, sha256(event_type || chr(1) || props) AS row_key, md5(CAST(user_id AS VARCHAR) || '-' || CASE WHEN event_id % 2 = 0 THEN '_null_' ELSE event_type END) AS surrogate, sha256(CAST(user_id AS VARCHAR) || 'pepper') AS pseudonym FROM events""")
def hash_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.when(F.col("event_id") % 2 != 0, F.col("event_type"))
    return D.table(spark, sf_dir, "events").select("event_id", S.row_key(["event_type", "props"]).alias("row_key"), S.surrogate_key(F.col("user_id"), some).alias("surrogate"), S.pseudonym(F.col("user_id"), "pepper").alias("pseudonym"))


@query("SELECT 'both' AS kind, user_id AS key FROM (SELECT user_id FROM events INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'event', user_id FROM events WHERE event_type = 'error'")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, o = D.table(spark, sf_dir, "events"), D.table(spark, sf_dir, "orders")
    both = e.select(F.col("user_id").alias("key")).intersect(o.select(F.col("o_custkey").alias("key")))
    return both.select(F.lit("both").alias("kind"), "key").unionAll(e.where("event_type = 'error'").select(F.lit("event").alias("kind"), F.col("user_id").alias("key")))


@query("""SELECT c_custkey, 'with' AS kind FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) UNION ALL SELECT c_custkey, 'without' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = D.table(spark, sf_dir, "customer").select("c_custkey"), D.table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("kind", F.lit("with")).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("kind", F.lit("without")))


@query("""WITH b AS (SELECT event_id, CAST(ts AS DATE) AS dt FROM events WHERE event_id % 11 <> 0), s AS (SELECT event_id, CAST(ts AS DATE) AS dt FROM events WHERE event_id % 13 <> 0 AND CAST(ts AS DATE) > DATE '2024-01-03'),
days AS (SELECT dt FROM b INTERSECT SELECT dt FROM s), j AS (SELECT coalesce(b.dt, s.dt) AS dt, b.event_id AS be, s.event_id AS se FROM (SELECT * FROM b WHERE dt IN (SELECT dt FROM days)) b FULL OUTER JOIN (SELECT * FROM s WHERE dt IN (SELECT dt FROM days)) s ON b.event_id = s.event_id)
SELECT dt, CAST(count_if(se IS NULL) AS BIGINT) AS missing_in_stream, CAST(count_if(be IS NULL) AS BIGINT) AS missing_in_batch FROM j WHERE dt < DATE '2024-01-30' GROUP BY 1 HAVING count_if(se IS NULL) + count_if(be IS NULL) > 0""")
def reconcile_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("dt"))
    return quality.reconcile_paths(e.where("event_id % 11 <> 0"), e.where("event_id % 13 <> 0 and dt > date'2024-01-03'"), F.lit("2024-01-30").cast("date"), key="event_id")


@query(f"""WITH {Q.CHG}, d AS (SELECT campaign_id, valid_from, CASE WHEN campaign_id % 10 = 0 AND version_number = 2 THEN valid_to - INTERVAL 1 DAY ELSE valid_to END AS valid_to, is_current AND campaign_id % 15 <> 0 AS is_current FROM dimc),
t AS (SELECT *, lead(valid_from) OVER (PARTITION BY campaign_id ORDER BY valid_from) AS nxt FROM d)
SELECT 'scd2:gap_or_overlap' AS "check", CAST(campaign_id AS VARCHAR) AS detail FROM t WHERE nxt <> valid_to UNION ALL SELECT 'scd2:current', CAST(campaign_id AS VARCHAR) || ' has ' || CAST(count_if(is_current) AS VARCHAR) FROM d GROUP BY campaign_id HAVING count_if(is_current) <> 1""")
def scd2_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension with planted gaps and missing current versions."""
    d = D.Star(spark, sf_dir).campaigns.where("campaign_id <> -1")
    broken = d.withColumn("valid_to", F.when((F.col("campaign_id") % 10 == 0) & (F.col("version_number") == 2), F.col("valid_to") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("valid_to"))).withColumn("is_current", F.col("is_current") & (F.col("campaign_id") % 15 != 0))
    return quality.scd2_integrity(broken, "campaign_id")


@query(f"WITH {Q.MART}, m AS (SELECT sum(impressions) AS mi, sum(clicks) AS mc, sum(spend) AS ms FROM mart), f AS (SELECT count(*) AS fi, count_if(is_click) AS fc, sum(cost) AS fs FROM fct) SELECT 'mart_reconciles' AS \"check\", '' AS detail FROM m, f WHERE mi <> fi OR mc <> fc OR abs(ms - fs) > 0.0001")
def mart_reconciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.Star(spark, sf_dir)
    return quality.mart_reconciles(s.mart, s.impressions)


@query(f"WITH {Q.FCT} SELECT 'unknown:campaign_sk' AS \"check\", impression_id AS detail FROM fct WHERE campaign_sk = '-1' OR campaign_id % 50 = 0")
def unknown_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts against a dimension that lacks some campaigns."""
    s = D.Star(spark, sf_dir)
    return quality.unknown_members(facts.fct_impressions(s.staged, s.campaigns.where("campaign_id % 50 <> 0"), s.segments))


@query("""SELECT 'not_null:v' AS "check", 'null' AS detail FROM events WHERE event_id % 1000 = 0 UNION ALL SELECT 'unique:user_id', CAST(user_id AS VARCHAR) FROM events GROUP BY user_id HAVING count(*) > 1
UNION ALL SELECT 'relationship:user_id', CAST(user_id AS VARCHAR) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 100 <> 0) UNION ALL SELECT 'accepted_values:event_type', event_type FROM events WHERE event_type = 'error'
UNION ALL SELECT 'accepted_range:event_id', CAST(event_id AS VARCHAR) FROM events WHERE event_id < 5 OR event_id > 9990 UNION ALL SELECT 'holds:small', 'null' FROM events WHERE NOT (user_id < 140)""")
def generic_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 1000 != 0, F.col("value")))
    parents = D.table(spark, sf_dir, "customer").where("c_custkey % 100 <> 0")
    found = [quality.not_null(e, "v"), quality.unique(e, "user_id"), quality.relationship(e, "user_id", parents, "c_custkey"), quality.accepted_values(e, "event_type", ["click", "purchase", "signup", "view"]), quality.accepted_range(e, "event_id", 5, 9990), quality.holds(e, "small", "user_id < 140")]
    return reduce(DataFrame.unionByName, found)


@query("""SELECT max(ts) AS max_loaded_at, CAST(epoch(TIMESTAMP '2024-02-01') AS BIGINT) - CAST(floor(epoch(max(ts))) AS BIGINT) AS age_seconds, CASE WHEN CAST(epoch(TIMESTAMP '2024-02-01') AS BIGINT) - floor(epoch(max(ts))) > 50 * 3600 THEN 'error' WHEN CAST(epoch(TIMESTAMP '2024-02-01') AS BIGINT) - floor(epoch(max(ts))) > 26 * 3600 THEN 'warn' ELSE 'pass' END AS status FROM events""")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.freshness(D.table(spark, sf_dir, "events"), "ts", F.lit("2024-02-01 00:00:00").cast("timestamp"), 26 * 3600, 50 * 3600)


@query(f"WITH {Q.IMP} SELECT campaign_id, round(quantile_cont(CAST(cost AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST(cost AS DOUBLE), 0.95), 6) AS p95, min(event_ts) AS first_ts, max(event_ts) AS last_ts FROM imp GROUP BY 1")
def cost_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = F.col("cost").cast("double")
    g = D.impressions(spark, sf_dir).groupBy("campaign_id").agg(F.percentile(cost, F.lit(0.5)).alias("p50"), F.percentile(cost, F.lit(0.95)).alias("p95"), F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("last_ts"))
    return rounded(g, "p50", "p95")


@query(f"WITH {Q.IMP} SELECT campaign_id, count(DISTINCT user_id) AS users, true AS within FROM imp GROUP BY 1")
def approx_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The approximate count beside the exact one: within six times the
    sketch's stated deviation, and one."""
    deviation = 0.02
    g = D.impressions(spark, sf_dir).groupBy("campaign_id").agg(F.countDistinct("user_id").alias("users"), F.approx_count_distinct("user_id", deviation).alias("about"))
    return g.select("campaign_id", "users", (F.abs(F.col("about") - F.col("users")) <= 6 * deviation * F.col("users") + 1).alias("within"))


@query("SELECT CAST(p AS DOUBLE) AS p, true AS within FROM (VALUES (0.05), (0.5), (0.95)) t(p)")
def sketched_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles from a sketch of bounded size: the share of values up to each
    is within the stated error of what was asked for."""
    rows, accuracy, asked = D.table(spark, sf_dir, "orders").select("o_totalprice"), 1000, [0.05, 0.5, 0.95]
    q = rows.agg(F.approx_percentile("o_totalprice", asked, accuracy).alias("q"), F.count("*").alias("n"))
    # one row meets each value
    upto = rows.crossJoin(F.broadcast(q)).agg(F.first("n").alias("n"), *[F.count_if(F.col("o_totalprice") <= F.get("q", F.lit(i))).alias(f"u{i}") for i in range(3)])
    shares = F.array(*[F.struct(F.lit(p).alias("p"), (F.abs(F.col(f"u{i}") / F.col("n") - p) <= 2 / accuracy + 1 / F.col("n")).alias("within")) for i, p in enumerate(asked)])
    return upto.select(F.explode(shares).alias("s")).select("s.*")


@query(f"WITH {Q.IMP} SELECT impression_id, campaign_id, sha256(user_id || 'pepper') AS user_id FROM imp")
def masked_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = masking.tag(D.impressions(spark, sf_dir), user_id="pseudonymous")
    return masking.mask(marked.select("impression_id", "campaign_id", "user_id"), "ANALYST", "pepper")


@query("""SELECT event_id, s AS copy, CAST(event_id AS VARCHAR) || '-' || CAST(s AS VARCHAR) AS new_key FROM events, range(1, 4) r(s)""")
def row_multiplication(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.table(spark, sf_dir, "events").select("event_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(3).cast("bigint"))).alias("copy"))
    return e.withColumn("new_key", F.concat_ws("-", "event_id", "copy"))


@query("""SELECT event_id, CAST(ts AS DATE) AS dt, CASE WHEN CAST(ts AS DATE) = DATE '2024-01-05' THEN 0 ELSE value END AS value FROM events""")
def partition_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by day of which one day is written anew."""
    path = scratch(spark, "overwrite")
    e = D.table(spark, sf_dir, "events").select("event_id", "value", F.to_date("ts").alias("dt"))
    e.repartition("dt").write.partitionBy("dt").parquet(path)
    e.where("dt = date'2024-01-05'").withColumn("value", F.lit(0.0)).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)
    return spark.read.parquet(path).select("event_id", "dt", "value")
