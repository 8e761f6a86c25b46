from datetime import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparrowline.functions import scalars as S
from sparrowline.operators import dims, facts, joins, masking, quality
from sparrowline.session import warehouse_name
from sparrowline.sources.raw import date_spine, record_partition


def ts(x):
    return datetime.fromisoformat(x)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(1, 3), st.integers(0, 50)), min_size=1, max_size=20))
def test_versions_tile_time(spark, changes):
    rows = [(k, datetime(2025, 1, 1 + d // 24, d % 24), "x") for k, d in changes]
    d = dims.scd2(spark.createDataFrame(rows, "campaign_id long, changed_at timestamp, tier string"), key="campaign_id", at="changed_at", attributes=["tier"], sk="campaign_sk", unknown={"campaign_id": -1})
    assert quality.scd2_integrity(d, "campaign_id").count() == 0
    assert d.count() == len(changes) + 1 and d.where("version_number = 1 and valid_from <> timestamp'1900-01-01'").count() == 0


def test_interval_edges(spark):
    v = spark.createDataFrame([(1, ts("2025-01-01"), ts("2025-01-02"), "a"), (1, ts("2025-01-02"), ts("2025-01-03"), "b")], "k int, valid_from timestamp, valid_to timestamp, name string")
    f = spark.createDataFrame([(1, ts("2025-01-02")), (1, ts("2025-01-03")), (2, ts("2025-01-02"))], "k int, t timestamp")
    got = {(r.k, str(r.t)): r.name for r in joins.interval_join(f, v, "k", "t", ["name"]).collect()}
    assert got == {(1, "2025-01-02 00:00:00"): "b", (1, "2025-01-03 00:00:00"): None, (2, "2025-01-02 00:00:00"): None}
    closed = {(r.k, str(r.t)): r.name for r in joins.interval_join(f, v, "k", "t", ["name"], closed_end=True).collect()}
    assert closed[1, "2025-01-02 00:00:00"] == "a" and closed[1, "2025-01-03 00:00:00"] == "b"


def touch(i, t, click, conv=1, conv_ts="2025-01-05", cost="1.0"):
    return (i, ts(t), f"c{i}", 7, "d", "u", click, conv, ts(conv_ts), False, cost)


def test_attribution(spark):
    rows = [touch("a", "2025-01-01", True), touch("b", "2025-01-02", True), touch("b0", "2025-01-02", True), touch("c", "2025-01-03", False), touch("late", "2025-01-06", True), touch("n", "2025-01-01", False, 2), touch("m", "2025-01-01", False, 2), touch("x", "2025-01-09", False, 3)]
    df = spark.createDataFrame(rows, "impression_id string, event_ts timestamp, campaign_sk string, campaign_id long, device_key string, user_id string, is_click boolean, conversion_id long, conversion_ts timestamp, is_attributed boolean, cost string").withColumn("cost", F.col("cost").cast("decimal(18,8)"))
    got = {r.conversion_id: r for r in facts.fct_conversions(df).collect()}
    assert set(got) == {1, 2}  # all of conversion 3 lies after it
    assert (got[1].credited_impression_id, got[1].last_touch_impression_id, got[1].path_impressions, got[1].path_clicks, got[1].credited_by_click) == ("b", "c", 4, 3, True)
    assert (got[2].credited_impression_id, got[2].credited_by_click, got[2].seconds_first_touch_to_conversion) == ("m", False, 4 * 86400)


def test_mart_drops_days_outside_and_keeps_conversion_only_days(spark):
    imp = spark.createDataFrame([(7, 20250101, True, "u", "2")], "campaign_id long, date_key int, is_click boolean, user_id string, cost string").withColumn("cost", F.col("cost").cast("decimal(18,8)"))
    conv = spark.createDataFrame([(7, 20250102, True), (7, 20250301, True)], "credited_campaign_id long, conversion_date_key int, is_attributed_to_source boolean")
    camp = spark.createDataFrame([("s", 7, ts("1900-01-01"), ts("2025-01-02")), ("t", 7, ts("2025-01-02"), ts("9999-12-31"))], "campaign_sk string, campaign_id long, valid_from timestamp, valid_to timestamp")
    got = {r.date_key: r for r in facts.mart_campaign_daily(imp, conv, dims.dim_date(spark, "2025-01-01", "2025-01-31"), camp).collect()}
    assert set(got) == {20250101, 20250102}
    assert got[20250101].cpa is None and got[20250101].cpm == 2000 and got[20250101].campaign_sk == "s"
    assert got[20250102].ctr == 0 and got[20250102].cpa == 0 and got[20250102].campaign_sk == "t"


def test_salting_replicates_only_hot_rows(spark):
    f = spark.range(1000).select(F.when(F.col("id") < 900, 1).otherwise(F.col("id")).alias("k"), "id")
    d = f.select("k").distinct().withColumn("v", F.col("k") * 2)
    hot = joins.hot_keys(f, ["k"], 5)
    assert [r.k for r in hot.collect()] == [1]
    got = joins.salted_join(f, d, ["k"], row_key="id", hot=hot)
    assert got.count() == 1000 and got.where("v <> k * 2 or v is null").count() == 0


def test_join_strategies_plan(spark):
    f, d = spark.range(1000).withColumnRenamed("id", "k"), spark.range(10).withColumnRenamed("id", "k")
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text(joins.broadcast_join(f, d, ["k"])) and "SortMergeJoin" in text(joins.merge_join(f, d, ["k"]))
    assert "SortMergeJoin" in text(joins.broadcast_join(f, d, ["k"], most_bytes=5))


def test_scalars(spark):
    r = spark.range(1).select(
        S.ratio_or_zero(F.lit(1), F.lit(0)).alias("z"), S.ratio_or_null(F.lit(1), F.lit(0)).alias("n"), S.seconds_between(F.lit("2025-01-01 00:00:00.9").cast("timestamp"), F.lit("2025-01-01 00:00:01.1").cast("timestamp")).alias("s"),
        S.date_key(F.lit("2025-01-05").cast("date")).alias("d"), record_partition(F.lit("7").cast("binary")).alias("p"), S.clean_cast(F.lit(" 1e3 "), "decimal(18,8)").alias("e"), S.clean_cast(F.lit("3.5"), "bigint").alias("x"),
    ).first()
    assert (r.z, r.n, r.s, r.d, float(r.e), r.x) == (0, None, 1, 20250105, 1000.0, None) and 0 <= r.p < 6
    assert date_spine(spark, "2025-01-01", "2025-01-03").count() == 2
    assert warehouse_name("prod", "core", "x") == "core" and warehouse_name("dev", "core", "x") == "x_core" and warehouse_name("dev", None, "x") == "x"


def test_masking_follows_columns(spark):
    df = masking.tag(spark.createDataFrame([("5", 1), (None, 2)], "user_id string, n int"), user_id="pseudonymous").where("n > 0").select("n", "user_id")
    assert masking.tagged(df) == {"user_id": "pseudonymous"}
    hidden = [r.user_id for r in masking.mask(df, "ANALYST", "s").orderBy("n").collect()]
    assert len(hidden[0]) == 64 and hidden[1] is None
    assert masking.mask(df, "PII_READER", "s").orderBy("n").first().user_id == "5"
    assert masking.may_use("PII_READER", "ANALYST") and not masking.may_use("ANALYST", "PII_READER")


def test_checks_are_stored(spark, tmp_path):
    df = spark.createDataFrame([(1,), (None,)], "a int")
    got = quality.run_checks([quality.Check("nulls", quality.not_null(df, "a"), "warn"), quality.Check("fine", quality.accepted_range(df, "a", 0, 5))], f"file://{tmp_path}")
    assert got == {"nulls": ("warn", 1), "fine": ("pass", 0)} and spark.read.parquet(f"file://{tmp_path}/nulls").count() == 1


def test_calendar_asof_late_changes(spark):
    c = spark.createDataFrame([(1, ts("2024-12-01"), "a"), (1, ts("2025-01-02T05:00"), "b"), (1, ts("2025-01-02T09:00"), "c")], "k int, at timestamp, v string")
    got = [(str(r.dt), r.v) for r in joins.calendar_asof(c, date_spine(spark, "2025-01-01", "2025-01-04", "dt"), key="k", at="at").orderBy("dt").collect()]
    assert got == [("2025-01-01", "a"), ("2025-01-02", "c"), ("2025-01-03", "c")]
