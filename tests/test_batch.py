import pytest
from pyspark.sql import functions as F

from sparrowline.operators.cleaning import check_reference, classify, clean_days, split, typed
from sparrowline.operators.layout import shuffle_tasks, target_files
from sparrowline.sources import raw as R
from sparrowline.sources.synthetic import campaign_changes, land, raw_impressions

EPOCH = 1_735_689_600
ROWS = 20_000


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('raw')}"
    land(raw_impressions(spark, ROWS, malformed=5000), root, anchor_epoch=EPOCH)
    return root


def one_row(**change):
    row = {c: "-1" for c in R.RAW_COLUMNS} | {"timestamp": "3600", "uid": " 18 ", "campaign": "70003", "conversion": "0", "attribution": "0", "click": "1", "cost": "0.00123"} | {f"cat{i}": f"c{i}" for i in range(1, 10)}
    return [tuple((row | change)[c] for c in R.RAW_COLUMNS)]


def judge(spark, **change):
    return classify(typed(spark.createDataFrame(one_row(**change), R.RAW_SCHEMA), EPOCH)).first()


def test_one_row(spark):
    r = judge(spark)
    assert str(r.event_ts) == "2025-01-01 01:00:00" and r.user_id == "18" and r.conversion_ts is None and r.cpo is None and r.is_click is True and r.reject_reason is None and str(r.dt) == "2025-01-01"


@pytest.mark.parametrize("change, reason", [
    ({"timestamp": "3.5"}, "bad_timestamp"), ({"timestamp": "9223372036854775807"}, "bad_timestamp"), ({"uid": "x"}, "bad_uid"), ({"campaign": ""}, "bad_campaign"), ({"click": "y"}, "bad_flag"), ({"cost": "-1"}, "bad_cost"), ({"cost": None}, "bad_cost"),
    ({"timestamp": "x", "uid": "x"}, "bad_timestamp"), ({"click": "2"}, None), ({"cost": "1e3"}, None),
])
def test_first_reason(spark, change, reason):
    assert judge(spark, **change).reject_reason == reason


def test_unknown_campaign_never_overrides(spark):
    df = classify(typed(spark.createDataFrame(one_row() + one_row(campaign="") + one_row(campaign="5"), R.RAW_SCHEMA), EPOCH))
    known = spark.createDataFrame([(70003,)], "campaign_id long")
    assert sorted(str(r.reject_reason) for r in check_reference(df, known).collect()) == ["None", "bad_campaign", "unknown_campaign"]


def test_landing(spark, landed):
    days = R.read_raw(spark, landed).select("source_dt").distinct()
    assert days.count() == 30 and R.is_ready(spark, landed, "2025-01-01") and not R.is_ready(spark, landed, "2025-03-01")


@pytest.mark.parametrize("mode", ["tuned", "baseline"])
def test_clean_job(spark, landed, tmp_path, mode):
    changes = campaign_changes(spark, R.read_raw(spark, landed).select(F.col("campaign").try_cast("bigint").alias("campaign_id")).where("campaign_id is not null").distinct(), anchor="2025-01-01")
    known = R.reference_set(changes)
    out = f"file://{tmp_path}"
    a = clean_days(spark, landed, out, day=None, anchor_epoch=EPOCH, known=known, mode=mode, days=30)
    assert a.rows_in == ROWS + ROWS // 200 and a.rows_quarantined > 0 and a.duplicates_removed == ROWS // 200
    good = spark.read.parquet(f"{out}/impressions")
    assert good.count() == good.select("impression_id").distinct().count() == a.rows_out
    assert good.where("event_ts is null or campaign_id is null or cost is null").count() == 0
    assert good.where("conversion_id = -1 or click_pos = -1 or cpo = -1").count() == 0
    if mode == "tuned":
        assert a.files_out == 30
    day = good.where("dt = date'2025-01-05'").count()
    b = clean_days(spark, landed, out, day="2025-01-05", anchor_epoch=EPOCH, known=known, mode=mode)
    assert b.rows_out == day
    assert spark.read.parquet(f"{out}/impressions").count() == a.rows_out


def test_sizing():
    assert target_files(0) == 1 and target_files(128 * 2**20, 1.0) == 1 and target_files(129 * 2**20, 1.0) == 2
    assert shuffle_tasks(0, 8) == 8 and shuffle_tasks(2**30, 8) == 24


def test_input_bytes(spark, landed, tmp_path):
    assert R.input_bytes(spark, f"{landed}/impressions") > 0 and R.input_bytes(spark, f"file://{tmp_path}/none") == 0


def test_quarantine_keeps_duplicates(spark):
    good, bad = split(classify(typed(spark.createDataFrame(one_row(uid="x") * 2 + one_row(), R.RAW_SCHEMA), EPOCH)))
    assert bad.count() == 2 and good.count() == 1


def test_stage_and_changes(spark, tmp_path):
    (tmp_path / "c.csv").write_text("campaign_id,advertiser_id,campaign_vertical,budget_tier,bid_strategy,daily_budget_usd,changed_at,change_reason\n3,1000,Retail,LOW,Manual_CPC,50.00,2025-01-01T00:00:00Z,created\nx,,,,,,,\n")
    c = R.read_changes(spark, f"file://{tmp_path}/c.csv")
    assert [(r.campaign_id, r.budget_tier) for r in c.orderBy("campaign_id").collect()] == [(None, None), (3, "low")]
    assert R.reference_set(c).count() == 1
    spark.sql("select 1 as a, '7' as b, date'2025-01-01' as dt").write.partitionBy("dt").parquet(f"file://{tmp_path}/s")
    from pyspark.sql.types import StructType

    got = R.read_stage(spark, f"file://{tmp_path}/s", StructType.fromDDL("a long, b int, missing string"), "2025-01-01").first()
    assert (got.a, got.b, got.missing) == (1, 7, None) and got.raw_source_file
