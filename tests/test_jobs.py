"""The daily run, projects, waiting, reports, and what streams do when they fail."""

import json

import pytest
from pyspark.sql import functions as F

from sparrowline.operators import report
from sparrowline.plans.daily import Run, attempt, run_day
from sparrowline.plans.project import Project
from sparrowline.session import scratch, settings
from sparrowline.sources import raw as R
from sparrowline.sources.synthetic import campaign_changes, land, raw_impressions
from sparrowline.streaming import pipeline
from sparrowline.streaming.contract import IMPRESSION_EVENT
from sparrowline.streaming.store import KeyedStore

EPOCH = 1_735_689_600


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('jobs')}"
    land(raw_impressions(spark, 6000, malformed=500), root, anchor_epoch=EPOCH)
    ids = R.read_raw(spark, root).select(F.col("campaign").try_cast("bigint").alias("campaign_id")).where("campaign_id is not null").distinct()
    campaign_changes(spark, ids, anchor="2025-01-01").write.option("header", True).csv(f"{root}/campaign_changes")
    return root


def test_generated_rows_follow_from_the_seed(spark):
    key = F.xxhash64(*R.RAW_COLUMNS)
    a = raw_impressions(spark, 3000).agg(F.sum(key.cast("decimal(38,0)"))).first()[0]
    assert a == raw_impressions(spark, 3000).repartition(7).agg(F.sum(key.cast("decimal(38,0)"))).first()[0]
    assert a != raw_impressions(spark, 3000, seed=8).agg(F.sum(key.cast("decimal(38,0)"))).first()[0]
    paths = raw_impressions(spark, 3000, duplicates=10_000).where("conversion = '1'").groupBy("conversion_id").agg(F.count("*").alias("n"), F.count_distinct("uid").alias("u"), F.sum(F.col("attribution").cast("int")).alias("a"))
    assert paths.count() > 10 and paths.where("n <> 4 or u <> 1 or a > 1").count() == 0


def test_run_of_a_day(spark, landed, tmp_path):
    told = []
    run = run_day(spark, landed, f"file://{tmp_path}", "2025-01-07", anchor_epoch=EPOCH, first="2025-01-01", end="2025-01-31", send=told.append)
    assert [s["step"] for s in run.steps] == ["wait", "clean", "changes", "freshness", "build", "test"] and not told
    assert run.results["freshness"] == "pass" and all(o in ("pass", "warn") for o, _ in run.results["test"].values())
    assert json.loads(run.to_json())["day"] == "2025-01-07" and run.to_markdown().count("\n") == 7
    clean = run.results["clean"]
    assert spark.table("fct_impressions").count() == clean.rows_out == spark.table("mart_campaign_daily").agg(F.sum("impressions")).first()[0]
    again = run_day(spark, landed, f"file://{tmp_path}", "2025-01-07", anchor_epoch=EPOCH, first="2025-01-01", end="2025-01-31")
    assert again.results["clean"] == clean
    with pytest.raises(TimeoutError):
        run_day(spark, landed, f"file://{tmp_path}", "2025-05-01", anchor_epoch=EPOCH, first="2025-01-01", end="2025-01-31", timeout=0, send=told.append)
    assert len(told) == 1 and "wait of 2025-05-01" in told[0]


def test_steps_are_tried_again():
    run, slept, calls = Run("d"), [], []

    def step():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("not yet")
        return "done"

    assert attempt(run, "s", step, tries=3, pause=2, sleep=slept.append, send=None) == "done" and slept == [2, 4]
    assert run.steps[0]["tries"] == 3 and run.results == {"s": "done"}


def test_waiting_holds_to_its_limit(spark, tmp_path):
    now = [0.0]
    with pytest.raises(TimeoutError):
        R.wait_until_ready(spark, f"file://{tmp_path}", "2025-01-01", timeout=700, every=300, sleep=lambda s: now.__setitem__(0, now[0] + s), clock=lambda: now[0])
    assert now[0] == 700


def test_project_order_and_kinds(spark, tmp_path):
    p = Project(spark, f"file://{tmp_path}")
    p.source("numbers", lambda: spark.range(10))
    p.model("evens", "numbers", kind="ephemeral")(lambda ref: ref("numbers").where("id % 2 = 0"))
    p.model("squares", "evens", kind="table", cluster=["sq"])(lambda ref: ref("evens").selectExpr("id * id as sq"))
    p.model("total", "squares")(lambda ref: ref("squares").agg(F.sum("sq").alias("s")))
    assert p.order("total") == ["evens", "squares", "total"]
    assert p.build()["total"].first().s == 120 and spark.table("total").first().s == 120 and spark.read.parquet(f"file://{tmp_path}/squares").count() == 5
    with pytest.raises(ValueError, match="already"):
        p.model("evens")
    with pytest.raises(ValueError, match="none of"):
        p.model("x", kind="cube")
    p.model("odd", "numbers")(lambda ref: ref("squares"))
    with pytest.raises(KeyError, match="didn't declare"):
        p.build("odd")
    p.model("lost", "nowhere")(lambda ref: ref("nowhere"))
    with pytest.raises(KeyError, match="neither"):
        p.order("lost")
    p.model("a", "b")(lambda ref: ref("b"))
    p.model("b", "a")(lambda ref: ref("a"))
    with pytest.raises(ValueError, match="circle"):
        p.order("a")


def test_reports_and_alerts():
    assert report.to_markdown([{"a": 1234, "b": 0.5}, {"a": None, "b": "x|y"}]) == "| a | b |\n| - | - |\n| 1,234 | 0.50 |\n|  | x\\|y |"
    assert report.to_json({"b": 1, "a": None}) == '{"a": null, "b": 1}' and report.to_markdown([]).startswith("|")
    assert report.alert("t", {"k": 1}) and not report.alert("t", {}, lambda text: 1 / 0)


def test_kafka_options():
    assert R.kafka_options("s:9092", "t")["failOnDataLoss"] == "true" and R.kafka_options("s", "t", starting="latest", most_per_trigger=5)["maxOffsetsPerTrigger"] == "5"
    sink = R.kafka_sink_options("s:9092", "t")
    assert sink["kafka.enable.idempotence"] == "true" and sink["kafka.acks"] == "all" and sink["kafka.compression.type"] == "zstd"


def test_settings_are_put_back(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    with settings(spark, {"spark.sql.adaptive.enabled": "false", "spark.sql.broadcastTimeout": "77"}):
        assert spark.conf.get("spark.sql.adaptive.enabled") == "false"
    assert spark.conf.get("spark.sql.adaptive.enabled") == before and spark.conf.get("spark.sql.broadcastTimeout") != "77"


def rates(spark, **more):
    return spark.readStream.format("rate").options(rowsPerSecond=1, **more).load()


def test_a_failing_query_is_raised_while_the_other_runs(spark, tmp_path):
    def fail(batch, batch_id):
        raise RuntimeError("planted")

    good = pipeline.start("good", rates(spark), lambda b, i: None, f"file://{tmp_path}/a", 1)
    bad = pipeline.start("bad", rates(spark), fail, f"file://{tmp_path}/b", 1)
    try:
        with pytest.raises(Exception, match="planted"):
            pipeline.watch(spark, [good, bad])
        assert good.isActive
    finally:
        good.stop()
        bad.stop()


def test_one_stopped_query_ends_a_continuous_run(spark, tmp_path):
    a, b = (pipeline.start(n, rates(spark), lambda x, i: None, f"file://{tmp_path}/{n}", 1) for n in "ab")
    a.stop()
    pipeline.watch(spark, [a, b], all_of_them=False)
    assert b.isActive
    b.stop()


def test_progress_outlives_its_recorder(spark, data):
    """Rows that one recorder wrote and never flushed are the next one's."""
    store = KeyedStore(spark, scratch(spark, "progress"))
    path, fs = store._fs(f"{store.root}/progress/q-0.json")
    out = fs.create(path)
    out.write(bytearray(json.dumps({"query_id": "q", "batch_id": 0, "query_name": "raw", "num_input_rows": 5, "watermark": None}).encode()))
    out.close()
    assert pipeline.ProgressRecorder(store).flush() == 1 and pipeline.ProgressRecorder(store).flush() == 0
    assert store.read("stream_query_progress").first().num_input_rows == 5


def test_offsets_by_partition(spark):
    rows = spark.range(500).selectExpr("cast(cast(id % 9 as string) as binary) as key", "cast('v' as binary) as value", "'t' as topic", "timestamp_seconds(1700000000 + id * 97) as timestamp", "id")
    got = R.kafka_shaped(rows, ["timestamp", "id"], headers={"a": "b"}).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.id):
        by.setdefault(r.partition, []).append(r.offset)
        assert r.headers[0].key == "a" and bytes(r.headers[0].value) == b"b"
    assert all(v == list(range(len(v))) for v in by.values()) and set(by) <= set(range(6))
    assert IMPRESSION_EVENT.topic


def test_timings_are_medians_and_outlive_a_run(tmp_path):
    from sparrowline.harness import Timings

    clock, calls = iter([0, 5, 10, 11, 20, 23]), []
    t = Timings(str(tmp_path / "t.json"))
    assert t.measure("a", lambda: calls.append(1), repeats=3, clock=lambda: next(clock)) == 3 and len(calls) == 4
    again = Timings(str(tmp_path / "t.json"))
    assert again.measure("a", lambda: 1 / 0) == 3
    again.seconds["b"] = 6
    assert again.ratio("a", "b") == 2
