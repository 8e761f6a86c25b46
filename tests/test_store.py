import pytest
from pyspark.sql import functions as F

from sparrowline.streaming.pipeline import batch_metrics
from sparrowline.streaming.store import TABLES, KeyedStore, merge_sql


@pytest.fixture
def store(spark, tmp_path):
    return KeyedStore(spark, f"file://{tmp_path}")


def rows(spark, *r):
    return spark.createDataFrame(list(r), "k int, v string")


def values(store):
    return {r.k: r.v for r in store.read("t").collect()}


def test_insert_keeps_what_is_there(spark, store):
    assert store.upsert("t", rows(spark, (1, "a"), (2, "b"), (2, "b")), ("k",)) == 2
    assert store.upsert("t", rows(spark, (2, "z"), (3, "c")), ("k",)) == 1
    assert values(store) == {1: "a", 2: "b", 3: "c"}
    assert store.upsert("t", rows(spark, (2, "z"), (3, "c")), ("k",)) == 0


def test_update_overwrites(spark, store):
    store.upsert("t", rows(spark, (1, "a"), (2, "b")), ("k",))
    assert store.upsert("t", rows(spark, (2, "z"), (3, "c")), ("k",), update=True) == 1
    assert values(store) == {1: "a", 2: "z", 3: "c"}


def test_empty_and_other_columns(spark, store):
    assert store.upsert("t", rows(spark, (1, "a")).where("false"), ("k",)) == 0
    store.upsert("t", rows(spark, (1, "a")), ("k",))
    store.upsert("t", spark.createDataFrame([(2, 9)], "k int, other int"), ("k",))
    assert values(store) == {1: "a", 2: None}


def test_declared_tables_fit(spark, store):
    q = spark.createDataFrame([(7, "2025-01-01 00:00:00", 3)], "campaign_id long, window_start string, impressions long").withColumn("window_start", F.col("window_start").cast("timestamp"))
    assert store.upsert("campaign_minute_metrics", q, update=True) == 1
    assert store.read("campaign_minute_metrics").columns == [c.split()[0] for c in TABLES["campaign_minute_metrics"][1].split(", ")]


def test_merge_text():
    assert merge_sql("t", "s", ["a", "b"], ["a"], True) == "MERGE INTO t t USING s s ON t.a = s.a WHEN MATCHED THEN UPDATE SET t.b = s.b WHEN NOT MATCHED THEN INSERT (a, b) VALUES (s.a, s.b)"
    assert "MATCHED THEN UPDATE" not in merge_sql("t", "s", ["a", "b"], ["a"], False)


def test_metrics_of_an_empty_batch(spark):
    m = batch_metrics(spark.createDataFrame([], "impression_id string, reject_reason string, event_ts timestamp, timestamp timestamp"), "raw", 3).first()
    assert m.rows_in == 0 and m.dlq_rate == 0.0 and m.latency_p95_s is None and m.min_event_ts is None


BY_TEN = {"keys": ("k",), "bucket": "cast(k div 10 as string)"}


def parts(store, table="t"):
    return {b: list(p) for b, p in store.latest(table).buckets.items()}


def test_only_touched_buckets_are_written(spark, store):
    store.upsert("t", rows(spark, *[(k, "a") for k in range(30)]), **BY_TEN)
    before = parts(store)
    assert store.upsert("t", rows(spark, (3, "b"), (31, "b")), update=True, **BY_TEN) == 1
    after = parts(store)
    assert set(after) == {"0", "1", "2", "3"} and after["1"] == before["1"] and after["2"] == before["2"] and after["0"] != before["0"]
    assert values(store)[3] == "b" and store.read("t", ["3"]).count() == 1


def test_a_crash_before_the_pointer_changes_nothing(spark, store, monkeypatch):
    store.upsert("t", rows(spark, (1, "a"), (2, "b")), **BY_TEN)
    with monkeypatch.context() as m:
        m.setattr(KeyedStore, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.upsert("t", rows(spark, (2, "z"), (3, "c")), update=True, **BY_TEN)
    assert values(store) == {1: "a", 2: "b"} and store.versions("t") == [1]
    # a passing file of a writer that died is no version
    path, fs = store._fs(f"{store.root}/t/log/.next-dead")
    fs.create(path).close()
    assert store.upsert("t", rows(spark, (2, "z"), (3, "c")), update=True, **BY_TEN) == 1
    assert values(store) == {1: "a", 2: "z", 3: "c"} and store.versions("t") == [1, 2]


def test_a_second_writer_is_noticed(spark, store):
    with pytest.raises(OSError, match="another writer"), store.change() as c:
        c.upsert("t", rows(spark, (1, "a")), **BY_TEN)
        store.upsert("t", rows(spark, (2, "b")), **BY_TEN)
    assert values(store) == {2: "b"}


def test_a_failed_change_rolls_back_all_tables(spark, store):
    with pytest.raises(ZeroDivisionError), store.change() as c:
        c.upsert("t", rows(spark, (1, "a")), **BY_TEN)
        c.upsert("u", rows(spark, (1, "a")), **BY_TEN)
        1 / 0  # noqa: B018
    assert store.read("t") is None and store.read("u") is None and store._names(f"{store.root}/t/data") == []


def test_parts_merge_and_old_versions_go(spark, store, monkeypatch):
    from sparrowline.streaming import store as module

    monkeypatch.setattr(module, "MERGE_AT", 3)
    monkeypatch.setattr(module, "KEEP_VERSIONS", 4)
    for k in range(9):
        assert store.upsert("t", rows(spark, (k, str(k)), (0, "again")), **BY_TEN) == 1
    assert values(store)[8] == "8" and len(values(store)) == 9 and store.versions("t")[-1] == 9
    (held,) = parts(store).values()
    assert [p[0] for p in held] == ["2"]
    store.vacuum("t", 1)
    assert sorted(store._names(f"{store.root}/t/data")) == sorted(held) and store.versions("t") == [9]


def test_truncate_and_load(spark, store):
    assert store.replace("t", rows(spark, (1, "a"), (1, "a"))) == 2
    assert store.replace("t", spark.createDataFrame([(5,)], "other int")) == 1
    assert store.read("t").columns == ["other"] and store.replace("t", spark.createDataFrame([], "other int")) == 0


def test_odd_buckets(spark, store):
    put = {"keys": ("k",), "bucket": "v"}
    odd = [(1, None), (2, ""), (3, "a/b=c %"), (4, "été")]
    assert store.upsert("t", rows(spark, *odd), **put) == 4 and store.upsert("t", rows(spark, *odd), **put) == 0
    assert sorted(values(store).items()) == odd
