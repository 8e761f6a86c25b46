from collections import Counter

import pytest

from sparrowline.llm import pfair
from sparrowline.llm.queries import QUERIES


def check(rows, block_docs):
    """Slots hold their windows, positions are unique, and while every source
    lasts each prefix is less than a block from the weights."""
    assert len({r.mix_position for r in rows}) == len(rows)
    slots = {}
    for r in rows:
        assert r.mix_release <= r.mix_slot < r.mix_due and r.mix_position // block_docs == r.mix_slot
        assert slots.setdefault(r.mix_slot, r.source) == r.source
    assert sorted(slots) == list(range(len(slots)))
    share = {r.source: r.mix_share for r in rows}
    left, seen = Counter(slots.values()), Counter()
    for t in range(len(slots)):
        seen[slots[t]] += 1
        if min(left[s] - seen[s] for s in share) <= max(share.values()) * pfair.SLOTS:
            break
        assert all(abs(seen[s] - share[s] * (t + 1)) < 1 for s in share)
    return t


def test_op7(spark, data):
    rows = QUERIES["op7_pfair_mixing"](spark, data.replace("sf0.001", "sf0.01")).collect()
    assert len(rows) == 1000
    check(rows, pfair.BLOCK_DOCS)


@pytest.mark.parametrize("weights", [None, {"a": 5, "b": 3, "c": 1}, {"a": 1, "b": 1, "c": 1, "absent": 9}])
def test_prefixes_keep_to_the_weights(spark, weights, monkeypatch):
    monkeypatch.setattr(pfair, "SLOTS", 40)
    monkeypatch.setattr(pfair, "BUCKET_DOCS", 500)
    df = spark.range(4000).selectExpr("id as doc_id", "case when id % 2 = 0 then 'a' when id % 3 = 0 then 'b' else 'c' end as source")
    assert check(pfair.mix(df, weights, block_docs=4).collect(), 4) > 100


def test_odd_documents(spark, documents):
    out = pfair.mix(documents, {"a": 2.0})
    assert out.columns[: len(documents.columns)] == documents.columns
    rows = out.collect()
    assert Counter((r.doc_id, r.text, r.source) for r in rows) == Counter((r.doc_id, r.text, r.source) for r in documents.collect())
    assert len({r.mix_position for r in rows}) == len(rows)
    assert pfair.mix(documents.where("false")).count() == 0


def test_order_is_kept_in_files(spark, documents, tmp_path):
    df = spark.range(3000).selectExpr("id as doc_id", "id % 5 as source")
    want = [r.doc_id for r in pfair.mix(df).orderBy("mix_position").collect()]
    pfair.mix(df, tasks=3).select(*df.columns).write.parquet(f"{tmp_path}/o")
    got = [x for f in sorted((tmp_path / "o").glob("*.parquet")) for x in spark.read.parquet(f"file://{f}").toPandas()["doc_id"]]
    assert got == want


def test_main_path_is_native(spark, data):
    plan = QUERIES["op7_pfair_mixing"](spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_many_sources_share_lanes(spark, monkeypatch):
    """More sources than lanes: all rows are placed, large sources by their
    own weights, and the others' lanes by theirs."""
    monkeypatch.setattr(pfair, "MOST_LANES", 20)
    monkeypatch.setattr(pfair, "REST_LANES", 7)
    df = spark.range(6000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' when id % 3 = 1 then concat('m', id % 19) else concat('s', id) end as source")
    rows = pfair.mix(df, block_docs=4).collect()
    assert sorted(r.doc_id for r in rows) == list(range(6000)) and len({r.mix_position for r in rows}) == 6000
    assert all(r.mix_release <= r.mix_slot < r.mix_due for r in rows)
    hot = sorted(r.mix_slot for r in rows if r.source == "hot")
    share = next(r.mix_share for r in rows if r.source == "hot")
    assert all(abs(k // 4 + 1 - share * (t + 1)) < 1 for k, t in enumerate(hot[:40]) if k % 4 == 0)  # until the first lane runs out
    given = pfair.mix(df, {"s2": 1, "hot": 1}, block_docs=4).orderBy("mix_position").collect()
    assert {r.source for r in given[:5]} == {"s2", "hot"} and len(given) == 6000


def test_equal_rows_and_large_blocks(spark, monkeypatch):
    """Half of all rows equal one another: equal hashes never split, and each
    row still has a place of its own, in order."""
    monkeypatch.setattr(pfair, "MOST_BLOCKS", 50)
    monkeypatch.setattr(pfair, "BUCKET_DOCS", 100)
    df = spark.range(2000).selectExpr("case when id % 2 = 0 then 7 else id end as doc_id", "id % 3 as source")
    rows = pfair.mix(df, tasks=6).collect()
    assert len({r.mix_position for r in rows}) == 2000 == len(rows) and all(r.mix_release <= r.mix_slot < r.mix_due for r in rows)
    assert max(r.mix_slot for r in rows) < 53
    assert sorted((r.mix_rank, r.source) for r in rows) == sorted((k, s) for s in range(3) for k in range(667 if s < 2 else 666))


def test_rows_move_once(spark, data):
    """One exchange holds whole rows; the others hold sources and hashes."""
    p = pfair.mix(spark.read.parquet(f"{data}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert p.count("shufflepartitionidpassthrough") == 1 and "rangepartitioning" not in p
