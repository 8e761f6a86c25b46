import math

import numpy as np
import pytest

from sparrowline.llm import bitslice
from sparrowline.llm.queries import ORACLES, QUERIES

from ..oracle import same


@pytest.mark.parametrize("n, d, low, high", [(1, 3, -5, 5), (70, 64, -1024, 1024), (1000, 5, 0, 1), (3000, 16, -(2**26), 2**26), (500, 4, 7, 7), (2000, 64, -3, 4), (40, 0, 0, 1)])
def test_index_is_exact(n, d, low, high):
    rng = np.random.default_rng(n)
    v = rng.integers(low, high + 1, (n, d))
    ids = rng.permutation(n * 3)[:n]
    ix = bitslice.Index(ids, v)
    for _ in range(15):
        r = rng.integers(n)
        s = v @ v[r]
        want = [(int(s[i]), int(ids[i])) for i in np.lexsort((ids, -s)) if ids[i] != ids[r]][:10]
        assert ix.top(v[r], int(ids[r]), 10) == want


def test_op5_equals_its_sql(spark, data):
    same(spark, QUERIES["op5_bit_sliced_top_k"], ORACLES["op5_bit_sliced_top_k"], data)


def test_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(bitslice, "ROWS", 9)
    monkeypatch.setattr(bitslice, "LEAST_ROWS", 5)
    nan, inf = math.nan, math.inf
    rows = [(100 * k, [k / 3, -k / 7, 0.5]) for k in range(4)] + [(k, [(k % 5) / 5, (k % 3) / 3, -0.25]) for k in range(1, 40)] + [(50, None), (51, [1.0, None, 2.0]), (52, [nan, 1.0, 1.0]), (53, [inf, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (500, [nan, 0.0, 0.0]), (54, [9.0]), (55, []), (7, [0.4, 0.1, -0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "'x' as id", "2 as rank", "3 as block")
    live = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in live:
        if q % 100 == 0:
            s = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in live if i != q))[:10]
            want += [(q, k, i, -x) for k, (x, i) in enumerate(s, 1)]
    assert sorted(tuple(r) for r in bitslice.top_k(df).collect()) == sorted(want)
    assert bitslice.top_k(df.where("false")).count() == 0
    assert bitslice.top_k(df.where("vec_id = 100")).count() == 0


def test_repeated_ids_are_the_querys_own(spark):
    rows = [(100, [1.0, 0.0])] * 2 + [(7, [2.0, 0.0])] * 3 + [(8, [1.0, 1.0])]
    got = sorted(tuple(r) for r in bitslice.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    one = [(100, 1, 7, 2 << 20), (100, 2, 7, 2 << 20), (100, 3, 7, 2 << 20), (100, 4, 8, 1 << 20)]
    assert got == sorted(one * 2)


def test_an_id_and_a_vector_that_hold_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(bitslice, "LEAST_ROWS", 100)
    rows = [(3, [0.5, 0.25])] * 500 + [(k, [0.5, 0.25]) for k in range(1000, 1500)] + [(100 * k, [k / 10, 0.5]) for k in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in bitslice.top_k(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    # queries 0, 100 to 400 and the copies at 1000, 1100 to 1400
    assert set(got) == {0, 100, 200, 300, 400, *range(1000, 1500, 100)} and all([k for k, _ in sorted(v)] == list(range(1, 11)) for v in got.values())
    assert [i for _, i in sorted(got[0])][:5] == [100, 200, 300, 400, 3]
