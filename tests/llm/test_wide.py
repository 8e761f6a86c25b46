import math
import random

import numpy as np
import pytest

from sparrowline.llm import bitslice


@pytest.mark.parametrize("size", [70_000.0, 3e7, 1e12])
def test_large_components_are_exact(spark, monkeypatch, size):
    monkeypatch.setattr(bitslice, "ROWS", 40)
    r = random.Random(7)
    rows = [(k, [r.uniform(-size, size) if k % 3 else r.uniform(-1, 1) * 1e-3 for _ in range(4)]) for k in range(1, 120)] + [(0, [0.5, -0.25, 0.001, 0.125]), (200, [1e-3, 0.0, -1e-3, 2e-3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    live = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    want = []
    for q, v in live:
        if q in (0, 200):
            s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in live if i != q)[:10]
            want += [(q, k, i, -x) for k, (x, i) in enumerate(s, 1)]
    got = bitslice.top_k(df, queries=df.where("vec_id in (0, 200)"))
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)


def test_sums_beyond_64_bits_are_ranked_exactly():
    rng = np.random.default_rng(3)
    v, q = rng.integers(-(2**60), 2**60, (200, 5)), rng.integers(-(2**60), 2**60, 5)
    want = sorted(((sum(int(a) * int(b) for a, b in zip(x, q, strict=True)), k) for k, x in enumerate(v)), key=lambda x: (-x[0], x[1]))
    assert bitslice.Index(np.arange(200), v).top(q, None, 10) == want[:10]


def test_what_has_no_64_bit_value_raises(spark):
    for x in (1e17, 1e13):
        with pytest.raises(Exception, match="2\\^62|64-bit"):
            bitslice.top_k(spark.createDataFrame([(0, [x]), (1, [x])], "vec_id long, embedding array<double>")).collect()
