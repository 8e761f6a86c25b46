from collections import Counter

import pytest

from sparrowline.llm import pfair


def drift(blocks, weights, shares=None):
    """The farthest that a source gets from its weight while all last."""
    shares = shares or [w / sum(weights) for w in weights]
    seen, worst = [0] * len(blocks), 0.0
    for t, (k, i, release, due) in enumerate(pfair.schedule(blocks, weights)):
        assert i == seen[k] and release <= t < due
        seen[k] += 1
        if seen[k] == blocks[k]:
            break
        worst = max(worst, *(abs(n - s * (t + 1)) for n, s in zip(seen, shares, strict=True)))
    return t, worst


def test_no_drift_over_many_periods():
    """20 sources, one with a third of 3,000,000 documents."""
    docs = [1_000_000] + [105_263] * 19
    w = [n**0.5 for n in docs]
    t, worst = drift([n // 16 for n in docs], pfair.exact(w), [x / sum(w) for x in w])
    assert t > 100_000 and worst < 1


def test_small_weights_are_not_lifted():
    t, worst = drift([40_000, 30, 30_000], pfair.exact([0.6, 0.0003, 0.3997]), [0.6, 0.0003, 0.3997])
    assert t > 60_000 and worst < 1


def test_all_blocks_once_to_the_end():
    blocks = [7, 0, 300, 41, 1]
    rows = list(pfair.schedule(blocks, [5, 2, 3, 3, 1]))
    assert Counter((k, i) for k, i, _, _ in rows) == Counter((k, i) for k, n in enumerate(blocks) for i in range(n))
    assert all(release <= t < due for t, (_, _, release, due) in enumerate(rows))


@pytest.mark.parametrize("weights", [{"a": 0.61803, "b": 0.0007, "c": 0.38127}, {"a": 1.0, "b": 2.5}])
def test_mix_keeps_to_the_weights_asked_for(spark, weights, monkeypatch):
    monkeypatch.setattr(pfair, "BUCKET_DOCS", 500)
    monkeypatch.setattr(pfair, "WRITE_ROWS", 2)
    df = spark.range(12_000).selectExpr("id as doc_id", "case when id % 50 = 0 then 'b' when id % 3 = 0 then 'c' else 'a' end as source")
    rows = sorted(pfair.mix(df, weights, block_docs=1).collect(), key=lambda r: r.mix_position)
    assert [r.mix_slot for r in rows] == list(range(12_000)) and len({r.doc_id for r in rows}) == 12_000
    total, left, seen = sum(weights.values()), Counter(r.source for r in rows), Counter()
    for t, r in enumerate(rows):
        seen[r.source] += 1
        assert r.mix_release <= t < r.mix_due and abs(r.mix_share - weights.get(r.source, 0) / total) < 1e-12
        assert all(abs(seen[s] - weights.get(s, 0) / total * (t + 1)) < 1 for s in left)
        if any(seen[s] == left[s] for s in weights):
            break
    assert t > 200
