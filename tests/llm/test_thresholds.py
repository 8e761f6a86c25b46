import random

import pytest

from sparrowline.llm import setsketch as K

from .test_near import brute, result


def test_bands_fit_the_threshold():
    assert K.banding(85) == (34, 6) and K.banding(80) == (40, 5)
    for percent in range(30, 100):
        bands, size = K.banding(percent)
        assert bands * size <= K.REGISTERS and (1 - (percent / 100) ** size) ** bands <= K.MISS


@pytest.mark.parametrize("percent", [50, 80])
def test_pairs_at_the_threshold_equal_brute_force(spark, percent):
    """60 pairs whose similarity is the threshold or a little more."""
    r, rows = random.Random(percent), []
    for k in range(60):
        n = 200
        own = int(n * (1 - percent / 100) / (1 + percent / 100)) - r.randint(0, 3)
        shared = [f"s{k}_{i}" for i in range(n)]
        rows += [(2 * k, " ".join(shared)), (2 * k + 1, " ".join(shared[: n - own] + [f"o{k}_{i}" for i in range(own)]))]
    want = brute(rows, percent)
    assert len({c for _, _, c in want}) < 120
    assert result(K.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent)) == want
