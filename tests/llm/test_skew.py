"""Many long texts, and one source and one group of copies that hold a third
of all rows, over many partitions."""

from collections import Counter

import corpus_pipeline as P
import pyarrow as pa
import pytest

from sparrowline.llm import common
from sparrowline.llm.matroska import encode_media, media_features, store
from sparrowline.llm.setsketch import near_duplicates

from .test_near import brute, result


def test_batches_are_bound_by_bytes(spark):
    common.small_batches(spark)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    rows = spark.range(0, 60, 1, 1).selectExpr("repeat('x', 1000000) as t").mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in rows) == 60 and max(r.size for r in rows) < common.BATCH_BYTES + 2_000_000 and len(rows) >= 4


def test_many_long_texts(spark):
    df = spark.range(0, 24, 1, 2).selectExpr("id as doc_id", "concat(repeat(concat('w', id % 12, ' x y z v '), 60000), id % 12) as text")
    got = {r.doc_id: r for r in media_features(store(encode_media(df))).collect()}
    assert len(got) == 24 and all(r.n_bytes > 500_000 for r in got.values())
    assert all(got[k].payload_sha256 == got[k + 12].payload_sha256 for k in range(12))
    assert Counter(r.component_id for r in near_duplicates(df).collect()) == Counter({k: 2 for k in range(12)})


@pytest.fixture
def skewed(spark):
    text = "case when id % 3 = 0 then 'one text that very many documents hold word for word' when id % 50 = 1 then '' else concat_ws(' ', transform(sequence(1, 20 + id % 7), x -> concat('w', id div 2, '_', x))) end"
    return spark.range(300).selectExpr("id as doc_id", f"{text} as text", "'en' as lang", "if(id % 3 = 1, 'hot', concat('s', id % 11)) as source", "20L as n_chars").repartition(200)


def test_stages_under_skew(spark, skewed, data):
    rows = [(r.doc_id, r.text) for r in skewed.collect()]
    assert result(near_duplicates(skewed)) == brute(rows)
    kept = P.near_duplicate_stage(spark, skewed, data)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(int(d) for d, _, c in brute(rows) if d == c)
    mixed = P.mixing_stage(spark, skewed, data)
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(d for d, _ in rows) and mixed.columns == skewed.columns
