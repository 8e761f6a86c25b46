from collections import Counter

import corpus_pipeline as P
from pyspark.sql import functions as F

from .test_near import brute
from .test_tokens import brute_pieces


def test_stages_follow_each_other(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, data)
        if k < 3:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "quality":
            model = P.fit_quality(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet").where(~P.held_out()))
            ids = sorted(before)
            kept = {i for i, s in zip(ids, model.score([before[i].encode() for i in ids]), strict=True) if s >= 0.5}
            assert {r.doc_id for r in docs.collect()} == kept and 0 < len(kept) < len(before)
        if name == "near_duplicates":
            kept = {int(d) for d, _, c in brute([(i, before[i]) for i in sorted(kept)]) if d == c}
            assert Counter(r.doc_id for r in docs.collect()) == Counter(kept)
        if name == "mixing":
            assert Counter(r.doc_id for r in docs.collect()) == Counter(kept)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in docs.collect()} == {i: brute_pieces(before[i]) for i in kept}


def test_run(spark, data):
    assert P.run(spark, data).count() > 0 and [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "mixing", "sentencepiece"]


def test_odd_documents(spark, documents, data):
    for name, stage in P.STAGES:
        out = stage(spark, documents, data)
        assert out.count() <= documents.count() and stage(spark, documents.where("false"), data).count() == 0
        if name != "sentencepiece":
            assert out.columns == documents.columns
    twins = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(2, "g h i"), (2, "a b c d e f"), (3, "g h i"), (4, ""), (4, " "), (1, "other text of one")], "doc_id long, text string").withColumn("near_id", F.lit("s"))
    kept = sorted((r.doc_id, r.text) for r in P.near_duplicate_stage(spark, twins, data).collect())
    assert kept == [(1, "a b c d e f"), (1, "other text of one"), (2, "g h i"), (4, ""), (4, " ")]
