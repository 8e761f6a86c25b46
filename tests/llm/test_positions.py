import corpus_pipeline as P
from pyspark.sql import functions as F

from sparrowline.llm.pfair import mix


def test_the_schedule_survives_the_reread(spark, data, tmp_path):
    """Files of uneven sizes are packed by size, so rows come back in another
    order; the result still says each row's place."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.repeat("text", 20)).otherwise(F.col("text")))
    want = {r.doc_id: r.mix_position for r in mix(docs).collect()}
    P.mixing_stage(spark, docs, data).repartitionByRange(8, "n_chars").write.parquet(f"{tmp_path}/m")
    again = spark.read.parquet(f"{tmp_path}/m")
    order = [r.doc_id for r in again.select("doc_id").collect()]
    assert order != sorted(want, key=want.get)
    got = P.sentencepiece_stage(spark, again, data).collect()
    assert {r.doc_id: r.mix_position for r in got} == want and len(got) == len(want)


def test_repeated_rows_have_places_of_their_own(spark, documents, data):
    rows = P.sentencepiece_stage(spark, documents, data).collect()
    want = sorted((str(r.doc_id), r.mix_position) for r in mix(documents).collect())
    assert sorted((str(r.doc_id), r.mix_position) for r in rows) == want
