from sparrowline.llm.queries import QUERIES


def test_op7_gives_whole_documents_in_order(spark, data):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = QUERIES["op7_pfair_mixing"](spark, data).collect()
    places = [r.mix_position for r in rows]
    assert places == sorted(places) and len(rows) == len(docs)
    assert all(r.text == docs[r.doc_id].text and r.source == docs[r.doc_id].source for r in rows)
