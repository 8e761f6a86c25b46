import zlib

import numpy as np

from sparrowline.llm import quality
from sparrowline.llm.queries import QUERIES


def test_op6_on_held_out_labels(spark, data):
    sf = data.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op6_quality"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc > 0.95 and np.mean([(s >= 0.5) == y for s, y in held]) > 0.93


def test_votes_equal_brute_force():
    texts = [f"w{k % 7} w{k % 5} the of {'### ' * (k % 3)}".encode() for k in range(60)] + [b"a a a a a a", b"x " * 5000]
    y = [int(k % 3 == 0) for k in range(60)] + [0, 0]
    m = quality.fit_model(texts, y)
    ask = [*texts[:9], b"", b" \n", b"unseen words here", b"z" * 3_000_000]
    got = m.score(ask)
    for t, s in zip(ask, got, strict=True):
        v = m.embed(quality.counts([t]))[0]
        if not v.any():
            assert s == m.labels.mean()
            continue
        cos = m.vectors @ v
        near = np.sort(np.maximum(cos, 0))[::-1][quality.voters(len(texts)) - 1]
        above = cos > near + 1e-5
        low, high = [(np.maximum(cos, 0) * pick).sum() for pick in (above * (np.array(y) == 1), (cos >= near - 1e-5) * 1)]
        assert low / high - 1e-4 <= s <= 1
    assert (quality.fit_model([], []).score([b"a", b""]) == 0.5).all()


def test_scores_do_not_depend_on_company():
    texts = [b"one two three", b"", b"four " * 400_000, b"five ### six"]
    m = quality.fit_model([b"one two", b"five ### ###", b"three four"], [1, 0, 1])
    alone = [m.score([t])[0] for t in texts]
    assert np.allclose(m.score(texts), alone, atol=1e-6)


def test_odd_documents(spark, documents):
    labels = spark.createDataFrame([(0, 1, 0), (5, 0, 0), (6, 0, None), (6, 1, 0), (9, None, 1), (None, 1, 1), (8, 7, 0), (10, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score_documents(documents, labels).collect()
    assert len(rows) == documents.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert {r.score for r in quality.score_documents(documents, labels.where("false")).collect()} == {0.5}
    assert quality.score_documents(documents.where("false"), labels).count() == 0


def test_latent_space_alone_tells_the_classes_apart():
    """Held-out labels of a larger table, with the model as op6 fits it."""
    import duckdb

    sf = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"select doc_id, text, quality from '{sf}/documents.parquet' join '{sf}/labels.parquet' using (doc_id) where quality in (0, 1) order by md5(doc_id::varchar)").fetchall()
    kept = [zlib.crc32(str(r[0]).encode()) % 3 == 1 for r in rows]
    m = quality.fit_model([r[1].encode() for r, h in zip(rows, kept, strict=True) if not h], [r[2] for r, h in zip(rows, kept, strict=True) if not h])
    y = np.array([r[2] for r, h in zip(rows, kept, strict=True) if h])
    s = m.score([r[1].encode() for r, h in zip(rows, kept, strict=True) if h])
    auc = (np.sign(s[y == 1][:, None] - s[y == 0]) / 2 + 0.5).mean()
    assert len(y) > 1000 and auc > 0.997 and ((s >= 0.5) == y).mean() > 0.99


def test_fit_on_executors_equals_a_local_one(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    rows = sorted(quality.labelled_sample(docs, labels).selectExpr("label", "xxhash64(id) as place", "text").collect(), key=lambda r: (r.label, r.place))
    local = quality.fit_model([bytes(r.text) for r in rows], [r.label for r in rows])
    texts = [bytes(r.text) for r in rows[::7]]
    assert np.allclose(quality.fit_quality(docs, labels).score(texts), local.score(texts), atol=1e-4)
    twice = docs.unionByName(docs.where("doc_id % 2 = 0"))
    assert quality.labelled_sample(twice, labels.unionByName(labels)).count() == len(rows)


def test_a_small_class_can_win_the_vote():
    good = [f"plain words in a line of text number {k} and some more of them".encode() for k in range(42)]
    bad = [f"{'spam ' * (20 + k)}".encode() for k in range(10)]
    m = quality.fit_model(good + bad, [1] * 42 + [0] * 10)
    assert quality.voters(52) == 7 and quality.voters(3000) == quality.NEIGHBOURS and quality.voters(0) == 1
    assert m.score([b"spam " * 33])[0] < 0.5 <= m.score([good[3]])[0]
