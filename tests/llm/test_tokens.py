import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparrowline.llm import bitpack, spm, wordids
from sparrowline.llm.queries import QUERIES
from sparrowline.llm.tokencount import count_tokens

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
LETTERS = list("ab the,.\n\t\x0b\x0c\x1c\x85\xa0 ▁éßÀÿ÷×µªº日本😀́ \x01'sS'LLÉİſ09²½") + ["<|endoftext|>", "<s>", "</s>", "<|", "'ll"]
texts = st.lists(st.sampled_from(LETTERS), max_size=20).map("".join)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_chunks_encode_and_decode_as_the_library(text):
    sp = spm.model(PIECES)
    t = spm.worker_table(PIECES, spm.both)
    d = spm.chunks(text)
    known = t.take([d])
    ids, out = ",".join(known[c][0] for c in d), "".join(known[c][1] for c in d)[1:]
    t.release()
    assert ids == ",".join(map(str, sp.encode(text))) and out == sp.decode(sp.encode(text))


@settings(max_examples=300, deadline=None)
@given(texts)
def test_words_encode_as_the_library(text):
    e = wordids.encoder(WORDS)
    assert e.by_word
    assert np.frombuffer(e.encode([text.encode()])[0], "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_take_whole_texts():
    e = wordids.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not e.by_word
    assert np.frombuffer(e.encode([b"a  b"])[0], "<u4").tolist() == e.tokenizer.encode("a  b", add_special_tokens=False).ids


def brute_pieces(text):
    sp = spm.model(PIECES)
    ids = sp.encode(text)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_op9_equals_the_library(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op9_sentencepiece"](spark, data).collect()}
    assert got == {k: brute_pieces(v) for k, v in docs.items()}


def test_odd_documents_encode(spark, documents):
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in spm.encode_decode(documents, PIECES).collect())
    assert got == sorted((str(r.doc_id), *brute_pieces(r.text or "")) for r in documents.collect())
    full = spm.encode_decode(documents.where("doc_id = 12"), PIECES, keep_output=True).first()
    assert full.ids == spm.model(PIECES).encode(documents.where("doc_id = 12").first().text)
    assert spm.encode_decode(documents.where("false"), PIECES).count() == 0


def test_op8_equals_the_library(spark, data):
    sp = spm.model(PIECES)
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op8_token_counts"](spark, data).collect()}
    assert got == {r.doc_id: (len(r.text.encode()), n := len(sp.encode(r.text)), n > 4096) for r in docs}


@pytest.mark.parametrize("tier", [0, 5])
def test_tiers_change_no_count(spark, documents, tier):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(documents, PIECES, limit=10, tier_rows=tier, task_rows=3).collect())
    sp = spm.model(PIECES)
    assert got == sorted((str(r.doc_id), len((t := r.text or "").encode()), n := len(sp.encode(t)), n > 10) for r in documents.collect())
    assert count_tokens(documents.where("false"), PIECES).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 31, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 9001).astype("u4")
    packed = bitpack.pack(ids, bits)
    assert len(packed) == -(-9001 * bits // 8) and (bitpack.unpack(packed, 9001, bits) == ids).all()


def test_packing_refuses_wide_ids():
    assert bitpack.width(49408) == 16 and bitpack.width(1) == 1 and bitpack.width(65537) == 17
    with pytest.raises(ValueError):
        bitpack.pack(np.array([4], "u4"), 2)


@pytest.mark.parametrize("bits", [13, 16])
def test_random_access(tmp_path, bits):
    r = random.Random(1)
    docs = [np.array([r.randrange(1 << bits) for _ in range(r.choice([0, 1, 50, 9000, 20000]))], "<u4") for _ in range(12)]
    with open(tmp_path / "f", "wb") as f:
        w = bitpack.Writer(f, bits)
        for k, d in enumerate(docs):
            w.add(k, d.tobytes())
            w.ids(d.tobytes())
        w.close()
    fs, base = bitpack.open_fs(str(tmp_path))
    with fs.open_input_file(f"{base}/f") as f:
        got = bitpack.Reader(f)
        for k in r.sample(range(12), 12):
            assert (got.document(k) == docs[k]).all()
        assert (got.read(100, 9000) == np.concatenate(docs)[100:9100]).all()


def brute_ids(rows):
    e, at, out = wordids.encoder(WORDS), 0, []
    for d, t in rows:
        ids = [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_op3_equals_the_library(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()
    got = sorted(tuple(r) for r in QUERIES["op3_bit_packing"](spark, data).collect())
    assert got == brute_ids([(r.doc_id, r.text) for r in docs])


def test_odd_documents_pack(spark, documents):
    rows = sorted(((r.doc_id, r.text or "") for r in documents.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    got = sorted((tuple(r) for r in bitpack.token_files(documents, WORDS).collect()), key=lambda r: r[1])
    assert got == brute_ids(rows)
    assert bitpack.token_files(documents.where("false"), WORDS).count() == 0
