import hashlib
import os
import random
import zlib

import pytest

from sparrowline.llm import matroska as M
from sparrowline.llm.queries import QUERIES

SIZES = [0, 1, 63, 64, 65, 1023, 1024, 1025, 8192, 8193, 100_000, 600_000]


@pytest.mark.parametrize("n", SIZES)
def test_round_trip_and_cues(n):
    p = M.padded(os.urandom(n))
    assert len(p) % 64 == 0 and len(p) >= max(n, 64)
    b = M.mux(p)
    m = M.parse(b)
    assert M.frames_of(b, m, 1) == p
    assert [c[1] for c in m.clusters] == [c[2] for c in m.cues]
    assert [x[1] for x in m.packets] == [k * M.FRAME_MS * 1_000_000 for k in range(len(m.packets))]
    assert M.seek(m, 1, 10**9) == m.cues[-1][2] and M.seek(m, 2, 0) is None


def test_all_lacings():
    frames = [b"a" * 300, b"b" * 255, b"c" * 10]
    xiph = bytes([2, 255, 45, 255, 0]) + b"".join(frames)
    assert [xiph[x : x + n] for x, n in M.laced(xiph, 0, len(xiph), 1)] == frames
    ebml = bytes([2]) + M._size(300) + M._signed_size(-45) + b"".join(frames)
    assert [ebml[x : x + n] for x, n in M.laced(ebml, 0, len(ebml), 3)] == frames
    fixed = bytes([1]) + b"xxyy"
    assert M.laced(fixed, 0, 5, 2) == [(1, 2), (3, 2)]
    assert M.laced(b"zz", 0, 2, 0) == [(0, 2)]


def test_unknown_sizes_and_block_groups():
    group = M._element(M.BLOCK_GROUP, M._element(M.BLOCK, b"\x81\x00\x05\x00data") + M._uint(M.BLOCK_DURATION, 7) + M._element(M.REFERENCE, b"\x01"))
    clusters = b"".join(b"\x1f\x43\xb6\x75\xff" + M._uint(M.TIMESTAMP, t) + group for t in (10, 20))
    m = M.parse(M._HEADER + b"\x18\x53\x80\x67\x01\xff\xff\xff\xff\xff\xff\xff" + M._TRACKS + clusters)
    assert [(t, pts // 1_000_000, key) for t, pts, key, _, _ in m.packets] == [(1, 15, False), (1, 25, False)] and len(m.clusters) == 2


@pytest.mark.parametrize("bad", [b"", b"\x00", b"RIFF", M._HEADER + b"\x18\x53\x80\x67\x84\x00", M.mux(b"x" * 64)[:-3]])
def test_broken_files_are_named(bad):
    with pytest.raises(ValueError):
        M.parse(bad)


def want(text):
    raw = (text or "").encode()
    p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
    return len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])


def test_op1(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = QUERIES["op1_matroska"](spark, data).collect()
    assert {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows} == {k: want(v) for k, v in docs.items()}
    by_text = {}
    for r in rows:
        assert by_text.setdefault(docs[r.doc_id], (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
        assert r.media_bytes > r.payload_bytes


def test_odd_documents(spark, documents):
    media = M.store(M.encode_media(documents))
    got = sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in M.media_features(media).collect())
    assert got == sorted((str(r.doc_id), *want(r.text)) for r in documents.collect())
    packets = M.packet_table(media).where("doc_id = 4").orderBy("seq").collect()
    assert sum(p["size"] for p in packets) == 50_048 and packets[1].pts_ns == 128_000_000 and all(p.keyframe for p in packets)
    assert M.media_features(M.encode_media(documents.where("false"))).count() == 0


def test_random_bytes_never_loop():
    r = random.Random(3)
    good = M.mux(M.padded(os.urandom(5000)))
    for _ in range(200):
        b = bytearray(good)
        for _ in range(3):
            b[r.randrange(200)] = r.randrange(256)
        try:
            M.parse(bytes(b))
        except (ValueError, IndexError, KeyError):
            pass
