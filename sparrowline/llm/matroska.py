"""Media columns in Matroska: a muxer for 8-bit PCM and a packet parser.

The parser reads variable-length EBML elements (sizes may be unknown for
segments and clusters), tracks, clusters, simple blocks and block groups with
Xiph, EBML and fixed-size lacing, and cues, into tables of packets: track,
timestamp, flags, and the byte range of each frame in the stored file. No
frame is copied until its bytes are asked for.

`encode_media` makes a media column out of bytes, `packet_table` explodes a
media column into packets, `media_features` reads stored files back. Defined
results: a null text is empty; a payload has at least one 64-byte unit; a file
that is no Matroska raises `ValueError` naming the byte; an empty table gives
an empty result; each repeated row is a row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BIN, LONG, STR, schema, shared_dir, small_batches, utf8

# Fixed values of the format (RFC 8794, RFC 9559): element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE = 0x2AD7B1, 0x4489, 0xAE, 0xD7, 0x73C5, 0x83
FLAG_LACING, DEFAULT_DURATION, CODEC_ID, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0x9C, 0x23E383, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

UNIT = 64
RATE, FRAME, LACED, CLUSTER_BLOCKS = 8000, 1024, 8, 30
FRAME_MS = FRAME * 1000 // RATE


def padded(data: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of UNIT."""
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


# --- writing ---------------------------------------------------------------


def _size(n: int) -> bytes:
    """A length in as few bytes as hold it (all ones are reserved)."""
    w = 1
    while n >= (1 << 7 * w) - 1:
        w += 1
    return (n | 1 << 7 * w).to_bytes(w, "big")


def _element(i: int, body: bytes) -> bytes:
    return i.to_bytes((i.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(i: int, v: int) -> bytes:
    return _element(i, v.to_bytes(max(1, (v.bit_length() + 7) // 8), "big"))


_HEADER = _element(EBML, b"".join([_uint(0x4286, 1), _uint(0x42F7, 1), _uint(0x42F2, 4), _uint(0x42F3, 8), _element(0x4282, b"matroska"), _uint(0x4287, 4), _uint(0x4285, 2)]))
_AUDIO = _element(AUDIO, _element(SAMPLING, struct.pack(">f", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
_TRACKS = _element(TRACKS, _element(TRACK_ENTRY, b"".join([
    _uint(TRACK_NUMBER, 1), _uint(TRACK_UID, 1), _uint(TRACK_TYPE, 2), _uint(FLAG_LACING, 1), _uint(DEFAULT_DURATION, FRAME_MS * 1_000_000),
    _element(CODEC_ID, b"A_PCM/INT/LIT"), _AUDIO,
])))


def _signed_size(d: int) -> bytes:
    """A difference of EBML lacing: a length minus the middle of its range."""
    w = 1
    while not -(1 << 7 * w - 1) < d < (1 << 7 * w - 1):
        w += 1
    return (d + (1 << 7 * w - 1) - 1 | 1 << 7 * w).to_bytes(w, "big")


def _block(track: int, offset_ms: int, frames: list[bytes]) -> bytes:
    """A simple block: one frame bare, equal frames by fixed-size lacing,
    others by EBML lacing."""
    sizes = [len(f) for f in frames]
    lacing, heads = 0, b""
    if len(frames) > 1:
        heads = bytes([len(frames) - 1])
        if len(set(sizes)) == 1:
            lacing = 2
        else:
            lacing = 3
            heads += _size(sizes[0]) + b"".join(_signed_size(b - a) for a, b in zip(sizes[:-2], sizes[1:-1], strict=True))
    return _element(SIMPLE_BLOCK, _size(track) + struct.pack(">hB", offset_ms, 0x80 | lacing << 1) + heads + b"".join(frames))


def mux(payload: bytes) -> bytes:
    """A Matroska file of one 8-bit mono PCM track that holds `payload`."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    blocks = [frames[i : i + LACED] for i in range(0, len(frames), LACED)]
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)))
    body, at, cues = [info, _TRACKS], len(info) + len(_TRACKS), []
    for i in range(0, len(blocks), CLUSTER_BLOCKS):
        ms = i * LACED * FRAME_MS
        own = [_block(1, k * LACED * FRAME_MS, b) for k, b in enumerate(blocks[i : i + CLUSTER_BLOCKS])]
        cluster = _element(CLUSTER, _uint(TIMESTAMP, ms) + b"".join(own))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, ms) + _element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    return _HEADER + _element(SEGMENT, b"".join(body) + _element(CUES, b"".join(cues)))


# --- reading ---------------------------------------------------------------


@dataclass
class Track:
    number: int = 0
    kind: int = 0
    codec: str = ""
    frame_ns: int = 0
    rate: float = 8000.0
    channels: int = 1
    bits: int = 0


@dataclass
class Media:
    scale: int = 1_000_000
    duration: float | None = None
    tracks: dict[int, Track] = field(default_factory=dict)
    clusters: list[tuple[int, int]] = field(default_factory=list)
    """(timestamp, position in the segment)"""
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    """(timestamp, track, position of the cluster in the segment)"""
    packets: list[tuple[int, int, bool, int, int]] = field(default_factory=list)
    """(track, timestamp in ns, keyframe, offset, size)"""


def _vint(b: bytes, at: int, keep: bool) -> tuple[int, int, bool]:
    """A variable-length integer: value, position after it, all ones."""
    if at >= len(b) or not b[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    w = 9 - b[at].bit_length()
    if at + w > len(b):
        raise ValueError(f"the integer at byte {at} is cut off")
    v, top = int.from_bytes(b[at : at + w], "big"), 1 << 7 * w
    return (v if keep else v ^ top), at + w, v == 2 * top - 1


_OPEN_END = {SEGMENT: {EBML, SEGMENT}, CLUSTER: {EBML, SEGMENT, CLUSTER, CUES, TRACKS, INFO, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469}}


def children(b: bytes, at: int, end: int, ends: set[int] = frozenset()) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the elements in a range. One of unknown size ends
    before the first element that can't be in it."""
    while at < end:
        i, body, _ = _vint(b, at, True)
        if i in ends:
            return
        n, body, unknown = _vint(b, body, False)
        if unknown:
            if i not in _OPEN_END:
                raise ValueError(f"element {i:#x} at byte {at} has no size")
            last = body
            for _, _, last in children(b, body, end, _OPEN_END[i]):
                pass
            yield i, body, last
            at = last
        else:
            if body + n > end:
                raise ValueError(f"element {i:#x} at byte {at} ends after its parent")
            yield i, body, body + n
            at = body + n


def _int(b: bytes, a: int, e: int) -> int:
    return int.from_bytes(b[a:e], "big")


def _real(b: bytes, a: int, e: int) -> float:
    return {0: 0.0, 4: struct.unpack(">f", b[a:e])[0] if e - a == 4 else 0.0}.get(e - a) if e - a < 8 else struct.unpack(">d", b[a:e])[0]


def laced(b: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(offset, size) of the frames in a block's body."""
    if not lacing:
        return [(at, end - at)]
    n, at = b[at] + 1, at + 1
    if lacing == 2:
        if (end - at) % n:
            raise ValueError(f"fixed lacing of {n} frames can't share {end - at} bytes")
        sizes = [(end - at) // n] * n
    else:
        sizes = []
        for k in range(n - 1):
            if lacing == 1:
                s = 0
                while True:
                    s, at = s + b[at], at + 1
                    if b[at - 1] < 255:
                        break
            else:
                before = at
                s, at, _ = _vint(b, at, False)
                if k:
                    s = sizes[-1] + s - ((1 << 7 * (at - before) - 1) - 1)
            sizes.append(s)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"the laces before byte {end} are longer than their block")
    out = []
    for s in sizes:
        out.append((at, s))
        at += s
    return out


def parse(b: bytes) -> Media:
    """The tables of a stored file."""
    m = Media()
    top = [x for x in children(b, 0, len(b))]
    if not top or top[0][0] != EBML:
        raise ValueError("no EBML header at byte 0")
    for i, a, e in top:
        if i == SEGMENT:
            for child in children(b, a, e):
                _segment_child(b, m, a, *child)
    return m


def _segment_child(b: bytes, m: Media, base: int, i: int, a: int, e: int) -> None:
    if i == INFO:
        for j, x, y in children(b, a, e):
            if j == TIMESTAMP_SCALE:
                m.scale = _int(b, x, y)
            elif j == DURATION:
                m.duration = _real(b, x, y)
    elif i == TRACKS:
        for j, x, y in children(b, a, e):
            if j == TRACK_ENTRY:
                t = _track(b, x, y)
                m.tracks[t.number] = t
    elif i == CLUSTER:
        _cluster(b, m, base, a, e)
    elif i == CUES:
        for j, x, y in children(b, a, e):
            if j == CUE_POINT:
                point = list(children(b, x, y))
                time = next((_int(b, p, q) for k, p, q in point if k == CUE_TIME), 0)
                for k, p, q in point:
                    if k == CUE_POSITIONS:
                        own = {c: _int(b, r, s) for c, r, s in children(b, p, q) if s - r <= 8}
                        m.cues.append((time, own.get(CUE_TRACK, 0), own.get(CUE_CLUSTER, 0)))


def _track(b: bytes, a: int, e: int) -> Track:
    t = Track()
    for j, x, y in children(b, a, e):
        if j == TRACK_NUMBER:
            t.number = _int(b, x, y)
        elif j == TRACK_TYPE:
            t.kind = _int(b, x, y)
        elif j == CODEC_ID:
            t.codec = b[x:y].decode("ascii", "replace")
        elif j == DEFAULT_DURATION:
            t.frame_ns = _int(b, x, y)
        elif j == AUDIO:
            for k, p, q in children(b, x, y):
                if k == SAMPLING:
                    t.rate = _real(b, p, q)
                elif k == CHANNELS:
                    t.channels = _int(b, p, q)
                elif k == BIT_DEPTH:
                    t.bits = _int(b, p, q)
    return t


def _cluster(b: bytes, m: Media, base: int, a: int, e: int) -> None:
    head = a - 4
    while head > base and b[head : head + 4] != b"\x1f\x43\xb6\x75":
        head -= 1
    now = 0
    for j, x, y in children(b, a, e):
        if j == TIMESTAMP:
            now = _int(b, x, y)
            m.clusters.append((now, head - base))
        elif j == SIMPLE_BLOCK:
            _frames(b, m, now, x, y, bool(b[_vint(b, x, False)[1] + 2] & 0x80), None)
        elif j == BLOCK_GROUP:
            parts = {k: (p, q) for k, p, q in children(b, x, y)}
            if BLOCK in parts:
                span = _int(b, *parts[BLOCK_DURATION]) if BLOCK_DURATION in parts else None
                _frames(b, m, now, *parts[BLOCK], REFERENCE not in parts, span)


def _frames(b: bytes, m: Media, now: int, a: int, e: int, key: bool, span: int | None) -> None:
    track, at, _ = _vint(b, a, False)
    offset, flags = struct.unpack_from(">hB", b, at)
    frames = laced(b, at + 3, e, flags >> 1 & 3)
    t = m.tracks.get(track)
    step = span * m.scale // len(frames) if span is not None else t.frame_ns if t else 0
    for k, (x, n) in enumerate(frames):
        m.packets.append((track, (now + offset) * m.scale + k * step, key, x, n))


def frames_of(b: bytes, m: Media, track: int) -> bytes:
    return b"".join([b[x : x + n] for t, _, _, x, n in m.packets if t == track])


def seek(m: Media, track: int, ms: int) -> int | None:
    """The position of the cluster to start at for a time, from the cues."""
    return max((c for c in m.cues if c[1] == track and c[0] * m.scale <= ms * 1_000_000), default=(0, 0, None))[2]


# --- columns ---------------------------------------------------------------


def encode_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's padded UTF-8 bytes as a Matroska file."""
    small_batches(docs.sparkSession)
    out = schema(**{id_col: docs.schema[id_col].dataType, "n_bytes": LONG, "media": BIN})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array([mux(padded(x)) for x in data], pa.binary())], names=out.names)

    return docs.select(F.col(id_col), utf8(text_col).alias("data")).mapInArrow(run, out)


def store(media: DataFrame) -> DataFrame:
    """Write the media table to the shared folder; its frame, read from there."""
    spark, path = media.sparkSession, shared_dir(media.sparkSession, "media")
    media.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(media.schema).parquet(path)


def packet_table(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each packet: id, track, seq, pts_ns, keyframe, offset, size."""
    small_batches(media.sparkSession)
    kind = media.schema[id_col].dataType
    out = schema(**{id_col: kind, "track": LONG, "seq": LONG, "pts_ns": LONG}).add("keyframe", "boolean").add("offset", LONG).add("size", LONG)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, which = [], []
            for k, x in enumerate(b.column(1).to_pylist()):
                if x is not None:
                    p = parse(x).packets
                    rows += [(t, s, *rest) for s, (t, *rest) in enumerate(p)]
                    which += [k] * len(p)
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=out.names)

    return media.select(F.col(id_col), F.col(media_col).alias("media")).mapInArrow(run, out)


def feature_of(m: Media, samples: bytes) -> str:
    """Counts of the tables, and integer statistics of the 8-bit samples."""
    s = np.frombuffer(samples, np.uint8)
    high = s >= 128
    t = m.tracks[min(m.tracks)]
    last = max((p[1] for p in m.packets), default=0) // 1_000_000
    return f"codec={t.codec};rate={t.rate:g};bits={t.bits};clusters={len(m.clusters)};cues={len(m.cues)};packets={len(m.packets)};last_ms={last};sum={int(s.sum(dtype=np.int64))};squares={int((s.astype(np.uint32) ** 2).sum(dtype=np.int64))};crossings={int((high[1:] != high[:-1]).sum())}"


def media_features(media: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """A row for each stored file, from its bytes: sizes and digests of the
    payload in track 1 and of the file, and `feature`."""
    small_batches(media.sparkSession)
    out = schema(**{id_col: media.schema[id_col].dataType, "n_bytes": LONG, "payload_bytes": LONG, "payload_sha256": STR, "tail_crc32": LONG, "media_bytes": LONG, "media_sha256": STR, "feature": STR})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for x in b.column(2).to_pylist():
                m = parse(x)
                p = frames_of(x, m, 1)
                for c, v in zip(cols, (len(p), sha(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(x), sha(x).hexdigest(), feature_of(m, p)), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=out.names)

    return media.select(id_col, "n_bytes", "media").mapInArrow(run, out)
