"""Sets of hashed word shingles, computed for many documents at once.

Words are runs of bytes other than ASCII white space, with A-Z lower-cased. A
word's hash is a polynomial over its bytes, taken as a difference of prefix
sums, so numpy sees a whole stretch of text at a time; a shingle's hash mixes
those of its words in order. 64 bits: two different shingles of a pair of
documents agree with a chance of about n^2 / 2^64.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed together; a longer word stretches it.
STRETCH = 1 << 20

_u = np.uint64
_rng = np.random.default_rng(20240607)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=_u) * _u(2) + _u(1)
_BASE = int(_rng.integers(1 << 61, 1 << 63)) * 2 + 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=_u) * _u(2) + _u(1)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 9, 10, 11, 12, 13]] = True
_white = re.compile(rb"[\x20\x09-\x0D]").search
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = (x ^ (x >> _u(33))) * _u(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _u(33))) * _u(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _u(33))


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    if base not in _powers or len(_powers[base]) < n:
        p = np.full(max(n, STRETCH + 4096), base, _u)
        p[0] = 1
        _powers[base] = np.multiply.accumulate(p)
    return _powers[base][:n]


def _stretches(data: bytes) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(data):
        end = at + STRETCH
        end = len(data) if end >= len(data) else m.start() if (m := _white(data, end)) else len(data)
        yield at, end
        at = end


def words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and byte positions of the words in lower-cased text."""
    hashes, places = [], []
    for a, e in _stretches(data):
        b = np.frombuffer(data, np.uint8, e - a, a)
        white = _WHITE[b]
        edge = np.diff(white, prepend=True, append=True)
        ends = np.flatnonzero(edge)
        starts, ends = ends[::2], ends[1::2]
        if not len(starts):
            continue
        sums = np.zeros(len(b) + 1, _u)
        np.cumsum(_VALUE[b] * _power(_BASE, len(b)), out=sums[1:])
        hashes.append(mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(b))[starts] ^ (ends - starts).astype(_u)))
        places.append(starts + a)
    if not hashes:
        return np.empty(0, _u), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def shingle_sets(texts: list[bytes], k: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text. A text of fewer than
    `k` words has one shingle of them all; one without words has none."""
    at = 0
    while at < len(texts):
        end, n = at, 0
        while end < len(texts) and (end == at or n + len(texts[end]) <= STRETCH):
            n += len(texts[end]) + 1
            end += 1
        group = texts[at:end]
        h, place = words(b" ".join(group).lower())
        edges = np.cumsum([0, *(len(t) + 1 for t in group)])
        of = np.searchsorted(place, edges).tolist()
        if len(h) >= k:
            s = np.zeros(len(h) - k + 1, _u)
            for i in range(k):
                s += h[i : len(h) - k + 1 + i] * _PLACE[i]
            s = mix(s)
        for a, e in zip(of[:-1], of[1:], strict=True):
            if e - a >= k:
                yield np.unique(s[a : e - k + 1])
            elif e > a:
                yield mix(np.array([(h[a:e] * _PLACE[k : k + e - a]).sum(dtype=_u)], _u))
            else:
                yield np.empty(0, _u)
        at = end


def fingerprint(s: np.ndarray) -> bytes:
    """128 bits of a set, the same in any order."""
    a = int(mix(s + _u(0x9E3779B97F4A7C15)).sum(dtype=_u))
    b = int(mix(s ^ _u(0xD1B54A32D192ED03)).sum(dtype=_u))
    return a.to_bytes(8, "big") + b.to_bytes(8, "big")
