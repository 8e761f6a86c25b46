import random
import re
from collections import defaultdict

import numpy as np
import pytest

from sparrowline.llm import setsketch as K
from sparrowline.llm import shingles as S
from sparrowline.llm.components import connected_components
from sparrowline.llm.queries import QUERIES


def brute_set(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, percent=80):
    sets = [brute_set(t) for _, t in rows]
    holders, shared, up = defaultdict(list), defaultdict(int), list(range(len(rows)))
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    for h in holders.values():
        for i, a in enumerate(h):
            for b in h[i + 1 :]:
                shared[a, b] += 1

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            up[root(a)] = root(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[root(k)] = min(d, least.get(root(k), d))
    return sorted((str(d), len(sets[k]), str(least.get(root(k)) if sets[k] else d)) for k, (d, _) in enumerate(rows))


def result(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def test_sets_are_those_of_words():
    r = random.Random(3)
    texts = [b"", b" ", b"a", b"a b c d", b"a b c d e", b" A  b\tc\nd\x0be f\x00 g", b"x" * 3_000_000 + b" y z w v u t", b"lo ng " * 600_000] + [b" ".join(r.choice([b"a", b"b", b"cc", b"D"]) for _ in range(r.randint(0, 40))) for _ in range(300)]
    for s, t in zip(S.shingle_sets(texts), texts, strict=True):
        assert len(s) == len(brute_set(t.decode()))
    assert S.fingerprint(np.array([1, 2], "u8")) == S.fingerprint(np.array([2, 1], "u8"))


@pytest.mark.parametrize("j", [0.3, 0.6, 0.85, 0.95])
def test_registers_estimate_and_merge(j):
    rng, est, eq = np.random.default_rng(int(j * 100)), [], []
    for _ in range(60):
        n = 300
        c = round(2 * n * j / (1 + j))
        x = S.mix(rng.integers(0, 1 << 63, 2 * n - c, dtype="u8"))
        a, b = K.registers(x[:n]), K.registers(x[n - c :])
        assert (K.merge(a, b) == K.registers(x)).all()
        one = np.array([float(n)])
        est.append(K.joint_estimate(np.array([(a > b).sum()]), np.array([(a < b).sum()]), one, one)[0])
        eq.append((a == b).mean())
    assert abs(np.mean(est) - j) < 0.02 and j - 0.02 < np.mean(eq) < j + 0.06


def test_op2_equals_brute_force(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    df = QUERIES["op2_setsketch"](spark, data)
    assert result(df) == brute(rows, 85)


def test_odd_documents(spark, documents):
    df = K.near_duplicates(documents)
    assert result(df) == brute([(r.doc_id, r.text) for r in documents.collect()])
    assert K.near_duplicates(documents.where("false")).count() == 0


def test_chains_and_crowds_equal_brute_force(spark):
    """Texts that drift apart word by word, and a crowd that shares a passage
    just below the threshold: links run across buckets' leaders."""
    r = random.Random(5)
    rows, words = [], [f"w{i}" for i in range(120)]
    for k in range(60):
        rows.append((k, " ".join(words)))
        words[r.randrange(120)] = f"n{k}"
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(100 + k, passage + " " + " ".join(f"q{k}_{i}" for i in range(r.randint(2, 14)))) for k in range(80)]
    rows += [(300 + k, "same text of copies here") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(K.near_duplicates(df)) == brute(rows)


def test_blocks_split_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 7)
    test_chains_and_crowds_equal_brute_force(spark)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_prefixes_of_linked_sets_meet():
    """The rarest shingles of any two sets that reach the threshold share
    one, whatever counts order them."""
    rng = np.random.default_rng(9)
    met = 0
    for _ in range(400):
        percent, n = int(rng.integers(50, 100)), int(rng.integers(1, 60))
        pool = rng.choice(10_000, 2 * n, replace=False).astype(np.int64)
        a, b = np.sort(pool[:n]), np.sort(pool[int(rng.integers(0, n // 4 + 1)) :][:n])
        known = np.sort(rng.choice(pool, n, replace=False))
        common = (known, rng.integers(1, 50, n))
        both = len(np.intersect1d(a, b))
        if 100 * both >= percent * (len(a) + len(b) - both):
            met += 1
            assert len(np.intersect1d(K.prefix(a, percent, common), K.prefix(b, percent, common)))
    assert met > 50


def test_a_large_bucket_just_below_the_threshold(spark, monkeypatch):
    """A crowd that shares most of a passage, nearly all pairs a little below
    the threshold and some above it: the groups are those of brute force."""
    r = random.Random(11)
    passage = [f"p{i}" for i in range(100)]
    rows = [(k, " ".join([*passage, *[f"q{k if r.random() < 0.97 else r.randrange(30)}_{i}" for i in range(r.randint(11, 16))]])) for k in range(400)]
    rows += [(1000 + k, " ".join([f"e{k}_{i}" if r.random() < 0.025 else w for i, w in enumerate(passage)])) for k in range(200)]
    want = brute(rows)
    sizes = [list(c for _, _, c in want).count(x) for x in {c for _, _, c in want}]
    assert sizes.count(1) > 50 and max(sizes) > 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(K, "BLOCK", 90)
    monkeypatch.setattr(K, "COMMON", 40)
    assert result(K.near_duplicates(df)) == want
