"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are hashed and counted over the whole text: its words, its
words' endings (the last three bytes, letters folded to classes), and how far
back each word last occurred (the binary logarithm of the distance in words; a
term of its own for a first occurrence). The first two are weighted by
log(1 + count) and inverse document frequency, the recurrence terms are square
roots of shares, and a text's vector is both, scaled to length one. A truncated
SVD of the labelled sample gives the latent space; every document's unit vector
is multiplied, in blocks, with all labelled vectors, and its nearest vote with
their cosines as weights: as many as the square root of the sample's size, at
most `NEIGHBOURS`, so a small class can still be a majority.

The fit uses at most `PER_CLASS` labelled rows of each class, chosen by a hash
of their ids: a documented bound, so the broadcast is bounded too (2 * 1500
vectors of `RANK` floats, and a projection of `WIDTH` by `RANK`: 1.4 MB). It
runs in one task over the sample's sparse counts (at most `WIDTH` cells a row);
neither texts nor counts come to the driver, only the model.
Labels, languages, sources and ids are no inputs of a score.

Defined results: null and empty texts, and texts without words, score the
share of label 1 in the sample; without labelled rows every score is 0.5; each
repeated row is scored; a labelled document that occurs more than once counts
once, with its least text; labels other than 0 and 1 are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BIN, LONG, schema, small_batches, utf8
from .shingles import STRETCH, mix, words

PER_CLASS, RANK, NEIGHBOURS = 1500, 32, 25
WORDS, ENDINGS, GAPS = 6144, 2048, 32
TERMS = WORDS + ENDINGS
WIDTH = TERMS + GAPS
#: Weight of the recurrence terms against all others together.
GAP_WEIGHT = 0.7
#: Documents whose counts are held at once.
BLOCK = 128

_u = np.uint64
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[ord("a") : ord("z") + 1] = ord("a")
_FOLD[ord("0") : ord("9") + 1] = ord("0")
_FOLD[128:] = 128


def _ends(data: bytes, at: np.ndarray) -> np.ndarray:
    """Hashes of the last three bytes of each word, by class of byte."""
    b = np.frombuffer(data + b" ", np.uint8)
    white = np.isin(b, np.array([0x20, 9, 10, 11, 12, 13], np.uint8))
    stop = np.flatnonzero(white[1:] & ~white[:-1]) + 1
    h = np.zeros(len(at), _u)
    for k in (1, 2, 3):
        inside = stop - k >= at
        h = h * _u(257) + np.where(inside, _FOLD[b[np.maximum(stop - k, 0)]] + _u(1), _u(0))
    return mix(h)


def _gaps(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each word the bits of the distance to its last occurrence in the
    same text; 0 for a first one."""
    key = mix(h + of.astype(_u) * _u(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order][1:] == key[order][:-1])
    out = np.zeros(len(h), np.int64)
    out[order[again + 1]] = np.frexp(order[again + 1] - order[again])[1]
    return np.minimum(out, GAPS - 1)


def counts(texts: list[bytes]) -> np.ndarray:
    """Hashed counts: a row for each text (float32)."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    at = 0
    while at < len(texts):
        end, n = at, 0
        while end < len(texts) and end - at < BLOCK and (end == at or n + len(texts[end]) <= STRETCH):
            n += len(texts[end]) + 1
            end += 1
        data = b" ".join(texts[at:end]).lower()
        h, place = words(data)
        of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts[at:end]]), place, side="right")
        for part, first, size in ((h, 0, WORDS), (_ends(data, place), WORDS, ENDINGS), (_gaps(h, of).astype(_u), TERMS, GAPS)):
            cell = of * size + (part % _u(size)).astype(np.int64)
            out[at:end, first : first + size] = np.bincount(cell, minlength=(end - at) * size).reshape(-1, size)
        at = end
    return out


def voters(rows: int) -> int:
    """The neighbours that vote in a sample of so many rows."""
    return min(NEIGHBOURS, max(1, round(rows**0.5)))


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 1e-12)


def _weighted(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.empty_like(c)
    x[:, :TERMS] = _unit(np.log1p(c[:, :TERMS]) * idf)
    said = np.maximum(c[:, TERMS:].sum(axis=1, keepdims=True), 1)
    x[:, TERMS:] = np.sqrt(c[:, TERMS:] / said) * np.float32(GAP_WEIGHT)
    return _unit(x)


@dataclass
class Model:
    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def embed(self, c: np.ndarray) -> np.ndarray:
        return _unit(_weighted(c, self.idf) @ self.projection)

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), float(self.labels.mean()) if len(self.labels) else 0.5)
        if not len(self.labels):
            return out
        k = voters(len(self.labels))
        for a in range(0, len(texts), BLOCK):
            v = self.embed(counts(texts[a : a + BLOCK]))
            cos = v @ self.vectors.T
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(cos, near, axis=1), 0).astype(np.float64)
            total, known = w.sum(axis=1), v.any(axis=1)
            ok = known & (total > 0)
            out[a : a + BLOCK][ok] = ((w * self.labels[near]).sum(axis=1)[ok] / total[ok]).clip(0, 1)
        return out


    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, idf=self.idf, projection=self.projection, vectors=self.vectors, labels=self.labels)
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Model:
        return Model(**np.load(io.BytesIO(data)))


def fit_model(texts: list[bytes], labels: list[int], seed: int = 0) -> Model:
    """The model of a sample of texts."""
    return fit_counts(counts(texts), labels, seed)


def fit_counts(x: np.ndarray, labels: list[int], seed: int = 0) -> Model:
    """The latent space of the sample, by a randomised SVD with a fixed seed."""
    if not len(x):
        return Model(np.zeros(TERMS, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    idf = np.log((1 + len(x)) / (1 + (x[:, :TERMS] > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    for a in range(0, len(x), BLOCK):
        x[a : a + BLOCK] = _weighted(x[a : a + BLOCK], idf)
    q = np.random.default_rng(seed).standard_normal((WIDTH, RANK + 16)).astype(np.float32)
    for _ in range(3):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    projection = np.ascontiguousarray((q @ vt.T)[:, :RANK], dtype=np.float32)
    return Model(idf, projection, _unit(x @ projection), np.asarray(labels, np.float64))


def labelled_sample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> DataFrame:
    """(id, label, text): at most `per_class` documents of each label, those
    of the least hashed ids. The chosen ids are few, so the documents are only
    filtered by them; repeats of one are folded where they are read."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("long").alias("label")).distinct()
    chosen = [known.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    return docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")).join(ids, "id").groupBy("id", "label").agg(F.min("text").alias("text"))


def fit_quality(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """The model, fitted in one task over the sample's counts."""
    small_batches(docs.sparkSession)
    cells = schema(label=LONG, place=LONG, cells=BIN, counts=BIN)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, BLOCK):
                part = b.slice(a, BLOCK)
                rows = counts(part.column(2).to_pylist())
                at = [np.flatnonzero(r).astype(np.uint16) for r in rows]
                some = [pa.array([x.tobytes() for x in at], pa.binary()), pa.array([r[x].tobytes() for r, x in zip(rows, at, strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *some], names=cells.names)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[:2])
        x = np.zeros((len(got), WIDTH), np.float32)
        for k, (_, _, at, n) in enumerate(got):
            x[k, np.frombuffer(at, np.uint16)] = np.frombuffer(n, np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([fit_counts(x, [r[0] for r in got]).to_bytes()], pa.binary())], names=["model"])

    sample = labelled_sample(docs, labels, **options).select("label", F.xxhash64("id").alias("place"), "text")
    row = sample.mapInArrow(count, cells).repartition(1).mapInArrow(fit, schema(model=BIN)).first()
    return Model.from_bytes(bytes(row["model"])) if row else fit_model([], [])


def quality_score(docs: DataFrame, model: Model, text_col: str = "text") -> F.Column:
    """A column with the score of each row's text."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for b in batches:
            yield pd.Series(m.score([bytes(x) for x in b]))

    return score(utf8(text_col))


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether a document's label is kept from the fit."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit_quality(docs, labels.where(~held_out(id_col)), id_col=id_col, text_col=text_col)
    out = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), quality_score(docs, model, text_col).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
