"""Exact top-k search over a bit-sliced index.

Components become integers. Rows are dealt into blocks; a block's index holds,
for each attribute, a bitmap for each of its highest `SLICES` bits (the value
shifted to be positive), and the integers themselves. For a query the slices
are added up with its integers as weights, by bitmap arithmetic alone: full
adders on whole bitmaps, three bits of one place into a sum and a carry, until
each place has one bitmap left. The k-th highest quantised score is found from
the most significant slice downward; a bit-sliced comparison then selects all
rows that the dropped low bits could still lift to it, and those boundary rows
are scored exactly. So the result is exact whatever the data.

Index rows move once, each to its block's task, and stay there; the queries, a
hundredth of the rows, are sent to every block in the same exchange and stream
through its index, which is built once. Only k rows of a query and a block go
on. Neither side is ever broadcast.

Defined results: vectors that are null, have a null id or hold null, NaN or
infinite components take no part; shorter vectors count as padded with zeros;
integers are never held: sums that may leave 64 bits are taken in wide ones,
and a component of 2^62 or more after scaling, or a score among the best of a
block that has no 64-bit value, raises an error; an id names a vector, so rows
that repeat the query's id are its own and no candidates, other repeated rows
are candidates each (those equal in id and vector share a block); a repeated
query is answered for each of its rows; ties go to the smaller id.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LONG, cut, schema, small_batches

SLICES = 8
#: Rows of an index block: as many, or fewer where blocks would be less than the
#: session's shuffle partitions, but not below the second number.
ROWS, LEAST_ROWS = 65_536, 8_192
#: Components must be less than this after scaling.
LIMIT = 1 << 62


def to_integers(vectors: DataFrame, *, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): the rows that take part, with components floor(scale * x)."""
    x = F.col(vector_col)
    whole = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    wide = F.raise_error(F.lit("a component is 2^62 or more after scaling")).cast("long")
    ints = F.transform(x, lambda e: F.when(F.abs(e.cast("double") * scale) < float(LIMIT), F.floor(e.cast("double") * scale)).otherwise(wide))
    return vectors.where(x.isNotNull() & F.col(id_col).isNotNull() & whole).select(F.col(id_col).cast("long").alias("id"), ints.alias("v"))


def matrix(column: pa.ListArray) -> np.ndarray:
    """A column of lists as rows of a matrix, shorter ones padded with zeros."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(size.max(initial=0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def stacked(parts: list[np.ndarray]) -> np.ndarray:
    """Matrices one below another, padded to the widest."""
    width = max((p.shape[1] for p in parts), default=0)
    return np.concatenate([np.zeros((0, width), np.int64), *[np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts]])


class Index:
    """The bit-sliced index of one block of rows."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        n, d = values.shape
        self.low = self.values.min(axis=0) if n else np.zeros(d, np.int64)
        span = int((self.values.max(axis=0) - self.low).max()) if n and d else 0
        self.most = max((abs(int(x)) for x in (self.values.min(), self.values.max())), default=0) if self.values.size else 0
        self.shift = max(0, span.bit_length() - SLICES)
        self.bits = max(1, min(SLICES, span.bit_length()))
        self.words = -(-n // 64)
        high = ((self.values - self.low) >> self.shift).astype(np.uint8)
        self.slices = np.zeros((d, self.bits, self.words), np.uint64)
        for b in range(self.bits if d else 0):
            packed = np.packbits((high >> b & 1).T, axis=1, bitorder="little")
            self.slices[:, b].view(np.uint8).reshape(d, -1)[:, : packed.shape[1]] = packed
        self.all = np.zeros(self.words, np.uint64)
        self.all.view(np.uint8)[: -(-n // 8)] = np.packbits(np.ones(n, np.uint8), bitorder="little")

    def sums(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices, lowest first, of the sum over attributes of |weight| times
        the quantised value, or its complement where the weight is negative."""
        places: dict[int, list[np.ndarray]] = {}
        size = np.abs(weights)
        for t in range(int(size.max(initial=0)).bit_length()):
            at = np.flatnonzero(size >> t & 1)
            if not len(at):
                continue
            for b in range(self.bits):
                s = self.slices[at, b]
                minus = weights[at] < 0
                s[minus] = ~s[minus]
                places.setdefault(b + t, []).append(s)
        out, p = [], 0
        while places:
            x = np.concatenate(places.pop(p, [np.zeros((1, self.words), np.uint64)]))
            while len(x) > 2:
                m = len(x) // 3
                a, b, c = x[:m], x[m : 2 * m], x[2 * m : 3 * m]
                half = a ^ b
                places.setdefault(p + 1, []).append(a & b | half & c)
                x = np.concatenate([half ^ c, x[3 * m :]])
            if len(x) == 2:
                places.setdefault(p + 1, []).append(x[:1] & x[1:])
                x = x[:1] ^ x[1:]
            out.append(x[0])
            p += 1
        return out

    def top(self, q: np.ndarray, own: int | None, k: int) -> list[tuple[int, int]]:
        """The best (score, id), all that may be among the first k."""
        width = max(len(q), self.values.shape[1])
        if width > self.values.shape[1]:
            q = q[: self.values.shape[1]]
        elif len(q) < width:
            q = np.pad(q, (0, width - len(q)))
        live = self.all.copy()
        if own is not None:
            a, e = np.searchsorted(self.ids, [own, own + 1])
            for r in range(int(a), int(e)):
                live[r // 64] &= ~np.uint64(1 << r % 64)
        slices = self.sums(q)
        sure, even, kth = np.zeros_like(live), live.copy(), 0
        count = lambda x: int(np.bitwise_count(x).sum())
        if count(live) > k:
            for b in range(len(slices) - 1, -1, -1):
                hit = even & slices[b]
                n = count(sure | hit)
                if n >= k:
                    even, kth = hit, kth | 1 << b
                else:
                    sure, even = sure | hit, even & ~slices[b]
            # the low bits add between 0 and (2^shift - 1) * |weights| to what the slices say
            slack = ((1 << self.shift) - 1) * sum(map(abs, q.tolist()))
            least = max(0, kth - (slack >> self.shift) - 1)
            live &= self._at_least(slices, least)
        rows = np.flatnonzero(np.unpackbits(live.view(np.uint8), bitorder="little"))
        if self.most * sum(map(abs, q.tolist())) < 1 << 63:
            scores = self.values[rows] @ q
            best = np.lexsort((self.ids[rows], -scores))[:k]
            return [(int(scores[i]), int(self.ids[rows[i]])) for i in best]
        exact = [(sum(map(operator.mul, v.tolist(), q.tolist())), int(i)) for v, i in zip(self.values[rows], self.ids[rows], strict=True)]
        return sorted(exact, key=lambda x: (-x[0], x[1]))[:k]

    def _at_least(self, slices: list[np.ndarray], least: int) -> np.ndarray:
        """The rows whose sum is no less than a number."""
        above, even = np.zeros_like(self.all), self.all.copy()
        for b in range(max(len(slices), least.bit_length()) - 1, -1, -1):
            s = slices[b] if b < len(slices) else np.zeros_like(self.all)
            if least >> b & 1:
                even = even & s
            else:
                above |= even & s
                even = even & ~s
        return above | even


def top_k(vectors: DataFrame, *, k: int = 10, every: int = 100, scale: int = 1024, queries: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the `k` best rows by integer inner
    product for each query, but the query's own. The queries are the rows of
    `queries`, or else those of `vectors` whose id `every` divides."""
    spark = vectors.sparkSession
    small_batches(spark)
    ready = to_integers(vectors, id_col=id_col, vector_col=vector_col, scale=scale)
    asked = ready.where(F.col("id") % every == 0) if queries is None else to_integers(queries, id_col=id_col, vector_col=vector_col, scale=scale)
    rows, tasks = ready.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-rows // ROWS), min(tasks, -(-rows // LEAST_ROWS)))
    # written, so that a query keeps its number
    asked = cut(asked.withColumn("q", F.monotonically_increasing_id()), "bsi-queries")
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "q", "id", "v")
    index = ready.select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"), F.lit(None).cast("long").alias("q"), "id", "v")
    met = index.unionByName(sent).repartitionById(blocks, "block").sortWithinPartitions(F.asc_nulls_first("q")).select("q", "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values, ix = [], [], None
        for b in batches:
            own = b.column(0).null_count  # index rows come first
            if own:
                ids.append(b.column(1).slice(0, own).to_numpy())
                values.append(matrix(b.column(2).slice(0, own)))
            if own == b.num_rows:
                continue
            if ix is None:
                ix = Index(np.concatenate([np.empty(0, np.int64), *ids]), stacked(values))
                ids, values = [], []
            got = zip(b.column(0).slice(own).to_pylist(), b.column(1).slice(own).to_pylist(), matrix(b.column(2).slice(own)), strict=True)
            out = [(q, i, s, v) for q, i, x in got for s, v in ix.top(x, i, k)]
            if any(not -(1 << 63) <= r[2] < 1 << 63 for r in out):
                raise OverflowError("a score has no 64-bit value")
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 4)], names=found.names)

    found = schema(q=LONG, query_id=LONG, score=LONG, vec_id=LONG)
    best = cut(met.mapInArrow(run, found), "bsi-best")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
