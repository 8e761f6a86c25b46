"""Near-duplicate groups by SetSketch registers.

A register is the least of a document's shingle hashes under a hash function
of its own, read as an exponential variable, on an exponential scale to base
`BASE` and truncated to a byte: floor(1 - log_b(x)), as in Ertl's SetSketch
(2021). Registers of a union are the maxima, and equal registers get likelier
with the Jaccard similarity. The steps:

1. Each text's shingle set gives a fingerprint and the registers. Equal sets
   are one class; classes, not copies, go on.
2. Registers in bands, sized by `banding` for the threshold; classes that
   agree in a band share a bucket. At a similarity of 0.85, 34 bands of 6 miss
   a link with a chance of 1e-7, and at 0.80 40 bands of 5 do.
3. In each bucket one class, drawn by a hash, is compared with every other
   (pairs grow with the members). A group of near copies shares many buckets,
   each with a leader of its own, so links through any of them join it. The
   joint maximum-likelihood estimate of the similarity, from the numbers of
   larger, smaller and equal registers and both sizes, drops pairs more than
   six deviations below the threshold. What is left is verified on the full
   sets. Verified links make components.
4. Buckets may still hold several components. Of two linked sets of sizes
   n and m, the n - ceil(t n) + 1 and m - ceil(t m) + 1 rarest shingles share
   one (the prefix filter, exact whatever "rare" means, as long as all sets
   are put in one order). Classes whose rarest shingles no other component
   holds have no link to find and go: those that share a passage, but too
   little of it.
5. The buckets that remain in several components are compared fully, in
   blocks, without a row for a pair: pairs across components that the estimate
   keeps are verified on the full sets in place, and of the links a spanning
   forest comes out. So no bucket has a cap.
6. The links of both steps give the components.

Defined results: a document without words has an empty set, no links and is
kept; a repeated row joins its copy; documents with a null doc_id take part
and never name a component; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BIN, LONG, cut, schema, settled, small_batches, utf8
from .components import connected_components
from .shingles import fingerprint, shingle_sets

REGISTERS = 204
#: Most registers in a band, and the most chance that all bands miss a link.
BAND_REGISTERS, MISS = 6, 2e-7
BASE, RATE, TOP = 1.15, 20.0, 255
#: Members of a block in step 5, and shingles of all its members.
BLOCK, BLOCK_ITEMS = 1000, 4_000_000
#: Shingles that step 4 orders by how many classes hold them; all others come first.
COMMON = 65_536
#: Most ids that are broadcast: 8 bytes each, 16 MB.
BROADCAST_IDS = 2_000_000

_LN = np.log(BASE)
_FACTORS = np.random.default_rng(20210104).integers(1 << 30, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_work = np.empty((512, REGISTERS), np.uint32)


def registers(s: np.ndarray) -> np.ndarray:
    """The registers of a set of 64-bit hashes (bytes; all 0 if it is empty)."""
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(x), 512):
        part = x[a : a + 512]
        out = _work[: len(part)]
        np.multiply(part[:, None], _FACTORS, out=out)
        np.minimum(low, out.min(axis=0), out=low)
    if not len(x):
        return np.zeros(REGISTERS, np.uint8)
    e = -np.log1p(-(low + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(e) / _LN), 0, TOP).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def _larger(x: np.ndarray) -> np.ndarray:
    """The chance that a register is the larger one, where `x` is the share of
    the union's minimum that its set alone holds."""
    return -np.log1p(-x * (BASE - 1) / BASE) / _LN


def joint_estimate(more: np.ndarray, fewer: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The likeliest Jaccard similarity of pairs of sets, from how many of the
    registers are larger and smaller in the first, and the sets' sizes. The
    likelihood is concave, so bisection on its slope finds it."""
    equal = REGISTERS - more - fewer
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    c = (BASE - 1) / BASE
    for _ in range(24):
        j = (low + high) / 2
        x, y = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
        px, py = _larger(x), _larger(y)
        dx, dy = -v * c / (1 - x * c) / _LN, -u * c / (1 - y * c) / _LN
        slope = more * dx / px + fewer * dy / py - equal * (dx + dy) / np.maximum(1 - px - py, 1e-12)
        up = slope > 0
        low, high = np.where(up, j, low), np.where(up, high, j)
    return (low + high) / 2


def banding(percent: int) -> tuple[int, int]:
    """The number of bands and the registers of each: the longest bands that
    miss a link at the threshold with a chance of at most `MISS`."""
    for size in range(BAND_REGISTERS, 1, -1):
        if (1 - (percent / 100) ** size) ** (REGISTERS // size) <= MISS:
            return REGISTERS // size, size
    return REGISTERS, 1


def _floor(percent: int) -> float:
    """The least estimate that is verified: six deviations below."""
    t = percent / 100
    return t - 6 * np.sqrt(t * (1 - t) / REGISTERS)


def _likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Which of the paired rows of registers may reach the threshold."""
    ok = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    at = np.flatnonzero(ok)
    if len(at):
        x, y = a[at], b[at]
        est = joint_estimate((x > y).sum(axis=1), (x < y).sum(axis=1), n_a[at].astype(float), n_b[at].astype(float))
        ok[at[est < _floor(percent)]] = False
    return ok


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of fixed width as rows of bytes."""
    if not len(column):
        return np.empty((0, width), np.uint8)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def sketch(docs: DataFrame, *, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, fp, regs) of each document."""
    small_batches(docs.sparkSession)
    out = schema(doc_id=LONG, n=LONG, fp=BIN, regs=BIN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, fp, regs = [], [], []
            for s in shingle_sets(b.column(1).to_pylist(), k):
                n.append(len(s))
                fp.append(fingerprint(s))
                regs.append(registers(s).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(regs, pa.binary())], names=out.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")).mapInArrow(run, out)


def _likely_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that the joint estimate keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = _likely(_matrix(t.column(2), REGISTERS), _matrix(t.column(3), REGISTERS), t.column(4).to_numpy(), t.column(5).to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one = classes.select(F.col("fp").alias("a"), F.col("regs").alias("regs_a"), F.col("n").alias("n_a"))
    two = classes.select(F.col("fp").alias("b"), F.col("regs").alias("regs_b"), F.col("n").alias("n_b"))
    both = pairs.join(two, "b").join(one, "a").select("a", "b", "regs_a", "regs_b", "n_a", "n_b")
    return both.mapInArrow(run, schema(a=BIN, b=BIN))


def _full_sets(wanted: DataFrame, docs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(fp, items): the full shingle sets of the classes in `wanted` (fp)."""
    ids = cut(classes.join(wanted, "fp", "left_semi").select("rep").distinct(), "near-ids")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["rep"]), "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            got = list(shingle_sets(t.column(0).to_pylist(), k))
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in got], pa.binary()), pa.array([s.tobytes() for s in got], pa.binary())], names=["fp", "items"])

    full = texts.select("text").mapInArrow(sets, schema(fp=BIN, items=BIN)).join(wanted, "fp", "left_semi").dropDuplicates(["fp"])
    return cut(full, "near-sets")


def linked(x: bytes, y: bytes, percent: int) -> bool:
    """Whether two full sets reach the threshold."""
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= percent * (len(p) + len(q) - both)


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets reach the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = [linked(x, y, percent) for x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one, two = full.select(F.col("fp").alias("a"), F.col("items").alias("x")), full.select(F.col("fp").alias("b"), F.col("items").alias("y"))
    return cut(pairs.join(two, "b").join(one, "a").select("a", "b", "x", "y").mapInArrow(check, schema(a=BIN, b=BIN)), "near-links")


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) between components, in each block pair of a
    bucket: a spanning forest of them, so no more than there are members.
    `members`: key, i, j (the block pair), own (the member's block), band, fp,
    comp, n, regs, items. A pair that shares an earlier band is left to that
    band's bucket."""

    bands, size = banding(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for t in batches:
            now = pa.Table.from_batches([t])
            now = now if rest is None else pa.concat_tables([rest, now])
            keys = np.stack([now.column(c).to_numpy() for c in ("key", "i", "j")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            yield from groups(now.slice(0, last), cuts[:-1])
            rest = now.slice(last)
        if rest is not None:
            yield from groups(rest, np.empty(0, np.int64))

    def groups(t: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        own, i, j, band, n = (t.column(c).to_numpy() for c in ("own", "i", "j", "band", "n"))
        fp, items = t.column("fp").to_pylist(), t.column("items")
        regs = _matrix(t.column("regs").combine_chunks(), REGISTERS)
        _, comp = np.unique(_matrix(t.column("comp").combine_chunks(), 16).copy().view("V16").ravel(), return_inverse=True)
        left, right = [], []
        for a, e in zip([0, *cuts.tolist()], [*cuts.tolist(), t.num_rows], strict=True):
            parent: dict[int, int] = {}

            def root(c: int, parent: dict[int, int] = parent) -> int:
                while (up := parent.get(c, c)) != c:
                    c = parent[c] = parent.get(up, up)
                return c

            for p in range(a, e):
                if i[a] == j[a]:
                    q = np.arange(p + 1, e)
                elif own[p] == i[a]:
                    q = np.flatnonzero(own[a:e] == j[a]) + a
                else:
                    continue
                q = q[(comp[q] != comp[p]) & (100 * np.minimum(n[q], n[p]) >= percent * np.maximum(n[q], n[p]))]
                if not len(q):
                    continue
                # far fewer equal registers than the floor's share rule a pair out before the estimate
                same = regs[q] == regs[p]
                keep = same.sum(axis=1) >= REGISTERS * _floor(percent) * 0.9
                q, same = q[keep], same[keep]
                q = q[same[:, : bands * size].reshape(-1, bands, size).all(axis=2).argmax(axis=1) == band[p]]
                q = q[[root(int(c)) != root(int(comp[p])) for c in comp[q]]] if len(q) else q
                if not len(q):
                    continue
                for x in q[_likely(np.broadcast_to(regs[p], (len(q), REGISTERS)), regs[q], np.full(len(q), n[p]), n[q], percent)].tolist():
                    one, two = root(int(comp[p])), root(int(comp[x]))
                    if one != two and linked(items[p].as_py(), items[x].as_py(), percent):
                        parent[one] = two
                        left.append(fp[p])
                        right.append(fp[x])
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])

    return members.mapInArrow(run, schema(a=BIN, b=BIN))


def _common(full: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The `COMMON` shingles that the most sets hold, in order, and how many
    sets hold each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x, n = np.unique(np.frombuffer(b"".join(t.column(0).to_pylist()), np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(n.astype(np.int64))], names=["item", "n"])

    top = full.select("items").mapInArrow(count, schema(item=LONG, n=LONG)).groupBy("item").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "item").limit(COMMON).toArrow()
    x, n = top.column("item").to_numpy(), top.column("n").to_numpy()
    order = np.argsort(x)
    return x[order], n[order]


def prefix(items: np.ndarray, percent: int, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The rarest shingles of a set, so many that two sets which reach the
    threshold share one."""
    known, held = common
    at = np.minimum(np.searchsorted(known, items), max(len(known) - 1, 0))
    n = np.where(known[at] == items, held[at], 0) if len(known) else np.zeros(len(items), np.int64)
    return items[np.lexsort((items, n))[: len(items) - -(-percent * len(items) // 100) + 1]]


def _linkable(full: DataFrame, torn: DataFrame, percent: int) -> DataFrame:
    """(fp): the classes of `torn` (fp, comp) that share one of their rarest
    shingles with a class of another component. `full`: fp, items."""
    common = _common(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            rare = [prefix(np.frombuffer(x, np.int64), percent, common) for x in t.column(2).to_pylist()]
            at = np.repeat(np.arange(t.num_rows), [len(x) for x in rare])
            yield pa.RecordBatch.from_arrays([t.column(0).take(pa.array(at)), t.column(1).take(pa.array(at)), pa.array(np.concatenate([np.empty(0, np.int64), *rare]))], names=["fp", "comp", "item"])

    rare = cut(full.join(torn, "fp").select("fp", "comp", "items").mapInArrow(run, schema(fp=BIN, comp=BIN, item=LONG)), "near-rare")
    several = rare.groupBy("item").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("item")
    return rare.join(several, "item", "left_semi").select("fp").distinct()


def _torn(placed: DataFrame) -> DataFrame:
    """(key, blocks) of the buckets that hold several components. `placed`:
    key, fp, comp, n."""
    state = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("members"), F.sum("n").alias("items"))
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("items") / BLOCK_ITEMS)).cast("int")
    return state.where("low <> high").select("key", blocks.alias("blocks"))


def _components(sketched: DataFrame, source: DataFrame, percent: int, k: int) -> DataFrame:
    """(fp, component_id) of each class with words. `source`: doc_id, text."""
    least = sketched.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    classes = cut(least, "near-classes")

    number, size = banding(percent)
    band = F.transform(F.sequence(F.lit(0), F.lit(number - 1)), lambda i: F.xxhash64(i, F.substring(F.col("regs"), i * size + 1, F.lit(size))))
    bands = classes.select("fp", "n", F.posexplode(band).alias("band", "key"))
    shared = bands.groupBy("key").agg(F.min_by("fp", F.xxhash64("fp", "key")).alias("a"), F.count("*").alias("size")).where("size > 1")
    members = cut(bands.join(shared, "key"), "near-members")

    told = members.where("a <> fp").select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b")).distinct()
    pairs = cut(_likely_pairs(told, classes, percent), "near-pairs")
    full = _full_sets(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), source, classes, k)
    first = _verified(pairs, full, percent)
    joined = connected_components(first.select(F.col("a").alias("src"), F.col("b").alias("dst")))

    # a bucket of two was compared in full
    placed = members.where("size > 2").join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("component", "fp")).select("key", "band", "fp", "comp", "n")
    placed = cut(placed, "near-placed")
    placed = cut(placed.join(_torn(placed).select("key"), "key", "left_semi"), "near-torn")
    full = _full_sets(placed.select("fp").distinct(), source, classes, k)
    placed = cut(placed.join(_linkable(full, placed.select("fp", "comp").distinct(), percent), "fp", "left_semi"), "near-linkable")
    open_ = cut(placed.join(_torn(placed), "key").select("key", "band", "blocks", "fp", "comp"), "near-open")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = open_.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "band", "fp", "comp")
    dealt = dealt.join(classes.select("fp", "n", "regs"), "fp").join(full, "fp").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    second = _across(dealt, percent)

    links = cut(first.unionByName(second), "near-all-links")
    parts = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("node", "fp")
    named = classes.select("fp", "rep").join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    name = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    return named.join(name, "component").select("fp", "component_id")


def near_duplicates(docs: DataFrame, *, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text", keep_class: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id, kept, and
    with `keep_class` also fp, the fingerprint of its shingle set.
    Documents are linked if 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    sketched = cut(sketch(docs, k=k, id_col=id_col, text_col=text_col), "near-sketch")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    of_class, _ = settled(spark, lambda: _components(sketched, source, percent, k), "near-named")
    # a class of very many copies is one key here; the join splits it
    out = sketched.select("doc_id", "n", "fp").join(of_class, "fp", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), *(["fp"] if keep_class else []))


def one_of_each(docs: DataFrame, *, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, with one of each group: that of the least
    id. Rows that repeat that id and its shingle set leave one; documents
    without words are in no group and all stay."""
    near = cut(near_duplicates(docs, percent=percent, k=k, id_col=id_col, text_col=text_col, keep_class=True), "near-result")
    again = cut(near.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("doc_id").alias("near_again")), "near-again")
    kept = near.where("kept").select(F.col("doc_id").alias("near_id"), F.col("fp").alias("near_fp")).distinct()
    id_ = docs[id_col]
    if again.isEmpty():
        return docs.join(kept, id_.eqNullSafe(kept["near_id"]), "left_semi")
    first = kept.join(again, F.col("near_id").eqNullSafe(F.col("near_again")), "left_anti")
    once = docs.join(first, id_.eqNullSafe(first["near_id"]), "left_semi")
    # only ids that occur more than once need their rows' sets to tell rows apart
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    many = docs.join(again, id_.eqNullSafe(again["near_again"]), "left_semi").select(row.alias("near_row"), F.col(f"`{id_col}`").alias("near_own"), fingerprint_of(text_col, k).alias("near_set"))
    many = many.join(kept, F.col("near_own").eqNullSafe(F.col("near_id")) & (F.col("near_set") == F.col("near_fp")), "left_semi")
    empty = F.col("near_set") == F.lit(fingerprint(np.empty(0, np.uint64)))
    many = many.where(~empty).dropDuplicates(["near_own", "near_set"]).unionByName(many.where(empty))
    return once.unionByName(many.select("near_row.*"))


def fingerprint_of(text_col: str, k: int) -> F.Column:
    """A column with the fingerprint of each text's shingle set."""

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(s) for s in shingle_sets([bytes(t) for t in texts], k)], dtype=object)

    return of(utf8(text_col))
