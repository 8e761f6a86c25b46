"""Token ids in fixed-width bit packing.

An id takes the least bits that hold the vocabulary, lowest bit first, with no
gaps but at the end of a block of `BLOCK` ids. A file holds blocks, then a
footer: each document's id and first position, and each block's offset. A
range of ids is read by its blocks alone, and numpy unpacks a block at once.

    TOKPACK1 | blocks ... | doc_ids i64 | has_id u8 | starts i64 (n+1) | offsets i64 (blocks+1) | bits, docs, blocks, footer i64 | TOKPACK1

Documents are dealt out by ranges of their ids, so the files, in the order of
their first document, hold the corpus in ascending order; a task writes one
file as its rows come and never holds more than a block and the footer. A file
is written under a temporary name and renamed, so a task that is run again
after a lost executor replaces whole files only.

Defined results: null and empty texts hold only the end id; a null doc_id
sorts first; rows that share a doc_id are in order of their texts; an empty
table gives no files and an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LONG, STR, cut, schema, shared_dir, small_batches, tasks_for, utf8
from .wordids import encoder

MAGIC, BLOCK = b"TOKPACK1", 8192


def width(vocabulary: int) -> int:
    """The least bits that hold ids below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if ids.size and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(spread, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide.ravel(), bitorder="little").view("<u4")


class Writer:
    """Writes documents to an open binary file."""

    def __init__(self, out, bits: int):
        self.out, self.bits = out, bits
        self.rest = np.empty(0, "<u4")
        self.docs: list[int | None] = []
        self.starts, self.offsets = [0], [len(MAGIC)]
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids) // 4)

    def ids(self, data: bytes) -> None:
        """The ids of the documents just added, in their order."""
        now = np.concatenate([self.rest, np.frombuffer(data, "<u4")])
        full = len(now) // BLOCK * BLOCK
        for k in range(0, full, BLOCK):
            self._block(now[k : k + BLOCK])
        self.rest = now[full:].copy()

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        at = self.offsets[-1]
        self.out.write(np.array([d or 0 for d in self.docs], "<i8").tobytes())
        self.out.write(np.array([d is not None for d in self.docs], "u1").tobytes())
        self.out.write(np.array(self.starts, "<i8").tobytes())
        self.out.write(np.array(self.offsets, "<i8").tobytes())
        self.out.write(np.array([self.bits, len(self.docs), len(self.offsets) - 1, at], "<i8").tobytes() + MAGIC)


class Reader:
    """Random access to a file; only footer and asked-for blocks are read."""

    def __init__(self, source):
        self.source = source
        tail = self._at(source.size() - 40, 40)
        if tail[32:] != MAGIC:
            raise ValueError("not a token file, or cut off")
        self.bits, n, blocks, at = np.frombuffer(tail, "<i8", 4).tolist()
        foot = self._at(at, n * 9 + (n + 1) * 8 + (blocks + 1) * 8)
        self.docs = np.frombuffer(foot, "<i8", n)
        self.has_id = np.frombuffer(foot, "u1", n, n * 8).astype(bool)
        self.starts = np.frombuffer(foot, "<i8", n + 1, n * 9)
        self.offsets = np.frombuffer(foot, "<i8", blocks + 1, n * 9 + (n + 1) * 8)

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def read(self, first: int, n: int) -> np.ndarray:
        """The ids at positions first .. first + n - 1."""
        if n <= 0:
            return np.empty(0, "<u4")
        a, e = first // BLOCK, -(-(first + n) // BLOCK)
        data, at, total = self._at(int(self.offsets[a]), int(self.offsets[e] - self.offsets[a])), int(self.offsets[a]), int(self.starts[-1])
        got = [unpack(data[int(self.offsets[k]) - at : int(self.offsets[k + 1]) - at], min(BLOCK, total - k * BLOCK), self.bits) for k in range(a, e)]
        return np.concatenate(got)[first - a * BLOCK : first - a * BLOCK + n]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.starts[k + 1] - self.starts[k]))


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def write_packed(docs: DataFrame, path: str, folder: str, *, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write the documents to files in `folder`. Returns the
    manifest, already computed: file, n_docs, n_ids, and `before`, the ids of
    all files before it."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        fs, base = open_fs(folder)
        name = f"{base}/part-{TaskContext.get().partitionId():06d}.tokpack"
        temporary, w, out = f"{base}/_{uuid.uuid4().hex}", None, None
        for b in batches:
            if w is None and b.num_rows:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(temporary)
                w = Writer(out, width(max(enc.vocabulary, (end_id or 0) + 1)))
            ids = [x + end for x in enc.encode(b.column(1).to_pylist())]
            for d, x in zip(b.column(0).to_pylist(), ids, strict=True):
                w.add(d, x)
            if ids:
                w.ids(b"".join(ids))
        if w is not None:
            w.close()
            out.close()
            fs.move(temporary, name)
            first = next((d for d in w.docs if d is not None), None)
            row = [[name.rpartition("/")[2]], [first], [w.docs[0] is None], [len(w.docs)], [w.starts[-1]]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=out_schema.names)

    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
    out_schema = schema(file=STR, first=LONG).add("has_null", "boolean").add("n_docs", LONG).add("n_ids", LONG)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    dealt = rows.repartitionByRange(tasks_for(docs), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    manifest = cut(dealt.mapInArrow(run, out_schema), "tokpack-manifest")
    # a row for each file; one task can sum those of any corpus
    order = Window.orderBy(F.desc("has_null"), "first").rowsBetween(Window.unboundedPreceding, -1)
    return cut(manifest.select("file", "n_docs", "n_ids", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("before")), "tokpack-manifest")


def read_packed(manifest: DataFrame, folder: str) -> DataFrame:
    """A row for each document, read from the files: doc_id, start (ids of
    all documents before it), n_tokens, ids_crc32."""
    out = schema(doc_id=LONG, start=LONG, n_tokens=LONG, ids_crc32=LONG)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        for b in batches:
            for name, before in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with fs.open_input_file(f"{base}/{name}") as f:
                    r = Reader(f)
                    n = len(r.docs)
                    step = 2000
                    for a in range(0, n, step):
                        e = min(n, a + step)
                        ids = r.read(int(r.starts[a]), int(r.starts[e] - r.starts[a])).tobytes()
                        at = ((r.starts[a : e + 1] - r.starts[a]) * 4).tolist()
                        crc = [zlib.crc32(ids[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(r.docs[a:e], pa.int64(), mask=~r.has_id[a:e]), pa.array(r.starts[a:e] + before, pa.int64()),
                            pa.array(np.diff(r.starts[a : e + 1]), pa.int64()), pa.array(crc, pa.int64()),
                        ], names=out.names)

    spark = manifest.sparkSession
    files = manifest.select("file", "before").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file")
    return files.mapInArrow(run, out)


def token_files(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write the files below the shared folder and read them back."""
    folder = shared_dir(docs.sparkSession, "tokpack")
    return read_packed(write_packed(docs, path, folder, **options), folder)
