"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the vocabulary may hold a whitespace marker after another
character, so no merge ever crosses from a word into the next marker. The
text, with its marker in front, thus falls into *chunks*: a run of markers and
the characters up to the next one. Each distinct chunk of an Arrow batch that
the worker has not met is segmented and decoded once by the library; the
documents' ids and texts are then joined back by position. Chunks never leave
their task, so there is no shuffle.

Defined results: null and empty texts have no ids and decode to the empty
string; repeated doc_ids give a row each; other columns of the input are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LONG, STR, schema, small_batches

MARK = "▁"
#: Chunks that a worker keeps, and the longest one it keeps (characters).
KEEP, KEEP_CHARS = 250_000, 48

#: Texts whose chunks must give the library's ids: prefix, runs, other white
#: space, compatibility forms, markers.
PROBES = ["a", " a", "a  b ", "\tb c", "a\n b", "a\u3000b", "x\u00a0y z", "\u00bd \ufb01 \uff21", "\u2581q \u2581", "   "]

_runs = re.compile(" +[^ ]*").findall
_models: dict[str, object] = {}


def model(path: str):
    """The library's processor, once for each worker. Raises if its pieces
    could cross a marker, for then chunks can't be segmented alone."""
    if path not in _models:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if MARK in p.lstrip(MARK) and not sp.is_control(i):
                raise ValueError(f"piece {p!r} crosses a whitespace marker")
        for text in PROBES:
            if [i for ids in _ids(sp, chunks(text)) for i in ids] != sp.encode(text):
                raise ValueError(f"the model treats white space in its own way: chunks of {text!r} can't be segmented alone")
        _models[path] = sp
    return _models[path]


def chunks(text: str) -> list[str]:
    """The chunks of a text, each without its first marker; a marker is a
    space here. The library takes the marker itself as a space too."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [c[1:] for c in _runs(" " + text)]
    return text.split(" ")


class Table:
    """Distinct chunks and what the library makes of each, kept by a worker."""

    def __init__(self, path: str, make, first: dict | None = None):
        self.sp, self.make, self.first = model(path), make, first or {}
        self.known = dict(self.first)

    def take(self, documents: list[list[str]]) -> dict:
        """A table that holds all chunks of these documents."""
        need: set[str] = set()
        for d in documents:
            need.update(d)
        new = [c for c in need if c not in self.known]
        if len(self.known) + len(new) > KEEP + len(self.first):
            self.known = dict(self.first)
            new = [c for c in need if c not in self.known]
        self.known.update(zip(new, self.make(self.sp, new), strict=True))
        self.passing = [c for c in new if len(c) > KEEP_CHARS]
        return self.known

    def release(self) -> None:
        """Long chunks pass: they hardly ever recur."""
        for c in self.passing:
            del self.known[c]


def _ids(sp, new: list[str]) -> list[list[int]]:
    """Ids of chunks given without the first marker, which the library puts
    before any text but the empty one."""
    lone = sp.piece_to_id(MARK)
    return [x if c else [lone] for c, x in zip(new, sp.encode(new, num_threads=1), strict=True)]


def lengths(sp, new: list[str]) -> list[int]:
    return [len(x) for x in _ids(sp, new)]


def both(sp, new: list[str]) -> list[tuple[str, str]]:
    """Decimal ids joined by commas, and the decoded text with the space that
    the library drops at the start of a text."""
    ids = _ids(sp, new)
    return [(",".join(map(str, x)), " " + d) for x, d in zip(ids, sp.decode(ids, num_threads=1), strict=True)]


_tables: dict[tuple, Table] = {}


def worker_table(path: str, make, first: dict | None = None, key: object = None) -> Table:
    """This worker's table; it outlives a task."""
    k = (path, make.__name__, key)
    if k not in _tables:
        _tables.clear()
        _tables[k] = Table(path, make, first)
    return _tables[k]


def encode_decode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), keep_output: bool = False) -> DataFrame:
    """A row for each document: its id, `n_tokens`, `ids_sha256` and
    `decoded_sha256`, then the columns `keep` as they are; with `keep_output` also `ids` (array of int) and
    `decoded`, the operator's plain outputs."""
    small_batches(docs.sparkSession)
    out = schema(**{id_col: docs.schema[id_col].dataType, "n_tokens": LONG, "ids_sha256": STR, "decoded_sha256": STR, **{c: docs.schema[c].dataType for c in keep}})
    if keep_output:
        out = out.add("ids", T.ArrayType(T.IntegerType())).add("decoded", STR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = worker_table(path, both)
        sha = hashlib.sha256
        for b in batches:
            split = [chunks(x) for x in b.column(1).to_pylist()]
            known = t.take(split)
            n, ids, texts, full = [], [], [], ([], [])
            for d in split:
                pairs = [known[c] for c in d]
                joined = ",".join([p[0] for p in pairs])
                text = "".join([p[1] for p in pairs])[1:]
                n.append(joined.count(",") + 1 if d else 0)
                ids.append(sha(joined.encode()).hexdigest())
                texts.append(sha(text.encode()).hexdigest())
                if keep_output:
                    full[0].append([int(x) for x in joined.split(",")] if d else [])
                    full[1].append(text)
            t.release()
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string()), *b.columns[2:]]
            if keep_output:
                cols += [pa.array(full[0], pa.list_(pa.int32())), pa.array(full[1], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=out.names)

    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(f"`{c}`") for c in keep])
    return rows.mapInArrow(run, out)
