"""Token counts by a two-tier lookup on the map side.

Tier one is a broadcast table of the corpus's most frequent pre-tokens and
their lengths in tokens: at most `tier_rows` entries of at most
`spm.KEEP_CHARS` characters, so its size is bounded whatever the corpus. Tier
two is each worker's cache; what neither holds is encoded by the library, a
batch's distinct misses at once. Pre-tokens stay in their task: only each
task's summary of its most frequent ones (`task_rows` at most) is exchanged,
to choose tier one. What tier one holds changes speed, never a count.

Pre-tokens are the chunks of `spm`. Defined results: null and empty texts
count 0 tokens and 0 bytes; repeated doc_ids give a row each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LONG, STR, schema, small_batches
from .spm import KEEP_CHARS, chunks, lengths, model, worker_table

#: Entries counted in a task before the rare ones go.
COUNTING = 200_000


def frequent(docs: DataFrame, text_col: str, rows: int, task_rows: int) -> list[str]:
    """The most frequent pre-tokens, from summaries over all documents."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for x in b.column(0).to_pylist():
                seen.update(chunks(x))
            if len(seen) > COUNTING:
                seen = Counter(dict(seen.most_common(COUNTING // 4)))
        top = [(c, n) for c, n in seen.most_common(task_rows) if len(c) <= KEEP_CHARS]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["chunk", "n"])

    text = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sums = text.mapInArrow(summary, schema(chunk=STR, n=LONG)).groupBy("chunk").agg(F.sum("n").alias("n"))
    return [r.chunk for r in sums.orderBy(F.desc("n"), "chunk").limit(rows).collect()]


def count_tokens(
    docs: DataFrame, path: str, *, limit: int = 4096, tier_rows: int = 16_384, task_rows: int = 2_048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row for each document: its id, `n_bytes`, `n_tokens` and `over_limit`
    (more than `limit` tokens)."""
    spark = docs.sparkSession
    small_batches(spark)
    top = frequent(docs, text_col, tier_rows, task_rows)
    tier = spark.sparkContext.broadcast(dict(zip(top, lengths(model(path), top), strict=True)))
    key = tier.id if hasattr(tier, "id") else id(tier)
    out = schema(**{id_col: docs.schema[id_col].dataType, "n_bytes": LONG, "n_tokens": LONG, "over_limit": T.BooleanType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = worker_table(path, lengths, tier.value, key)
        for b in batches:
            split = [chunks(x) for x in b.column(2).to_pylist()]
            get = t.take(split).__getitem__
            n = [sum(map(get, d)) for d in split]
            t.release()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=out.names)

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(run, out)
