"""Keyed tables on Parquet: upserts as new parts behind a log of versions.

A table's rows lie in buckets (a day, or a run of offsets or batches), and a
key never leaves its bucket. A version is a small file that lists each bucket's
parts. It is written under a passing name and renamed to the next free number,
and readers take the highest number: no step removes what an earlier version
names, so a crash at any point leaves the table as it was.

An upsert reads and writes the buckets that its rows touch, no others, so its
cost doesn't grow with the table's age. Inserts add a part to a bucket; every
`MERGE_AT` parts of one level are merged into one of the next, so a row is
rewritten only a logarithmic number of times. Upserts that repeat have no
effect.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The tables and their keys.
_DLQ = "kafka_topic string, kafka_partition int, kafka_offset bigint, kafka_ts timestamp, kafka_key string, raw_value string, reject_reason string, schema_version string, _ingested_at timestamp"
_MINUTES = "campaign_id bigint, window_start timestamp, window_end timestamp, impressions bigint, clicks bigint, conversion_path_impressions bigint, spend decimal(28,8), approx_users bigint, _updated_at timestamp"
_BATCH = "query_name string, batch_id bigint, rows_in bigint, rows_valid bigint, rows_dlq bigint, rows_duplicate_in_batch bigint, min_event_ts timestamp, max_event_ts timestamp, latency_p50_s double, latency_p95_s double, dlq_rate double, _recorded_at timestamp"
_PROGRESS = "query_id string, batch_id bigint, query_name string, num_input_rows bigint, input_rows_per_s double, processed_rows_per_s double, batch_duration_ms bigint, rows_dropped_by_watermark bigint, state_rows bigint, watermark string, _recorded_at timestamp"
#: Name: (key, columns, bucket). Days of the event or the window; a million offsets; a thousand batches.
TABLES: dict[str, tuple[tuple[str, ...], str | None, str]] = {
    "impressions_stream": (("impression_id",), None, "date_format(event_ts, 'yyyy-MM-dd')"),
    "impressions_dlq": (("kafka_topic", "kafka_partition", "kafka_offset"), _DLQ, "concat_ws('-', kafka_partition, kafka_offset div 1000000)"),
    "campaign_minute_metrics": (("campaign_id", "window_start"), _MINUTES, "date_format(window_start, 'yyyy-MM-dd')"),
    "stream_batch_metrics": (("query_name", "batch_id"), _BATCH, "concat_ws('-', query_name, batch_id div 1000)"),
    "stream_query_progress": (("query_id", "batch_id"), _PROGRESS, "cast(batch_id div 1000 as string)"),
}
ONE = "'all'"
#: Parts of one level in a bucket that are merged; versions that stay readable.
MERGE_AT, KEEP_VERSIONS = 8, 20
ONE_TASK = 50_000
BUCKET = "store_bucket"


def merge_sql(target: str, staging: str, columns: list[str], keys: list[str], update: bool) -> str:
    """The same upsert as a MERGE statement, for warehouses that have it."""
    match = " AND ".join(f"t.{k} = s.{k}" for k in keys)
    parts = [f"MERGE INTO {target} t USING {staging} s ON {match}"]
    rest = [c for c in columns if c not in keys]
    if update and rest:
        parts.append("WHEN MATCHED THEN UPDATE SET " + ", ".join(f"t.{c} = s.{c}" for c in rest))
    parts.append(f"WHEN NOT MATCHED THEN INSERT ({', '.join(columns)}) VALUES ({', '.join('s.' + c for c in columns)})")
    return " ".join(parts)


def _bucket(bucket: str) -> Column:
    """A row's bucket; a folder's name can't be empty."""
    return F.coalesce(F.nullif(F.expr(bucket), F.lit("")), F.lit("none"))


@dataclass
class Version:
    """What a table holds: its columns, and for each bucket its parts. A part
    is named after its level and a number of its own."""

    number: int = 0
    schema: T.StructType | None = None
    buckets: dict[str, list[str]] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({"schema": self.schema.jsonValue(), "buckets": self.buckets}, sort_keys=True)


class Change:
    """Staged versions of some tables, committed together or not at all
    unless the commit itself is cut short; then a replay completes it."""

    def __init__(self, store: KeyedStore):
        self.store, self.next, self.parts = store, {}, []

    def version(self, table: str) -> Version:
        return self.next.get(table) or self.store.latest(table)

    def part(self, table: str, rows: DataFrame, bucket: str, order: Iterable[str] = (), level: int = 0, size: int | None = None) -> tuple[str, list[str]]:
        """Write rows as a part, sorted; its name and the buckets it has rows
        for. Small buckets share a task, and a large one is split by its size;
        up to `ONE_TASK` rows, if that is known, need no exchange."""
        name = f"{level}-{uuid.uuid4().hex}"
        path = f"{self.store.root}/{table}/data/{name}"
        self.parts.append(path)
        placed = rows.withColumn(BUCKET, _bucket(bucket))
        placed = placed.coalesce(1) if size is not None and size <= ONE_TASK else placed.hint("rebalance", BUCKET)
        placed.sortWithinPartitions(BUCKET, *order).write.partitionBy(BUCKET).parquet(path)
        return name, self.store.list_buckets(path)

    def upsert(self, table: str, rows: DataFrame, keys: tuple[str, ...] | None = None, *, update: bool = False, bucket: str | None = None) -> int:
        """Insert rows whose key is absent; with `update` also overwrite the
        others. Columns that the table lacks are dropped, missing ones are
        null. Rows with one key twice count once. Returns the rows added."""
        keys, spec, where = TABLES.get(table, (keys, None, ONE))
        keys, bucket = list(keys), bucket or where
        now, store = self.version(table), self.store
        schema = now.schema or (T.StructType.fromDDL(spec) if spec else rows.schema)
        fitted = rows.select(*[(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]).dropDuplicates(keys)
        fitted = fitted.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            # the buckets of one batch are few
            sizes = {r[0]: r[1] for r in fitted.groupBy(_bucket(bucket)).count().collect()}
            touched = sorted(sizes)
            known = {b: now.buckets[b] for b in touched if b in now.buckets}
            if not touched:
                return 0
            new, had = fitted, 0
            if known:
                old = store.rows(table, schema, known)
                if update:
                    new, had = fitted.unionByName(old.join(fitted.select(*keys), keys, "left_anti").select(*schema.names)), old.count()
                else:
                    new = fitted.join(old.select(*keys), keys, "left_anti").select(*schema.names)
            name, written = self.part(table, new, bucket, keys, size=sum(sizes.values()) + had)
        finally:
            fitted.unpersist()
        if not written:
            return 0
        buckets = dict(now.buckets)
        for b in written:
            buckets[b] = [name] if update or b not in known else self._merged(table, schema, bucket, keys, b, [*known[b], name])
        self.next[table] = Version(now.number, schema, buckets)
        # of Parquet files only the footers are read for a count
        again = {b: [name] for b in written if b in known}
        return sum(n for b, n in sizes.items() if b not in known) + (store.rows(table, schema, again).count() if again else 0) - had

    def upsert_each(self, rows: dict[str, DataFrame]) -> dict[str, int]:
        """Insert into several tables at once: their jobs are small and share
        the cluster."""
        one = inheritable_thread_target(self.store.spark)(lambda t: (t, self.upsert(t, rows[t])))
        with ThreadPoolExecutor(len(rows)) as pool:
            return dict(pool.map(one, rows))

    def _merged(self, table: str, schema: T.StructType, bucket: str, keys: Iterable[str], b: str, parts: list[str]) -> list[str]:
        level = 0
        while len(same := [p for p in parts if p.startswith(f"{level}-")]) >= MERGE_AT:
            name, _ = self.part(table, self.store.rows(table, schema, {b: same}), bucket, keys, level + 1)
            parts = [*[p for p in parts if p not in same], name]
            level += 1
        return parts

    def replace(self, table: str, rows: DataFrame, *, bucket: str | None = None) -> int:
        """Truncate and load: the table is these rows, in their own columns."""
        bucket = bucket or TABLES.get(table, (None, None, ONE))[2]
        name, there = self.part(table, rows, bucket)
        self.next[table] = Version(self.version(table).number, rows.schema, {b: [name] for b in there})
        return self.store.rows(table, rows.schema, self.next[table].buckets).count()


@dataclass
class KeyedStore:
    """Tables below one folder. One writer at a time for each table."""

    spark: SparkSession
    root: str

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        p, fs = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def list_buckets(self, path: str) -> list[str]:
        unescape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        return sorted(unescape(n.partition("=")[2]) for n in self._names(path) if n.startswith(f"{BUCKET}="))

    def versions(self, table: str) -> list[int]:
        return sorted(int(n) for n in self._names(f"{self.root}/{table}/log") if n.isdigit())

    def at(self, table: str, number: int) -> Version:
        p, fs = self._fs(f"{self.root}/{table}/log/{number:012d}")
        f = fs.open(p)
        try:
            d = json.loads(bytes(f.readAllBytes()).decode())
        finally:
            f.close()
        return Version(number, T.StructType.fromJson(d["schema"]), d["buckets"])

    def latest(self, table: str) -> Version:
        there = self.versions(table)
        return self.at(table, there[-1]) if there else Version()

    def rows(self, table: str, schema: T.StructType, buckets: dict[str, list[str]]) -> DataFrame:
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        paths = [f"{self.root}/{table}/data/{p}/{BUCKET}={escape(b)}" for b, parts in buckets.items() for p in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, table: str, buckets: Iterable[str] | None = None) -> DataFrame | None:
        """The table, or some of its buckets; none before its first row."""
        now = self.latest(table)
        if now.schema is None:
            return None
        return self.rows(table, now.schema, now.buckets if buckets is None else {b: now.buckets[b] for b in buckets if b in now.buckets})

    @contextmanager
    def change(self) -> Iterator[Change]:
        """Upserts of several tables that count together: versions are only
        pointed at when all are staged; after an error what was staged goes."""
        c = Change(self)
        try:
            yield c
        except BaseException:
            for path in c.parts:
                p, fs = self._fs(path)
                fs.delete(p, True)
            raise
        for table, v in c.next.items():
            self._commit(table, v)

    def _commit(self, table: str, v: Version) -> None:
        number = v.number + 1
        passing, fs = self._fs(f"{self.root}/{table}/log/.next-{uuid.uuid4().hex}")
        out = fs.create(passing, False)
        out.write(bytearray(v.to_json().encode()))
        out.close()
        final, _ = self._fs(f"{self.root}/{table}/log/{number:012d}")
        if fs.exists(final) or not fs.rename(passing, final):
            fs.delete(passing, False)
            raise OSError(f"another writer made version {number} of {table}")
        if number % KEEP_VERSIONS == 0:
            self.vacuum(table)

    def upsert(self, table: str, rows: DataFrame, keys: tuple[str, ...] | None = None, *, update: bool = False, bucket: str | None = None) -> int:
        """`Change.upsert`, committed."""
        with self.change() as c:
            return c.upsert(table, rows, keys, update=update, bucket=bucket)

    def replace(self, table: str, rows: DataFrame, *, bucket: str | None = None) -> int:
        with self.change() as c:
            return c.replace(table, rows, bucket=bucket)

    def vacuum(self, table: str, keep: int = KEEP_VERSIONS) -> int:
        """Remove versions but the last `keep`, and parts that none of these
        names; parts of a change under way are newer than them and stay
        only if this is the table's one writer. Returns the parts removed."""
        there = self.versions(table)
        named = {p for n in there[-keep:] for parts in self.at(table, n).buckets.values() for p in parts}
        for n in there[:-keep]:
            p, fs = self._fs(f"{self.root}/{table}/log/{n:012d}")
            fs.delete(p, False)
        gone = [n for n in self._names(f"{self.root}/{table}/data") if n not in named]
        for n in gone:
            p, fs = self._fs(f"{self.root}/{table}/data/{n}")
            fs.delete(p, True)
        return len(gone)
