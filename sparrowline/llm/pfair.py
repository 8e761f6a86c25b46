"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in an order by hash, are cut into blocks, one for a
slot. In the ideal (fluid) schedule every source that has blocks left is served
at a rate in proportion to its weight; block i of a source is released in the
slot where its ideal service begins and due where that ends, and each slot goes
to the released block with the earliest deadline. On one sequence this meets
every deadline, so in each prefix of the schedule a source is less than one
block away from its ideal service. While all sources last that is its weight;
when a source runs out the others share its time in proportion. Every document
is placed once.

Weights are taken as they are given: releases and deadlines are exact integer
arithmetic over the whole run, so nothing drifts however long the corpus is.
Earliest deadline first is one sequence by nature; the driver runs it over the
blocks (not the documents) and writes it to the shared folder as it goes. There
are at most `MOST_BLOCKS` of them, so blocks grow with a very large corpus.

Whole rows move once. Only (source, hash) of each row is written first; there
ranks are found in ranges of the hash, each ranked by a task of its own, so no
task sees a whole source. That tells at which hash each output task's share of
a source begins, and a row goes straight to its task, together with a short
list of that task's slots, which a window hands to the rows. The result is
partitioned and sorted in schedule order.

At most `MOST_LANES` sources, the largest, are scheduled by themselves. Others,
each a tiny part of so many, share `REST_LANES` lanes by a hash of their names;
a lane has its sources' weights and documents, and the bound holds for it. In
it documents follow in the order of their hashes.

Defined results: a null source is a source of its own, ''; repeated rows are
placed each (rows equal in all columns stay together in one task); weights of
absent sources are ignored; sources without a positive weight follow after all
others, in proportion to their default weights; an empty table gives an empty
result; columns of the input are kept, and the new ones have names of their
own (`mix_*`).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shared_dir, tasks_for

#: Slots in a row of the written schedule, and rows written at once.
SLOTS, WRITE_ROWS = 1000, 500
BLOCK_DOCS, MOST_BLOCKS = 16, 1 << 24
#: Documents of a range of hashes, and most ranges.
BUCKET_DOCS, MOST_BUCKETS = 2_000, 500_000
#: Sources with a lane of their own, and lanes for all others.
MOST_LANES, REST_LANES = 10_000, 1_000
#: Most rows (of about 50 bytes) in the table of where tasks begin that is broadcast; a larger one is joined.
BROADCAST_ROWS = 1_000_000


def exact(weights: list[float]) -> list[int]:
    """Positive weights as integers in exactly the same proportions."""
    parts = [Fraction(w) for w in weights]
    over = lcm(*[f.denominator for f in parts])
    whole = [f.numerator * (over // f.denominator) for f in parts]
    return [x // gcd(*whole) for x in whole]


def schedule(blocks: list[int], weights: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """For each slot (source, block, release, due), earliest deadline first."""
    # ideal service in virtual time v: source k has min(blocks[k], weights[k] v)
    ends = sorted((k for k in range(len(blocks)) if blocks[k]), key=lambda k: Fraction(blocks[k], weights[k]))
    spent, rate, gone, left = [], [], 0, sum(weights[k] for k in ends)
    for k in ends:
        spent.append(gone)
        rate.append(left)
        gone, left = gone + blocks[k], left - weights[k]
    part = [0] * len(blocks)

    def ideal(k: int, i: int) -> tuple[int, int]:
        """The slot time when source k's ideal service reaches i blocks, as
        its floor and ceiling."""
        while i * weights[ends[part[k]]] > blocks[ends[part[k]]] * weights[k]:
            part[k] += 1
        at, rest = divmod(rate[part[k]] * i, weights[k])
        return spent[part[k]] + at, spent[part[k]] + at + (rest > 0)

    done, release, due, after = ([0] * len(blocks) for _ in range(4))
    later: list[tuple[int, int]] = []
    ready: list[tuple[int, int]] = []

    def next_block(k: int) -> None:
        release[k] = after[k]
        after[k], due[k] = ideal(k, done[k] + 1)
        heapq.heappush(later, (release[k], k))

    for k in ends:
        next_block(k)
    for t in range(sum(blocks)):
        while later and later[0][0] <= t:
            k = heapq.heappop(later)[1]
            heapq.heappush(ready, (due[k], k))
        k = heapq.heappop(ready)[1]
        yield k, done[k], release[k], due[k]
        done[k] += 1
        if done[k] < blocks[k]:
            next_block(k)


def _written(spark: SparkSession, runs: list[tuple[list[int], list[int], list[int]]]) -> DataFrame:
    """(mix_lane, mix_block, slot, release, due) of the runs (lanes, blocks,
    weights) one after another."""
    fields = "first long, lane array<int>, block array<long>, release array<long>, due array<long>"
    path, rows, first = shared_dir(spark, "mix-schedule"), [], 0

    def flush() -> None:
        spark.createDataFrame(rows, fields).repartition(max(1, -(-len(rows) // 50))).write.mode("append").parquet(path)
        rows.clear()

    for lanes, blocks, weights in runs:
        origin, part = first, []
        for k, i, release, due in schedule(blocks, weights):
            part.append((lanes[k], i, origin + release, origin + due))
            if len(part) == SLOTS or first + len(part) == origin + sum(blocks):
                rows.append((first, *map(list, zip(*part, strict=True))))
                first, part = first + len(part), []
                if len(rows) == WRITE_ROWS:
                    flush()
    flush()
    one = spark.read.schema(fields).parquet(path).select("first", F.posexplode(F.arrays_zip("lane", "block", "release", "due")).alias("at", "b"))
    return one.select(F.col("b.lane").alias("mix_lane"), F.col("b.block").alias("mix_block"), (F.col("first") + F.col("at")).alias("slot"), "b.release", "b.due")


def _lanes(sizes: DataFrame, weights: Mapping[str, float] | None, alpha: float) -> tuple[list[str], list[int], list[float], list[float]]:
    """The sources with lanes of their own, and of each lane its documents,
    its weight and its default weight."""
    if weights is not None and len(weights) > MOST_LANES:
        raise ValueError(f"more than {MOST_LANES} weights")
    wanted = {str(s): max(0.0, float(w)) for s, w in (weights or {}).items()}
    named = F.col("mix_source").isin(list(wanted)) if wanted else F.lit(False)
    own = sizes.orderBy(named.desc(), F.desc("docs"), "mix_source").limit(MOST_LANES).collect()
    names, docs = [r["mix_source"] for r in own], [r["docs"] for r in own]
    usual = [n**alpha for n in docs]
    given = [wanted.get(s, 0.0) for s in names] if weights is not None else list(usual)
    if len(own) == MOST_LANES:
        known = F.broadcast(sizes.sparkSession.createDataFrame([(s,) for s in names], "mix_source string"))
        rest = sizes.join(known, "mix_source", "left_anti").groupBy(_rest_lane().alias("lane")).agg(F.sum("docs").alias("docs"), F.sum(F.pow("docs", F.lit(alpha))).alias("usual"))
        found = {r["lane"]: r for r in rest.collect()}  # a row for each of REST_LANES
        for k in range(REST_LANES if found else 0):
            docs.append(found[k]["docs"] if k in found else 0)
            usual.append(found[k]["usual"] if k in found else 0.0)
            given.append(usual[-1] if weights is None else 0.0)
    return names, docs, given, usual


def _rest_lane() -> Column:
    return F.pmod(F.xxhash64("mix_source"), F.lit(REST_LANES)).cast("int")


def _bucket(hash_: Column, buckets: Column) -> Column:
    """The range of a hash among `buckets` equal ones, in order."""
    part = (hash_.cast("double") + float(1 << 63)) / float(1 << 64)
    return F.least(F.floor(part * buckets), buckets - 1)


def mix(
    docs: DataFrame, weights: Mapping[str, float] | None = None, *, alpha: float = 0.5, block_docs: int = BLOCK_DOCS, source_col: str = "source", hash_col: str | None = None, tasks: int | None = None
) -> DataFrame:
    """The documents with `mix_position` (their place in the schedule, unique
    and in order, with gaps after a source's short last block), `mix_slot`
    (their block's slot), `mix_rank` (in the source), `mix_release` and
    `mix_due` (slots between which the block must lie), `mix_share` (the
    source's part while all sources with a weight last). Without `weights` a
    source's weight is its number of documents to the power `alpha`. The order
    in a source is by the hash of the row, or by `hash_col`. The result has
    `tasks` partitions, one after another in the order of the schedule."""
    spark = docs.sparkSession
    src = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    # the row goes along as one struct, so its columns' names can clash with none of these
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("mix_row"), src.alias("mix_source"), (F.col(hash_col) if hash_col else F.xxhash64(row)).alias("mix_hash"))
    narrow = cut(keyed.select("mix_source", "mix_hash"), "mix-keys")

    names, found, given, usual = _lanes(narrow.groupBy("mix_source").agg(F.count("*").alias("docs")), weights, alpha)
    total, weight = sum(found), sum(given) or 1.0
    block = max(block_docs, -(-total // MOST_BLOCKS))
    runs = []
    for some, by in (([k for k, w in enumerate(given) if w > 0], given), ([k for k, w in enumerate(given) if w == 0 and found[k]], usual)):
        if some:
            runs.append((some, [-(-found[k] // block) for k in some], exact([by[k] for k in some])))
    slots = _written(spark, runs)
    last = max(1, sum(sum(r[1]) for r in runs))
    tasks = min(tasks or tasks_for(docs), last)

    # a row for each lane: bounded, so broadcast
    size = max(BUCKET_DOCS, -(-total // MOST_BUCKETS))
    own = spark.createDataFrame([(s, k) for k, s in enumerate(names)], "mix_source string, own int")
    lanes = F.broadcast(spark.createDataFrame([(k, n, max(1, -(-n // size)), given[k] / weight) for k, n in enumerate(found)], "mix_lane int, docs long, buckets long, share double"))

    def dealt(rows: DataFrame) -> DataFrame:
        lane = F.coalesce("own", F.lit(len(names)) + _rest_lane()).cast("int")
        at = rows.join(F.broadcast(own), "mix_source", "left").withColumn("mix_lane", lane).drop("own", "mix_source")
        return at.join(lanes.select("mix_lane", "buckets"), "mix_lane").withColumn("mix_bucket", _bucket(F.col("mix_hash"), F.col("buckets"))).drop("buckets")

    # ranks, on lanes and hashes alone
    placed = dealt(narrow)
    before = F.sum("c").over(Window.partitionBy("mix_lane").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1))
    shifts = placed.groupBy("mix_lane", "mix_bucket").agg(F.count("*").alias("c")).withColumn("shift", F.coalesce(before, F.lit(0))).drop("c")
    shifts = cut(shifts, "mix-ranges")
    inside = Window.partitionBy("mix_lane", "mix_bucket").orderBy("mix_hash")
    ranked = placed.withColumns({"nth": F.row_number().over(inside) - 1, "less": F.rank().over(inside) - 1}).join(shifts, ["mix_lane", "mix_bucket"])
    rank = F.col("shift") + F.col("nth")
    firsts = ranked.where(rank % block == 0).select("mix_lane", F.floor(rank / block).alias("mix_block"), "mix_hash", (F.col("shift") + F.col("less")).alias("less"))

    # where each task's share of a lane begins: `least` is its first hash, `start` the rows before it
    task = F.floor(F.col("slot") * tasks / last).cast("int")
    begins = slots.join(firsts, ["mix_lane", "mix_block"]).groupBy("mix_lane", task.alias("mix_task")).agg(F.min("mix_hash").alias("least"), F.min("less").alias("start"))
    until = F.lead("start").over(Window.partitionBy("mix_lane").orderBy("mix_task"))
    begins = begins.withColumn("until", until).join(lanes, "mix_lane").withColumn("until", F.coalesce("until", "docs"))
    begins = cut(begins.select("mix_lane", "mix_task", "least", "start", "until", "share", "buckets"), "mix-begins")
    wanted = begins.where("until > start").withColumn("mix_block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("until") - 1) / block))))
    held = F.sort_array(F.collect_list(F.struct("mix_block", "slot", "release", "due"))).alias("slots")
    heads = wanted.join(slots, ["mix_lane", "mix_block"]).groupBy("mix_task", "mix_lane", "start", "share").agg(held)

    # a row's task: the last one of its lane that begins at its hash or before
    cuts = begins.withColumn("mix_bucket", _bucket(F.col("least"), F.col("buckets")))
    cuts = cuts.groupBy("mix_lane", "mix_bucket").agg(F.collect_list(F.struct("least", "mix_task")).alias("cuts"), F.max("mix_task").alias("upto"))
    earlier = F.last("upto", ignorenulls=True).over(Window.partitionBy("mix_lane").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1))
    look = shifts.join(cuts, ["mix_lane", "mix_bucket"], "left").withColumn("earlier", earlier).select("mix_lane", "mix_bucket", "cuts", "earlier")
    look = F.broadcast(look) if begins.count() + shifts.count() <= BROADCAST_ROWS else look
    here = F.array_max(F.transform(F.filter("cuts", lambda c: c["least"] <= F.col("mix_hash")), lambda c: c["mix_task"]))
    body = dealt(keyed).join(look, ["mix_lane", "mix_bucket"]).select("mix_row", "mix_lane", "mix_hash", F.coalesce(here, "earlier").alias("mix_task"), F.lit(1).alias("mix_kind"))

    rows = body.unionByName(heads.withColumn("mix_kind", F.lit(0)), allowMissingColumns=True).repartitionById(tasks, "mix_task")
    w = Window.partitionBy("mix_task", "mix_lane").orderBy("mix_kind", "mix_hash")
    rows = rows.withColumns({"nth": F.row_number().over(w) - 2, "from": F.first("start").over(w), "at": F.first("slots").over(w), "part": F.first("share").over(w)}).where("mix_kind = 1")
    rank = F.col("from") + F.col("nth")
    one = F.get("at", (F.floor(rank / block) - F.floor(F.col("from") / block)).cast("int"))
    out = rows.select("mix_row", rank.alias("mix_rank"), one.alias("one"), "part")
    return out.select(
        "mix_row.*",
        (F.col("one.slot") * block + F.pmod(F.col("mix_rank"), F.lit(block))).alias("mix_position"),
        F.col("one.slot").alias("mix_slot"),
        "mix_rank",
        F.col("one.release").alias("mix_release"),
        F.col("one.due").alias("mix_due"),
        F.col("part").alias("mix_share"),
    ).sortWithinPartitions("mix_position")
