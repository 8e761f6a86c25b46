"""Connected components by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): each
step links every node to the least node of its neighbourhood, which keeps the
number of edges from growing and ends after O(log^2 n) steps, in practice a
handful. A step is an aggregate (with partial sums, so a hot node costs one
row for each task) and a join back, which splits skewed keys. Each step's
edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _least(edges: DataFrame) -> DataFrame:
    """(src, m): the least of each src and its neighbours dst."""
    return edges.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    # larger neighbours are linked to the least one
    return both.join(_least(both), "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    m = _least(down)
    linked = down.join(m, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return linked.unionByName(m.select("src", F.col("m").alias("dst"))).where("src <> dst").distinct()


def connected_components(edges: DataFrame, most_steps: int = 60) -> DataFrame:
    """Rows (node, component) of all nodes in `edges` (src, dst, not null);
    the component is its least node. Raises if not done in `most_steps`."""
    now = cut(edges.where("src <> dst").select("src", "dst"), "cc")
    sums = None
    for _ in range(most_steps):
        now = cut(_small_star(_large_star(now)), "cc")
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
        if new == sums:
            break
        sums = new
    else:
        raise RuntimeError(f"components did not settle in {most_steps} steps")
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)
