"""Connected components over an edge table by alternating large-star and small-star steps.

The steps are those of Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Every
step keeps at most one edge per edge it got, so the table never grows, and a hub's edges meet only in
sort-merge joins (which adaptive execution splits) and in partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_table


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """The component of each node that has an edge: rows ``(node, component)``, component = least node.

    ``edges`` has two columns of one orderable type; order, repeats, loops and rows with a null do not
    matter. No edges: no rows. Each round is written to the shared folder before it is read twice.
    """
    a, b = edges.columns
    now = as_table(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") > F.col("b")))
        .distinct(),
        "edges",
    )
    mark = None
    for _ in range(max_rounds):
        before, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        now = as_table(_small_star(_large_star(now)), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
