"""Connected components by alternating stars, as DataFrame jobs.

Large star: every node links its larger neighbours to the smallest node next to it.
Small star: every node links its smaller neighbours to the smallest of them. Repeated,
the edges become stars whose centres are the smallest nodes of the components; the
number of rounds grows with the logarithm of the longest path. A hub is never gathered:
its smallest neighbour is a partial aggregate, and the join that hands it back is one
that Spark can split. Each round is written to the shared folder, so lineage is short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("_m"))
    moved = edges.join(least, "a").where("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return moved.unionByName(least.select("a", F.col("_m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    """Equal for equal edge sets: their number and two sums of hashes."""
    wide = "decimal(38,0)"
    return tuple(
        edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast(wide)), F.sum(F.hash("b", "a").cast(wide))
        ).first()
    )


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component``: every node that has an edge, with the smallest node it reaches.

    Nodes are any orderable type. Edges may repeat, point either way, or be loops; an
    edge with a null end is no edge. A node whose only edges are loops is not returned.
    """
    one, two = F.col(f"`{a}`"), F.col(f"`{b}`")
    now = common.written(
        edges.select(F.greatest(one, two).alias("a"), F.least(one, two).alias("b")).where(one.isNotNull() & two.isNotNull() & (one != two)).distinct(),
        "edges",
    )
    state = _state(now)
    while True:
        now = common.written(_small(_large(now)), "edges")
        state, before = _state(now), state
        if state == before:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
