"""Connected components over an edge table by alternating large-star and small-star contraction.

Each round is two aggregations and two joins over the edges; the neighbour list of a node is never gathered, so a
hub with a third of all edges costs one pre-aggregated minimum and a join whose skewed partition AQE can split.
Rounds are staged to shared storage and the loop reads only two numbers (edge count and an edge checksum) a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitscope.llm._common import staged


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1)))).first()
    return row[0], row[1] or 0


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs, any direction, repeats allowed -> ``(node, root)`` for every node but the roots.

    ``root`` is the least node of the component. Null ends and loops are ignored; an empty table gives no rows.
    """
    edges = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    while state[0]:
        edges = staged(_small_star(_large_star(edges)))
        new = _state(edges)
        if new == state:
            break
        state = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
