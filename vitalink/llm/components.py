"""Connected components of a graph given as an edge table, without collecting any group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of the component of each node that has an edge.

    ``edges`` has two long columns ``a`` and ``b``.  Alternates the large-star and small-star steps (Kiveris et al.,
    2014): each sends the neighbours of a node to its smallest neighbour, by a partial aggregate and a join, so that
    a node with very many neighbours is dealt out like any other skewed join.  Edges with a null end are ignored.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    seen = None
    for _ in range(rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "u")
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        hung = large.join(least, F.col("a") == F.col("u"))
        small = hung.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("u", "m")).distinct()
        now = cut(small)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
