"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from oddsmill.llm.common import checkpointed


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node on an edge between two different nodes; root is the smallest node it can reach.

    Each step replaces edges by edges to smaller nodes, so the table never grows, and a star of any size is one row per
    leaf. The number of steps grows with the logarithm of the longest chain. Edges with a null end are left out.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(u.alias("u"), v.alias("v")).distinct()
    e = checkpointed(e)
    state = _state(e)
    while state[0]:
        # Large star: every neighbour above a node moves to the smallest of the node and its neighbours.
        both = e.select(F.col("u").alias("n"), F.col("v").alias("m")).union(e.select(F.col("v").alias("n"), F.col("u").alias("m")))
        low = both.groupBy("n").agg(F.least(F.col("n"), F.min("m")).alias("low"))
        large = e.join(low, e["v"] == low["n"]).select("u", F.col("low").alias("v")).distinct()
        # Small star: a node and its neighbours below it move to the smallest of them.
        least = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("low"))
        moved = large.join(least, large["u"] == least["n"]).select(F.col("v").alias("u"), F.col("low").alias("v"))
        small = moved.union(least.select(F.col("n").alias("u"), F.col("low").alias("v"))).where("u != v").distinct()
        e = checkpointed(small)
        after = _state(e)
        if after == state:
            break
        state = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
