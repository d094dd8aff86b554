"""Connected components by alternating large and small stars, all in joins and grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.llm.store import looked_up, written

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    # A sum over exact decimals: the same whatever the order.
    h = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), h).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the (a, b) edges: its component's smallest node.

    Each round sends every larger neighbour of a node to the node's smallest neighbour, then
    every smaller one to the smallest of all; it ends when nothing changes. Rounds are written,
    so lineage stays short. Smallest neighbours are combined before they are shuffled; those of
    hubs are broadcast, so that a hub's edges stay where they are.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = written(edges.select(a, b).where("a <> b").distinct(), "edges")
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n"))
        large = looked_up(both.where("b > a"), written(least, "least"), "a", "n").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = looked_up(large, written(least, "least"), "a", "n").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))
