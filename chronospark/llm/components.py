"""Connected components of a graph of links, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"] or 0


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smallest neighbour (itself included) to its larger neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = both.where(F.col("v") > F.col("u")).join(least, "u")
    return larger.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smallest smaller neighbour to itself and to its other smaller neighbours. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that is reachable, for every node that has a link.

    ``edges`` has two long columns u and v. Alternating large-star and small-star rounds; each round's edges are
    checkpointed, so a lost executor costs one round at most. The number of edges never grows. Links of a node to
    itself, repeated links and both directions are allowed. An empty table gives an empty table. It raises an
    error if ``max_rounds`` doesn't suffice (the rounds grow with the logarithm of the longest chain).
    """
    ordered = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = checkpointed(ordered)
    state = _state(now)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        now = checkpointed(_small_star(_large_star(now)))
        before, state = state, _state(now)
        if before == state:
            break
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
