"""Connected components of an edge list, by DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoform.llm._spark import written

#: Nodes whose minima are broadcast at most: those with more than 2 * edges / HEAVY edges.
HEAVY = 10_000


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of (a, b) edges; a component is named by its least node.

    Alternates two steps that keep components and shorten paths: every larger
    neighbour of a node is tied to the node's least neighbour, then every smaller one
    is. Minima are combined before they are shuffled. Edges meet the minima of their
    nodes by a join; the edges of a node with very many stay where they are, and its
    minimum is broadcast (as 2 E ends of edges are shared out, at most HEAVY nodes have
    more than 2 E / HEAVY). The edges of each round are a written table. The result is
    a set of stars once a round changes nothing, after a number of rounds that grows
    as the logarithm of the longest path. Null nodes are no nodes; repeated edges and
    edges of a node with itself change nothing.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    mark = _mark(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        most = max(1000, 2 * mark[0] // HEAVY)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, most).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        small = _with_least(large, most)
        now = written(small.select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).distinct(), "edges")
        before, mark = mark, _mark(now)
        if before == mark:
            break
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _with_least(edges: DataFrame, most: int) -> DataFrame:
    """(u, v) edges with m, the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("_n"))
    heavy = least.where(F.col("_n") > most).select("u", F.col("m").alias("_m"))
    met = edges.join(F.broadcast(heavy), "u", "left")
    rest = met.where("_m is null").select("u", "v").join(least.where(F.col("_n") <= most).select("u", "m"), "u")
    return met.where("_m is not null").select("u", "v", F.col("_m").alias("m")).unionByName(rest.select("u", "v", "m"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)).first())
