"""Connected components by alternating star contractions; no node's neighbours are ever gathered in one place.

Each round replaces the edges by stars around ever smaller node numbers. Minima over neighbours are aggregates
(combined before the shuffle). The rewiring is a join on the node; the minima come from a stage of their own
(apart_keys), so that both of the join's sides are plain shuffles, which Spark splits where a node is hot.
Rounds end when the edges are stars around their least nodes. Each half of a round is a table in the shared folder: as one
plan the second half held the first four times over, and the driver kept and planned that anew after each of its stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart_keys, cut, drop

MAX_ROUNDS = 60


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u > v) are stars around their least nodes: nothing points at two nodes, or is pointed at and points on."""
    end = lambda node, out: F.struct(F.col(node).alias("node"), F.lit(out).alias("out"), F.lit(1 - out).alias("hit"))
    ends = edges.select(F.inline(F.array(end("u", 1), end("v", 0))))
    return not ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("hit").alias("hit")).where("out > 1 or out > 0 and hit > 0").limit(1).count()


def both_ways(edges: DataFrame) -> DataFrame:
    """Each of edges (u, v) as (u, v) and (v, u), in one scan."""
    return edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point the larger (large) or smaller neighbours of each node, and the node, at the least node of its star."""
    both = both_ways(edges) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = apart_keys(both, ["u"], F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node with an edge in edges (u long, v long).

    Empty edges give no rows; loops and repeated edges change nothing.
    """
    edges = cut(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        if _settled(edges):
            break
        for large in (True, False):
            last, edges = edges, cut(_star(edges, large), "edges")
            drop(last)
    else:
        raise RuntimeError("components did not settle")
    star = [F.struct(F.col(x).alias("node"), F.col("v").alias("component")) for x in "uv"]
    return edges.select(F.inline(F.array(*star))).distinct()
