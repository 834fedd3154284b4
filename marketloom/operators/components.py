"""Connected components of an edge table by alternating large-star and small-star steps."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage

c = F.col
#: A node with this share of the edges is matched by a broadcast; there are two thousand of them at most.
HEAVY_SHARE = 1000


def _with_least(edges: DataFrame, total: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """edges (u, v) with the least of u and its v as m."""
    least = keep(edges.groupBy("u").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("degree")))
    heavy = F.broadcast(least.where(c("degree") * HEAVY_SHARE >= total).select(c("u").alias("hub"), c("least").alias("hub_least")))
    marked = edges.join(heavy, c("u") == c("hub"), "left")
    light = marked.where("hub IS NULL").select("u", "v").join(least.select("u", "least"), "u").select("u", "v", "least")
    found = light.unionByName(marked.where("hub IS NOT NULL").select("u", "v", c("hub_least").alias("least")))
    return found.select("u", "v", F.least("u", "least").alias("m"))


def components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """(node, component) for every node of edges (a, b): the least node that can be reached.

    Each step points the neighbours of a node at the least node known there, so the edges shrink to
    stars in a number of rounds that grows with the logarithm of the size. A least neighbour is a
    map-side combined minimum, never a list, and a hub's edges stay spread over the tasks. `keep`
    writes a table to shared storage. Nulls and loops are ignored."""
    pairs = keep(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def mark(d):
        return tuple(d.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())

    seen = mark(pairs)
    while seen[0]:
        both = pairs.union(pairs.select("v", "u"))
        large = keep(_with_least(both, 2 * seen[0], keep).where("v > u").select(c("v").alias("u"), c("m").alias("v")).distinct())
        small = _with_least(large, max(1, large.count()), keep)
        pairs = keep(small.where("v != m").select(c("v").alias("u"), c("m").alias("v")).union(small.select("u", c("m").alias("v"))).distinct())
        now = mark(pairs)
        if now == seen:
            break
        seen = now
    return pairs.select(c("u").alias("node"), c("v").alias("component")).union(pairs.select(c("v").alias("node"), c("v").alias("component")).distinct())
