"""Breadth-first walks from many starts at once.

Starts are numbered and packed 64 to a block; what a node has been reached from is one long per block,
merged by `bit_or`. So a hop moves one row per node, block and edge, not one per start and edge, and
visited sets are subtracted bit by bit. Single starts appear only where the result is unpacked. The
edges of hubs are split over salts, so no task holds all edges of a node.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .numbering import numbered

c = F.col
#: A node with this share of all edges is a hub (hence a thousand hubs at most), split over so many salts.
HUB_SHARE, SALTS = 1000, 32
BITS = "filter(sequence(0, 63), b -> (shiftright({0}, b) & 1L) = 1L)"


def packed(starts: DataFrame) -> DataFrame:
    """(id, block, bit) of every distinct start."""
    d = numbered(starts.select("id").distinct(), [c("id")])
    return d.select("id", F.expr("index DIV 64").alias("block"), (c("index") % 64).cast("int").alias("bit"))


class Adjacency:
    """Edges (src, tgt, …) kept once, those of hubs dealt out over salts."""

    def __init__(self, edges: DataFrame):
        kept = cut_lineage(edges)
        least = max(kept.count(), HUB_SHARE)
        degree = kept.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
        self.hubs = F.broadcast(cut_lineage(degree.where(c("degree") * HUB_SHARE >= least).select(c("src").alias("hub"))))
        d = kept.join(self.hubs, c("src") == c("hub"), "left")
        salts = F.when(c("hub").isNull(), 1).otherwise(SALTS)
        self.edges = d.withColumn("salt", F.pmod(F.xxhash64("tgt"), salts).cast("int")).drop("hub")

    def along(self, frontier: DataFrame) -> DataFrame:
        """Every edge that leaves a node of the frontier, once for each block, with the frontier's mask."""
        d = frontier.join(self.hubs, c("id") == c("hub"), "left")
        d = d.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(c("hub").isNull(), 0).otherwise(SALTS - 1)))).drop("hub")
        return d.withColumnRenamed("id", "src").join(self.edges, ["src", "salt"]).drop("salt")


def reach(adjacency: Adjacency, starts: DataFrame, depth: int, count_start: bool = False) -> list[DataFrame]:
    """For hop 0, 1, …: (id, block, mask) of the nodes first reached in that hop.

    starts: `packed`. A start counts as reached from the beginning with `count_start`."""
    frontier = starts.select("id", "block", F.expr("shiftleft(1L, bit)").alias("mask"))
    seen = frontier if count_start else frontier.where(F.lit(False))
    hops = [frontier]
    for _ in range(depth):
        step = adjacency.along(frontier).groupBy(c("tgt").alias("id"), "block").agg(F.bit_or("mask").alias("mask"))
        old = seen.groupBy("id", "block").agg(F.bit_or("mask").alias("old"))
        fresh = c("mask").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long"))))
        frontier = cut_lineage(step.join(old, ["id", "block"], "left").select("id", "block", fresh.alias("mask")).where("mask != 0"))
        seen = seen.union(frontier)
        hops.append(frontier)
    return hops


def unpacked(masks: DataFrame, starts: DataFrame, *names: str) -> DataFrame:
    """(start, *names): one row for each bit of the masks."""
    d = masks.withColumn("bit", F.explode(F.expr(BITS.format("mask"))))
    return d.join(starts.withColumnRenamed("id", "start"), ["block", "bit"]).select("start", *names)


def count_bits(masks: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, nodes): how many rows hold each bit, added up by block before single starts appear."""
    sums = [F.sum(F.shiftright("mask", b).bitwiseAND(F.lit(1).cast("long"))) for b in range(64)]
    d = masks.groupBy("block").agg(F.array(*sums).alias("n")).select("block", F.posexplode("n").alias("bit", "nodes"))
    return d.join(starts.withColumnRenamed("id", "start"), ["block", "bit"]).select("start", "nodes")


def tree(edges: DataFrame, starts: DataFrame, depth: int = 2, exclude_start: bool = False) -> DataFrame:
    """Tree edges (start, hop, src, edge, tgt) of the breadth-first walk, every target once per start,
    reached by the least (src, edge) of the hop before."""
    adjacency = Adjacency(edges.select(c("from_id").alias("src"), c("id").alias("edge"), c("to_id").alias("tgt")))
    who = cut_lineage(packed(starts))
    hops = reach(adjacency, who, depth, exclude_start)
    out = None
    for hop in range(1, depth + 1):
        new = hops[hop].select(c("id").alias("tgt"), "block", c("mask").alias("new"))
        via = adjacency.along(hops[hop - 1]).join(new, ["tgt", "block"])
        via = via.withColumn("mask", c("mask").bitwiseAND(c("new"))).where("mask != 0")
        # Grouped by (tgt, block, bit) the rows stay where the join by (tgt, block) has put them.
        bits = via.withColumn("bit", F.explode(F.expr(BITS.format("mask")))).groupBy("tgt", "block", "bit")
        step = bits.agg(F.min(F.struct("src", "edge")).alias("via")).join(who.withColumnRenamed("id", "start"), ["block", "bit"])
        step = step.select("start", F.lit(hop).alias("hop"), "via.src", "via.edge", "tgt")
        out = step if out is None else out.union(step)
    return out


def both_ways(edges: DataFrame) -> DataFrame:
    """Distinct (src, tgt) in both directions."""
    return edges.select(c("from_id").alias("src"), c("to_id").alias("tgt")).union(edges.select("to_id", "from_id")).distinct()


def within(edges: DataFrame, starts: DataFrame, hops: int = 2) -> tuple[list[DataFrame], DataFrame]:
    """Undirected reach by hop, as masks, and the packed starts."""
    who = cut_lineage(packed(starts))
    return reach(Adjacency(both_ways(edges)), who, hops, count_start=True), who


def incident(edges: DataFrame, hops: list[DataFrame]) -> DataFrame:
    """(edge, block, mask): the starts whose nodes an edge touches; the last hop's nodes do not count."""
    ends = edges.select(c("id").alias("edge"), F.explode(F.array("from_id", "to_id")).alias("src"))
    adjacency = Adjacency(ends.select("src", c("edge").alias("tgt")))
    inner = hops[0]
    for d in hops[1:-1]:
        inner = inner.union(d)
    return adjacency.along(inner).groupBy(c("tgt").alias("edge"), "block").agg(F.bit_or("mask").alias("mask"))


def surroundings(edges: DataFrame, starts: DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """Undirected sub-graph: (start, id, hop) of every node within `hops`, and (start, edge) of all edges
    incident to the nodes within hops − 1."""
    masks, who = within(edges, starts, hops)
    marked = [d.withColumn("hop", F.lit(i)) for i, d in enumerate(masks)]
    seen = marked[0]
    for d in marked[1:]:
        seen = seen.union(d)
    return unpacked(seen, who, "id", "hop"), unpacked(incident(edges, masks), who, "edge")
