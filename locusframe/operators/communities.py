"""Communities of weighted graphs by local moving and aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import cut


def _weighted_modularity(e: DataFrame, place: DataFrame, total: float) -> float:
    """Modularity of place(node, c) on e(a, b, w), both directions and loops (a loop once, with twice its weight)."""
    x = e.join(place.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(place.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b")
    own = x.groupBy("ca").agg(F.sum("w").alias("d"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("i"))
    return own.agg(F.sum(F.col("i") / total - F.pow(F.col("d") / total, 2))).first()[0] or 0.0


def louvain(edges: DataFrame, rounds: int = 12, levels: int = 8, least: float = 1e-6) -> DataFrame:
    """Communities (node, community) of the undirected graph of edges (src, dst[, weight]), named by their smallest node.

    Each round half of the nodes, by a hash of node and round, move to the neighbouring community
    of the greatest gain in modularity, ties to the smallest name, if that gain is positive; the
    best placement seen is kept. When no round of a level is better by `least`, communities become
    the nodes of the next level, which are joined in turn until nothing is gained. A round is joins and grouped sums;
    lineage is cut in each.
    """
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    e = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), weight.alias("w")).groupBy("a", "b").agg(F.sum("w").alias("w"))
    e = cut(e.select("a", "b", F.when(F.col("a") == F.col("b"), 2 * F.col("w")).otherwise(F.col("w")).alias("w")).union(e.where("a != b").select("b", "a", "w")))
    total = e.agg(F.sum("w")).first()[0]
    nodes = cut(e.select(F.col("a").alias("node")).distinct())
    if not total:
        return nodes.select("node", F.col("node").alias("community"))
    final = nodes.select("node", F.col("node").alias("community"))
    score = _weighted_modularity(e, nodes.select("node", F.col("node").alias("c")), total)
    for _ in range(levels):
        degree = cut(e.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")))
        best = place = cut(degree.select("node", F.col("node").alias("c"), "k"))
        top, stale = score, 0
        for i in range(rounds):
            inside = place.groupBy("c").agg(F.sum("k").alias("d"))
            near = e.where("a != b").join(place.select(F.col("node").alias("b"), "c"), "b").groupBy(F.col("a").alias("node"), "c").agg(F.sum("w").alias("to"))
            near = near.union(place.select("node", "c", F.lit(0.0)))  # staying is a choice even without a link
            near = near.groupBy("node", "c").agg(F.sum("to").alias("to")).join(inside, "c").join(place.select("node", F.col("c").alias("now"), "k"), "node")
            others = F.col("d") - F.when(F.col("c") == F.col("now"), F.col("k")).otherwise(0.0)
            gain = F.col("to") - F.col("k") * others / total
            choice = near.groupBy("node").agg(F.max_by("c", F.struct(F.round(gain, 9), F.col("c") == F.col("now"), -F.col("c"))).alias("next"))
            moving = F.pmod(F.xxhash64("node", F.lit(i)), F.lit(2)) == 0
            place = cut(place.join(choice, "node").select("node", F.when(moving, F.col("next")).otherwise(F.col("c")).alias("c"), "k"))
            now = _weighted_modularity(e, place, total)
            if now > top + least:
                best, top, stale = place, now, 0
            elif (stale := stale + 1) == 3:
                break
        if top <= score + least:
            break
        score = top
        named = cut(best.join(best.groupBy("c").agg(F.min("node").alias("name")), "c").select("node", "name"))
        final = cut(final.join(named.select(F.col("node").alias("community"), "name"), "community").select("node", F.col("name").alias("community")))
        e = e.join(named.select(F.col("node").alias("a"), F.col("name").alias("na")), "a").join(named.select(F.col("node").alias("b"), F.col("name").alias("nb")), "b")
        e = cut(e.groupBy(F.col("na").alias("a"), F.col("nb").alias("b")).agg(F.sum("w").alias("w")))
    return final
