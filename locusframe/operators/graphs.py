"""Graph measures over edges (src, dst[, weight]) as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import cut
from .stats import div


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct edges a < b without loops."""
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a != b").distinct()


def neighbours(edges: DataFrame) -> DataFrame:
    u = undirected(edges)
    return u.select(F.col("a").alias("node"), F.col("b").alias("other")).union(u.select(F.col("b"), F.col("a")))


def degrees(edges: DataFrame) -> DataFrame:
    """In, out and undirected degree and degree centrality."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i"))
    und = neighbours(edges).groupBy("node").agg(F.count("*").alias("degree"))
    x = out.join(into, "node", "full_outer").join(und, "node", "left").fillna(0)
    n = x.agg(F.count("*").alias("n"))
    return x.crossJoin(F.broadcast(n)).select("node", F.col("o").alias("out_degree"), F.col("i").alias("in_degree"), "degree", div(F.col("degree").cast("double"), F.col("n") - 1).alias("centrality"))


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles (a < b < c). Edges point from the lesser degree on, so wedges at hubs stay few."""
    u = undirected(edges)
    deg = neighbours(edges).groupBy("node").agg(F.count("*").alias("d"))
    x = u.join(deg.select(F.col("node").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("node").alias("b"), F.col("d").alias("db")), "b")
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    x = x.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("p"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("q"))
    w = x.alias("x").join(x.select(F.col("p").alias("p2"), F.col("q").alias("r")), F.col("p") == F.col("p2")).where("q < r").select("p", "q", "r")
    t = w.join(u, (F.col("q") == F.col("a")) & (F.col("r") == F.col("b"))).select(F.array_sort(F.array("p", "q", "r")).alias("t"))
    return t.select(F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c"))


def clustering(edges: DataFrame) -> DataFrame:
    """Triangles and local clustering coefficient of each node; 0 under degree 2."""
    t = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    d = neighbours(edges).groupBy("node").agg(F.count("*").alias("k"))
    return d.join(t, "node", "left").fillna(0).select("node", "triangles", div(2.0 * F.col("triangles"), F.col("k") * (F.col("k") - 1)).alias("clustering"))


def similar_nodes(edges: DataFrame) -> DataFrame:
    """Common neighbours, Jaccard and Adamic-Adar of pairs that share a neighbour."""
    n = neighbours(edges)
    d = n.groupBy("node").agg(F.count("*").alias("k"))
    x = n.join(d.select(F.col("node").alias("other"), F.col("k").alias("ko")), "other")
    p = x.select("other", F.col("node").alias("a"), "ko").join(n.select("other", F.col("node").alias("b")), "other").where("a < b")
    p = p.groupBy("a", "b").agg(F.count("*").alias("common"), F.sum(F.when(F.col("ko") > 1, 1 / F.ln(F.col("ko").cast("double"))).otherwise(0.0)).alias("adamic_adar"))
    p = p.join(d.select(F.col("node").alias("a"), F.col("k").alias("ka")), "a").join(d.select(F.col("node").alias("b"), F.col("k").alias("kb")), "b")
    return p.select("a", "b", "common", (F.col("common") / (F.col("ka") + F.col("kb") - F.col("common"))).alias("jaccard"), "adamic_adar")


def page_rank(edges: DataFrame, rounds: int, damping: float = 0.85) -> DataFrame:
    """PageRank of directed edges after a fixed number of rounds; dangling mass is spread evenly. Lineage is cut every three."""
    e = cut(edges.select("src", "dst").distinct())
    nodes = cut(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())
    n = nodes.count()
    out = e.groupBy(F.col("src").alias("s")).agg(F.count("*").alias("k"))
    e = e.join(out, F.col("src") == F.col("s")).select("src", "dst", "k")
    rank = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    dangling = nodes.join(out, F.col("node") == F.col("s"), "left_anti").select(F.col("node").alias("_d"))
    for i in range(rounds):
        flow = e.join(rank, e.src == rank.node).groupBy("dst").agg(F.sum(F.col("rank") / F.col("k")).alias("f"))
        lost = rank.join(dangling, F.col("node") == F.col("_d"), "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        rank = nodes.join(flow, F.col("node") == F.col("dst"), "left").crossJoin(lost).select("node", ((1 - damping) / n + damping * (F.coalesce("f", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        if i % 3 == 2:
            rank = cut(rank)
    return rank


def bfs(edges: DataFrame, start, rounds: int | None = None) -> DataFrame:  # noqa: ANN001
    """Undirected hop distance from one node to all that it reaches, or up to `rounds` hops.

    A node's neighbours are at most one hop nearer or farther, so a new frontier is held against the last two only.
    """
    n = cut(neighbours(edges))
    before = last = n.where(F.col("node") == start).select("node").distinct().withColumn("distance", F.lit(0))
    seen, i = last, 0
    while rounds is None or i < rounds:
        i += 1
        edge = last.join(n, "node").select(F.col("other").alias("node")).distinct()
        edge = cut(edge.join(before.union(last), "node", "left_anti").withColumn("distance", F.lit(i)))
        if edge.isEmpty():
            break
        before, last, seen = last, edge, seen.union(edge)
        if i % 16 == 0:
            seen = cut(seen)
    return seen


def components(edges: DataFrame) -> DataFrame:
    """Components (id, component) of undirected edges (a, b), named by their smallest id; ids without an edge are absent.

    Alternating large-star and small-star rounds until the edges stay the same.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    check = (F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)))
    state, now = None, e.agg(*check).first()
    while now != state:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v"))).distinct()
        e = cut(small)
        state, now = now, e.agg(*check).first()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def label_components(edges: DataFrame) -> DataFrame:
    """Smallest node id of each node's component, whatever its diameter."""
    return components(undirected(edges)).select(F.col("id").alias("node"), "component")


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Newman's modularity of labels(node, label) on the undirected graph."""
    u = undirected(edges)
    x = u.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
    m = u.agg(F.count("*").alias("m"))
    inner = x.where("la = lb").groupBy(F.col("la").alias("label")).agg(F.count("*").alias("e"))
    deg = neighbours(edges).join(labels, "node").groupBy("label").agg(F.count("*").alias("d"))
    return deg.join(inner, "label", "left").crossJoin(F.broadcast(m)).agg(F.sum(F.coalesce("e", F.lit(0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("modularity"))


def random_walk(edges: DataFrame, seeds: DataFrame, rounds: int, restart: float, tolerance: float = 0.0) -> DataFrame:
    """Random walk with restart from seeds(node), row-normalised, until no node moves by more than tolerance, for at most `rounds`.

    Lineage is cut every three rounds.
    """
    n = neighbours(edges)
    d = n.groupBy("node").agg(F.count("*").alias("k"))
    n = cut(n.join(d, "node"))
    s = d.select("node").join(seeds.select(F.col("node").alias("_s")).distinct(), F.col("node") == F.col("_s"), "left").withColumn("w", F.when(F.col("_s").isNotNull(), 1.0).otherwise(0.0))
    base = cut(s.crossJoin(F.broadcast(s.agg(F.sum("w").alias("_t")))).select("node", div(F.col("w"), F.col("_t")).alias("p0")))
    p = base.select("node", F.col("p0").alias("p"))
    for i in range(rounds):
        flow = n.join(p, "node").groupBy(F.col("other").alias("node")).agg(F.sum(F.col("p") / F.col("k")).alias("f"))
        after = base.join(flow, "node", "left").select("node", ((1 - restart) * F.coalesce("f", F.lit(0.0)) + restart * F.col("p0")).alias("p"))
        if i % 3 == 2 or tolerance:
            after = cut(after)
        if tolerance and (after.join(p.withColumnRenamed("p", "_p"), "node").agg(F.max(F.abs(F.col("p") - F.col("_p")))).first()[0] or 0.0) <= tolerance:
            return after
        p = after
    return p


def moran(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """Moran's I and Geary's C of points(id, x) with binary weights on directed pairs(src, dst)."""
    z = points.crossJoin(F.broadcast(points.agg(F.avg("x").alias("_m")))).withColumn("z", F.col("x") - F.col("_m"))
    total = z.agg(F.count("*").alias("n"), F.sum(F.col("z") * F.col("z")).alias("ss"))
    p = pairs.join(z.select(F.col("id").alias("src"), F.col("z").alias("a")), "src").join(z.select(F.col("id").alias("dst"), F.col("z").alias("b")), "dst")
    s = p.agg(F.count("*").alias("w"), F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.pow(F.col("a") - F.col("b"), 2)).alias("d2"))
    return s.crossJoin(total).select(div(F.col("n") * F.col("ab"), F.col("w") * F.col("ss")).alias("moran_i"), div((F.col("n") - 1) * F.col("d2"), 2 * F.col("w") * F.col("ss")).alias("geary_c"))
