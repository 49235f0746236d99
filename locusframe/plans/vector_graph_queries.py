"""Vectors from embeddings, graphs from orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusframe.operators import graphs as G
from locusframe.operators import vectors as V

from .registry import query, table
from .stats_queries import R

EMB = "e as (select vec_id as id, list_transform(embedding, lambda x: x::double) as v, label from embeddings)"
SQ = "list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - b.v[i]) ** 2))"


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


@query(f"""with {EMB} select a.label, a.id as id_a, b.id as id_b, round(sqrt({SQ}), 6) as euclidean, round(list_sum(list_transform(range(1, 65), lambda i: abs(a.v[i] - b.v[i]))), 6) as manhattan,
 round(list_max(list_transform(range(1, 65), lambda i: abs(a.v[i] - b.v[i]))), 6) as chebyshev, round(1 - list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i])) / sqrt(list_sum(list_transform(a.v, lambda x: x * x)) * list_sum(list_transform(b.v, lambda x: x * x))), 6) as cosine
 from e a join e b on a.label = b.label and a.id < b.id""")
def pairwise_distances(spark, d):
    return R(V.pairwise(vectors(spark, d), ["euclidean", "manhattan", "chebyshev", "cosine"], ["label"]))


@query(f"""with {EMB}, p as (select a.id, b.id as neighbour, sqrt({SQ}) as distance from e a join e b on a.label = b.label and a.id <> b.id), r as (select *, row_number() over (partition by id order by distance, neighbour) as rank from p)
 select id, neighbour, cast(rank as int) as rank, round(distance, 6) as distance from r where rank <= 5""")
def knn_neighbours(spark, d):
    x = vectors(spark, d)
    return R(V.knn_join(x, x, 5, ["label"]))


@query(f"with {EMB}, x as (select label, unnest(range(0, 64)) as dim, unnest(v) as x from e) select label, cast(dim as int) as dim, round(avg(x), 6) as mean from x group by 1, 2")
def label_centroids(spark, d):
    return R(V.centroids(vectors(spark, d), "label"))


@query(f"""with {EMB}, p as (select a.id, a.label as l, b.label as m, avg(sqrt({SQ})) as d from e a join e b on a.id <> b.id group by 1, 2, 3), s as (select id, max(d) filter (l = m) as a, min(d) filter (l <> m) as b from p group by 1)
 select id, round((b - a) / greatest(a, b), 6) as silhouette from s""")
def silhouette_scores(spark, d):
    return R(V.silhouette(vectors(spark, d), "label"))


def _means(k: int) -> str:
    return f"""d{k} as (select a.id, a.v, b.label, {SQ} as q from e a cross join c{k - 1} b), p{k} as (select *, row_number() over (partition by id order by q, label) as r from d{k}),
u{k} as (select label, unnest(range(0, 64)) as dim, unnest(v) as x from p{k} where r = 1), m{k} as (select label, dim, avg(x) as x from u{k} group by 1, 2), c{k} as (select label, list(x order by dim) as v from m{k} group by 1)"""


@query(f"""with {EMB}, c0 as (select id as label, v from e where id < 8), {_means(1)}, {_means(2)}, {_means(3)}, f as (select a.id, b.label, {SQ} as q from e a cross join c3 b), r as (select *, row_number() over (partition by id order by q, label) as r from f)
 select label, count(*) as n, round(sum(q), 5) as inertia from r where r = 1 group by 1""")
def kmeans_clusters(spark, d):
    x = vectors(spark, d)
    seeds = x.where("id < 8").select(F.col("id").alias("label"), F.col("v").alias("c"))
    placed, _ = V.kmeans(x.select("id", "v"), seeds, 3)
    return R(placed.groupBy("label").agg(F.count("*").alias("n"), F.sum("squared").alias("inertia")), 5)


@query(f"""with {EMB}, p as (select a.id from e a join e b on a.label = b.label and a.id <> b.id where sqrt({SQ}) <= 1.2) select e.id, count(p.id) + 1 as neighbours, count(p.id) + 1 >= 5 as core from e left join p on e.id = p.id group by 1""")
def density_core_points(spark, d):
    x = vectors(spark, d)
    return V.density_core(x, ["label"], 1.2, 5)


@query("""with j as (select l_returnflag as a, l_linestatus as b, count(*) as j from lineitem group by 1, 2), n as (select count(*) as n from lineitem), x as (select *, sum(j) over (partition by a) as ra, sum(j) over (partition by b) as rb from j, n),
 m as (select sum(j / n * ln(j * n / (ra * rb))) as mi from x), ea as (select -sum(k / n * ln(k / n)) as h from (select count(*) as k from lineitem group by l_returnflag), n), eb as (select -sum(k / n * ln(k / n)) as h from (select count(*) as k from lineitem group by l_linestatus), n)
 select round(mi, 7) as mi, round(ea.h, 6) as entropy_a, round(eb.h, 6) as entropy_b, round(2 * mi / (ea.h + eb.h), 7) as nmi from m, ea, eb""")
def mutual_information(spark, d):
    x = V.mutual_information(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")
    return x.select(F.round("mi", 7).alias("mi"), F.round("entropy_a", 6).alias("entropy_a"), F.round("entropy_b", 6).alias("entropy_b"), F.round("nmi", 7).alias("nmi"))


EDGES = "g as (select distinct l_suppkey as src, l_suppkey + l_linenumber * l_linenumber as dst from lineitem)"
NEXT = "u as (select distinct least(src, dst) as a, greatest(src, dst) as b from g where src <> dst), n as (select a as node, b as other from u union all select b, a from u), k as (select node, count(*) as k from n group by 1)"


def edges(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_suppkey") + F.col("l_linenumber") * F.col("l_linenumber")).alias("dst")).distinct()


@query(f"""with {EDGES}, {NEXT}, v as (select src as node from g union select dst from g) select v.node, (select count(*) from g where src = v.node) as out_degree, (select count(*) from g where dst = v.node) as in_degree, coalesce(k, 0) as degree,
 round(coalesce(k, 0) / ((select count(*) from v) - 1), 6) as centrality from v left join k on v.node = k.node""")
def degree_centrality(spark, d):
    return R(G.degrees(edges(spark, d)))


TRI = "t as (select x.a, x.b, y.b as c from u x join u y on x.b = y.a join u z on z.a = x.a and z.b = y.b)"


@query(f"with {EDGES}, {NEXT}, {TRI} select a, b, c from t")
def triangle_list(spark, d):
    return G.triangles(edges(spark, d))


@query(f"with {EDGES}, {NEXT}, {TRI}, c as (select node, count(*) as t from (select a as node from t union all select b from t union all select c from t) group by 1) select k.node, coalesce(t, 0) as triangles, round(case when k > 1 then 2.0 * coalesce(t, 0) / (k * (k - 1)) else 0 end, 6) as clustering from k left join c on k.node = c.node")
def clustering_coefficient(spark, d):
    return R(G.clustering(edges(spark, d)))


@query(f"""with {EDGES}, {NEXT}, p as (select x.node as a, y.node as b, count(*) as common, sum(case when k > 1 then 1 / ln(k) else 0 end) as aa from n x join n y on x.other = y.other and x.node < y.node join k on k.node = x.other group by 1, 2)
 select a, b, common, round(common / (ka.k + kb.k - common), 6) as jaccard, round(aa, 6) as adamic_adar from p join k ka on ka.node = a join k kb on kb.node = b""")
def neighbour_similarity(spark, d):
    return R(G.similar_nodes(edges(spark, d)))


def _ranks(k: int) -> str:
    return f"""l{k} as (select coalesce(sum(rank), 0) as lost from r{k - 1} where node not in (select src from g)), f{k} as (select dst, sum(rank / o.k) as f from g join r{k - 1} r on r.node = g.src join o on o.src = g.src group by 1),
r{k} as (select v.node, 0.15 / (select count(*) from v) + 0.85 * (coalesce(f, 0) + lost / (select count(*) from v)) as rank from v left join f{k} on v.node = dst, l{k})"""


@query(f"""with {EDGES}, v as (select src as node from g union select dst from g), o as (select src, count(*) as k from g group by 1), r0 as (select node, 1.0::double / (select count(*) from v) as rank from v), {', '.join(_ranks(i) for i in range(1, 7))} select node, round(rank, 9) as rank from r6""")
def page_rank(spark, d):
    return R(G.page_rank(edges(spark, d), 6), 9)


@query(f"""with recursive {EDGES}, {NEXT}, b as (select cast(1 as bigint) as node, 0 as distance union select n.other, distance + 1 from b join n on n.node = b.node where distance < (select count(*) from k)) select node, min(distance) as distance from b group by 1""")
def breadth_first_search(spark, d):
    return G.bfs(edges(spark, d), 1)


EV = "g as (select distinct user_id as src, 1000 + cast(floor(value) as bigint) as dst from events)"


@query(f"""with recursive {EV}, {NEXT}, b as (select node, node as c from k union select n.other, c from b join n on n.node = b.node) select node, min(c) as component from b group by 1""")
def connected_components(spark, d):
    x = table(spark, d, "events").select(F.col("user_id").alias("src"), (F.lit(1000) + F.floor("value")).cast("long").alias("dst")).distinct()
    return G.label_components(x)


@query(f"""with {EDGES}, {NEXT}, m as (select count(*) as m from u), i as (select a % 4 as l, count(*) as e from u where a % 4 = b % 4 group by 1), dd as (select node % 4 as l, count(*) as d from n group by 1) select round(sum(coalesce(e, 0) / m - (d / (2 * m)) ** 2), 8) as modularity from dd left join i using (l), m""")
def graph_modularity(spark, d):
    g = edges(spark, d)
    labels = G.neighbours(g).select("node").distinct().withColumn("label", F.col("node") % 4)
    return R(G.modularity(g, labels), 8)


def _walk(k: int) -> str:
    return f"p{k} as (select b.node, 0.6 * coalesce(f, 0) + 0.4 * p0 as p from b left join (select n.other as node, sum(p / k.k) as f from n join p{k - 1} using (node) join k using (node) group by 1) using (node))"


@query(f"with {EDGES}, {NEXT}, b as (select node, case when node in (1, 2, 3) then 1.0::double / (select count(*) from k where node in (1, 2, 3)) else 0 end as p0 from k), p0 as (select node, p0 as p from b), {', '.join(_walk(i) for i in range(1, 6))} select node, round(p, 8) as p from p5")
def random_walk_restart(spark, d):
    return R(G.random_walk(edges(spark, d), spark.createDataFrame([(1,), (2,), (3,)], "node long"), 5, 0.4), 8)


@query(f"""with {EDGES}, z as (select s_suppkey as id, s_acctbal - avg(s_acctbal) over () as z from supplier), p as (select x.z as a, y.z as b from g join z x on x.id = src join z y on y.id = dst), t as (select count(*) as n, sum(z * z) as ss from z), s as (select count(*) as w, sum(a * b) as ab, sum((a - b) ** 2) as d2 from p)
 select round(n * ab / (w * ss), 8) as moran_i, round((n - 1) * d2 / (2 * w * ss), 8) as geary_c from s, t""")
def spatial_autocorrelation(spark, d):
    return R(G.moran(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x")), edges(spark, d)), 8)
