"""Distributions and learning over lineitem, events, embeddings and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusframe.functions import distributions as D
from locusframe.operators import learning as L
from locusframe.operators import stats as S
from locusframe.operators import vectors as V

from .registry import query, table
from .sequence_queries import sequences
from .stats_queries import R, pair
from .vector_graph_queries import EDGES, EMB, NEXT, SQ, edges, vectors


@query()
def p_values(spark, d):
    t = S.two_samples(pair(spark, d), "v", "g", ["l_suppkey"])
    return R(t.select("l_suppkey", D.column(D.t_p)("welch_t", "welch_df").alias("p_welch"), D.column(D.normal_p)("welch_t").alias("p_normal")))


@query("""with r as (select l_suppkey, l_returnflag, rank() over (partition by l_suppkey order by l_quantity) + (count(*) over (partition by l_suppkey, l_quantity) - 1) / 2 as r from lineitem),
 t as (select l_suppkey, l_returnflag, count(*) as n, sum(r) as r from r group by 1, 2), s as (select l_suppkey, count(*) as k, sum(n) as n, sum(r * r / n) as s from t group by 1)
 select l_suppkey, round(case when k = 3 then least(1, exp(-(12 / (n * (n + 1)) * s - 3 * (n + 1)) / 2)) end, 6) as p from s""")
def chi_squared_p_values(spark, d):
    x = S.kruskal(table(spark, d, "lineitem"), "l_quantity", "l_returnflag", ["l_suppkey"])
    return R(x.select("l_suppkey", D.column(D.chi2_p)("h", "df").alias("p")))


_CHOOSE = "lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1)"


@query(f"""with n as (select count(*) as t, count(*) filter (p_retailprice > 950) as h from part), g as (select p_brand, count(*) as d, count(*) filter (p_retailprice > 950) as k from part group by 1), i as (select p_brand, d, h, t, unnest(range(greatest(k, d + h - t, 0), least(d, h) + 1)) as i from g, n)
 select p_brand, round(least(1, sum(exp({_CHOOSE.format(n='h', k='i')} + {_CHOOSE.format(n='(t - h)', k='(d - i)')} - ({_CHOOSE.format(n='t', k='d')})))), 9) as p from i group by 1""")
def hypergeometric_enrichment(spark, d):
    x = table(spark, d, "part").withColumn("hit", F.col("p_retailprice") > 950)
    n = x.agg(F.count("*").alias("total"), F.count_if("hit").alias("hits"))
    g = x.groupBy("p_brand").agg(F.count("*").alias("drawn"), F.count_if("hit").alias("k")).crossJoin(F.broadcast(n))
    return R(g.select("p_brand", D.column(D.hypergeometric_tail)("k", "drawn", "hits", "total").alias("p")), 9)


@query()
def principal_component_scores(spark, d):
    scores, _ = L.principal_components(vectors(spark, d).select("id", "v"), 3)
    return scores.select("id", F.transform("pc", lambda x: F.round(F.abs(x), 5)).alias("pc"))


@query()
def forest_predictions(spark, d):
    x = L.folds(vectors(spark, d), 5)
    return L.classify(x.where("fold != 0"), x.where("fold = 0"), "forest", numTrees=10, maxDepth=4)


@query()
def tree_predictions(spark, d):
    x = L.folds(vectors(spark, d), 5)
    return L.classify(x.where("fold != 0"), x.where("fold = 0"), "tree", maxDepth=4)


@query(f"""with recursive {EMB}, near as (select a.id, b.id as other from e a join e b on a.label = b.label and a.id <> b.id where sqrt({SQ}) <= 1.15), k as (select id from near group by 1 having count(*) + 1 >= 4),
 i as (select r.id, r.other from near r where r.id in (select id from k) and r.other in (select id from k)), l as (select id, id as c from k union select i.other, l.c from l join i on i.id = l.id), l1 as (select id, min(c) as c from l group by 1),
 b as (select r.id, min(l1.c) as c from near r join l1 on l1.id = r.other where r.id not in (select id from k) group by 1), f as (select id, c from l1 union all select id, c from b) select e.id, coalesce(c, -1) as cluster from e left join f on f.id = e.id""")
def dbscan_clusters(spark, d):
    x = vectors(spark, d)
    return L.dbscan_vectors(x, ["label"], 1.15, 4)


def _vote(k: int) -> str:
    return f"v{k} as (select n.node, l.label, count(*) as k from n join l{k - 1} l on l.node = n.other group by 1, 2), r{k} as (select *, row_number() over (partition by node order by k desc, label) as r from v{k}), l{k} as (select node, label from r{k} where r = 1)"


@query(f"with {EDGES}, {NEXT}, l0 as (select node, node as label from k), {', '.join(map(_vote, range(1, 5)))} select node, label from l4")
def community_labels(spark, d):
    return L.label_propagation(edges(spark, d), 4)


@query(f"""with recursive {EDGES}, {NEXT}, r as (select node, other, 0 as i from n union all select node, other, i + 1 from (select *, count(*) over (partition by node) as d, count(*) over (partition by other) as e, 0 as one from r) x
 where d >= 8 and e >= 8 and (select min(c) from (select count(*) as c from r group by node)) < 8), f as (select node, count(*) as degree from r where i = (select max(i) from r) group by 1) select * from f where (select min(degree) from f) >= 8""")
def core_nodes(spark, d):
    return L.k_core(edges(spark, d), 8)


@query("""with n as (select count(*) as n from lineitem), w as (select -sum(k / n * log2(k / n)) as h from (select count(*) as k from lineitem group by l_returnflag), n), c as (select l_linestatus, l_returnflag, count(*) as k from lineitem group by 1, 2),
 m as (select *, sum(k) over (partition by l_linestatus) as m from c), r as (select -sum(k / n * log2(k / m)) as r from m, n) select round(h - r, 7) as gain from w, r""")
def information_gain(spark, d):
    return R(L.entropy_gain(table(spark, d, "lineitem"), "l_linestatus", "l_returnflag"), 7)


@query()
def hidden_states(spark, d):
    at, gc = {"A": 0.3, "T": 0.3, "C": 0.2, "G": 0.2}, {"A": 0.2, "T": 0.2, "C": 0.3, "G": 0.3}
    x = L.viterbi(sequences(spark, d), [0.5, 0.5], [[0.95, 0.05], [0.05, 0.95]], [at, gc])
    return x.select("id", F.size(F.filter("path", lambda s: s == 1)).alias("gc_states"), F.round("log_probability", 4).alias("log_probability"), F.round("log_likelihood", 4).alias("log_likelihood"))
