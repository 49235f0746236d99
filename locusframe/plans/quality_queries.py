"""Read trimming, sketches and cell filters over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusframe.operators import omics as O
from locusframe.operators import quality as Q
from locusframe.operators import communities as C
from locusframe.operators import sequences as N
from locusframe.operators import stats as S
from locusframe.operators import trees as T
from locusframe.operators import vectors as V
from locusframe.operators.staging import folder

from .omics_queries import CELL, ERF, cells
from .registry import query, table
from .sequence_queries import DNA, LETTERS, SEQ, sequences
from .stats_queries import R
from .vector_graph_queries import EMB, edges, vectors

QUAL = "r as (select l_orderkey as id, list(cast(l_quantity as int) order by l_linenumber, l_partkey, l_suppkey, l_quantity) as qual from lineitem group by 1)"


def qualities(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("q"))
    return x.select("id", F.transform("q", lambda s: s["l_quantity"].cast("int")).alias("qual"))


@query(f"""with {QUAL}, u as (select id, qual, unnest(range(1, len(qual) + 1)) as i, unnest(qual) as q from r), s as (select id, qual, i, sum(20 - q) over (partition by id order by i desc) as s from u), l as (select *, max(case when s < 0 then i end) over (partition by id) as wall from s),
 b as (select id, qual, max(i) filter (s = m) as i from (select *, max(s) over (partition by id) as m from l where (wall is null or i > wall) and s > 0) group by 1, 2), t as (select r.id, r.qual[1:coalesce(b.i - 1, len(r.qual))] as qual from r left join b on r.id = b.id),
 v as (select id, qual, len(qual) as n, list_avg(qual) as mean from t where len(qual) >= 2) select id, n as length, round(mean, 6) as mean from v where mean >= 25""")
def quality_trimmed_reads(spark, d):
    return R(Q.trim_ends(qualities(spark, d), 20, 2, 25.0).select("id", F.size("qual").cast("long").alias("length"), "mean"))


ITEM = f"b as (select item_id as id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{DNA}') as seq from benchmark)"


def _sketch(source: str, name: str) -> str:
    return f"{name} as (select distinct id, cast('0x' || substr(md5(k), 1, 8) as bigint) as hash from (select distinct id, substr(seq, i, 21) as k from (select id, seq, unnest(range(1, length(seq) - 19)) as i from {source})) where cast('0x' || substr(md5(k), 1, 8) as bigint) < {(1 << 32) // 20})"


@query(f"with {SEQ}, {ITEM}, {_sketch('s', 't')}, {_sketch('b', 'q')}, n as (select id, count(*) as n from q group by 1), m as (select id, count(*) as n from t group by 1) select q.id as query, t.id as target, count(*) as shared, round(count(*) / max(n.n), 6) as containment, round(count(*) / (max(n.n) + max(m.n) - count(*)), 6) as jaccard from q join t using (hash) join n on n.id = q.id join m on m.id = t.id group by 1, 2")
def sketch_containment(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), LETTERS, DNA).alias("seq"))
    return R(Q.containment(Q.scaled_sketch(items, 21, 20), Q.scaled_sketch(sequences(spark, d), 21, 20)))


@query(f"with {CELL}, q as (select cell, count(*) filter (v > 0) as genes, sum(v) as total, sum(case when gene like '%1' then v else 0 end) as marked from x group by 1), k as (select cell from q where genes >= 20 and total >= 14000 and round(marked / total, 9) <= 0.21), y as (select * from x where cell in (select cell from k)), g as (select gene from y where v > 0 group by 1 having count(*) >= 10) select gene, cell, v from y where gene in (select gene from g)")
def filtered_cells(spark, d):
    return Q.filter_genes(Q.filter_cells(cells(spark, d), 20, 14000.0, F.col("gene").endswith("1"), 0.21), 10).select("gene", "cell", "v")


@query(f"""with {CELL}, g as (select gene, count(*) filter (cluster = 0) as n0, count(*) filter (cluster = 1) as n1, avg(v) filter (cluster = 0) as m0, avg(v) filter (cluster = 1) as m1, var_samp(v) filter (cluster = 0) as s0, var_samp(v) filter (cluster = 1) as s1 from x where cluster in (0, 1) group by 1),
 z as (select gene, (m1 - m0) / sqrt(s0 / n0 + s1 / n1) as z from g), p as (select gene, z, greatest(0, 1 - {ERF.format(x='(abs(z) / sqrt(2.0::double))')}) as p from z), a as (select *, round(p, 9) as rp, count(*) over () as n, rank() over (order by round(p, 9)) as k from p),
 b as (select *, least(1, min(rp * n / (k + c - 1)) over (order by rp desc rows between unbounded preceding and current row)) as bh from (select *, count(*) over (partition by rp) as c from a)) select gene, round(z, 6) as z, round(rp, 6) as p, round(min(bh) over (partition by rp), 6) as bh from b""")
def adjusted_expression_tests(spark, d):
    x = cells(spark, d).where("cluster in (0, 1)")
    x = S.two_samples(x.withColumn("g", F.col("cluster")), "v", "g", ["gene"])
    x = x.select("gene", (-F.col("welch_t")).alias("z")).withColumn("p", F.round(O.normal_p(F.col("z")), 9)).withColumn("one", F.lit(1))
    return R(S.adjust(x, "p", ["one"]).select("gene", "z", "p", "bh"))


@query(f"""with {SEQ}, p as (select id, i - 1 as start, {' + '.join(f"cast(substr(seq, i + {k}, 1) <> '{c}' as int)" for k, c in enumerate('GATTACA'))} as mismatches from (select id, seq, unnest(range(1, length(seq) - 5)) as i from s)) select id, start, cast(mismatches as bigint) as mismatches from p where mismatches <= 1""")
def approximate_motif_hits(spark, d):
    return N.approximate_hits(sequences(spark, d), "GATTACA", 1)


@query()
def louvain_communities(spark, d):
    return C.louvain(edges(spark, d))


@query()
def hierarchical_clusters(spark, d):
    return T.agglomerate(vectors(spark, d), "label", 4, "complete")


def _seed(i: int) -> str:
    u = f"(cast('0x' || substr(md5('0:{i}:' || cast(e.id as varchar)), 1, 8) as bigint)::double + 0.5) / 4294967296"
    if not i:
        return f"c0 as (select v from (select e.v, -ln(-ln({u})) as d, id from e) order by d desc, id desc limit 1)"
    gaps = [f"(select list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - c{k}.v[i]) ** 2)) from c{k})" for k in range(i)]
    low = f"least({', '.join(gaps)})" if i > 1 else gaps[0]
    return f"c{i} as (select v from (select a.v, ln(low) - ln(-ln({u.replace('e.id', 'a.id')})) as d, id from (select a.*, {low} as low from e a) a where low > 0) order by d desc, id desc limit 1)"


@query(f"with {EMB}, {', '.join(map(_seed, range(4)))} {' union all '.join(f'select cast({i} as bigint) as label, list_transform(v, lambda x: round(x, 6)) as c from c{i}' for i in range(4))}")
def spread_seeds(spark, d):
    return V.spread_seeds(vectors(spark, d).select("id", "v"), 4).select("label", F.transform("c", lambda x: F.round(x, 6)).alias("c"))


@query("select c_custkey, c_name, c_acctbal, c_mktsegment from customer")
def csv_round_trip(spark, d):
    at = folder(spark, "formats-csv")
    x = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    x.write.option("header", True).csv(at)
    return spark.read.option("header", True).schema(x.schema).csv(at)


@query("with x as (select p_type, p_brand, count(*) as n from part group by 1, 2), t as (select count(*)::double as t from part), m as (select p_type, p_brand, n, sum(n) over (partition by p_type) as a, sum(n) over (partition by p_brand) as b from x) select p_type, p_brand, round(n / t * ln(n * t / (a * b)), 9) as mi from m, t order by mi desc, p_type, p_brand limit 12")
def top_mutual_information(spark, d):
    from locusframe.operators.ordering import top

    x = table(spark, d, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    a, b = (x.groupBy(F.col(c).alias(f"_{c}")).agg(F.sum("n").alias(k)) for c, k in (("p_type", "a"), ("p_brand", "b")))
    x = x.join(a, F.col("p_type") == F.col("_p_type")).join(b, F.col("p_brand") == F.col("_p_brand")).crossJoin(F.broadcast(x.agg(F.sum("n").cast("double").alias("t"))))
    x = x.select("p_type", "p_brand", F.round(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("a") * F.col("b"))), 9).alias("mi"))
    return top(x, [F.desc("mi"), F.asc("p_type"), F.asc("p_brand")], 12)
