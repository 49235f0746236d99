"""Ecology: nations are samples, parts taxa, order lines the count."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusframe.operators import ecology as E

from .registry import query, table
from .stats_queries import R

OTU = """o as (select n_name as sample, cast(l_partkey as varchar) as taxon, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2)"""


def otu(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    x = x.join(table(spark, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return x.groupBy(F.col("n_name").alias("sample"), F.col("l_partkey").cast("string").alias("taxon")).agg(F.count("*").alias("n"))


@query(f"""with {OTU}, x as (select *, n / sum(n) over (partition by sample) as p, sum(n) over (partition by sample) as t from o where n > 0),
 a as (select sample, count(*) as observed, -sum(p * ln(p)) as sh, sum(p * p) as sq, sum(n * (n - 1)) as pairs, count(*) filter (n = 1) as f1, count(*) filter (n = 2) as f2, max(p) as bp, max(t) as t from x group by 1)
 select sample, observed, round(sh, 6) as shannon, round(1 - pairs / (t * (t - 1)), 6) as simpson, round(1 / sq, 6) as inverse_simpson, round(sh / ln(observed), 6) as pielou,
 round(observed + case when f2 > 0 then f1 * f1 / (2.0 * f2) else f1 * (f1 - 1) / 2.0 end, 6) as chao1, round(bp, 6) as berger_parker, round(1 - f1 / t, 6) as coverage, round(exp(sh), 6) as hill_1 from a""")
def alpha_diversity(spark, d):
    return R(E.diversity(otu(spark, d)))


@query(f"""with {OTU}, t as (select sample, taxon from (select distinct sample from o) cross join (select distinct taxon from o)), f as (select sample, taxon, coalesce(n, 0) as n from t left join o using (sample, taxon)),
 p as (select a.sample as sample_a, b.sample as sample_b, a.n as x, b.n as y from f a join f b on a.taxon = b.taxon and a.sample < b.sample)
 select sample_a, sample_b, round(sum(abs(x - y)) / sum(x + y), 6) as bray_curtis, round(1 - count(*) filter (x > 0 and y > 0) / count(*) filter (x > 0 or y > 0), 6) as jaccard, round(sqrt(sum((x - y) ** 2)), 6) as euclidean,
 round(sum(case when x + y > 0 then abs(x - y) / (x + y) else 0 end), 6) as canberra from p group by 1, 2""")
def beta_diversity(spark, d):
    return R(E.between(otu(spark, d)))


@query(f"with {OTU} select sample, taxon, round(ln(n) - avg(ln(n)) over (partition by sample), 6) as clr from o")
def centred_log_ratio(spark, d):
    return R(E.clr(otu(spark, d)).select("sample", "taxon", "clr"))


@query(f"""with {OTU}, t as (select *, sum(n) over (partition by sample)::bigint as t from o), q as (select *, n * 1000 // t as low, n * 1000 % t as rest from t where t >= 1000)
 select sample, taxon, cast(low + case when row_number() over (partition by sample order by rest desc, taxon) <= 1000 - sum(low) over (partition by sample) then 1 else 0 end as bigint) as rarefied from q""")
def rarefied_counts(spark, d):
    return E.rarefy(otu(spark, d), 1000).select("sample", "taxon", "rarefied")


@query(f"with {OTU}, g as (select taxon from o group by 1 having sum(n) >= 35 and count(*) >= 0.7 * (select count(distinct sample) from o)) select sample, taxon, n from o where taxon in (select taxon from g)")
def prevalence_filter(spark, d):
    return E.prevalence(otu(spark, d), 35, 0.7).select("sample", "taxon", "n")


@query("""select n_name as sample, c_mktsegment as phylum, o_orderpriority as genus, count(*) as n, 2 - cast(round(log2(grouping(c_mktsegment) * 2 + grouping(o_orderpriority) + 1)) as int) as depth
 from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by grouping sets ((n_name, c_mktsegment, o_orderpriority), (n_name, c_mktsegment), (n_name))""")
def taxonomy_rollup(spark, d):
    x = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    x = x.select(F.col("n_name").alias("sample"), F.col("c_mktsegment").alias("phylum"), F.col("o_orderpriority").alias("genus"), F.lit(1).cast("long").alias("n"))
    return E.roll_up(x, ["phylum", "genus"])


@query(f"""with {OTU}, x as (select o.*, n_regionkey as region from o join nation on n_name = sample), c as (select region, taxon, avg(n) as m, count(*) filter (n > 0) / count(*) as f from x group by 1, 2)
 select region, taxon, round(m / sum(m) over (partition by taxon) * f, 9) as indicator from c""")
def indicator_species(spark, d):
    x = otu(spark, d).join(table(spark, d, "nation").select(F.col("n_name").alias("sample"), F.col("n_regionkey").alias("region")), "sample")
    return R(E.indicator(x, "region"), 9)
