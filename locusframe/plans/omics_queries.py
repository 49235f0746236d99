"""Omics operators: brands are genes, suppliers cells or samples, return flags clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusframe.operators import omics as O

from .registry import query, table
from .stats_queries import R

CELL = "x as (select p_brand as gene, l_suppkey as cell, sum(l_quantity) as v, l_suppkey % 4 as cluster from lineitem join part on l_partkey = p_partkey group by 1, 2)"


def cells(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("gene"))
    x = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("gene", F.col("l_suppkey").alias("cell")).agg(F.sum("l_quantity").alias("v"))
    return x.withColumn("cluster", F.col("cell") % 4)


@query(f"with {CELL} select gene, sum(v) as total, round(avg(v), 6) as mean, count(*) filter (v <> 0) as nonzero, max(v) as greatest from x group by 1")
def matrix_row_sums(spark, d):
    return R(O.matrix_sums(cells(spark, d), "gene", "v"))


@query(f"with {CELL} select a.gene as row, b.gene as col, sum(a.v * b.v) as value from x a join x b on a.cell = b.cell group by 1, 2")
def sparse_matrix_product(spark, d):
    x = cells(spark, d)
    a = x.select(F.col("gene").alias("row"), F.col("cell").alias("col"), F.col("v").alias("value"))
    return O.matrix_product(a, x.select(F.col("cell").alias("row"), F.col("gene").alias("col"), F.col("v").alias("value")))


@query(f"with {CELL} select gene, cell, round(ln(1 + v / sum(v) over (partition by cell) * 10000), 6) as normalised from x")
def log_normalised_cells(spark, d):
    return R(O.log_normalise(cells(spark, d), "cell", "v", 1e4).select("gene", "cell", "normalised"))


@query(f"""with {CELL}, n as (select count(distinct cell) as n from x), g as (select gene, sum(v) / n as mean, (sum(v * v) - sum(v) * sum(v) / n) / (n - 1) as variance from x, n group by gene, n),
 r as (select *, variance / mean as dispersion, row_number() over (order by round(variance / mean, 9) desc, gene) as r from g) select gene, round(mean, 6) as mean, round(variance, 5) as variance, round(dispersion, 5) as dispersion, r <= 8 as variable from r""")
def highly_variable_genes(spark, d):
    x = cells(spark, d)
    n = x.select("cell").distinct().count()
    x = O.variable_genes(x, "gene", "v", F.lit(n), 8)
    return x.select("gene", F.round("mean", 6).alias("mean"), F.round("variance", 5).alias("variance"), F.round("dispersion", 5).alias("dispersion"), "variable")


@query(f"""with {CELL}, c as (select gene, cluster, count(*) as n, sum(v) as s, count(*) filter (v > 50) as k from x group by 1, 2), o as (select *, sum(n) over (partition by gene) - n as no_, sum(s) over (partition by gene) - s as so, sum(k) over (partition by gene) - k as ko from c)
 select gene, cluster, round(s / n, 6) as mean_in, round(so / no_, 6) as mean_out, round(log2(greatest((s / n) / (so / no_), 1e-15)), 6) as log2fc from o""")
def cluster_marker_genes(spark, d):
    return R(O.marker_genes(cells(spark, d), "gene", "cluster", "v").select("gene", "cluster", "mean_in", "mean_out", "log2fc"))


ERF = "(1 - (1 / (1 + 0.3275911 * {x})) * (0.254829592 + (1 / (1 + 0.3275911 * {x})) * (-0.284496736 + (1 / (1 + 0.3275911 * {x})) * (1.421413741 + (1 / (1 + 0.3275911 * {x})) * (-1.453152027 + (1 / (1 + 0.3275911 * {x})) * 1.061405429)))) * exp(-{x} * {x}))"


@query(f"""with {CELL}, a as (select gene, avg(v) filter (cluster = 0) as m0, avg(v) filter (cluster = 1) as m1, count(*) filter (cluster = 0) as n0, count(*) filter (cluster = 1) as n1, avg(v) as m, var_samp(v) as va from x where cluster in (0, 1) group by 1),
 b as (select *, greatest(1e-8, least(10.0, (va - m) / (m * m))) as alpha from a), z as (select gene, alpha, ln((m1 + 0.5) / (m0 + 0.5)) as f, (m0 + 0.5 + alpha * (m0 + 0.5) ** 2) / n0 / (m0 + 0.5) ** 2 + (m1 + 0.5 + alpha * (m1 + 0.5) ** 2) / n1 / (m1 + 0.5) ** 2 as se from b),
 y as (select gene, f / ln(2) as log2fc, alpha, f / sqrt(se) as z, abs(f / sqrt(se)) / sqrt(2.0::double) as u from z) select gene, round(log2fc, 6) as log2fc, round(alpha, 6) as alpha, round(z, 5) as z, round(greatest(0, 1 - {ERF.format(x='u')}), 5) as p from y""")
def differential_expression(spark, d):
    x = O.differential(cells(spark, d).where("cluster in (0, 1)"), "gene", "cluster", "v")
    return x.select("gene", F.round("log2fc", 6).alias("log2fc"), F.round("alpha", 6).alias("alpha"), F.round("z", 5).alias("z"), F.round("p", 5).alias("p"))


@query("""with p as (select l_suppkey, l_partkey, max(l_extendedprice) as i from lineitem group by 1, 2), r as (select *, row_number() over (partition by l_suppkey order by i desc, l_partkey) as r from p)
 select l_suppkey, count(*) as peptides, round(sum(i), 2) as total, round(avg(i) filter (r <= 3), 4) as top3 from r group by 1""")
def protein_quantification(spark, d):
    x = O.protein_intensity(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", "l_extendedprice")
    return x.select("l_suppkey", "peptides", F.round("total", 2).alias("total"), F.round("top3", 4).alias("top3"))


@query("with m as (select c_nationkey, quantile_cont(c_acctbal, 0.5) as m from customer where c_acctbal > 0 group by 1) select c_custkey, round(c_acctbal / m, 6) as normalised, round(case when c_acctbal > 0 then log2(c_acctbal) else 0 end, 6) as log2 from customer join m using (c_nationkey)")
def median_normalisation(spark, d):
    return R(O.median_normalise(table(spark, d, "customer"), "c_nationkey", "c_acctbal").select("c_custkey", "normalised", "log2"))


@query("with f as (select user_id, cast(value * 3 as bigint) % 400 as size from (select user_id, floor(value) as value from events)), c as (select user_id, count(*) filter (size < 150) as free, count(*) filter (size between 150 and 300) as mono from f group by 1) select user_id, free, mono, round(case when mono > 0 then free / mono else 0 end, 6) as ratio from c")
def nucleosome_free_ratio(spark, d):
    x = table(spark, d, "events").select("user_id", (F.floor("value") * 3 % 400).cast("long").alias("size"))
    return R(O.fragment_ratio(x, "size", ["user_id"]))


@query("""select o_orderpriority, o_orderkey, round(row_number() over w / count(*) over (partition by o_orderpriority), 6) as bins, round(sum(o_totalprice) over (partition by o_orderpriority order by o_totalprice, o_orderkey rows unbounded preceding) / sum(o_totalprice) over (partition by o_orderpriority), 6) as covered
 from orders window w as (partition by o_orderpriority order by o_totalprice, o_orderkey)""")
def coverage_fingerprint(spark, d):
    return R(O.fingerprint(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", "o_orderkey"))


WIN = "w as (select l_suppkey as chrom, datediff('day', date '1992-01-01', cast(l_shipdate as date)) // 60 as bin, count(*) as n from lineitem group by 1, 2)"


def windows(spark, d):
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("chrom"), F.floor(day / 60).alias("bin")).agg(F.count("*").alias("n"))


@query(f"with {WIN}, m as (select *, avg(n) over (partition by chrom) as m from w) select chrom, bin, n, round(n / m, 6) as fold, round(n * ln(n / m) - (n - m), 6) as llr from m where n / m >= 1.5")
def enriched_peaks(spark, d):
    return R(O.enriched_windows(windows(spark, d), 1.5).select("chrom", "bin", "n", "fold", "llr"))


@query(f"""with {WIN}, s as (select chrom, bin, case when n > 20 then 'gain' when n < 12 then 'loss' else 'neutral' end as state from w), r as (select *, row_number() over (partition by chrom order by bin) - row_number() over (partition by chrom, state order by bin) as run from s)
 select chrom, state, min(bin) as first, max(bin) as last, count(*) as n from r group by chrom, state, run""")
def copy_number_segments(spark, d):
    return O.state_segments(windows(spark, d), ["chrom"], "bin", F.when(F.col("n") > 20, "gain").when(F.col("n") < 12, "loss").otherwise("neutral"))


@query("with c as (select l_linenumber * 10 + l_suppkey % 10 as i, l_partkey % 80 as j, count(*) as n from lineitem group by 1, 2), e as (select *, abs(i - j) as distance, avg(n) over (partition by abs(i - j)) as ex from c) select i, j, n, distance, round(ex, 6) as expected, round(n / ex, 6) as over_expected from e")
def contact_distance_decay(spark, d):
    x = table(spark, d, "lineitem").groupBy((F.col("l_linenumber") * 10 + F.col("l_suppkey") % 10).alias("i"), (F.col("l_partkey") % 80).alias("j")).agg(F.count("*").alias("n"))
    return R(O.distance_decay(x))


@query("select l_partkey, count(*) filter (l_discount > 0) as channels, round(case when max(l_discount * 5) >= 1 then 1 else 1 - exp(sum(ln(1 - least(l_discount * 5, 0.999999)))) end, 6) as combined from lineitem group by 1")
def combined_evidence(spark, d):
    return R(O.combine_evidence(table(spark, d, "lineitem").withColumn("s", F.col("l_discount") * 5), ["l_partkey"], "s"))


@query(f"with {CELL}, m as (select gene, cluster, avg(v) as m from x group by 1, 2) select a.gene as ligand, b.gene as receptor, a.cluster as sender, b.cluster as receiver, round(a.m * b.m, 5) as score from m a join m b on b.gene = 'Brand#' || cast(cast(regexp_extract(a.gene, '[0-9]+$') as int) + 1 as varchar)")
def ligand_receptor_scores(spark, d):
    m = cells(spark, d).groupBy("gene", "cluster").agg(F.avg("v").alias("m"))
    pairs = m.select(F.col("gene").alias("ligand")).distinct().withColumn("receptor", F.concat(F.lit("Brand#"), (F.regexp_extract("ligand", "([0-9]+)$", 1).cast("int") + 1).cast("string")))
    return R(O.ligand_receptor(m, pairs), 5)


@query("""with b as (select l_suppkey as id, floor(l_quantity / 2) as bin, sum(l_extendedprice) as v from lineitem group by 1, 2), u as (select id, bin, v / sqrt(sum(v * v) over (partition by id)) as u from b)
 select x.id as id_a, y.id as id_b, count(*) as shared, round(sum(x.u * y.u), 6) as cosine from u x join u y on x.bin = y.bin and x.id < y.id group by 1, 2""")
def spectral_similarity(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_quantity").alias("mz"), F.col("l_extendedprice").alias("intensity"))
    return R(O.spectrum_cosine(x, 2.0))


@query("""with n as (select count(*)::double as t, count(*) filter (p_retailprice > 950)::double as d from part), g as (select p_brand, count(*) as m, count(*) filter (p_retailprice > 950) as k from part group by 1)
 select p_brand, m as members, k as overlap, round(m * d / t, 6) as expected, round(k / (m * d / t), 6) as fold, round((k - m * d / t) / sqrt(m * d / t * (t - m) / t * (t - d) / (t - 1)), 6) as z from g, n""")
def over_representation(spark, d):
    return R(O.overlap_enrichment(table(spark, d, "part").withColumn("hit", F.col("p_retailprice") > 950), "hit", ["p_brand"]))


@query("with c as (select l_suppkey, count(*) filter (l_returnflag = 'R') as k, count(*) as n from lineitem group by 1), p as (select *, k + 2.0::double as a, n - k + 5.0::double as b from c) select l_suppkey, k, n, round(a / (a + b), 6) as posterior_mean, round(a * b / ((a + b) ** 2 * (a + b + 1)), 8) as posterior_variance from p")
def beta_binomial_posterior(spark, d):
    return R(O.beta_binomial(table(spark, d, "lineitem"), ["l_suppkey"], F.col("l_returnflag") == "R", 2.0, 5.0), 8).withColumn("posterior_mean", F.round("posterior_mean", 6))


@query("select c_nationkey, count(*) as n, round((100.0 / 50 + sum(c_acctbal) / 9.0) / (1 / 50.0 + count(*) / 9.0), 5) as posterior_mean, round(1 / (1 / 50.0 + count(*) / 9.0), 7) as posterior_variance from customer group by 1")
def normal_posterior(spark, d):
    x = O.normal_normal(table(spark, d, "customer"), ["c_nationkey"], "c_acctbal", 100.0, 50.0, 9.0)
    return x.select("c_nationkey", "n", F.round("posterior_mean", 5).alias("posterior_mean"), F.round("posterior_variance", 7).alias("posterior_variance"))


@query("""with recursive t as (select 'root' as id, cast(null as varchar) as parent union all select r_name, 'root' from region union all select n_name, r_name from nation join region on n_regionkey = r_regionkey),
 c as (select id as node, id as ancestor, 0 as steps from t union all select c.node, t.parent, steps + 1 from c join t on t.id = c.ancestor where t.parent is not null) select node, ancestor, steps from c""")
def taxonomy_ancestors(spark, d):
    return O.ancestors(taxonomy(spark, d), 3)


def taxonomy(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    x = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("id"), F.col("r_name").alias("parent"))
    return x.union(r.select("r_name", F.lit("root"))).union(spark.createDataFrame([("root", None)], "id string, parent string"))


@query("select a.n_name as a, b.n_name as b, case when a.n_name = b.n_name then a.n_name when a.n_regionkey = b.n_regionkey then r_name else 'root' end as lca from nation a cross join nation b join region on r_regionkey = a.n_regionkey")
def lowest_common_ancestors(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("a"))
    return O.lowest_common(n.crossJoin(n.withColumnRenamed("a", "b")), O.ancestors(taxonomy(spark, d), 3))


@query("with k as (select l_partkey, cast(sum(l_quantity) as bigint) % 60 as derived from lineitem group by 1) select derived, count(*) as sites from k group by 1")
def site_frequency_spectrum(spark, d):
    return O.site_frequency(table(spark, d, "lineitem").groupBy("l_partkey").agg((F.sum("l_quantity").cast("long") % 60).alias("derived")), "derived")


@query("select a.l_orderkey, a.l_partkey as read1, b.l_partkey as read2 from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber = 1 and b.l_linenumber = 2")
def mate_pairs(spark, d):
    x = table(spark, d, "lineitem")
    a = x.where("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("read1"))
    return a.join(x.where("l_linenumber = 2").select("l_orderkey", F.col("l_partkey").alias("read2")), "l_orderkey")
