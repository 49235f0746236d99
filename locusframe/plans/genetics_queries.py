"""Variants, reads, population genetics, survival, enrichment and classification over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusframe.operators import genetics as G

from .registry import query, table
from .stats_queries import R

BASES = "'ACGT'"
VAR = """v as (select cast(p_size as varchar) as chrom, p_partkey as position, substr('ACGTACGT', cast(p_partkey % 4 as int) + 1, cast(1 + p_partkey % 7 // 6 as int)) as ref,
 substr('CATGGTCA', cast(p_partkey % 5 as int) + 1, cast(1 + p_partkey % 11 // 9 as int)) as alt, case when p_partkey % 13 = 0 then null else p_retailprice / 20 end as quality, case when p_partkey % 3 = 0 then 'q10' else 'PASS' end as filter from part)"""
TYPED = """t as (select *, case when length(ref) = 1 and length(alt) = 1 then 'SNV' when length(ref) = length(alt) then 'MNV' when length(ref) < length(alt) and starts_with(alt, ref) then 'INS'
 when length(ref) > length(alt) and starts_with(ref, alt) then 'DEL' else 'COMPLEX' end as type from v)"""


def variants(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        F.col("p_size").cast("string").alias("chrom"), k.alias("position"), F.substring(F.lit("ACGTACGT"), (k % 4 + 1).cast("int"), F.expr("cast(1 + p_partkey % 7 div 6 as int)")).alias("ref"),
        F.substring(F.lit("CATGGTCA"), (k % 5 + 1).cast("int"), F.expr("cast(1 + p_partkey % 11 div 9 as int)")).alias("alt"), F.when(k % 13 != 0, F.col("p_retailprice") / 20).alias("quality"), F.when(k % 3 == 0, "q10").otherwise("PASS").alias("filter"))


def typed(spark, d):
    return variants(spark, d).withColumn("type", G.variant_type(F.col("ref"), F.col("alt")))


@query(f"with {VAR}, {TYPED} select position, type from t where coalesce(quality, 0) >= 48 and (type = 'SNV' or not filter = 'PASS') and not chrom = '7'")
def variant_filter_language(spark, d):
    return typed(spark, d).where(G.compile_filter('QUAL >= 48 && (TYPE == "SNV" || !FILTER == "PASS") && CHROM != "7"')).select("position", "type")


@query(f"""with {VAR}, {TYPED}, s as (select *, type = 'SNV' as snv, ref || alt in ('AG', 'GA', 'CT', 'TC') as ts from t)
 select chrom, count(*) as n, count(*) filter (snv) as snv, count(*) filter (not snv) as other, count(*) filter (snv and ts) as ti, count(*) filter (snv and not ts) as tv,
 case when count(*) filter (snv and not ts) = 0 then 0 else round(count(*) filter (snv and ts) / count(*) filter (snv and not ts), 6) end as ti_tv, round(avg(quality), 6) as quality from s group by 1""")
def variant_statistics(spark, d):
    return R(G.variant_summary(variants(spark, d), ["chrom"]))


@query("with a as (select l_orderkey as position, list(l_linenumber order by l_linenumber, l_partkey) as alts from lineitem group by 1) select position, unnest(range(len(alts))) as allele, unnest(alts) as alt from a")
def split_multiallelic(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("position")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_linenumber"]).alias("alts"))
    return G.split_alleles(x).select("position", F.col("allele").cast("long").alias("allele"), "alt")


@query("with s as (select o_custkey as chrom, count(*) as n, string_agg(o_orderstatus, ',' order by o_orderkey) as alts from orders group by 1) select cast(chrom as varchar) as chrom, alts from s")
def join_multiallelic(spark, d):
    x = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("chrom"), F.lit(1).alias("position"), F.lit("A").alias("ref"), F.col("o_orderkey").alias("allele"), F.col("o_orderstatus").alias("alt"))
    return G.join_alleles(x).select("chrom", F.array_join("alts", ",").alias("alts"))


@query("""with a as (select distinct l_partkey, l_suppkey from lineitem where l_returnflag = 'A'), b as (select distinct l_partkey, l_suppkey from lineitem where l_returnflag = 'R'), f as (select a.l_partkey as x, b.l_partkey as y from a full join b using (l_partkey, l_suppkey))
 select count(*) filter (x is not null and y is not null) as shared, count(*) filter (y is null) as only_a, count(*) filter (x is null) as only_b, round(count(*) filter (x is not null and y is not null) / count(*), 9) as jaccard from f""")
def set_concordance(spark, d):
    x = table(spark, d, "lineitem")
    return R(G.concordance(x.where("l_returnflag = 'A'"), x.where("l_returnflag = 'R'"), ["l_partkey", "l_suppkey"]), 9)


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_returnflag = 'A' and (l_partkey, l_suppkey) in (select l_partkey, l_suppkey from lineitem where l_returnflag = 'R')")
def variant_intersect(spark, d):
    x = table(spark, d, "lineitem")
    return x.where("l_returnflag = 'A'").join(x.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"], "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_returnflag = 'A' and (l_partkey, l_suppkey) not in (select l_partkey, l_suppkey from lineitem where l_returnflag = 'R')")
def variant_difference(spark, d):
    x = table(spark, d, "lineitem")
    return x.where("l_returnflag = 'A'").join(x.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"], "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""with r as (select l_orderkey * 37 % 4096 as flag from lineitem), b as (select flag, (flag & 256) <> 0 as s, (flag & 2048) <> 0 as x, (flag & 4) <> 0 as u, (flag & 1) <> 0 and (flag & 256) = 0 and (flag & 2048) = 0 as p from r)
 select count(*) as total, count(*) filter (s) as secondary, count(*) filter (x) as supplementary, count(*) filter ((flag & 1024) <> 0) as duplicates, count(*) filter (not u) as mapped, count(*) filter (p) as paired,
 count(*) filter (p and (flag & 64) <> 0) as read1, count(*) filter (p and (flag & 128) <> 0) as read2, count(*) filter (p and (flag & 2) <> 0 and not u) as proper, count(*) filter (p and not u and (flag & 8) <> 0) as singletons from b""")
def flag_statistics(spark, d):
    return G.flagstat(table(spark, d, "lineitem").select((F.col("l_orderkey") * 37 % 4096).alias("flag")))


@query("select event_id, row_number() over (partition by user_id, event_type, date_trunc('day', ts) order by value desc, event_id) > 1 as duplicate from events")
def duplicate_reads(spark, d):
    x = table(spark, d, "events").withColumn("day", F.date_trunc("day", "ts"))
    return G.mark_duplicates(x, ["user_id", "event_type", "day"], "value", "event_id").select("event_id", "duplicate")


GT = """g as (select l_partkey % 400 as locus, l_suppkey as sample, s_nationkey % 5 as pop, case when l_linenumber = 7 then null else cast(l_quantity as int) % 3 end as gt from lineitem join supplier on l_suppkey = s_suppkey)"""


def genotypes(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return x.select((F.col("l_partkey") % 400).alias("locus"), F.col("l_suppkey").alias("sample"), (F.col("s_nationkey") % 5).alias("pop"), F.when(F.col("l_linenumber") != 7, F.col("l_quantity").cast("int") % 3).alias("gt"))


AF = """c as (select {by}, count(*) filter (gt = 0)::double as a, count(*) filter (gt = 1)::double as h, count(*) filter (gt = 2)::double as b, count(*) filter (gt is null) as missing from g group by {by}),
 f as (select *, a + h + b as n, (2 * b + h) / (2 * (a + h + b)) as p, h / (a + h + b) as ob, 2 * (2 * b + h) / (2 * (a + h + b)) * (1 - (2 * b + h) / (2 * (a + h + b))) as ex from c)"""


@query(f"""with {GT}, {AF.format(by='locus')} select locus, cast(n as bigint) as n, missing, round(p, 6) as frequency, round(ob, 6) as observed, round(ex, 6) as expected, round(1 - ob / ex, 6) as f,
 round((a - (1 - p) ** 2 * n) ** 2 / ((1 - p) ** 2 * n) + (h - ex * n) ** 2 / (ex * n) + (b - p * p * n) ** 2 / (p * p * n), 5) as hwe_chi2 from f""")
def hardy_weinberg(spark, d):
    x = G.allele_frequencies(genotypes(spark, d), ["locus"])
    return R(x.withColumn("hwe_chi2", F.round("hwe_chi2", 5)))


@query(f"""with {GT}, {AF.format(by='locus, pop')}, l as (select locus, sum(n * ex) / sum(n) as hs, sum(n * p) / sum(n) as p from f where n > 0 group by 1), t as (select sum(hs) as hs, sum(2 * p * (1 - p)) as ht, count(*) as loci from l)
 select loci, round(hs, 5) as hs, round(ht, 5) as ht, round(greatest(0, least(1, (ht - hs) / ht)), 7) as fst from t""")
def fixation_index(spark, d):
    x = G.fst(genotypes(spark, d))
    return x.select("loci", F.round("hs", 5).alias("hs"), F.round("ht", 5).alias("ht"), F.round("fst", 7).alias("fst"))


ONE = "one as (select locus, sample, min(gt) as gt from g where gt is not null group by 1, 2)"


@query(f"""with {GT}, {ONE}, p as (select a.locus as locus_a, b.locus as locus_b, a.gt as x, b.gt as y from one a join one b on a.sample = b.sample and b.locus > a.locus and b.locus - a.locus <= 3)
 select locus_a, locus_b, count(*) as n, round(case when var_pop(x) * var_pop(y) > 0 then covar_pop(x, y) ** 2 / (var_pop(x) * var_pop(y)) else 0 end, 6) as r2 from p group by 1, 2""")
def linkage_disequilibrium(spark, d):
    one = genotypes(spark, d).where("gt is not null").groupBy("locus", "sample").agg(F.min("gt").alias("gt"))
    return R(G.linkage(one, 3))


@query("""with s as (select p_brand as region, 40 as n, cast(p_partkey * 13 % 41 as int) as k from part),
 x as (select region, 40.0 as n, sum(2.0 * k * (40 - k) / (40.0 * 39)) as pi, count(*) filter (k > 0 and k < 40) as s from s group by 1), c as (select sum(1.0 / i) as a1, sum(1.0 / (i * i)) as a2 from range(1, 40) t(i)),
 e as (select *, ((n + 1) / (3 * (n - 1)) - 1 / a1) / a1 as e1, (2 * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / (a1 * a1)) / (a1 * a1 + a2) as e2 from x, c)
 select region, cast(n as int) as n, s, round(pi, 6) as pi, round(s / a1, 6) as theta, round((pi - s / a1) / sqrt(e1 * s + e2 * s * (s - 1)), 5) as tajima_d from e""")
def tajima_test(spark, d):
    x = table(spark, d, "part").select(F.col("p_brand").alias("region"), F.lit(40).alias("n"), (F.col("p_partkey") * 13 % 41).cast("int").alias("k"))
    return R(G.nucleotide_diversity(x, ["region"]).withColumn("tajima_d", F.round("tajima_d", 5)))


SURV = """s as (select o_orderpriority as grp, cast(o_totalprice / 1000 as bigint) + 1 as time, o_orderstatus = 'F' as event from orders)"""


def survival(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("grp"), (F.round(F.col("o_totalprice") / 1000).cast("long") + 1).alias("time"), (F.col("o_orderstatus") == "F").alias("event"))


RISK = """t as (select grp, time, count(*) as n, count(*) filter (event) as d from s group by 1, 2), r as (select *, sum(n) over (partition by grp order by time desc) as risk from t)"""


@query(f"""with {SURV.replace('cast(o_totalprice / 1000 as bigint)', 'cast(round(o_totalprice / 1000) as bigint)')}, {RISK}, k as (select *, 1 - d / risk as fall from r where d > 0),
 c as (select *, case when min(fall) over w <= 0 then 0 else exp(sum(case when fall > 0 then ln(fall) end) over w) end as sv, sum(case when risk > d then d / (risk * (risk - d)) end) over w as g from k window w as (partition by grp order by time rows unbounded preceding))
 select grp, time, cast(risk as bigint) as risk, d as events, round(sv, 6) as survival, round(sv * sv * coalesce(g, 0), 8) as variance from c""")
def kaplan_meier_curve(spark, d):
    x = G.kaplan_meier(survival(spark, d), ["grp"])
    return x.select("grp", "time", "risk", "events", F.round("survival", 6).alias("survival"), F.round("variance", 8).alias("variance"))


@query(f"""with {SURV.replace('cast(o_totalprice / 1000 as bigint)', 'cast(round(o_totalprice / 1000) as bigint)')}, a as (select time, count(*) as n, count(*) filter (event) as d from s group by 1), b as (select *, sum(n) over (order by time desc) as risk from a),
 e as (select g.grp, sum((select count(*) from s where s.grp = g.grp and s.time >= b.time) * b.d / b.risk) as expected from b, (select distinct grp from s) g where b.d > 0 group by 1), o as (select grp, count(*) filter (event) as observed from s group by 1)
 select grp, observed, round(expected, 5) as expected, round((observed - expected) ** 2 / expected, 6) as part from o join e using (grp)""")
def log_rank_test(spark, d):
    x = G.log_rank(survival(spark, d), "grp")
    return x.select("grp", "observed", F.round("expected", 5).alias("expected"), F.round("part", 6).alias("part"))


PSM = "m as (select l.doc_id, d.n_chars % 997 as score, l.quality = 0 as decoy, l.toxic = 1 as pos from labels l join documents d using (doc_id))"


def psms(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return x.select("doc_id", (F.col("n_chars") % 997).alias("score"), (F.col("quality") == 0).alias("decoy"), (F.col("toxic") == 1).alias("pos"))


@query(f"""with {PSM}, f as (select *, sum(case when decoy then 1 else 0 end) over w / greatest(1, sum(case when decoy then 0 else 1 end) over w) as fdr from m window w as (order by score desc, decoy, doc_id rows unbounded preceding))
 select doc_id, round(fdr, 6) as fdr, round(least(1, min(fdr) over (order by score, decoy desc, doc_id desc rows unbounded preceding)), 6) as q from f""")
def target_decoy_q_values(spark, d):
    return R(G.q_values(psms(spark, d), "score", "decoy", "doc_id").select("doc_id", "fdr", "q"))


@query("""with x as (select c_nationkey, c_custkey, c_acctbal as s, c_mktsegment = 'BUILDING' as hit from customer), y as (select *, sum(case when hit then abs(s) else 0 end) over (partition by c_nationkey) as t, count(*) filter (not hit) over (partition by c_nationkey) as m from x),
 r as (select *, sum(case when hit then abs(s) / t else -1.0 / m end) over (partition by c_nationkey order by s desc, c_custkey rows unbounded preceding) as r from y)
 select c_nationkey, count(*) filter (hit) as hits, round(case when max(r) >= -min(r) then max(r) else min(r) end, 6) as es from r group by 1""")
def gene_set_enrichment(spark, d):
    x = table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal", (F.col("c_mktsegment") == "BUILDING").alias("hit"))
    return R(G.enrichment_score(x, ["c_nationkey"], "c_acctbal", "hit", "c_custkey"))


@query("""with x as (select source, n_chars as l, sum(n_chars) over (partition by source) as t, sum(n_chars) over (partition by source order by n_chars desc rows unbounded preceding) as c, row_number() over (partition by source order by n_chars desc) as i from documents)
 select source, count(*) as contigs, cast(max(t) as bigint) as total, max(l) filter (c >= ceil(t * 0.5)) as n50, cast(min(i) filter (c >= ceil(t * 0.5)) as int) as l50, max(l) filter (c >= ceil(t * 0.9)) as n90, round(sum(l * l) / max(t), 4) as aun from x group by 1""")
def assembly_n50(spark, d):
    return R(G.n50(table(spark, d, "documents"), "n_chars", ["source"]), 4)


@query(f"""with {PSM}, t as (select cast(score as double) as threshold, count(*) filter (pos) as p, count(*) filter (not pos) as n from m group by 1), c as (select threshold, sum(p) over w as tp, sum(n) over w as fp, sum(p) over () as ap, sum(n) over () as an from t window w as (order by threshold desc rows unbounded preceding))
 select threshold, round(fp / an, 6) as fpr, round(tp / ap, 6) as tpr, round(tp / (tp + fp), 6) as precision from c union all select 'infinity'::double, 0, 0, 1""")
def roc_curve(spark, d):
    return R(G.roc(psms(spark, d), "score", "pos"))


@query(f"""with {PSM}, t as (select score, count(*) filter (pos) as p, count(*) filter (not pos) as n from m group by 1), c as (select score, n, p, sum(p) over (order by score desc rows unbounded preceding) - p / 2 as tp from t) select round(sum(n * tp) / ((select count(*) filter (pos) from m) * (select count(*) filter (not pos) from m)), 7) as auc from c""")
def roc_auc(spark, d):
    return R(G.area(G.roc(psms(spark, d), "score", "pos"), "fpr", "tpr"), 7)


@query(f"""with {PSM}, c as (select count(*) filter (pos and score > 500)::double as tp, count(*) filter (not pos and score > 500)::double as fp, count(*) filter (pos and score <= 500)::double as fn, count(*) filter (not pos and score <= 500)::double as tn from m)
 select tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1, round(tn / (tn + fp), 6) as specificity,
 round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) as mcc from c""")
def confusion_scores(spark, d):
    return R(G.confusion(psms(spark, d).withColumn("guess", F.col("score") > 500), "pos", "guess"))
