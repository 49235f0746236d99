"""Reads, variants in sets, spectra and profiles over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusframe.operators import effects as E
from locusframe.operators import genetics as G
from locusframe.operators import ordering as O
from locusframe.operators import profiles as P
from locusframe.operators import reads as A
from locusframe.operators import spectra as S

from .genetics_queries import GT, PSM, VAR, genotypes, psms, variants
from .registry import query, table
from .stats_queries import R

READ = """reads as (select 'r' || cast(l_orderkey // 2 as varchar) as qname, cast(l_orderkey * 37 % 4096 as int) as flag, case when l_partkey % 17 = 0 then null else 'chr' || cast(l_suppkey % 5 as varchar) end as rname,
 case when l_partkey % 17 = 0 then null else l_partkey end as pos, cast(l_quantity as int) as mapq, cast(l_linenumber as varchar) || 'S' || cast(cast(l_quantity as int) as varchar) || 'M' || cast(l_suppkey % 4 + 1 as varchar) || 'I' || cast(l_orderkey % 9 + 1 as varchar) || 'D20M' as cigar,
 cast(l_extendedprice as bigint) % 900 - 200 as tlen, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_extendedprice * 100 as bigint)) as tag from lineitem)"""


def reads(spark, d):
    k = lambda c: F.col(c).cast("string")
    placed = F.col("l_partkey") % 17 != 0
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("r"), F.expr("cast(l_orderkey div 2 as string)")).alias("qname"), (F.col("l_orderkey") * 37 % 4096).cast("int").alias("flag"),
        F.when(placed, F.concat(F.lit("chr"), (F.col("l_suppkey") % 5).cast("string"))).alias("rname"), F.when(placed, F.col("l_partkey")).alias("pos"), F.col("l_quantity").cast("int").alias("mapq"),
        F.concat(k("l_linenumber"), F.lit("S"), F.col("l_quantity").cast("int").cast("string"), F.lit("M"), (F.col("l_suppkey") % 4 + 1).cast("string"), F.lit("I"), (F.col("l_orderkey") % 9 + 1).cast("string"), F.lit("D20M")).alias("cigar"),
        (F.round("l_extendedprice").cast("long") % 900 - 200).alias("tlen"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long")).alias("tag"))


READ = READ.replace("cast(l_extendedprice as bigint)", "cast(round(l_extendedprice) as bigint)").replace("cast(l_extendedprice * 100 as bigint)", "cast(round(l_extendedprice * 100) as bigint)")


@query(f"with {READ} select tag, row_number() over (order by rname nulls last, pos nulls last, tag) as position from reads")
def coordinate_sorted_reads(spark, d):
    return A.coordinate_sorted(reads(spark, d), "tag").select("tag", "position")


@query(f"with {READ} select tag, row_number() over (order by qname, flag & 192, tag) as position from reads")
def name_sorted_reads(spark, d):
    return A.name_sorted(reads(spark, d), "tag").select("tag", "position")


@query(f"with {READ} select tag, row_number() over (order by rname nulls last, pos nulls last, tag) as position from (select * from reads where mapq >= 25 union all select * from reads where mapq < 25)")
def merged_sorted_runs(spark, d):
    x = reads(spark, d)
    return A.merged_runs([x.where("mapq >= 25"), x.where("mapq < 25")], "tag").select("tag", "position")


def _ops(letters: str) -> str:
    return f"coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[{letters}]', 1), lambda x: cast(x as bigint))), 0)"


@query(f"""with {READ} select rname, count(*) as reads, count(*) filter (flag & 4 = 0) as mapped, round(avg(mapq) filter (flag & 4 = 0), 6) as mapq, cast(sum({_ops('M=X')}) filter (flag & 4 = 0) as bigint) as aligned, cast(sum({_ops('I')}) filter (flag & 4 = 0) as bigint) as inserted,
 cast(sum({_ops('D')}) filter (flag & 4 = 0) as bigint) as deleted, cast(sum({_ops('SH')}) filter (flag & 4 = 0) as bigint) as clipped, round(avg(tlen) filter (flag & 4 = 0 and flag & 2 <> 0 and tlen > 0), 6) as insert_size, round(stddev_samp(tlen) filter (flag & 4 = 0 and flag & 2 <> 0 and tlen > 0), 6) as insert_sd from reads group by 1""")
def alignment_statistics(spark, d):
    return R(A.alignment_stats(reads(spark, d), ["rname"]))


@query(f"with {READ}, f as (select 'chr' || cast(i as varchar) as rname, cast(200000 as bigint) as length from range(0, 7) t(i) union all select '*', 0) select f.rname, length, count(*) filter (flag & 4 = 0) as mapped, count(*) filter (flag & 4 <> 0) as unmapped from f left join reads r on f.rname = coalesce(r.rname, '*') group by 1, 2")
def reference_index_statistics(spark, d):
    return A.idxstats(reads(spark, d), spark.range(7).select(F.concat(F.lit("chr"), F.col("id").cast("string")).alias("rname"), F.lit(200000).alias("length")))


@query("""with p as (select 'p' || cast(l_orderkey as varchar) as qname, l_linenumber, min('chr' || cast(l_suppkey % 3 as varchar)) as rname, min(l_partkey) as pos, max(cast(l_quantity as bigint)) + 20 as len from lineitem where l_linenumber <= 2 group by l_orderkey, l_linenumber)
 select a.qname, a.rname, a.pos, b.rname as rnext, b.pos as pnext, case when a.rname <> b.rname then 0 when a.pos <= b.pos then greatest(a.pos + a.len, b.pos + b.len) - a.pos else b.pos - greatest(a.pos + a.len, b.pos + b.len) end as tlen from p a join p b on a.qname = b.qname and a.l_linenumber = 1 and b.l_linenumber = 2""")
def fixed_mates(spark, d):
    x = table(spark, d, "lineitem").where("l_linenumber <= 2").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.concat(F.lit("chr"), (F.col("l_suppkey") % 3).cast("string"))).alias("rname"), F.min("l_partkey").alias("pos"), F.max(F.col("l_quantity").cast("long")).alias("m"))
    x = x.select(F.concat(F.lit("p"), F.col("l_orderkey").cast("string")).alias("qname"), F.when(F.col("l_linenumber") == 1, 65).otherwise(129).alias("flag"), "rname", "pos", F.concat(F.col("m").cast("string"), F.lit("M5I20M")).alias("cigar"))
    return A.fix_mates(x)


@query("with t as (select count(*)::double as t from lineitem) select cast(l_suppkey as varchar) as chrom, l_partkey // 100 * 100 as start, count(*) as n, round(count(*) * 1e6 / max(t), 5) as cpm, round(count(*) * 1e9 / (max(t) * 100), 5) as rpkm from lineitem, t group by 1, 2")
def window_signal(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("chrom"), F.col("l_partkey").alias("start"))
    return R(A.window_signal(x, 100), 5)


@query("""with r as (select cast(l_suppkey as varchar) as chrom, l_partkey as start, l_partkey + cast(l_quantity as bigint) as stop from lineitem), p as (select cast(s_suppkey as varchar) as chrom, s_suppkey * 7 % 500 as start, s_suppkey * 7 % 500 + 300 as stop from supplier),
 i as (select count(*) as inside from r where exists (select 1 from p where p.chrom = r.chrom and r.start < p.stop and p.start < r.stop)), n as (select count(*) as reads from r) select reads, inside, round(inside / reads, 8) as frip from n, i""")
def reads_in_peaks(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("chrom"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("stop"))
    k = F.col("s_suppkey") * 7 % 500
    return R(A.reads_in_peaks(r, table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("chrom"), k.alias("start"), (k + 300).alias("stop")), 128, ["chrom", "start", "stop"]), 8)


@query("""with v as (select p_partkey as position, repeat('A', cast(p_partkey % 3 + 1 as int)) || substr('CGTACG', cast(p_partkey % 4 + 1 as int), 2) || 'TT' as ref, repeat('A', cast(p_partkey % 3 + 1 as int)) || substr('GATTAC', cast(p_partkey % 5 + 1 as int), 1) || 'TT' as alt, p_partkey as id from part),
 x as (select *, (select max(k) from range(0, least(length(ref), length(alt))) t(k) where right(ref, cast(k as int)) = right(alt, cast(k as int))) as k from v), y as (select id, position, left(ref, length(ref) - cast(k as int)) as ref, left(alt, length(alt) - cast(k as int)) as alt from x),
 z as (select *, (select max(k) from range(0, least(length(ref), length(alt))) t(k) where left(ref, cast(k as int)) = left(alt, cast(k as int))) as f from y) select id, position + f as position, substr(ref, f + 1) as ref, substr(alt, f + 1) as alt from z""")
def normalised_variants(spark, d):
    k = F.col("p_partkey")
    head = F.expr("repeat('A', cast(p_partkey % 3 + 1 as int))")
    x = table(spark, d, "part").select(k.alias("id"), k.alias("position"), F.concat(head, F.expr("substr('CGTACG', cast(p_partkey % 4 + 1 as int), 2)"), F.lit("TT")).alias("ref"), F.concat(head, F.expr("substr('GATTAC', cast(p_partkey % 5 + 1 as int), 1)"), F.lit("TT")).alias("alt"))
    return G.normalise_variants(x)


@query(f"with {VAR}, s as (select *, 'all' as n from v union all select *, 'good' from v where quality >= 60 union all select *, 'passed' from v where filter = 'PASS') select chrom, position, ref, alt, string_agg(n, ',' order by n) as sets, max(quality) as quality from s group by 1, 2, 3, 4")
def merged_variant_sets(spark, d):
    v = variants(spark, d)
    x = G.merge_sets({"all": v, "good": v.where("quality >= 60"), "passed": v.where("filter = 'PASS'")}, ["chrom", "position", "ref", "alt"])
    return x.select("chrom", "position", "ref", "alt", F.array_join("sets", ",").alias("sets"), "quality")


@query(f"with {VAR} select v.position, v.ref, v.alt, 'rs' || cast(o_orderkey as varchar) as id from v left join orders on o_orderkey = v.position and o_custkey % 2 = 0")
def annotated_identifiers(spark, d):
    known = table(spark, d, "orders").where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("position"), F.concat(F.lit("rs"), F.col("o_orderkey").cast("string")).alias("id"))
    return variants(spark, d).join(known, "position", "left").select("position", "ref", "alt", "id")


@query(f"""with {GT}, x as (select locus, count(gt) filter (pop = 0)::double as n1, count(gt) filter (pop = 1)::double as n2, avg(gt) filter (pop = 0) / 2 as p1, avg(gt) filter (pop = 1) / 2 as p2 from g group by 1),
 y as (select (p1 - p2) ** 2 - p1 * (1 - p1) / (2 * n1 - 1) - p2 * (1 - p2) / (2 * n2 - 1) as num, p1 * (1 - p2) + p2 * (1 - p1) as den from x where n1 > 0 and n2 > 0) select count(*) as loci, round(sum(num), 6) as num, round(sum(den), 6) as den, round(sum(num) / sum(den), 7) as fst from y""")
def hudson_fixation_index(spark, d):
    x = G.hudson_fst(genotypes(spark, d), "locus", "pop", "gt", 0, 1)
    return x.select("loci", F.round("num", 6).alias("num"), F.round("den", 6).alias("den"), F.round("fst", 7).alias("fst"))


@query(f"""with {GT}, s as (select locus, pop, count(*)::double as n, avg(gt) / 2 as p, avg(case when gt = 1 then 1.0::double else 0 end) as h from g where gt is not null group by 1, 2), t as (select locus, count(*) as r, sum(n) as s, sum(n * n) as sq, sum(n * p) / sum(n) as p, sum(n * h) / sum(n) as h, sum(n * p * p) as npp from s group by 1 having count(*) > 1),
 u as (select *, s / r as m, (s - sq / s) / (r - 1) as nc, (npp - s * p * p) / ((r - 1) * (s / r)) as s2 from t), v as (select *, p * (1 - p) - (r - 1) / r * s2 as i from u), w as (select locus, m / nc * (s2 - (i - h / 4) / (m - 1)) as a, m / (m - 1) * (i - (2 * m - 1) / (4 * m) * h) as b, h / 2 as c from v)
 select locus, round(a, 7) as a, round(b, 7) as b, round(c, 7) as c, round(case when a + b + c = 0 then 0 else a / (a + b + c) end, 6) as theta from w""")
def variance_component_fst(spark, d):
    x = G.weir_cockerham(genotypes(spark, d), "locus", "pop", "gt")
    return x.select("locus", F.round("a", 7).alias("a"), F.round("b", 7).alias("b"), F.round("c", 7).alias("c"), F.round("theta", 6).alias("theta"))


@query(f"""with {PSM}, t as (select cast(score as double) as threshold, count(*) filter (pos) as p, count(*) filter (not pos) as n from m group by 1), c as (select threshold, sum(p) over w as tp, sum(n) over w as fp, sum(p) over () as ap from t window w as (order by threshold desc rows unbounded preceding)),
 r as (select threshold, tp / ap as x, tp / (tp + fp) as y from c union all select 'infinity'::double, 0, 1), l as (select x, y, lag(x) over (order by threshold desc) as px, lag(y) over (order by threshold desc) as py from r) select round(sum((x - px) * (y + py) / 2), 7) as auc from l""")
def precision_recall_auc(spark, d):
    return R(G.area(G.roc(psms(spark, d), "score", "pos"), "tpr", "precision"), 7)


SPEC = "s as (select l_suppkey as id, cast(l_partkey as double) / 7 as mz, sum(l_extendedprice) as intensity from lineitem group by 1, 2)"


def spectra(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id"), (F.col("l_partkey").cast("double") / 7).alias("mz")).agg(F.sum("l_extendedprice").alias("intensity"))


@query(f"with {SPEC}, r as (select *, row_number() over (partition by id order by round(intensity, 2) desc, mz) as rank from s) select id, round(mz, 6) as mz, cast(rank as int) as rank from r where rank <= 10")
def strongest_peaks(spark, d):
    return S.top_peaks(spectra(spark, d).withColumn("intensity", F.round("intensity", 2)), 10).select("id", F.round("mz", 6).alias("mz"), "rank")


@query(f"with {SPEC}, r as (select *, intensity / max(intensity) over (partition by id) as relative from s) select id, round(mz, 6) as mz, round(relative, 6) as relative from r where round(relative, 9) >= 0.5")
def relative_peak_filter(spark, d):
    x = S.above(spectra(spark, d), 0.0).where(F.round("relative", 9) >= 0.5)
    return x.select("id", F.round("mz", 6).alias("mz"), F.round("relative", 6).alias("relative"))


@query(f"with {SPEC} select id, count(*) as peaks, round(sum(intensity), 2) as tic, round(max(intensity), 2) as base, round(arg_max(mz, intensity), 6) as base_mz from s group by 1")
def spectrum_currents(spark, d):
    x = S.total_ion_current(spectra(spark, d))
    return x.select("id", "peaks", F.round("tic", 2).alias("tic"), F.round("base", 2).alias("base"), F.round("base_mz", 6).alias("base_mz"))


@query("with m as (select l_orderkey as spectrum, concat_ws('-', l_partkey, l_linenumber, l_suppkey) as peptide, cast(l_quantity as double) as score from lineitem), r as (select *, row_number() over w as r, lead(score) over w as n from m window w as (partition by spectrum order by score desc, peptide)) select spectrum, peptide, score, coalesce(score - n, 0) as delta from r where r = 1")
def best_peptide_matches(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("spectrum"), F.concat_ws("-", "l_partkey", "l_linenumber", "l_suppkey").alias("peptide"), F.col("l_quantity").cast("double").alias("score"))
    return S.best_matches(x, "score", "peptide")


@query("""with t as (select l_linenumber as c, sum(l_extendedprice) as t from lineitem group by 1), k as (select *, (select avg(t) from t) as m from t), x as (select l_suppkey as protein, l_linenumber as channel, sum(l_extendedprice * m / t) as scaled from lineitem join k on c = l_linenumber group by 1, 2)
 select x.protein, x.channel, round(x.scaled, 3) as scaled, round(log2(x.scaled / b.scaled), 6) as log2_ratio from x join x b on b.protein = x.protein and b.channel = 1 where b.scaled > 0 and x.scaled > 0""")
def reporter_ion_ratios(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("protein"), F.col("l_linenumber").alias("channel"), F.col("l_extendedprice").alias("intensity"))
    x = S.reporter_ratios(x, "channel", "intensity", 1)
    return x.select("protein", "channel", F.round("scaled", 3).alias("scaled"), F.round("log2_ratio", 6).alias("log2_ratio"))


PROFILE = "p as (select l_suppkey as sample, l_partkey % 50 as taxon, cast(sum(l_quantity) as bigint) as n from lineitem group by 1, 2)"


def profile(spark, d, where="true"):
    return table(spark, d, "lineitem").where(where).groupBy(F.col("l_suppkey").alias("sample"), (F.col("l_partkey") % 50).alias("taxon")).agg(F.sum("l_quantity").cast("long").alias("n"))


@query(f"with {PROFILE} select sample, taxon, n, round(n / sum(n) over (partition by sample), 8) as share from p")
def taxon_shares(spark, d):
    return R(P.shares(profile(spark, d)), 8)


@query(f"with {PROFILE} select sample, taxon, n from p")
def merged_profiles(spark, d):
    return P.merge_profiles([profile(spark, d, f"l_returnflag = '{x}'") for x in "ANR"])


@query(f"with {PROFILE}, s as (select *, n / sum(n) over (partition by sample) as share from p), k as (select taxon from s where round(share, 9) >= 0.02 group by 1 having count(*) >= 45) select sample, taxon, n from p where taxon in (select taxon from k)")
def filtered_profiles(spark, d):
    return P.filtered(profile(spark, d), 0.02, 45)


_U = "cast('0x' || substr(md5('{seed}:' || {key}), 1, 8) as bigint)::double / 4294967296"


def _weight(b: int) -> str:
    u = _U.format(seed=b, key="cast(c_custkey as varchar)")
    return " + ".join(f"cast({u} >= {c} as int)" for c in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015))


@query(f"""with x as (select c_mktsegment, count(*) as n, [{', '.join(f"coalesce(sum(({_weight(b)}) * c_acctbal) / nullif(sum({_weight(b)}), 0), 0)" for b in range(20))}] as m from customer group by 1)
 select c_mktsegment, n, round(list_avg(m), 5) as mean, round(list_stddev_samp(m), 5) as se from x""")
def bootstrap_means(spark, d):
    return R(P.bootstrap(table(spark, d, "customer"), "c_custkey", "c_acctbal", ["c_mktsegment"], 20), 5)


def _gap(g: str) -> str:
    return f"avg(c_acctbal) filter ({g}) - avg(c_acctbal) filter (not ({g}))"


@query(f"""with o as (select c_mktsegment as s, avg(case when c_nationkey < 10 then 1.0::double else 0 end) as odds from customer group by 1), x as (select c_mktsegment, {_gap('c_nationkey < 10')} as difference, [{', '.join(_gap(_U.format(seed=f'p{k}', key='cast(c_custkey as varchar)') + ' < odds') for k in range(20))}] as d from customer join o on s = c_mktsegment group by 1),
 y as (select *, len(list_filter(d, lambda v: abs(v) >= abs(difference))) as extreme from x) select c_mktsegment, round(difference, 6) as difference, cast(extreme as int) as extreme, round((extreme + 1) / 21, 6) as p from y""")
def permutation_p_values(spark, d):
    return R(P.permutation_test(table(spark, d, "customer"), "c_custkey", "c_acctbal", F.col("c_nationkey") < 10, ["c_mktsegment"], 20))


@query("select l_suppkey, count(*) as degree from lineitem group by 1 order by degree desc, l_suppkey limit 10")
def top_central_nodes(spark, d):
    x = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("degree"))
    return O.top(x, [F.desc("degree"), F.asc("l_suppkey")], 10)


@query("select event_id, count(*) over (partition by user_id order by ts range between interval 6 hours preceding and current row) as recent, round(sum(value) over (partition by user_id order by ts range between interval 6 hours preceding and current row), 5) as total from events")
def recent_event_windows(spark, d):
    from pyspark.sql import Window as W

    x = table(spark, d, "events").withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp")))
    line = W.partitionBy("user_id").orderBy("_t").rangeBetween(-6 * 3_600_000_000, 0)
    return x.select("event_id", F.count("*").over(line).alias("recent"), F.round(F.sum("value").over(line), 5).alias("total"))


def transcripts(spark, d):
    """Made transcripts of three exons, 30 bases each, 10 apart; the coding part leaves 6 bases at either end."""
    k, a = F.col("p_partkey"), F.col("p_partkey") * 40
    exons = F.array(*[F.struct((a + 40 * i).alias("start"), (a + 40 * i + 30).alias("stop")) for i in range(3)])
    return table(spark, d, "part").select(F.concat(F.lit("t"), k.cast("string")).alias("transcript"), F.concat(F.lit("chr"), (F.col("p_size") % 3).cast("string")).alias("chrom"), a.alias("start"), (a + 110).alias("stop"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"),
                                          (k % 7 != 0).alias("coding"), exons.alias("exons"), (a + 6).alias("cds_start"), (a + 104).alias("cds_stop"), F.expr("concat('ATG', repeat('GCA', 24), 'TAA')").alias("cds"))


@query()
def variant_consequences(spark, d):
    k = F.col("o_orderkey")
    v = table(spark, d, "orders").select(k.alias("id"), F.concat(F.lit("chr"), (k % 3).cast("string")).alias("chrom"), (k % 80_000 + 1).alias("position"), F.lit("A").alias("ref"), F.expr("substr('CGTCAGTT', cast(o_orderkey % 5 + 1 as int), cast(1 + o_orderkey % 11 div 10 as int))").alias("alt"))
    return E.variant_effects(v, transcripts(spark, d), 20, 128)


@query(f"with {READ} select rname, count(*) as n, min(pos) as first, max(pos) as last, round(avg(mapq), 6) as mapq, count(distinct qname) as names from reads group by 1")
def read_summaries(spark, d):
    return R(reads(spark, d).groupBy("rname").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.avg("mapq").alias("mapq"), F.count_distinct("qname").alias("names")))


@query("with i as (select l_partkey as chrom, cast(l_quantity as bigint) as size from lineitem) select chrom, count(*) as n, cast(sum(size) as bigint) as bases, min(size) as shortest, max(size) as longest, round(avg(size), 6) as mean, round(median(size), 6) as median from i group by 1")
def interval_summaries(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_partkey").alias("chrom"), F.col("l_quantity").cast("long").alias("size"))
    return R(x.groupBy("chrom").agg(F.count("*").alias("n"), F.sum("size").alias("bases"), F.min("size").alias("shortest"), F.max("size").alias("longest"), F.avg("size").alias("mean"), F.percentile("size", 0.5).alias("median")))


@query("""with q as (select l_orderkey as id, list(cast(l_quantity as int)) as q from lineitem group by 1) select count(*) as reads, cast(sum(len(q)) as bigint) as bases, round(sum(list_sum(q)) / sum(len(q)), 6) as mean_quality,
 round(sum(len(list_filter(q, lambda x: x >= 20))) / sum(len(q)), 6) as q20, round(sum(len(list_filter(q, lambda x: x >= 30))) / sum(len(q)), 6) as q30, min(len(q)) as shortest, max(len(q)) as longest from q""")
def quality_summary(spark, d):
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("int")).alias("q"))
    share = lambda t: (F.sum(F.size(F.filter("q", lambda v: v >= t))) / F.sum(F.size("q")))
    return R(x.agg(F.count("*").alias("reads"), F.sum(F.size("q")).alias("bases"), (F.sum(F.aggregate("q", F.lit(0), lambda t, v: t + v)) / F.sum(F.size("q"))).alias("mean_quality"), share(20).alias("q20"), share(30).alias("q30"),
                   F.min(F.size("q")).cast("long").alias("shortest"), F.max(F.size("q")).cast("long").alias("longest")))
