"""Interval algebra over lineitem, a part is a chromosome, a shipping day a position, the quantity a length, and over orders by customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusframe.operators import intervals as I

from .registry import query, table

WIDTH, SIZE = 64, 2700


def rows(spark, d):
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    return table(spark, d, "lineitem").select(
        F.col("l_partkey").cast("string").alias("chrom"), day.alias("start"), (day + F.col("l_quantity").cast("long")).alias("stop"),
        F.when(F.col("l_linenumber") % 2 == 0, "+").otherwise("-").alias("strand"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", day, F.col("l_quantity").cast("long")).alias("id"))


def shipped(spark, d):
    return rows(spark, d).distinct()


def ordered(spark, d):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    return table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("chrom"), day.alias("start"), (day + 20 + F.col("o_orderkey") % 30).alias("stop"), F.lit("+").alias("strand"), F.col("o_orderkey").cast("string").alias("id"))


def genome(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("chrom"), F.lit(SIZE).cast("long").alias("size"))


IV = """iv as (select cast(l_partkey as varchar) as chrom, cast(datediff('day', date '1992-01-01', cast(l_shipdate as date)) as bigint) as start,
  cast(datediff('day', date '1992-01-01', cast(l_shipdate as date)) + cast(l_quantity as bigint) as bigint) as stop, case when l_linenumber % 2 = 0 then '+' else '-' end as strand,
  concat_ws('-', l_orderkey, l_linenumber, l_partkey, datediff('day', date '1992-01-01', cast(l_shipdate as date)), cast(l_quantity as bigint)) as id, l_orderkey from lineitem),
a as (select distinct chrom, start, stop, strand, id from iv), b as (select cast(o_custkey as varchar) as chrom, cast(datediff('day', date '1992-01-01', cast(o_orderdate as date)) as bigint) as start,
  cast(datediff('day', date '1992-01-01', cast(o_orderdate as date)) + 20 + o_orderkey % 30 as bigint) as stop, '+' as strand, cast(o_orderkey as varchar) as id from orders),
genome as (select cast(p_partkey as varchar) as chrom, cast(2700 as bigint) as size from part)"""


def merged(src, name, by="chrom", gap=0):
    return f"""{name}0 as (select {by}, start, stop, max(stop) over (partition by {by} order by start, stop rows between unbounded preceding and 1 preceding) as reach from {src}),
{name}1 as (select *, sum(case when reach is null or start > reach + {gap} then 1 else 0 end) over (partition by {by} order by start, stop rows unbounded preceding) as isl from {name}0),
{name} as (select {by}, min(start) as start, max(stop) as stop, count(*) as n from {name}1 group by {by}, isl)"""


@query(f"with {IV}, {merged('iv', 'm')} select chrom, start, stop, n from m")
def merge_intervals(spark, d):
    return I.merge(rows(spark, d), bin_width=256)


@query(f"with {IV}, {merged('iv', 'm', 'chrom, strand', 5)} select chrom, strand, start, stop, n from m")
def merge_intervals_stranded_gap(spark, d):
    return I.merge(rows(spark, d), ["chrom", "strand"], 5, 256)


@query(f"with {IV}, u as (select chrom, start, stop from a union all select chrom, start, stop from b), {merged('u', 'm')} select chrom, start, stop, n from m")
def interval_union(spark, d):
    return I.merge(shipped(spark, d).select("chrom", "start", "stop").union(ordered(spark, d).select("chrom", "start", "stop")), bin_width=256)


@query(f"with {IV} select a.chrom, greatest(a.start, b.start) as start, least(a.stop, b.stop) as stop, count(*) as n from a join b on a.chrom = b.chrom and a.start < b.stop and b.start < a.stop group by 1, 2, 3")
def interval_intersect(spark, d):
    return I.intersect(shipped(spark, d), ordered(spark, d), WIDTH).groupBy("chrom", "start", "stop").agg(F.count("*").alias("n"))


@query(f"with {IV} select a.id, count(*) as n, cast(sum(least(a.stop, b.stop) - greatest(a.start, b.start)) as bigint) as bases from a join b on a.chrom = b.chrom and a.start < b.stop and b.start < a.stop group by 1")
def range_join_counts(spark, d):
    x = I.range_join(shipped(spark, d), ordered(spark, d), WIDTH)
    return x.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.least("stop", "b_stop") - F.greatest("start", "b_start")).alias("bases"))


@query(f"with {IV} select id, chrom, start, stop from a where exists (select 1 from b where a.chrom = b.chrom and a.start < b.stop and b.start < a.stop)")
def interval_overlap_semi(spark, d):
    return I.range_join(shipped(spark, d), ordered(spark, d), WIDTH, "left_semi", key=["id"]).select("id", "chrom", "start", "stop")


@query(f"with {IV} select id, chrom, start, stop from a where not exists (select 1 from b where a.chrom = b.chrom and a.start < b.stop and b.start < a.stop)")
def interval_overlap_anti(spark, d):
    return I.range_join(shipped(spark, d), ordered(spark, d), WIDTH, "left_anti", key=["id"]).select("id", "chrom", "start", "stop")


@query(f"""with {IV}, {merged('b', 'm')}, c as (select a.id, a.start as s, a.stop as e, m.start as bs, m.stop as be from a join m on a.chrom = m.chrom and a.start < m.stop and m.start < a.stop),
p as (select id, coalesce(lag(be) over (partition by id order by bs), s) as start, bs as stop from c union all select id, max(be), max(e) from c group by id
union all select id, start, stop from a where id not in (select id from c)) select id, start, stop from p where start < stop""")
def interval_subtract(spark, d):
    return I.subtract(shipped(spark, d).select("id", "chrom", "start", "stop"), ordered(spark, d), WIDTH).select("id", "start", "stop")


@query(f"""with {IV}, {merged('iv', 'm')}, u as (select chrom, start, stop from m union all select chrom, size, size from genome),
g as (select chrom, coalesce(lag(stop) over (partition by chrom order by start, stop), 0) as s, start as e from u) select chrom, s as start, e as stop from g where s < e""")
def interval_complement(spark, d):
    return I.complement(rows(spark, d), genome(spark, d))


@query(f"""with {IV}, p as (select a.id, b.start as bs, b.stop as be, case when a.start < b.stop and b.start < a.stop then 0 when b.stop <= a.start then a.start - b.stop else b.start - a.stop end as dist from a join b on a.chrom = b.chrom),
r as (select *, row_number() over (partition by id order by dist, bs, be) as k from p) select id, bs as b_start, be as b_stop, dist as distance from r where k = 1""")
def interval_closest(spark, d):
    return I.closest(shipped(spark, d), ordered(spark, d), WIDTH, 256).where("distance is not null").select("id", "b_start", "b_stop", "distance")


@query(f"with {IV}, s as (select chrom, size, unnest(range(0, size, 500)) as start from genome) select chrom, start, least(start + 500, size) as stop from s")
def tiling_windows(spark, d):
    return I.windows(genome(spark, d), 500)


@query(f"with {IV}, s as (select chrom, size, unnest(range(0, size, 450)) as start from genome) select chrom, start, least(start + 900, size) as stop from s")
def sliding_windows(spark, d):
    return I.windows(genome(spark, d), 900, 450)


COVER = """e as (select chrom, start as pos, 1 as d from iv union all select chrom, stop, -1 from iv), f as (select chrom, pos, sum(d) as d from e group by 1, 2 having sum(d) <> 0),
c as (select chrom, pos as start, lead(pos) over (partition by chrom order by pos) as stop, cast(sum(d) over (partition by chrom order by pos rows unbounded preceding) as bigint) as depth from f)"""


@query(f"with {IV}, {COVER} select chrom, start, stop, depth from c where depth > 0 and stop is not null")
def coverage_runs(spark, d):
    return I.coverage(rows(spark, d), 256)


@query(f"""with {IV}, {COVER}, t as (select chrom, sum(stop - start) as covered, sum((stop - start) * depth) as bases, max(depth) as md from c where depth > 0 and stop is not null group by 1)
select g.chrom, coalesce(md, 0) as max_depth, round(coalesce(covered, 0) / g.size, 6) as breadth, round(coalesce(bases, 0) / g.size, 6) as mean_depth from genome g left join t on g.chrom = t.chrom""")
def coverage_statistics(spark, d):
    return I.coverage_stats(rows(spark, d), genome(spark, d)).select("chrom", "max_depth", F.round("breadth", 6).alias("breadth"), F.round("mean_depth", 6).alias("mean_depth"))


@query(f"""with {IV}, {merged('a', 'm')}, {merged('b', 'n')}, i as (select sum(least(m.stop, n.stop) - greatest(m.start, n.start)) as shared from m join n on m.chrom = n.chrom and m.start < n.stop and n.start < m.stop),
x as (select (select sum(stop - start) from m) + (select sum(stop - start) from n) as s) select cast(shared as bigint) as shared, cast(s - shared as bigint) as either, round(shared / (s - shared), 9) as jaccard from i, x""")
def interval_jaccard(spark, d):
    return I.jaccard(shipped(spark, d), ordered(spark, d), WIDTH).withColumn("jaccard", F.round("jaccard", 9))


@query(f"with {IV} select id, greatest(0, start - 10) as start, least(size, stop + 20) as stop from iv join genome using (chrom)")
def interval_slop(spark, d):
    return I.slop(rows(spark, d), genome(spark, d), 10, 20).select("id", "start", "stop")


@query(f"with {IV}, f as (select id, greatest(0, start - 15) as start, start as stop from iv union all select id, stop, least(size, stop + 15) from iv join genome using (chrom)) select id, start, stop from f where start < stop")
def interval_flank(spark, d):
    return I.flank(rows(spark, d), genome(spark, d), 15).select("id", "start", "stop")


BLOCKS = """bl as (select chrom, k * 540 as start, k * 540 + 500 as stop, 't' || chrom as t_chrom, k * 500 as t_start, case when cast(chrom as bigint) % 2 = 0 then '+' else '-' end as strand, 2500 as t_size from genome, range(0, 5) r(k))"""


@query(f"""with {IV}, {BLOCKS}, x as (select iv.id, iv.start, iv.stop, bl.*, greatest(iv.start, bl.start) as s, least(iv.stop, bl.stop) as e from iv join bl on iv.chrom = bl.chrom and iv.start < bl.stop and bl.start < iv.stop),
y as (select id, start, stop, t_chrom, strand, case when strand = '+' then s - start_1 + t_start else t_size - (s - start_1 + t_start) - (e - s) end as ms, e - s as n from (select id, start, stop, t_chrom, strand, t_start, t_size, s, e, start_1 from (select iv.id, iv.start, iv.stop, bl.t_chrom, bl.strand, bl.t_start, bl.t_size, bl.start as start_1, greatest(iv.start, bl.start) as s, least(iv.stop, bl.stop) as e from iv join bl on iv.chrom = bl.chrom and iv.start < bl.stop and bl.start < iv.stop)))
select id, min(t_chrom) as t_chrom, cast(min(ms) as bigint) as t_start, cast(max(ms + n) as bigint) as t_stop, min(strand) as t_strand from y group by id, start, stop having sum(n) >= 0.95 * (stop - start)""")
def liftover_intervals(spark, d):
    k = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")
    blocks = genome(spark, d).select("chrom", k).select(
        "chrom", (F.col("k") * 540).cast("long").alias("start"), (F.col("k") * 540 + 500).cast("long").alias("stop"), F.concat(F.lit("t"), "chrom").alias("t_chrom"),
        (F.col("k") * 500).cast("long").alias("t_start"), F.when(F.col("chrom").cast("long") % 2 == 0, "+").otherwise("-").alias("strand"), F.lit(2500).cast("long").alias("t_size"))
    return I.liftover(rows(spark, d), blocks, WIDTH)
