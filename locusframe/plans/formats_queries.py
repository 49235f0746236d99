"""The driver's tables written in each format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusframe.operators.staging import folder
from locusframe.sources import text as T

from .interval_queries import IV, rows
from .registry import query, table


def place(spark, name):
    return folder(spark, f"formats-{name}")


@query(f"with {IV} select chrom, start, stop, id as name, cast(stop - start as double) as score, strand from iv")
def bed_round_trip(spark, d):
    at = place(spark, "bed")
    T.write_bed(rows(spark, d).select("chrom", "start", "stop", F.col("id").alias("name"), (F.col("stop") - F.col("start")).alias("score"), "strand"), at)
    return T.read_bed(spark, at)


@query(f"with {IV} select chrom, start, stop, cast(stop - start as double) / 4 as value from iv")
def bedgraph_round_trip(spark, d):
    at = place(spark, "bedgraph")
    T.write_bedgraph(rows(spark, d).select("chrom", "start", "stop", ((F.col("stop") - F.col("start")) / 4).alias("value")), at)
    return T.read_bedgraph(spark, at)


@query(f"with {IV} select chrom, 'made' as source, 'region' as type, start, stop, strand, id, 'a=b;' || cast(stop as varchar) || '%' as note from iv")
def gff_round_trip(spark, d):
    at = place(spark, "gff")
    notes = F.create_map(F.lit("ID"), "id", F.lit("Note"), F.concat(F.lit("a=b;"), F.col("stop").cast("string"), F.lit("%")))
    T.write_gff3(rows(spark, d).select("chrom", F.lit("made").alias("source"), F.lit("region").alias("type"), "start", "stop", F.lit(None).alias("score"), "strand", F.lit(None).alias("phase"), notes.alias("attributes")), at)
    return T.read_gff(spark, at).select("chrom", "source", "type", "start", "stop", "strand", F.col("attributes")["ID"].alias("id"), F.col("attributes")["Note"].alias("note"))


@query("""select cast(p_size as varchar) as chrom, p_partkey as position, case when p_partkey % 3 = 0 then null else 'rs' || cast(p_partkey as varchar) end as id, substr('ACGT', cast(p_partkey % 4 + 1 as int), 1) as ref, 'G,CA' as alts, case when p_partkey % 5 = 0 then null else p_retailprice end as quality,
 case when p_partkey % 2 = 0 then 'PASS' else 'q10' end as filter, cast(p_size as varchar) as depth from part""")
def vcf_round_trip(spark, d):
    at, k = place(spark, "vcf"), F.col("p_partkey")
    x = table(spark, d, "part").select(
        F.col("p_size").cast("string").alias("chrom"), k.alias("position"), F.when(k % 3 != 0, F.concat(F.lit("rs"), k.cast("string"))).alias("id"), F.expr("substr('ACGT', cast(p_partkey % 4 + 1 as int), 1)").alias("ref"), F.array(F.lit("G"), F.lit("CA")).alias("alts"),
        F.when(k % 5 != 0, F.col("p_retailprice")).alias("quality"), F.when(k % 2 == 0, "PASS").otherwise("q10").alias("filter"), F.create_map(F.lit("DP"), F.col("p_size").cast("string"), F.lit("DB"), F.lit(None).cast("string")).alias("info"))
    T.write_vcf(x, at, ['##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">'])
    return T.read_vcf(spark, at).select("chrom", "position", "id", "ref", F.array_join("alts", ",").alias("alts"), "quality", "filter", F.col("info")["DP"].alias("depth"))


@query("""select concat_ws('-', l_orderkey, l_linenumber) as qname, cast(l_orderkey * 37 % 4096 as int) as flag, 'chr' || cast(l_suppkey % 5 as varchar) as rname, l_partkey as pos, cast(l_quantity as int) as mapq, cast(cast(l_quantity as int) as varchar) || 'M' as cigar,
 cast(cast(l_quantity as int) as bigint) as span from lineitem""")
def sam_round_trip(spark, d):
    at, q = place(spark, "sam"), F.col("l_quantity").cast("int")
    x = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("qname"), (F.col("l_orderkey") * 37 % 4096).cast("int").alias("flag"), F.concat(F.lit("chr"), (F.col("l_suppkey") % 5).cast("string")).alias("rname"), F.col("l_partkey").alias("pos"), q.alias("mapq"),
                                           F.concat(q.cast("string"), F.lit("M")).alias("cigar"), *[F.lit(None).cast(k).alias(n) for n, k in T.SAM[6:]])
    T.write_sam(x, [(f"chr{i}", 200_000) for i in range(5)], at)
    return T.read_sam(spark, at).select("qname", "flag", "rname", "pos", "mapq", "cigar", T.reference_length(F.col("cigar")).alias("span"))


SEQ = "q as (select p_partkey as id, regexp_replace(upper(p_name || p_type || p_brand), '[^ACGT]', '', 'g') as seq, p_name from part)"


def letters(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.regexp_replace(F.upper(F.concat("p_name", "p_type", "p_brand")), "[^ACGT]", "").alias("seq"), "p_name")


@query(f"with {SEQ} select 's' || cast(id as varchar) as name, p_name as description, seq, cast(length(seq) as bigint) as length from q")
def fasta_round_trip(spark, d):
    at = place(spark, "fasta")
    T.write_fasta(letters(spark, d).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("name"), F.col("p_name").alias("description"), "seq"), at)
    x = T.read_fasta(spark, at)
    return x.select("name", "description", "seq", F.length("seq").cast("bigint").alias("length"))


@query(f"with {SEQ} select 's' || cast(id as varchar) as name, seq, list_transform(range(0, length(seq)), lambda i: cast((i * 7 + id) % 60 as int)) as qual from q")
def fastq_round_trip(spark, d):
    at = place(spark, "fastq")
    x = letters(spark, d).where("length(seq) > 0").union(letters(spark, d).where("length(seq) = 0"))
    qual = F.when(F.length("seq") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0))), lambda i: ((i * 7 + F.col("id")) % 60).cast("int"))).otherwise(F.array().cast("array<int>"))
    T.write_fastq(x.select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("name"), F.lit(None).cast("string").alias("description"), "seq", qual.alias("qual")), at)
    return T.read_fastq(spark, at).select("name", "seq", "qual")


@query("select 'g' || cast(n_nationkey as varchar) as name, r_name as description, list_transform(range(0, n_nationkey % 4 + 1), lambda i: n_name || cast(i as varchar)) as genes from nation join region on n_regionkey = r_regionkey")
def gene_set_round_trip(spark, d):
    at = place(spark, "gmt")
    x = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    T.write_gmt(x.select(F.concat(F.lit("g"), F.col("n_nationkey").cast("string")).alias("name"), F.col("r_name").alias("description"), F.transform(F.sequence(F.lit(0), F.col("n_nationkey") % 4), lambda i: F.concat("n_name", i.cast("string"))).alias("genes")), at)
    return T.read_gmt(spark, at)


@query("select distinct 's' || cast(l_suppkey as varchar) as src, l_returnflag as type, 'p' || cast(l_partkey as varchar) as dst from lineitem")
def edge_list_round_trip(spark, d):
    at = place(spark, "sif")
    T.write_sif(table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.col("l_returnflag").alias("type"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")).distinct(), at)
    return T.read_sif(spark, at)


@query("select l_suppkey as row, l_partkey as col, sum(l_quantity) as value from lineitem group by 1, 2")
def matrix_market_round_trip(spark, d):
    at = place(spark, "mtx")
    x = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col")).agg(F.sum("l_quantity").alias("value"))
    n = x.agg(F.max("row"), F.max("col")).first()
    T.write_mtx(x, n[0], n[1], at)
    return T.read_mtx(spark, at)


@query("""with p as (select l_orderkey, l_partkey + l_linenumber / 8 as mz, max(l_quantity) as intensity from lineitem group by 1, 2) select 'o' || cast(l_orderkey as varchar) as title, l_orderkey / 4 as pepmass, cast(l_orderkey % 3 + 1 as int) as charge, list(mz order by mz) as mzs, list(intensity order by mz) as intensities from p group by l_orderkey""")
def spectra_round_trip(spark, d):
    at = place(spark, "mgf")
    x = table(spark, d, "lineitem").groupBy("l_orderkey", (F.col("l_partkey") + F.col("l_linenumber") / 8).alias("mz")).agg(F.max("l_quantity").alias("intensity"))
    x = x.groupBy("l_orderkey").agg(F.collect_list(F.struct("mz", "intensity")).alias("peaks"))
    T.write_mgf(x.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("title"), (F.col("l_orderkey") / 4).alias("pepmass"), (F.col("l_orderkey") % 3 + 1).cast("int").alias("charge"), "peaks"), at)
    return T.read_mgf(spark, at).select("title", "pepmass", "charge", F.col("peaks.mz").alias("mzs"), F.col("peaks.intensity").alias("intensities"))


@query(f"with {SEQ} select 'l' as kind, cast(id as varchar) as a, cast(id + 1 as varchar) as b, cast(null as bigint) as length from q union all select 's', cast(id as varchar), nullif(seq, ''), cast(length(seq) as bigint) from q")
def assembly_graph_round_trip(spark, d):
    at, x = place(spark, "gfa"), letters(spark, d)
    segments = x.select(F.col("id").cast("string").alias("name"), F.nullif("seq", F.lit("")).alias("seq"), F.length("seq").alias("length"))
    T.write_gfa(segments, x.select(F.col("id").cast("string").alias("src"), F.lit("+").alias("src_strand"), (F.col("id") + 1).cast("string").alias("dst"), F.lit("-").alias("dst_strand"), F.lit("0M").alias("overlap")), at)
    s, l = T.read_gfa(spark, at)
    return s.select(F.lit("s").alias("kind"), F.col("name").alias("a"), F.col("seq").alias("b"), "length").union(l.select(F.lit("l"), "src", "dst", F.lit(None).cast("bigint")))


@query("""select 'q' || cast(l_orderkey as varchar) as query, 's' || cast(l_partkey as varchar) as subject, l_quantity * 2 as identity, l_suppkey as length, l_tax as evalue, l_extendedprice as bits from lineitem""")
def hit_table_round_trip(spark, d):
    at, n = place(spark, "blast"), F.col("l_linenumber")
    x = table(spark, d, "lineitem")
    T.write_lines(x, [F.concat(F.lit("q"), F.col("l_orderkey").cast("string")), F.concat(F.lit("s"), F.col("l_partkey").cast("string")), F.col("l_quantity") * 2, F.col("l_suppkey"), n, n, n, n, n, n, F.col("l_tax"), F.col("l_extendedprice")], at)
    return T.read_blast(spark, at).select("query", "subject", "identity", "length", "evalue", "bits")


@query(f"with {IV} select chrom, start, stop, id as name from iv where chrom = '17' and start < 1500 and stop > 200")
def interval_region_scan(spark, d):
    at = place(spark, "intervals")
    T.write_typed(rows(spark, d).withColumnRenamed("id", "name").withColumn("score", F.lit(0.0)), "intervals", at)
    return T.read_region(spark, "intervals", at, "17", 200, 1500).select("chrom", "start", "stop", "name")


@query("select p_partkey as position, p_retailprice as quality from part where p_size = 9 and p_partkey > 100 and p_partkey <= 1500")
def variant_region_scan(spark, d):
    at = place(spark, "variants")
    x = table(spark, d, "part").select(F.col("p_size").cast("string").alias("chrom"), F.col("p_partkey").alias("position"), F.lit(None).alias("id"), F.lit("A").alias("ref"), F.array(F.lit("T")).alias("alts"), F.col("p_retailprice").alias("quality"), F.lit("PASS").alias("filter"))
    T.write_typed(x, "variants", at)
    return T.read_region(spark, "variants", at, "9", 100, 1500).select("position", "quality")


@query("select 'g' || cast(l_partkey % 200 as varchar) as gene, 's' || cast(l_suppkey % 12 as varchar) as sample, sum(l_quantity) as value from lineitem group by 1, 2")
def expression_round_trip(spark, d):
    at = place(spark, "wide")
    x = table(spark, d, "lineitem").groupBy(F.concat(F.lit("g"), (F.col("l_partkey") % 200).cast("string")).alias("gene"), F.concat(F.lit("s"), (F.col("l_suppkey") % 12).cast("string")).alias("sample")).agg(F.sum("l_quantity").alias("value"))
    T.write_wide(x, "gene", "sample", "value", at)
    return T.read_wide(spark, at, "gene", "sample", "value")
