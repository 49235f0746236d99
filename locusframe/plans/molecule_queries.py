"""Alignment, trees, spectra, structures, streams and sources over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusframe.functions import sequence as Q
from locusframe.operators import alignment as A
from locusframe.operators import ecology as E
from locusframe.operators import molecules as M
from locusframe.operators import trees as T
from locusframe.streaming import windows as X

from .ecology_queries import otu
from .registry import query, table
from .sequence_queries import PROT, PROTEIN, sequences
from .stats_queries import R


def names(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("a"), F.upper("p_type").alias("b"))


@query("select p_partkey as id, levenshtein(upper(p_name), upper(p_type)) as edits from part")
def edit_distances(spark, d):
    return names(spark, d).select("id", F.levenshtein("a", "b").cast("long").alias("edits"))


@query()
def needleman_wunsch(spark, d):
    return A.align_pairs(names(spark, d), "global")


@query()
def smith_waterman(spark, d):
    return A.align_pairs(names(spark, d), "local")


@query()
def semi_global_alignment(spark, d):
    return A.align_pairs(names(spark, d), "semiglobal")


def nation_trees(spark, d, method):
    region = table(spark, d, "nation").select(F.col("n_name").alias("sample_a"), F.col("n_regionkey").alias("region"))
    pairs = E.between(otu(spark, d)).join(region, "sample_a").join(region.select(F.col("sample_a").alias("sample_b"), F.col("region").alias("r2")), "sample_b").where("region = r2")
    return T.cluster_groups(pairs.select("region", F.col("sample_a").alias("item_a"), F.col("sample_b").alias("item_b"), F.col("bray_curtis").alias("distance")), "region", method)


@query()
def upgma_trees(spark, d):
    return nation_trees(spark, d, T.upgma)


@query()
def neighbor_joining_trees(spark, d):
    return nation_trees(spark, d, T.neighbor_joining)


@query()
def newick_node_table(spark, d):
    return T.newick_nodes(nation_trees(spark, d, T.upgma).withColumnRenamed("region", "id"))


@query("""with s as (select user_id as id, list_distinct(list(event_type || '-' || date_part('day', ts) || '-' || date_part('hour', ts))) as bits from events group by 1), x as (select id, len(bits) as n, unnest(bits) as bit from s),
 p as (select a.id as id_a, b.id as id_b, a.n as na, b.n as nb, count(*) as s from x a join x b on a.bit = b.bit and a.id < b.id group by 1, 2, 3, 4) select id_a, id_b, round(s / (na + nb - s), 6) as tanimoto from p where s / (na + nb - s) >= 0.02""")
def tanimoto_pairs(spark, d):
    x = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.collect_set(F.concat_ws("-", "event_type", F.dayofmonth("ts"), F.hour("ts"))).alias("bits"))
    return R(M.similar_sets(x, 0.02))


@query(f"""with {PROT}, p as (select unnest(string_split(regexp_replace(replace(replace(seq, 'KP', 'kP'), 'RP', 'rP'), '([KR])', '\\1|', 'g'), '|')) as p from s), q as (select distinct upper(p) as peptide from p where length(p) >= 2),
 m as (select * from (values {', '.join(f"('{a}', {w})" for a, w in Q.RESIDUE_MASS.items())}) v(aa, w)), r as (select peptide, i, w from (select peptide, unnest(range(1, length(peptide) + 1)) as i from q) join m on aa = peptide[i]),
 c as (select peptide, i, sum(w) over (partition by peptide order by i) as b, sum(w) over (partition by peptide order by i desc) as y, length(peptide) as n from r)
 select peptide, 'b' as ion, cast(i as int) as number, round(cast(b as double) + 1.00728, 5) as mz from c where i < n union all select peptide, 'y', cast(n - i + 1 as int), round(cast(y as double) + 18.01056 + 1.00728, 5) from c where i > 1""")
def peptide_fragments(spark, d):
    x = sequences(spark, d, PROTEIN).select(F.explode(Q.peptides(F.col("seq"))).alias("peptide")).where("length(peptide) >= 2").distinct()
    return M.fragment_table(x).withColumn("mz", F.round("mz", 5))


@query("select o_orderkey as id, c_custkey as b_id from orders join customer on abs(o_totalprice / 50 - c_acctbal) <= c_acctbal * 20 * 1e-6 where c_acctbal > 0 and o_totalprice > 0")
def mass_tolerance_join(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 50).alias("mz"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("mz"))
    return M.tolerance_join(a, b, 20.0).select("id", "b_id")


XYZ = "p as (select vec_id as id, label, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings)"


def points(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", *[e[i].cast("double").alias(c) for i, c in enumerate("xyz")])


@query(f"with {XYZ}, q as (select a.label, a.id as id_a, b.id as id_b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) as distance from p a join p b on a.label = b.label and a.id < b.id) select label, id_a, id_b, round(distance, 7) as distance from q where distance <= 0.1")
def contact_map(spark, d):
    return R(M.contacts(points(spark, d), 0.1, ["label"]), 7)


@query("""with e as (select vec_id as id, list_transform(embedding, lambda x: x::double) as v from embeddings), u as (select id, v[1]-v[4] as ax, v[2]-v[5] as ay, v[3]-v[6] as az, v[7]-v[4] as bx, v[8]-v[5] as by_, v[9]-v[6] as bz from e)
 select id, round(degrees(acos(greatest(-1, least(1, (ax*bx + ay*by_ + az*bz) / sqrt((ax*ax + ay*ay + az*az) * (bx*bx + by_*by_ + bz*bz)))))), 5) as angle from u""")
def bond_angles(spark, d):
    v = F.col("embedding").cast("array<double>")
    p, q, r = ([v[3 * k + i] for i in range(3)] for k in range(3))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.round(M.angle(p, q, r), 5).alias("angle"))


@query("""with e as (select vec_id as id, list_transform(embedding, lambda x: x::double) as v from embeddings), u as (select id, v[4]-v[1] as ax, v[5]-v[2] as ay, v[6]-v[3] as az, v[7]-v[4] as bx, v[8]-v[5] as by_, v[9]-v[6] as bz, v[10]-v[7] as cx, v[11]-v[8] as cy, v[12]-v[9] as cz from e),
 n as (select *, ay*bz - az*by_ as px, az*bx - ax*bz as py, ax*by_ - ay*bx as pz, by_*cz - bz*cy as qx, bz*cx - bx*cz as qy, bx*cy - by_*cx as qz from u)
 select id, round(degrees(atan2(((py*qz - pz*qy)*bx + (pz*qx - px*qz)*by_ + (px*qy - py*qx)*bz) / sqrt(bx*bx + by_*by_ + bz*bz), px*qx + py*qy + pz*qz)), 5) as dihedral from n""")
def dihedral_angles(spark, d):
    v = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.round(M.dihedral(*[[v[3 * k + i] for i in range(3)] for k in range(4)]), 5).alias("dihedral"))


@query("with x as (select label, (embedding[1]::double - embedding[4]::double) ** 2 + (embedding[2]::double - embedding[5]::double) ** 2 + (embedding[3]::double - embedding[6]::double) ** 2 as d from embeddings) select label, round(sqrt(avg(d)), 7) as rmsd from x group by 1")
def point_rmsd(spark, d):
    v = F.col("embedding").cast("array<double>")
    x = table(spark, d, "embeddings").select("label", *[v[i].alias(f"a{c}") for i, c in enumerate("xyz")], *[v[3 + i].alias(f"b{c}") for i, c in enumerate("xyz")])
    return R(M.rmsd(x, ["label"]), 7)


def event_stream(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


@query("select time_bucket(interval '6 hours', ts, timestamp '1970-01-01') as start, event_type, count(*) as n, round(sum(value), 4) as total, round(avg(value), 6) as mean from events group by 1, 2")
def streaming_windows(spark, d):
    x = X.run_to_table(X.tumbling(event_stream(spark, d), "ts", "6 hours", "1 day", ["event_type"], "value"), ["start", "event_type"])
    return x.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"))


@query("select time_bucket(interval '1 day', ts, timestamp '1970-01-01') as start, event_type, count(*) as n, round((2.0 + count(*)) / 1.5, 6) as posterior_mean from events group by 1, 2")
def streaming_gamma_poisson(spark, d):
    x = X.run_to_table(X.gamma_poisson(event_stream(spark, d), "ts", "1 day", "1 day", ["event_type"], 2.0, 0.5), ["start", "event_type"])
    return x.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("posterior_mean", 6).alias("posterior_mean"))


@query("select event_id, cast(props->>'k' as int) as k, sha256(props) as digest from events")
def json_properties(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.sha2("props", 256).alias("digest"))
