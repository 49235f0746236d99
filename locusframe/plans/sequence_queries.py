"""Sequence operators over documents: letters of the whole text stand for bases, or for residues."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusframe.functions import sequence as Q
from locusframe.operators import sequences as S

from .registry import query, table
from .stats_queries import R

LETTERS, DNA, PROTEIN = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC", "ACDEFGHIKLMNPQRSTVWYKRPAGL"
SEQ = f"s as (select doc_id as id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{DNA}') as seq from documents)"
PROT = SEQ.replace(DNA, PROTEIN)


def sequences(spark, d, letters=DNA):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), LETTERS, letters).alias("seq"))


def _n(x: str) -> str:
    return f"(length(seq) - length(replace(seq, '{x}', '')))"


@query(f"""with {SEQ}, c as (select id, length(seq) as n, {_n('A')} as a, {_n('C')} as c, {_n('G')} as g, {_n('T')} as t from s)
 select id, n, a, c, g, t, round(case when n > 0 then (g + c) / n else 0 end, 6) as gc, round(case when g + c > 0 then (g - c) / (g + c) else 0 end, 6) as skew,
 round({' + '.join(f"case when {x} > 0 then -{x} / n * log2({x} / n) else 0 end" for x in 'acgt')}, 6) as entropy from c""")
def base_composition(spark, d):
    x = F.col("seq")
    return R(sequences(spark, d).select("id", F.length(x).cast("long").alias("n"), *[Q.count_of(x, b).cast("long").alias(b.lower()) for b in "ACGT"], Q.gc_content(x).alias("gc"), Q.gc_skew(x).alias("skew"), Q.entropy(x).alias("entropy")))


@query(f"with {SEQ} select id, reverse(translate(seq, 'ACGT', 'TGCA')) as seq, md5(replace(seq, 'T', 'U')) as rna from s")
def reverse_complements(spark, d):
    return sequences(spark, d).select("id", Q.reverse_complement(F.col("seq")).alias("seq"), F.md5(Q.transcribe(F.col("seq"))).alias("rna"))


@query(f"with {SEQ}, k as (select substr(seq, p, 6) as kmer from (select seq, unnest(range(1, length(seq) - 4)) as p from s)) select kmer, count(*) as n from k group by 1")
def kmer_spectrum(spark, d):
    return S.kmer_counts(sequences(spark, d), 6)


CODONS = "g as (select * from (values " + ", ".join(f"('{c}', '{a}')" for c, a in Q.codons().items()) + ") v(codon, aa)), k as (select id, p, substr(seq, p, 3) as codon from (select id, seq, unnest(range(1, length(seq) - 1, 3)) as p from s))"


@query(f"with {SEQ}, {CODONS}, t as (select id, string_agg(aa, '' order by p) as protein from k join g using (codon) group by 1) select s.id, coalesce(protein, '') as protein from s left join t on s.id = t.id")
def translated_proteins(spark, d):
    return S.translate(sequences(spark, d))


@query(f"with {SEQ}, {CODONS}, u as (select codon, aa, count(*) as n from k join g using (codon) group by 1, 2) select codon, aa, n, round(n / avg(n) over (partition by aa), 6) as rscu from u")
def codon_usage(spark, d):
    from pyspark.sql import Window as W

    code = spark.createDataFrame(list(Q.codons().items()), "codon string, aa string")
    x = sequences(spark, d).select(F.explode(F.regexp_extract_all("seq", F.lit("..."), F.lit(0))).alias("codon")).groupBy("codon").agg(F.count("*").alias("n"))
    return R(x.join(F.broadcast(code), "codon").select("codon", "aa", "n", (F.col("n") / F.avg("n").over(W.partitionBy("aa"))).alias("rscu")))


@query(f"with {SEQ}, p as (select id, count(*) filter (substr(seq, p, 5) = 'ACACA') as n from (select id, seq, unnest(range(1, length(seq) + 2)) as p from s) group by 1) select id, n from p")
def motif_occurrences(spark, d):
    return sequences(spark, d).select("id", Q.occurrences(F.col("seq"), "ACACA").cast("long").alias("n"))


@query(f"with {SEQ}, f as (select id, unnest(string_split(replace(seq, 'GATC', 'G|ATC'), '|')) as f from s) select id, count(*) as fragments, min(length(f)) as shortest, max(length(f)) as longest, round(avg(length(f)), 4) as mean from f group by 1")
def restriction_fragments(spark, d):
    x = sequences(spark, d).select("id", F.explode(Q.fragments(F.col("seq"), "GATC", 1)).alias("f"))
    return R(x.groupBy("id").agg(F.count("*").alias("fragments"), F.min(F.length("f")).cast("long").alias("shortest"), F.max(F.length("f")).cast("long").alias("longest"), F.avg(F.length("f")).alias("mean")), 4)


@query(f"""with {PROT} select id, length(seq) as n, round({' + '.join(f"{_n(a)} * {m}" for a, m in Q.RESIDUE_MASS.items())} + {Q.WATER}, 6) as mass, round(case when length(seq) > 0 then ({' + '.join(f"{_n(a)} * ({h})" for a, h in Q.HYDROPATHY.items())}) / length(seq) else 0 end, 9) as gravy from s""")
def protein_properties(spark, d):
    x = F.col("seq")
    return sequences(spark, d, PROTEIN).select("id", F.length(x).cast("long").alias("n"), F.round(Q.peptide_mass(x), 6).alias("mass"), F.round(Q.gravy(x), 9).alias("gravy"))


@query(f"with {PROT}, p as (select unnest(string_split(regexp_replace(replace(replace(seq, 'KP', 'kP'), 'RP', 'rP'), '([KR])', '\\1|', 'g'), '|')) as p from s), q as (select upper(p) as peptide from p where p <> '') select peptide, count(*) as n from q group by 1")
def tryptic_peptides(spark, d):
    return sequences(spark, d, PROTEIN).select(F.explode(Q.peptides(F.col("seq"))).alias("peptide")).groupBy("peptide").agg(F.count("*").alias("n"))


@query(f"with {SEQ}, m as (select length(seq) as n, {_n('G')} + {_n('C')} as gc, id from s) select id, round(case when n < 14 then 2.0 * (n - gc) + 4.0 * gc else 64.9 + 41 * (gc - 16.4) / n end, 5) as tm from m")
def melting_temperatures(spark, d):
    return sequences(spark, d).select("id", F.round(Q.melting_temperature(F.col("seq")), 5).alias("tm"))


FRAMES = """t as (select id, '+' as strand, seq, length(seq) as n from s union all select id, '-', reverse(translate(seq, 'ACGT', 'TGCA')), length(seq) from s), c as (select id, strand, n, (p - 1) % 3 as frame, p - 1 as p, substr(seq, p, 3) as codon from (select *, unnest(range(1, n - 1)) as p from t)),
 e as (select id, strand, n, frame, p, codon, coalesce(max(case when codon in ('TAA', 'TAG', 'TGA') then p end) over (partition by id, strand, frame order by p rows between unbounded preceding and 1 preceding), -1) as prior from c where codon in ('TAA', 'TAG', 'TGA', 'ATG')),
 f as (select id, strand, n, frame, prior, min(case when codon = 'ATG' then p end) as a, max(case when codon <> 'ATG' then p end) + 3 as b from e group by 1, 2, 3, 4, 5)"""


@query(f"with {SEQ}, {FRAMES} select id, strand, cast(frame as int) as frame, case when strand = '+' then a else n - b end as start, case when strand = '+' then b else n - a end as stop from f where a < b and b - a >= 60")
def open_reading_frames(spark, d):
    return S.reading_frames(sequences(spark, d), 60)


@query()
def sequence_minimizers(spark, d):
    return S.minimizers(sequences(spark, d), 15, 10)


@query()
def minhash_sketches(spark, d):
    return S.sketches(sequences(spark, d), 15, 64)


def _odds(letter: str) -> str:
    import math

    return " + ".join(f"case when substr(seq, p + {k}, 1) = '{x}' then {math.log2(8.5 / 10 / 0.25)!r} else {math.log2(0.5 / 10 / 0.25)!r} end" for k, x in enumerate(letter))


@query(f"""with {SEQ}, p as (select id, p - 1 as "at", {_odds('TATAAT')} as score from (select id, seq, unnest(range(1, length(seq) - 4)) as p from s)) select id, "at", round(score, 6) as score from p where score >= 8""")
def motif_matrix_hits(spark, d):
    return R(S.scan_matrix(sequences(spark, d), [{x: 8} for x in "TATAAT"], 8.0))
