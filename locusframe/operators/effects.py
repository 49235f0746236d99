"""Consequences of variants on transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions.sequence import codons, reverse_complement

from .intervals import range_join


def residue(codon: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in codons().items() for x in kv])
    return F.coalesce(table[F.upper(codon)], F.lit("X"))


def variant_effects(variants: DataFrame, transcripts: DataFrame, beside: int = 5000, width: int = 1 << 14, splice: int = 8) -> DataFrame:
    """Rows (id, transcript, effect, cds_position, change) for each variant and each transcript it is in or within `beside` of.

    variants: id, chrom, position (1-based), ref, alt. transcripts: transcript, chrom, start, stop,
    strand, coding, exons array<struct<start, stop>> in order of place, cds_start, cds_stop
    (half-open; null without one), cds (the coding letters in reading direction). effect: upstream,
    downstream, non_coding, intron, splice_donor and splice_acceptor (the two bases next to an
    exon), splice_region (up to `splice` bases), utr_5, utr_3, and in the coding part frameshift,
    inframe_insertion, inframe_deletion, block_substitution, synonymous, missense, stop_gained, stop_lost, start_lost. cds_position
    counts from 1; change is the codon's residue before and after. The first base of ref tells the place.
    """
    v = variants.select("id", "chrom", (F.col("position") - 1).alias("start"), F.col("position").alias("stop"), "ref", "alt")
    t = transcripts.select("chrom", F.greatest(F.lit(0), F.col("start") - beside).alias("start"), (F.col("stop") + beside).alias("stop"), F.col("start").alias("from"), F.col("stop").alias("to"),
                           "transcript", "strand", "coding", "exons", "cds_start", "cds_stop", "cds")
    x = range_join(v, t, width).select("id", F.col("start").alias("p"), "ref", "alt", *[F.col(f"b_{c}").alias(c) for c in ("transcript", "strand", "coding", "exons", "cds_start", "cds_stop", "cds", "from", "to")])
    p, back = F.col("p"), F.col("strand") == "-"
    before, after = p < F.col("from"), p >= F.col("to")
    exonic = F.exists("exons", lambda e: (e["start"] <= p) & (p < e["stop"]))
    # how far into an intron: from the exon that ends before, and from the one that starts after
    past = F.array_min(F.transform(F.filter("exons", lambda e: e["stop"] <= p), lambda e: p - e["stop"]))
    ahead = F.array_min(F.transform(F.filter("exons", lambda e: e["start"] > p), lambda e: e["start"] - p - 1))
    donor, acceptor = F.when(back, ahead).otherwise(past), F.when(back, past).otherwise(ahead)
    # coding bases at or before the place, along the strand
    part = lambda e: F.greatest(F.lit(0), F.when(
        back, F.least(e["stop"], F.col("cds_stop")) - F.greatest(e["start"], F.col("cds_start"), p)).otherwise(F.least(e["stop"], F.col("cds_stop"), p + 1) - F.greatest(e["start"], F.col("cds_start"))))
    at = F.aggregate("exons", F.lit(0).cast("long"), lambda n, e: n + part(e))
    first = F.floor((F.col("at") - 1) / 3) * 3 + 1
    old = F.substring(F.col("cds"), first.cast("int"), F.lit(3))
    letter = F.when(back, reverse_complement(F.col("alt"))).otherwise(F.col("alt"))
    k = F.pmod(F.col("at") - 1, F.lit(3)).cast("int")
    new = F.concat(F.substring(old, F.lit(1), k), letter, F.substring(old, k + 2, F.lit(3)))
    x = x.withColumn("in_cds", exonic & (p >= F.col("cds_start")) & (p < F.col("cds_stop"))).withColumn("at", F.when(F.col("in_cds"), at))
    grown = F.length("alt") - F.length("ref")
    x = x.withColumn("old", residue(old)).withColumn("new", residue(new))
    single = (F.length("ref") == 1) & (F.length("alt") == 1)
    coding = (F.when((grown != 0) & (F.pmod(grown, F.lit(3)) != 0), "frameshift").when(grown > 0, "inframe_insertion").when(grown < 0, "inframe_deletion").when(~single, "block_substitution")
              .when((F.col("at") <= 3) & (F.col("old") != F.col("new")), "start_lost").when(F.col("old") == F.col("new"), "synonymous").when(F.col("new") == "*", "stop_gained").when(F.col("old") == "*", "stop_lost").otherwise("missense"))
    effect = (F.when(before, F.when(back, "downstream").otherwise("upstream")).when(after, F.when(back, "upstream").otherwise("downstream")).when(~F.col("coding"), "non_coding")
              .when(~exonic, F.when(donor < 2, "splice_donor").when(acceptor < 2, "splice_acceptor").when(F.least(past, ahead) < splice, "splice_region").otherwise("intron"))
              .when(F.col("in_cds"), coding).when((p < F.col("cds_start")) != back, "utr_5").otherwise("utr_3"))
    x = x.withColumn("effect", effect)
    inside = F.col("in_cds") & F.col("coding")
    return x.select("id", "transcript", "effect", F.when(inside, F.col("at")).alias("cds_position"), F.when(inside & single, F.concat("old", F.lit(">"), "new")).alias("change"))
