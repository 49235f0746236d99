"""Aligned reads (qname, flag, rname, pos, mapq, cigar, tlen, ...): order, CIGAR algebra, mates and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import range_join
from .ordering import positions
from .stats import div

#: Which operations of a CIGAR string take letters of the read, and which take bases of the reference.
READ, REFERENCE = "MIS=X", "MDN=X"


def coordinate_sorted(df: DataFrame, tie: str) -> DataFrame:
    """Add position: the reads in order of reference and place, unplaced ones last; ties by the column `tie`."""
    return positions(df, [F.asc_nulls_last("rname"), F.asc_nulls_last("pos"), F.asc(tie)])


def name_sorted(df: DataFrame, tie: str) -> DataFrame:
    """Add position: the reads by name, the first of a pair before the second; ties by the column `tie`."""
    return positions(df, [F.asc("qname"), F.asc(F.col("flag").bitwiseAND(192)), F.asc(tie)])


def merged_runs(runs: list[DataFrame], tie: str) -> DataFrame:
    """Several files of reads as one, in order of coordinates."""
    every = runs[0]
    for x in runs[1:]:
        every = every.unionByName(x)
    return coordinate_sorted(every, tie)


def cigar_sum(cigar: Column, operations: str) -> Column:
    """Letters that the given operations of a CIGAR string take; 0 for * and null."""
    return F.coalesce(F.aggregate(F.regexp_extract_all(cigar, F.lit(f"([0-9]+)[{operations}]"), F.lit(1)), F.lit(0).cast("long"), lambda t, x: t + x.cast("long")), F.lit(0).cast("long"))


def alignment_stats(df: DataFrame, by: list[str]) -> DataFrame:
    """Reads, mapped ones, mean mapping quality, letters aligned, inserted, deleted and clipped, and the mean size of proper pairs' inserts."""
    mapped = F.col("flag").bitwiseAND(4) == 0
    proper = mapped & (F.col("flag").bitwiseAND(2) != 0) & (F.col("tlen") > 0)
    total = lambda ops: F.sum(F.when(mapped, cigar_sum(F.col("cigar"), ops)).otherwise(0))
    return df.groupBy(*by).agg(
        F.count("*").alias("reads"), F.count_if(mapped).alias("mapped"), F.avg(F.when(mapped, F.col("mapq"))).alias("mapq"), total("M=X").alias("aligned"), total("I").alias("inserted"),
        total("D").alias("deleted"), total("SH").alias("clipped"), F.avg(F.when(proper, F.col("tlen"))).alias("insert_size"), F.stddev_samp(F.when(proper, F.col("tlen"))).alias("insert_sd"))


def idxstats(df: DataFrame, references: DataFrame) -> DataFrame:
    """References (rname, length) with the numbers of mapped and of placed but unmapped reads; reads without a reference under *."""
    n = df.groupBy(F.coalesce("rname", F.lit("*")).alias("_r")).agg(F.count_if(F.col("flag").bitwiseAND(4) == 0).alias("mapped"), F.count_if(F.col("flag").bitwiseAND(4) != 0).alias("unmapped"))
    every = references.select("rname", F.col("length").cast("long").alias("length")).union(df.sparkSession.createDataFrame([("*", 0)], "rname string, length long"))
    return every.join(n, F.col("rname") == F.col("_r"), "left").select("rname", "length", F.coalesce("mapped", F.lit(0)).alias("mapped"), F.coalesce("unmapped", F.lit(0)).alias("unmapped"))


def fix_mates(df: DataFrame) -> DataFrame:
    """Primary reads of pairs with their mate's place and the template length: from the leftmost base to the rightmost, negative for the right read."""
    x = df.where(F.col("flag").bitwiseAND(256 | 2048) == 0).withColumn("stop", F.col("pos") + cigar_sum(F.col("cigar"), REFERENCE))
    first, second = (x.where(F.col("flag").bitwiseAND(192) == k).select("qname", F.struct("rname", "pos", "stop").alias(n)) for k, n in ((64, "a"), (128, "b")))
    p = first.join(second, "qname")
    size = F.greatest("a.stop", "b.stop") - F.least("a.pos", "b.pos")
    size = F.when(F.col("a.rname") == F.col("b.rname"), F.when(F.col("a.pos") <= F.col("b.pos"), size).otherwise(-size)).otherwise(0)
    return p.select("qname", F.col("a.rname").alias("rname"), F.col("a.pos").alias("pos"), F.col("b.rname").alias("rnext"), F.col("b.pos").alias("pnext"), size.alias("tlen"))


def window_signal(df: DataFrame, width: int) -> DataFrame:
    """Reads (chrom, start) per window of `width`: count, CPM and RPKM."""
    x = df.groupBy("chrom", (F.floor(F.col("start") / width) * width).alias("start")).agg(F.count("*").alias("n"))
    total = F.broadcast(df.agg(F.count("*").alias("_t")))
    return x.crossJoin(total).select("chrom", "start", "n", (F.col("n") * F.lit(1e6) / F.col("_t")).alias("cpm"), (F.col("n") * F.lit(1e9) / (F.col("_t") * width)).alias("rpkm"))


def reads_in_peaks(reads: DataFrame, peaks: DataFrame, width: int, key: list[str]) -> DataFrame:
    """Reads, those that overlap a peak, and their share (FRiP)."""
    hit = range_join(reads, peaks, width, "left_semi", key=key).agg(F.count("*").alias("inside"))
    return reads.agg(F.count("*").alias("reads")).crossJoin(F.broadcast(hit)).withColumn("frip", div(F.col("inside").cast("double"), F.col("reads")))
