"""Algebra of half-open intervals (chrom, start, stop) as relational plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(df: DataFrame, by: list[str], gap: int = 0) -> DataFrame:
    """Add island: the number of the merged interval a row is in; abutting intervals are one (gap more bytes apart too)."""
    line = W.partitionBy(*by).orderBy("start", "stop")
    reach = F.max("stop").over(line.rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("_new", (reach.isNull() | (F.col("start") > reach + gap)).cast("int")).withColumn(
        "island", F.sum("_new").over(line.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def merge(df: DataFrame, by: list[str] | None = None, gap: int = 0, bin_width: int = 1 << 16) -> DataFrame:
    """Merged intervals with n, the number of rows in each.

    First within bins of start, in parallel along each chromosome, then the few results of all
    bins; a chromosome's rows never meet in one task before they are merged.
    """
    by = by or ["chrom"]
    binned = df.select(*by, "start", "stop", F.floor(F.col("start") / bin_width).alias("_bin"))
    first = islands(binned, [*by, "_bin"], gap).groupBy(*by, "_bin", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n"))
    return islands(first.select(*by, "start", "stop", "n"), by, gap).groupBy(*by, "island").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n").alias("n")).drop("island")


def cluster(df: DataFrame, gap: int = 0) -> DataFrame:
    """Rows with the number of their cluster of overlapping intervals, from 1 per chromosome."""
    return islands(df, ["chrom"], gap).withColumnRenamed("island", "cluster")


def range_join(a: DataFrame, b: DataFrame, width: int, how: str = "inner", on: list[str] | None = None, key: list[str] | None = None) -> DataFrame:
    """Pairs of overlapping intervals, b's columns named b_*; how: inner, left_semi or left_anti.

    Both sides are dealt to buckets of `width`, of which the planner makes an equi-join; a pair is
    kept in the first bucket that both have, so nothing is compared twice or made distinct.
    key: for the semi and the anti join, columns that tell a's intervals apart (all, if not
    given); rows alike in them stay or go together.
    """
    on = on or ["chrom"]
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    spread = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)))
    left = a.withColumn("_bucket", spread("start", "stop"))
    right = right.withColumn("_b_bucket", spread("b_start", "b_stop"))
    meets = (F.col("_bucket") == F.col("_b_bucket")) & (F.col("start") < F.col("b_stop")) & (F.col("b_start") < F.col("stop"))
    for c in on:
        meets = meets & (F.col(c) == F.col(f"b_{c}"))
    if how == "inner":
        first = F.col("_bucket") == F.greatest(F.floor(F.col("start") / width), F.floor(F.col("b_start") / width))
        return left.join(right, meets & first).drop("_bucket", "_b_bucket")
    key = key or a.columns
    hit = left.join(right, meets, "left_semi").select(*[F.col(c).alias(f"_hit_{c}") for c in key]).distinct()
    return a.join(hit, reduce(lambda x, c: x & F.col(c).eqNullSafe(F.col(f"_hit_{c}")), key, F.lit(True)), how)


def intersect(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """The common parts of all overlapping pairs."""
    return range_join(a, b, width).select("chrom", F.greatest("start", "b_start").alias("start"), F.least("stop", "b_stop").alias("stop"))


def subtract(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """The parts of each row of a that no interval of b covers; a's other columns stay. a needs a unique column `id`."""
    keep = [c for c in a.columns if c not in ("start", "stop")]
    cuts = range_join(a, merge(b), width).select(*keep, F.col("start").alias("_s"), F.col("stop").alias("_e"), "b_start", "b_stop")
    line = W.partitionBy("id").orderBy("b_start")
    pieces = cuts.select(*keep, F.coalesce(F.lag("b_stop").over(line), F.col("_s")).alias("start"), F.col("b_start").alias("stop"))
    tail = cuts.groupBy(*keep, "_e").agg(F.max("b_stop").alias("start")).select(*keep, "start", F.col("_e").alias("stop"))
    whole = a.join(cuts.select("id").distinct(), "id", "left_anti").select(*keep, "start", "stop")
    return pieces.union(tail).union(whole).where("start < stop")


def complement(df: DataFrame, genome: DataFrame) -> DataFrame:
    """The gaps between merged intervals within genome(chrom, size), also of chromosomes without intervals."""
    merged = merge(df).join(genome, "chrom").select("chrom", "start", "stop")
    ends = genome.select("chrom", F.col("size").alias("start"), F.col("size").alias("stop"))
    line = W.partitionBy("chrom").orderBy("start", "stop")
    gap = merged.union(ends).select("chrom", F.coalesce(F.lag("stop").over(line), F.lit(0)).alias("_s"), F.col("start").alias("_e"))
    return gap.where("_s < _e").select("chrom", F.col("_s").alias("start"), F.col("_e").alias("stop"))


def carried(rows: DataFrame, at: str, mark: str, name: str, width: int, back: bool) -> DataFrame:
    """Add name: the last mark that isn't null at or before each row's place on its chromosome (back), else the next one.

    Seen within bins of `width`, in parallel along a chromosome; from bin to bin only one mark each is carried on.
    """
    key = F.col(at) if back else -F.col(at)
    rows = rows.withColumn("_key", key).withColumn("_bin", F.floor(key / width))
    line = W.partitionBy("chrom", "_bin").orderBy("_key", F.col(mark).isNull()).rowsBetween(W.unboundedPreceding, 0)
    bins = rows.where(F.col(mark).isNotNull()).groupBy("chrom", "_bin").agg(F.max_by(mark, "_key").alias("_last"))
    every = rows.select("chrom", "_bin").distinct().join(bins, ["chrom", "_bin"], "left")
    before = every.select(F.col("chrom").alias("_c"), F.col("_bin").alias("_b"), F.last("_last", True).over(W.partitionBy("chrom").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)).alias("_carry"))
    rows = rows.withColumn("_own", F.last(mark, True).over(line)).join(before, (F.col("chrom") == F.col("_c")) & (F.col("_bin") == F.col("_b")))
    return rows.withColumn(name, F.coalesce("_own", "_carry")).drop("_key", "_bin", "_c", "_b", "_own", "_carry")


def closest(a: DataFrame, b: DataFrame, width: int, bin_width: int = 1 << 16) -> DataFrame:
    """Rows of a(id, chrom, start, stop) with b_start, b_stop and distance of the nearest interval of b, 0 if they overlap.

    Ties go to the lowest (start, stop). Overlaps come from the range join; else the nearest on
    each side is the last or next one carried along the chromosome, without any join of the two.
    """
    over = range_join(a, b, width).groupBy("id").agg(F.min(F.struct("b_start", "b_stop")).alias("o"))
    ends = b.groupBy("chrom", F.col("stop").alias("at")).agg(F.min("start").alias("other"))
    starts = b.groupBy("chrom", F.col("start").alias("at")).agg(F.min("stop").alias("other"))

    def seen(marks: DataFrame, at: str, name: str, start: Column, stop: Column, back: bool) -> DataFrame:
        rows = a.select("chrom", F.col(at).alias("at"), "id", F.lit(None).cast("struct<b_start:bigint,b_stop:bigint>").alias("m"))
        rows = rows.union(marks.select("chrom", "at", F.lit(None).cast(dict(a.dtypes)["id"]), F.struct(start.cast("long").alias("b_start"), stop.cast("long").alias("b_stop"))))
        return carried(rows, "at", "m", name, bin_width, back).where("m is null").select("id", name)

    before = seen(ends, "start", "l", F.col("other"), F.col("at"), True)
    after = seen(starts, "stop", "r", F.col("at"), F.col("other"), False)
    x = a.join(over, "id", "left").join(before, "id").join(after, "id")
    left = F.when(F.col("l").isNotNull(), F.struct((F.col("start") - F.col("l.b_stop")).alias("d"), F.col("l.b_start").alias("b_start"), F.col("l.b_stop").alias("b_stop")))
    right = F.when(F.col("r").isNotNull(), F.struct((F.col("r.b_start") - F.col("stop")).alias("d"), F.col("r.b_start").alias("b_start"), F.col("r.b_stop").alias("b_stop")))
    hit = F.when(F.col("o").isNotNull(), F.struct(F.lit(0).cast("long").alias("d"), F.col("o.b_start").alias("b_start"), F.col("o.b_stop").alias("b_stop")))
    best = F.least(hit, left, right)
    return x.select("id", "chrom", "start", "stop", best.alias("best")).select("id", "chrom", "start", "stop", "best.b_start", "best.b_stop", F.col("best.d").alias("distance"))


def windows(genome: DataFrame, size: int, step: int | None = None) -> DataFrame:
    """Tiling (step = size) or sliding windows over genome(chrom, size); the last ones are clipped."""
    step = step or size
    return genome.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(step).cast("long")))).select(
        "chrom", "start", F.least(F.col("start") + size, F.col("size")).alias("stop"))


def coverage(df: DataFrame, bin_width: int = 1 << 16) -> DataFrame:
    """Runs (chrom, start, stop, depth) of constant depth > 0: a running sum of starts less stops.

    Summed within bins, in parallel along a chromosome, from what the bins before leave open.
    """
    marks = df.select("chrom", F.col("start").alias("at"), F.lit(1).alias("d")).union(df.select("chrom", F.col("stop"), F.lit(-1)))
    marks = marks.groupBy("chrom", "at").agg(F.sum("d").alias("d")).where("d != 0").withColumn("bin", F.floor(F.col("at") / bin_width))
    bins = W.partitionBy("chrom").orderBy("bin")
    total = marks.groupBy("chrom", "bin").agg(F.sum("d").alias("t"), F.min("at").alias("first"))
    total = total.select("chrom", "bin", (F.sum("t").over(bins) - F.col("t")).alias("open"), F.lead("first").over(bins).alias("next"))
    line = W.partitionBy("chrom", "bin").orderBy("at")
    runs = marks.join(total, ["chrom", "bin"]).select("chrom", F.col("at").alias("start"), F.coalesce(F.lead("at").over(line), "next").alias("stop"), (F.col("open") + F.sum("d").over(line.rowsBetween(W.unboundedPreceding, 0))).alias("depth"))
    return runs.where("depth > 0 and stop is not null")


def coverage_stats(df: DataFrame, genome: DataFrame) -> DataFrame:
    """Breadth (share covered) and mean depth of each chromosome of genome(chrom, size)."""
    c = coverage(df).groupBy("chrom").agg(F.sum(F.col("stop") - F.col("start")).alias("covered"), F.sum((F.col("stop") - F.col("start")) * F.col("depth")).alias("bases"), F.max("depth").alias("max_depth"))
    return genome.join(c, "chrom", "left").select("chrom", F.coalesce("max_depth", F.lit(0)).alias("max_depth"), (F.coalesce("covered", F.lit(0)) / F.col("size")).alias("breadth"),
                                                  (F.coalesce("bases", F.lit(0)) / F.col("size")).alias("mean_depth"))


def jaccard(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """Bases in both sets over bases in either."""
    size = lambda df: F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0))
    m, n = merge(a), merge(b)
    shared, x, y = (df.agg(size(df).alias(c)) for df, c in ((intersect(m, n, width), "shared"), (m, "x"), (n, "y")))
    return shared.crossJoin(x).crossJoin(y).select("shared", (F.col("x") + F.col("y") - F.col("shared")).alias("either")).withColumn("jaccard", F.coalesce(F.try_divide("shared", "either"), F.lit(0.0)))


def slop(df: DataFrame, genome: DataFrame, before: int, after: int) -> DataFrame:
    """Intervals grown on both sides within genome(chrom, size)."""
    return df.join(genome, "chrom").withColumn("start", F.greatest(F.lit(0), F.col("start") - before)).withColumn("stop", F.least(F.col("size"), F.col("stop") + after)).drop("size")


def flank(df: DataFrame, genome: DataFrame, width: int) -> DataFrame:
    """The `width` bases on either side, within genome(chrom, size)."""
    left = df.withColumn("stop", F.col("start")).withColumn("start", F.greatest(F.lit(0), F.col("start") - width))
    right = df.join(genome, "chrom").withColumn("start", F.col("stop")).withColumn("stop", F.least(F.col("size"), F.col("stop") + width)).select(*df.columns)
    return left.unionByName(right).where("start < stop")


def liftover(df: DataFrame, blocks: DataFrame, width: int, least_share: float = 0.95) -> DataFrame:
    """Map intervals(id, chrom, start, stop) through blocks(chrom, start, stop, t_chrom, t_start, strand, t_size).

    Mapped bases of a row's blocks on one target and strand are joined; a row whose mapped share
    is under `least_share` or that falls on several targets is not returned. Blocks are long, so
    their buckets are many times the rows the planner knows of: they are sorted, never broadcast.
    """
    x = range_join(df, blocks.hint("merge"), width).withColumn("s", F.greatest("start", "b_start")).withColumn("e", F.least("stop", "b_stop"))
    shift = F.col("s") - F.col("b_start") + F.col("b_t_start")
    size = F.col("e") - F.col("s")
    forward = F.col("b_strand") == "+"
    x = x.withColumn("m_start", F.when(forward, shift).otherwise(F.col("b_t_size") - shift - size)).withColumn("m_stop", F.col("m_start") + size)
    return x.groupBy("id", "start", "stop").agg(
        F.sum("m_stop").alias("_b"), F.sum("m_start").alias("_a"), F.min("m_start").alias("t_start"), F.max("m_stop").alias("t_stop"), F.min("b_t_chrom").alias("t_chrom"),
        F.max("b_t_chrom").alias("_other"), F.min("b_strand").alias("t_strand"), F.max("b_strand").alias("_strand")).where(
        (F.col("t_chrom") == F.col("_other")) & (F.col("t_strand") == F.col("_strand")) & ((F.col("_b") - F.col("_a")) >= least_share * (F.col("stop") - F.col("start")))).select(
        "id", "t_chrom", "t_start", "t_stop", "t_strand")
