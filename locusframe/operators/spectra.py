"""Mass spectra as rows (id, mz, intensity) and peptide-spectrum matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stats import div


def top_peaks(df: DataFrame, n: int) -> DataFrame:
    """The n strongest peaks of each spectrum, ties by m/z."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("intensity"), "mz"))).where(F.col("rank") <= n)


def above(df: DataFrame, share: float) -> DataFrame:
    """Peaks of at least a share of their spectrum's strongest one, with that share."""
    x = df.withColumn("relative", div(F.col("intensity"), F.max("intensity").over(W.partitionBy("id"))))
    return x.where(F.col("relative") >= share)


def total_ion_current(df: DataFrame) -> DataFrame:
    """Peaks, total ion current, base peak and its m/z (the least of ties) per spectrum."""
    return df.groupBy("id").agg(F.count("*").alias("peaks"), F.sum("intensity").alias("tic"), F.max("intensity").alias("base"), F.max_by("mz", F.struct("intensity", -F.col("mz"))).alias("base_mz"))


def best_matches(df: DataFrame, score: str, tie: str) -> DataFrame:
    """The best-scored match of each spectrum, and how far the second best is behind (0 without one)."""
    line = W.partitionBy("spectrum").orderBy(F.desc(score), tie)
    x = df.withColumn("_r", F.row_number().over(line)).withColumn("_next", F.lead(score).over(line))
    return x.where("_r = 1").withColumn("delta", F.coalesce(F.col(score) - F.col("_next"), F.lit(0.0))).drop("_r", "_next")


def reporter_ratios(df: DataFrame, channel: str, intensity: str, reference) -> DataFrame:  # noqa: ANN001
    """Reporter ions (protein, channel, intensity): channels scaled to equal totals, then log2 over the reference channel of the protein."""
    total = df.groupBy(F.col(channel).alias("_c")).agg(F.sum(intensity).alias("_t"))
    scale = total.crossJoin(F.broadcast(total.agg(F.avg("_t").alias("_m"))))
    x = df.join(F.broadcast(scale), F.col(channel) == F.col("_c")).groupBy("protein", channel).agg(F.sum(F.col(intensity) * F.col("_m") / F.col("_t")).alias("scaled"))
    base = x.where(F.col(channel) == reference).select(F.col("protein").alias("_p"), F.col("scaled").alias("_b"))
    return x.join(base, F.col("protein") == F.col("_p")).where("_b > 0 and scaled > 0").select("protein", channel, "scaled", F.log2(F.col("scaled") / F.col("_b")).alias("log2_ratio"))
