"""Taxon profiles and count tables (sample, taxon, n): shares, merging, filters, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import div


def shares(df: DataFrame) -> DataFrame:
    """Relative abundance of each taxon within its sample."""
    total = df.groupBy(F.col("sample").alias("_s")).agg(F.sum("n").alias("_t"))
    return df.join(total, F.col("sample") == F.col("_s")).select("sample", "taxon", "n", div(F.col("n").cast("double"), F.col("_t")).alias("share"))


def merge_profiles(tables: list[DataFrame]) -> DataFrame:
    """One profile of several: counts of a sample's taxon are added; one shuffle."""
    every = tables[0]
    for x in tables[1:]:
        every = every.unionByName(x)
    return every.groupBy("sample", "taxon").agg(F.sum("n").alias("n"))


def filtered(df: DataFrame, least_share: float, samples: int) -> DataFrame:
    """The rows of taxa that have at least a share in at least so many samples."""
    kept = shares(df).where(F.round("share", 9) >= least_share).groupBy("taxon").agg(F.count("*").alias("_k")).where(F.col("_k") >= samples).select("taxon")
    return df.join(kept, "taxon", "left_semi")


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the key's MD5: the same wherever it is computed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8), 16, 10).cast("double") / float(1 << 32)


def bootstrap(df: DataFrame, key: str, value: str, by: list[str], rounds: int) -> DataFrame:
    """Means of `rounds` Poisson bootstrap resamples per group, their spread and their mean.

    Each row counts 0, 1, 2, ... times in a resample by its own draw, so nothing is collected and
    resamples are sums side by side.
    """
    cuts = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015]
    totals = []
    for b in range(rounds):
        u = uniform(F.col(key).cast("string"), str(b))
        w = sum(((u >= c).cast("int") for c in cuts), F.lit(0))
        totals.append(div(F.sum(w * F.col(value)).cast("double"), F.sum(w)).alias(f"m{b}"))
    x = df.groupBy(*by).agg(F.count("*").alias("n"), *totals)
    means = F.array(*[F.col(f"m{b}") for b in range(rounds)])
    mid = F.aggregate(means, F.lit(0.0), lambda t, m: t + m) / rounds
    return x.select(*by, "n", mid.alias("mean"), F.sqrt(F.aggregate(means, F.lit(0.0), lambda t, m: t + (m - mid) * (m - mid)) / (rounds - 1)).alias("se"))


def permutation_test(df: DataFrame, key: str, value: str, group: Column, by: list[str], rounds: int) -> DataFrame:
    """Difference of means between rows with and without `group`, and how many label permutations differ as much; p with one added.

    A permutation redraws each row's label with the groups' own odds.
    """
    x = df.withColumn("_g", group)
    odds = x.groupBy(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)]).agg(F.avg(F.col("_g").cast("double")).alias("_odds"))
    on = F.lit(True)
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"_b{i}"))
    x = x.join(odds, on)
    gap = lambda g: F.avg(F.when(g, F.col(value))) - F.avg(F.when(~g, F.col(value)))
    tries = [gap(uniform(F.col(key).cast("string"), f"p{k}") < F.col("_odds")).alias(f"d{k}") for k in range(rounds)]
    x = x.groupBy(*by).agg(gap(F.col("_g")).alias("difference"), *tries)
    more = sum((F.when(F.abs(F.col(f"d{k}")) >= F.abs("difference"), 1).otherwise(0) for k in range(rounds)), F.lit(0))
    return x.select(*by, "difference", more.alias("extreme"), ((more + 1) / (rounds + 1)).alias("p"))
