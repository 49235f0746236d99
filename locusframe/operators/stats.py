"""Descriptive statistics, ranks, corrections and test statistics as aggregations and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def div(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a, b))


def describe(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, moments and quantiles; population variance, skewness and excess kurtosis, both 0 for constants; type-7 quantiles."""
    x = F.col(value)
    flat = F.var_pop(x) == 0
    return df.groupBy(*by).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("variance"), F.stddev_pop(x).alias("sd"), F.var_samp(x).alias("sample_variance"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.percentile(x, 0.25).alias("q1"), F.percentile(x, 0.5).alias("median"), F.percentile(x, 0.75).alias("q3"),
        F.when(flat, 0.0).otherwise(F.skewness(x)).alias("skewness"), F.when(flat, 0.0).otherwise(F.kurtosis(x)).alias("kurtosis"))


def mad(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Median absolute deviation from the median, and the interquartile range."""
    mid = df.groupBy(*by).agg(F.percentile(value, 0.5).alias("_m"), F.percentile(value, 0.75).alias("_u"), F.percentile(value, 0.25).alias("_l"))
    return df.join(mid, by).groupBy(*by).agg(F.percentile(F.abs(F.col(value) - F.col("_m")), 0.5).alias("mad"), F.first(F.col("_u") - F.col("_l")).alias("iqr"))


def ranks(df: DataFrame, value: str, by: list[str], tie: str) -> DataFrame:
    """Add rank_min, rank_max, rank_average, rank_dense and rank_ordinal (ties by column `tie`), all from 1."""
    line = W.partitionBy(*by).orderBy(value)
    same = W.partitionBy(*by, value)
    low = F.rank().over(line)
    high = low + F.count("*").over(same) - 1
    ordinal = F.row_number().over(W.partitionBy(*by).orderBy(value, tie))
    return df.select("*", low.cast("long").alias("rank_min"), high.alias("rank_max"), ((low + high) / 2).alias("rank_average"), F.dense_rank().over(line).cast("long").alias("rank_dense"), ordinal.cast("long").alias("rank_ordinal"))


def pearson(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Correlation and covariance; 0 where a column is constant."""
    a, b = F.col(x), F.col(y)
    spread = F.var_pop(a) * F.var_pop(b)
    return df.groupBy(*by).agg(F.count("*").alias("n"), div(F.covar_pop(a, b), F.sqrt(spread)).alias("r"), F.covar_samp(a, b).alias("covariance"))


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Pearson correlation of average ranks."""
    def rank(c: str) -> Column:
        return F.rank().over(W.partitionBy(*by).orderBy(c)) + (F.count("*").over(W.partitionBy(*by, c)) - 1) / 2

    return pearson(df.select(*by, rank(x).alias("_x"), rank(y).alias("_y")), "_x", "_y", by)


def linear_fit(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Least-squares line: slope, intercept and r squared."""
    a, b = F.col(x), F.col(y)
    slope = div(F.covar_pop(a, b), F.var_pop(a))
    return df.groupBy(*by).agg(slope.alias("slope"), (F.avg(b) - slope * F.avg(a)).alias("intercept"), F.pow(div(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b))), 2).alias("r2"))


def adjust(df: DataFrame, p: str, by: list[str]) -> DataFrame:
    """Add bonferroni, holm and bh, the adjusted p-values within each group.

    bh: least p * n / rank over the ranks from a row's own on; holm: greatest p * (n - rank + 1)
    up to it; each at most 1. Tied p-values share the outcome of the tie's best place.
    """
    part, tie = W.partitionBy(*by), [F.col(p)]
    n = F.count("*").over(part)
    place = F.row_number().over(part.orderBy(*tie))
    x = df.withColumn("_n", n).withColumn("_i", place)
    down = part.orderBy(F.desc(p), F.desc("_i")).rowsBetween(W.unboundedPreceding, 0)
    up = part.orderBy(p, "_i").rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("bonferroni", F.least(F.lit(1.0), F.col(p) * F.col("_n"))).withColumn("bh", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_i")).over(down)))
    x = x.withColumn("holm", F.least(F.lit(1.0), F.max(F.col(p) * (F.col("_n") - F.col("_i") + 1)).over(up)))
    same = W.partitionBy(*by, p)
    return x.withColumn("bh", F.min("bh").over(same)).withColumn("holm", F.max("holm").over(same)).drop("_n", "_i")


def two_samples(df: DataFrame, value: str, group: str, by: list[str]) -> DataFrame:
    """Welch and pooled t, Cohen's d and Hedges' g of the groups 0 and 1 of column `group`."""
    x = lambda g: F.when(F.col(group) == g, F.col(value))
    a = df.groupBy(*by).agg(*[f(x(g)).alias(f"{n}{g}") for g in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]).where("n0 > 1 and n1 > 1")
    n0, n1, v0, v1, gap = (F.col(c) for c in ("n0", "n1", "v0", "v1", "m0"))
    gap = F.col("m0") - F.col("m1")
    pooled = ((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)
    se = v0 / n0 + v1 / n1
    d = div(gap, F.sqrt(pooled))
    return a.select(*by, n0, n1, div(gap, F.sqrt(se)).alias("welch_t"), div(F.pow(se, 2), F.pow(v0 / n0, 2) / (n0 - 1) + F.pow(v1 / n1, 2) / (n1 - 1)).alias("welch_df"),
                    div(gap, F.sqrt(pooled * (1 / n0 + 1 / n1))).alias("pooled_t"), d.alias("cohen_d"), (d * (1 - 3 / (4 * (n0 + n1) - 9))).alias("hedges_g"))


def anova(df: DataFrame, value: str, group: str, by: list[str]) -> DataFrame:
    """One-way F with its degrees of freedom, and eta squared."""
    cells = df.groupBy(*by, group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count("*")).alias("within"))
    line = W.partitionBy(*by)
    cells = cells.withColumn("grand", F.sum(F.col("n") * F.col("m")).over(line) / F.sum("n").over(line))
    t = cells.groupBy(*by).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2)).alias("between"), F.sum("within").alias("within"))
    k, n = F.col("k"), F.col("n")
    return t.where("k > 1 and n > k").select(*by, (k - 1).alias("df_between"), (n - k).alias("df_within"), div(F.col("between") / (k - 1), F.col("within") / (n - k)).alias("f"), div(F.col("between"), F.col("between") + F.col("within")).alias("eta2"))


def mann_whitney(df: DataFrame, value: str, group: str, by: list[str]) -> DataFrame:
    """U of groups 0 and 1 with average ranks and z, without tie or continuity correction."""
    r = F.rank().over(W.partitionBy(*by).orderBy(value)) + (F.count("*").over(W.partitionBy(*by, value)) - 1) / 2
    t = df.select(*by, F.col(group).alias("_g"), r.alias("_r")).groupBy(*by).agg(
        F.count_if(F.col("_g") == 0).alias("n0"), F.count_if(F.col("_g") == 1).alias("n1"), F.sum(F.when(F.col("_g") == 0, F.col("_r"))).alias("r0"))
    n0, n1 = F.col("n0"), F.col("n1")
    u = F.col("r0") - n0 * (n0 + 1) / 2
    return t.where("n0 > 0 and n1 > 0").select(*by, n0, n1, F.least(u, n0 * n1 - u).alias("u"), ((F.least(u, n0 * n1 - u) - n0 * n1 / 2) / F.sqrt(n0 * n1 * (n0 + n1 + 1) / 12)).alias("z"))


def kruskal(df: DataFrame, value: str, group: str, by: list[str]) -> DataFrame:
    """H with average ranks, without tie correction."""
    r = F.rank().over(W.partitionBy(*by).orderBy(value)) + (F.count("*").over(W.partitionBy(*by, value)) - 1) / 2
    t = df.select(*by, group, r.alias("_r")).groupBy(*by, group).agg(F.count("*").alias("n"), F.sum("_r").alias("r")).groupBy(*by).agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"))
    return t.select(*by, (F.col("k") - 1).alias("df"), (12 / (F.col("n") * (F.col("n") + 1)) * F.col("s") - 3 * (F.col("n") + 1)).alias("h"))


def contingency(df: DataFrame, row: str, column: str) -> DataFrame:
    """Chi squared without correction, degrees of freedom and Cramer's V of a table of counts."""
    cells = df.groupBy(row, column).agg(F.count("*").alias("o"))
    r, c = df.groupBy(row).agg(F.count("*").alias("r")), df.groupBy(column).agg(F.count("*").alias("c"))
    every = r.crossJoin(c).join(cells, [row, column], "left").withColumn("o", F.coalesce("o", F.lit(0)))
    n = df.agg(F.count("*").alias("n"))
    x = every.crossJoin(n).withColumn("e", F.col("r") * F.col("c") / F.col("n"))
    t = x.agg(F.sum(F.pow(F.col("o") - F.col("e"), 2) / F.col("e")).alias("chi2"), F.count_distinct(row).alias("rows"), F.count_distinct(column).alias("cols"), F.first("n").alias("n"))
    return t.select("chi2", ((F.col("rows") - 1) * (F.col("cols") - 1)).alias("df"), F.sqrt(div(F.col("chi2"), F.col("n") * (F.least("rows", "cols") - 1))).alias("cramers_v"))


def odds(df: DataFrame, a: Column, b: Column, by: list[str]) -> DataFrame:
    """Odds ratio, relative risk and phi of two conditions."""
    n = lambda c: F.count_if(c).cast("double")
    t = df.groupBy(*by).agg(n(a & b).alias("p"), n(a & ~b).alias("q"), n(~a & b).alias("r"), n(~a & ~b).alias("s"))
    p, q, r, s = (F.col(c) for c in "pqrs")
    return t.select(*by, div(p * s, q * r).alias("odds_ratio"), div(div(p, p + q), div(r, r + s)).alias("relative_risk"), div(p * s - q * r, F.sqrt((p + q) * (r + s) * (p + r) * (q + s))).alias("phi"))


def z_scores(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Add z (population deviation) and min_max; 0 for constants."""
    part = W.partitionBy(*by)
    x = F.col(value)
    low, high = F.min(x).over(part), F.max(x).over(part)
    return df.withColumn("z", div(x - F.avg(x).over(part), F.stddev_pop(x).over(part))).withColumn("min_max", div(x - low, high - low))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts of equal-width bins between the least and greatest value; the last bin is closed."""
    ends = df.agg(F.min(value).alias("_l"), F.max(value).alias("_h"))
    at = F.least(F.lit(bins - 1), F.floor(div(F.col(value) - F.col("_l"), F.col("_h") - F.col("_l")) * bins))
    return df.crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))


def correlations(df: DataFrame, item: str, sample: str, value: str) -> DataFrame:
    """Pearson correlation of all pairs of items over the samples both have; rows with item_a < item_b.

    The pairs come from an equi-join by sample, whose rows are summed before anything else.
    """
    a = df.select(F.col(item).alias("item_a"), sample, F.col(value).alias("_x"))
    b = df.select(F.col(item).alias("item_b"), sample, F.col(value).alias("_y"))
    return pearson(a.join(b, sample).where("item_a < item_b"), "_x", "_y", ["item_a", "item_b"])


def normalise_counts(df: DataFrame, sample: str, item: str, count: str, length: str | None = None) -> DataFrame:
    """Add cpm and share per sample, and tpm if there is a length column."""
    part = W.partitionBy(sample)
    out = df.withColumn("share", div(F.col(count), F.sum(count).over(part))).withColumn("cpm", F.col("share") * 1e6)
    if length:
        rate = F.col(count) / F.col(length)
        out = out.withColumn("tpm", div(rate, F.sum(rate).over(part)) * 1e6)
    return out


def size_factors(df: DataFrame, sample: str, item: str, count: str) -> DataFrame:
    """Median over items of count / geometric mean, over the items that are positive in all samples."""
    n = df.agg(F.count_distinct(sample).alias("n"))
    means = df.where(F.col(count) > 0).groupBy(item).agg(F.avg(F.ln(count)).alias("g"), F.count("*").alias("k")).crossJoin(n).where("k = n").select(item, "g")
    return df.join(means, item).groupBy(sample).agg(F.percentile(F.exp(F.ln(count) - F.col("g")), 0.5).alias("size_factor"))


def quantile_normalise(df: DataFrame, sample: str, item: str, value: str) -> DataFrame:
    """Each value becomes the mean, over samples, of the values of its rank (ties by item)."""
    x = df.withColumn("_r", F.row_number().over(W.partitionBy(sample).orderBy(value, item)))
    return x.join(x.groupBy("_r").agg(F.avg(value).alias("normalised")), "_r").drop("_r")
