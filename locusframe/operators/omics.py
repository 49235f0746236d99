"""Expression matrices, single cells, proteomics, epigenomics, networks and evidence over long tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tiles
from .stats import div


def erf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26; absolute error at most 1.5e-7. The coefficients are fixed values."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_p(z: Column) -> Column:
    """Two-sided p-value of a standard normal statistic."""
    return F.greatest(F.lit(0.0), 1 - erf(F.abs(z) / math.sqrt(2)))


def matrix_sums(df: DataFrame, axis: str, value: str) -> DataFrame:
    """Sum, mean of the stored entries, their number and the greatest one per row or column of a long matrix."""
    return df.groupBy(axis).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.count_if(F.col(value) != 0).alias("nonzero"), F.max(value).alias("greatest"))


def matrix_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """(row, col, value) of the product of two sparse matrices (row, col, value); an equi-join on the inner index."""
    right = b.select(F.col("row").alias("_k"), F.col("col").alias("_c"), F.col("value").alias("_v"))
    return a.join(right, a.col == F.col("_k")).groupBy("row", F.col("_c").alias("col")).agg(F.sum(F.col("value") * F.col("_v")).alias("value"))


def log_normalise(df: DataFrame, cell: str, value: str, scale: float) -> DataFrame:
    """Add ln(1 + value / cell total * scale)."""
    return df.withColumn("normalised", F.log1p(div(F.col(value) * F.lit(scale), F.sum(value).over(W.partitionBy(cell)))))


def variable_genes(df: DataFrame, gene: str, value: str, cells: Column, top: int) -> DataFrame:
    """Mean, variance over all cells (absent entries are 0) and dispersion; the `top` by dispersion are marked."""
    x = df.groupBy(gene).agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"), F.first(cells).alias("n"))
    x = x.withColumn("mean", F.col("s") / F.col("n")).withColumn("variance", (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1))
    x = x.withColumn("dispersion", div(F.col("variance"), F.col("mean")))
    best = x.orderBy(F.desc(F.round("dispersion", 9)), gene).limit(top).select(gene, F.lit(True).alias("variable"))
    return x.join(F.broadcast(best), gene, "left").select(gene, "mean", "variance", "dispersion", F.coalesce("variable", F.lit(False)).alias("variable"))


def marker_genes(df: DataFrame, gene: str, cluster: str, value: str) -> DataFrame:
    """log2 fold change of the mean inside over outside a cluster, and the shares of positive entries.

    Fold change: log2 of the ratio, at least 1e-15; where the outside mean is under 1e-15, 10 if the inside mean isn't, else 0.
    """
    x = df.groupBy(gene, cluster).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.count_if(F.col(value) > 0).alias("k"))
    part = W.partitionBy(gene)
    for c in "nsk":
        x = x.withColumn(f"{c}o", F.sum(c).over(part) - F.col(c))
    x = x.withColumn("mean_in", F.col("s") / F.col("n")).withColumn("mean_out", div(F.col("so"), F.col("no")))
    fold = F.when(F.col("mean_out") < 1e-15, F.when(F.col("mean_in") > 1e-15, 10.0).otherwise(0.0)).otherwise(F.log2(F.greatest(F.try_divide("mean_in", "mean_out"), F.lit(1e-15))))
    return x.select(gene, cluster, "mean_in", "mean_out", fold.alias("log2fc"), (F.col("k") / F.col("n")).alias("pct_in"), div(F.col("ko"), F.col("no")).alias("pct_out"))


def differential(df: DataFrame, gene: str, group: str, value: str) -> DataFrame:
    """Negative-binomial Wald test of group 1 against 0: log2 fold change with 0.5 added, z by the delta method and normal p."""
    g = lambda k: F.when(F.col(group) == k, F.col(value))
    x = df.groupBy(gene).agg(F.avg(g(0)).alias("m0"), F.avg(g(1)).alias("m1"), F.count(g(0)).alias("n0"), F.count(g(1)).alias("n1"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).where("n0 > 1 and n1 > 1")
    alpha = F.greatest(F.lit(1e-8), F.least(F.lit(10.0), div(F.col("v") - F.col("m"), F.col("m") * F.col("m"))))
    part = lambda k: (F.col(f"m{k}") + 0.5 + alpha * F.pow(F.col(f"m{k}") + 0.5, 2)) / F.col(f"n{k}") / F.pow(F.col(f"m{k}") + 0.5, 2)
    fold = F.ln((F.col("m1") + 0.5) / (F.col("m0") + 0.5))
    z = fold / F.sqrt(part(0) + part(1))
    return x.select(gene, (fold / math.log(2)).alias("log2fc"), alpha.alias("alpha"), z.alias("z"), normal_p(z).alias("p"))


def protein_intensity(df: DataFrame, protein: str, peptide: str, intensity: str) -> DataFrame:
    """Of each peptide the greatest intensity; a protein's sum and the mean of its best three."""
    x = df.groupBy(protein, peptide).agg(F.max(intensity).alias("i"))
    x = x.withColumn("r", F.row_number().over(W.partitionBy(protein).orderBy(F.desc("i"), peptide)))
    return x.groupBy(protein).agg(F.count("*").alias("peptides"), F.sum("i").alias("total"), F.avg(F.when(F.col("r") <= 3, F.col("i"))).alias("top3"))


def median_normalise(df: DataFrame, sample: str, value: str) -> DataFrame:
    """Add value / median of the sample's positive values, and log2 of the value (0 where it isn't positive)."""
    m = df.where(F.col(value) > 0).groupBy(F.col(sample).alias("_s")).agg(F.percentile(value, 0.5).alias("_m"))
    return df.join(m, F.col(sample) == F.col("_s"), "left").withColumn("normalised", div(F.col(value), F.col("_m"))).withColumn("log2", F.when(F.col(value) > 0, F.log2(value)).otherwise(0.0)).drop("_s", "_m")


def fragment_ratio(df: DataFrame, size: str, by: list[str]) -> DataFrame:
    """Fragments under 150 over those from 150 to 300, 0 without any."""
    x = df.groupBy(*by).agg(F.count_if(F.col(size) < 150).alias("free"), F.count_if((F.col(size) >= 150) & (F.col(size) <= 300)).alias("mono"))
    return x.withColumn("ratio", div(F.col("free").cast("double"), F.col("mono")))


def fingerprint(df: DataFrame, by: list[str], depth: str, order: str) -> DataFrame:
    """Cumulative share of bins against cumulative share of coverage, least covered first."""
    part = W.partitionBy(*by)
    line = part.orderBy(depth, order).rowsBetween(W.unboundedPreceding, 0)
    return df.select(*by, order, (F.row_number().over(part.orderBy(depth, order)) / F.count("*").over(part)).alias("bins"), div(F.sum(depth).over(line), F.sum(depth).over(part)).alias("covered"))


def enriched_windows(df: DataFrame, fold: float) -> DataFrame:
    """Windows (chrom, start, stop, n) at least `fold` times the chromosome's mean count, with fold change and Poisson log-likelihood ratio."""
    mean = F.avg("n").over(W.partitionBy("chrom"))
    x = df.withColumn("fold", div(F.col("n"), mean)).withColumn("llr", F.when(F.col("n") > 0, F.col("n") * F.ln(F.col("n") / mean) - (F.col("n") - mean)).otherwise(0.0))
    return x.where(F.col("fold") >= fold)


def state_segments(df: DataFrame, by: list[str], order: str, state: Column) -> DataFrame:
    """Runs of consecutive rows in one state: (first, last, n, state)."""
    line = W.partitionBy(*by).orderBy(order)
    x = df.withColumn("state", state)
    x = x.withColumn("_run", F.row_number().over(line) - F.row_number().over(W.partitionBy(*by, "state").orderBy(order)))
    return x.groupBy(*by, "state", "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_run")


def distance_decay(df: DataFrame) -> DataFrame:
    """Contacts (i, j, n) by distance: mean per distance and each contact over its distance's mean."""
    return df.withColumn("distance", F.abs(F.col("i") - F.col("j"))).withColumn("expected", F.avg("n").over(W.partitionBy("distance"))).withColumn("over_expected", div(F.col("n"), F.col("expected")))


def combine_evidence(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """1 - product of (1 - score), scores held within [0, 1] and zeros skipped; exactly 1 once a score is 1."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score)))
    return df.groupBy(*by).agg(F.count_if(s > 0).alias("channels"), F.when(F.max(s) >= 1, 1.0).otherwise(1 - F.exp(F.sum(F.ln(1 - F.when(s < 1, s))))).alias("combined"))


def ligand_receptor(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Scores of pairs(ligand, receptor) between all clusters that express both: the product of mean expressions (gene, cluster, m)."""
    a = df.select(F.col("gene").alias("ligand"), F.col("cluster").alias("sender"), F.col("m").alias("x"))
    b = df.select(F.col("gene").alias("receptor"), F.col("cluster").alias("receiver"), F.col("m").alias("y"))
    return a.join(pairs, "ligand").join(b, "receptor").select("ligand", "receptor", "sender", "receiver", (F.col("x") * F.col("y")).alias("score"))


def spectrum_cosine(df: DataFrame, width: float, tile: int = 4096) -> DataFrame:
    """Cosine of binned spectra (id, mz, intensity) for pairs id_a < id_b that share a bin, by products of tiles of spectra."""
    x = df.groupBy("id", F.floor(F.col("mz") / width).alias("bin")).agg(F.sum("intensity").alias("v"))
    n = x.groupBy("id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    x = x.join(n, "id").withColumn("u", div(F.col("v"), F.col("n")))
    kind = dict(df.dtypes)["id"]

    def run(a: tiles.Tile, b: tiles.Tile, same: bool) -> Iterator[dict]:
        for at in tiles.stripes(a, b, 1 << 20):
            shared, dot = tiles.products(a, b, at)
            i, j, out = tiles.ordered(a, b, same, at, shared > 0)
            yield out | {"shared": shared[i, j], "cosine": dot[i, j]}

    x = x.where("bin is not null").groupBy("id").agg(F.collect_list(F.struct(F.col("bin").alias("k"), "u")).alias("items")).withColumn("_g", F.lit(0))
    return tiles.tile_pairs(x, ["_g"], run, f"id_a {kind}, id_b {kind}, shared bigint, cosine double", tile).drop("_g")


def overlap_enrichment(df: DataFrame, chosen: str, groups: list[str]) -> DataFrame:
    """Over-representation of chosen items in each group: overlap, expected overlap, fold and hypergeometric z."""
    n = df.agg(F.count("*").alias("total"), F.count_if(F.col(chosen)).alias("drawn"))
    x = df.groupBy(*groups).agg(F.count("*").alias("members"), F.count_if(F.col(chosen)).alias("overlap")).crossJoin(F.broadcast(n))
    N, d, m, k = (F.col(c).cast("double") for c in ("total", "drawn", "members", "overlap"))
    e, v = m * d / N, m * d / N * (N - m) / N * (N - d) / (N - 1)
    return x.select(*groups, "members", "overlap", e.alias("expected"), div(k, e).alias("fold"), div(k - e, F.sqrt(v)).alias("z"))


def beta_binomial(df: DataFrame, by: list[str], hit: Column, a: float, b: float) -> DataFrame:
    """Posterior mean and variance of a rate from a Beta(a, b) prior."""
    x = df.groupBy(*by).agg(F.count_if(hit).alias("k"), F.count("*").alias("n"))
    p, q = F.col("k") + a, F.col("n") - F.col("k") + b
    return x.select(*by, "k", "n", (p / (p + q)).alias("posterior_mean"), (p * q / ((p + q) * (p + q) * (p + q + 1))).alias("posterior_variance"))


def normal_normal(df: DataFrame, by: list[str], value: str, mean: float, variance: float, noise: float) -> DataFrame:
    """Posterior mean and variance of a mean from a normal prior with known noise."""
    precision = 1 / variance + F.count(value) / noise
    return df.groupBy(*by).agg(F.count(value).alias("n"), ((mean / variance + F.sum(value) / noise) / precision).alias("posterior_mean"), (1 / precision).alias("posterior_variance"))


def ancestors(nodes: DataFrame, rounds: int) -> DataFrame:
    """Ancestor closure (node, ancestor, steps) of nodes(id, parent), itself included, up to `rounds` steps."""
    up = nodes.select(F.col("id").alias("_i"), F.col("parent").alias("_p"))
    front = nodes.select(F.col("id").alias("node"), F.col("id").alias("ancestor"), F.lit(0).alias("steps"))
    found = front
    for k in range(1, rounds + 1):
        front = front.join(up, front.ancestor == up._i).where("_p is not null").select("node", F.col("_p").alias("ancestor"), F.lit(k).alias("steps"))
        found = found.union(front)
    return found


def lowest_common(pairs: DataFrame, closure: DataFrame) -> DataFrame:
    """The lowest common ancestor of pairs(a, b)."""
    x = closure.select(F.col("node").alias("a"), "ancestor", F.col("steps").alias("sa"))
    y = closure.select(F.col("node").alias("b"), "ancestor", F.col("steps").alias("sb"))
    z = pairs.join(x, "a").join(y, ["b", "ancestor"])
    return z.groupBy("a", "b").agg(F.min_by("ancestor", F.struct(F.col("sa") + F.col("sb"), "ancestor")).alias("lca"))


def site_frequency(df: DataFrame, derived: str) -> DataFrame:
    """How many sites have each count of derived alleles."""
    return df.groupBy(derived).agg(F.count("*").alias("sites"))
