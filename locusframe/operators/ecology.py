"""Community ecology, compositions and taxonomic roll-ups over (sample, taxon, n)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stats import div


def diversity(df: DataFrame) -> DataFrame:
    """Per sample: observed, Shannon (natural log), unbiased Simpson, inverse Simpson, Pielou, Chao1, Berger-Parker, Good's coverage and Hill numbers."""
    part = W.partitionBy("sample")
    x = df.where("n > 0").withColumn("total", F.sum("n").over(part)).withColumn("p", F.col("n") / F.col("total"))
    one, two = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
    shannon, square, total = -F.sum(F.col("p") * F.ln("p")), F.sum(F.col("p") * F.col("p")), F.first("total")
    a = x.groupBy("sample").agg(F.count("*").alias("observed"), total.alias("total"), shannon.alias("shannon"), square.alias("square"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"),
                                one.alias("one"), two.alias("two"), F.max("p").alias("berger_parker"))
    c = F.col
    chao = F.when(c("two") > 0, c("one") * c("one") / (2.0 * c("two"))).otherwise(c("one") * (c("one") - 1) / 2.0)
    return a.select("sample", "observed", "shannon", (1 - div(c("pairs").cast("double"), c("total") * (c("total") - 1))).alias("simpson"), (1 / c("square")).alias("inverse_simpson"),
                    div(c("shannon"), F.ln(c("observed").cast("double"))).alias("pielou"), (c("observed") + chao).alias("chao1"), "berger_parker", (1 - c("one") / c("total")).alias("coverage"), F.exp("shannon").alias("hill_1"))


def between(df: DataFrame) -> DataFrame:
    """Bray-Curtis, Jaccard, Euclidean and Canberra distances of all pairs sample_a < sample_b.

    Only shared taxa are joined; totals bring in the rest, so there is no cross product by taxon.
    """
    x = df.where("n > 0")
    t = x.groupBy("sample").agg(F.sum("n").alias("t"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("q"))
    both = x.select(F.col("sample").alias("sample_a"), "taxon", F.col("n").alias("a")).join(x.select(F.col("sample").alias("sample_b"), "taxon", F.col("n").alias("b")), "taxon").where("sample_a < sample_b")
    both = both.groupBy("sample_a", "sample_b").agg(F.sum(F.least("a", "b")).alias("m"), F.count("*").alias("s"), F.sum(F.col("a") * F.col("b")).alias("d"), F.sum(F.abs(F.col("a") - F.col("b")) / (F.col("a") + F.col("b"))).alias("cb"))
    a = t.select(F.col("sample").alias("sample_a"), F.col("t").alias("ta"), F.col("k").alias("ka"), F.col("q").alias("qa"))
    b = t.select(F.col("sample").alias("sample_b"), F.col("t").alias("tb"), F.col("k").alias("kb"), F.col("q").alias("qb"))
    p = a.join(b, F.col("sample_a") < F.col("sample_b")).join(both, ["sample_a", "sample_b"], "left").fillna(0, ["m", "s", "d", "cb"])
    c = F.col
    return p.select("sample_a", "sample_b", (1 - 2 * c("m") / (c("ta") + c("tb"))).alias("bray_curtis"), (1 - c("s") / (c("ka") + c("kb") - c("s"))).alias("jaccard"),
                    F.sqrt(c("qa") + c("qb") - 2 * c("d")).alias("euclidean"), (c("cb") + c("ka") + c("kb") - 2 * c("s")).alias("canberra"))


def clr(df: DataFrame, value: str = "n") -> DataFrame:
    """Centred log ratio within samples; a value that isn't positive is an error."""
    part = W.partitionBy("sample")
    positive = F.when(F.col(value) > 0, F.ln(value)).otherwise(F.raise_error(F.lit("clr needs positive values")).cast("double"))
    return df.withColumn("_l", positive).withColumn("clr", F.col("_l") - F.avg("_l").over(part)).drop("_l")


def rarefy(df: DataFrame, depth: int) -> DataFrame:
    """Counts scaled down to `depth` per sample by largest remainder, ties by taxon; samples under that depth are left out."""
    part = W.partitionBy("sample")
    x = df.withColumn("t", F.sum("n").over(part)).where(F.col("t") >= depth).withColumn("q", F.col("n") * F.lit(depth))
    x = x.withColumn("low", F.expr("q div t")).withColumn("rest", F.expr("q % t"))
    more = F.row_number().over(part.orderBy(F.desc("rest"), "taxon")) <= depth - F.sum("low").over(part)
    return x.withColumn("rarefied", F.col("low") + more.cast("long")).drop("t", "q", "low", "rest")


def prevalence(df: DataFrame, least_count: int, least_share: float) -> DataFrame:
    """Rows of the taxa with at least least_count in sum and present in at least that share of the samples."""
    samples = df.agg(F.count_distinct("sample").alias("s"))
    good = df.groupBy("taxon").agg(F.sum("n").alias("t"), F.count_if(F.col("n") > 0).alias("k")).crossJoin(F.broadcast(samples)).where((F.col("t") >= least_count) & (F.col("k") >= least_share * F.col("s")))
    return df.join(good.select("taxon"), "taxon", "left_semi")


def roll_up(df: DataFrame, levels: list[str], sample: str = "sample") -> DataFrame:
    """Sums of n at every level of the taxonomy at once, with the depth of each row."""
    x = df.rollup(sample, *levels).agg(F.sum("n").alias("n"), F.grouping_id().alias("_g"))
    return x.where(F.col(sample).isNotNull()).withColumn("depth", F.lit(len(levels)) - F.round(F.log2(F.col("_g") + 1)).cast("int")).drop("_g")


def indicator(df: DataFrame, group: str) -> DataFrame:
    """Indicator value of each taxon and group: mean relative specificity times fidelity."""
    cells = df.groupBy(group, "taxon").agg(F.avg("n").alias("m"), (F.count_if(F.col("n") > 0) / F.count("*")).alias("fidelity"))
    a = div(F.col("m"), F.sum("m").over(W.partitionBy("taxon")))
    return cells.select(group, "taxon", (a * F.col("fidelity")).alias("indicator"))
