"""Read and cell quality: trimming and filters as columns, scaled k-mer sketches, single-cell filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import div


def mean_quality(qual: Column) -> Column:
    """Mean of a quality array; 0 for an empty one."""
    return div(F.aggregate(qual, F.lit(0.0), lambda t, q: t + q), F.size(qual).cast("double"))


def trim_point(qual: Column, threshold: int) -> Column:
    """How many letters stay when the end goes where the sum of threshold - quality from there on is greatest.

    The sum runs from the end to the front and stops where it falls under 0; of equal sums the
    shortest cut counts.
    """
    start = F.struct(F.lit(0).alias("s"), F.lit(0).alias("best"), F.size(qual).alias("stay"), F.size(qual).alias("i"), F.lit(False).alias("over"))

    def step(a: Column, q: Column) -> Column:
        s, i = a["s"] + threshold - q, a["i"] - 1
        over = a["over"] | (s < 0)
        better = ~over & (s > a["best"])
        return F.struct(s.cast("int").alias("s"), F.when(better, s).otherwise(a["best"]).cast("int").alias("best"), F.when(better, i).otherwise(a["stay"]).alias("stay"), i.alias("i"), over.alias("over"))

    return F.aggregate(F.reverse(qual), start, step, lambda a: a["stay"])


def trim_ends(df: DataFrame, threshold: int, least: int, least_mean: float) -> DataFrame:
    """Reads (id, qual array<int>, ...) cut at trim_point(); short ones and those of low mean quality go."""
    x = df.withColumn("stay", trim_point(F.col("qual"), threshold)).withColumn("qual", F.expr("slice(qual, 1, stay)")).drop("stay")
    return x.where(F.size("qual") >= least).withColumn("mean", mean_quality(F.col("qual"))).where(F.col("mean") >= least_mean)


def scaled_sketch(df: DataFrame, k: int, scale: int) -> DataFrame:
    """Rows (id, hash): of the distinct k-mers of rows (id, seq) those whose 32-bit hash, of MD5, is in the lowest 1 / scale.

    Unlike a sketch of fixed size it grows with the sequence, so containment in a far longer one
    can be told.
    """
    mers = F.regexp_extract_all("seq", F.lit(f"(?=(.{{{k}}}))"), F.lit(1))  # one pass, overlapping ones too
    x = df.select("id", F.explode(F.array_distinct(mers)).alias("kmer"))
    return x.select("id", F.conv(F.substring(F.md5("kmer"), 1, 8), 16, 10).cast("long").alias("hash")).where(F.col("hash") < (1 << 32) // scale).distinct()


def containment(queries: DataFrame, base: DataFrame) -> DataFrame:
    """Shared hashes of the sketches (id, hash) of queries and base that share any: containment of the query and Jaccard index."""
    size = lambda df, name: df.groupBy(F.col("id").alias(f"_{name}")).agg(F.count("*").alias(f"n_{name}"))
    x = queries.select(F.col("id").alias("query"), "hash").join(base.select(F.col("id").alias("target"), "hash"), "hash").groupBy("query", "target").agg(F.count("*").alias("shared"))
    x = x.join(size(queries, "query"), F.col("query") == F.col("_query")).join(size(base, "target"), F.col("target") == F.col("_target"))
    return x.select("query", "target", "shared", (F.col("shared") / F.col("n_query")).alias("containment"), (F.col("shared") / (F.col("n_query") + F.col("n_target") - F.col("shared"))).alias("jaccard"))


def filter_cells(df: DataFrame, least_genes: int, least_total: float, marked: Column, most_marked: float) -> DataFrame:
    """Counts (gene, cell, v) of the cells with enough genes and counts and no more than a share of marked ones (mitochondrial, say)."""
    q = df.groupBy("cell").agg(F.count_if(F.col("v") > 0).alias("genes"), F.sum("v").alias("total"), F.sum(F.when(marked, F.col("v")).otherwise(0)).alias("marked"))
    q = q.where((F.col("genes") >= least_genes) & (F.col("total") >= least_total) & (F.round(div(F.col("marked").cast("double"), F.col("total")), 9) <= most_marked))
    return df.join(q.select("cell"), "cell", "left_semi")


def filter_genes(df: DataFrame, least_cells: int) -> DataFrame:
    """Counts of the genes that enough cells have."""
    return df.join(df.where("v > 0").groupBy("gene").agg(F.count("*").alias("_n")).where(F.col("_n") >= least_cells).select("gene"), "gene", "left_semi")
