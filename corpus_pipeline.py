"""A training-corpus pipeline over documents: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of docs. Rows that a stage drops are gone for the later ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusframe.llm import bpe, exact_dedup, jaccard, mixing, toxicity
from locusframe.llm.common import SPACE, count_runs, documents, staged


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = "_" + name
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; the model learns from the labels of sf_dir.

    Null and empty texts score as clean ones and stay; equal texts go or stay together. Without
    labels nothing goes. An empty table gives an empty table.
    """
    model, score = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), fresh(docs, "score")
    return toxicity.score(docs, model, column=score).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, white space aside, the one with the smallest doc_id, a null one last; of ties exactly one.

    Null and empty texts are equal. An empty table gives an empty table.
    """
    return exact_dedup.exact_groups(docs, with_rows=True).where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at 0.8 the one with the smallest doc_id, a null one last.

    Exactly one row of a component stays: of rows that share a doc_id the one whose text hashes
    lowest, of rows alike in both the one that hashes lowest as a whole. Texts without words are
    linked with nothing and all stay. An empty table gives an empty table.
    """
    h, times, i, none, rank = (fresh(docs, x) for x in ("hash_", "times_", "id_", "none_", "rank_"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    found = jaccard.jaccard_components(docs.select(key.alias("doc_id"), "text"))
    lead = found.where("n_shingles = 0 or doc_id = component_id").groupBy("doc_id").agg(F.when(F.max("n_shingles") > 0, F.count("*")).otherwise(1).alias(times))
    lead = lead.select(F.col("doc_id.id").alias(i), F.col("doc_id.none").alias(none), F.col("doc_id.h").alias(h), times)
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h))
    alike = docs.join(lead.where(F.col(times) > 1), same).withColumn(rank, F.row_number().over(W.partitionBy(none, i, h).orderBy(F.xxhash64(*docs.columns))))
    return docs.join(lead.where(F.col(times) == 1), same, "left_semi").union(alike.where(F.col(rank) == 1).select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times, 0 to 3, as mixing.copies gives it, so that each source's words come near its target.

    Rows alike in doc_id, source and size come equally often. A document without words is in no
    block of the mix and goes.
    """
    size, times, copy, i, s, n = (fresh(docs, x) for x in ("size_", "times_", "copy_", "id_", "source_", "words_"))
    taken = mixing.copies(mixing.mix(docs.select("doc_id", "source", "text"))).select(
        F.col("doc_id").alias(i), F.col("source").alias(s), F.col("size").alias(n), F.col("times").alias(times))
    sized = docs.withColumn(size, count_runs(F.col("text"), f"^{SPACE}", SPACE))
    same = F.col("doc_id").eqNullSafe(F.col(i)) & F.col("source").eqNullSafe(F.col(s)) & (F.col(size) == F.col(n))
    return sized.join(taken.where(F.col(times) > 0), same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids and n_tokens of every document; null and empty texts have no ids, repeated rows equal ones."""
    return bpe.encode(docs.select("doc_id", "source", "text")).select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]

#: SQL can't express the toxicity stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
