"""Exact dedup by MSD radix partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, documents, staged

#: Bytes of the first digit, and how much wider each further digit is.
FIRST, GROWTH = 64, 16
#: 64-bit words of the map that marks first digits with more than one row: 4 for each, a power of two up to this (8 MB).
WORDS = 1 << 20


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " ")


#: Parts that the rows of a large group are dealt to.
SALTS = 32


def beside_digits(x: DataFrame, key: list[str], aggregates: list[Column], rows: int) -> DataFrame:
    """x with aggregates of each row's group beside it, and none of them met by all rows of a large group.

    Groups with more than a thousandth of all rows, fewer than a thousand, are told by a broadcast
    of their 64-bit hashes; their rows are dealt by rid to SALTS parts, and their aggregates go to
    each. Rows and aggregates meet by the bytes of the key, which are never broadcast.
    """
    found = x.groupBy(*key).agg(F.count("*").alias("members"), *aggregates).withColumn("_h", F.xxhash64(*key))
    large = F.broadcast(found.where(F.col("members") * 1000 > rows).select(F.col("_h").alias("_l")).distinct())
    salted = lambda df: df.join(large, F.col("_h") == F.col("_l"), "left")
    left = salted(x.withColumn("_h", F.xxhash64(*key))).withColumn("_salt", F.when(F.col("_l").isNull(), 0).otherwise(F.pmod(F.xxhash64("rid"), F.lit(SALTS))).cast("int"))
    right = salted(found).withColumn("_salt", F.explode(F.when(F.col("_l").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    return left.drop("_h", "_l").join(right.drop("_h", "_l"), [*key, "_salt"]).drop("_salt")


def exact_groups(docs: DataFrame, text: str = "text", with_rows: bool = False) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256[, row]), one per row of docs.

    Texts are equal when identical after each `[\\x20\\x09-\\x0D]+` became one space. The
    normalised bytes, headed by their number, are split digit by digit from the front: the first
    digit is the length and 64 bytes, each further one 16 times as many bytes. A group is its
    digits so far, later the row that leads it; rows go on while their group has others and bytes
    are left. Counts per digit are summed before they are shuffled, so a group of a third of all
    rows arrives as one row per task, and the joins back can be split by adaptive execution. Only
    rows whose first digit others may share are shuffled with their text: a broadcast bit map of
    at most WORDS words marks such digits (it may mark too many, never too few; beyond some 30
    million shared digits it marks most). Equality compares bytes; the digest is only returned.

    Of equal texts the row with the smallest doc_id is kept, a null doc_id counting as largest; of
    repeated rows with that doc_id exactly one. Null text counts as empty, and all empty texts
    are one group. Very long texts are split like others. An empty table gives an empty result. With with_rows, `row` is the struct of
    all columns of docs, whatever their names.
    """
    row = F.struct("*") if with_rows else F.struct("doc_id", F.col(text).alias(text))
    norm = normalised(F.col(f"row.{text}"))
    d = docs.select(row.alias("row")).select("row", norm.alias("norm")).select(
        "row", F.octet_length("norm").alias("n"), F.substring(F.col("norm").cast("binary"), 1, FIRST).alias("head"), F.sha2("norm", 256).alias("sha"))
    several = staged(d.groupBy("n", "head").agg(F.count("*").alias("members")).where("members > 1"), "digit0")
    words = min(WORDS, max(1 << 10, 1 << (4 * several.count()).bit_length()))
    word, bit = F.expr(f"xxhash64(n, head) >>> 6 & {words - 1}"), F.expr("shiftleft(1L, cast(xxhash64(n, head) & 63 as int))")
    marks = several.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("marks"))
    d = d.withColumn("word", word).join(F.broadcast(marks), "word", "left").withColumn("maybe", F.coalesce(F.col("marks").bitwiseAND(bit) != 0, F.lit(False)))
    slim = F.col("row") if with_rows else F.when(F.col("maybe"), F.col("row")).otherwise(
        F.struct(*[(F.lit(None).cast(t) if c == text else F.col(f"row.{c}")).alias(c) for c, t in d.select("row.*").dtypes]))
    first = staged(d.select(F.monotonically_increasing_id().alias("rid"), slim.alias("row"), "sha", "n", "maybe", F.when(F.col("maybe"), F.col("head")).alias("head")), "rows")

    def result(x: DataFrame, keep_id: Column, size: Column, kept: Column) -> DataFrame:
        return x.select(F.col("row.doc_id").alias("doc_id"), keep_id.alias("keep_id"), size.cast("long").alias("group_size"),
                        kept.alias("kept"), F.col("sha").alias("text_sha256"), *(["row"] if with_rows else []))

    parts = [result(first.where("not maybe"), F.col("row.doc_id"), F.lit(1), F.lit(True))]
    some = first.where("maybe")
    some = beside_digits(some.drop("maybe"), ["n", "head"], [], some.count()).select(
        "rid", "row", "sha", "n", "members", F.struct("n", "head", F.lit(-1).cast("long").alias("lead")).alias("grp"))
    some = staged(some, "digit")
    parts.append(result(some.where("members = 1"), F.col("row.doc_id"), F.lit(1), F.lit(True)))
    alive, seen, width = some.where("members > 1"), FIRST, FIRST
    while count := alive.count():
        width *= GROWTH
        x = alive.select("rid", "row", "sha", "n", "grp", F.substring(norm.cast("binary"), seen + 1, width).alias("digit"))
        seen += width
        lead = F.min(F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("doc_id"), "rid")).alias("best")
        x = staged(beside_digits(x, ["grp", "digit"], [lead], count).select(
            "rid", "row", "sha", "n", "members", "best",
            F.struct("n", F.lit(b"").alias("head"), F.col("best.rid").alias("lead")).alias("grp")), "digit")
        over = (F.col("members") == 1) | (F.col("n") <= seen)
        parts.append(result(x.where(over), F.col("best.doc_id"), F.col("members"), F.col("rid") == F.col("best.rid")))
        alive = x.where(~over)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir).select("doc_id", "text"))


_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"
ORACLE = f"""
with d as (select doc_id, {_NORM} as t from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, sha256(t) as text_sha256
from d window w as (partition by t)
"""
