"""Order-dependent measures over whole tables without a task that holds them: range partitions with carried totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import cut


def running(df: DataFrame, order: list[Column], totals: dict[str, tuple[str, Column]], parts: int | None = None) -> DataFrame:
    """Add columns name: (kind, value) over all rows in the given order, which should have no ties.

    kind: sum (so far, the row's own included), min (so far), or lag (the value of the row before).
    The rows are range-partitioned and written once, so that a partition is the same whenever it
    is read again; what goes from one partition to the next is a row each.
    """
    dealt = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    x = cut(dealt.select("*", *[v.alias(f"_v_{n}") for n, (_, v) in totals.items()], F.spark_partition_id().alias("_p")))
    line = W.partitionBy("_p").orderBy(*order)
    so_far, after = line.rowsBetween(W.unboundedPreceding, 0), W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    whole, local = [], []
    for n, (kind, _) in totals.items():
        v = F.col(f"_v_{n}")
        whole.append({"sum": F.sum(v), "min": F.min(v), "lag": F.max_by(v, "_i")}[kind].alias(f"_w_{n}"))
        local.append({"sum": F.sum(v).over(so_far), "min": F.min(v).over(so_far), "lag": F.lag(v).over(line)}[kind].alias(f"_l_{n}"))
    x = x.select("*", F.row_number().over(line).alias("_i"), *local)
    carry = {"sum": lambda c: F.sum(c).over(after), "min": lambda c: F.min(c).over(after), "lag": lambda c: F.last(c).over(after)}
    before = x.groupBy("_p").agg(*whole).select(F.col("_p").alias("_q"), *[carry[kind](f"_w_{n}").alias(f"_c_{n}") for n, (kind, _) in totals.items()])
    x = x.join(F.broadcast(before), F.col("_p") == F.col("_q"))  # a row per partition
    mixed = {"sum": lambda n: F.col(f"_l_{n}") + F.coalesce(F.col(f"_c_{n}"), F.lit(0)), "min": lambda n: F.least(f"_l_{n}", f"_c_{n}"), "lag": lambda n: F.when(F.col("_i") == 1, F.col(f"_c_{n}")).otherwise(F.col(f"_l_{n}"))}
    return x.select(*df.columns, *[mixed[kind](n).alias(n) for n, (kind, _) in totals.items()])


def positions(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Add each row's place, from 1, in the given order of the whole table."""
    return running(df, order, {name: ("sum", F.lit(1).cast("long"))})


def top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows in the given order: each task keeps k, one task puts those in order."""
    return df.orderBy(*order).limit(k)
