"""Event-time aggregates as Structured Streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.operators.staging import folder


def tumbling(events: DataFrame, time: str, width: str, late: str, by: list[str], value: str) -> DataFrame:
    """Count, sum and mean per window and key; rows later than the watermark are left out. Works on streams and tables."""
    x = events.withWatermark(time, late) if events.isStreaming else events
    return x.groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), *by, "n", "total", "mean")


def gamma_poisson(events: DataFrame, time: str, width: str, late: str, by: list[str], shape: float, rate: float) -> DataFrame:
    """Posterior mean rate of events per key and window from a Gamma(shape, rate) prior and one exposure per window."""
    x = events.withWatermark(time, late) if events.isStreaming else events
    return x.groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n", ((F.lit(shape) + F.col("n")) / (F.lit(rate) + 1)).alias("posterior_mean"))


def run_to_table(stream: DataFrame, by: list[str]) -> DataFrame:
    """Run a streaming aggregate over what its sources hold now, in update mode, and give its last rows by the columns `by`.

    State behind the watermark is dropped, and so are the rows that come later than that. The sink
    is idempotent: each batch replaces the folder of its number, so a retried batch leaves one result.
    """
    spark = stream.sparkSession
    place = folder(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    x = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{place}/out")
    rest = [c for c in stream.columns if c not in by]
    return x.groupBy(*by).agg(F.max_by(F.struct(*rest), "batch").alias("_row")).select(*[F.col(c) if c in by else F.col(f"_row.{c}").alias(c) for c in stream.columns])
