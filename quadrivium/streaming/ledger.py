"""Streaming forms of the cost ledger (extensions of the batch operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import filled
from ..sources.readers import ledger_lines


def lines(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A ledger folder as a stream; malformed lines are skipped as in the batch reader."""
    return ledger_lines(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))


def by_operation(calls: DataFrame) -> DataFrame:
    """Running totals per operation: a bounded state, for update or complete mode."""
    return calls.groupBy(F.coalesce(filled("operation"), F.lit("untagged")).alias("operation")).agg(F.count("*").alias("calls"), F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"), F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"), F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("cost_usd"))


def by_window(calls: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Cost per window of event time; windows older than the watermark are final, so state stays bounded."""
    timed = calls.withColumn("at", F.try_to_timestamp("event_time")).where(F.col("at").isNotNull()).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), F.coalesce(filled("operation"), F.lit("untagged")).alias("operation")).agg(F.count("*").alias("calls"), F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("cost_usd"))


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Everything there is into a memory table, from where the checkpoint left off."""
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
