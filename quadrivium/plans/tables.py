"""Access to the driver's tables, and folders for stores that queries write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import scratch, written  # noqa: F401  queries take them from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
