"""Resumable loading of a stream into a target: every key once, whatever is run again.

A batch is written to folders that bear its name, first its rows, then the keys
that are new with it, and last a mark that it is whole.  A batch that is played
again after a crash writes the same folders anew, or is passed over where its
mark is there.  Readers and later batches see marked batches only, so half a
batch is never seen and needs no cleaning up.  The keys that the target holds
are kept apart, in buckets: a batch reads the buckets of its own keys and not
the target.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import exists

BUCKETS = 64


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file; whether it was not there before."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(target):
        return False
    stream = files.create(target, False)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    return True


def load_name(spark: SparkSession, checkpoint: str) -> str:
    """A name that lives and dies with the checkpoint: batch numbers begin anew only where that does."""
    path = f"{checkpoint.rstrip('/')}/load-name"
    _create(spark, path, f"b{uuid.uuid4().hex[:12]}\n")
    return spark.read.text(path).first()["value"]


def marked(spark: SparkSession, target: str) -> DataFrame:
    """(batch): the batches that are whole."""
    path = f"{target}/marks"
    return spark.read.text(path).select(F.col("value").alias("batch")) if exists(spark, path) else spark.createDataFrame([], "batch string")


def loaded(spark: SparkSession, target: str) -> DataFrame:
    """The rows of all whole batches."""
    return spark.read.parquet(f"{target}/rows").join(marked(spark, target), "batch", "left_semi").drop("batch")


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def add_batch(batch: DataFrame, name: str, target: str, key: str, order: str | None, buckets: int = BUCKETS) -> None:
    """Add the rows of a batch whose key no whole batch has: of a key's rows the first by ``order``, else the least row."""
    spark = batch.sparkSession
    if not marked(spark, target).where(F.col("batch") == name).isEmpty():
        return
    row = F.struct(*batch.columns)
    rank = F.struct(order, *[c for c in batch.columns if c != order]) if order else row
    first = batch.groupBy(F.col(key).alias("__key")).agg(F.min_by(row, rank).alias("r")).select("r.*")
    rows = first.withColumn("__bucket", _bucket(key, buckets))
    if exists(spark, f"{target}/keys"):
        mine = [r[0] for r in rows.select("__bucket").distinct().collect()]  # of a fixed number of buckets
        known = spark.read.parquet(f"{target}/keys").where(F.col("bucket").isin(mine)).join(marked(spark, target), "batch", "left_semi").select(F.col("key").alias("__known"), F.col("bucket").alias("__of"))
        rows = rows.join(known, (F.col("__bucket") == F.col("__of")) & F.col(key).eqNullSafe(F.col("__known")), "left_anti")
    rows.drop("__bucket").write.mode("overwrite").parquet(f"{target}/rows/batch={name}")
    held = spark.read.schema(batch.select(*batch.columns).schema).parquet(f"{target}/rows/batch={name}")
    held.select(F.col(key).alias("key"), _bucket(key, buckets).alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/keys/batch={name}")
    _create(spark, f"{target}/marks/{name}", f"{name}\n")


def load_new(items: DataFrame, target: str, checkpoint: str, key: str = "url", order: str | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Load all there is of a stream; rows are read back by ``loaded``."""
    name = load_name(items.sparkSession, checkpoint)
    query = items.writeStream.foreachBatch(lambda batch, n: add_batch(batch, f"{name}-{n:08d}", target.rstrip("/"), key, order, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
