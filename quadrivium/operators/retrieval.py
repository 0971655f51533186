"""Vector retrieval: exact cosine top-k, in the whole or per course."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import dot, norm, unit, usable
from ..sources.shared import BROADCAST_BYTES, written

TOP_K, TOP_K_PER_COURSE = 8, 10
#: Rows of a chunk matrix and of a query matrix.
BLOCK_ROWS, QUERY_ROWS = 4096, 1024


def scored(chunks: DataFrame, query: list[float], vector: str = "embedding") -> DataFrame:
    """Adds ``score`` to chunks with a usable vector; a vector of another length is an error, not a miss."""
    same = F.when(F.size(vector) == len(query), dot(vector, unit(query)) / norm(vector)).otherwise(F.raise_error(F.lit("vector of another dimension")).cast("double"))
    return chunks.where(usable(vector)).withColumn("score", same)


def search(chunks: DataFrame, query: list[float], top_k: int = TOP_K, key: str = "id", vector: str = "embedding", **wanted) -> DataFrame:
    """The ``top_k`` best chunks, ties by key. Equalities given in ``wanted`` filter before scoring."""
    for name, value in wanted.items():
        if value is not None:
            chunks = chunks.where(F.col(name) == F.lit(value))
    return scored(chunks, query, vector).orderBy(F.desc("score"), key).limit(top_k)


def search_each(chunks: DataFrame, query: list[float], group: str, top_k: int = TOP_K_PER_COURSE, key: str = "id", vector: str = "embedding") -> DataFrame:
    """The ``top_k`` best of every group; the rank filter is pushed below the shuffle (a group limit)."""
    order = Window.partitionBy(group).orderBy(F.desc("score"), key)
    return scored(chunks, query, vector).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def search_many(chunks: DataFrame, queries: DataFrame, top_k: int = TOP_K, key: str = "id", vector: str = "embedding", rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, key, score, rank): the ``top_k`` best chunks for every row of (query_id, query), ties by key.

    A grid of blocks: chunks and queries are packed into matrices of bounded size, every chunk block meets every query
    block by an equi-join on the number of the latter, and a cell is one matrix product that gives the ``top_k`` of each
    of its queries.  What is shuffled after that is ``top_k`` rows for each query and chunk block, cut down once more
    below the shuffle.  Query blocks are broadcast where their counted bytes are few; else both sides are dealt by cell.
    Scores that decide are summed per row in a fixed order, so equal vectors tie wherever they stand.  A usable vector
    of another length than its partner's is an error; unusable queries have no result.
    """
    spark = chunks.sparkSession
    packed = written(_packed(queries.where(usable("query")).select("query_id", "query"), query_rows).withColumn("row", F.monotonically_increasing_id()), "query-blocks")
    numbered = packed.select("row", F.octet_length("matrix").alias("bytes")).orderBy("row").collect()  # a row for each block of queries
    if not numbered:
        return spark.createDataFrame([], T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField(key, chunks.schema[key].dataType), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())]))
    cell = spark.createDataFrame([(r["row"], i) for i, r in enumerate(numbered)], "row long, at int")
    blocks = _packed(chunks.where(usable(vector)).select(key, vector), rows).select(F.col("ids").alias("chunk_ids"), F.col("matrix").alias("chunk_matrix"), F.explode(F.sequence(F.lit(0), F.lit(len(numbered) - 1))).alias("at"))
    sides = packed.join(cell, "row").select("at", F.col("ids").alias("query_ids"), F.col("matrix").alias("query_matrix"))
    small = sum(r["bytes"] for r in numbered) <= BROADCAST_BYTES
    met = blocks.join(F.broadcast(sides) if small else sides, "at").select("chunk_ids", "chunk_matrix", "query_ids", "query_matrix")
    kinds = [queries.schema["query_id"].dataType, chunks.schema[key].dataType]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk_ids, chunk_matrix, query_ids, query_matrix in zip(*batch.columns, strict=True):
                ids, names = chunk_ids.values, query_ids.values
                c, q = (np.frombuffer(m.as_py(), np.float64).reshape(len(n), -1) for m, n in ((chunk_matrix, ids), (query_matrix, names)))
                if c.shape[1] != q.shape[1]:
                    raise ValueError(f"vectors of {c.shape[1]} and of {q.shape[1]} dimensions")
                order = np.empty(len(ids), np.int64)
                order[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
                product = q @ c.T
                k = min(top_k, len(ids))
                kth = np.partition(product, len(ids) - k, axis=1)[:, len(ids) - k]
                of, at, score = [], [], []
                for i in range(len(q)):
                    near = np.flatnonzero(product[i] >= kth[i] - 1e-9)
                    exact = (c[near] * q[i]).sum(1)
                    best = np.lexsort((order[near], -exact))[:k]
                    of.append(np.full(k, i))
                    at.append(near[best])
                    score.append(exact[best])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.concatenate(of))), ids.take(pa.array(np.concatenate(at))), pa.array(np.concatenate(score))], names=["query_id", key, "score"])

    found = met.mapInArrow(run, T.StructType([T.StructField("query_id", kinds[0]), T.StructField(key, kinds[1]), T.StructField("score", T.DoubleType())]))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """(ids, matrix): rows of (id, vector) as unit vectors in blocks of at most ``most``, all of one length."""
    kind = rows.schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for d in np.unique(lengths):
                own = np.flatnonzero(lengths == d)
                for first in range(0, len(own), most):
                    at = pa.array(own[first : first + most])
                    x = batch.column(1).take(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), d)
                    x /= np.sqrt((x * x).sum(1))[:, None]
                    ids = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), batch.column(0).take(at))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes()], pa.binary())], names=["ids", "matrix"])

    return rows.mapInArrow(run, T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("matrix", T.BinaryType())]))
