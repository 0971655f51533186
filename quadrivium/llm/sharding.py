"""Sharding by longest processing time: groups that stay together go to the least-loaded shard.

Equal texts form a group; its size is the sum of its rows' sizes.  The heap
needs the sizes of all groups in falling order, and nothing else: the driver
gets the table of (size, number of groups of that size).  ``n`` different sizes
sum to at least n (n + 1) / 2 bytes, so a corpus of B bytes has at most
sqrt(2 B) of them, whatever its number of groups.  Groups of one size are
scheduled together: a few through the heap one by one, many by counting how
many of them the heap would have given to each shard, which is the same.

Which of the groups of one size a shard gets is decided by their rank in the
order of their hashes; slots are the ranks of a shard's rows in an order of
hashes of id and text.  Both ranks are counted in ranges (``common.ranked``), so
neither a frequent size nor a large shard or group meets in one task.

Edge cases: null text has size 1, checksum 0 and groups with the empty text;
repeated rows and ids get slots of their own; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, partitions, ranked, small, table

SHARDS = 16


def dealt(load: list[int], size: int, groups: int) -> list[int]:
    """How many of ``groups`` groups of one size the heap gives to each shard; ``load`` is brought up to date.

    Shard i is taken at the loads load[i], load[i] + size, ...; the heap takes the ``groups`` least of all these, the
    lower shard among equals.  So all below some load are taken, and as many as are left of those that equal it.
    """
    given = [0] * len(load)
    if groups <= 4 * len(load):
        heap = [(x, i) for i, x in enumerate(load)]
        heapq.heapify(heap)
        for _ in range(groups):
            least, i = heap[0]
            heapq.heapreplace(heap, (least + size, i))
            given[i] += 1
    else:
        below = lambda bar: [max(0, -(-(bar - x) // size)) for x in load]
        low, high = min(load), max(load) + size * (groups // len(load) + 1)
        while low < high:  # the highest bar below which no more than ``groups`` are taken
            bar = (low + high + 1) // 2
            low, high = (bar, high) if sum(below(bar)) <= groups else (low, bar - 1)
        given = below(low)
        left = groups - sum(given)
        for i, x in enumerate(load):
            if left and x + given[i] * size == low:
                given[i] += 1
                left -= 1
    for i, n in enumerate(given):
        load[i] += n * size
    return given


def schedule(sizes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int]]]:
    """Of (size, number of groups), largest first: (size, up to which rank, exclusive, each shard has the groups)."""
    load = [0] * shards
    for size, groups in sizes:
        up_to, n = [], 0
        for given in dealt(load, size, groups):
            n += given
            up_to.append(n)
        yield size, up_to


def lpt_shards(documents: DataFrame, shards: int = SHARDS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row."""
    spark = documents.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = documents.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"))
    sized = materialise(sized.withColumn("row", F.monotonically_increasing_id()), "sized")
    groups = materialise(sized.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "groups")
    counts = groups.groupBy("bytes").agg(F.count("*").alias("n"), F.sum("rows").alias("rows")).orderBy(F.desc("bytes")).collect()  # at most sqrt(2 x bytes) rows
    plan = spark.createDataFrame([(size, up_to) for size, up_to in schedule(((r["bytes"], r["n"]) for r in counts), shards)], "bytes long, up_to array<long>")
    placed = ranked(groups, ["bytes"], ["key"], "by-size").join(small(plan, len(counts), 16 + 16 * shards), "bytes")
    placed = materialise(placed.select("key", "rows", F.size(F.filter("up_to", lambda x: x <= F.col("rank"))).alias("shard")), "placed")

    # Groups with more than an eighth of a task's share of rows are few and known to all tasks; the others meet their rows by key.
    most = max(1, sum(r["rows"] for r in counts) // (8 * partitions(spark)))
    hot = F.broadcast(placed.where(F.col("rows") > most).select("key", "shard"))
    at = sized.join(hot, "key").unionByName(sized.join(hot, "key", "left_anti").join(placed.where(F.col("rows") <= most).select("key", "shard"), "key"))
    order = F.sha2(F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("")), F.lower(F.hex("key"))), 256)
    out = ranked(at.select("id", "size", "text_crc32", "shard", order.alias("order"), "row"), ["shard"], ["order", "row"], "in-shards")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", F.col("rank").alias("slot"))


def write_shards(documents: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the rows as one folder per shard, in slot order within each file; ids must be unique."""
    spark = documents.sparkSession
    rows = documents.join(placed.select(id_col, "shard", "slot"), id_col)
    rows.repartitionByRange(partitions(spark), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lpt_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


SQL = """
WITH RECURSIVE crc AS (
  SELECT list(CAST(list_reduce(range(8), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), b) AS BIGINT) ORDER BY b) AS entries FROM range(256) AS t(b)
), t AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, sha256(coalesce(text, '')) AS key,
         CASE WHEN coalesce(text, '') = '' THEN 0 ELSE xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(text), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda c, x: xor(c >> 8, entries[1 + xor(c & 255, x)]), CAST(4294967295 AS BIGINT))) END AS text_crc32
  FROM documents, crc
), g AS (
  SELECT key, CAST(sum(size) AS BIGINT) AS bytes, row_number() OVER (ORDER BY sum(size) DESC, key) AS step, row_number() OVER (PARTITION BY sum(size) ORDER BY key) - 1 AS rank FROM t GROUP BY key
), run(step, loads, shard, bytes) AS (
  SELECT CAST(0 AS BIGINT), list_transform(range(16), lambda x: CAST(0 AS BIGINT)), CAST(NULL AS INTEGER), CAST(NULL AS BIGINT)
  UNION ALL
  SELECT g.step, list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + g.bytes ELSE x END), CAST(list_position(loads, list_min(loads)) - 1 AS INTEGER), g.bytes FROM run JOIN g ON g.step = run.step + 1
), given AS (
  SELECT bytes, shard, sum(count(*)) OVER (PARTITION BY bytes ORDER BY shard) AS up_to FROM run WHERE shard IS NOT NULL GROUP BY bytes, shard
), placed AS (
  SELECT key, min(shard) AS shard FROM g JOIN given USING (bytes) WHERE up_to > rank GROUP BY key
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY sha256(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || key)) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM t JOIN placed USING (key)
"""
