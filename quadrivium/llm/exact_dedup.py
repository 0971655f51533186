"""Exact deduplication through an extendible-hash index on shared files.

Keys are 64-bit hashes of whitespace-free texts.  The *directory* maps the
leading bits of a hash to a bucket: starting from one bucket, an overfull
bucket is split by one more bit and the directory doubles whenever a bucket
reaches its depth.  Every *owner task* has a range of keys, the buckets next to
each other in the directory with about an even share of the keys; rows are
dealt to the owner of their bucket, where equal hashes form a chain and nodes
of a chain are told apart by comparing the texts themselves.  The nodes (one per distinct text) are written to the shared
folder as the index.

Hot texts: a chain with more rows than ``rows / (8 x partitions)`` is spread
over pages of that many rows, each with the owner one further on, so no owner
gets more than a small multiple of the mean; at most ``8 x partitions`` chains can be that long, which bounds the
broadcast of their hashes.  Nodes of one chain from several pages (or with
several lengths) are merged afterwards by their bytes.

Edge cases: null text counts as empty and all empty texts are one group; an
empty table gives an empty result; a null id never wins over a row with an id
of the same length; where one id is repeated, exactly one of the rows that
could stay does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, materialise, partitions, small, table

MAX_DEPTH = 20
LEAST_CAPACITY = 64
SPACE = r"[\x20\x09-\x0D]+"


@dataclass
class Directory:
    """Extendible-hash directory over the leading bits of 64-bit hashes."""

    depth: int
    slots: list[int]  # bucket of every prefix of ``depth`` bits
    local: list[int]  # local depth of every bucket

    @classmethod
    def build(cls, counts: dict[int, int], fine: int, capacity: int) -> Directory:
        """``counts``: keys per prefix of ``fine`` bits; buckets split until none that can be holds over ``capacity``."""
        self = cls(0, [0], [0])
        prefix, held = [0], [sum(counts.values())]
        sums = {fine: dict(counts)}  # keys per prefix at every depth
        for depth in range(fine - 1, -1, -1):
            level: dict[int, int] = {}
            for p, n in sums[depth + 1].items():
                level[p >> 1] = level.get(p >> 1, 0) + n
            sums[depth] = level
        full = [b for b in range(len(held)) if held[b] > capacity]
        while full:
            bucket = full.pop()
            if self.local[bucket] == fine:
                continue  # equal leading bits throughout: the chain stays long
            if self.local[bucket] == self.depth:
                self.slots = [b for b in self.slots for _ in (0, 1)]
                self.depth += 1
            self.local[bucket] += 1
            depth, low, new = self.local[bucket], prefix[bucket] << 1, len(held)
            prefix[bucket] = low
            prefix.append(low | 1), self.local.append(depth)
            held[bucket] = sums[depth].get(low, 0)
            held.append(sums[depth].get(low | 1, 0))
            span = 1 << (self.depth - depth)
            self.slots[(low | 1) * span : ((low | 1) + 1) * span] = [new] * span
            full += [b for b in (bucket, new) if held[b] > capacity]
        return self

    def owners(self, counts: dict[int, int], fine: int, tasks: int) -> list[int]:
        """The owner of every slot: a bucket goes to the task in whose even share of the keys its first key falls."""
        held = [0] * len(self.local)
        for p, n in counts.items():
            held[self.slots[p >> (fine - self.depth)]] += n
        total, before, out = max(1, sum(held)), 0, []
        for i, bucket in enumerate(self.slots):
            if i and bucket == self.slots[i - 1]:
                out.append(out[-1])
                continue
            out.append(min(tasks - 1, before * tasks // total))
            before += held[bucket]
        return out

    def frame(self, spark: SparkSession, owners: list[int]) -> DataFrame:
        """(prefix, bucket, owner): at most 2**MAX_DEPTH rows of three numbers."""
        return spark.createDataFrame(list(zip(range(len(self.slots)), self.slots, owners, strict=True)), "prefix long, bucket int, owner int")


def leading(h: str, bits: int) -> Column:
    return F.lit(0).cast("long") if bits == 0 else F.shiftrightunsigned(F.col(h), 64 - bits)


def normalised(text_col: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, "")


def exact_dedup(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row.

    Of equal texts the row with the most code points, then the smallest id, stays.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("size")).withColumn("h", F.xxhash64("norm"))
    entries = materialise(rows.select("id", "size", "h", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"), F.monotonically_increasing_id().alias("row")), "entries")
    chains = materialise(entries.groupBy("h").agg(F.count("*").alias("n")), "chains")
    total = chains.agg(F.sum("n").alias("rows"), F.count("*").alias("keys")).first()
    n_rows, n_keys, parts = total["rows"] or 0, total["keys"], partitions(spark)

    capacity = max(LEAST_CAPACITY, n_keys // (8 * parts))
    fine = min(MAX_DEPTH, max(0, (max(1, n_keys // capacity)).bit_length() + 3))
    counts = {r[0]: r[1] for r in chains.groupBy(leading("h", fine).alias("p")).count().collect()}  # at most 2**fine numbers
    directory = Directory.build(counts, fine, capacity)

    page = max(1, n_rows // (8 * parts))
    hot = chains.where(F.col("n") > page).select("h", F.ceil(F.col("n") / page).cast("int").alias("pages"))
    dealt = (
        rows.join(F.broadcast(hot), "h", "left")
        .withColumn("prefix", leading("h", directory.depth))
        .join(F.broadcast(directory.frame(spark, directory.owners(counts, fine, parts))), "prefix")
        .withColumn("page", F.when(F.col("pages").isNull(), 0).otherwise(F.pmod(F.xxhash64("id", "size"), F.col("pages"))).cast("int"))
        .select("bucket", "page", "h", "norm", "size", "id", F.pmod(F.col("owner") + F.col("page"), F.lit(parts)).alias("owner"))
        .repartitionById(parts, F.col("owner"))
    )
    # One node per distinct text of a chain: the grouping key is the text, so equality is of bytes.
    nodes = materialise(dealt.groupBy("owner", "bucket", "page", "h", "norm", "size").agg(F.count("*").alias("n"), F.min("id").alias("first")), "index")

    chained = nodes.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h")
    chained = materialise(chained, "chained")
    chained = small(chained, chained.count(), 16)
    sha = F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha")
    alone = nodes.where("n > 1").join(chained, "h", "left_anti").select("h", sha, F.col("first").alias("keep"), F.col("size").alias("top"), "n")
    order = F.struct(-F.col("size"), F.col("first").isNull(), F.col("first"))
    merged = nodes.join(chained, "h", "left_semi").groupBy("h", "norm").agg(F.min(order).alias("best"), F.sum("n").alias("n")).where("n > 1")
    merged = merged.select("h", sha, F.col("best.first").alias("keep"), (-F.col("best")["col1"]).alias("top"), "n")
    groups = alone.unionByName(merged)

    found = entries.join(groups, ["h", "sha"], "left")
    stays = F.col("n").isNull() | (F.col("id").eqNullSafe(F.col("keep")) & (F.col("size") == F.col("top")))
    found = found.select("id", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), stays.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "row")
    # Several rows of a group that are equal in id and length could stay: the first written one does.
    again = found.where("kept and group_size > 1").groupBy("id", "text_sha256").agg(F.min("row").alias("first_row"), F.count("*").alias("rows")).where("rows > 1")
    again = materialise(again.select(F.col("id").alias("__id"), F.col("text_sha256").alias("__sha"), "first_row"), "several")
    if n_again := again.count():
        found = found.join(small(again, n_again, 96), F.col("id").eqNullSafe(F.col("__id")) & (F.col("text_sha256") == F.col("__sha")), "left")
        found = found.withColumn("kept", F.col("kept") & (F.col("first_row").isNull() | (F.col("row") == F.col("first_row"))))
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts one row stays; columns stay as they are."""
    found = materialise(exact_dedup(docs), "exact")
    id_, sha, own_sha, n = (fresh(c, docs) for c in ("of_id", "of_sha", "own_sha", "own_rank"))
    named = lambda rows: rows.select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha))
    gone = named(found.where(~F.col("kept")))
    own = F.sha2(normalised("text").cast("binary"), 256)
    ids = found.where("kept").groupBy("doc_id").count().where("count > 1").limit(1).count()
    both = found.groupBy("doc_id", "text_sha256").agg(F.min("kept").alias("all"), F.max("kept").alias("any")).where("any and not all").limit(1).count()  # null ids are grouped too
    if ids or both:  # ids that repeat within a group: one row for each kept (id, text)
        kept = named(found.where("kept"))
        longest = Window.partitionBy("doc_id", own_sha).orderBy(F.desc(F.length(F.coalesce("text", F.lit("")))))
        # Before the join, so that the rank filter leaves a row of each key and task to be dealt, however hot the key.
        firsts = docs.withColumn(own_sha, own).withColumn(n, F.row_number().over(longest)).where(F.col(n) == 1)
        return firsts.join(kept, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own_sha) == F.col(sha)), "left_semi").select(*docs.columns)
    gone = small(gone, gone.count(), 96)
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(id_)) & (own == F.col(sha)), "left_anti")


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY size DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""
