"""Audit of the extraction: counts, date categories, missing fields, duplicates, verdict."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.similarity import DUPLICATE
from ..functions.text import filled, percent
from ..sources.shared import written
from .similar import similar_titles, title_classes

LOW_COUNT = 5
FIELDS = ["title", "course_id", "due_date_raw", "due_date_resolved", "assignment_type", "point_value", "source_link", "confidence"]
CRITICAL = ["title", "course_id", "due_date_raw"]
PARSEABLE = ["iso_datetime", "iso_date", "date_string"]
#: About how many keys of a title are expanded at once, how many pairs of rows a task makes, and most tasks (then with more pairs each).
BLOCK_KEYS = 1000
TASK_PAIRS = 5_000_000
TASKS = 10_000


def per_course(courses: DataFrame, assignments: DataFrame) -> DataFrame:
    """Assignments per course with a flag below five; courses without any are there, failed ones (``failed``) are not."""
    n = assignments.groupBy("course_id").agg(F.count("*").alias("__n"))
    return courses.where("not failed").join(n, "course_id", "left").select("course_id", F.coalesce("__n", F.lit(0)).alias("n")).withColumn("low", F.col("n") < LOW_COUNT)


def categorised(assignments: DataFrame, raw: str = "due_date_raw", resolved: str = "due_date_resolved") -> DataFrame:
    return assignments.withColumn("category", dates.effective_category(raw, resolved)).withColumn("timed", dates.has_time(raw, "category"))


def histogram(rows: DataFrame, category: str = "category") -> DataFrame:
    """All six categories in their order, empty ones too, with their share."""
    spark = rows.sparkSession
    names = spark.createDataFrame(list(enumerate(dates.CATEGORIES)), "place int, category string")
    n = rows.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("__n"))
    total = rows.agg(F.count("*").alias("total"))
    out = F.broadcast(names).join(n, "category", "left").join(F.broadcast(total))
    return out.select("place", "category", F.coalesce("__n", F.lit(0)).alias("n"), percent(F.coalesce("__n", F.lit(0)), "total").alias("share"), F.col("category").isin(*PARSEABLE).alias("parseable")).orderBy("place")


def missing(rows: DataFrame, fields: list[str] | None = None, critical: list[str] | None = None) -> DataFrame:
    """Per field how many values are null or empty: one pass, then unpivoted."""
    fields, critical = fields or FIELDS, CRITICAL if critical is None else critical
    counts = rows.agg(*[F.count_if(filled(F.col(f).cast("string")).isNull()).alias(f) for f in fields])
    return counts.unpivot([], fields, "field", "n").withColumn("critical", F.col("field").isin(*critical))


def duplicate_pairs(rows: DataFrame, least: float = DUPLICATE, group: str = "course_id", key: str = "pos", title: str = "title", exact: bool = True, digits: int | None = None) -> DataFrame:
    """(group, a, b, similarity) of similar titles of a group, a before b; numbered series are no duplicates.

    Distinct titles are compared (``similar.similar_titles``), whatever their number
    of rows.  Only then do titles expand to rows: the output is every pair of rows, as
    many as there are; ``similar.title_classes`` gives each pair of titles once, with
    its number of rows, and ``duplicate_total`` counts the pairs without making them.

    A title's keys are cut into blocks of about ``BLOCK_KEYS``; two blocks of similar
    titles meet in a cell, and cells are dealt by the number of pairs to come, so no
    title makes its pairs in one task.  What is the same for a cell (the similarity to
    ``digits``, which order reaches ``least``) is found before it expands, and it
    expands key by key, so a task has rows of one key with one block in memory.  Rows
    without a key or with equal keys have no order and are no pair.
    """
    blocks = written(_key_blocks(rows, group, key, title), "key-blocks")
    sizes = blocks.groupBy("group", "title").agg(F.sum(F.size("keys")).alias("n"))
    same = sizes.where("n > 1").select("group", F.col("title").alias("ta"), F.col("title").alias("tb"), F.lit(100.0).alias("ab"), F.lit(100.0).alias("ba"))
    side = lambda x, f, n: f.select("group", F.col("title").alias(f"t{x}"), *[F.col(c).alias(f"{c}_{x}") for c in n])
    pairs = similar_titles(rows, least, group, title, exact).withColumnRenamed(group, "group").unionByName(same)
    pairs = written(pairs.join(side("a", sizes, ["n"]), ["group", "ta"]).join(side("b", sizes, ["n"]), ["group", "tb"]), "similar")
    total = pairs.agg(F.sum(F.col("n_a") * F.col("n_b").cast("double")).alias("n")).first().n or 0
    # What an order of the keys gives; null: it is no pair.  Of one title, blocks meet once, and a block itself in one order.
    shown = lambda c: F.when(F.col(c) >= least, F.col(c) if digits is None else F.round(c, digits)).alias(c)
    met = pairs.select("group", "ta", "tb", shown("ab"), shown("ba")).join(side("a", blocks, ["block", "keys"]), ["group", "ta"]).join(side("b", blocks, ["block", "keys"]), ["group", "tb"])
    cells = met.where("ta <> tb or block_a <= block_b").withColumn("ba", F.when((F.col("ta") != F.col("tb")) | (F.col("block_a") < F.col("block_b")), F.col("ba")))
    dealt = cells.repartition(min(TASKS, max(1, math.ceil(total / TASK_PAIRS))), "group", "ta", "tb", "block_a", "block_b")
    # A compiled loop keeps every row that it makes of one input row, and a lambda is not compiled: so keys come one at a time, and a block of rows is kept instead of a cell's.
    one = F.explode(F.transform("keys_a", lambda k: k)).alias("ka")
    made = dealt.select("group", "ab", "ba", "keys_b", one).select("group", "ab", "ba", "ka", F.explode("keys_b").alias("kb"))
    similarity = F.when(F.col("ka") < F.col("kb"), F.col("ab")).when(F.col("ka") > F.col("kb"), F.col("ba"))
    return made.where(similarity.isNotNull()).select(F.col("group").alias(group), F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), similarity.alias("similarity"))


def _key_blocks(rows: DataFrame, group: str, key: str, title: str) -> DataFrame:
    """(group, title, block, keys): the keys of each title, about ``BLOCK_KEYS`` in a block; equal keys share one."""
    keys = rows.select(F.col(group).alias("group"), F.col(title).alias("title"), F.col(key).alias("key")).where("group is not null and title is not null and key is not null")
    long = keys.groupBy("group", "title").agg(F.ceil(F.count("*") / BLOCK_KEYS).alias("blocks"))
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    return keys.join(long, ["group", "title"]).groupBy("group", "title", block.alias("block")).agg(F.collect_list("key").alias("keys"))


def duplicate_total(rows: DataFrame, least: float = DUPLICATE, group: str = "course_id", key: str = "pos", title: str = "title", exact: bool = True) -> DataFrame:
    """(group, duplicates): the number of pairs that ``duplicate_pairs`` gives, without making them."""
    return title_classes(rows, least, group, key, title, exact).groupBy(group).agg(F.sum("pairs").alias("duplicates")).where("duplicates > 0")


def duplicate_groups(rows: DataFrame, group: str = "course_id", key: str = "pos", title: str = "title") -> DataFrame:
    """Equal titles as (first key, count): the linear form of the pairs of equal titles."""
    return rows.groupBy(group, title).agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1")


def first_pairs(pairs: DataFrame, limit: int = 20) -> DataFrame:
    return pairs.orderBy("a", "b").limit(limit)


def confidence_presence(rows: DataFrame, shown: int = 8) -> DataFrame:
    """How many rows have a confidence, and the first few."""
    has = filled("confidence")
    count = rows.agg(F.count(has).alias("n"))
    first = rows.where(has.isNotNull()).orderBy("pos").limit(shown).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "confidence"))), lambda x: x["confidence"]).alias("first"))
    return count.join(F.broadcast(first))  # one row each


def verdict(total: int, parseable: int, critical_missing: int, duplicates: int) -> str:
    share = 100 * parseable / total if total else 0
    return "GREEN" if share >= 80 and not critical_missing and not duplicates else "YELLOW" if share >= 60 else "RED"


def verdict_of(hist: DataFrame, gaps: DataFrame, totals: DataFrame) -> DataFrame:
    """One row: share of parseable dates, critical gaps, duplicates (of ``duplicate_total``) and the verdict."""
    h = hist.agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("parseable"), F.col("n"))), F.lit(0)).alias("parseable"))
    g = gaps.agg(F.coalesce(F.sum(F.when(F.col("critical"), F.col("n"))), F.lit(0)).alias("gaps"))
    d = totals.agg(F.coalesce(F.sum("duplicates"), F.lit(0)).alias("duplicates"))
    share = F.when(F.col("total") > 0, 100.0 * F.col("parseable") / F.nullif(F.col("total"), F.lit(0))).otherwise(0.0)
    return h.join(F.broadcast(g)).join(F.broadcast(d)).select("total", "parseable", "gaps", "duplicates", F.when((share >= 80) & (F.col("gaps") == 0) & (F.col("duplicates") == 0), "GREEN").when(share >= 60, "YELLOW").otherwise("RED").alias("verdict"))


def sample(rows: DataFrame, seed: int, n: int = 10) -> DataFrame:
    return rows.orderBy(F.rand(seed)).limit(n)


def read_rollup(items: DataFrame) -> DataFrame:
    """Totals of a reading run: all, read, and skipped or left to vision."""
    s = F.col("read_status")
    return items.agg(F.count("*").alias("total"), F.count_if(s == "success").alias("read"), F.count_if(s.isin("skipped", "image_based")).alias("skipped"))
