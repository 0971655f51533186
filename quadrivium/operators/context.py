"""Prompt context: attachments, course summaries with their overrides, and retrieved excerpts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .documents import title_of
from .retrieval import TOP_K_PER_COURSE, search_each

RULE = "\n\n---\n\n"


def _joined(rows: DataFrame, text: str, mark: str) -> DataFrame:
    return rows.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(text).alias("t")))), lambda x: x["t"]), mark).alias("text"))


def excerpts(chunks: DataFrame, documents: DataFrame, query: list[float], courses: DataFrame, top_k: int = TOP_K_PER_COURSE) -> DataFrame:
    """(course_id, rank, part) of the retrieved chunks; summaries are dropped after the ranking, so fewer may stay."""
    own = chunks.withColumn("course_id", F.col("metadata.course_id")).join(courses.select("course_id").distinct(), "course_id", "left_semi")
    hits = search_each(own, query, "course_id", top_k).where(~(F.coalesce(F.col("metadata.content_type"), F.lit("")) == "course_summary"))
    return title_of(hits, documents).select("course_id", "rank", F.concat(F.lit("[Relevant excerpt from "), F.col("doc_title"), F.lit("]\n"), F.col("text")).alias("part"))


def build_context(courses: DataFrame, summaries: DataFrame, found: DataFrame, attached: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """One row, ``text``: overrides, attachments, then a block per routed course (pos, course_id, course_name).

    ``found`` comes from ``excerpts``, ``attached`` from ``attachment_texts``, ``overrides`` from ``overrides_block``.
    """
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"]), "\n\n").alias("parts")
    head = F.concat(F.lit("[Pre-processed Course Summary: "), F.col("course_name"), F.lit("]\n"), F.nullif(F.col("summary"), F.lit("")))
    blocks = courses.join(summaries.select("course_id", "summary"), "course_id", "left").join(found.groupBy("course_id").agg(parts), "course_id", "left")
    body = _joined(blocks.select("pos", F.concat_ws("\n\n", head, "parts").alias("block")), "block", RULE).withColumnRenamed("text", "body")
    before = _joined(attached.select("pos", F.concat(F.lit("[Attached document: "), F.col("title"), F.lit("]\n"), F.col("text")).alias("block")), "block", RULE) if attached is not None else None
    # A row for each of the three parts, put side by side by one aggregation: a prompt is one text by definition.
    parts_ = body.select(F.lit("body").alias("kind"), F.col("body").alias("text"))
    for kind, rows in (("attached", before), ("fixed", overrides)):
        if rows is not None:
            parts_ = parts_.unionByName(rows.select(F.lit(kind).alias("kind"), "text"))
    side = parts_.groupBy().agg(*[F.max(F.when(F.col("kind") == k, F.col("text"))).alias(k) for k in ("fixed", "attached", "body")])
    main = F.concat_ws(RULE, F.nullif("attached", F.lit("")), F.nullif("body", F.lit("")))
    return side.select(F.when(F.col("fixed").isNotNull(), F.concat("fixed", F.lit("\n---\n\n"), main)).otherwise(main).alias("text"))
