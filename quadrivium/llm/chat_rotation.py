"""Chat formatting: every participant's view of a multi-party dialogue.

For each speaker of a conversation the whole dialogue is rendered once with
that speaker as ``assistant`` and every other one as a named ``user``; only
the assistant's turns (body and end mark) are to be learned from.  The result
is in long form, one row per (conversation, perspective, turn) with its place
and its character offset in the rendered dialogue, so that the dialogue is
fixed to the character while a conversation of any length is never gathered
into one task.  ``system`` turns are shown to all, never learned from, and give
no perspective.

Control marks: a text or name cannot forge one.  In both, ``<`` with any number
of backslashes before ``|`` gets one backslash more, which ``unescaped`` undoes.

Edge cases: turns are in the order of (turn, speaker, rendered text), null turns
first, and equal rows of it in any; all of them stay.  A null role speaks as
``unknown``; a null or empty text renders an empty body; a conversation with
only system turns has no participant and so no row; null conversation ids are
one conversation; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked, table

SYSTEM = "system"
END = "<|end|>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, perspective, place, turn, speaker, role, name, rendered, char_start, learn, mask_start, mask_end).

    ``rendered`` of a view in order of ``place`` (from 0) is its dialogue, where it begins at ``char_start``.
    ``mask_start``/``mask_end`` are the span within ``rendered`` that counts for the loss, empty for other roles; all in code points.
    """
    said = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text_col), F.lit("")).alias("body"), F.monotonically_increasing_id().alias("row"))
    people = said.where(F.col("speaker") != SYSTEM).select("conv", F.col("speaker").alias("perspective")).distinct()
    # Null conversation ids belong together, as in a group by.
    views = said.alias("s").join(people.alias("p"), F.col("s.conv").eqNullSafe(F.col("p.conv"))).select("s.*", "perspective")
    own, system = F.col("speaker") == F.col("perspective"), F.col("speaker") == SYSTEM
    role = F.when(system, SYSTEM).when(own, "assistant").otherwise("user")
    name = F.when(system | own, F.lit(None)).otherwise(F.col("speaker"))
    head = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.when(F.col("name").isNull(), "").otherwise(F.concat(escaped(F.col("name")), F.lit(": "))))
    views = views.withColumns({"role": role, "name": name}).withColumn("head", head)
    rendered = F.concat("head", escaped(F.col("body")), F.lit(END + "\n"))
    learn, start = F.col("role") == "assistant", F.length("head")
    views = views.select("conv", "perspective", "turn", "speaker", "row", "role", "name", rendered.alias("rendered"), learn.alias("learn"), start.alias("mask_start"), F.length(rendered).alias("length"))
    placed = ranked(views, ["conv", "perspective"], ["turn", "speaker", "rendered", "row"], "views", total="length")
    return placed.select(
        F.col("conv").alias(conv_col), "perspective", F.col("rank").alias("place"), F.col("turn").alias(turn_col), "speaker", "role", "name", "rendered", F.col("before").alias("char_start"), "learn",
        "mask_start", F.when(F.col("learn"), F.col("length") - 1).otherwise(F.col("mask_start")).alias("mask_end"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS body FROM conversations
), people AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'
), views AS (
  SELECT s.*, p.perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
         CASE WHEN speaker = 'system' OR speaker = perspective THEN NULL ELSE speaker END AS name
  FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), headed AS (
  SELECT *, '<|' || role || '|>' || chr(10) || CASE WHEN name IS NULL THEN '' ELSE regexp_replace(name, '<(\\*)\|', '<\1\\|', 'g') || ': ' END AS head FROM views
), whole AS (
  SELECT *, head || regexp_replace(body, '<(\\*)\|', '<\1\\|', 'g') || '<|end|>' || chr(10) AS rendered FROM headed
)
SELECT conv_id, perspective, row_number() OVER w - 1 AS place, turn, speaker, role, name, rendered, CAST(sum(length(rendered)) OVER w - length(rendered) AS BIGINT) AS char_start, role = 'assistant' AS learn,
       CAST(length(head) AS INTEGER) AS mask_start, CAST(CASE WHEN role = 'assistant' THEN length(rendered) - 1 ELSE length(head) END AS INTEGER) AS mask_end
FROM whole WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, rendered ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""
