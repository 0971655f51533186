"""Deadline pipeline: ids, overrides, bucketing and header counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, markdown
from ..functions.text import blank, course_of_id, filled, slugify, strip
from . import ordered
from . import overrides as o

# Palette of course colours.
COLOURS = ["#2563eb", "#16a34a", "#dc2626", "#ea580c", "#9333ea", "#0891b2"]
LEAST, LEAST_TALK, TALK = 3, 4, ("discussion", "participation")


def with_ids(rows: DataFrame, course: str = "course_id", title: str = "title", pos: str = "pos", width: int = ordered.SEGMENT) -> DataFrame:
    """Adds ``id``: course, slug and how many earlier titles of the course have that slug.

    ``pos`` is a whole number; a title that very many rows have is counted in segments of ``width`` places.
    """
    counted = ordered.numbered(rows.withColumn("__slug", slugify(title)), [course, "__slug"], pos, "__earlier", width=width)
    return counted.withColumn("id", F.concat_ws("__", F.col(course), "__slug", F.col("__earlier").cast("string"))).drop("__slug", "__earlier")


def extracted(assignments: DataFrame) -> DataFrame:
    """Parsed assignments as deadlines; blank titles go. Slug and number use the original title."""
    rows = with_ids(assignments.where(~blank("title")))
    return rows.select(
        "id", "course_id", "course_name", strip("title").alias("title"), F.coalesce(filled(F.lower(strip("assignment_type"))), F.lit("unknown")).alias("type"), "due_date_raw",
        dates.resolved_date("due_date_resolved").alias("due_date_resolved"), dates.confidence("confidence").alias("confidence_score"), filled("source_link").alias("source_link"), F.lit(None).cast("string").alias("source_item_id"), "pos",
    )


def bucketed(deadlines: DataFrame, start: Column, end: Column) -> DataFrame:
    """Adds ``bucket`` and ``flag_reason`` to deadlines that carry their overrides.

    Dismissed first; a row that no user touched must fall in the window; then
    confidence, taken as 5 where the user gave the date.
    """
    due = F.col("due_date_resolved")
    by_user = F.col("user_edited") & F.array_contains("user_edited_fields", "due_date_resolved")
    sure = F.when(by_user, 5).otherwise(F.col("confidence_score"))
    least = F.when(F.lower("type").isin(*TALK), LEAST_TALK).otherwise(LEAST)
    outside = due.isNotNull() & ~F.col("user_edited") & dates.outside_window(due, start, end)
    reason = F.when(F.col("dismissed"), F.lit(None)).when(outside, "outside_semester_window").when(due.isNull(), "unresolved_date").when(sure < least, "low_confidence")
    bucket = F.when(F.col("dismissed"), "dismissed").when(reason.isNotNull(), "needs_attention").otherwise("resolved")
    return deadlines.withColumn("flag_reason", reason).withColumn("bucket", bucket)


def manual(adds: DataFrame, courses: DataFrame) -> DataFrame:
    """Manual entries as bucketed deadlines: confidence 5, their date resolved like an extracted one."""
    value = lambda c: o.edit(c)
    rows = adds.withColumn("course_id", course_of_id("id")).join(courses.select("course_id", F.col("course_name").alias("__name")), "course_id", "left")
    due = dates.resolved_date(value("due_date_resolved"))
    rows = rows.select(
        "id", "course_id", F.coalesce("__name", "course_id").alias("course_name"), F.coalesce(value("title"), F.lit("Untitled")).alias("title"), F.coalesce(value("type"), F.lit("manual")).alias("type"), F.lit("").alias("due_date_raw"),
        due.alias("due_date_resolved"), F.lit(5).alias("confidence_score"), F.lit(None).cast("string").alias("source_link"), F.lit(None).cast("string").alias("source_item_id"), value("notes").alias("notes"), "dismissed", F.lit(True).alias("manual_add"),
    )
    dated = F.col("due_date_resolved").isNotNull()
    reason = F.when(F.col("dismissed"), F.lit(None)).when(dated, "user_added").otherwise("unresolved_date")
    bucket = F.when(F.col("dismissed"), "dismissed").when(dated, "resolved").otherwise("needs_attention")
    return rows.withColumn("flag_reason", reason).withColumn("bucket", bucket)


def aggregate(assignments: DataFrame, overrides: DataFrame, courses: DataFrame, start: Column, end: Column) -> DataFrame:
    """The whole table of deadlines, one ``bucket`` each: extracted ones with their overrides, and manual ones."""
    found = extracted(assignments)
    kept = bucketed(o.apply(found, overrides), start, end).withColumn("manual_add", F.lit(False))
    return kept.unionByName(manual(o.manual_adds(overrides, found), courses), allowMissingColumns=True)


def from_summaries(summaries: DataFrame, overrides: DataFrame, courses: DataFrame, start: Column, end: Column) -> DataFrame:
    """Summaries (course_id, summary) to deadlines; a course without a name goes by its id."""
    named = summaries.join(courses.select("course_id", "course_name"), "course_id", "left").withColumn("course_name", F.coalesce("course_name", "course_id"))
    return aggregate(markdown.parse_assignments(named), overrides, courses, start, end)


def header(deadlines: DataFrame, overrides: DataFrame) -> DataFrame:
    """The counts that head the store, one row."""
    is_ = lambda b: F.count_if(F.col("bucket") == b).alias(b)
    touched = deadlines.select("id", "manual_add").join(overrides.select("id").distinct(), "id", "left_semi").agg(F.count("id").alias("overrides_applied"))
    counts = deadlines.agg(F.count_distinct("course_id").alias("course_count"), F.count("*").alias("total"), is_("resolved"), is_("needs_attention"), is_("dismissed"), F.count_if(F.col("flag_reason") == "outside_semester_window").alias("flagged_outside_window"))
    return counts.join(F.broadcast(touched))  # one row each


def course_list(deadlines: DataFrame, pos: str = "pos") -> DataFrame:
    """Distinct courses in first-seen order."""
    return deadlines.groupBy("course_id", "course_name").agg(F.min(pos).alias("first")).orderBy("first").select("course_id", "course_name")


def colours(courses: DataFrame, course: str = "course_id") -> DataFrame:
    """Colour by alphabetical rank, the palette repeated. A dimension: one task ranks the distinct courses."""
    rank = F.row_number().over(Window.orderBy(course)) - 1
    return courses.select(course).distinct().withColumn("colour", F.element_at(F.array(*[F.lit(c) for c in COLOURS]), (rank % len(COLOURS) + 1).cast("int")))


def calendar(deadlines: DataFrame, palette: DataFrame) -> DataFrame:
    """Calendar events of resolved deadlines that have a start; a value with a ``T`` is timed."""
    rows = deadlines.where((F.col("bucket") == "resolved") & filled("due_date_resolved").isNotNull()).join(palette, "course_id", "left")
    colour = F.coalesce("colour", F.lit(COLOURS[0]))
    return rows.select("id", "title", F.col("due_date_resolved").alias("start"), (~F.contains("due_date_resolved", F.lit("T"))).alias("allDay"), colour.alias("backgroundColor"), colour.alias("borderColor"), F.struct("course_id", "course_name", "type", "confidence_score", "source_link").alias("extendedProps"))


def attention_groups(deadlines: DataFrame) -> DataFrame:
    return deadlines.where(F.col("bucket") == "needs_attention").groupBy("flag_reason").agg(F.count("*").alias("n"))


def resolved_dates(deadlines: DataFrame) -> DataFrame:
    return deadlines.where(F.col("bucket") == "resolved").select(filled("due_date_resolved").alias("due")).where("due is not null")


def anomalies(rows: DataFrame, start: Column, end: Column, key: str = "id", group: str = "course_id", due: str = "due") -> DataFrame:
    """(key, outside, gap_days, outlier) of dated rows.

    ``gap_days``: to the nearest other date of the group; an outlier is over 21
    days from it where the group has two other dates at least.  Rows are counted
    by date first, so what a window orders is a group's distinct dates, which the
    calendar bounds, however many rows it has; every row then looks up its date.
    """
    dated = rows.where(F.col(due).isNotNull())
    days = dated.groupBy(group, due).agg(F.count("*").alias("__on_day"))
    order, whole = Window.partitionBy(group).orderBy(due), Window.partitionBy(group)
    back, ahead = F.datediff(F.col(due), F.lag(due).over(order)), F.datediff(F.lead(due).over(order), F.col(due))
    gap = F.when(F.col("__on_day") > 1, 0).otherwise(F.least(back, ahead))
    known = days.select(F.col(group).alias("__group"), F.col(due).alias("__due"), gap.alias("gap_days"), F.sum("__on_day").over(whole).alias("__n"))
    outside = (F.col(due) < F.date_sub(start, dates.DAYS_BEFORE)) | (F.col(due) > F.date_add(end, dates.DAYS_AFTER))
    found = dated.join(known, F.col(group).eqNullSafe(F.col("__group")) & (F.col(due) == F.col("__due")))
    return found.select(key, outside.alias("outside"), "gap_days", ((F.col("__n") > 2) & (F.col("gap_days") > dates.OUTLIER_DAYS)).alias("outlier"))
