"""Course summaries in markdown as a table of lines: sections, assignment blocks and their fields.

A summary is split into lines once and every line is classified.  Running
counts then say in which block and in which entry of a block a line stands,
and blocks and their values are aggregations over lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import col, filled, strip

# Headings that begin an assignment, the names of its fields, and what counts as no value.
HEADINGS = "Assignment|Exam|Quiz|Midterm|Final|Homework|Discussion|Paper|Project|Presentation|Lab|Participation|Assessment|Test|Essay|Survey|Portfolio|Writing|Reading Assignment|Problem Set|Response"
FIELDS = {
    "due_date_raw": ["Due Date", "Due date", "Due", "Deadline", "Date Due"],
    "due_date_resolved": ["Due Date Resolved", "Resolved Due Date"],
    "assignment_type": ["Type", "Assignment Type", "Format", "Category"],
    "point_value": ["Weight", "Points", "Point Value", "% of Grade", "Percentage", "Value", "Grade Weight"],
    "confidence": ["Confidence", "Confidence Score", "confidence"],
}
NAME = ["Name"]
ABSENT = ["none", "n/a", "not mentioned", "not available", ""]
FAILED = "pre-processing failed"
SECTION_NAME = "assignments?"

_LABELS = sorted({name.lower() for names in [NAME, *FIELDS.values()] for name in names})


def failed(summary: Column | str) -> Column:
    return F.contains(F.lower(col(summary)), F.lit(FAILED))


def line_table(summaries: DataFrame) -> DataFrame:
    """(summary_id, course_id, course_name, n, line): the lines of every summary that is there and reports no failed run."""
    kept = summaries.where(F.col("summary").isNotNull() & ~failed("summary")).withColumn("summary_id", F.monotonically_increasing_id())
    return kept.select("summary_id", "course_id", "course_name", F.posexplode(F.split("summary", "\n")).alias("n", "line"))


def section_lines(lines: DataFrame) -> DataFrame:
    """The lines after the one that names the section, up to the next section; all lines where none names it.

    That line is not looked for at the left margin: without a ``## ASSIGNMENTS`` line the heading of the first
    assignment is taken for it, and that assignment is lost.  The line right after it never ends the section.
    """
    whole = Window.partitionBy("summary_id")
    names = F.lower("line").rlike(rf"##\s+\d*\.?\s*{SECTION_NAME}\b")
    begun = lines.withColumn("begin", F.min(F.when(names, F.col("n"))).over(whole)).withColumn("last", F.max("n").over(whole))
    begun = begun.withColumn("begin", F.coalesce(F.when(F.col("begin") < F.col("last"), F.col("begin")), F.lit(-1)))
    ends = (F.col("begin") >= 0) & (F.col("n") > F.col("begin") + 1) & F.lower("line").rlike(r"^##\s+\d*\.?\s*[a-z]")
    ended = begun.withColumn("end", F.min(F.when(ends, F.col("n"))).over(whole))
    return ended.where((F.col("n") > F.col("begin")) & (F.col("end").isNull() | (F.col("n") < F.col("end")))).drop("last", "end")


def numbered(lines: DataFrame) -> DataFrame:
    """Adds ``block``, how many headings a line has come after, and ``entry``, how many headings and bold bullets."""
    heading = F.col("line").rlike(r"^#{1,4}(\s|$)") & (F.col("n") > F.col("begin") + 1)
    bullet = F.col("line").rlike(r"^\s*[-*]\s*\*\*")
    so_far = Window.partitionBy("summary_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumns({"block": F.sum(heading.cast("int")).over(so_far), "entry": F.sum((heading | bullet).cast("int")).over(so_far)})


def entry_table(lines: DataFrame) -> DataFrame:
    """(summary_id, course_id, course_name, block, entry, head, link, text): an entry is a bold bullet with the lines under it.

    ``head`` is its first line that is neither blank nor a rule, ``link`` its first address.
    """
    line = F.col("line")
    told = F.when(~line.rlike(r"^\s*(---+\s*)?$"), F.col("n"))
    link = F.regexp_extract("line", r"https?://\S+", 0)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("summary_id", "course_id", "course_name", "block", "entry").agg(F.min_by(line, told).alias("head"), F.min_by(link, F.when(link != "", F.col("n"))).alias("link"), F.max(~line.rlike(r"^\s*$")).alias("any"), text.alias("text"))


def flat(value: Column) -> Column:
    """A value on one line: emphasis dropped, bullets under it divided by semicolons."""
    plain = F.regexp_replace(strip(value), r"[*`]+", "")
    rows = F.filter(F.transform(F.split(plain, "\n"), strip), lambda x: x != "")
    listed = F.transform(rows, lambda x, i: F.when((i > 0) & x.rlike(r"^[-]\s"), F.concat(F.lit("; "), strip(F.substr(x, F.lit(2))))).when(i > 0, F.concat(F.lit(" "), x)).otherwise(x))
    return strip(F.array_join(listed, ""))


def labelled(entries: DataFrame) -> DataFrame:
    """Entries with ``label`` and ``value``, a row for each bold label in them: what follows the label; null where there is none."""
    label = rf"\*\*({'|'.join(_LABELS)})[:\s]*\*\*"
    given = entries.withColumn("label", F.explode_outer(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(f"(?i){label}"), F.lit(1)), F.lower))))
    rest = F.regexp_replace("text", F.concat(F.lit(r"(?is)\A.*?\*\*"), "label", F.lit(r"[:\s]*\*\*")), F.lit(""))
    return given.withColumn("value", flat(rest)).drop("text")


def usable(names: list[str]) -> Column:
    """Of a block's values by label, that of the first of the names that has one, else null."""
    values = [F.col(f"value of {n}") for n in dict.fromkeys(n.lower() for n in names)]
    return F.coalesce(*[F.when(~F.lower(v).isin(*ABSENT), v) for v in values])


def heading_title(first_line: Column | str) -> Column:
    """The title in a heading: without its marks and without an opening noun, number and colon or full stop."""
    words = strip(F.regexp_replace(col(first_line), "^#+", ""))
    return strip(F.regexp_replace(words, rf"^(?i:{HEADINGS})\s*\d*\s*[:.]", ""))


def parse_assignments(summaries: DataFrame) -> DataFrame:
    """Rows of (course_id, course_name, summary) to one row per assignment, ``pos`` its place in the summary.

    Summaries that are null or report a failed run give none.
    """
    rows = labelled(entry_table(numbered(section_lines(line_table(summaries)))))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("entry"))).alias(c)
    values = [F.min_by("value", F.when(F.col("label") == n, F.col("entry"))).alias(f"value of {n}") for n in _LABELS]  # of a label given twice the first
    blocks = rows.groupBy("summary_id", "course_id", "course_name", "block").agg(first("head"), first("link"), F.max("any").alias("any"), *values).where("any")
    placed = blocks.withColumn("pos", (F.col("block") - F.min("block").over(Window.partitionBy("summary_id"))).cast("int"))
    found = placed.where(F.lower(strip("head")).rlike(rf"^#{{1,4}}\s+(?:{HEADINGS.lower()})\b"))
    text = lambda c: F.coalesce(c, F.lit(""))
    return found.select("course_id", "course_name", "pos", F.coalesce(usable(NAME), heading_title(strip("head"))).alias("title"), *[text(usable(names)).alias(out) for out, names in FIELDS.items()], text(F.col("link")).alias("source_link"))
