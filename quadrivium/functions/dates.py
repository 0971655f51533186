"""Date and confidence functions over text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, filled, strip

# The patterns below define the audit categories.
ISO_TIME = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"
ISO_DATE = r"\b\d{4}-\d{2}-\d{2}\b"
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec"
DATE_STRING = rf"(?i)(?:{MONTHS})\s+\d{{1,2}}(?:,?\s*\d{{4}})?|\b\d{{1,2}}/\d{{1,2}}(?:/\d{{2,4}})?\b|\b\d{{1,2}}-\d{{1,2}}(?:-\d{{2,4}})?\b"
NAMED_DAY = r"\bnext\s+(monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b|\b(before|by|during)\s+class\b"
RELATIVE = rf"(?i)\bweek\s*\d+\b|{NAMED_DAY}|\b(class|session|lecture|module|unit|lab)\s*\d+\b"
VAGUE = r"(?i)\b(tbd|tba|not specified|end of (semester|term|year|course)|before (spring|fall|winter|summer) break|to be announced|to be determined|flexible|ongoing|see (syllabus|instructor|course page)|check (blackboard|canvas|course page)|varies|rolling|as assigned)\b"
TIME = r"\b\d{1,2}:\d{2}\s*(?:am|pm|AM|PM)?\b"
CATEGORIES = ["iso_datetime", "iso_date", "date_string", "relative", "vague", "missing"]
DUE_FORMATS = ["MMM d, yyyy h:mm a", "MMMM d, yyyy h:mm a", "MMM d, yyyy", "MMMM d, yyyy", "M/d/yyyy", "M/d/yy", "yyyy-M-d"]
DAYS_BEFORE, DAYS_AFTER, OUTLIER_DAYS = 7, 30, 21


def confidence(x: Column | str) -> Column:
    """First digit 1-5 in the text, 2 when there is none."""
    return F.coalesce(filled(F.regexp_extract(col(x), "[1-5]", 0)).cast("int"), F.lit(2))


def resolved_date(x: Column | str) -> Column:
    """ISO minute time, else ISO date, found in the text; null for blank, UNRESOLVED and anything else."""
    s = strip(x)
    found = F.coalesce(filled(F.regexp_extract(s, ISO_TIME, 0)), filled(F.regexp_extract(s, ISO_DATE, 0)))
    return F.when(F.upper(s) != "UNRESOLVED", found)


def day(x: Column | str) -> Column:
    return F.try_to_date(F.left(col(x), F.lit(10)), "yyyy-MM-dd")


def outside_window(due: Column | str, start: Column, end: Column) -> Column:
    """Beyond the semester with its margins; false when the date or the window is unknown."""
    d = day(due)
    return F.coalesce((d < F.date_sub(start, DAYS_BEFORE)) | (d > F.date_add(end, DAYS_AFTER)), F.lit(False))


def date_category(x: Column | str) -> Column:
    """The first category that a text fits, in the order below.

    Cheap tests that a pattern's matches all pass come before it: most texts have no digit, and then only a named day
    can tell them from vague ones; a date as words needs a digit after a letter and blanks, or one beside a dash.
    """
    text = col(x)
    missing = text.isNull() | F.lower(F.left(strip(text), F.lit(8))).isin("", "none", "null", "n/a")
    written = text.rlike(r"\d[-/]\d|[a-zA-Z]\s+\d") & text.rlike(DATE_STRING)
    return (
        F.when(missing, "missing").when(~text.rlike(r"\d"), F.when(text.rlike(rf"(?i){NAMED_DAY}"), "relative").otherwise("vague"))
        .when(text.rlike(r"\d-\d") & text.rlike(ISO_TIME), "iso_datetime").when(text.rlike(r"\d-\d") & text.rlike(ISO_DATE), "iso_date").when(written, "date_string")
        .when(text.rlike(RELATIVE), "relative").when(text.rlike(VAGUE), "vague").otherwise("relative")
    )


def resolved_category(x: Column | str) -> Column:
    s = strip(F.coalesce(col(x), F.lit("")))
    return F.when(s == "", "other").when(F.upper(s) == "UNRESOLVED", "unresolved").when(s.rlike(ISO_TIME), "iso_datetime").when(s.rlike(ISO_DATE), "iso_date").otherwise("other")


def effective_category(raw: Column | str, resolved: Column | str) -> Column:
    r = resolved_category(resolved)
    return F.when(r.isin("iso_datetime", "iso_date"), r).otherwise(date_category(raw))


def has_time(raw: Column | str, category: Column | str) -> Column:
    return (col(category) == "iso_datetime") | F.coalesce(col(raw).rlike(TIME), F.lit(False))


def leading_date(x: Column | str) -> Column:
    return filled(F.regexp_extract(col(x), r"^\d{4}-\d{2}-\d{2}", 0))


def parse_due(x: Column | str) -> Column:
    """ISO date of a written due date, by the first of seven formats that fits."""
    clean = strip(F.regexp_replace(col(x), r"^[Dd]ue:?\s*", ""))
    return F.date_format(F.coalesce(*[F.try_to_timestamp(clean, F.lit(f)) for f in DUE_FORMATS]), "yyyy-MM-dd")


def due_in_note(x: Column | str) -> Column:
    return filled(F.regexp_extract(col(x), r"[Dd]ue\s*[Dd]ate:?\s*(\d{1,2}/\d{1,2}/\d{2,4})", 1))


def as_instant(x: Column | str) -> Column:
    """ISO text as a timestamp; text without an offset is read as UTC (the session's zone)."""
    return F.try_to_timestamp(col(x))


def week_day(start: Column | str, week: Column | str) -> Column:
    """First day of week N of a semester."""
    return F.date_add(col(start), ((col(week) - 1) * 7).cast("int"))


DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def week_resolved(x: Column | str, start: Column | str, meets: Column) -> Column:
    """The day a text like "Week 3 Friday" means in a semester; null (UNRESOLVED) for a text without a week.

    The weekday named in the text, else the first day the course meets (``meets``, an array of weekday names), else the
    first day of the week; weeks run for seven days from the day the semester starts.
    """
    week = filled(F.regexp_extract(col(x), r"(?i)\bweek\s*(\d+)\b", 1)).cast("int")
    first = week_day(start, week)
    index = lambda name: F.nullif(F.array_position(F.array(*[F.lit(d) for d in DAYS]), F.initcap(name)), F.lit(0).cast("long"))
    after = lambda name: F.pmod(index(name) - 1 - F.weekday(first), F.lit(7)).cast("int")
    named = filled(F.regexp_extract(col(x), rf"(?i)\b({'|'.join(DAYS)})\b", 1))
    soonest = F.array_min(F.transform(meets, after))
    return F.date_add(first, F.coalesce(after(named), soonest, F.lit(0)))


def rubric(category: Column | str, on_page: Column) -> Column:
    """Confidence by the form of a date: explicit on the page 5, explicit elsewhere 4, by week 3, vague 2, none 1."""
    c = col(category)
    return F.when(c.isin("iso_datetime", "iso_date", "date_string"), F.when(on_page, 5).otherwise(4)).when(c == "relative", 3).when(c == "vague", 2).otherwise(1)
