"""Course content: key items, item classes, containers, compact indexes and preprocessing messages."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered
from ..functions import dates
from ..functions.text import absolute_url, contains_any, filled, normalize_chapter, snippet, title_tokens, titles_match
from ..sources.shared import written

# What makes an item a key item.
KEY_TITLES = ["syllabus", "schedule", "timeline", "course outline", "course info", "course description", "course overview", "grading", "requirements", "policies"]
KEY_TYPES = ["assignment", "assessment", "test", "exam", "quiz", "discussion", "survey", "turnitin", "scorm"]
KEY_PHRASES = ["grade", "grading", "assessment", "final exam", "midterm", "percentage", "weight", "due date", "submission"]
LONG_TYPES, LONG_CHARS = ["text document", "pdf"], 3000
FINAL_STATES = ["success", "skipped", "image_based"]
CONTAINERS = ["Learning Module", "Open Folder", "Folder"]
NO_TEXT = "(no text)"


def is_key_item(title: str = "title", kind: str = "content_type", text: str = "extracted_text") -> Column:
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    long = low(kind).isin(*LONG_TYPES) & (F.length(F.coalesce(F.col(text), F.lit(""))) > LONG_CHARS)
    return contains_any(low(title), KEY_TITLES) | contains_any(low(kind), KEY_TYPES) | long | contains_any(low(text), KEY_PHRASES)


def classify(host: str, url: str = "url", kind: str = "content_type") -> Column:
    """How an item is read: file, document, assessment, discussion, image_based or skip; the first rule that fits.

    ``host``: what the address of an internal page contains.
    """
    u = F.coalesce(F.col(url), F.lit(""))
    has = lambda x: F.contains(u, F.lit(x))
    return (
        F.when(F.col(kind) == "Photo", "image_based").when(F.col(kind) == "Video", "skip").when(u.isin("", "#"), "skip")
        .when(F.startswith(u, F.lit("http")) & ~has(host), "skip").when(F.endswith(F.regexp_replace(u, "/+$", ""), F.lit("/outline")), "skip")
        .when(has("/outline/file/"), "file").when(has("/outline/edit/document/"), "document").when(has("/outline/assessment/"), "assessment").when(has("/outline/discussion/"), "discussion")
        .otherwise("skip")
    )


def read_status(text: str, failed: str) -> Column:
    """success, no_text, or error after the last attempt."""
    return F.when(F.col(failed), "error").when(F.col(text).isNotNull(), "success").otherwise("no_text")


def unread(items: DataFrame) -> DataFrame:
    """Items an interrupted run still has to read."""
    return items.where(~F.coalesce(F.col("read_status"), F.lit("")).isin(*FINAL_STATES))


def attachment_join(rows: DataFrame, key: str = "item_id") -> DataFrame:
    """(key, text, status) of attachment rows (pos, name, text, reason): each under its name, the text or the reason in brackets."""
    part = F.concat(F.lit("--- "), F.col("name"), F.lit(" ---\n"), F.coalesce(filled("text"), F.concat(F.lit("["), F.coalesce("reason", F.lit("no text")), F.lit("]"))))
    out = rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))), lambda x: x["part"]), "\n\n").alias("text"), F.bool_or(filled("text").isNotNull()).alias("any"))
    return out.select(key, F.when(F.col("any"), F.col("text")).alias("text"), F.when(F.col("any"), "success").otherwise("image_based").alias("status"))


def assessment_text(due: str, attempts: str, description: str) -> Column:
    return filled(F.concat_ws("\n", filled(due), filled(attempts), filled(description)))


def carried_containers(items: DataFrame, course: str = "course_id", pos: str = "pos", title: str = "title", is_container: str = "is_container", is_nested: str = "is_nested", parent: str = "parent_container", width: int = ordered.SEGMENT) -> DataFrame:
    """Adds ``container_name``: the own parent, else the last container before the row.

    A container sets the current one; a row without a parent of its own that
    is not nested takes the current one and ends it.  Rows without a title are
    dropped first.  Containers keep only their own parent.  ``pos`` is a whole
    number; a course is spread over segments of ``width`` places.
    """
    own = filled(parent)
    rows = items.where(filled(title).isNotNull())
    ends = ~F.col(is_container) & own.isNull() & ~F.coalesce(F.col(is_nested), F.lit(False))
    event = F.when(F.col(is_container), F.struct(F.col(title).alias("name"))).when(ends, F.struct(F.lit(None).cast("string").alias("name")))
    rows = ordered.carried(rows, [course], pos, event, "__current", width)
    return rows.withColumn("container_name", F.when(F.col(is_container), own).otherwise(F.coalesce(own, F.col("__current.name")))).drop("__current")


def emitted(items: DataFrame, is_container: str = "is_container") -> DataFrame:
    """Containers are items themselves only when they have a description."""
    return items.where(~F.col(is_container) | filled("description").isNotNull())


def content_items(raw: DataFrame, base_url: str) -> DataFrame:
    """Content objects of raw page rows: containers carried, URL made absolute, due date from the element or the note."""
    rows = emitted(carried_containers(raw.withColumn("is_container", F.col("content_type").isin(*CONTAINERS))))
    noted = dates.parse_due(dates.due_in_note("subtext"))
    due = F.coalesce(dates.leading_date("time_datetime"), noted)
    return rows.select("course_name", "course_id", "pos", "container_name", "title", "content_type", absolute_url("href", base_url, "course_url").alias("url"), due.alias("due_date"), filled("time_datetime").alias("due_date_raw"), filled("description").alias("description"), filled("subtext").alias("subtext"))


def discovered(links: DataFrame, term: str) -> DataFrame:
    """Courses of a scan: the first name seen of every id (by ``pos``), those of the term."""
    first = links.groupBy("course_id").agg(F.min_by("course_name", "pos").alias("course_name"), F.min("pos").alias("pos"))
    return first.where(F.contains("course_name", F.lit(term)))


def nearest_containers(items: DataFrame, key: str = "content_id", parent: str = "parent_id", is_container: str = "is_container", title: str = "title", max_depth: int = 64) -> DataFrame:
    """(key, container_id, container_name, state): of every item the nearest ancestor that is a container.

    ``state``: ``found``; ``top``, where the way up ends without one, at an item without parent or one that is not
    there; ``cycle``, where it comes back to itself or is longer than about ``max_depth`` (the next power of two).
    Pointer doubling: each round every item that is still on its way takes over how far its present ancestor has come,
    so the rounds are the logarithm of the depth.  An ancestor that is a container, or has no parent, is where a way ends.  Keys tell items apart; rows of
    a key given twice are one, the least.
    """
    first = items.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(F.struct(F.col(parent).alias("up"), F.coalesce(F.col(is_container), F.lit(False)).alias("box"), F.col(title).alias("name"))).alias("r"))
    nodes = written(first.select("key", "r.up", "r.box", "r.name"), "containers")
    # ``to``: the ancestor that an item has reached; ``over``: whether the way ends there.
    above = nodes.select(F.col("key").alias("up"), F.col("box").alias("__box"))
    ways = written(nodes.join(above, "up", "left").select("key", F.col("up").alias("to"), F.coalesce("__box", F.lit(True)).alias("over")), "ways")
    for _ in range(max(1, math.ceil(math.log2(max_depth)))):
        if ways.where("not over").isEmpty():
            break
        known = ways.select(F.col("key").alias("__at"), F.col("to").alias("__to"), F.col("over").alias("__over"))
        going = ways.where("not over").join(known, F.col("to") == F.col("__at")).select("key", F.col("__to").alias("to"), F.col("__over").alias("over"))
        ways = written(ways.where("over").unionByName(going), "ways")
    boxes = nodes.where("box").select(F.col("key").alias("to"), F.col("name").alias("container_name"))
    found = ways.join(boxes.withColumn("__found", F.lit(True)), "to", "left")
    state = F.when(~F.col("over"), "cycle").when(F.col("__found"), "found").otherwise("top")
    there = state == "found"
    return found.select(F.col("key").alias(key), F.when(there, F.col("to")).alias("container_id"), F.when(there, F.col("container_name")).alias("container_name"), state.alias("state"))


#: Characters of a piece by which a text that contains another is found.
PIECE = 4


def matched_titles(questions: DataFrame, titles: DataFrame, question: str = "question", title: str = "title") -> DataFrame:
    """(question, title) of the distinct pairs that ``text.titles_match``, without comparing all with all.

    A text that another contains posts one piece of ``PIECE`` characters, the rarest it has over all texts; those that
    may contain it look up all of theirs.  A text too short for a piece is looked up whole among the short substrings,
    which finds matches and nothing else.  By tokens a title needs ``o`` of its ``n`` (two at least), so two of its
    ``n - o + 2`` rarest: it posts the pairs of those, and questions look up their pairs.  Candidates are then tested in
    full.  The empty text is contained in every text, so it is paired with all.
    """
    q = written(questions.select(F.col(question).alias("q")).where("q is not null").distinct().withColumn("n", normalize_chapter(F.lower("q"))), "questions")
    t = written(titles.select(F.col(title).alias("t")).where("t is not null").distinct().withColumn("n", normalize_chapter(F.lower("t"))), "titles")
    found = _by_tokens(q, t).unionByName(_contained(t, "t", q, "q").select("q", "t")).unionByName(_contained(q, "q", t, "t").select("q", "t")).distinct()
    tested = found.where(titles_match("q", "t"))
    # One empty text a side at most; what it is paired with is the result, a row each.
    no_q, no_t = q.where("n = ''").select("q"), t.where("n = ''").select("t")
    empty = no_q.withColumn("k", F.lit(0)).join(t.select("t", F.lit(0).alias("k")), "k").select("q", "t").unionByName(q.select("q", F.lit(0).alias("k")).join(no_t.withColumn("k", F.lit(0)), "k").select("q", "t"))
    return tested.unionByName(empty).distinct().select(F.col("q").alias(question), F.col("t").alias(title))


def _pieces(text: str, length: int) -> Column:
    """The distinct substrings of a length; none of a shorter text."""
    places = F.when(F.length(text) >= length, F.sequence(F.lit(1), F.length(text) - (length - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(F.col(text), i, F.lit(length))))


def _contained(inner: DataFrame, own: str, outer: DataFrame, other: str) -> DataFrame:
    """(own, other): pairs of which the first may be a substring of the second; all that are, empty ones left out."""
    pieces = inner.select(own, F.explode(_pieces("n", PIECE)).alias("piece"))
    held = outer.select(other, F.explode(_pieces("n", PIECE)).alias("piece"))
    often = held.groupBy("piece").agg(F.count("*").alias("df"))
    # A piece that no text of the other side has is the rarest: its text is in none, and meets none.
    rarest = pieces.join(often, "piece", "left").groupBy(own).agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "piece"))["piece"].alias("piece"))
    long = rarest.join(held, "piece").select(own, other)
    short = inner.where((F.length("n") > 0) & (F.length("n") < PIECE)).select(own, F.col("n").alias("piece"))
    whole = outer.select(other, F.explode(F.array_distinct(F.flatten(F.array(*[_pieces("n", k) for k in range(1, PIECE)])))).alias("piece"))
    return long.unionByName(short.join(whole, "piece").select(own, other))


def _by_tokens(q: DataFrame, t: DataFrame) -> DataFrame:
    """(q, t) that share two of the title's rarest tokens."""
    asked = q.select("q", title_tokens("n").alias("tokens"))
    named = t.select("t", F.posexplode(title_tokens("n")).alias("__", "token")).drop("__")
    often = asked.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    ordered_ = named.join(often, "token", "left").groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))), lambda x: x["token"]).alias("tokens"))
    n = F.size("tokens")
    posted = F.slice("tokens", F.lit(1), n - F.greatest(F.lit(2), F.floor(n / 2).cast("int")) + 2)

    def pairs(tokens: Column) -> Column:
        return F.explode(F.flatten(F.transform(tokens, lambda a: F.transform(F.filter(tokens, lambda b: b > a), lambda b: F.concat_ws(" ", a, b)))))

    return asked.select("q", pairs(F.array_sort("tokens")).alias("k")).join(ordered_.where("size(tokens) > 1").select("t", pairs(F.array_sort(posted)).alias("k")), "k").select("q", "t")


def full_texts(items: DataFrame) -> DataFrame:
    """(course_id, title, text): of a repeated title the last text."""
    titled = items.where(filled("extracted_text").isNotNull()).withColumn("title", F.coalesce(filled("title"), F.lit("(untitled)")))
    return titled.groupBy("course_id", "title").agg(F.max_by("extracted_text", "pos").alias("text"))


def index_line() -> Column:
    """One item of a compact index: its head and the lines it has."""
    line = lambda label, value: F.concat(F.lit(f"  {label}: "), value)
    return F.concat_ws(
        "\n", F.concat(F.lit("- ["), F.coalesce("content_type", F.lit("")), F.lit("] "), F.coalesce(filled("title"), F.lit("(untitled)"))),
        line("Container", filled("container_name")), line("Due", F.coalesce(filled("due_date"), filled("due_date_raw"))), line("Description", filled("description")),
        line("Note", filled("subtext")), line("Content", filled(snippet("extracted_text"))),
    )


def compact_index(items: DataFrame) -> DataFrame:
    """(course_id, text): the course's head, then its items in order, a blank line between."""
    rows = items.select("course_id", "course_name", "pos", index_line().alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return rows.groupBy("course_id", "course_name").agg(lines.alias("lines")).select("course_id", F.array_join(F.concat(F.array(F.concat(F.lit("Course: "), F.col("course_name"), F.lit("\n"))), "lines"), "\n\n").alias("text"))


def preprocess_messages(items: DataFrame) -> DataFrame:
    """(course_id, message) for the summary model: full key items, then the compact index."""
    part = F.concat_ws("\n", F.concat(F.lit("["), F.coalesce("content_type", F.lit("")), F.lit("] "), F.coalesce(filled("title"), F.lit("(untitled)"))), F.concat(F.lit("Due: "), F.coalesce(filled("due_date"), filled("due_date_raw"))), F.concat(F.lit("Description: "), filled("description")), F.coalesce(filled("extracted_text"), F.lit(NO_TEXT)))
    keys = items.where(is_key_item()).select("course_id", "pos", part.alias("part")).groupBy("course_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "\n\n").alias("keys"))
    index = compact_index(items)
    return index.join(keys, "course_id", "left").select("course_id", F.concat_ws("\n\n", F.lit("KEY ITEMS"), F.coalesce("keys", F.lit("(none)")), F.lit("ALL ITEMS"), F.col("text")).alias("message"))


def summarise(messages: DataFrame, model, failed: str = "Pre-processing failed") -> DataFrame:
    """(course_id, summary) by an injected callable text -> text; a failure gives a marked summary."""
    @F.pandas_udf("string")
    def called(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return model(text)
            except Exception as error:  # noqa: BLE001 - a model may fail in any way
                return f"{failed}: {error}"

        return texts.map(one)

    return messages.select("course_id", called("message").alias("summary"))
