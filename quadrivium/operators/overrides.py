"""User overrides of extracted deadlines: application, the change log, and markdown rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import filled, strip
from . import ordered

EDITABLE = ("title", "due_date_resolved", "type", "notes")
EDITS = "array<struct<field: string, value: string>>"


def edit(field: str) -> Column:
    """The non-null value an override gives to a field, else null."""
    return F.get(F.filter("edits", lambda e: (e["field"] == field) & e["value"].isNotNull()), 0)["value"]


def apply(deadlines: DataFrame, overrides: DataFrame) -> DataFrame:
    """Left join on id: dismissed, then every non-null edit, its old value kept, fields in the order of entry.

    Deadlines without an override get ``user_edited`` and ``dismissed`` false.
    """
    o = overrides.select("id", F.col("edits").cast(EDITS).alias("edits"), F.col("dismissed").alias("__dismissed"))
    rows = deadlines.withColumns({c: F.lit(None).cast("string") for c in EDITABLE if c not in deadlines.columns}).join(o, "id", "left")
    used = F.filter(F.coalesce("edits", F.array().cast(EDITS)), lambda e: e["value"].isNotNull())
    old = F.create_map(*[x for c in EDITABLE for x in (F.lit(c), F.col(c).cast("string"))])
    rows = rows.withColumns({"__used": used, "__old": old})
    return rows.select(
        *[c for c in rows.columns if c not in (*EDITABLE, "edits", "__dismissed", "__used", "__old", "dismissed")],
        *[F.coalesce(edit(c), F.col(c)).alias(c) for c in EDITABLE],
        F.coalesce("__dismissed", F.lit(False)).alias("dismissed"), (F.size("__used") > 0).alias("user_edited"),
        F.transform("__used", lambda e: e["field"]).alias("user_edited_fields"),
        F.transform("__used", lambda e: F.struct(e["field"].alias("field"), F.col("__old")[e["field"]].alias("value"))).alias("ai_original"),
    )


def manual_adds(overrides: DataFrame, deadlines: DataFrame) -> DataFrame:
    """Manual entries whose id was not extracted."""
    return overrides.where("manual_add").join(deadlines.select("id"), "id", "left_anti")


def known_ids(ids: DataFrame, deadlines: DataFrame, overrides: DataFrame) -> DataFrame:
    """Ids that a change may name: resolved or waiting deadlines, or any override; dismissed ones do not count."""
    found = deadlines.where(F.col("bucket").isin("resolved", "needs_attention")).select("id").unionByName(overrides.select("id"))
    return ids.join(found, "id", "left_semi")


def fold(log: DataFrame, width: int = ordered.SEGMENT) -> DataFrame:
    """State of every entry after a log of (seq, id, op, field, value, at).

    ops: set (field), dismiss / undismiss, manual, clear (field or, with null, the entry); ``seq``, a whole number,
    orders the events of an id, and other columns those of equal ``seq``.  A cleared field removes an entry left
    without edits unless it is dismissed, even a manual one; what follows starts anew.

    The state is not carried from event to event.  Whether a field has an edit depends on that field's events alone,
    and so does dismissal: a removal happens only where none of them is left.  So each of these parts says at which
    events it comes and goes; a running count of the parts that are there gives the clear events that remove the
    entry; and the state is what came after the last of them.  All of it is aggregations and counts in segments of a
    log (``ordered``), so that one entry may have any number of events.
    """
    order = F.struct("seq", "op", "field", "value", "at")
    events = log.select("id", "seq", "op", "field", "value", "at", order.alias("o"))
    wiped = events.where("op = 'clear' and field is null").groupBy("id").agg(F.max("o").alias("__wiped"))
    events = events.join(wiped, "id", "left").where("__wiped is null or o > __wiped").drop("__wiped")

    # A part is a field, or the dismissal; an event turns it on or off.
    part = F.when(F.col("op").isin("set", "clear"), F.concat(F.lit("."), F.col("field"))).when(F.col("op").isin("dismiss", "undismiss"), "dismissed")
    turned = events.withColumns({"part": part, "on": F.col("op").isin("set", "dismiss")})
    acts = turned.where("part is not null")
    before = ordered.carried_by(acts, ["id", "part"], "seq", "o", F.col("on"), "__was", width)
    step = before.withColumn("step", F.col("on").cast("int") - F.coalesce("__was", F.lit(False)).cast("int"))
    there = ordered.running(step, ["id"], "seq", F.col("step"), "parts", ["o"], width)
    removed = there.where("op = 'clear' and parts = 0").groupBy("id").agg(F.max("o").alias("__removed"))

    # Of a part, its last event counts, and where it is on, since when.
    parts = step.groupBy("id", "part").agg(F.max_by(F.struct("on", "value"), "o").alias("last"), F.max(F.when(F.col("step") == 1, F.col("o"))).alias("since")).where("last.on")
    edits = F.collect_list(F.when(F.col("part") != "dismissed", F.struct("since", F.substr("part", F.lit(2)).alias("field"), F.col("last.value").alias("value"))))
    of_parts = parts.groupBy("id").agg(F.transform(F.array_sort(edits), lambda x: F.struct(x["field"].alias("field"), x["value"].alias("value"))).cast(EDITS).alias("edits"), F.bool_or(F.col("part") == "dismissed").alias("dismissed"))
    live = events.where("op in ('set', 'dismiss', 'undismiss', 'manual')").join(removed, "id", "left").where("__removed is null or o > __removed")
    entries = live.groupBy("id").agg(F.max_by("at", "o").alias("edited_at"), F.bool_or(F.col("op") == "manual").alias("manual_add"))
    return entries.join(of_parts, "id", "left").select("id", F.coalesce("edits", F.array().cast(EDITS)).alias("edits"), F.coalesce("dismissed", F.lit(False)).alias("dismissed"), "edited_at", "manual_add")


def overrides_block(items: DataFrame, courses: DataFrame) -> DataFrame:
    """One row, ``text``: all overridden items by course in first-seen order; no row without any.

    ``items`` has a ``pos`` in store order (resolved, needs_attention, dismissed).
    """
    due = F.coalesce(filled("due_date_resolved"), F.lit("UNRESOLVED"))
    kind = F.when(filled("type").isNotNull(), F.concat(F.lit("\n    Type: "), F.col("type"))).otherwise("")
    before = F.get(F.filter("ai_original", lambda e: e["field"] == "due_date_resolved"), 0)["value"]
    original = F.when(filled(before).isNotNull(), F.concat(F.lit(" (original AI extraction was "), before, F.lit(")"))).otherwise("")
    body = (
        F.when(F.col("dismissed"), F.lit("    Status: User dismissed (not a real deadline; ignore)"))
        .when(F.col("manual_add"), F.concat(F.lit("    Due: "), due, kind, F.lit("\n    Status: User-added manually")))
        .otherwise(F.concat(F.lit("    Due: "), due, kind, F.lit("\n    Status: User-edited"), original))
    )
    rows = items.where("dismissed or manual_add or user_edited").join(courses.select("course_id", F.col("course_name").alias("__name")), "course_id", "left")
    rows = rows.select("course_id", "pos", F.coalesce("__name", "course_id").alias("name"), F.concat(F.lit('- "'), F.coalesce("title", F.lit("(untitled)")), F.lit('"\n'), body).alias("line"))
    by_course = rows.groupBy("course_id", "name").agg(F.min("pos").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    part = F.concat(F.lit("Course: "), F.col("name"), F.lit("\n"), F.col("lines"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("first", part.alias("part")))), lambda x: x["part"])
    # Fixed value: the heading of the block.
    heading = "[USER-CONFIRMED OVERRIDES — AUTHORITATIVE]\nThe user has manually corrected the following deadlines. These supersede any\nconflicting information in summaries, document text, or the item index below.\n\n"
    return by_course.groupBy().agg(parts.alias("parts")).where(F.size("parts") > 0).select(F.concat(F.lit(heading), F.array_join("parts", "\n\n"), F.lit("\n")).alias("text"))


# --- overrides in the summaries ------------------------------------------------------------

# The labels of a block's lines, and the lines of a block added by hand.
LABELS = {"title": "Name", "due_date_resolved": "Due Date Resolved", "type": "Type", "notes": "User notes"}
BY_HAND = ["### Assignment", "- **Name:** {title}", "- **Type:** {type}", "- **Due Date:** (user-added)", "- **Due Date Resolved:** {due_date_resolved}", "- **Weight:** not specified", "- **Confidence:** 5"]
ABSENT = {"title": "Untitled", "type": "manual", "due_date_resolved": "UNRESOLVED"}
ASSIGNMENT = r"(?i)### Assignment\s*\n"
SECTION_END = r"(?is)\A(.*?## ASSIGNMENTS.*?)(?=\n## |\z)"


def joined(order: str, text: Column | str, mark: str = "") -> Column:
    """The texts of a group in order, as one."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, (F.col(text) if isinstance(text, str) else text).alias("t")))), lambda x: x["t"]), mark)


def literal(replacement: Column | str) -> Column:
    """A replacement text in which no character is special."""
    return F.regexp_replace(replacement, r"([\\$])", r"\\$1")


def block_table(summaries: DataFrame) -> DataFrame:
    """(course_id, at, piece, name, nth): the pieces whose concatenation is a summary.

    A piece begins at an assignment heading or a line that begins with ``###``; one that begins with an assignment
    heading is a block and has a name (lower case, trimmed), ``nth`` of its course from 1.
    """
    pieces = summaries.select("course_id", F.posexplode(F.split("summary", rf"{ASSIGNMENT.replace('(?i)', '(?i)(?=')})|(?<=\n)(?=###)")).alias("at", "piece"))
    name = F.when(F.col("piece").rlike(r"\A" + ASSIGNMENT), filled(F.lower(strip(F.regexp_extract("piece", r"\*\*Name:\*\*\s*([^\n]+)", 1)))))
    same = Window.partitionBy("course_id", "name").orderBy("at")
    return pieces.withColumn("name", name).withColumn("nth", F.when(F.col("name").isNotNull(), F.row_number().over(same)))


def assigned(blocks: DataFrame, items: DataFrame) -> DataFrame:
    """Overridden items with ``at``, the piece each one is about, null where there is none.

    An item goes by the title it was extracted with, or by its own where no block has that.  Of several blocks of a
    name it takes the first that is still there and still so named: each earlier item that dismisses or renames one
    moves on by one.  Names are those of the summary as it was; those given by edits are not looked for.
    """
    plain = lambda c: F.lower(strip(F.coalesce(c, F.lit(""))))
    first = F.get(F.filter("ai_original", lambda e: e["field"] == "title"), 0)["value"]
    rows = items.where("user_edited or dismissed or manual_add").withColumns({"__own": plain(F.col("title")), "__first": F.when(F.col("user_edited"), plain(filled(first)))})
    known = blocks.where("name is not null").select("course_id", F.col("name").alias("__first"), F.lit(True).alias("__known")).distinct()
    rows = rows.join(known, ["course_id", "__first"], "left").withColumn("name", F.when(F.col("__known"), F.col("__first")).otherwise(F.col("__own")))
    renames = F.col("user_edited") & ~F.col("manual_add") & F.array_contains("user_edited_fields", "title") & (F.col("__own") != F.col("name"))
    earlier = Window.partitionBy("course_id", "name").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("nth", F.coalesce(F.sum((F.col("dismissed") | renames).cast("int")).over(earlier), F.lit(0)).cast("int") + 1)
    return rows.join(blocks.where("name is not null").select("course_id", "name", "nth", "at"), ["course_id", "name", "nth"], "left")


def edited(piece: str, new: dict[str, str]) -> Column:
    """A block with new values in its lines; notes are added where it has no line for them."""
    text = F.col(piece)
    for field, column in new.items():
        label, value = LABELS[field], F.col(column)
        changed = F.regexp_replace(text, F.lit(rf"(\*\*{label}:\*\*\s*)[^\n]+"), F.concat(F.lit("$1"), literal(value)))
        if field == "notes":
            changed = F.when(F.contains(text, F.lit(f"**{label}:**")), changed).otherwise(F.concat(F.regexp_replace(text, r"\n+\z", ""), F.lit(f"\n- **{label}:** "), value, F.lit("\n")))
        text = F.when(value.isNull(), text).otherwise(changed)
    return text


def apply_to_markdown(summaries: DataFrame, items: DataFrame) -> DataFrame:
    """(course_id, summary) with the overridden items of each course worked in, in ``pos`` order.

    Blocks of dismissed items go, those of edited ones get the new values (of several for one line the last), and
    items added by hand that no block is named after come at the end of the assignments section, or of a summary
    without one.  What is joined again is a summary's own pieces and the entries a user made for a course.
    """
    blocks = block_table(summaries)
    rows = assigned(blocks, items)
    value = lambda f: F.max_by(F.col(f).cast("string"), F.when(F.array_contains("user_edited_fields", f) & F.col(f).isNotNull() & F.col("user_edited") & ~F.col("manual_add") & ~F.col("dismissed"), F.col("pos")))
    per_piece = rows.where("at is not null").groupBy("course_id", "at").agg(F.bool_or("dismissed").alias("__gone"), *[value(f).alias(f"__{f}") for f in LABELS])
    changed = blocks.join(per_piece.select("course_id").distinct(), "course_id", "left_semi").join(per_piece, ["course_id", "at"], "left")
    piece = F.when(F.col("__gone"), "").otherwise(edited("piece", {f: f"__{f}" for f in LABELS}))
    whole = changed.select("course_id", "at", piece.alias("piece")).groupBy("course_id").agg(joined("at", "piece").alias("__text"))

    line = lambda x: F.concat(*[y for k, part in enumerate(x.replace("}", "{").split("{")) for y in ([F.lit(part)] if k % 2 == 0 else [F.coalesce(filled(F.col(part)), F.lit(ABSENT[part]))])])
    notes = F.when(filled(F.col("notes")).isNotNull(), F.concat(F.lit(f"- **{LABELS['notes']}:** "), "notes"))
    made = F.concat(F.concat_ws("\n", *[line(x) for x in BY_HAND], notes), F.lit("\n"))
    added = rows.where("at is null and manual_add and not dismissed").select("course_id", "pos", made.alias("made")).groupBy("course_id").agg(joined("pos", F.concat(F.lit("\n"), F.col("made"))).alias("__made"))
    text = F.coalesce("__text", "summary")
    in_section = F.regexp_replace(text, F.lit(SECTION_END), F.concat(F.lit("$1"), literal("__made")))
    at_end = F.concat(F.regexp_replace(text, r"\n+\z", ""), F.lit("\n"), F.col("__made"))
    out = summaries.join(whole, "course_id", "left").join(added, "course_id", "left")
    return out.select("course_id", F.when(F.col("__made").isNull(), text).when(text.rlike(SECTION_END), in_section).otherwise(at_end).alias("summary"))
