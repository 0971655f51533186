"""Deadline pipeline, overrides and audit on literal rows."""

import pytest
from pyspark.sql import functions as F

from quadrivium.operators import audit, deadlines, overrides

EDITS = "array<struct<field: string, value: string>>"
OVERRIDE = f"id string, edits {EDITS}, dismissed boolean, edited_at string, manual_add boolean"
ASSIGNMENT = "course_id string, course_name string, pos int, title string, assignment_type string, due_date_raw string, due_date_resolved string, point_value string, confidence string, source_link string"

def row(pos, title="Essay", kind="essay", due="2026-03-01", confidence="5", course="c"):
    return (course, "C", pos, title, kind, "raw", due, "", confidence, "")


def run(spark, rows, over=(), courses=(("c", "C"),)):
    a, o = spark.createDataFrame(rows, ASSIGNMENT), spark.createDataFrame(list(over), OVERRIDE)
    c = spark.createDataFrame(list(courses), "course_id string, course_name string")
    return {r["id"]: r for r in deadlines.aggregate(a, o, c, F.lit("2026-01-14").cast("date"), F.lit("2026-05-02").cast("date")).collect()}


def test_index_counts_equal_slugs(spark):
    got = run(spark, [row(0, "Quiz"), row(1, "quiz!"), row(2, "Other"), row(3, " ")])
    assert sorted(got) == ["c__other__0", "c__quiz__0", "c__quiz__1"]


@pytest.mark.parametrize("kind,confidence,want", [("discussion", "3", ("needs_attention", "low_confidence")), ("discussion", "4", ("resolved", None)), ("Participation", "3", ("needs_attention", "low_confidence")), ("essay", "3", ("resolved", None)), ("essay", "", ("needs_attention", "low_confidence"))])
def test_confidence_thresholds(spark, kind, confidence, want):
    r = run(spark, [row(0, kind=kind, confidence=confidence)])["c__essay__0"]
    assert (r.bucket, r.flag_reason) == want


def test_window_and_edits(spark):
    late = row(0, due="2026-07-01")
    assert run(spark, [late])["c__essay__0"].flag_reason == "outside_semester_window"
    notes = ("c__essay__0", [("notes", "x")], False, None, False)
    r = run(spark, [late], [notes])["c__essay__0"]
    assert (r.bucket, r.flag_reason, r.user_edited, r.notes) == ("resolved", None, True, "x"), "any edit skips the window test"
    dated = ("c__essay__0", [("due_date_resolved", "2026-04-01"), ("title", None)], False, None, False)
    r = run(spark, [row(0, confidence="1")], [dated])["c__essay__0"]
    assert (r.bucket, r.confidence_score, r.due_date_resolved, r.user_edited_fields) == ("resolved", 1, "2026-04-01", ["due_date_resolved"])
    assert [tuple(x) for x in r.ai_original] == [("due_date_resolved", "2026-03-01")]
    r = run(spark, [row(0, due="UNRESOLVED")])["c__essay__0"]
    assert (r.bucket, r.flag_reason) == ("needs_attention", "unresolved_date")


def test_dismissed_and_manual(spark):
    over = [
        ("c__essay__0", [], True, None, False), ("c__mine__0", [("title", "Mine"), ("due_date_resolved", "2026-02-02T09:30:00")], False, None, True),
        ("d__later__0", [("title", "Later")], False, None, True), ("c__gone__0", [("title", "Gone")], True, None, True),
    ]
    got = run(spark, [row(0)], over)
    assert (got["c__essay__0"].bucket, got["c__essay__0"].flag_reason) == ("dismissed", None)
    m = got["c__mine__0"]
    assert (m.bucket, m.flag_reason, m.due_date_resolved, m.confidence_score, m.course_name) == ("resolved", "user_added", "2026-02-02T09:30", 5, "C")
    assert (got["d__later__0"].bucket, got["d__later__0"].flag_reason, got["d__later__0"].course_name) == ("needs_attention", "unresolved_date", "d")
    assert got["c__gone__0"].bucket == "dismissed"


def test_buckets_are_a_partition(spark):
    rows = [row(i, title=f"t{i}", kind=k, due=d, confidence=c) for i, (k, d, c) in enumerate((k, d, c) for k in ("essay", "discussion") for d in ("", "2026-03-01", "2029-01-01") for c in ("1", "3", "5"))]
    got = run(spark, rows)
    assert len(got) == len(rows) and {r.bucket for r in got.values()} <= {"resolved", "needs_attention", "dismissed"}


def test_colours_repeat_after_six(spark):
    c = spark.createDataFrame([(f"c{i}",) for i in range(7)], "course_id string")
    got = {r[0]: r[1] for r in deadlines.colours(c).collect()}
    assert got["c0"] == got["c6"] and len(set(got.values())) == 6


def test_anomalies(spark):
    rows = spark.createDataFrame([("a", 1, "2026-02-01"), ("b", 1, "2026-02-22"), ("c", 1, "2026-03-16"), ("d", 2, "2026-02-01"), ("e", 2, "2026-04-01")], "id string, course_id int, due string").withColumn("due", F.to_date("due"))
    got = {r.id: (r.gap_days, r.outlier) for r in deadlines.anomalies(rows, F.lit("2026-01-14").cast("date"), F.lit("2026-05-02").cast("date")).collect()}
    assert got == {"a": (21, False), "b": (21, False), "c": (22, True), "d": (59, False), "e": (59, False)}


def fold(spark, *events):
    log = spark.createDataFrame([(i, "d", *e) for i, e in enumerate(events)], "seq int, id string, op string, field string, value string, at string")
    rows = overrides.fold(log).collect()
    return rows[0] if rows else None


def test_fold_of_changes(spark):
    e = fold(spark, ("set", "title", "A", "1"), ("set", "due_date_resolved", "2026-03-20", "2"), ("set", "title", "B", "3"))
    assert [tuple(x) for x in e.edits] == [("title", "B"), ("due_date_resolved", "2026-03-20")] and e.edited_at == "3" and not e.dismissed
    e = fold(spark, ("set", "title", "A", "1"), ("set", "notes", "n", "2"), ("clear", "title", None, "3"))
    assert [tuple(x) for x in e.edits] == [("notes", "n")]
    assert fold(spark, ("set", "title", "A", "1"), ("clear", "title", None, "2")) is None
    assert fold(spark, ("set", "title", "A", "1"), ("dismiss", None, None, "1"), ("clear", None, None, "2")) is None
    assert fold(spark, ("manual", None, None, "1"), ("set", "title", "A", "2"), ("clear", "title", None, "3")) is None, "a manual entry goes with its last edit"
    assert fold(spark, ("dismiss", None, None, "1"), ("set", "title", "A", "2"), ("clear", "title", None, "3")).dismissed
    assert fold(spark, ("dismiss", None, None, "1"), ("undismiss", None, None, "2")).dismissed is False


def test_apply_leaves_others_alone(spark):
    d = spark.createDataFrame([("x", "Midterm", "2026-03-15", "exam")], "id string, title string, due_date_resolved string, type string")
    o = spark.createDataFrame([("y", [("title", "Z")], True, None, False)], OVERRIDE)
    r = overrides.apply(d, o).first()
    assert (r.title, r.user_edited, r.dismissed, r.ai_original) == ("Midterm", False, False, [])
    deadline = spark.createDataFrame([("y", "resolved"), ("z", "dismissed")], "id string, bucket string")
    ids = spark.createDataFrame([("y",), ("z",), ("q",)], "id string")
    assert [r.id for r in overrides.known_ids(ids, deadline, o.where("id = 'q'")).collect()] == ["y"]


MARK = "## ASSIGNMENTS\n### Assignment\n- **Name:** One\n- **Type:** essay\n- **Due Date Resolved:** x\n### Assignment\n- **Name:** Two\n## GRADING\nall\n"


def item(**k):
    return {"title": "", "type": None, "due_date_resolved": None, "notes": None, "dismissed": False, "user_edited": False, "manual_add": False, "user_edited_fields": [], "ai_original": []} | k


ITEM = f"course_id string, pos int, title string, type string, due_date_resolved string, notes string, dismissed boolean, user_edited boolean, manual_add boolean, user_edited_fields array<string>, ai_original {EDITS}"


def rewritten(spark, markdown, items):
    rows = [("c", i, x.get("title"), x.get("type"), x.get("due_date_resolved"), x.get("notes"), x.get("dismissed", False), x.get("user_edited", False), x.get("manual_add", False), x.get("user_edited_fields", []), [(e["field"], e["value"]) for e in x.get("ai_original", [])]) for i, x in enumerate(items)]
    s = spark.createDataFrame([("c", markdown)], "course_id string, summary string")
    return overrides.apply_to_markdown(s, spark.createDataFrame(rows, ITEM)).first()["summary"]


def test_markdown_rewriting(spark):
    assert "One" not in rewritten(spark, MARK, [item(title="one", dismissed=True)])
    assert rewritten(spark, MARK, [item(title="Two", dismissed=True)]) == MARK[: MARK.index("### Assignment\n- **Name:** Two")], "the last block takes what follows with it"
    edited = item(title="Uno", due_date_resolved="2026-01-01", notes="n", user_edited=True, user_edited_fields=["title", "due_date_resolved", "notes"], ai_original=[{"field": "title", "value": "One"}])
    out = rewritten(spark, MARK, [edited])
    assert "- **Name:** Uno" in out and "- **Due Date Resolved:** 2026-01-01" in out and "- **User notes:** n" in out and "Two" in out
    out = rewritten(spark, MARK, [item(title="New", manual_add=True)])
    assert out.index("New") < out.index("## GRADING") and "UNRESOLVED" in out and rewritten(spark, out, [item(title="New", manual_add=True)]) == out
    assert rewritten(spark, MARK, [item(title="None such", dismissed=True)]) == MARK


def test_markdown_of_equal_names_and_special_characters(spark):
    block = lambda name, kind="essay": f"### Assignment\n- **Name:** {name}\n- **Type:** {kind}\n"
    three = "# Head\n" + block("Quiz", "a") + block("QUIZ ", "b") + block("Quiz", "c")
    renamed = lambda new, **own: item(title=new, user_edited=True, user_edited_fields=["title"], ai_original=[{"field": "title", "value": "Quiz"}], **own)
    assert rewritten(spark, three, [renamed("A $1 \\x"), renamed("B")]) == "# Head\n" + block("A $1 \\x", "a") + block("B", "b") + block("Quiz", "c"), "a renamed block is not found again"
    assert rewritten(spark, three, [item(title="quiz", dismissed=True), item(title="quiz", dismissed=True)]) == "# Head\n" + block("Quiz", "c")
    kind = lambda t: item(title="Quiz", type=t, user_edited=True, user_edited_fields=["type"])
    assert rewritten(spark, three, [kind("x"), kind("y")]) == "# Head\n" + block("Quiz", "y") + three[three.index("### Assignment\n- **Name:** QUIZ") :], "both are about the first"
    noted = item(title="Quiz", notes="new", user_edited=True, user_edited_fields=["notes"])
    assert rewritten(spark, block("Quiz") + "- **User notes:** old\n", [noted]) == block("Quiz") + "- **User notes:** new\n"
    assert rewritten(spark, block("Quiz") + "\n\n", [noted]) == block("Quiz") + "- **User notes:** new\n"
    two = [item(title="P", manual_add=True, notes="by $hand"), item(title="Q", manual_add=True, type="exam", due_date_resolved="2026-02-02"), item(title="Gone", manual_add=True, dismissed=True)]
    made = "### Assignment\n- **Name:** P\n- **Type:** manual\n- **Due Date:** (user-added)\n- **Due Date Resolved:** UNRESOLVED\n- **Weight:** not specified\n- **Confidence:** 5\n- **User notes:** by $hand\n\n### Assignment\n- **Name:** Q\n- **Type:** exam\n- **Due Date:** (user-added)\n- **Due Date Resolved:** 2026-02-02\n- **Weight:** not specified\n- **Confidence:** 5\n"
    assert rewritten(spark, "text\n\n", two) == "text\n\n" + made and rewritten(spark, "## Assignments\nx\n## Next\ny", two) == "## Assignments\nx\n" + made + "\n## Next\ny"
    assert rewritten(spark, None, two) is None and rewritten(spark, three, []) == three


def test_markdown_per_course(spark):
    s = spark.createDataFrame([("c", MARK), ("d", MARK)], "course_id string, summary string")
    rows = spark.createDataFrame([("c", 0, "One", None, None, None, True, False, False, [], [])], f"course_id string, pos int, title string, type string, due_date_resolved string, notes string, dismissed boolean, user_edited boolean, manual_add boolean, user_edited_fields array<string>, ai_original {EDITS}")
    got = {r.course_id: r.summary for r in overrides.apply_to_markdown(s, rows).collect()}
    assert "One" not in got["c"] and got["d"] == MARK


def test_overrides_block(spark):
    rows = spark.createDataFrame([("c", 0, "A", "exam", "2026-01-01", False, True, False, [("due_date_resolved", "2025-01-01")]), ("z", 1, "B", None, None, True, False, False, []), ("c", 2, "C", "", None, False, False, True, []), ("c", 3, "D", "", None, False, False, False, [])], f"course_id string, pos int, title string, type string, due_date_resolved string, dismissed boolean, user_edited boolean, manual_add boolean, ai_original {EDITS}")
    c = spark.createDataFrame([("c", "Ethics")], "course_id string, course_name string")
    out = overrides.overrides_block(rows, c).first()[0]
    assert out.endswith('Course: Ethics\n- "A"\n    Due: 2026-01-01\n    Type: exam\n    Status: User-edited (original AI extraction was 2025-01-01)\n- "C"\n    Due: UNRESOLVED\n    Status: User-added manually\n\nCourse: z\n- "B"\n    Status: User dismissed (not a real deadline; ignore)\n')
    assert overrides.overrides_block(rows.where("title = 'D'"), c).count() == 0


def test_header_counts(spark):
    rows = [row(0), row(1, title="B", due="")]
    over = spark.createDataFrame([("c__essay__0", [], True, None, False), ("c__m__0", [], True, None, True)], OVERRIDE)
    a = spark.createDataFrame(rows, ASSIGNMENT)
    c = spark.createDataFrame([("c", "C")], "course_id string, course_name string")
    all_ = deadlines.aggregate(a, over, c, F.lit("2026-01-14").cast("date"), F.lit("2026-05-02").cast("date"))
    r = deadlines.header(all_, over).first()
    assert (r.course_count, r.total, r.resolved, r.needs_attention, r.dismissed, r.overrides_applied) == (1, 3, 0, 1, 2, 2)


def test_audit(spark):
    a = spark.createDataFrame([("c", 0, "Essay One Draft", "2026-01-01", ""), ("c", 1, "Essay one drafts", "Week 2", ""), ("c", 2, "Quiz 1", None, "x"), ("c", 3, "Quiz 2", "TBD", "x"), ("d", 4, "Same", "Oct 5", "x"), ("d", 5, "Same", "Oct 5", "x")], "course_id string, pos int, title string, due_date_raw string, due_date_resolved string")
    pairs = audit.duplicate_pairs(a)
    assert [(r.a, r.b) for r in pairs.orderBy("a").collect()] == [(0, 1), (4, 5)], "numbered series are no duplicates"
    hist = audit.histogram(audit.categorised(a))
    assert [(r.category, r.n) for r in hist.collect()] == [("iso_datetime", 0), ("iso_date", 1), ("date_string", 2), ("relative", 1), ("vague", 1), ("missing", 1)]
    gaps = audit.missing(a, ["title", "course_id", "due_date_raw"])
    assert {r.field: r.n for r in gaps.collect()} == {"title": 0, "course_id": 0, "due_date_raw": 1}
    v = audit.verdict_of(hist, gaps, audit.duplicate_total(a)).first()
    assert (v.total, v.parseable, v.gaps, v.duplicates, v.verdict) == (6, 3, 1, 2, "RED")
    assert [audit.verdict(10, 8, 0, 0), audit.verdict(10, 8, 1, 0), audit.verdict(10, 5, 0, 0), audit.verdict(0, 0, 0, 0)] == ["GREEN", "YELLOW", "RED", "RED"]
    courses = spark.createDataFrame([("c", False), ("e", False), ("f", True)], "course_id string, failed boolean")
    assert {r.course_id: (r.n, r.low) for r in audit.per_course(courses, a).collect()} == {"c": (4, True), "e": (0, True)}
