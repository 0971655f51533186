"""Scalar rules against values derived by hand."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrivium.functions import dates, extraction, html, markdown, similarity, text, vectors
from quadrivium.functions.chunking import chunk_documents, chunk_text, segments


@pytest.mark.parametrize("raw,want", [("", 2), ("0", 2), ("4 (syllabus)", 4), ("10", 1), (None, 2)])
def test_confidence(value, raw, want):
    assert value(dates.confidence, raw) == want


@pytest.mark.parametrize("raw,want", [("UNRESOLVED", None), ("2026-03-15T23:59:00", "2026-03-15T23:59"), ("by 2026-03-15", "2026-03-15"), ("March 15", None), ("  ", None), (None, None), ("2026-03-15 08:30", "2026-03-15 08:30")])
def test_resolved_date(value, raw, want):
    assert value(dates.resolved_date, raw) == want


@pytest.mark.parametrize("raw,want", [("  Essay #1: Draft_A ", "essay-1-draft-a"), ("!!!", "untitled"), ("Café  Über", "café-über"), ("--a--b--", "a-b")])
def test_slugify(value, raw, want):
    assert value(text.slugify, raw) == want


def test_ids(value):
    assert value(lambda c, t, i: text.item_id(c, t, i), "c1", "Quiz 1", 0) == "c1__quiz-1__0"
    assert value(text.course_of_id, "_62_1__quiz__0__x") == "_62_1"


@pytest.mark.parametrize("raw,want", [("N/A", "missing"), ("Week 7", "relative"), ("Oct 15", "date_string"), ("TBD", "vague"), ("Room 12", "relative"), ("", "missing"), (None, "missing"), ("2026-01-02", "iso_date"), ("2026-01-02T10:00", "iso_datetime"), ("3/4", "date_string"), ("sometime", "vague"), ("see syllabus", "vague")])
def test_date_category(value, raw, want):
    assert value(dates.date_category, raw) == want


def test_resolved_and_effective_category(value):
    assert [value(dates.resolved_category, x) for x in ("", "unresolved", "2026-01-01", "2026-01-01 10:00", "x")] == ["other", "unresolved", "iso_date", "iso_datetime", "other"]
    assert value(dates.effective_category, "Week 2", "2026-01-01") == "iso_date"
    assert value(dates.effective_category, "Week 2", "UNRESOLVED") == "relative"
    assert value(dates.has_time, "at 9:30 pm", "relative") is True
    assert value(dates.has_time, None, "missing") is False


@pytest.mark.parametrize("raw,want", [("Due: Jan 5, 2026", "2026-01-05"), ("January 5, 2026 11:59 PM", "2026-01-05"), ("1/21/26", "2026-01-21"), ("1/21/2026", "2026-01-21"), ("2026-01-02", "2026-01-02"), ("soon", None)])
def test_parse_due(value, raw, want):
    assert value(dates.parse_due, raw) == want


def test_small_dates(value):
    assert value(dates.leading_date, "2026-01-02T00:00Z") == "2026-01-02"
    assert value(dates.leading_date, "on 2026-01-02") is None
    assert value(dates.due_in_note, "Due date: 1/21/26") == "1/21/26"
    assert str(value(lambda s, w: dates.week_day(s.cast("date"), w), "2026-01-14", 3)) == "2026-01-28"
    assert value(lambda c: dates.rubric(c, F.lit(True)), "iso_date") == 5
    assert value(lambda c: dates.rubric(c, F.lit(False)), "relative") == 3


@pytest.mark.parametrize("due,out", [("2026-01-07", False), ("2026-01-06", True), ("2026-06-01", False), ("2026-06-02T10:00", True), ("2026-99-99", False), (None, False)])
def test_window_bounds(value, due, out):
    assert value(lambda d: dates.outside_window(d, F.lit("2026-01-14").cast("date"), F.lit("2026-05-02").cast("date")), due) is out


def test_window_disabled_without_term(value):
    assert value(lambda d: dates.outside_window(d, F.lit(None).cast("date"), F.lit(None).cast("date")), "1990-01-01") is False


def test_titles(value):
    assert value(text.normalize_chapter, "chapter 7 slides") == "ch7 slides"
    assert value(text.normalize_chapter, "ch 7") == "ch7"
    assert value(text.auto_title, "a" * 51) == "a" * 49 + "…"
    assert value(text.auto_title, " a\r\nb ") == "a b"
    assert value(text.renamed_title, "b" * 60) == "b" * 50
    assert value(text.short_label, "Spring 2026 Ethics in Business (PHIL 2)") == "Ethics in Business"
    assert value(lambda x: text.short_label(x, 6), "Spring 2026 Ethics in Business") == "Ethics"
    assert value(text.without_numbers, "Lab #3: Week 4 essay 12 Draft #2") == ": draft"
    assert value(text.snippet, "x" * 501) == "x" * 500 + "…"
    assert value(text.snippet, "x" * 500) == "x" * 500


@pytest.mark.parametrize("question,title,want", [("what is in chapter 7 slides", "Ch 7 Slides", True), ("ethics essay outline due", "Essay Outline for Ethics", True), ("ethics", "Essay Outline", False), ("essay", "essay on the a", True), ("weekly plan", "plan b of weekly notes", True)])
def test_titles_match(value, question, title, want):
    assert value(text.titles_match, question, title) is want


def test_urls_and_files(value):
    assert value(lambda h, c: text.absolute_url(h, "https://x.org", c), "/a", "u") == "https://x.org/a"
    assert value(lambda h, c: text.absolute_url(h, "https://x.org", c), "", "u") == "u"
    assert value(text.course_id_of_href, "/ultra/courses/_62_1/cl/outline") == "_62_1"
    assert value(text.course_id_of_href, "/x") is None
    assert value(text.mime_base, " Text/Plain ; charset=utf-8") == "text/plain"
    assert [value(text.extension, x) for x in ("a/b.PDF", "noext", ".bashrc", "x.tar.gz")] == [".pdf", "", "", ".gz"]


def test_display(value):
    assert value(text.percent, 1, 3) == "33.3%"
    assert value(text.percent, 0, 0) == "0.0%"
    assert value(text.shown_time, "2026-01-02T03:04:05.678+00:00") == "2026-01-02 03:04:05"
    assert value(text.shown_money, 1.5) == "1.5000"
    assert value(text.shown_count, 1234567) == "1,234,567"
    assert value(text.without_colours, "\x1b[31mred\x1b[0m") == "red"
    assert value(text.log_fields, "event=chat id=3") == {"event": "chat", "id": "3"}
    assert value(text.shown_id, "x" * 20) == "x" * 16


@pytest.mark.parametrize("reply,want", [('["c1","zz"]', ["c1"]), ("[]", ["c1", "c2"]), ('```json\n["c1"]\n```', ["c1", "c2"]), ("nonsense", ["c1", "c2"]), ('["c2","c2","c1"]', ["c2", "c2", "c1"])])
def test_routed(value, reply, want):
    assert value(lambda r: text.routed(r, F.array(F.lit("c1"), F.lit("c2"))), reply) == want


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0], [], [1.0, None])], "a array<double>, b array<double>, z array<double>, e array<double>, n array<double>")
    got = row.select(vectors.cosine("a", "b"), vectors.usable("a"), vectors.usable("z"), vectors.usable("e"), vectors.usable("n")).first()
    assert got[0] == pytest.approx(0.96) and got[1:] == (True, False, False, False)
    with pytest.raises(ValueError):
        vectors.unit([0.0, 0.0])


def test_chunks_by_hand():
    assert chunk_text(None) == [] and chunk_text("  \n ") == []
    assert chunk_text("ten chars!") == ["ten chars!"]
    hard = chunk_text("x" * 3000)
    assert [len(c) for c in hard] == [1500, 1700]
    assert chunk_text("a" * 1000 + "\n\n" + "b" * 1000)[1] == "a" * 198 + "\n\n" + "b" * 1000


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=400), st.integers(5, 60))
def test_chunk_properties(body, limit):
    parts = list(segments(body, limit))
    assert "".join(parts) == body and all(len(p) <= limit for p in parts)
    assert all(len(c) <= limit + 4 for c in chunk_text(body, limit, 4))


def test_chunk_documents(spark):
    d = spark.createDataFrame([("a", "x" * 3000), ("b", None), ("c", " ")], "id string, extracted_text string")
    assert [(r[0], r[1], len(r[2])) for r in chunk_documents(d).orderBy("document_id", "chunk_index").collect()] == [("a", 0, 1500), ("a", 1, 1700)]


def test_similarity(spark):
    rows = spark.createDataFrame([("Midterm Exam", "midterm exams"), ("abc", "xyz")], "a string, b string")
    got = rows.select(similarity.similarity("a", "b"), similarity.may_reach("a", "b"), similarity.edit_similarity("a", "b")).collect()
    assert got[0][0] == pytest.approx(96.0) and got[0][1] is True and got[1][0] == 0.0 and got[1][2] == 0.0


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=12), st.text(max_size=12))
def test_length_bound_is_safe(a, b):
    x, y = len(a.lower()), len(b.lower())
    assert not similarity.ratio(a, b) >= 85 or 200.0 * min(x, y) >= 85 * (x + y)


def test_html():
    page = "<html><head><title>t</title><style>x{}</style></head><body><p>One &amp; two</p><script>var a='<p>';</script><div>three<br>four</div></body></html>"
    assert html.visible_text(page) == "One & two\nthree\nfour" and html.visible_text(None) is None


def test_extraction_rules(spark, value):
    assert value(extraction.handler, "a.PDF", "text/plain") == "pdf" and value(extraction.handler, "x", "Text/Plain; a=b") == "plain" and value(extraction.handler, "x.bin", None) is None
    assert value(extraction.native_or_vision, "x " * 20)["method"] == "needs_vision" and value(extraction.native_or_vision, "x " * 21)["method"] == "native_text"
    assert extraction.plain_text(b"caf\xe9 ") == "café" and extraction.plain_text(b"  ") is None
    assert value(extraction.upload_errors, "../a.pdf", 5) == "bad_name" and value(extraction.upload_errors, "a.exe", 5) == "unsupported_type" and value(extraction.upload_errors, "a.pdf", 21 * 2**20) == "too_large" and value(extraction.upload_errors, "a.pdf", 20 * 2**20) is None
    files = spark.createDataFrame([("a.txt", None, bytearray(b" hi ")), ("b.png", None, bytearray(b"\x89"))], "name string, mime string, content binary")
    got = {r["name"]: tuple(r["extracted"]) for r in extraction.extract_files(files).collect()}
    assert got == {"a.txt": ("hi", "native_text", 5), "b.png": (None, "needs_vision", 0)}
    got = {r["name"]: tuple(r["extracted"]) for r in extraction.extract_files(files, lambda data: "seen").collect()}
    assert got["b.png"] == ("seen", "vision_ocr", 4)


SUMMARY = """Intro
## 1. ASSIGNMENTS
### Assignment
- **Name:** Essay 1
- **Type:** essay
- **Due Date:** Week 7
- **Due Date Resolved:** 2026-02-25
- **Weight:** not mentioned
- **Points:** 20
- **Confidence:** 3
---
### Quiz 2: Basics
- **Due:** none
- **Deadline:** `Oct 5`
  - see https://x.org/a
#### Notes
nothing
## 2. GRADING
- **Name:** not this
"""


def parsed(spark, summary):
    d = spark.createDataFrame([("c", "C", summary)], "course_id string, course_name string, summary string")
    return markdown.parse_assignments(d).orderBy("pos").collect()


def test_parse_assignments(spark):
    a, b = parsed(spark, SUMMARY)
    assert (a.title, a.assignment_type, a.due_date_raw, a.due_date_resolved, a.point_value) == ("Essay 1", "essay", "Week 7", "2026-02-25", "20")
    assert a.confidence == "3 ---", "the last field takes in what follows it in the block"
    assert (b.title, b.due_date_raw, b.source_link) == ("Basics", "Oct 5; see https://x.org/a", "https://x.org/a")


def test_parse_without_section_header_loses_the_first_block(spark):
    body = "### Assignment\n- **Name:** One\n### Assignment\n- **Name:** Two\n"
    assert [r.title for r in parsed(spark, body)] == ["Two"]


def test_parse_failed_and_null(spark):
    assert parsed(spark, "Pre-Processing FAILED: x\n" + SUMMARY) == [] and parsed(spark, None) == []
