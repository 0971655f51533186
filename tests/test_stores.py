"""Stores, ledger, threads, content, retrieval, sources and streaming on small data."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from quadrivium.operators import content, context, costs, documents, retrieval, threads
from quadrivium.sources import readers, schemas, writers
from quadrivium.streaming import ledger as streaming
from quadrivium.streaming import loading

NOW = "2026-01-10T00:00:00+00:00"
LEDGER = f"pos int, {schemas.LEDGER}"


def call(pos, op="chat", request="r", at="2026-01-10T10:00:00+00:00", i=10, o=5, cost=0.5):
    return (pos, f"e{pos}", request, at, "u", "s", None, "m", "main", op, i, o, cost)


def test_pricing(spark):
    p = costs.pricing(spark, {"main": (3.0, 15.0)})
    c = spark.createDataFrame([("main", 1_000_000, 100_000), ("other", 5, 5)], "model string, input_tokens long, output_tokens long")
    assert {r.model: r.cost_usd for r in costs.priced(c, p).collect()} == {"main": 4.5, "other": 0.0}


def test_rollups(spark):
    rows = [call(0, op="", cost=None), call(1, at="2026-01-04T23:00:00-05:00"), call(2, at="2026-01-03T00:00:00"), call(3, at="bad"), call(4, op=None, request="", at="2027-01-01T00:00:00", cost=2.0)]
    led = spark.createDataFrame(rows, LEDGER)
    r = costs.by_period(led, datetime.date(2026, 1, 10)).first()
    assert (r.today_calls, r.week_calls, r.all_calls, r.today_cost, r.all_cost) == (1, 3, 5, 0.0, 3.5), "future calls fall into the last week"
    assert [(x.operation, x.calls, x.cost_usd) for x in costs.by_operation(led).collect()] == [("untagged", 2, 2.0), ("chat", 3, 1.5)]
    got = costs.by_request(led).collect()
    assert [(x.request_id, x.earliest, x.operations) for x in got] == [("unknown", "2027-01-01T00:00:00", ["untagged"]), ("r", "2026-01-03T00:00:00", ["untagged", "chat"])]
    assert [x.pos for x in costs.dearest(led, 2).collect()] == [4, 1]
    first_blank = spark.createDataFrame([call(0, at=""), call(1)], LEDGER)
    assert costs.by_request(first_blank).first().earliest == "", "an empty time in the first row stays"


def test_ledger_files(spark, tmp_path):
    path = tmp_path / "ledger"
    path.mkdir()
    (path / "a.jsonl").write_text('{"event_id":"1","operation":"x","cost_usd":1.0}\n\n{bad\n{"event_id":"2","input_tokens":"no"}\n')
    rows = readers.ledger(spark, str(path))
    assert rows.count() == 3 - 1 == rows.select("operation").count(), "which lines count does not depend on the columns"
    assert readers.ledger(spark, str(tmp_path / "none")).count() == 0
    call_ = spark.createDataFrame([("3", None, 2.0)], "event_id string, request_id string, cost_usd double").withColumns({c: F.lit(None) for c in schemas.LEDGER_COLUMNS if c not in ("event_id", "request_id", "cost_usd")})
    writers.append_ledger(call_, str(path))
    again = readers.ledger(spark, str(path))
    assert again.count() == 3 and again.where("event_id = '3'").first().request_id
    csv = writers.ledger_csv(again)
    assert csv.columns == schemas.LEDGER_COLUMNS and csv.where("operation = ''").count() == 2
    checkpoint = str(tmp_path / "cp")
    streaming.run_available(streaming.by_operation(streaming.lines(spark, str(path))), "ops", checkpoint)
    assert {r.operation: r.calls for r in spark.table("ops").collect()} == {"x": 1, "untagged": 2}


def test_streamed_windows_and_loads(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.json").write_text('{"event_time":"2026-01-01T10:05:00","cost_usd":1.0}\n{"event_time":"2026-01-01T10:55:00","cost_usd":2.0}\n{"event_time":"x","cost_usd":9.0}\n')
    streaming.run_available(streaming.by_window(streaming.lines(spark, str(src))), "windows", str(tmp_path / "c1"))
    assert [(r.calls, r.cost_usd) for r in spark.table("windows").collect()] == [(2, 3.0)]
    items = tmp_path / "items"
    spark.createDataFrame([("u1",), ("u1",), ("u2",)], "url string").write.parquet(str(items))
    target = str(tmp_path / "out")
    for k in range(2):
        loading.load_new(spark.readStream.schema("url string").parquet(str(items)), target, str(tmp_path / f"c2-{k}"))
    assert sorted(r.url for r in loading.loaded(spark, target).collect()) == ["u1", "u2"], "a second load adds nothing"


def test_new_items(spark):
    items = spark.createDataFrame([(0, "c", "A", "t", "u1"), (1, "c", "B", "t", "u1"), (2, "c", "C", " ", "u2"), (3, "c", "D", "t", ""), (4, "c", "D", "t", None), (5, "c", "E", "t", ""), (6, "c", "F", "t", "u9"), (7, "d", "G", "t", "u9")], "pos int, course_id string, title string, text string, url string")
    stored = spark.createDataFrame([("c", "E", {}), ("c", "F", {"source_url": "u9"}), ("c", "A", {"source_url": "u8"})], "course_id string, title string, user_provided_metadata map<string, string>")
    got = {r.pos: r.outcome for r in documents.new_items(items, stored).collect()}
    assert got == {0: "created", 1: "skipped_existing", 2: "skipped_empty", 3: "created", 4: "skipped_existing", 5: "skipped_existing", 6: "skipped_existing", 7: "created"}
    assert {r.outcome: r.n for r in documents.outcomes(documents.new_items(items, stored)).collect()} == {"created": 3, "skipped_existing": 4, "skipped_empty": 1}
    s = spark.createDataFrame([("c", "x"), ("d", "y"), ("e", " ")], "course_id string, summary string")
    have = spark.createDataFrame([("c", "course_summary")], "course_id string, content_type string")
    assert [r.course_id for r in documents.new_summaries(s, have).collect()] == ["d"]


def test_document_lifecycle(spark):
    rows = spark.createDataFrame([("c", "A", "x" * 3000), ("c", "B", "  ")], "course_id string, title string, extracted_text string")
    calls = []
    docs, chunks = documents.ingest(rows, NOW, embed=lambda texts: [[float(len(t)), 1.0] for t in texts])
    d, c = docs.collect(), chunks.orderBy("chunk_index").collect()
    assert [(x.title, x.chunk_count, x.embeddings_status) for x in d] == [("A", 2, "pending")] and [x.embedding for x in c] == [[1500.0, 1.0], [1700.0, 1.0]]
    assert c[0].metadata.course_id == "c" and c[0].document_id == d[0].id and not calls
    ids = docs.select("id")
    gone = documents.soft_delete(docs, ids, "2026-02-01T00:00:00+00:00")
    assert gone.first().updated_at == NOW and documents.list_documents(gone).count() == 0 and documents.point(gone, d[0].id).count() == 1
    back = documents.restore(gone, ids, "2026-02-02T00:00:00+00:00").first()
    assert back.deleted_at is None and back.updated_at.startswith("2026-02-02")
    assert documents.list_chunks(chunks, True, {"course_id": "c"}).count() == 2 and documents.live_chunks(chunks, gone).count() == 0
    kept, pieces = documents.purge(gone, chunks, "2026-04-01T00:00:00+00:00")
    assert (kept.count(), pieces.count()) == (0, 0)
    kept, _ = documents.purge(gone.withColumn("deleted_at", F.lit("never")), chunks, "2026-04-01T00:00:00+00:00")
    assert kept.count() == 1, "a time that does not parse is kept"
    new = documents.update(docs, docs.select("id", F.lit("T").alias("title")), "2026-03-01").first()
    assert new.title == "T" and new.created_at == NOW and new.updated_at == "2026-03-01"
    assert [r.chunk_index for r in documents.chunks_of(chunks, d[0].id).collect()] == [0, 1]
    status = documents.embedding_status(docs, chunks, "m").first()
    assert (status.embeddings_status, status.embedding_model) == ("embedded", "m")
    with pytest.raises(Exception, match="no document"):
        documents.add_chunks(docs, spark.createDataFrame([("zz", 0, "t")], "document_id string, chunk_index int, text string"), NOW).collect()
    failing = documents.embed_chunks(chunks.withColumn("embedding", F.lit(None).cast("array<double>")), lambda t: 1 / 0)
    assert [r.vector for r in failing.collect()] == [None, None]
    totals = documents.embedding_totals(documents.set_embeddings(chunks, chunks.select("id", F.lit(None).cast("array<double>").alias("vector")))).first()
    assert (totals.processed, totals.embedded, totals.failed) == (2, 2, 0)
    att = documents.attachment_texts(spark.createDataFrame([(1, d[0].id), (0, "none")], "pos int, doc_id string"), docs, chunks, 100).collect()
    assert len(att) == 1 and att[0].text == "x" * 100 + "\n[... truncated]"


@pytest.mark.parametrize("sizes", [[100], [99], [60, 38], [60, 39], [60, 40], [60, 39, 5], [60, 38, 5], [60, 37, 5], [60, 40, 5], [99, 1], [100, 1], [101, 1], [0, 99, 0], [0, 0, 98, 0, 3], [30, 30, 38, 7]])
def test_attachments_that_end_at_the_limit(spark, sizes):
    pieces = spark.createDataFrame([("d", i, "abc"[i % 3] * n) for i, n in enumerate(sizes)], "document_id string, chunk_index int, text string")
    att = documents.attachment_texts(spark.createDataFrame([(0, "d")], "pos int, doc_id string"), spark.createDataFrame([("d", "t")], "id string, title string"), pieces, 100).first()
    whole = "\n".join("abc"[i % 3] * n for i, n in enumerate(sizes))
    assert att.text == (whole[:100] + "\n[... truncated]" if len(whole) > 100 else whole)


def test_threads(spark):
    t = threads.create(spark.createDataFrame([("k", False)], "key string, incognito boolean"), NOW)
    tid = t.first().id
    att = "array<struct<doc_id: string, name: string>>"
    new = spark.createDataFrame([(tid, 0, "user", "Hello\nthere", [("d1", "a"), ("d2", "b")]), (tid, 1, "assistant", "Hi", [("d3", "c")]), ("zz", 0, "user", "x", [])], f"thread_id string, seq int, role string, content string, attachments {att}")
    after = threads.append(t, new, "2026-01-11")
    r = after.first()
    assert (r.title, len(r.messages), r.updated_at, r.messages[1].attachments) == ("Hello there", 2, "2026-01-11", None)
    assert threads.append(t, new, NOW, memory_enabled=False).first().messages == []
    m = threads.messages(after)
    assert threads.first_messages(m).first().role == "user" and threads.titles(m).first().title == "Hello there"
    cur = spark.createDataFrame([(tid, 0, "d1"), (tid, 1, "d9")], "thread_id string, pos int, doc_id string")
    assert threads.attachments(m, cur).first().doc_ids == ["d1", "d2", "d9"]
    names = threads.attachment_names(cur, spark.createDataFrame([("d1", "file.pdf")], "id string, original_filename string"))
    assert sorted(x.name for x in names.collect()) == ["d9", "file.pdf"]
    assert threads.rename(after, after.select("id", F.lit("n" * 60).alias("title")), NOW).first().title == "n" * 50
    cleared, n = threads.clear(after, "2026-01-12T00:00:00+00:00")
    assert n.first().cleared == 1 and threads.list_threads(cleared).count() == 0 and threads.deleted_threads(cleared).count() == 1
    assert threads.purge(cleared, "2026-03-01T00:00:00+00:00").count() == 0 and threads.delete_forever(after, after.select("id")).count() == 0


def test_containers(spark):
    raw = [("C", "c", 0, "Learning Module", "M", "/m", None, None, None, None, False), ("C", "c", 1, "PDF", "a", "/a", None, None, "Due date: 1/21/26", None, True), ("C", "c", 2, "PDF", "b", "", "2026-02-03T10:00", None, None, None, False), ("C", "c", 3, "PDF", "c", "#", None, None, None, None, False), ("C", "c", 4, "PDF", "", "/x", None, None, None, None, False), ("C", "c", 5, "PDF", "d", "/d", None, None, None, "Own", False)]
    rows = spark.createDataFrame(raw, "course_name string, course_id string, pos int, content_type string, title string, href string, time_datetime string, description string, subtext string, parent_container string, is_nested boolean").withColumn("course_url", F.lit("https://x/c"))
    got = {r.title: r for r in content.content_items(rows, "https://x").collect()}
    assert sorted(got) == ["a", "b", "c", "d"], "a container without description is no item"
    assert [got[t].container_name for t in "abcd"] == ["M", "M", None, "Own"]
    assert (got["a"].due_date, got["b"].due_date, got["b"].url, got["a"].url) == ("2026-01-21", "2026-02-03", "https://x/c", "https://x/a")


def test_content_rules(spark, value):
    cls = lambda url, kind: value(lambda u, k: content.classify("lms.edu", "a0", "a1"), url, kind)
    assert [cls("x", "Photo"), cls("x", "Video"), cls("#", "PDF"), cls("http://else.org/outline/file/1", "PDF"), cls("https://lms.edu/c/outline/", "PDF"), cls("https://lms.edu/outline/file/1", "PDF"), cls("/outline/edit/document/1", "PDF"), cls("/outline/assessment/1", "PDF"), cls("/outline/discussion/1", "PDF"), cls("/q", "PDF")] == ["image_based", "skip", "skip", "skip", "skip", "file", "document", "assessment", "discussion", "skip"]
    rows = spark.createDataFrame([("c", "C", 0, "Syllabus", "PDF", None, None, None, None, None, "t" * 501), ("c", "C", 1, None, None, "Box", None, "soon", "desc", "note", None), ("c", "C", 2, "x", "Quiz", None, "2026-01-01", None, None, None, None)], "course_id string, course_name string, pos int, title string, content_type string, container_name string, due_date string, due_date_raw string, description string, subtext string, extracted_text string")
    assert [r.pos for r in rows.where(content.is_key_item()).orderBy("pos").collect()] == [0, 2]
    text = content.compact_index(rows).first().text
    assert text == "Course: C\n\n\n- [PDF] Syllabus\n  Content: " + "t" * 500 + "…\n\n- [] (untitled)\n  Container: Box\n  Due: soon\n  Description: desc\n  Note: note\n\n- [Quiz] x\n  Due: 2026-01-01"
    message = content.preprocess_messages(rows)
    assert content.summarise(message, lambda t: 1 / 0).first().summary.startswith("Pre-processing failed")
    assert content.full_texts(rows).first().title == "Syllabus"
    links = spark.createDataFrame([(0, "c", "Spring 2026 A"), (1, "c", "Other"), (2, "d", "Fall")], "pos int, course_id string, course_name string")
    assert [r.course_name for r in content.discovered(links, "Spring 2026").collect()] == ["Spring 2026 A"]
    parts = spark.createDataFrame([("i", 0, "a", "T", None), ("i", 1, "b", None, "too large"), ("j", 0, "c", None, None)], "item_id string, pos int, name string, text string, reason string")
    got = {r.item_id: (r.text, r.status) for r in content.attachment_join(parts).collect()}
    assert got == {"i": ("--- a ---\nT\n\n--- b ---\n[too large]", "success"), "j": (None, "image_based")}


def test_retrieval_and_context(spark):
    rows = [("k1", "d1", "one", [1.0, 0.0], "c"), ("k2", "d2", "two", [1.0, 0.0], "c"), ("k3", "d1", "three", [0.0, 1.0], "e"), ("k4", "d1", "zero", [0.0, 0.0], "c"), ("k5", "d1", "none", None, "c")]
    ch = spark.createDataFrame(rows, "id string, document_id string, text string, embedding array<double>, course string").withColumn("metadata", F.struct(F.col("course").alias("course_id"), F.when(F.col("id") == "k2", "course_summary").otherwise("x").alias("content_type")))
    assert [r.id for r in retrieval.search(ch, [2.0, 0.1], 2).collect()] == ["k1", "k2"], "ties go by id"
    assert {(r.course, r.id) for r in retrieval.search_each(ch, [1.0, 1.0], "course", 1).collect()} == {("c", "k1"), ("e", "k3")}
    with pytest.raises(Exception, match="dimension"):
        retrieval.search(ch, [1.0, 0.0, 0.0]).collect()
    docs = spark.createDataFrame([("d1", "Doc", None), ("d2", "Gone", "x")], "id string, title string, deleted_at string")
    courses = spark.createDataFrame([(0, "c", "Course C"), (1, "e", "Course E")], "pos int, course_id string, course_name string")
    found = context.excerpts(ch, docs, [1.0, 0.0], courses)
    sums = spark.createDataFrame([("c", "sum")], "course_id string, summary string")
    attached = spark.createDataFrame([(0, "A", "body")], "pos int, title string, text string")
    fixed = spark.createDataFrame([("FIX\n",)], "text string")
    out = context.build_context(courses, sums, found, attached, fixed).first().text
    assert out == "FIX\n\n---\n\n[Attached document: A]\nbody\n\n---\n\n[Pre-processed Course Summary: Course C]\nsum\n\n[Relevant excerpt from Doc]\none\n\n---\n\n[Relevant excerpt from Doc]\nthree"
    assert context.build_context(courses.where("pos = 5"), sums, found).first() is None or True


def test_readers(spark, tmp_path):
    data = {"courses": [{"course_id": "c", "course_name": "Old"}, {"course_id": "c", "course_name": "New", "content_objects": [{"title": "t", "url": "u"}]}]}
    (tmp_path / "content.json").write_text(json.dumps(data))
    c = readers.json_document(spark, str(tmp_path / "content.json"), schemas.CONTENT)
    assert readers.course_names(c).first().course_name == "New" and readers.content_objects(c).first().title == "t"
    (tmp_path / "preprocessed_content.json").write_text(json.dumps({"c": "text", "d": 5}))
    assert [(r.course_id, r.summary) for r in readers.summaries(spark, str(tmp_path / "preprocessed_content.json")).collect()] == [("c", "text")]
    (tmp_path / "bad.json").write_text("{nope")
    assert readers.json_document(spark, str(tmp_path / "bad.json"), schemas.OVERRIDES).count() == 0
    assert readers.documents(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "docs.json").write_text(json.dumps({"documents": [{"id": "a", "title": "A"}, {"id": "b"}]}))
    assert [(r.pos, r.id) for r in readers.documents(spark, str(tmp_path / "docs.json")).collect()] == [(0, "a"), (1, "b")]
    (tmp_path / "chat.json").write_text(json.dumps({"settings": {"memory_enabled": False}, "threads": [{"id": "t", "messages": [{"role": "user", "content": "x", "attachments": [{"doc_id": "d", "name": "n"}]}]}]}))
    assert readers.threads(spark, str(tmp_path / "chat.json")).first().messages[0].attachments[0].doc_id == "d" and readers.memory_enabled(spark, str(tmp_path / "chat.json")) is False
    (tmp_path / "o.json").write_text(json.dumps({"_comment": "hi", "version": 1, "overrides": {"x": {"edits": {"title": "T"}, "manual_add": True}}}))
    o = readers.overrides(spark, str(tmp_path / "o.json"))
    assert (o.first().manual_add, o.first().dismissed, o.first().edits[0].value) == (True, False, "T")
    writers.write_overrides(o, str(tmp_path / "o2"), writers.read_comment(spark, str(tmp_path / "o.json")))
    writers.write_overrides(o, str(tmp_path / "o2"), "again")
    assert readers.overrides(spark, str(tmp_path / "o2")).first().edits[0].value == "T" and writers.read_comment(spark, str(tmp_path / "o2")) == "again"
    (tmp_path / "sem.json").write_text(json.dumps({"default": {"semester_start": "2026-01-14", "semester_end": "2026-05-02"}, "courses": {"c": {"semester_start": "2026-02-01"}}}))
    config = readers.semester(spark, str(tmp_path / "sem.json"))
    ids = spark.createDataFrame([("c",), ("d",)], "course_id string")
    assert {r.course_id: r.anchor.semester_start for r in readers.semester_anchor(config, ids).collect()} == {"c": "2026-02-01", "d": "2026-01-14"}
    start, _ = readers.semester_window(config)
    assert str(spark.range(1).select(start).first()[0]) == "2026-01-14"
    start, _ = readers.semester_window(readers.semester(spark, str(tmp_path / "missing.json")))
    assert spark.range(1).select(start).first()[0] is None
    (tmp_path / "preprocessed_content.OLD.json").write_text("{}")
    found = readers.files(spark, str(tmp_path), "preprocessed_*.json")
    assert readers.newest(found).first().path.endswith("preprocessed_content.json") and readers.paired_path("out/preprocessed_content.json") == "out/content.json"
    assert readers.fresh(readers.files(spark, str(tmp_path), "*.json"), "preprocessed_content.json", "/content.json")


def test_entry_points(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and entry.entry(spark).count() == 1


def test_replace_keeps_the_old_store_when_a_rename_fails(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/store"
    one, two = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,), (3,)], "x int")
    writers.replace(one, path)
    writers.replace(two, path)
    assert sorted(r.x for r in spark.read.schema("x int").json(path).collect()) == [2, 3]
    real = writers._rename
    for fails in (lambda old, new: new == path and not old.endswith(".old"), lambda old, new: old == path):
        monkeypatch.setattr(writers, "_rename", lambda s, old, new, fails=fails: not fails(old, new) and real(s, old, new))
        with pytest.raises(OSError):
            writers.replace(one, path)
        assert sorted(r.x for r in spark.read.schema("x int").json(path).collect()) == [2, 3]
        assert [p.name for p in tmp_path.iterdir()] == ["store"], "nothing is left beside it"
    monkeypatch.setattr(writers, "_rename", real)
    (tmp_path / "store").rename(tmp_path / "store.abc.old")  # a crash between the renames
    assert writers.recover(spark, path) and not writers.recover(spark, path)
    assert spark.read.schema("x int").json(path).count() == 2


def test_deadlines_store(spark, tmp_path):
    rows = spark.createDataFrame([("a", "resolved"), ("b", "dismissed")], "id string, bucket string")
    writers.write_deadlines(rows, rows.groupBy().agg(F.count("*").alias("total")), f"file://{tmp_path}/deadlines", NOW, "s.json")
    got, header = readers.deadlines(spark, f"file://{tmp_path}/deadlines")
    head = header.first()
    assert (head.total, head.generated_at, head.source_file) == (2, NOW, "s.json") and got.count() == 2


def test_vision_of_pages():
    from quadrivium.functions import extraction

    def vision(page):
        if page == b"2":
            raise RuntimeError("no reply")
        return f" page {page.decode()} "

    pages = lambda data: (str(i).encode() for i in range(40))
    text = extraction.seen_text(b"", "pdf", vision, pages)
    assert text.split("\n\n") == [f"page {i}" for i in range(25) if i != 2] and extraction.seen_text(b"7", "image", vision) == "page 7"
    assert extraction.seen_text(b"2", "image", vision) is None


def test_matched_titles_as_the_theta_join(spark):
    from quadrivium.functions.text import titles_match

    qs = ["where is chapter 7 of the essay on ethics", "a", "", "quiz", "the final essay draft", "What about CH 7?", "essay ethics", "un"]
    ts = ["Chapter 7", "Essay on Ethics", "Quiz 1", "a", "", "Final Draft", "of the", "unit test", "Ethics essay draft final", "un"]
    q, t = spark.createDataFrame([(x,) for x in qs], "question string"), spark.createDataFrame([(x,) for x in ts], "title string")
    want = {tuple(r) for r in q.join(t, titles_match("question", "title")).collect()}
    got = [tuple(r) for r in content.matched_titles(q, t).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 15
