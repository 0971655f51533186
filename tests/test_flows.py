"""Versions, resumable loads, the start-up graph, selected elements, blocked search: crashes, replays and brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quadrivium.functions import html, text
from quadrivium.operators import retrieval, startup, threads
from quadrivium.sources import readers, versions, writers
from quadrivium.streaming import loading

NOW = "2024-01-01"


def numbers(frame):
    return sorted(r[0] for r in frame.collect())


def test_a_crash_at_each_step_leaves_one_whole_version(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/store"
    rows = lambda n: spark.createDataFrame([(i,) for i in range(n)], "x int")
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path, "rows")
    assert versions.commit({"rows": rows(1), "head": rows(1)}, path) == 1
    boom = spark.range(3).select(F.raise_error(F.lit("boom")).cast("int").alias("x"))
    with pytest.raises(Exception, match="boom"):  # the first table is written, the second fails
        versions.commit({"rows": rows(5), "head": boom}, path)
    real = versions._point
    monkeypatch.setattr(versions, "_point", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):  # all is written, the pointer is not
        versions.commit({"rows": rows(5), "head": rows(5)}, path)
    monkeypatch.setattr(versions, "_point", real)
    assert numbers(versions.read(spark, path, "rows")) == numbers(versions.read(spark, path, "head")) == [0]
    (tmp_path / "store" / "_pointers" / "0000000002").write_text('{"folder": "v')  # the writer died in the pointer
    assert versions.current(spark, path)[0] == 1 and numbers(versions.read(spark, path, "rows")) == [0]
    assert versions.commit({"rows": rows(3), "head": rows(2)}, path, note={"a": "b"}) == 3
    assert len(numbers(versions.read(spark, path, "rows"))) == 3 and versions.note(spark, path) == {"a": "b"}


def test_two_writers(spark, tmp_path, monkeypatch):
    path, one = f"file://{tmp_path}/store", spark.createDataFrame([(1,)], "x int")
    n = versions.commit({"rows": one}, path)
    with pytest.raises(versions.Conflict):
        versions.commit({"rows": one}, path, made_from=n - 1)
    monkeypatch.setattr(versions, "_numbers", lambda *a: [])  # a writer that has not seen the other's commit
    with pytest.raises(versions.Conflict):
        versions.commit({"rows": one.withColumn("x", F.lit(9))}, path)
    monkeypatch.undo()
    assert numbers(versions.read(spark, path, "rows")) == [1] and len(list((tmp_path / "store").glob("v*"))) == 1
    for _ in range(3):
        versions.commit({"rows": one}, path)
    assert versions.vacuum(spark, path, keep=2) == 2 and numbers(versions.read(spark, path, "rows")) == [1]
    assert versions.vacuum(spark, path, keep=2) == 0


def test_stores_of_rows(spark, tmp_path):
    path = f"file://{tmp_path}"
    o = spark.createDataFrame([("a", [("title", "T")], False, "1", True)], "id string, edits array<struct<field: string, value: string>>, dismissed boolean, edited_at string, manual_add boolean")
    writers.write_overrides(o.limit(0), f"{path}/o", comment="hi")
    writers.write_overrides(o, f"{path}/o", comment=writers.read_comment(spark, f"{path}/o"))
    assert readers.overrides(spark, f"{path}/o").first().edits[0].value == "T" and writers.read_comment(spark, f"{path}/o") == "hi"
    s = spark.createDataFrame([(0, "c", "text"), (1, "d", None)], "pos int, course_id string, summary string")
    writers.write_store(s, f"{path}/s", "summaries")
    assert [r.course_id for r in readers.summaries(spark, f"{path}/s").collect()] == ["c"]
    assert readers.deadlines(spark, f"{path}/none") is None


def stream(spark, path):
    return spark.readStream.schema("page_id long, url string").option("maxFilesPerTrigger", 1).parquet(path)


def write(spark, rows, path):
    spark.createDataFrame(rows, "page_id long, url string").coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("step", ["rows", "keys", "mark"])
def test_kill_and_replay(spark, tmp_path, monkeypatch, step):
    """A load that dies in a batch is started again: nothing is lost or doubled, the first by order wins."""
    source, target, checkpoint = str(tmp_path / "in"), f"file://{tmp_path}/out", str(tmp_path / "cp")
    write(spark, [(5, "a"), (3, "a"), (4, "b"), (9, None), (8, None)], source)
    loading.load_new(stream(spark, source), target, checkpoint, order="page_id")
    write(spark, [(1, "a"), (7, "c"), (6, "c")], source)
    real, calls = loading._create, []

    def dies(s, path, said):
        if "/marks/" in path and not calls:
            calls.append(path)
            if step == "rows":  # half of the rows were written, and no keys
                (part,) = (tmp_path / "out" / "keys").glob(f"batch={said.strip()}")
                part.rename(tmp_path / "lost")
            if step == "mark":
                real(s, path, said)
            raise RuntimeError("killed")
        return real(s, path, said)

    monkeypatch.setattr(loading, "_create", dies)
    with pytest.raises(Exception, match="killed|foreachBatch|FOREACH"):
        loading.load_new(stream(spark, source), target, checkpoint, order="page_id")
    seen = {(r.page_id, r.url) for r in loading.loaded(spark, target).collect()}
    assert seen == {(3, "a"), (4, "b"), (8, None)} | ({(6, "c")} if step == "mark" else set()), "half a batch is not seen"
    for _ in range(2):
        loading.load_new(stream(spark, source), target, checkpoint, order="page_id")
    loading.load_new(stream(spark, source), target, str(tmp_path / "cp2"), order="page_id")  # another load of the same files
    got = [(r.page_id, r.url) for r in loading.loaded(spark, target).collect()]
    assert sorted(got, key=str) == sorted([(3, "a"), (4, "b"), (8, None), (6, "c")], key=str)


def test_refresh_rebuilds_what_is_stale(spark, tmp_path):
    source, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/stores"
    data = lambda: spark.read.schema("x long").parquet(source)
    spark.range(3).select(F.col("id").alias("x")).write.parquet(source)
    fails = []

    def last(t):
        if fails:
            raise RuntimeError("model")
        return t["mid"].agg(F.sum("x").alias("s"))

    stores = [startup.Store("last", ("mid",), last), startup.Store("mid", ("in",), lambda t: t["in"]), startup.Store("other", (), lambda t: spark.range(1))]
    run = lambda: {name: (rebuilt, reason) for name, rebuilt, reason, _ in startup.refresh(spark, folder, {"in": (source, data())}, stores)}
    assert run() == {"mid": (True, "missing"), "last": (True, "missing"), "other": (True, "missing")}
    assert {r for r, _ in run().values()} == {False}
    spark.range(5).select(F.col("id").alias("x")).write.mode("append").parquet(source)
    fails.append(1)
    with pytest.raises(RuntimeError):
        run()
    assert startup.store(spark, folder, "last").first().s == 3, "the version before stays"
    fails.clear()
    assert run() == {"mid": (False, "fresh"), "last": (True, "changed: mid"), "other": (False, "fresh")}
    assert startup.store(spark, folder, "last").first().s == 13
    with pytest.raises(ValueError, match="no store"):
        startup.refresh(spark, folder, {}, [startup.Store("a", ("zz",), last)])
    built = []
    for _ in range(2):
        out = startup.load_or_build(spark, f"{folder}2", "cache", source, data(), lambda df: built.append(1) or df)
        assert out.count() == 8
    assert built == [1]


def test_search_many_against_all(spark):
    rng = random.Random(1)
    vec = lambda: [rng.choice([-1.0, 0.5, 2.0]) for _ in range(3)]  # noqa: E731  many equal scores
    chunks = [(i, vec()) for i in range(200)] + [(300, None), (301, [0.0] * 3), (302, [])]
    queries = [(f"q{i}", vec()) for i in range(23)] + [("none", None), ("zero", [0.0] * 3)]
    c, q = spark.createDataFrame(chunks, "id int, embedding array<double>").repartition(3), spark.createDataFrame(queries, "query_id string, query array<double>").repartition(2)
    got = {}
    for r in retrieval.search_many(c, q, 4, rows=7, query_rows=5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.id, round(r.score, 9))
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    for name, v in queries[:23]:
        scored = sorted((-round(sum(a * b for a, b in zip(v, w)) / norm(v) / norm(w), 12), i) for i, w in chunks[:200])[:4]
        assert [got[name][k + 1] for k in range(4)] == [(i, round(-s, 9)) for s, i in scored]
    assert len(got) == 23 and retrieval.search_many(c, q.limit(0)).collect() == [] and retrieval.search_many(c.limit(0), q).collect() == []
    with pytest.raises(Exception, match="dimensions"):
        retrieval.search_many(c, spark.createDataFrame([("q", [1.0])], "query_id string, query array<double>")).collect()


PAGE = '<div class="a textLayer">One <b>two</b><div class="textLayer">in</div></div><p class="textLayerX">no</p><span CLASS="react-pdf_Page__textContent">&amp; three<br>four</span></i>'
TASK = '<div><span class="js-due-date"> Due 1 </span><p class="js-due-date">again</p><div class="ql-editor bb-editor" contenteditable="false">Body<script>x</script></div><div class="overview-attempts-section">  </div></div>'


def test_selected_elements(spark):
    assert html.selected(PAGE, html.TEXT_LAYERS) == ["One twoin", "in", "& threefour"] and html.layered("<p>x</p>") is None
    assert html.parts(TASK) == "Due 1\nBodyx" and html.selected(TASK, html.TOPIC) == ["Bodyx"] and html.parts("") is None and html.parts(None) is None
    assert html.selected('<a href="x">1</a><a href="y" id=k>2</a><a>3</a>', 'a[href], #k') == ["1", "2"] and html.selected("<p>open", "p") == ["open"] and html.selected(None, "p") is None
    for bad in ("div p", "", "a,,b", "a:hover"):
        with pytest.raises(ValueError):
            html.selector(bad)
    rows = spark.createDataFrame([(PAGE, "file"), (TASK, "assessment"), (TASK, "discussion"), ("<p>x</p>", "document"), (None, "file"), ("<p>x</p>", "file"), (None, None)], "h string, k string")
    assert [r.t for r in rows.select(html.item_text("h", "k").alias("t")).collect()] == ["One twoin\n\nin\n\n& threefour", "Due 1\nBodyx", "Bodyx", "x", None, None, None]


CUT = '<h1>a &amp;&amp;&lt;&amp</h1><li>&am</li><li>&quot &#39; &#39</li><li data-x="p&amp;q&r">&ampx; &amp;lt; &nosuch; &eacute; \ue000&</li><script>if (a &amp b) {}</script>'


def test_references_cut_short(spark):
    """As a browser reads them, or with only those that end in a semicolon."""
    assert html.selected(CUT, "h1") == ["a &&<&"] and html.selected(CUT, "h1", closed=True) == ["a &&<&amp"]
    assert html.selected(CUT, "li", closed=True) == ["&am", "&quot ' &#39", "&ampx; &lt; &nosuch; é \ue000&"]
    assert html.selected(CUT, '[data-x="p&q&r"]', closed=True) == html.selected(CUT, "li", closed=True)[2:] and html.selected(CUT, "script", closed=True) == ["if (a &amp b) {}"]
    assert html.visible_text("<p>x &lt;&amp</p>", closed=True) == "x <&amp" and html.visible_text("<p>x &lt;&amp</p>") == "x <&"


@pytest.mark.parametrize("query", ["pages_selected", "pages_by_kind"])
def test_pages_with_cut_headings(spark, tmp_path, query):
    """Headings cut in a reference at every place, as in larger tables, against the queries' SQL."""
    import duckdb

    from quadrivium.plans import registry

    heads = [t[:n] for t in ("Für&amp;&lt;x&gt;", "&quot;a&#39; &amp;amp;") for n in range(1, len(t) + 1)]
    rows = [(i, "u", f'<title>{h}</title><div class="ad">{h} ad</div><article><h1>{h}</h1><ul><li>{h}</li><li>b</li></ul></article>') for i, h in enumerate(h for h in heads for _ in range(4))]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    found = registry.QUERIES[query](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert sorted(map(tuple, found)) == sorted(con.execute(registry.SQL[query]).fetchall())


def test_strip_is_linear(spark):
    import time

    inner = "a" + " " * 2_000_000 + "b"
    frame = spark.createDataFrame([(f" \t {inner} \r\n",)], "x string").cache()
    frame.count()
    start = time.time()
    assert frame.select(text.strip("x").alias("x")).first().x == inner and time.time() - start < 5
    blanks = "".join(chr(c) for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F)
    assert set(text.BLANKS) == set(blanks)


def test_message_log(spark, tmp_path):
    heads = spark.createDataFrame([("t", "New chat", "0"), ("u", "New chat", "0")], "id string, title string, updated_at string").withColumn("messages", F.lit(None).cast("array<struct<role: string, content: string, timestamp: string, attachments: array<struct<doc_id: string, name: string>>>>"))
    new = spark.createDataFrame([("t", 1, "assistant", "second", [("d", "n")]), ("t", 0, "user", "first words", [("d", "n")]), ("zz", 0, "user", "x", [])], "thread_id string, seq int, role string, content string, attachments array<struct<doc_id: string, name: string>>")
    schema = "thread_id string, at string, seq long, role string, content string, attachments array<struct<doc_id: string, name: string>>, bucket int"
    heads, rows = threads.append_log(heads, spark.createDataFrame([], schema), new, "1")
    path = str(tmp_path / "log")
    threads.write_log(rows, path)
    log = spark.read.schema(schema).parquet(path)
    assert {(r.id, r.title, r.updated_at) for r in heads.collect()} == {("t", "first words", "1"), ("u", "New chat", "0")}
    heads, rows = threads.append_log(heads, log, new.where("seq = 0").withColumn("content", F.lit("later")), "2")
    threads.write_log(rows, path)
    log = spark.read.schema(schema).parquet(path)
    assert [(r.content, r.attachments and r.attachments[0].doc_id) for r in threads.of_thread(log, "t").collect()] == [("first words", "d"), ("second", None), ("later", "d")]
    out = {r.id: r for r in threads.exported(heads, log).collect()}
    assert out["t"].title == "first words" and [m.content for m in out["t"].messages] == ["first words", "second", "later"] and out["u"].messages is None
    same, none = threads.append_log(heads, log, new, "3", memory_enabled=False)
    assert none.count() == 0 and same is heads
