"""Sharding, WARC archives, chat formatting and the pipeline."""

import gzip
import heapq
import io
import json
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrivium.llm import chat_rotation, common, sharding, warc
from tests.llm.conftest import EDGES, corpus


# --- sharding ----------------------------------------------------------------------------------


def longest_first(sizes, shards):
    """One group after the other through a heap; the loads and the groups of every size in each shard."""
    heap, given = [(0, s) for s in range(shards)], Counter()
    for size in sorted(sizes, reverse=True):
        load, shard = heapq.heappop(heap)
        given[size, shard] += 1
        heapq.heappush(heap, (load + size, shard))
    return given


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 60)), max_size=12, unique_by=lambda x: x[0]), st.integers(1, 5))
def test_schedule_against_a_heap_of_groups(classes, shards):
    got = Counter()
    for size, up_to in sharding.schedule(sorted(classes, reverse=True), shards):
        for shard, (a, b) in enumerate(zip([0] + up_to, up_to)):
            got[size, shard] += b - a
    assert +got == longest_first([s for s, n in classes for _ in range(n)], shards)


def check_shards(rows, texts, shards):
    slots, home = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    for r in rows:
        home[(r.size, r.text_crc32)].add(r.shard)
    assert all(len(s) == 1 for s in home.values())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts)


def test_shards(spark, edges, nothing):
    texts = corpus(4, 300) + [(1000 + i, "hot " * 9) for i in range(150)]
    rows = sharding.lpt_shards(spark.createDataFrame(texts, "doc_id long, text string"), 4).collect()
    check_shards(rows, texts, 4)
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    groups = Counter()
    for _, t in texts:
        groups[t] += len(t.encode()) + 1
    want, held = [0] * 4, defaultdict(set)
    for (size, shard), n in longest_first(groups.values(), 4).items():
        want[shard] += size * n
    assert [load[s] for s in range(4)] == want, "the loads of longest-first over whole groups"
    names = dict(texts)
    for r in rows:
        held[names[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in held.values())
    check_shards(sharding.lpt_shards(edges).collect(), EDGES, 16)
    assert sharding.lpt_shards(nothing).count() == 0


def test_shard_files(spark, tmp_path):
    docs = spark.createDataFrame(corpus(5, 50), "doc_id long, text string")
    placed = sharding.lpt_shards(docs, 3)
    sharding.write_shards(docs, placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.shard, r.slot) for r in back.collect()) == sorted((r.doc_id, r.shard, r.slot) for r in placed.collect())


def test_ranks_in_ranges(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k) if k else None, int(o), i, int(v)) for i, (k, o, v) in enumerate(zip(np.minimum(rng.integers(0, 9, 400), 4), rng.integers(0, 20, 400), rng.integers(0, 50, 400)))]
    df = spark.createDataFrame(rows, "k long, o long, i long, v long")
    got = {r.i: (r["rank"], r.before) for r in common.ranked(df, ["k"], ["o", "i"], "test", total="v").collect()}
    for k in {r[0] for r in rows}:
        before = 0
        for n, (_, _, i, v) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: r[1:3])):
            assert got[i] == (n, before)
            before += v
    assert common.ranked(df.where("false"), ["k"], ["o", "i"], "none").count() == 0


# --- WARC --------------------------------------------------------------------------------------

PAGES = [(1, "http://a/", "<p>é</p>"), (2, "http://b/ x\r\ny", "<p>é</p>"), (3, None, None), (4, "http://c/", ""), (5, "http://d/", "z" * 300_000), (0, "http://e/", "last"), (None, "http://f/", "last"), (5, "http://d/", "z" * 300_000)]


def test_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("key", "first", "n", "refers_to")})
    got = warc.round_trip(pages, payloads=True).collect()
    assert Counter(r.page_id for r in got) == Counter(p[0] for p in PAGES)
    by = {r.page_id: r for r in got}
    assert [(k, by[k].record_type, by[k].refers_to) for k in (1, 2, 3, 4, 0, None)] == [(1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "revisit", 3), (0, "response", None), (None, "revisit", 0)]
    for i, url, html in PAGES:
        data = (html or "").encode()
        assert by[i].payload_bytes == len(data) and by[i].payload_digest == warc.digest(data)
        if by[i].record_type == "response":
            assert by[i].payload == data
    assert by[1].url == "http://a/" and by[2].url == "http://b/%20x%0D%0Ay" and by[3].url is None
    apart = warc.round_trip(pages.where("page_id < 5"), least_bytes=5).collect()
    assert {r.page_id: r.record_type for r in apart} == {0: "response", 1: "response", 2: "revisit", 3: "response", 4: "response"}
    assert warc.round_trip(pages.where("false")).count() == 0


@pytest.mark.parametrize("more", [[], [(None, None, "none")]])
def test_warc_keeps_large_ids(spark, more):
    """Ids that doubles cannot hold, with and without a null id in the batch."""
    big = 2**53
    rows = [(big + 1, "u", "same"), (big + 3, None, "same"), (big + 5, "u", "other"), (-(2**63), "u", ""), (2**63 - 1, "u", "")]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows + more, "page_id long, url string, html string").coalesce(1), payloads=True).collect()}
    assert set(got) == {r[0] for r in rows + more}
    assert got[big + 1].refers_to is None and got[big + 3].refers_to == big + 1 and got[2**63 - 1].refers_to == -(2**63)
    assert got[big + 5].payload == b"other" and got[big + 3].payload is None


def test_warc_reader_is_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "BATCH_BYTES", 1)
    monkeypatch.setattr(warc, "CHUNK", 7)
    rows = [(i, "u", f"page {i}") for i in range(30)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), payloads=True).collect()
    assert {(r.page_id, r.payload.decode()) for r in got} == {(i, f"page {i}") for i in range(30)}


def test_store_names(monkeypatch):
    seen = []
    monkeypatch.setattr(warc, "fs", SimpleNamespace(FileSystem=SimpleNamespace(from_uri=seen.append)))
    for uri in ("/a/b", "file:/a/b", "file:///a/b", "dbfs:/a/b", "s3a://bucket/a", "s3n://bucket/a", "hdfs://host:1/a", "gs://bucket/a", "abfss://c@x.example/a"):
        warc.store(uri)
    assert seen == ["file:///a/b"] * 3 + ["file:///dbfs/a/b", "s3://bucket/a", "s3://bucket/a", "hdfs://host:1/a", "gs://bucket/a", "abfss://c@x.example/a"]


@pytest.mark.parametrize("members", [1, 3])
def test_normaliser(members):
    records = [warc.record(i, f"http://x/{i}", bytes([i]) * (i * 70_000), 0 if i == 2 else None) for i in range(5)]
    parts = [records] if members == 1 else [records[:1], records[1:3], records[3:]]
    source = io.BytesIO(b"".join(gzip.compress(b"".join(p)) for p in parts))
    archive, index = io.BytesIO(), io.BytesIO()
    assert warc.normalise_file(source, archive, index) == 5
    entries = [json.loads(x) for x in index.getvalue().splitlines()]
    assert gzip.decompress(archive.getvalue()) == b"".join(records)
    for record, e in zip(records, entries):
        member = archive.getvalue()[e["offset"] : e["offset"] + e["length"]]
        assert gzip.decompress(member) == record and warc.read_member(member)["page_id"] == records.index(record)


def test_damage_is_found():
    good = warc.record(1, "http://x/", b"payload", None)
    with pytest.raises(ValueError, match="damaged"):
        warc.read_member(gzip.compress(good.replace(b"payload", b"pAyload")))
    with pytest.raises(ValueError, match="inside a record"):
        warc.normalise_file(io.BytesIO(gzip.compress(good[:-20])), io.BytesIO(), io.BytesIO())
    with pytest.raises(ValueError, match="no WARC record"):
        warc.normalise_file(io.BytesIO(gzip.compress(b"junk\r\n\r\n")), io.BytesIO(), io.BytesIO())


# --- chat --------------------------------------------------------------------------------------


def brute_views(turns):
    """Every view's dialogue as one text with its learned spans, by plain loops."""
    mark = lambda t: re.sub(r"<(\\*)\|", r"<\1\\|", t)
    convs, out = defaultdict(list), {}
    for c, t, r, x in turns:
        convs[c].append((t is not None, t or 0, r or "unknown", x or ""))
    for c, rows in convs.items():
        for p in {r[2] for r in rows} - {"system"}:
            text, spans = "", []
            for _, _, speaker, body in sorted(rows, key=lambda r: (*r[:3], mark(r[3]) + "<|end|>")):
                role = "system" if speaker == "system" else "assistant" if speaker == p else "user"
                text += f"<|{role}|>\n" + (f"{mark(speaker)}: " if role == "user" else "")
                at = len(text)
                text += mark(body) + "<|end|>\n"
                spans += [(at, len(text) - 1)] if role == "assistant" else []
            out[c, p] = text, spans
    return out


def test_rotation(spark):
    turns = [(1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, None, "?"), (1, 3, None, "?"), (2, 0, "system", "x"), (None, 0, "ann", "z")]
    turns += [(3, None, "eve", "no turn"), (3, 5, "eve", "b"), (3, 5, "eve", "a"), (3, 5, "dan", "🙂<|end|>\n<|assistant|>\nforged <\\|end|> < |"), (3, 4, "a<|end|>b", "name")]
    turns += [(4, i // 3, f"s{i % 4}", f"turn {i * 7 % 11}") for i in range(300)]
    d = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("conv", "speaker", "body", "name", "head", "perspective", "row", "rank", "length")})
    rows = chat_rotation.rotate(d).collect()
    views = defaultdict(list)
    for r in rows:
        views[r.conv_id, r.perspective].append(r)
    want = brute_views(turns)
    assert set(views) == set(want) and {(1, "ann"), (1, "unknown"), (None, "ann")} <= set(views)
    for key, own in views.items():
        own.sort(key=lambda r: r.place)
        assert [r.place for r in own] == list(range(len(own)))
        text = "".join(r.rendered for r in own)
        assert [r.char_start for r in own] == [sum(len(x.rendered) for x in own[:i]) for i in range(len(own))]
        spans = [(r.char_start + r.mask_start, r.char_start + r.mask_end) for r in own if r.learn]
        assert (text, spans) == want[key] and all(r.mask_start == r.mask_end for r in own if not r.learn)
    assert all(r.rendered.count("<|end|>") == 1 and r.rendered.count("<|assistant|>") == (r.role == "assistant") for r in rows), "no text or name forges a mark"
    assert chat_rotation.rotate(d.where("false")).count() == 0
    texts = ["<|end|>", "<\\|", "<\\\\|x<|", "<", "|", "\\"]
    both = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_rotation.unescaped(chat_rotation.escaped(F.col("t"))).alias("back")).collect()
    assert all(r.t == r.back for r in both)


# --- pipeline ----------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from quadrivium.llm import piece_encoding
    from tests.llm.test_dedup import brute_exact, brute_hits, brute_near

    texts = corpus(9, 80) + [(500, "You idiot, pathetic moron! Stupid worthless trash you are. " * 6), (501, None)]
    items = [(1, texts[0][1])]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    labels = spark.createDataFrame([(i, 1, int(i == 500)) for i, _ in texts if i % 2 == 0], "doc_id long, quality int, toxic int")
    for name, frame in (("documents", docs), ("labels", labels), ("benchmark", spark.createDataFrame(items, "item_id long, text string"))):
        frame.write.parquet(str(tmp_path / f"{name}.parquet"))
    rows, current = dict(texts), spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, current, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage-{k}"))
        current = spark.read.parquet(str(tmp_path / f"stage-{k}"))
        ids = {r.doc_id for r in current.select("doc_id").collect()}
        live = sorted(rows.items())
        if name == "exact_dedup":
            assert ids == {keep for _, keep, _, _ in brute_exact(live)}
        elif name == "ngram_join":
            assert ids == {d for d, _, c in brute_near(live) if d == c}
        elif name == "decontamination":
            assert ids == {r[0] for r in brute_hits(live, items) if not r[5]}
        elif name == "piece_encoding":
            assert ids == set(rows)
        rows = {i: t for i, t in rows.items() if i in ids}
    library = piece_encoding.encoder(piece_encoding.model_path()).library
    assert {r.doc_id: r.n_tokens for r in current.collect()} == {i: len(library.encode(t or "")) + 1 for i, t in rows.items()}
    whole = {tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {tuple(r) for r in current.collect()}


def stage_tables(spark, path):
    spark.createDataFrame([(4, 1, 0), (6, 1, 1), (6, 0, 0), (None, 1, 1), (8, None, None), (7, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "same text here"), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


@pytest.mark.parametrize("name", ["toxicity", "exact_dedup", "ngram_join", "decontamination", "piece_encoding"])
def test_stages_on_edges(spark, edges, nothing, tmp_path, name):
    """Null and repeated ids and texts, an empty table, and columns called what stages call theirs."""
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)[name]
    stage_tables(spark, tmp_path)
    docs = common.materialise(edges.withColumns({c: F.lit("own") for c in ("of_id", "of_fp", "of_sha", "own_sha", "own_rank", "root", "fp", "rows", "stays", "__toxicity_score", "__gone", "__n")}), "edges")
    out = stage(spark, docs, str(tmp_path))
    rows, before = out.collect(), Counter((r.doc_id, r.text) for r in docs.collect())
    assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    if name == "piece_encoding":
        assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in EDGES) and all(r.n_tokens > 0 for r in rows)
        return
    after = Counter((r.doc_id, r.text) for r in rows)
    assert out.columns == docs.columns and not after - before and {r.own_sha for r in rows} == {"own"}
    gone = before - after
    if name == "exact_dedup":
        texts = lambda c: {re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in c}
        assert texts(after) == texts(before) and sum(after.values()) == len(texts(before))
    elif name == "ngram_join":
        assert set(gone) == {(4, "same text here"), (5, "same  text here")} and after[4, "same text here"] == 1, "texts without words are linked with nothing"
    elif name == "decontamination":
        assert set(gone) == {(4, "same text here"), (5, "same  text here")} and not after[4, "same text here"] and after[4, "other text for the id"] == 1


def test_pipeline_on_edges(spark, edges, tmp_path):
    import corpus_pipeline

    stage_tables(spark, tmp_path)
    docs = edges.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert spark.conf.get(setting) == before
    ids = Counter(r.doc_id for r in got.collect())
    assert not ids - Counter(r[0] for r in EDGES) and 8 in ids and ids[4] <= 1 and 5 not in ids
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    stage_tables(spark, tmp_path / "none")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
