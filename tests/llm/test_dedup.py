import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrivium.llm import decontamination, exact_dedup, ngram_join
from tests.llm.conftest import EDGES, corpus

SPACE = re.compile(r"[\x20\x09-\x0D]")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# --- exact copies ------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 255), st.integers(1, 40), max_size=60), st.integers(1, 60))
def test_directory(counts, capacity):
    d = exact_dedup.Directory.build(counts, 8, capacity)
    assert len(d.slots) == 2**d.depth and set(d.slots) == set(range(len(d.local)))
    held = defaultdict(int)
    for prefix, n in counts.items():
        held[d.slots[prefix >> (8 - d.depth)]] += n
    assert sum(held.values()) == sum(counts.values())
    for bucket, local in enumerate(d.local):
        own = [i for i, b in enumerate(d.slots) if b == bucket]
        assert len(own) == 2 ** (d.depth - local) and own == list(range(own[0], own[0] + len(own)))
        assert held[bucket] <= capacity or local == 8
    owners = d.owners(counts, 8, 5)
    assert owners == sorted(owners) and (not owners or 0 <= owners[0] and owners[-1] < 5), "ranges of keys"
    share, most = defaultdict(int), max(held.values(), default=0)
    for bucket, n in held.items():
        share[owners[d.slots.index(bucket)]] += n
    assert all(n <= sum(held.values()) / 5 + most for n in share.values())


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        norm = SPACE.sub("", t or "")
        best = min(groups[norm], key=lambda x: (x[0], x[1], x[2] or 0))
        out.append((i, best[2], len(groups[norm]), hashlib.sha256(norm.encode()).hexdigest()))
    return out


def test_exact_against_brute_force(spark):
    rows = corpus(3, 120) + [(1000 + i, "hot text " * 3) for i in range(90)] + [(2000 + i, "hot  text " * 3) for i in range(5)]
    got = [tuple(r) for r in exact_dedup.exact_dedup(frame(spark, rows)).select("doc_id", "keep_id", "group_size", "text_sha256").collect()]
    assert sorted(got) == sorted(brute_exact(rows))


def test_exact_edges(spark, edges, nothing):
    got = exact_dedup.exact_dedup(edges).collect()
    key = lambda x: tuple((y is None, str(y)) for y in x)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(brute_exact(EDGES), key=key)
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}, "one row of every group stays, even where an id repeats"
    assert exact_dedup.exact_dedup(nothing).count() == 0
    stays = exact_dedup.stage(spark, edges, "")
    assert stays.columns == edges.columns and stays.count() == len(kept)
    assert exact_dedup.stage(spark, frame(spark, corpus(3, 60)), "").count() == len({SPACE.sub("", t) for _, t in corpus(3, 60)})


def test_exact_stage_of_null_ids(spark):
    """All rows of a group have null ids, and no other id repeats: one row stays, the longest."""
    rows = [(None, "no id here"), (None, "no  id here"), (None, "no id here"), (1, "with an id"), (2, "with an id"), (3, "alone")]
    got = [tuple(r) for r in exact_dedup.stage(spark, frame(spark, rows), "").collect()]
    assert sorted(got, key=str) == [(1, "with an id"), (3, "alone"), (None, "no  id here")]
    hot = [(None, "hot text")] * 200 + [(i, f"text {i}") for i in range(400)]
    assert exact_dedup.stage(spark, frame(spark, hot), "").count() == 401


# --- near copies -------------------------------------------------------------------------------


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_near(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [(d, len(sets[i]), least.get(top(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def near_rows(seed):
    """Clusters whose members often miss their pivot: copies of copies, with edits."""
    rng = np.random.default_rng(seed)
    base = [f"w{rng.integers(0, 400)}" for _ in range(60)]
    rows, last = corpus(seed, 40), base
    for i in range(40):
        last = list(base if i % 7 == 0 else last)
        last[rng.integers(0, 60)] = f"e{i}"
        rows.append((500 + i, " ".join(last)))
    return rows


def test_near_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_LEAST", 3)
    monkeypatch.setattr(ngram_join, "BLOCK_MOST", 3)
    for seed in (1, 2):
        rows = near_rows(seed)
        got = [tuple(r) for r in ngram_join.near_duplicates(frame(spark, rows)).collect()]
        assert sorted(got) == sorted(brute_near(rows))


def test_near_edges(spark, edges, nothing):
    key = lambda x: tuple((y is None, str(y)) for y in x)
    got = sorted((tuple(r) for r in ngram_join.near_duplicates(edges).collect()), key=key)
    # The id 4 stands for two texts: its row with the other text is in a class of its own.
    assert got == sorted(brute_near(EDGES), key=key)
    assert ngram_join.near_duplicates(nothing).count() == 0
    kept = ngram_join.stage(spark, edges, "")
    assert kept.columns == edges.columns and kept.where("doc_id = 5").count() == 0


def test_near_stage_judges_rows(spark):
    """Null and repeated ids: one row of every component stays, and rows that have no partner all do."""
    rng = np.random.default_rng(11)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 10_000, 60))
    near = lambda t, k: t + f" end{k}"
    a, b, c, d, e, f = (text() for _ in range(6))
    big = 2**60 + 1
    alone = [(None, text()), (None, text()), (big, text()), (1, text()), (None, None), (None, None), (7, ""), (7, " ")]
    groups = [
        [(1, a), (None, near(a, 1)), (None, near(a, 2)), (9, near(a, 3))],  # nulls beside ids
        [(None, near(b, k)) for k in range(4)],  # null ids alone
        [(2, near(c, k)) for k in range(3)] + [(3, c)],  # several texts with the least id
        [(4, d), (4, d), (4, d), (5, d)],  # repeated rows
        [(None, e), (None, e), (None, near(e, 1))],
        [(big, f), (big + 1, near(f, 1)), (None, near(f, 2))],
    ]
    docs = spark.createDataFrame([(*r, str(i)) for i, r in enumerate(sum(groups, alone))], "doc_id long, text string, lang string")
    got = [tuple(r) for r in ngram_join.stage(spark, docs, "").select("doc_id", "text").collect()]
    left = list(got)
    for r in alone:
        left.remove(r)
    for group in groups:
        own = [r for r in left if r in group]
        least = min((i for i, _ in group if i is not None), default=None)
        assert len(own) == 1 and own[0][0] == least, (group[0][0], own)
        left.remove(own[0])
    assert not left


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "ab", "Éa", "éa", "ba", "🙂", "x" * 70]), max_size=14))
def test_shingle_sets(words):
    text = " \n".join(words)
    assert len(ngram_join.shingle_set(text)) == len(shingles(text))
    assert (ngram_join.shingle_set(text) == ngram_join.shingle_set("\t" + "\x0b".join(w if ord(w[0]) > 127 else w.swapcase() for w in words))).all() or any("a" in w[1:] and ord(w[0]) > 127 for w in words)


def test_long_text_hashes_in_blocks(monkeypatch):
    text = ("lorem ipsum dolor sit amet " * 300).encode()
    whole = ngram_join.word_hashes(text)
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 17)
    assert (ngram_join.word_hashes(text) == whole).all() and len(whole) == 1500


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(1, 50)]
    got = dict(tuple(r) for r in ngram_join.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    assert got == {x: top(x) for p in pairs if p[0] != p[1] for x in p}
    assert ngram_join.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- contamination -----------------------------------------------------------------------------

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return TOKEN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(docs, items):
    wins = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            wins[tuple(w[i : i + n])].add(str(item))
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if ids := wins.get(tuple(w[i : i + n])):
                    found |= ids
                    hit |= set(range(i, i + n))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def contaminated_rows():
    docs = corpus(7, 40)
    items = [(i, t) for i, t in corpus(8, 12)] + [(100, "Über ÉTÉ"), (101, "omega"), (102, ""), (103, None), (104, docs[0][1]), (105, docs[0][1])]
    long = max(docs, key=lambda x: len(x[1]))[1]
    docs += [(200, "start " + items[0][1].upper() + " end"), (201, items[-2][1]), (202, "über été, omega! über  été"), (203, None), (204, long + "! " + long), (202, "second text of the id omega")]
    items.append((106, long))
    return docs, items


def test_decontamination_against_brute_force(spark, monkeypatch):
    docs, items = contaminated_rows()
    want = sorted(brute_hits(docs, items), key=str)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (decontamination.BROADCAST_BYTES, 0):  # 0: the way without a broadcast
        monkeypatch.setattr(decontamination, "BROADCAST_BYTES", limit)
        got = [tuple(r) for r in decontamination.decontaminate(frame(spark, docs), bench).collect()]
        assert sorted(got, key=str) == want


def test_decontamination_edges(spark, edges, nothing):
    bench = spark.createDataFrame([(1, "same text"), (None, "emoji and"), (2, None)], "item_id long, text string")
    got = decontamination.decontaminate(edges, bench).collect()
    assert len(got) == len(EDGES) and sum(r.contaminated for r in got) == 3
    assert {r.n_hit for r in decontamination.decontaminate(edges, bench.where("false")).collect()} == {0}
    assert decontamination.decontaminate(nothing, bench).count() == 0


def test_decontamination_stage_judges_rows(spark, tmp_path):
    """Null and repeated ids: only the contaminated rows of an id go."""
    spark.createDataFrame([(1, "one passage of the benchmark that is long enough to be found again in any document")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    bad = "One passage of the benchmark that is long enough to be found again in any document!"
    rows = [(None, bad), (None, "clean text of a row without an id"), (None, "another clean one"), (None, None), (4, bad), (4, "clean text of a repeated id"), (4, bad), (5, "clean"), (5, "clean"), (6, bad)]
    got = [tuple(r) for r in decontamination.stage(spark, frame(spark, rows), str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((r for r in rows if r[1] != bad), key=str)


def test_decontamination_of_items_with_one_text(spark, monkeypatch):
    """Few windows with very many ids each: not broadcast, whatever the number of windows."""
    items = [(i, "one text that all of these items have") for i in range(2000)] + [(5000, "omega pi rho")]
    docs = [(1, "see: one text that all of these items have"), (2, "omega pi rho sigma"), (None, "nothing of it")]
    seen, real = [], decontamination.F.broadcast
    monkeypatch.setattr(decontamination.F, "broadcast", lambda df: (seen.append(df.columns), real(df))[1])
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 8192)
    got = [tuple(r) for r in decontamination.decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted(brute_hits(docs, items), key=str)
    assert seen and not any("items" in columns for columns in seen)


def test_near_of_pooled_paragraphs(spark, monkeypatch):
    """Documents put together from shared paragraphs: one web of shared shingles, in which only some pairs link."""
    rng = np.random.default_rng(21)
    pool = [" ".join(f"p{k}w{i}" for i in range(rng.integers(6, 40))) for k in range(30)]
    rows = [(i, " ".join(pool[k] for k in rng.choice(30, rng.integers(2, 9), replace=False))) for i in range(120)]
    for i in range(120, 170):  # one paragraph of another document changed, left out or added
        words = rows[int(rng.integers(0, i))][1].split(" ")
        at = int(rng.integers(0, len(words)))
        rows.append((i, " ".join(words[:at] + pool[rng.integers(0, 30)].split(" ")[: rng.integers(1, 8)] + words[at + int(rng.integers(0, 4)) :])))
    want = sorted(brute_near(rows))
    assert 5 < sum(d != c for d, _, c in want) < 100
    for most, tokens, fan in ((1024, 1 << 22, 4096), (3, 40, 3)):  # many ranges, dealt twice, and small cells
        monkeypatch.setattr(ngram_join, "BLOCK_LEAST", min(most, 64))
        monkeypatch.setattr(ngram_join, "BLOCK_MOST", most)
        monkeypatch.setattr(ngram_join, "RANGE_TOKENS", tokens)
        monkeypatch.setattr(ngram_join, "FAN", fan)
        assert sorted(tuple(r) for r in ngram_join.near_duplicates(frame(spark, rows)).collect()) == want


def test_stars_leave_the_rest_to_cells(spark, monkeypatch):
    """Without any star the cells alone find all links."""
    rows = near_rows(3)
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(ngram_join, "star_links", lambda *_: none)
    assert sorted(tuple(r) for r in ngram_join.near_duplicates(frame(spark, rows)).collect()) == sorted(brute_near(rows))


@pytest.mark.parametrize("bits", [0, 2])
def test_references_that_clash(spark, bits):
    """Nearly all classes have another one's number: they get new ones, and every link is found."""
    rows = near_rows(3)
    assert sorted(tuple(r) for r in ngram_join.near_duplicates(frame(spark, rows), bits=bits).collect()) == sorted(brute_near(rows))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-3, 3), st.integers(0, 2**64 - 1), st.integers(1, 9)), max_size=40), st.integers(1, 4))
def test_packed_blocks(rows, cap):
    old, ngram_join.CAP = ngram_join.CAP, cap
    try:
        ref, tokens, df = (np.array([r[i] for r in rows], dtype=t) for i, t in enumerate((np.int64, np.uint64, np.int64)))
        assert [x.tolist() for x in ngram_join.unpack(ngram_join.pack(ref, tokens, df), True)] == [ref.tolist(), tokens.tolist(), df.tolist()]
        assert (ngram_join.range_of(tokens, 7) < 7).all() and (ngram_join.ref_range(ref, 7) >= 0).all()
    finally:
        ngram_join.CAP = old


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 300), max_size=200), st.sets(st.integers(0, 300), max_size=200), st.sampled_from([2, 65_535]))
def test_sketches_bound_the_overlap(both, one, two, cap):
    old, ngram_join.CAP = ngram_join.CAP, cap
    try:
        a, b = (np.array(sorted(both | own), dtype=np.uint64) for own in (one, two))
        x = ngram_join.sketches([ngram_join.sketch(a), ngram_join.sketch(b)])
        assert np.minimum(x[0], x[1]).sum() >= len(set(a.tolist()) & set(b.tolist()))
    finally:
        ngram_join.CAP = old
