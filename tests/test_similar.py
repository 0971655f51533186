"""The similar-title join against all pairs, by the ratio and by edit distance."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quadrivium.functions.similarity import ratio
from quadrivium.operators import audit, content, similar
from quadrivium.functions.text import titles_match

SCHEMA = "course_id string, pos int, title string"


def plain(title):
    import re

    t = re.sub(r"\b(chapter|ch|week|assignment|essay|part|lab|quiz|module|unit|hw|homework)\s*#?\s*\d+\b", "", title.lower())
    t = re.sub(r"\b\d+\b", "", re.sub(r"#\s*\d+", "", t))
    return re.sub(r"\s+", " ", t).strip()


def edit(a, b):
    a, b = a.lower(), b.lower()
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 100.0 * (1 - row[-1] / max(len(a), len(b)))


def brute(titles, least, measure):
    """(group, ta, tb) of distinct titles that are no numbered series."""
    out = set()
    for g, own in titles.items():
        for a in own:
            for b in own:
                if a < b and plain(a) != plain(b) and max(measure(a, b), measure(b, a)) >= least:
                    out.add((g, a, b))
    return out


def varied(rng, n):
    """Titles with a shared stem, so that common q-grams are hot, short ones, copies with a few edits, and numbers."""
    out = set()
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.5:
            t = list(rng.choice(sorted(out)) or "x")
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(t) + 1)
                t[at : at + rng.randint(0, 1)] = rng.choice(["a", "E", " ", "é", "1", ""])
            out.add("".join(t))
        elif kind < 0.65:
            out.add("".join(rng.choice("abC1 ") for _ in range(rng.randint(0, 8))))
        else:
            out.add("Assignment on " + " ".join(rng.choice(["ethics", "logic", "Week 3", "quiz 2", "the state", "history"]) for _ in range(rng.randint(1, 4))))
    return sorted(out)


@pytest.mark.parametrize(("exact", "least", "block"), [(True, 85.0, 2000), (True, 85.0, 3), (True, 60.0, 2000), (False, 70.0, 2000), (False, 85.0, 2)])
def test_titles_against_all_pairs(spark, exact, least, block):
    rng = random.Random(int(least) + block)
    titles = {g: varied(rng, 90) for g in ("c", "d")}
    rows = [(g, i, t) for g, own in titles.items() for i, t in enumerate(own * 2)] + [("c", 999, None), (None, 1, "Assignment on ethics")]
    found = similar.similar_titles(spark.createDataFrame(rows, SCHEMA), least, exact=exact, block=block).collect()
    want = brute(titles, least, ratio if exact else edit)
    assert {(r.course_id, r.ta, r.tb) for r in found} == want and len(found) == len(want) and len(want) > 20


def test_bounds_hold_for_random_texts():
    rng = random.Random(3)
    for _ in range(4000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choice(["a", "b", "d", ""])
        b = "".join(b)
        for least, exact in ((85.0, True), (60.0, True), (70.0, False)):
            if b and (ratio(a, b) if exact else edit(a, b)) >= least:
                for q in similar.GRAMS:
                    grams = lambda t, q=q: [t[i : i + q] for i in range(len(t) - q + 1)]
                    shared = sum(min(grams(a).count(g), grams(b).count(g)) for g in set(grams(a)))
                    assert shared >= similar.least_shared(q, len(a), len(b), least, exact), (a, b, q)


def test_candidates_are_few_in_a_hot_course(spark):
    """Titles with one stem and a word of their own: trigrams of the stem are in all lists' titles, but none posts them."""
    rng = random.Random(1)
    words = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(16)) for _ in range(400)]
    rows = [("c", i, f"Reflection on {w}") for i, w in enumerate(words)] + [("c", 1000 + i, f"Reflection on {w}s") for i, w in enumerate(words[:50])]
    titles = spark.createDataFrame(rows, SCHEMA).select(F.col("course_id").alias("group"), "title").distinct()
    met = similar.candidates(titles, 85.0, True).count()
    assert similar.similar_titles(spark.createDataFrame(rows, SCHEMA)).count() == 50 and met < 10 * 50


def test_title_classes_count_pairs(spark):
    rng = random.Random(5)
    own = varied(rng, 60)
    rows = [("c", i, rng.choice(own)) for i in range(400)]
    frame = spark.createDataFrame(rows, SCHEMA)
    pairs = [(a, b) for _, a, t in rows for _, b, u in rows if a < b and ((t == u) or (plain(t) != plain(u) and ratio(t, u) >= 85))]
    assert {(r.a, r.b) for r in audit.duplicate_pairs(frame).collect()} == set(pairs)
    assert audit.duplicate_total(frame).first().duplicates == len(pairs)
    one_way = similar.similar_titles(frame).where("(ab >= 85) <> (ba >= 85)").count()
    assert one_way > 0 or similar.similar_titles(frame).count() > 0


def test_one_way_pairs_are_counted_by_order(spark):
    pairs = spark.createDataFrame([("c", "x", "y", 90.0, 80.0), ("c", "x", "z", 80.0, 90.0)], "group string, ta string, tb string, ab double, ba double")
    keys = [("c", t, k) for k, t in enumerate("xyzzyxxyz")]
    got = {(r.ta, r.tb): r.earlier for r in similar._earlier(pairs, spark.createDataFrame(keys, "group string, t string, k int"), 85.0).collect()}
    count = lambda p, q: sum(1 for _, t, a in keys for _, u, b in keys if t == p and u == q and a < b)
    assert got == {("x", "y"): count("x", "y"), ("x", "z"): count("z", "x")}


def test_matched_titles_of_skewed_heads(spark):
    """All titles begin alike and share words; candidates stay near the matches, and results are those of the theta join."""
    rng = random.Random(2)
    own = ["".join(rng.choice("bdfgklmnprst") for _ in range(7)) for _ in range(150)]
    titles = [f"Assignment week {w}" for w in own] + ["ch 7", "Chapter 12", "7", "", "as"]
    questions = [f"what about assignment week {w} then" for w in own[:40]] + ["Week " + own[3], "a", "", own[5], "chapter 7?"]
    q, t = spark.createDataFrame([(x,) for x in questions], "question string"), spark.createDataFrame([(x,) for x in titles], "title string")
    want = {tuple(r) for r in q.join(t, titles_match("question", "title")).collect()}
    got = content.matched_titles(q, t).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    norm = lambda f, c, n: f.select(F.col(c).alias(n), F.lower(c).alias("n")).distinct()
    met = content._contained(norm(t, "title", "t"), "t", norm(q, "question", "q"), "q").distinct().count()
    assert met < 10 * len(want)


def test_numbered_series_are_not_compared(spark, monkeypatch):
    """A course of one series posts nothing, and one title more is all it takes to be compared; long lists of one series go too."""
    read = []
    monkeypatch.setattr(similar, "posted", lambda titles, *a, f=similar.posted: (read.append({r.group for r in titles.select("group").collect()}), f(titles, *a))[1])
    rows = [("c", i, f"Order {i}") for i in range(300)] + [("d", i, f"Order {i}") for i in range(60)] + [("d", 900, "Ordering 7"), ("d", 901, "Orderings 7")]
    found = similar.similar_titles(spark.createDataFrame(rows, SCHEMA), block=4).collect()
    assert read == [{"d"}]
    titles = {g: [t for h, _, t in rows if h == g] for g in ("c", "d")}
    assert {(r.course_id, r.ta, r.tb) for r in found} == brute(titles, 85.0, ratio) and len(found) > 0


def test_plans_stay_small(spark):
    """What both sides of a join need is planned once: the driver keeps every plan and each of its changes."""
    rows = spark.createDataFrame([("c", 0, "Essay on ethics"), ("c", 1, "Essay on ethics!")], SCHEMA)
    plan = audit.duplicate_total(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") < 30


def test_pairs_of_one_title_are_made_in_many_tasks(spark, monkeypatch):
    """Titles with most of the rows are cut into blocks, and no task makes all of their pairs; none is lost or made twice."""
    monkeypatch.setattr(audit, "BLOCK_KEYS", 40, raising=False)
    monkeypatch.setattr(audit, "TASK_PAIRS", 5000, raising=False)
    rows = [("c", i, "Essay on ethics" if i % 3 else "Essay on ethics!") for i in range(500)] + [("c", 900, "Quiz"), ("d", 901, "Essay on ethics")]
    pairs = audit.duplicate_pairs(spark.createDataFrame(rows, SCHEMA), exact=False).withColumn("task", F.spark_partition_id())
    made = pairs.groupBy("task").count().collect()
    assert sum(r["count"] for r in made) == 500 * 499 // 2 and max(r["count"] for r in made) < 500 * 499 // 2 / 4
    found = {(r.a, r.b): r.similarity for r in pairs.collect()}
    assert found == {(a, b): 100.0 if (a % 3 == 0) == (b % 3 == 0) else pytest.approx(93.75) for b in range(500) for a in range(b)}


def test_a_cell_expands_key_by_key(spark):
    """A compiled loop keeps all rows that it makes of one input row, so the two expansions of a cell are not compiled into one."""
    rows = [("c", i, "Essay on ethics" if i % 3 else "Essay on ethics!") for i in range(60)]
    pairs = audit.duplicate_pairs(spark.createDataFrame(rows, SCHEMA), exact=False)
    assert len(pairs.collect()) == 60 * 59 // 2
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    inner, outer = re.findall(r"(\*\(\d+\) )?Generate explode", plan)
    assert not inner or inner != outer


def test_rows_without_order_are_no_pair(spark):
    """As in the SQL, a pair needs a < b: rows with no key or with the same key are none, rows that repeat a key are pairs with others."""
    rows = [("c", 1, "old bolt"), ("c", 1, "cold bolt"), ("c", 1, "old bolt"), ("c", None, "cold bolt"), ("c", 2, "cold bolt"), ("c", 0, "old bolt")]
    found = sorted(tuple(r) for r in audit.duplicate_pairs(spark.createDataFrame(rows, SCHEMA), 70.0, exact=False).collect())
    near = pytest.approx(800 / 9)
    assert found == [("c", 0, 1, near), ("c", 0, 1, 100.0), ("c", 0, 1, 100.0), ("c", 0, 2, near), ("c", 1, 2, near), ("c", 1, 2, near), ("c", 1, 2, 100.0)]
