"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

from quadrivium.llm import spelling
from tests.llm.conftest import EDGES


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows, one_in=97, letters=5, seen=3):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % one_in else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: c for w, c in n.items() if len(w) >= letters and c >= seen}


def brute(n, ratio=2):
    out = {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        out[w] = (n[w], len(others), best if best and n[best] >= ratio * n[w] else None)
    rows = set()
    for w, (c, k, form) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        rows.add((w, c, k, form, n[form] if form else None, root))
    return rows


def found(frame):
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in frame.collect()}


def test_variants_against_pairs(spark):
    """Few letters, so groups are full, doubled letters and ties common, chains long."""
    for seed in range(4):
        rng = random.Random(seed)
        n = {}
        for _ in range(120):
            n["".join(rng.choice("aabcé÷ÿ"[: 3 + seed]) for _ in range(rng.randint(5, 7)))] = rng.choice([3, 3, 4, 6, 7, 12, 13, 24, 50, 100])
        frame = spark.createDataFrame(list(n.items()), "word string, n long")
        assert found(spelling.variants(frame)) == brute(n)


def test_chain_to_the_root(spark):
    n = {"a" * 5 + "b" * i: 3 * 2 ** (12 - i) for i in range(12)}
    got = found(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == brute(n) and {r[5] for r in got} == {"aaaaa"}


def test_query_against_pairs(spark, tmp_path):
    rng = random.Random(7)
    words = ["Straße", "straße", "Größe", "ÀÉÎÕÜ", "àéîõü", "counter", "Counters", "count×er", "÷÷÷÷÷", "hello", "hallo", "hullo", "world", "worlds", "abc", "lettre", "lettres", "lettré"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)) + rng.choice([".", "\n", "’", "1"])) for i in range(120)] + [(None, "hello world " * 40), (5, None), (6, "")] + [(9, "hello")] * 5
    clash = "doc_id long, text string"
    spark.createDataFrame(rows, clash).selectExpr("*", "'x' AS word", "1L AS n", "'y' AS run", "0L AS h").write.parquet(f"{tmp_path}/documents.parquet")
    want = counted(rows)
    assert any(len(w) < 7 and "lettr" in w for w in want)
    assert found(spelling.query(spark, str(tmp_path))) == brute(want)


def test_edges(spark, edges, nothing):
    words = lambda f: spelling.vocabulary(spelling.with_slips(spelling.runs(f)))
    assert {(r.word, r.n) for r in words(edges).collect()} == set(counted(EDGES).items())
    assert spelling.variants(words(nothing)).collect() == []
    one = spark.createDataFrame([("alone", 9)], "word string, n long")
    assert found(spelling.variants(one)) == {("alone", 9, 0, None, None, "alone")}
