"""License rules against every rule tried at every place, and suppression pair by pair."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrivium.llm import signatures
from quadrivium.llm.signatures import Rule, Scanner, words_of
from tests.llm.conftest import EDGES

CLASS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text, scanner):
    """All rules without keywords, on text words; (rule, first, end, suppressed)."""
    words = CLASS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    line, found = " " + " ".join(words) + " ", []
    for i, rule in enumerate(scanner.rules):
        for m in re.finditer(f" (?:{rule.pattern})(?= )", line):
            found.append((i, line[: m.start()].count(" "), line[: m.end()].count(" ")))
    out = []
    for x in found:
        key = lambda y: (scanner.rules[y[0]].priority, y[1] - y[2], y[0])
        gone = x[0] >= scanner.n_base and any(y[0] >= scanner.n_base and y[1] <= x[1] and y[2] >= x[2] and key(y) < key(x) for y in found if y != x)
        out.append((*x, gone))
    return len(words), sorted(out)


CITED = [
    "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.",
    "SPDX-License-Identifier: GPL-2.0-or-later OR MIT", "https://www.apache.org/licenses/LICENSE-2.0", "CC BY CC BY-SA 4.0, cc by", "GNU Lesser General Public License v2.1 or (at your option) any later version",
    "Redistribution and use in source and binary forms, with or without modification, are permitted", "All rights reserved.", "the BSD 3-Clause License and the GPLv2", "creativecommons.org/licenses/by-nc-nd/3.0/",
]


@pytest.mark.parametrize("seed", range(6))
def test_scan_against_all_rules(seed):
    rng, scanner = random.Random(seed), Scanner()
    for _ in range(6):
        text = " ".join(rng.choice([rng.choice(CITED), rng.choice(["the", "été", "License", "under", "gnu", "version 2", "\n", "x-y"])]) for _ in range(rng.randint(0, 14)))
        words = words_of(text)
        assert (len(words), sorted(scanner.detections(words))) == brute(text, scanner)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 12), st.integers(1, 6)), max_size=14, unique=True))
def test_suppression_pair_by_pair(spans):
    rules = [Rule(str(i), str(i), "x", frozenset(["x"]), p, 1.0) for i, p in enumerate((2, 1, 1, 3, 2, 1))]
    scanner = Scanner(rules, ())
    found = [(i, a, a + n) for i, a, n in spans]
    key = lambda y: (rules[y[0]].priority, y[1] - y[2], y[0])
    want = sorted((*x, any(y[1] <= x[1] and y[2] >= x[2] and key(y) < key(x) for y in found)) for x in found)
    assert sorted(scanner.resolved(found)) == want


def test_rules():
    assert len(signatures.RULES) > 300 and all(r.keywords and r.priority > 0 and 0 < r.weight <= 1 for r in signatures.RULES)
    for r in signatures.RULES:  # a match without a keyword would be lost
        re.compile(r.pattern)
    labels = lambda t: {s.rules[i].label for i, _, _, gone in s.detections(words_of(t)) if not gone}
    s = Scanner()
    assert labels(CITED[0]) == {"gpl", "gpl-3.0"} and labels(CITED[2]) == {"cc-by", "cc-by-nc-4.0"} and labels(CITED[3]) == {"apache", "apache-2.0"}
    assert labels(CITED[8]) == {"bsd"} and labels("nothing of the kind, just gnu and public words") == set()


def test_operator_and_edges(spark, edges, nothing):
    found = {(r.doc_id, r.n_words): r for r in signatures.scan(edges).collect()}
    assert len(signatures.scan(edges).collect()) == len(EDGES) and signatures.scan(nothing).collect() == []
    assert found[6, 20_000].detections == [] and found[2, 0].score == 0.0 and (1, 0) in found
    rows = [(2**53 + 1, "word " * 50_000 + CITED[0]), (None, "CC BY. cc by"), (None, "CC BY. cc by")]
    out = signatures.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in out} == {2**53 + 1, None} and len(out) == 3
    assert [d.first_word for r in out if r.doc_id for d in r.detections if d.base] == [50_006]


def test_query_contract(spark, tmp_path):
    rows = [(1, CITED[0] + " " + CITED[0]), (2, "CC BY 4.0; Apache License"), (3, None), (4, "MITLicense mit licenses")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in signatures.query(spark, str(tmp_path)).collect()}
    assert (out[1].n_words, out[1].n_base, out[1].first_word, out[1].last_word, out[1].base_labels, out[1].labels) == (24, 2, 6, 18, "gpl", "gpl,gpl-3.0")
    assert out[2].base_labels == "apache,cc-by" and out[2].labels == "apache,cc-by,cc-by-4.0" and out[2].first_word == 0
    assert (out[3].n_words, out[3].n_base, out[3].first_word, out[3].base_labels, out[3].labels, out[3].score) == (0, 0, None, "", "", 0.0) and out[4].n_base == 0
