"""License scan by ordered signature rules over whole texts.

A text becomes its words: A-Z lower-cased, everything but ASCII digits, letters
and non-ASCII characters a separator, one space between words.  A rule is a
regular expression over that line with bounded repetition, a set of keywords, a
priority and a weight.  A rule is tried only on texts that hold all its
keywords, so a text without license words costs one set look-up.  Every match
is a detection, an interval of words.

Detections overlap: the name of a license stands inside the grant that cites
it, a general name inside a versioned one.  A detection is suppressed if the
interval of one that goes before it contains its own; before goes the better
priority, then the longer interval, then the earlier rule.  That order and
containment are transitive, so a suppressed detection suppresses nothing that
its own suppressor does not.  Matches of the base phrases are reported at every
place and are never suppressed.

The rules are built from a table of license families and a few forms in which a
family is cited, besides signatures of license texts; ``scan`` takes others.

Edge cases: null counts as empty; no words give no detections and score 0;
repeated rows are scanned each; very long texts are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


class Rule(NamedTuple):
    """``pattern`` is over words with one space between them; matches begin and end at borders of words."""

    name: str
    label: str
    pattern: str
    keywords: frozenset[str]
    priority: int
    weight: float


# The phrases that are always reported, and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: label ; keyword ; name, with <1 2> for a version ; identifier in words ; address in words
FAMILIES = """
gpl-1.0 ; general ; gnu general public license <1 0> ; gpl 1 0 ; gnu org licenses gpl 1
gpl-2.0 ; general ; gnu general public license <2 0> ; gpl 2 0 ; gnu org licenses (?:old licenses )?gpl 2
gpl-3.0 ; general ; gnu general public license <3 0> ; gpl 3 0 ; gnu org licenses gpl 3
gpl-1.0 ; gpl ; gpl <1 0> ; - ; -
gpl-2.0 ; gpl ; gpl <2 0> ; - ; -
gpl-3.0 ; gpl ; gpl <3 0> ; - ; -
gpl-2.0 ; gplv2 ; gplv2 ; - ; -
gpl-3.0 ; gplv3 ; gplv3 ; - ; -
gpl ; general ; gnu general public license ; gpl ; gnu org licenses gpl
lgpl-2.0 ; library ; gnu library general public license <2 0> ; lgpl 2 0 ; gnu org licenses (?:old licenses )?lgpl 2 0
lgpl-2.1 ; lesser ; gnu lesser general public license <2 1> ; lgpl 2 1 ; gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3.0 ; lesser ; gnu lesser general public license <3 0> ; lgpl 3 0 ; gnu org licenses lgpl 3
lgpl ; lesser ; gnu lesser general public license ; lgpl ; gnu org licenses lgpl
lgpl-2.1 ; lgpl ; lgpl <2 1> ; - ; -
lgpl-3.0 ; lgpl ; lgpl <3 0> ; - ; -
agpl-1.0 ; affero ; affero general public license <1 0> ; agpl 1 0 ; affero org oagpl
agpl-3.0 ; affero ; gnu affero general public license <3 0> ; agpl 3 0 ; gnu org licenses agpl 3
agpl ; affero ; gnu affero general public license ; agpl ; gnu org licenses agpl
agpl-3.0 ; agpl ; agpl <3 0> ; - ; -
gfdl-1.1 ; documentation ; gnu free documentation license <1 1> ; gfdl 1 1 ; gnu org licenses (?:old licenses )?fdl 1 1
gfdl-1.2 ; documentation ; gnu free documentation license <1 2> ; gfdl 1 2 ; gnu org licenses (?:old licenses )?fdl 1 2
gfdl-1.3 ; documentation ; gnu free documentation license <1 3> ; gfdl 1 3 ; gnu org licenses fdl 1 3
gfdl ; documentation ; gnu free documentation license ; gfdl ; gnu org (?:licenses|copyleft) fdl
apache-1.0 ; apache ; apache (?:software )?licen[cs]e <1 0> ; apache 1 0 ; apache org licenses license 1 0
apache-1.1 ; apache ; apache (?:software )?licen[cs]e <1 1> ; apache 1 1 ; apache org licenses license 1 1
apache-2.0 ; apache ; apache (?:software )?licen[cs]e <2 0> ; apache 2 0 ; apache org licenses license 2 0
apache ; apache ; apache software licen[cs]e ; apache ; apache org licenses
mit ; mit ; (?:the )?mit licen[cs]e ; mit ; opensource org licenses mit
mit ; expat ; expat licen[cs]e ; - ; -
mit-0 ; mit ; mit no attribution ; mit 0 ; opensource org licenses mit 0
x11 ; x11 ; x11 licen[cs]e ; x11 ; -
isc ; isc ; isc licen[cs]e ; isc ; opensource org licenses isc
bsd-4-clause ; bsd ; (?:bsd 4 clause|4 clause bsd|original bsd|four clause bsd)(?: licen[cs]e)? ; bsd 4 clause ; -
bsd-3-clause ; bsd ; (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|three clause bsd)(?: licen[cs]e)? ; bsd 3 clause ; opensource org licenses bsd 3 clause
bsd-2-clause ; bsd ; (?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd|two clause bsd)(?: licen[cs]e)? ; bsd 2 clause ; opensource org licenses bsd 2 clause
bsd ; bsd ; bsd (?:style )?licen[cs]e ; bsd ; opensource org licenses bsd license
0bsd ; zero ; (?:zero clause bsd|bsd zero clause)(?: licen[cs]e)? ; 0bsd ; opensource org licenses 0bsd
mpl-1.0 ; mozilla ; mozilla public licen[cs]e <1 0> ; mpl 1 0 ; mozilla org mpl 1 0
mpl-1.1 ; mozilla ; mozilla public licen[cs]e <1 1> ; mpl 1 1 ; mozilla org (?:en us )?mpl 1 1
mpl-2.0 ; mozilla ; mozilla public licen[cs]e <2 0> ; mpl 2 0 ; mozilla org (?:en us )?mpl 2 0
mpl ; mozilla ; mozilla public licen[cs]e ; mpl ; mozilla org (?:en us )?mpl
epl-1.0 ; eclipse ; eclipse public licen[cs]e <1 0> ; epl 1 0 ; eclipse org legal epl v10
epl-2.0 ; eclipse ; eclipse public licen[cs]e <2 0> ; epl 2 0 ; eclipse org legal epl (?:2 0|v20)
epl ; eclipse ; eclipse public licen[cs]e ; epl ; eclipse org legal epl
edl-1.0 ; eclipse ; eclipse distribution licen[cs]e <1 0> ; - ; eclipse org org documents edl v10
cddl-1.0 ; cddl ; (?:common development and distribution licen[cs]e cddl|cddl) <1 0> ; cddl 1 0 ; opensource org licenses cddl 1 0
cddl-1.1 ; cddl ; (?:common development and distribution licen[cs]e cddl|cddl) <1 1> ; cddl 1 1 ; -
cddl ; development ; common development and distribution licen[cs]e ; cddl ; -
cpl-1.0 ; common ; common public licen[cs]e <1 0> ; cpl 1 0 ; opensource org licenses cpl 1 0
eupl-1.1 ; eupl ; (?:european union public licen[cs]e eupl|eupl) <1 1> ; eupl 1 1 ; -
eupl-1.2 ; eupl ; (?:european union public licen[cs]e eupl|eupl) <1 2> ; eupl 1 2 ; -
eupl ; european ; european union public licen[cs]e ; eupl ; joinup ec europa eu software page eupl
artistic-1.0 ; artistic ; artistic licen[cs]e <1 0> ; artistic 1 0 ; opensource org licenses artistic license 1 0
artistic-2.0 ; artistic ; artistic licen[cs]e <2 0> ; artistic 2 0 ; opensource org licenses artistic license 2 0
artistic ; artistic ; artistic licen[cs]e ; artistic ; perlfoundation org artistic
bsl-1.0 ; boost ; boost software licen[cs]e <1 0> ; bsl 1 0 ; boost org license 1 0
bsl ; boost ; boost software licen[cs]e ; - ; -
busl-1.1 ; business ; business source licen[cs]e <1 1> ; busl 1 1 ; mariadb com bsl11
zlib ; zlib ; zlib(?: libpng)? licen[cs]e ; zlib ; opensource org licenses zlib
unlicense ; unlicense ; (?:the )?unlicense ; unlicense ; unlicense org
wtfpl ; wtfpl ; wtfpl ; wtfpl ; wtfpl net
wtfpl ; want ; do what the (?:fuck|f) you want to public licen[cs]e ; - ; -
psf-2.0 ; python ; python software foundation licen[cs]e(?: <2 0>)? ; (?:psf|python) 2 0 ; docs python org (?:3 )?license
php-3.01 ; php ; php licen[cs]e <3 01> ; php 3 01 ; php net license 3 01
ruby ; ruby ; ruby s? ?licen[cs]e ; ruby ; -
openssl ; openssl ; openssl licen[cs]e ; openssl ; openssl org source license
ncsa ; ncsa ; (?:university of illinois )?ncsa(?: open source)? licen[cs]e ; ncsa ; opensource org licenses ncsa
ms-pl ; microsoft ; microsoft public licen[cs]e ; ms pl ; opensource org licenses ms pl
ms-rl ; microsoft ; microsoft reciprocal licen[cs]e ; ms rl ; opensource org licenses ms rl
ofl-1.0 ; sil ; sil open font licen[cs]e <1 0> ; ofl 1 0 ; -
ofl-1.1 ; sil ; sil open font licen[cs]e <1 1> ; ofl 1 1 ; scripts sil org ofl
ofl ; sil ; sil open font licen[cs]e ; ofl ; openfontlicense org
odbl-1.0 ; database ; open (?:data commons open )?database licen[cs]e(?: <1 0>)? ; odbl 1 0 ; opendatacommons org licenses odbl
odc-by-1.0 ; attribution ; open data commons attribution licen[cs]e(?: <1 0>)? ; odc by 1 0 ; opendatacommons org licenses by
pddl-1.0 ; dedication ; (?:open data commons )?public domain dedication and licen[cs]e(?: <1 0>)? ; pddl 1 0 ; opendatacommons org licenses pddl
cdla-permissive-2.0 ; cdla ; (?:community data licen[cs]e agreement|cdla) permissive <2 0> ; cdla permissive 2 0 ; cdla (?:dev|io) permissive
cdla-sharing-1.0 ; cdla ; (?:community data licen[cs]e agreement|cdla) sharing <1 0> ; cdla sharing 1 0 ; cdla (?:dev|io) sharing
ogl-uk-3.0 ; government ; open government licen[cs]e <3 0> ; ogl uk 3 0 ; nationalarchives gov uk doc open government licence version 3
ogl ; government ; open government licen[cs]e ; ogl uk ; nationalarchives gov uk doc open government licence
cc0-1.0 ; cc0 ; (?:creative commons )?cc0(?: <1 0>)?(?: universal)? ; cc0 1 0 ; creativecommons org publicdomain zero 1 0
cc-pdm-1.0 ; mark ; (?:creative commons )?public domain mark(?: <1 0>)? ; - ; creativecommons org publicdomain mark 1 0
sspl-1.0 ; server ; server side public licen[cs]e(?: <1 0>)? ; sspl 1 0 ; mongodb com licensing server side public license
elastic-2.0 ; elastic ; elastic licen[cs]e <2 0> ; elastic 2 0 ; elastic co licensing elastic license
rail ; rail ; (?:creativeml |bigscience |bigcode )?open ?rail(?: m)? licen[cs]e ; - ; -
"""

#: Creative Commons licenses are a set of parts and a version; every such pair is a family.
CC_PARTS = (("by", "attribution"), ("by nc", "attribution noncommercial"), ("by sa", "attribution sharealike"), ("by nd", "attribution noderiv[a-z]{1,6}"), ("by nc sa", "attribution noncommercial sharealike"), ("by nc nd", "attribution noncommercial noderiv[a-z]{1,6}"))
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: label ; keyword ; words of the text of a license or notice
TEXTS = """
mit ; hereby ; permission is hereby granted free of charge to any person obtaining a copy of this software
isc ; permission ; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd ; redistribution ; redistribution and use in source and binary forms with or without modification are permitted
bsd-4-clause ; advertising ; all advertising materials mentioning features or use of this software must display
bsd-3-clause ; endorse ; may be used to endorse or promote products derived from this software without specific prior written permission
apache-2.0 ; compliance ; you may not use this file except in compliance with the license
gpl ; redistribute ; this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
lgpl ; redistribute ; this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
agpl ; redistribute ; this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license
gpl ; verbatim ; everyone is permitted to copy and distribute verbatim copies of this license document
mpl-2.0 ; source ; this source code form is subject to the terms of the mozilla public license v 2 0
bsl-1.0 ; obtaining ; obtaining a copy of the software and accompanying documentation covered by this license
zlib ; misrepresented ; the origin of this software must not be misrepresented
unlicense ; unencumbered ; this is free and unencumbered software released into the public domain
public-domain ; domain ; (?:released into|dedicated to|placed in|in) the public domain
proprietary ; reserved ; all rights reserved
proprietary ; prohibited ; unauthorized (?:copying|reproduction|distribution) (?:[^ ]+ ){0,8}?is (?:strictly )?prohibited
proprietary ; confidential ; confidential and proprietary
"""

VERSIONED_GNU = re.compile(r"(?:gpl|lgpl|agpl|gfdl)-\d")


def versioned(name: str) -> str:
    """Writes <2 0> as what may stand for version 2.0; a minor 0 may be left out."""

    def one(m: re.Match) -> str:
        major, _, minor = m[1].partition(" ")
        return f"(?:version |v )?v?{major}" + ("(?: 0)?" if minor == "0" else f" {minor}" if minor else "")

    return re.sub(r"<([\d ]+)>", one, name)


def rules_of(label: str, keyword: str, name: str, identifier: str, address: str) -> Iterator[Rule]:
    """The forms in which a family is cited, best first."""
    need, name = frozenset([keyword]), versioned(name)
    if identifier != "-":
        yield Rule(f"{label}/identifier", label, rf"spdx license identifier (?:[^ ]+ ){{0,6}}?{identifier}", frozenset(["spdx", "identifier", *re.findall(r"^\w+", identifier)]), 2, 1.0)
    if address != "-":
        yield Rule(f"{label}/address", label, address, frozenset(re.findall(r"^\w+", address)), 3, 0.95)
    if VERSIONED_GNU.match(label):
        later = r"(?: only)? (?:or|and) (?:at your option )?(?:any )?(?:later|newer)(?: versions?)?"
        yield Rule(f"{label}/later", f"{label}-or-later", name + later, need, 4, 0.9)
    yield Rule(f"{label}/grant", label, rf"under (?:the |a |an )?(?:terms (?:and conditions )?of (?:the )?)?{name}", need | {"under"}, 5, 0.9)
    yield Rule(f"{label}/name", label, name, need, 6, 0.6)


def _rows(text: str) -> Iterator[list[str]]:
    for line in text.strip().splitlines():
        yield [x.strip() for x in line.split(" ; ")]


def all_rules() -> tuple[Rule, ...]:
    """Signatures of texts, then every family in every form; several hundred rules."""
    found = [Rule(f"{label}/text", label, words, frozenset([keyword]), 1, 1.0) for label, keyword, words in _rows(TEXTS)]
    for row in _rows(FAMILIES):
        found += rules_of(*row)
    for parts, words in CC_PARTS:
        for version in CC_VERSIONS:
            label, spaced = f"cc-{parts.replace(' ', '-')}-{version}", version.replace(".", " ")
            found += rules_of(label, "cc", f"cc {parts} <{spaced}>", f"cc {parts} {spaced}", f"creativecommons org licenses {parts} {spaced}")
            found += [r for r in rules_of(label, "commons", f"creative commons {words} <{spaced}>", "-", "-")]
            found += [r for r in rules_of(label, "commons", f"creative commons {words} <{spaced}> (?:international|unported|generic)(?: public)? licen[cs]e", "-", "-")]
        label = f"cc-{parts.replace(' ', '-')}"
        found += rules_of(label, "cc", f"cc {parts}", "-", f"creativecommons org licenses {parts}") if parts != "by" else ()
        found += rules_of(label, "commons", f"creative commons {words}(?: licen[cs]e)?", "-", "-")
    return tuple(found)


RULES = all_rules()
BASE_WEIGHT = 0.5

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_compiled: dict[str, re.Pattern] = {}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_WORD_BYTES).split()


class Scanner:
    """Rules by the keyword that gates them; patterns are compiled when first needed, once per worker."""

    def __init__(self, rules: Sequence[Rule] = RULES, base: Sequence[tuple[str, str]] = BASE):
        self.rules = [Rule(f"base/{label}", label, re.escape(phrase).replace(r"\ ", " "), frozenset(phrase.split()), 0, BASE_WEIGHT) for phrase, label in base] + list(rules)
        self.n_base = len(base)
        self.needs = [frozenset(w.encode() for w in r.keywords) for r in self.rules]
        self.by_word: dict[bytes, list[int]] = {}
        for i, need in enumerate(self.needs):
            self.by_word.setdefault(min(need, key=lambda w: (-len(w), w)), []).append(i)
        self.words = frozenset(self.by_word)

    def detections(self, words: list[bytes]) -> list[tuple[int, int, int, bool]]:
        """(rule, first word, past the last word, suppressed) of every match, by place."""
        have = set(words)
        gated = sorted(i for w in self.words & have for i in self.by_word[w] if self.needs[i] <= have)
        if not gated:
            return []
        line = b" " + b" ".join(words) + b" "
        spans = []
        for i in gated:
            pattern = self.rules[i].pattern
            if pattern not in _compiled:
                _compiled[pattern] = re.compile(f" (?:{pattern})(?= )".encode())
            spans += [(i, m.start(), m.end()) for m in _compiled[pattern].finditer(line)]
        if not spans:
            return []
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        first, end = (np.searchsorted(spaces, [s[k] for s in spans]).tolist() for k in (1, 2))
        return self.resolved([(i, a, b) for (i, _, _), a, b in zip(spans, first, end, strict=True)])

    def resolved(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool]]:
        """Marks what lies inside a detection that goes before it; one sweep, matches have bounded length."""
        before = lambda x: (self.rules[x[0]].priority, x[1] - x[2], x[0])
        out, open_ = [], []
        for x in sorted(found, key=lambda x: (x[1], -x[2], x[0])):
            if x[0] < self.n_base:
                out.append((*x, False))
                continue
            open_ = [y for y in open_ if y[2] > x[1]]
            # What contains x begins before it, or with it and is as long; of equal intervals all have been seen but later rules.
            out.append((*x, any(y[2] >= x[2] and before(y) < before(x) for y in open_)))
            open_.append(x)
        same: dict[tuple[int, int], tuple] = {}
        for x in out:  # equal intervals: the best of them stays, wherever it stood in the sweep
            if x[0] >= self.n_base and ((x[1], x[2]) not in same or before(x) < same[x[1], x[2]]):
                same[x[1], x[2]] = before(x)
        return [x if x[0] < self.n_base or x[3] or before(x) == same[x[1], x[2]] else (*x[:3], True) for x in out]


DETECTION = "struct<label:string,rule:string,first_word:long,last_word:long,base:boolean,suppressed:boolean>"
_ARROW = pa.list_(pa.struct([("label", pa.string()), ("rule", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base", pa.bool_()), ("suppressed", pa.bool_())]))


def scan(documents: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[tuple[str, str]] = BASE, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, detections, score) of every document; score is the largest weight of what is not suppressed."""
    docs = documents.select(F.col(id_col), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules, base)
        for batch in batches:
            n, found, scores = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                hits = scanner.detections(words)
                n.append(len(words))
                found.append([(scanner.rules[i].label, scanner.rules[i].name, a, b - 1, i < scanner.n_base, gone) for i, a, b, gone in hits])
                scores.append(max([0.0, *(scanner.rules[i].weight for i, _, _, gone in hits if not gone)]))
            rows = [[dict(zip(("label", "rule", "first_word", "last_word", "base", "suppressed"), x, strict=True)) for x in xs] for xs in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(rows, _ARROW), pa.array(scores, pa.float64())], names=[id_col, "n_words", "detections", "score"])

    return docs.mapInArrow(run, f"`{id_col}` {kind}, n_words long, detections array<{DETECTION}>, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base, live = F.filter("detections", lambda x: x["base"]), F.filter("detections", lambda x: ~x["suppressed"])
    starts = F.transform(base, lambda x: x["first_word"])
    labels = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda x: x["label"]))), ",")
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(live).alias("labels"), "score")
