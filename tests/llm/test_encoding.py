import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrivium.llm import piece_encoding as pe
from quadrivium.llm import token_attribution as ta
from tests.llm.conftest import EDGES

ENCODER = pe.encoder(pe.model_path())
PATH = ta.public_tokenizers.path(ta.VOCABULARY)
TEXT = st.text(alphabet=st.one_of(st.sampled_from(list("  \n\tabcdeéß▁.,!012日本🙂")), st.characters(blacklist_categories=("Cs",))), max_size=80)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_pieces_as_the_library(text):
    assert list(ENCODER.encode(text)) == ENCODER.library.encode(text) + [ENCODER.end]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(ENCODER.piece[259:]), max_size=12))
def test_pieces_of_pieces(parts):
    text = "".join(parts)
    assert list(ENCODER.encode(text)) == ENCODER.library.encode(text) + [ENCODER.end]


@pytest.mark.parametrize("text", ["", " ", " " * 100, "a" * 5000, "ab0Zü" * 3000, "word " * 5000, "<s></s><0x0A>", "\x00\x01"])
def test_pieces_extreme(text):
    ids = ENCODER.encode(text)
    assert list(ids) == ENCODER.library.encode(text) + [ENCODER.end] and ENCODER.decode(ids) == ENCODER.library.decode(ENCODER.library.encode(text))


def test_caches_stay_bounded(monkeypatch):
    monkeypatch.setattr(pe, "CACHED_SEGMENTS", 3)
    monkeypatch.setattr(pe, "CACHED_PAIRS", 5)
    own = pe.PieceEncoder(pe.model_path())
    text = "one two three four five six seven eight"
    assert list(own.encode(text)) == own.library.encode(text) + [own.end] and len(own.segments) <= 3 and len(own.pairs) <= 5


def test_encode_documents(spark, edges, nothing):
    rows = pe.encode_documents(edges).collect()
    assert len(rows) == len(EDGES)
    want = sorted((str(d), ENCODER.library.encode(t or "") + [2], ENCODER.library.decode(ENCODER.library.encode(t or ""))) for d, t in EDGES)
    assert sorted((str(r.doc_id), list(r.ids), r.decoded) for r in rows) == want
    again = pe.decode_documents(pe.encode_documents(edges)).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in again) == sorted((a, c) for a, _, c in want)
    assert pe.encode_documents(nothing).count() == 0
    r = pe.digests(pe.encode_documents(edges.where("doc_id = 5"))).first()
    ids = ENCODER.library.encode("same  text here") + [2]
    assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(b"same  text here").hexdigest())


def brute_spans(text):
    """Character spans token by token from the bytes each id stands for."""
    own, lengths = ta.encoding(PATH)
    at, out = 0, []
    chars = [i for i, c in enumerate(text) for _ in c.encode()]
    for i in own.encode_ordinary(text):
        n = int(lengths[i])
        out.append((chars[at], chars[at + n - 1] + 1))
        at += n
    return out


@settings(max_examples=150, deadline=None)
@given(TEXT, st.lists(st.integers(0, 80), max_size=6), st.sampled_from(ta.RULES))
def test_attribution_against_brute_force(text, cuts, rule):
    spans = brute_spans(text)
    starts, ends = ta.token_spans(text, PATH)
    assert [(int(a), int(b)) for a, b in zip(starts, ends)] == spans
    edges_ = sorted({min(c, len(text)) for c in cuts})
    sections = [(a, b) for k, (a, b) in enumerate(zip(edges_, edges_[1:])) if k % 3 != 1]  # with gaps
    left, right = np.array([a for a, _ in sections], dtype=np.int64), np.array([b for _, b in sections], dtype=np.int64)
    counts, outside = ta.attribute(starts, ends, left, right, rule)
    want, rest = [0.0] * len(sections), 0.0
    for s, e in spans:
        own = [sum(a <= c < b for c in range(s, e)) for a, b in sections]
        gap = (e - s) - sum(own)
        if rule in ("start", "end"):
            c = s if rule == "start" else e - 1
            k = next((i for i, (a, b) in enumerate(sections) if a <= c < b), None)
            want, rest = ([w + (i == k) for i, w in enumerate(want)], rest + (k is None))
        elif rule == "share":
            want, rest = [w + o / (e - s) for w, o in zip(want, own)], rest + gap / (e - s)
        elif own and max(own) and max(own) >= gap:
            want[own.index(max(own))] += 1
        else:
            rest += 1
    assert counts == pytest.approx(want) and outside == pytest.approx(rest) and counts.sum() + outside == pytest.approx(len(spans))


def test_count_tokens(spark, edges, nothing):
    rows = ta.count_tokens(edges).collect()
    own, _ = ta.encoding(PATH)
    totals = {}
    for r in rows:
        totals.setdefault(r.doc_id, []).append(r)
    assert sum(r.n_tokens for r in totals[6]) == len(own.encode_ordinary("Word " * 20_000)) == totals[6][0].doc_tokens
    assert [(r.section, r.char_start, r.char_end, r.n_tokens) for r in totals[2]] == [(0, 0, 0, 0.0)]
    assert [(r.section, r.char_start, r.char_end) for r in sorted(totals[3], key=lambda r: r.section)] == [(0, 0, 2), (1, 2, 3)]
    assert ta.count_tokens(nothing).count() == 0
    with pytest.raises(ValueError):
        ta.count_tokens(edges, rule="none")
    shared = ta.count_tokens(edges.where("doc_id = 8"), sections=lambda t: (np.array([0]), np.array([3])), rule="share").collect()
    assert sum(r.n_tokens for r in shared) == pytest.approx(shared[0].doc_tokens) and {r.section for r in shared} == {0, -1}


@pytest.mark.parametrize("more", [[], [(None, "no id\nat all")]])
def test_token_counts_keep_large_ids(spark, more):
    rows = [(2**53 + 1, "a b\nc"), (2**53 + 3, ""), (2**63 - 1, None)] + more
    got = ta.count_tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted({r.doc_id for r in got}, key=lambda x: (x is None, x or 0)) == [r[0] for r in rows]
    assert [(r.section, r.char_start, r.char_end) for r in got if r.doc_id == 2**53 + 1] == [(0, 0, 4), (1, 4, 5)]
