"""Token counts by offset-mapped attribution.

A whole document is encoded once; token byte lengths give token character
spans, which an interval join (binary search over sorted section starts)
assigns to the sections of the text.  A token that crosses a boundary is
allocated by an explicit rule:

``start``  to the section of its first character (the rule of the registered query),
``end``    to the section of its last character,
``most``   to the section with most of its characters, the earlier among equals,
``share``  to every section it touches, by its share of the token's characters.

A token that begins inside a character counts from that character on.

Edge cases: null counts as empty; a text always has a section, the empty text
one of no tokens; sections may be empty; characters outside every section are
counted under section -1; repeated rows are counted each.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOCABULARY = "byte_bpe_50k.tiktoken"
RULES = ("start", "end", "most", "share")
_loaded: dict[str, tuple[tiktoken.Encoding, np.ndarray]] = {}


def encoding(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The tokenizer and the byte length of each id; once per worker process."""
    if path not in _loaded:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _loaded[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths
    return _loaded[path]


def token_spans(text: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end character of every token of the whole text."""
    own, lengths = encoding(path)
    ids = np.array(own.encode_ordinary(text), dtype=np.int64)
    ends = np.cumsum(lengths[ids]) if len(ids) else np.zeros(0, dtype=np.int64)
    starts = ends - lengths[ids] if len(ids) else ends
    raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    if len(raw) == len(text):
        return starts, ends
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    return char[starts], char[ends - 1] + 1


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines with their newline; the rest after a last newline is a section only if not empty."""
    ends = [i + 1 for i in _newlines(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return np.array([0, *ends[:-1]], dtype=np.int64), np.array(ends, dtype=np.int64)


def _newlines(text: str) -> Iterator[int]:
    at = text.find("\n")
    while at >= 0:
        yield at
        at = text.find("\n", at + 1)


def attribute(starts: np.ndarray, ends: np.ndarray, left: np.ndarray, right: np.ndarray, rule: str) -> tuple[np.ndarray, float]:
    """Tokens per section, and those outside all; sections sorted and disjoint."""
    counts, outside = np.zeros(len(left)), 0.0
    if not len(starts) or not len(left):
        return counts, float(len(starts))
    at = lambda p: np.where((k := np.searchsorted(left, p, "right") - 1) >= 0, np.where(p < right[np.maximum(k, 0)], k, -1), -1)
    if rule in ("start", "end"):
        k = at(starts if rule == "start" else ends - 1)
        return counts + np.bincount(k[k >= 0], minlength=len(left)), float((k < 0).sum())
    first, last = at(starts), at(ends - 1)
    simple = (first == last) & (first >= 0)
    counts += np.bincount(first[simple], minlength=len(left))
    for s, e in zip(starts[~simple], ends[~simple], strict=True):
        lo, hi = np.searchsorted(right, s, "right"), np.searchsorted(left, e, "left")
        own = np.minimum(right[lo:hi], e) - np.maximum(left[lo:hi], s)
        gap = (e - s) - own.sum()
        if rule == "share":
            counts[lo:hi] += own / (e - s)
            outside += gap / (e - s)
        elif len(own) and own.max() >= gap:
            counts[lo + int(own.argmax())] += 1
        else:
            outside += 1
    return counts, outside


def count_tokens(documents: DataFrame, sections: Callable[[str], tuple[np.ndarray, np.ndarray]] = line_sections, rule: str = "start", text_col: str = "text", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """(id, section, char_start, char_end, n_tokens, doc_tokens) for every section of every document."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or public_tokenizers.path(VOCABULARY)
    docs = documents.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    names = [id_col, "section", "char_start", "char_end", "n_tokens", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple] = []
            size = first = 0
            for row, text in enumerate(batch.column(1)):
                text = text.as_py()
                starts, ends = token_spans(text, path)
                left, right = sections(text)
                counts, outside = attribute(starts, ends, left, right, rule)
                number = np.arange(len(left))
                if outside:
                    number, left, right, counts = np.append(number, -1), np.append(left, 0), np.append(right, len(text)), np.append(counts, outside)
                parts.append((number, left, right, counts, np.full(len(number), len(starts))))
                size += len(number)
                if size >= 50_000:
                    yield gathered(batch, first, parts)
                    parts, size, first = [], 0, row + 1
            if parts:
                yield gathered(batch, first, parts)

    def gathered(batch: pa.RecordBatch, first: int, parts: list[tuple]) -> pa.RecordBatch:
        """Ids are taken from the batch as they are, each as often as its document has sections."""
        rows = np.repeat(np.arange(first, first + len(parts)), [len(p[0]) for p in parts])
        columns = [np.concatenate([p[i] for p in parts]) for i in range(5)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.mapInArrow(run, f"`{id_col}` {kind}, section long, char_start long, char_end long, n_tokens double, doc_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = count_tokens(table(spark, sf_dir, "documents"))
    return out.withColumn("n_tokens", F.col("n_tokens").cast("long"))
