"""Quality classifier: histogram boosted trees over document statistics.

Statistics of one whole text (lengths, character classes, line shapes,
repetition, function-word share) feed the ensemble of ``gbt``; no word
identities beyond the fixed function words enter a score.

Edge cases: null and empty texts get the score of an all-zero row; texts of
any length are read whole; repeated rows score alike; without a single
training label every score is the neutral prior 0.0001.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import hand_back, id_fold, table
from .learning import labelled_sample, with_text

SAMPLE_ROWS = 40_000
FOLDS, HELD = 4, 2
CUT = 0.7

# Frequent function words of the corpus languages.
FUNCTION_WORDS = frozenset("the of and to in is that it for as was with be by on not are this or an at de la le les des et en un une que el los las por con para su der die das und ist ein eine zu von mit den sich auf für nicht".split())
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
SYMBOLS = b"#$%&*+@^_|~<>=\\{}[]"
REPEATED_MARK = re.compile(r"([^\w\s])\1")
NAMES = ("log_words", "log_bytes", "word_length", "word_length_sd", "longest", "unique", "function", "upper", "shouted", "digits", "symbols", "pipes", "bangs", "stops", "commas", "spaces", "non_ascii", "repeated_marks", "marked_words", "lines", "line_words", "line_sd", "ended", "double_lines", "double_share", "pair_share", "top_word", "short_lines", "root_ratio")


def features(text: str) -> list[float]:
    raw = text.encode("utf-8", "replace")
    size = len(raw)
    words = text.split()
    if not size or not words:
        return [0.0] * len(NAMES)
    n = len(words)
    without = lambda chars: size - len(raw.translate(None, chars))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    per_line = np.array([x.count(" ") + 1 for x in lines])
    line_counts = Counter(lines)
    repeated = [x for x, c in line_counts.items() if c > 1]
    pairs = len(set(zip(words, words[1:]))) / max(1, n - 1)
    marks = sum(len(w) > 1 and w[-1] == w[-2] and not w[-1].isalnum() for w in words)
    return [
        float(np.log1p(n)), float(np.log1p(size)), float(lengths.mean()), float(lengths.std()), float(np.log1p(lengths.max())), len(counts) / n, sum(counts[w] for w in FUNCTION_WORDS) / n,
        without(UPPER) / size, sum(w.isupper() and len(w) > 1 for w in words) / n, without(DIGITS) / size, without(SYMBOLS) / size, raw.count(b"|") / n, raw.count(b"!") / n, raw.count(b".") / n, raw.count(b",") / n,
        without(b" \n\t") / size, 1 - len(text) / size, sum(1 for _ in REPEATED_MARK.finditer(text)) / n, marks / n, float(np.log1p(len(lines))), float(per_line.mean()), float(per_line.std()),
        sum(x.rstrip()[-1] in ".!?" for x in lines) / len(lines), len(repeated) / len(lines), sum(line_counts[x] for x in repeated) / len(lines), pairs, max(counts.values()) / n, float((per_line < 3).mean()), len(counts) / (1 + np.sqrt(n)),
    ]


@dataclass(frozen=True)
class Model:
    forest: gbt.Forest

    def score(self, texts: pd.Series) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        return self.forest.probability(np.array([features(t if t is not None else "") for t in texts]))


def train(documents: DataFrame, labels: DataFrame, train_rows: Column, text_col: str = "text", id_col: str = "doc_id", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Features of the sampled rows are made on the executors; the trees are fitted from at most about ``sample_rows`` of them."""
    rows = with_text(documents, labelled_sample(labels, label, id_col, train_rows, sample_rows), text_col, id_col)

    def dense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "x": [features(t) for t in batch["text"]]})

    part = rows.select("y", "text").mapInPandas(dense, "y double, x array<double>").toPandas()
    x = np.array(part["x"].tolist(), dtype=float).reshape(len(part), len(NAMES))
    return Model(gbt.fit(x, part["y"].to_numpy(float), trees=100))


def score(documents: DataFrame, model: Model, text_col: str = "text") -> Column:
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shipped.value
        for texts in batches:
            yield pd.Series(own.score(texts))
            hand_back()

    return scored(F.col(text_col))


def quality(documents: DataFrame, labels: DataFrame, train_rows: Column | None = None, text_col: str = "text", id_col: str = "doc_id", cut: float = CUT) -> DataFrame:
    """(id, score, predicted) of every document."""
    model = train(documents, labels, F.lit(True) if train_rows is None else train_rows, text_col, id_col)
    return documents.select(id_col, score(documents, model, text_col).alias("score")).withColumn("predicted", (F.col("score") >= cut).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality(documents, table(spark, sf_dir, "labels"), id_fold("doc_id", FOLDS) != HELD)
    return out.select("doc_id", (id_fold("doc_id", FOLDS) == HELD).alias("held_out"), "score", "predicted")
