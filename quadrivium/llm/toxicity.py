"""Toxicity: boosted trees over dense lexical features, calibrated isotonically.

Learning, over at most about ``SAMPLE_ROWS`` labelled training rows dealt to
``PARTS`` parts by a hash of their id, alike at every size:

1. a *lexicon* is learned for each part from the other parts: words whose
   document frequency among toxic rows exceeds that among clean rows by a
   smoothed log-odds z-score, in a strong and a weak tier, joined to a short
   fixed list; one more from all rows is the one that texts are scored with;
2. dense features (lexicon densities, distance of lexicon words to
   second-person words, capitals, punctuation, obfuscation rates) are made of
   every row with the lexicon of its part, so that no row is described by words
   learned from itself, and trees are fitted on them;
3. isotonic calibration of scores that each part gets from trees of the others.

A lexicon has every word of three characters or more whose z-score reaches
``least_z``; what bounds it is the bound on labelled rows.

Edge cases: null and empty texts get the score of an all-zero feature row;
texts of any length are read whole; repeated rows score alike; with no
training label at all every score is the neutral prior 0.0001.
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
from .common import fresh, hand_back, id_fold, materialise, small, small_batches, table
from .learning import labelled_sample, with_text

SAMPLE_ROWS = 40_000
PARTS = 3
#: The z-score that a word of a lexicon reaches, and toxic rows that it is in, at least.
LEAST_Z, LEAST_ROWS = 2.0, 4
FOLDS = 5

# Everyday insults used as the seed lexicon, whatever the labels say.
SEED_WORDS = frozenset("bastard clown creep dimwit disgusting dumb fool freak garbage idiot imbecile jerk loser lunatic moron pathetic pig rat scum sucker stupid trash ugly useless vermin worthless".split())
# Second-person words of the corpus languages.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te ton ta tes toi vous votre vos tú ti tuyo usted ustedes vosotros".split())

WORD = re.compile(r"[^\W_]+")
MIXED = re.compile(r"[^\W\d_]+[0-9@$*!#%&+|]+[^\W\d_]+|[0-9@$]+[^\W\d_]{2,}")
STRETCHED = re.compile(r"([^\W\d_])\1\1")
UNLEET = str.maketrans("013457@$!|", "oieastasil", "*#%&+._-~^'")
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SYMBOLS = b"#$%&*+@^_|~<>=\\"
NEAR = 50
NAMES = ("log_words", "seed", "strong", "weak", "hits", "hidden", "nearest", "near_hits", "second", "capitals", "shouted", "bangs", "questions", "punctuation", "symbols", "digits", "mixed", "stretched", "word_length", "non_ascii", "peak", "stems", "stem_hits")


@dataclass(frozen=True)
class Lexicon:
    strong: frozenset
    weak: frozenset
    stems: frozenset = frozenset()


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The dense row of one whole text; all zero when it has no words and no marks."""
    raw = text.encode("utf-8", "replace")
    size = len(raw)
    if not size:
        return [0.0] * len(NAMES)
    without = lambda chars: size - len(raw.translate(None, chars))
    cased = WORD.findall(text)
    words = [w.lower() for w in cased]
    n = max(1, len(words))
    strong, weak = lexicon.strong, lexicon.weak
    hits = [i for i, w in enumerate(words) if w in strong]
    seeds = sum(words[i] in SEED_WORDS for i in hits)
    soft = sum(w in weak for w in words)
    stems = lexicon.stems
    stemmed = sum(len(w) > 6 and (w[:5] in stems or w[:6] in stems) for w in words) if stems else 0
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    nearest, near_hits, peak = NEAR, 0, 0
    if hits:
        at = np.array(hits)
        peak = int((np.searchsorted(at, at + NEAR) - np.arange(len(at))).max())
        if second:
            you = np.array(second)
            right = np.searchsorted(you, at)
            gap = np.minimum(np.abs(at - you[np.minimum(right, len(you) - 1)]), np.abs(at - you[np.maximum(right - 1, 0)]))
            nearest, near_hits = int(min(NEAR, gap.min())), int((gap <= 5).sum())
    mixed = MIXED.findall(text) if without(SYMBOLS + DIGITS) else []
    hidden = sum(m.lower().translate(UNLEET) in strong for m in mixed)
    hidden += sum(STRETCHED.sub(r"\1", w) in strong for w in words if len(w) > 4 and STRETCHED.search(w)) if STRETCHED.search(text) else 0
    shouted = sum(w.isupper() and len(w) > 1 for w in cased) if without(UPPER) > n // 50 else 0
    return [
        float(np.log1p(len(words))), seeds / n, len(hits) / n, soft / n, float(np.log1p(len(hits))), float(hidden), float(NEAR - nearest), near_hits / n, len(second) / n,
        without(UPPER) / size, shouted / n, raw.count(b"!") / size, raw.count(b"?") / size, without(PUNCTUATION) / size, without(SYMBOLS) / size, without(DIGITS) / size,
        len(mixed) / n, sum(1 for _ in STRETCHED.finditer(text)) / n, size / n, 1 - len(text) / size, float(peak), stemmed / n, float(np.log1p(stemmed)),
    ]


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    forest: gbt.Forest
    calibrate: gbt.Isotonic

    def score(self, texts: pd.Series) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        x = np.array([features(t if t is not None else "", self.lexicon) for t in texts])
        return self.calibrate(self.forest.probability(x))


def learn_lexicons(rows: DataFrame, least_z: float = LEAST_Z) -> list[Lexicon]:
    """Of (part, text, y), a lexicon for each part from the rows of the others, and last one from all rows.

    Words are counted per batch on the executors, then summed by Spark; a part's counts are taken off the whole.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            slots = 2 * batch["part"] + (batch["y"] > 0)
            for at in range(0, len(batch), 500):  # a few texts at a time: their words are many
                seen: dict[int, Counter] = {}
                for slot, text in zip(slots[at : at + 500], batch["text"][at : at + 500], strict=True):
                    found = {w for w in WORD.findall(text.lower()) if len(w) >= 3}
                    seen.setdefault(slot, Counter()).update(found | {w[:k] + "*" for w in found if len(w) > 6 for k in (5, 6)})
                for slot, counts in seen.items():
                    yield pd.DataFrame({"word": list(counts), "slot": slot, "n": list(counts.values())})
            hand_back()

    sizes = {r["part"]: (float(r["t"]), float(r["n"] - r["t"])) for r in rows.groupBy("part").agg(F.sum("y").alias("t"), F.count("*").alias("n")).collect()}
    every = [F.sum(F.when(F.col("slot") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(2 * PARTS)]
    toxic_rows = sum((F.col(f"n{2 * p + 1}") for p in range(PARTS)), F.lit(0))
    counts = rows.select("part", "text", "y").mapInPandas(count, "word string, slot int, n long").groupBy("word").agg(*every).where(toxic_rows >= LEAST_ROWS)
    total = [sum((F.col(f"n{2 * p + side}") for p in range(PARTS)), F.lit(0)) for side in (0, 1)]
    counts = materialise(counts.select("word", *[(total[side] - (F.col(f"n{2 * p + side}") if p < PARTS else 0)).alias(f"{'ba'[side]}{p}") for p in range(PARTS + 1) for side in (0, 1)]), "words")
    out = []
    for p in range(PARTS + 1):
        toxic, clean = (sum(x[side] for part, x in sizes.items() if part != p) for side in (0, 1))
        out.append(_lexicon(counts.select("word", F.col(f"a{p}").alias("a"), F.col(f"b{p}").alias("b")), toxic, clean, least_z))
    return out


def _lexicon(counts: DataFrame, toxic: float, clean: float, least_z: float) -> Lexicon:
    """The lexicon of (word, a, b): in how many of ``toxic`` and ``clean`` rows a word is."""
    if not toxic or not clean:
        return Lexicon(SEED_WORDS, frozenset())
    odds = F.log((F.col("a") + 0.5) / (toxic - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (clean - F.col("b") + 0.5))
    z = odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    best = counts.where(F.col("a") >= LEAST_ROWS).withColumn("z", z).where(F.col("z") >= least_z).orderBy(F.desc("z"), "word").collect()  # words of the bounded sample of labelled rows
    # Strong: at least a fiftieth of the toxic rows have the word and nearly no clean row does.
    enough = max(LEAST_ROWS, toxic / 50)
    stems = frozenset(r["word"][:-1] for r in best if r["word"][-1] == "*" and r["z"] >= 4 and r["a"] >= enough)
    best = [r for r in best if r["word"][-1] != "*"]
    strong = {r["word"] for r in best if r["z"] >= 2.5 and r["a"] >= enough and r["b"] * 20 * toxic <= r["a"] * clean}
    return Lexicon(frozenset(strong) | SEED_WORDS, frozenset(r["word"] for r in best) - strong, stems)


def cross_fitted(x: np.ndarray, y: np.ndarray, part: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """A score of every row by trees that were fitted on the other parts."""
    raw = np.zeros(len(y))
    for p in range(parts):
        own = part == p
        if own.any():
            raw[own] = gbt.fit(x[~own], y[~own]).probability(x[own])
    return raw


def train(documents: DataFrame, labels: DataFrame, train_rows: Column, text_col: str = "text", id_col: str = "doc_id", label: str = "toxic", sample_rows: int = SAMPLE_ROWS, least_z: float = LEAST_Z) -> Model:
    sample = labelled_sample(labels, label, id_col, train_rows, sample_rows)
    rows = with_text(documents, sample, text_col, id_col).select(F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(PARTS)).cast("int").alias("part"), "text", "y")
    lexicons = learn_lexicons(rows, least_z)

    def dense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"part": batch["part"], "y": batch["y"], "x": [features(t, lexicons[p]) for t, p in zip(batch["text"], batch["part"], strict=True)]})
            hand_back()

    got = rows.mapInPandas(dense, "part int, y double, x array<double>").toPandas()
    x = np.array(got["x"].tolist(), dtype=float).reshape(len(got), len(NAMES))
    y, part = got["y"].to_numpy(float), got["part"].to_numpy()
    return Model(lexicons[-1], gbt.fit(x, y), gbt.isotonic(cross_fitted(x, y, part), y))


def score(documents: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Score column for ``documents[text_col]``: an Arrow batch at a time, the model shipped once a task."""
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shipped.value
        for texts in batches:
            yield pd.Series(own.score(texts))
            hand_back()

    return scored(F.col(text_col))


def toxicity(documents: DataFrame, labels: DataFrame, train_rows: Column | None = None, text_col: str = "text", id_col: str = "doc_id", cut: float = 0.5) -> DataFrame:
    """(id, score, predicted) of every document; ``train_rows`` says which label rows may be learned from."""
    model = train(documents, labels, F.lit(True) if train_rows is None else train_rows, text_col, id_col)
    return documents.select(id_col, score(documents, model, text_col).alias("score")).withColumn("predicted", (F.col("score") >= cut).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity(documents, table(spark, sf_dir, "labels"), id_fold("doc_id", FOLDS) != 0)
    return out.select("doc_id", (id_fold("doc_id", FOLDS) == 0).alias("held_out"), "score", "predicted")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted toxic go, each judged by its own text; columns stay as they are."""
    id_, fp = fresh("of_id", docs), fresh("of_fp", docs)
    with small_batches(spark):
        model = train(docs, table(spark, sf_dir, "labels"), id_fold("doc_id", FOLDS) != 0)
        toxic = docs.where(score(docs, model) >= 0.5).select(F.col("doc_id").alias(id_), F.xxhash64("text").alias(fp)).distinct()
        toxic = materialise(toxic, "toxic")
    return docs.join(small(toxic, toxic.count(), 24), F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(fp)), "left_anti")
