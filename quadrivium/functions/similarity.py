"""Title similarity on a 0-100 scale."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, once

DUPLICATE = 85.0
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a.lower(), b.lower()).ratio() * 100


def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)])


def similarity(a: Column | str, b: Column | str) -> Column:
    return F.pandas_udf(ratios, "double")(col(a), col(b))


def may_reach(a: Column | str, b: Column | str, least: float = DUPLICATE) -> Column:
    """Exact upper bound of ``ratio`` from the lengths alone: 2 min / (sum)."""
    x, y = F.length(F.lower(col(a))), F.length(F.lower(col(b)))
    return 200.0 * F.least(x, y) >= least * (x + y)


def letter_counts(x: Column | str) -> Column:
    """How often each of a-z, and anything else, occurs in a title: what ``may_share`` needs of it."""
    def of(t: Column) -> Column:
        letters = [F.length(t) - F.length(F.replace(t, F.lit(c), F.lit(""))) for c in LETTERS]
        return F.array(*letters, F.length(F.regexp_replace(t, "[a-z]", "")))

    return once(F.lower(col(x)), of)


def may_share(a: Column | str, b: Column | str, least: float = DUPLICATE) -> Column:
    """Exact upper bound of ``ratio`` from the letter counts of two titles: what they have in common in any order."""
    total = lambda v: F.aggregate(v, F.lit(0), lambda s, n: s + n)
    shared = total(F.zip_with(col(a), col(b), lambda x, y: F.least(x, y)))
    return 200.0 * shared >= least * (total(col(a)) + total(col(b)))


def edit_similarity(a: Column | str, b: Column | str) -> Column:
    """A JVM-side variant by edit distance; a different measure from ``ratio``."""
    x, y = F.lower(col(a)), F.lower(col(b))
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, 100.0).otherwise(100.0 * (1 - F.levenshtein(x, y) / longest))
