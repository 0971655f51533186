"""Similar titles of a group by an exact filter-and-verify join; no pair is made that shares no rare part.

Two titles that reach a similarity have many q-grams in common: a matched run
of characters keeps its q-grams, and the bound on unmatched characters bounds
how many are lost.  With the q-grams of every title ordered from rare to common
in its group, titles that must share ``o`` of ``n`` have one in common among the
first ``n - o + 1`` of either.  Only those are posted, in lists by q-gram and
class of length; pairs that meet in a list pass bounds by length and by letter
counts before the similarity itself is computed, once a pair.  Lists longer
than ``BLOCK`` are joined block by block, so no task holds a whole list.
Groups and long lists whose titles all belong to one numbered series have no
pair and are left out.  Titles and what they post are written once, since both
sides of the join and the lengths of lists are read from them.

Titles for which trigrams prove nothing (a few short ones) meet by bigrams or
single letters instead.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import DUPLICATE, edit_similarity, letter_counts, may_reach, may_share, similarity
from ..functions.text import without_numbers
from ..sources.shared import written

#: Most rows of a list that meet as a whole; longer ones are cut into blocks of about so many.
BLOCK = 2000
GRAMS = (3, 2, 1)
LIST = ["group", "q", "gram", "nth", "class"]


def least_shared(q: int, x: int, y: int, least: float, exact: bool) -> int:
    """How many q-grams texts of ``x`` and ``y`` characters share, repeats counted, if they reach ``least``; may be negative.

    ``exact``: ratio of matched characters, in order: M of each are matched; a character of the one without partner
    breaks q q-grams, one of the other stands between and breaks q - 1.  Else by edit distance: k edits break q each.
    """
    if exact:
        m = math.ceil(least * (x + y) / 200 - 1e-9)
        return (2 * q - 1) * m - (q - 1) * (x + y) - q + 1
    k = math.floor((1 - least / 100) * max(x, y) + 1e-9)
    return max(x, y) - q + 1 - k * q


def widest(least: float, exact: bool) -> float:
    """How many times as long as the other the longer of two similar titles can be."""
    return (200 - least) / least if exact else 100 / least


@lru_cache(maxsize=100_000)
def kept(x: int, least: float, exact: bool) -> tuple[tuple[int, int], ...]:
    """(q, how many of the rarest q-grams) that a title of ``x`` characters posts: for each possible length of the other, the largest q that proves something."""
    most: dict[int, int] = {}
    for y in range(max(1, math.ceil(x / widest(least, exact) - 1e-9)), math.floor(x * widest(least, exact) + 1e-9) + 1):
        for q in GRAMS:
            if (shared := least_shared(q, x, y, least, exact)) > 0:
                most[q] = max(most.get(q, 0), x - q + 1 - shared + 1)
                break
        else:
            raise ValueError(f"a similarity of {least} is too low for texts of {x} and {y} characters: nothing need be shared")
    return tuple(most.items())


def _grams(least: float, exact: bool) -> Column:
    """array of (q, gram, nth, keep) of a lower-case title; nth tells repeats of a gram apart."""

    def of(title: str) -> list[tuple[int, str, int, int]]:
        out = []
        for q, keep in kept(len(title), least, exact) if title else ():
            seen: Counter[str] = Counter()
            for i in range(len(title) - q + 1):
                gram = title[i : i + q]
                out.append((q, gram, seen[gram], keep))
                seen[gram] += 1
        return out

    def batch(titles: pd.Series) -> pd.Series:
        return titles.map(of)

    return F.explode(F.pandas_udf(batch, "array<struct<q: int, gram: string, nth: int, keep: int>>")("low"))


def posted(titles: DataFrame, least: float, exact: bool) -> DataFrame:
    """(group, title, size, q, gram, nth): the rarest q-grams of every title."""
    grams = titles.select("group", "title", _grams(least, exact).alias("g")).select("group", "title", "g.*")
    token = ["group", "q", "gram", "nth"]
    counted = grams.join(grams.groupBy(*token).agg(F.count("*").alias("df")), token)
    lists = counted.groupBy("group", "title", "q", "keep").agg(F.array_sort(F.collect_list(F.struct("df", "gram", "nth"))).alias("grams"))
    return lists.select("group", "title", "q", F.explode(F.slice("grams", F.lit(1), F.col("keep"))).alias("g")).select("group", "title", "q", "g.gram", "g.nth")


def candidates(rows: DataFrame, least: float, exact: bool, block: int = BLOCK) -> DataFrame:
    """(group, ta, tb), ta < tb, of distinct titles (group, title) that may be similar and are no numbered series."""
    varied = rows.groupBy("group").agg(F.min(without_numbers("title")).alias("lo"), F.max(without_numbers("title")).alias("hi")).where("lo < hi")
    titles = rows.join(varied.select("group"), "group", "left_semi").select("group", "title", F.lower("title").alias("low"), without_numbers("title").alias("plain"), letter_counts("title").alias("letters"))
    titles = written(titles.withColumn("size", F.length("low")), "titles")
    step = math.log(widest(least, exact) * 1.0001)
    # Titles of similar lengths are in the same class of length or in neighbouring ones.
    of_length = F.floor(F.log("size") / step).cast("int")
    posts = written(posted(titles, least, exact), "posts").join(titles.select("group", "title", "plain", "letters", "size"), ["group", "title"]).withColumn("own", of_length)
    left = posts.withColumn("class", F.col("own"))
    right = posts.withColumn("class", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)))
    # A list longer than a block is cut; each block of one side meets each of the other in a cell of its own.
    long = written(right.groupBy(*LIST).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), (F.min("plain") < F.max("plain")).alias("varied")).where("blocks > 1"), "long-lists")
    cut = lambda side: side.join(long, LIST, "left").where("varied is null or varied").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("at", F.pmod(F.xxhash64("title"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    side = lambda x, n: [F.col(c).alias(f"{c}_{n}") for c in ("title", "plain", "letters", "size")]
    a = cut(left).withColumn("to", every).select(*LIST, F.col("at").alias("i"), F.col("to").alias("j"), *side(left, "a"))
    b = cut(right).withColumn("to", every).select(*LIST, F.col("to").alias("i"), F.col("at").alias("j"), *side(right, "b"))
    near = 200.0 * F.least("size_a", "size_b") >= least * (F.col("size_a") + F.col("size_b"))
    met = a.join(b, [*LIST, "i", "j"]).where((F.col("title_a") < F.col("title_b")) & (F.col("plain_a") != F.col("plain_b")) & near & may_share("letters_a", "letters_b", least))
    return met.select("group", F.col("title_a").alias("ta"), F.col("title_b").alias("tb")).distinct()


def similar_titles(rows: DataFrame, least: float = DUPLICATE, group: str = "course_id", title: str = "title", exact: bool = True, block: int = BLOCK) -> DataFrame:
    """(group, ta, tb, ab, ba) of distinct titles of a group, ta < tb, that are similar in one order at least.

    The ratio is not symmetric, so both orders are given.  Titles that differ in numbers of a series only are no
    pair.  Null titles and groups are in no pair.
    """
    distinct = rows.select(F.col(group).alias("group"), F.col(title).alias("title")).where("group is not null and title is not null").distinct()
    measure = similarity if exact else edit_similarity
    found = candidates(distinct, least, exact, block).withColumns({"ab": measure("ta", "tb"), "ba": measure("tb", "ta")})
    return found.where((F.col("ab") >= least) | (F.col("ba") >= least)).select(F.col("group").alias(group), "ta", "tb", "ab", "ba")


def title_classes(rows: DataFrame, least: float = DUPLICATE, group: str = "course_id", key: str = "pos", title: str = "title", exact: bool = True) -> DataFrame:
    """(group, ta, tb, similarity, na, nb, pairs): similar titles once for all rows that have them.

    ``ta`` = ``tb`` stands for rows of one title.  ``pairs``: how many pairs of rows, the earlier by ``key`` first,
    reach ``least``.  Both orders of two titles mostly do, and then that is a product; only where one order alone
    does are rows counted, and each title then needs its earlier rows of the other: a rank, not the pairs.
    """
    n = rows.where(F.col(group).isNotNull() & F.col(title).isNotNull()).groupBy(F.col(group).alias("g"), F.col(title).alias("t")).agg(F.count("*").alias("n"))
    same = n.where("n > 1").select(F.col("g").alias("group"), F.col("t").alias("ta"), F.col("t").alias("tb"), F.lit(100.0).alias("similarity"), F.col("n").alias("na"), F.col("n").alias("nb"), (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"))
    pairs = written(similar_titles(rows, least, group, title, exact).withColumnRenamed(group, "group"), "similar")
    sized = lambda c, name: n.select(F.col("g").alias("group"), F.col("t").alias(c), F.col("n").alias(name))
    apart = pairs.join(sized("ta", "na"), ["group", "ta"]).join(sized("tb", "nb"), ["group", "tb"])
    both = (F.col("ab") >= least) & (F.col("ba") >= least)
    keys = rows.select(F.col(group).alias("group"), F.col(title).alias("t"), F.col(key).alias("k"))
    one_way = apart.where(~both)
    ordered = _earlier(one_way, keys, least)
    out = apart.join(ordered, ["group", "ta", "tb"], "left").select("group", "ta", "tb", F.greatest("ab", "ba").alias("similarity"), "na", "nb", F.when(both, F.col("na") * F.col("nb")).otherwise(F.coalesce("earlier", F.lit(0))).cast("long").alias("pairs"))
    return out.unionByName(same).withColumnRenamed("group", group)


def _earlier(one_way: DataFrame, keys: DataFrame, least: float) -> DataFrame:
    """(group, ta, tb, earlier): of pairs similar in one order alone, how many pairs of rows are in that order."""
    from pyspark.sql import Window

    forward = F.col("ab") >= least
    sides = one_way.select("group", "ta", "tb", F.explode(F.array(F.struct(F.col("ta").alias("t"), forward.alias("goes_first")), F.struct(F.col("tb").alias("t"), (~forward).alias("goes_first")))).alias("s")).select("group", "ta", "tb", "s.t", "s.goes_first")
    rows = sides.join(keys, ["group", "t"])
    before = Window.partitionBy("group", "ta", "tb").orderBy("k").rangeBetween(Window.unboundedPreceding, -1)
    counted = rows.withColumn("firsts", F.sum(F.col("goes_first").cast("long")).over(before))
    return counted.where(~F.col("goes_first")).groupBy("group", "ta", "tb").agg(F.sum(F.coalesce("firsts", F.lit(0))).alias("earlier"))
