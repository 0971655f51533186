"""Spelling variants: words that differ by one letter, grouped without making pairs.

Words are counted over all texts.  Two words are near if one inserted, deleted
or replaced code point turns one into the other.

* Replacements: every word is put into a group for each of its places, named by
  what stands before and after the place.  A group keeps its size and its two
  most frequent words, and that is all its members need: a member's neighbours
  there are the others, and the best of them is the first of the two, or the
  second for the first itself.  A group has a word for each letter at most.
* Insertions and deletions: the distinct results of deleting one code point
  join the vocabulary.  A match counts for both words; a word has at most as
  many matches as code points.

Counts and best neighbours of both kinds are added up by word.  A word's form
is its most frequent neighbour (ties: the smallest word) if that is at least
``ratio`` times as frequent.  Frequencies at least double along a chain of
forms, so chains end, and roots are found by pointer doubling.

Edge cases: a null text has no words; a null id is written as '' where runs are
hashed; repeated rows count each; a table without words gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, table

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_SEEN, RATIO = 5, 3, 2
#: One run in so many loses a code point before it is counted.
SLIPS = 97
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; texts of ASCII go the faster way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def runs(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, run): every maximal run of letters, A-Z lower-cased."""
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return documents.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))


def with_slips(rows: DataFrame, one_in: int = SLIPS) -> DataFrame:
    """(word): runs, of which those whose hash with the id is divisible by ``one_in`` lose a code point."""
    hashed = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    without = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return hashed.select(F.when(F.col("h") % one_in == 0, without).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_letters: int = LEAST_LETTERS, least_seen: int = LEAST_SEEN) -> DataFrame:
    """(word, n) of words that are long and frequent enough."""
    return words.where(F.char_length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_seen)


def _best(n: Column, word: Column) -> Column:
    """Its least value is the most frequent, of equals the smallest word."""
    return F.struct((-n).alias("minus"), word.alias("word"))


def replaced(words: DataFrame) -> DataFrame:
    """(word, n_near, best): neighbours by one replaced code point, from sizes and top-two words of wildcard groups."""
    place = F.explode(F.sequence(F.lit(1), F.char_length("word")))
    holes = words.select("word", "n", place.alias("place")).select("word", "n", F.concat(F.substring("word", F.lit(1), F.col("place") - 1), F.lit("*"), F.substring("word", F.col("place") + 1, F.char_length("word"))).alias("hole"))
    # A hole names its place, what is before and what is after it. Members are at most as many as there are letters.
    groups = holes.groupBy("hole").agg(F.array_sort(F.collect_list(_best(F.col("n"), F.col("word")))).alias("members")).where(F.size("members") > 1)
    kept = groups.select(F.size("members").alias("size"), F.col("members")[0].alias("first"), F.col("members")[1].alias("second"), F.explode("members").alias("own"))
    other = F.when(F.col("own.word") == F.col("first.word"), F.col("second")).otherwise(F.col("first"))
    return kept.groupBy(F.col("own.word").alias("word")).agg(F.sum(F.col("size") - 1).alias("n_near"), F.min(other).alias("best"))


def indels(words: DataFrame, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """(word, n_near, best): neighbours by one inserted or deleted code point."""
    short = lambda p: F.concat(F.substring("word", F.lit(1), p - 1), F.substring("word", p + 1, F.char_length("word")))
    less = words.where(F.char_length("word") > least_letters).select("word", "n", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("word")), short))).alias("short"))
    known = words.select(F.col("word").alias("short"), F.col("n").alias("short_n"))
    found = less.join(known, "short")
    both = F.explode(F.array(F.struct(F.col("word"), _best(F.col("short_n"), F.col("short")).alias("other")), F.struct(F.col("short").alias("word"), _best(F.col("n"), F.col("word")).alias("other"))))
    return found.select(both.alias("x")).groupBy(F.col("x.word").alias("word")).agg(F.count("*").alias("n_near"), F.min("x.other").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form, from (word, form): each step doubles how far a word has followed."""
    now = materialise(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialise(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "roots")
        went = after.where("went").limit(1).count()
        discard(now)
        now = after.select("word", "root")
        now.quadrivium_path = after.quadrivium_path
        if not went:
            return now


def variants(words: DataFrame, least_letters: int = LEAST_LETTERS, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of a vocabulary (word, n) of distinct words."""
    words = materialise(words.select("word", "n"), "vocabulary")
    near = replaced(words).unionByName(indels(words, least_letters)).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    enough = -F.col("best.minus") >= ratio * F.col("n")
    formed = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n"))
    formed = materialise(formed, "forms")
    return formed.join(roots(formed), "word", "left").withColumn("root", F.coalesce("root", "word"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vocabulary(with_slips(runs(table(spark, sf_dir, "documents"))))
    return variants(found).select("word", "form", "root", "n", "n_near", "form_n")


SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(CAST(list_reduce(range(8), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), b) AS BIGINT) ORDER BY b) AS entries FROM range(256) AS t(b)
), r AS (
  SELECT id, run, count(*) AS c FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents
  ) GROUP BY id, run
), hashed AS (
  SELECT run, c, xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(id || ':' || run), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda c, x: xor(c >> 8, entries[1 + xor(c & 255, x)]), CAST(4294967295 AS BIGINT))) AS h FROM r, crc
), v AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, c FROM hashed
  ) WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v
), cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z FROM places
), pairs AS (
  SELECT x.word, y.word AS other, y.n AS m FROM cut AS x JOIN cut AS y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION SELECT cut.word, v.word, v.n FROM cut JOIN v ON v.word = a || z
  UNION SELECT v.word, cut.word, cut.n FROM cut JOIN v ON v.word = a || z
), near AS (
  SELECT word, count(*) AS n_near, min({'minus': -m, 'word': other}) AS best FROM pairs GROUP BY word
), f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.minus >= 2 * v.n THEN best.word END AS form, CASE WHEN -best.minus >= 2 * v.n THEN -best.minus END AS form_n FROM v LEFT JOIN near USING (word)
), way(word, top, step) AS (
  SELECT word, word, 0 FROM f UNION ALL SELECT way.word, f.form, step + 1 FROM way JOIN f ON f.word = way.top WHERE f.form IS NOT NULL
)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN (SELECT word, arg_max(top, step) AS root FROM way GROUP BY word) USING (word)
"""
