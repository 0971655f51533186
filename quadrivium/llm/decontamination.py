"""Benchmark decontamination: a prefix-filtered containment join of item windows with documents.

A window is ``WINDOW`` consecutive item words (a shorter item is one window).
Seen as a set join: the tokens of a window are its shingles of ``SHINGLE``
words, ordered by rarity in the whole corpus.  Containment must be full, so
the prefix that any matching document has to share is the single rarest
shingle.  A document position holding that shingle fixes where the window
would start (positional bound) and whether it fits (length bound); what is left
is verified word by word over exactly that item-sized document window.

Documents are read twice, and each time split once, whatever the lengths of the
items: first to count the tokens of the windows, then to find prefix tokens.
In both, a bit table of the wanted tokens (at most ``MOST_BITS`` bits, however
many tokens there are) thins out the positions inside the row, so that the few
left, and not all of a text, become rows; the joins that follow are exact.
A document goes through the second reading in pieces of ``PIECE`` positions and
a found position carries the words around it only, so time and memory are in
proportion to the length of a text and no text is joined with itself again.

What an item list costs does not grow with the documents that have it: equal
item texts are one text, windows of the same texts one class, and the list of
ids is made once for every set of classes that some document has.

Words are taken from a byte view of the text (its UTF-8 bytes read as Latin-1),
in which the JVM's lower-casing changes A-Z and maps the bytes of other letters
one to one, so word equality is that of the ASCII-lowered text.

Edge cases: null and empty texts have no words and no hits; items without words
give no window; repeated items and rows are judged each on its own; words that
only items with a null id have are hit, but such items are not counted or
listed; no benchmark rows means nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, fresh, materialise, small, table

WINDOW = 13
SHINGLE = 3
#: Word positions of a document that are gone through at a time.
PIECE = 4096
#: Bits for every wanted token, and most bits in all (256 KB in the plan); more tokens let more positions through to the exact join.
BITS_EACH, MOST_BITS = 32, 1 << 21
#: What separates words, in the byte view after lower-casing.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text_col: str) -> Column:
    view = F.lower(F.decode(F.col(text_col).cast("binary"), "ISO-8859-1"))
    return F.filter(F.split(F.coalesce(view, F.lit("")), BREAK), lambda w: w != "")


def shingles(array: str, k: int) -> Column:
    """The hash of the ``k`` words that start at each word; the last ``k - 1`` are partial and never verified."""
    return F.transform(F.col(array), lambda w, i: F.xxhash64(w, *[F.get(F.col(array), i + j) for j in range(1, k)]))


class Bits:
    """A bit table of tokens as one literal of the plan: may say yes to a token that is not there, never no to one that is."""

    def __init__(self, tokens: DataFrame, bound: int):
        self.words = 1
        while self.words * 64 < min(MOST_BITS, BITS_EACH * bound):
            self.words *= 2
        at, bit = self.place(F.col("token"))
        rows = tokens.groupBy(at.alias("at")).agg(F.bit_or(bit).alias("bits")).collect()  # at most MOST_BITS / 64 numbers
        held = [0] * self.words
        for row in rows:
            held[row["at"]] = row["bits"]
        self.table = F.split(F.lit(",".join(map(str, held))), ",").cast("array<bigint>")  # folded to one literal

    def place(self, token: Column) -> tuple[Column, Column]:
        return F.shiftrightunsigned(token, 6).bitwiseAND(F.lit(self.words - 1)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), token.bitwiseAND(F.lit(63)).cast("int"))

    def may_have(self, token: Column) -> Column:
        at, bit = self.place(token)
        return F.get(self.table, at).bitwiseAND(bit) != 0


def item_texts(benchmark: DataFrame, text_col: str, item_col: str) -> DataFrame:
    """(text, item, w): every item with the key of its words; items of equal words share it."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(text_col).alias("w")).where(F.size("w") > 0)
    return items.select(F.sha2(F.array_join("w", " ").cast("binary"), 256).alias("text"), "item", "w")


def windows(texts: DataFrame, size: int) -> DataFrame:
    """(window, words, text): every distinct window of a distinct text."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    rows = texts.select("text", "w").dropDuplicates(["text"]).select("text", "w", F.explode(starts).alias("at")).select("text", F.slice("w", F.col("at") + 1, F.lit(size)).alias("words"))
    return rows.distinct().withColumn("window", F.sha2(F.array_join("words", " ").cast("binary"), 256))


def window_index(split: DataFrame, own: DataFrame, lengths: list[int], n_windows: int, size: int) -> DataFrame:
    """(k, token, window, len, offset, own): the rarest shingle of every window, by its count in the whole corpus."""
    tokens = None
    for k in lengths:
        part = own.where(F.least(F.size("words"), F.lit(SHINGLE)) == k)
        part = part.select(F.lit(k).alias("k"), "window", F.size("words").alias("len"), F.posexplode(F.slice(shingles("words", k), F.lit(1), F.size("words") - (k - 1))).alias("offset", "token"))
        tokens = part if tokens is None else tokens.unionByName(part)
    tokens = materialise(tokens, "window-tokens")
    vocabulary = tokens.select("k", "token").distinct()
    bits = Bits(vocabulary, n_windows * size)
    wanted = lambda k: F.transform(F.filter(shingles("w", k), bits.may_have), lambda t: F.struct(F.lit(k).alias("k"), t.alias("token")))
    found = F.concat(*[wanted(k) for k in lengths])
    counted = split.select(F.explode(found).alias("t")).select("t.*").groupBy("k", "token").agg(F.count("*").alias("df"))
    counted = vocabulary.join(counted, ["k", "token"], "left")
    rarest = F.min(F.struct(F.coalesce("df", F.lit(0)), "token", "offset")).alias("best")
    prefix = tokens.join(small(counted, n_windows * size, 24), ["k", "token"]).groupBy("k", "window", "len").agg(rarest)
    prefix = prefix.select("k", "window", "len", F.col("best.token").alias("token"), F.col("best.offset").alias("offset"))
    return materialise(prefix.join(own.select("window", F.col("words").alias("own")), "window"), "prefix")


def marked(split: DataFrame, index: DataFrame, lengths: list[int], n_windows: int, size: int) -> DataFrame:
    """(id, fp, lead, n_words, found) of every piece of a document, ``lead`` the first: places of possible prefix tokens with the words around them."""
    bits = Bits(index.select("token").distinct(), n_windows)
    around = size - 1
    n = F.size("w")
    # A piece has the words before and after its positions that a window over one of them may need.
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(PIECE)),
        lambda a: F.struct(F.greatest(a - around, F.lit(0)).alias("first"), F.least(a, F.lit(around)).alias("skip"), (a == 0).alias("lead"), n.cast("long").alias("n_words"), F.slice("w", F.greatest(a - around, F.lit(0)) + 1, F.least(a, F.lit(around)) + PIECE + around).alias("piece")),
    )
    rows = split.select("id", "fp", F.inline(pieces))
    inside = lambda i: (i >= F.col("skip")) & (i < F.col("skip") + PIECE)

    def places(k: int) -> Column:
        at = F.array_compact(F.transform(shingles("piece", k), lambda t, i: F.when(bits.may_have(t) & inside(i), i)))
        token = lambda i: F.xxhash64(*[F.get("piece", i + j) for j in range(k)]).alias("token")
        start = lambda i: F.greatest(i - around, F.lit(0))
        near = lambda i: F.slice("piece", start(i) + 1, F.lit(2 * around + 1)).alias("near")
        return F.transform(at, lambda i: F.struct(F.lit(k).alias("k"), token(i), (F.col("first") + i).alias("at"), (F.col("first") + start(i)).alias("first"), near(i)))

    kinds = [places(k) for k in lengths]
    return rows.select("id", "fp", "lead", "n_words", F.concat(*kinds).alias("found"))


def judged(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_text: str = "text", item_col: str = "item_id", window: int = WINDOW, per: int = 20) -> DataFrame:
    """(id, fp, n_words, n_hit, n_items, items_sha256, contaminated) of every document; fp is the xxhash64 of its text."""
    texts = materialise(item_texts(benchmark, item_text, item_col), "item-texts")
    found = materialise(windows(texts, window), "windows")
    own = materialise(found.select("window", "words").distinct(), "window-words")
    n_windows = own.count()
    lengths = sorted(r[0] for r in own.select(F.least(F.size("words"), F.lit(SHINGLE))).distinct().collect())  # at most SHINGLE numbers
    split = documents.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("fp"), words(text_col).alias("w"))
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    if not lengths:
        out = split.select("id", "fp", F.size("w").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), nothing.alias("items_sha256"))
        return out.withColumn("contaminated", F.lit(False))

    index = window_index(split, own, lengths, n_windows, window)
    bytes_ = index.agg(F.sum(F.octet_length(F.array_join("own", " ")) + 160)).first()[0]
    marks = materialise(marked(split, index, lengths, n_windows, window), "marks")
    places = marks.select("id", "fp", F.inline("found"))
    start = F.col("at") - F.col("offset")
    same = F.slice("near", start - F.col("first") + 1, F.col("len")) == F.col("own")
    hits = places.join(F.broadcast(index) if bytes_ <= BROADCAST_BYTES else index, ["k", "token"]).where(start >= 0).where(same)
    hits = materialise(hits.select("id", "fp", start.alias("start"), "len", "window").distinct(), "hits")

    # Windows of the same texts are one class; a document's set of classes decides its list of items.
    sums = found.groupBy("window").agg(F.count("*").alias("n"), F.sum(F.xxhash64("text").cast("decimal(20,0)")).alias("a"), F.sum(F.xxhash64(F.lit("b"), "text").cast("decimal(20,0)")).alias("b"))
    classes = materialise(sums.select("window", F.sha2(F.concat_ws(" ", "n", "a", "b"), 256).alias("class")), "window-classes")
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def cover(acc: Column, span: Column) -> Column:
        end = span["start"] + span["len"]
        new = F.greatest(end - F.greatest(acc["end"], span["start"]), F.lit(0))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + new).alias("n"))

    # Both gather at most as many numbers as a document has words, beside a text that is a row already.
    spans = hits.groupBy("id", "fp").agg(F.array_sort(F.collect_set(F.struct("start", "len"))).alias("spans"))
    spans = spans.select("id", "fp", F.aggregate("spans", zero, cover)["n"].alias("n_hit"))
    sets = hits.select("id", "fp", "window").distinct().join(small(classes, n_windows, 160), "window").groupBy("id", "fp").agg(F.array_sort(F.collect_set("class")).alias("classes"))
    sets = materialise(sets.withColumn("set", F.sha2(F.array_join("classes", " "), 256)), "class-sets")
    one = classes.groupBy("class").agg(F.min("window").alias("window"))
    listed = sets.select("set", "classes").dropDuplicates(["set"]).select("set", F.explode("classes").alias("class")).join(one, "class").join(found.select("window", "text"), "window")
    listed = listed.select("set", "text").distinct().join(texts.select("text", "item").distinct(), "text").groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("items"))
    listed = listed.select("set", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    per_doc = sets.select("id", "fp", "set").join(listed, "set", "left").alias("s").join(spans.alias("h"), F.col("s.id").eqNullSafe(F.col("h.id")) & (F.col("s.fp") == F.col("h.fp")))
    per_doc = materialise(per_doc.select("s.id", "s.fp", "n_hit", "n_items", "items_sha256"), "contamination")

    counted = marks.where("lead").alias("d").join(small(per_doc, per_doc.count(), 128).alias("h"), F.col("d.id").eqNullSafe(F.col("h.id")) & (F.col("d.fp") == F.col("h.fp")), "left")
    out = counted.select("d.id", "d.fp", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", nothing).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * per >= F.col("n_words")))


def decontaminate(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_text: str = "text", item_col: str = "item_id", window: int = WINDOW, per: int = 20) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    out = judged(documents, benchmark, text_col, id_col, item_text, item_col, window, per)
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go, each judged by its own id and text; columns stay as they are."""
    id_, fp = fresh("of_id", docs), fresh("of_fp", docs)
    found = judged(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("id").alias(id_), F.col("fp").alias(fp))
    found = materialise(found.distinct(), "contaminated")
    return docs.join(small(found, found.count(), 24), F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(fp)), "left_anti")


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i + 1 : i + least(13, len(w))], ' ') AS win
  FROM b, unnest(range(greatest(len(w) - 13, 0) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT size FROM win),
places AS (
  SELECT doc_id, i AS place, size, array_to_string(w[i + 1 : i + size], ' ') AS win FROM d, sizes, unnest(range(len(w) - size + 1)) AS t(i) WHERE len(w) >= size
), hits AS (SELECT doc_id, place, size, item_id FROM places JOIN win USING (size, win)),
covered AS (SELECT doc_id, count(DISTINCT place + j) AS n_hit FROM (SELECT DISTINCT doc_id, place, size FROM hits), unnest(range(size)) AS t(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
