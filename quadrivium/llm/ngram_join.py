"""Near-duplicate join on word shingles: a grouped prefix join with exact verification.

Set of a document: the distinct hashes of its runs of ``words`` consecutive
words (all its words as one, if fewer).  Two documents link when the Jaccard
similarity of their sets is at least ``percent``.  Steps:

1. Documents with equal sets form a *class*; only classes go on.
2. Document frequency of every shingle over all classes: shingles are dealt by
   their hash to ranges, in packed blocks beside a reference per document, and
   only those that two or more classes share come back to their classes.
3. Each class orders its shingles by (frequency, hash).  Its *prefix* is the
   first ``n - ceil(n * percent) + 1`` of them; unshared shingles come first and
   cannot meet a partner, so a class that has enough of them is done.
4. Classes of identical prefix and size collapse into one *group*; prefix
   tokens are posted for groups.  Tokens that the same groups have are one
   *list*, named by the first of them; every candidate pair is in the list of
   its first common prefix token.
5. *Stars*: in each list all members are verified against one pivot, the class
   with the smallest share of shingles of its own, and in a second round against
   one of those left over.  Pairs must pass the size and positional filters.
6. In lists whose members are not yet in one component, those outside the
   pivot's component are verified against each other and against the rest in
   *cells* of two blocks of bounded size: group pairs must have no common prefix
   token before the list's, and pass the size and positional filters, then
   expand to their members, whose shared shingles are intersected.  Before the
   sets are shipped, a pass over the same cells with only a *sketch* of each
   class (how many of its shared shingles fall into each of ``BUCKETS`` buckets,
   which bounds any overlap from above) leaves out rows that have no partner.

Only connectivity is asked for, so pairs within a component already found are
left out and a cell reports a spanning forest of its links; no link between
components is lost.

Memory: a range has about ``RANGE_TOKENS`` shingles, however many there are in
all and whatever the number of partitions, of which each goes through its
ranges one by one.  Blocks are dealt to at most ``FAN`` coarse ranges at a time;
beyond ``FAN`` ranges a second dealing splits the coarse ones.

Hot keys: a copy's set is shipped once per task and collapses in its class;
frequencies, pivots and components are sums and minima with map-side
combination; joins on list or component keys are plain sort-merge joins,
whose large partitions adaptive execution splits; a cell never holds more than
two blocks, whatever the size of its list.

Shingles are compared by hashes of 64 bits: that two different shingles of a
pair of documents of 20,000 words collide has a probability below 1e-10.
Classes and groups are told by 128 bits; a class goes by a number of 64, which
is replaced where two classes have the same.

Edge cases: null, empty and blank texts have empty sets, are linked with
nothing and keep their own id; repeated rows are one class; rows with null ids
take part, and a class of only null ids has a null component; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, fresh, hand_back, materialise, partitions, small, small_batches, table

WORDS, PERCENT = 5, 80
#: Shingles gathered in a task before they are dealt, and text hashed at a time.
BLOCK_TOKENS, BLOCK_BYTES = 1 << 19, 1 << 17
#: Shingles of a range, and ranges that blocks are dealt to at a time.
RANGE_TOKENS, FAN = 1 << 22, 4096
CAP = 65_535
#: Classes in a block of a cell: about half a partition's share, within these bounds; and shingles, about.
BLOCK_LEAST, BLOCK_MOST, BLOCK_SHINGLES = 64, 1024, 1 << 21
#: Bits of the number that stands for a class.
REF_BITS = 64
#: Buckets of a sketch; a count of ``CAP`` stands for that many or more.
BUCKETS = 64

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE += 2 if _BASE % 4 == 1 else 0
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240101)
_BYTE = _rng.integers(1, 1 << 64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLACE = [int(x) | 1 for x in _rng.integers(1, 1 << 63, 64, dtype=np.uint64)]
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n; kept for the process."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of every word of ASCII-lowered UTF-8 bytes: prefix sums of a polynomial, mixed."""
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + BLOCK_BYTES)
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":  # a block ends between words
            end += 1
        block = np.frombuffer(raw, dtype=np.uint8, count=end - at, offset=at)
        space = _SPACE[block]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        up, down = powers(len(block) + 1)
        sums = np.zeros(len(block) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[block] * up[:-1], out=sums[1:])
        h = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        for i in np.flatnonzero(ends - starts > 64):  # the polynomial is weak on long periodic words
            h[i] = int.from_bytes(hashlib.blake2b(raw[at + starts[i] : at + ends[i]], digest_size=8).digest(), "little")
        out.append(h)
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the document's shingles."""
    h = word_hashes((text or "").encode("utf-8").lower())
    if not len(h):
        return h
    width, n = min(words, len(h)), max(1, len(h) - words + 1)
    total = np.full(n, len(h) if len(h) < words else 0, dtype=np.uint64)
    for j in range(width):
        total += h[j : j + n] * _U(_PLACE[j % 64])
    return np.unique(mix(total))


def signature(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def reference(sig: bytes, bits: int = REF_BITS) -> int:
    """The number of a class: the first bits of its signature, unless another class has them too (``new_references``)."""
    number = int.from_bytes(sig[:8], "little", signed=True)
    return number if bits == 64 else number % (1 << bits)


def need(n: np.ndarray | int, percent: int = PERCENT):
    """Least overlap of a set of ``n`` with any partner: ceil(n * percent / 100)."""
    return (n * percent + 99) // 100


# --- packed blocks ---------------------------------------------------------------------------


def stretches(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of equal rows begin and end."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0))))
    return first, np.append(first[1:], n)


def pack(refs: np.ndarray, tokens: np.ndarray, df: np.ndarray | None = None) -> bytes:
    """Tokens in runs of one reference: (reference, length up to ``CAP``) of every run, then the tokens and their frequencies."""
    first, end = stretches(refs)
    counts = end - first
    pieces = -(-counts // CAP)
    lengths = np.full(pieces.sum(), CAP)
    lengths[np.cumsum(pieces) - 1] = counts - (pieces - 1) * CAP
    parts = [np.array([len(lengths), len(tokens)], dtype=np.int64), np.repeat(refs[first], pieces).astype(np.int64), lengths.astype(np.uint16), tokens.astype(np.uint64)]
    if df is not None:
        parts.append(df.astype(np.uint16))
    return b"".join(x.tobytes() for x in parts)


def unpack(blob: bytes, with_df: bool = False) -> tuple[np.ndarray, ...]:
    """(reference, token[, frequency]) of every token."""
    runs, n = np.frombuffer(blob, dtype=np.int64, count=2)
    at, out = 16, []
    for kind, size in ((np.int64, runs), (np.uint16, runs), (np.uint64, n), *([(np.uint16, n)] if with_df else [])):
        out.append(np.frombuffer(blob, dtype=kind, count=size, offset=at))
        at += out[-1].nbytes
    return (np.repeat(out[0], out[1]), *out[2:])


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range, from 0, of 64-bit hashes, by their upper half; ``ranges`` is below 2**32."""
    return (((keys.astype(np.uint64) >> _U(32)) * _U(ranges)) >> _U(32)).astype(np.int64)


def ref_range(refs: np.ndarray, ranges: int) -> np.ndarray:
    return range_of(mix(refs.astype(np.int64).view(np.uint64)), ranges)


def cut(to: np.ndarray, *columns: np.ndarray) -> pd.DataFrame:
    """A packed block for every range that occurs in ``to``."""
    order = np.argsort(to, kind="stable")
    to = to[order]
    rows = [(int(to[a]), pack(*(c[order[a:b]] for c in columns))) for a, b in zip(*stretches(to), strict=True)]
    return pd.DataFrame(rows, columns=["to", "block"])


def by_range(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list]]:
    """(range, its rows) of rows sorted by range, one range at a time."""
    number, held = None, []
    for batch in batches:
        for row in batch.itertuples(index=False, name=None):
            if row[0] != number and held:
                yield number, held
                held = []
            number = row[0]
            held.append(row[1:])
    if held:
        yield number, held


def _shared(ref: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(reference, token, frequency) of the tokens of two or more references, each pair once."""
    order = np.argsort(tokens, kind="stable")
    ordered = tokens[order]
    same = ordered[1:] == ordered[:-1]
    keep = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))] if len(tokens) > 1 else order[:0]
    del ordered, same, order
    tokens, ref = tokens[keep], ref[keep]
    order = np.lexsort((ref, tokens))
    tokens, ref = tokens[order], ref[order]
    new, _ = stretches(tokens, ref)
    tokens, ref = tokens[new], ref[new]
    first, end = stretches(tokens)
    df = np.repeat(end - first, end - first)
    many = df > 1
    return ref[many], tokens[many], np.minimum(df[many], CAP)


def sketch(tokens: np.ndarray) -> bytes:
    return np.minimum(np.bincount((tokens % _U(BUCKETS)).astype(np.int64), minlength=BUCKETS), CAP).astype(np.uint16).tobytes()


def sketches(blobs: list[bytes]) -> np.ndarray:
    """Counts by row and bucket; the sum of the lesser counts of two rows is at least their overlap."""
    counts = np.frombuffer(b"".join(blobs), dtype=np.uint16).reshape(-1, BUCKETS).astype(np.int64)
    return np.where(counts == CAP, 1 << 40, counts)


def _prefixes(blocks: list[bytes], sizes: list[bytes], percent: int) -> Iterator[pd.DataFrame]:
    """(ref, n, single, tokens, prefix, sketch) of every class with a shingle in its prefix that another class shares."""
    runs = [unpack(b, True) for b in blocks]
    if not runs:
        return
    ref, tokens, df = (np.concatenate([x[i] for x in runs]) for i in range(3))
    del runs
    known = np.concatenate([np.frombuffer(x, dtype=np.int64).reshape(2, -1) for x in sizes], axis=1)
    known = known[:, np.argsort(known[0], kind="stable")]
    order = np.lexsort((tokens, df, ref))
    tokens, ref = tokens[order], ref[order]
    first, end = stretches(ref)
    size = known[1, np.searchsorted(known[0], ref[first])]
    rows = []
    for a, b, n in zip(first, end, size.tolist(), strict=True):
        single = n - int(b - a)
        k = n - need(n, percent) + 1 - single
        if k > 0:
            rows.append((int(ref[a]), n, single, np.sort(tokens[a:b]).tobytes(), tokens[a : a + k].tobytes(), sketch(tokens[a:b])))
            if len(rows) >= 2000:
                yield pd.DataFrame(rows, columns=["ref", "n", "single", "tokens", "prefix", "sketch"])
                rows = []
    if rows:
        yield pd.DataFrame(rows, columns=["ref", "n", "single", "tokens", "prefix", "sketch"])


# --- distributed steps -----------------------------------------------------------------------


def signatures(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """(n, sig, ref) of every row beside its columns other than the text; sig and ref are null for empty sets."""
    carried = [c for c in docs.columns if c != "text"]
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # Arrow: pandas would round large ids beside null ones
        for batch in batches:
            sizes, sigs = [], []
            for text in batch.column("text").to_pylist():
                own = shingle_set(text, words)
                sizes.append(len(own))
                sigs.append(signature(own) if len(own) else None)
            refs = pa.array([reference(s, bits) if s else None for s in sigs], pa.int64())
            own = [batch.column(c) for c in carried]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), refs], [*carried, "n", "sig", "ref"])
            del batch
            hand_back()

    return materialise(docs.mapInArrow(run, f"{kinds}, n long, sig binary, ref long"), "signatures")


def new_references(classes: DataFrame) -> dict[bytes, int]:
    """References for classes whose own another class of a lesser signature has; they are in use nowhere else.

    Of n classes n * n / 2**65 pairs share a reference: 11 are expected among 2 * 10**10.  Signatures have 128 bits.
    """
    first = classes.groupBy("ref").agg(F.min("sig").alias("first"), F.count("*").alias("classes")).where("classes > 1")
    clash = [bytes(r["sig"]) for r in classes.join(first, "ref").where("sig <> first").select("sig").collect()]
    found: dict[bytes, int] = {}
    turn = 0
    while clash:
        turn += 1
        tried = {sig: int.from_bytes(hashlib.blake2b(sig, digest_size=8, salt=turn.to_bytes(8, "little")).digest(), "little", signed=True) for sig in clash}
        used = {r["ref"] for r in classes.where(F.col("ref").isin(list(tried.values()))).select("ref").distinct().collect()} | set(found.values())
        clash = []
        for sig, ref in tried.items():
            if ref in used:
                clash.append(sig)
            else:
                found[sig] = ref
                used.add(ref)
    return found


def in_ranges(blocks: DataFrame, parts: int) -> DataFrame:
    """Rows of (to, ...) with every range in one partition, the ranges of a partition one after the other."""
    return blocks.repartitionById(parts, F.pmod("to", F.lit(parts)).cast("int")).sortWithinPartitions("to")


def finer(blocks: DataFrame, ranges: int, step: int, parts: int, with_df: bool) -> DataFrame:
    """Blocks of coarse ranges, of ``step`` ranges each, split into blocks of ranges."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def split(held: list) -> pd.DataFrame:
            columns = [np.concatenate([x[i] for x in held]) for i in range(2 + with_df)]
            return cut(ref_range(columns[0], ranges) if with_df else range_of(columns[1], ranges), *columns)

        held, size, number = [], 0, None
        for batch in batches:
            for to, block in zip(batch["to"], batch["block"], strict=True):
                if held and (to != number or size >= BLOCK_TOKENS):
                    yield split(held)
                    held, size = [], 0
                number = to
                held.append(unpack(block, with_df))
                size += len(held[-1][0])
        if held:
            yield split(held)

    return in_ranges(blocks, parts).mapInPandas(run, "to long, block binary") if step > 1 else blocks


def shared_sets(docs: DataFrame, classes: DataFrame, words: int, percent: int, bits: int, renamed: dict[bytes, int]) -> DataFrame:
    """Steps 2 and 3: classes that may have a partner, with their shared shingles and prefix."""
    parts = partitions(docs.sparkSession)
    ranges = max(parts, (classes.agg(F.sum("n")).first()[0] or 0) // RANGE_TOKENS + 1)
    step = -(-ranges // FAN)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def blocks(gathered: list) -> pd.DataFrame:
            tokens = np.concatenate([t for _, t in gathered])
            refs = np.repeat(np.array([r for r, _ in gathered], dtype=np.int64), [len(t) for _, t in gathered])
            return cut(range_of(tokens, ranges) // step, refs, tokens)

        gathered, size, seen = [], 0, set()
        for batch in batches:
            for text in batch["text"]:
                tokens = shingle_set(text, words)
                if not len(tokens):
                    continue
                sig = signature(tokens)
                ref = renamed.get(sig)
                if (ref := reference(sig, bits) if ref is None else ref) in seen:
                    continue
                seen.add(ref)
                gathered.append((ref, tokens))
                size += len(tokens)
                if size >= BLOCK_TOKENS:
                    yield blocks(gathered)
                    gathered, size, seen = [], 0, set()
        if gathered:
            yield blocks(gathered)
        del gathered, seen
        hand_back()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in by_range(batches):
            runs = [unpack(block) for (block,) in rows]
            rows.clear()
            ref, tokens = (np.concatenate([x[i] for x in runs]) for i in range(2))
            del runs
            ref, tokens, df = _shared(ref, tokens)
            yield cut(ref_range(ref, ranges) // step, ref, tokens, df)
            hand_back()

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ref, n = batch["ref"].to_numpy(np.int64), batch["n"].to_numpy(np.int64)
            to = ref_range(ref, ranges)
            order = np.argsort(to, kind="stable")
            ref, n, to = ref[order], n[order], to[order]
            rows = [(int(to[a]), None, np.concatenate((ref[a:b], n[a:b])).tobytes()) for a, b in zip(*stretches(to), strict=True)]
            yield pd.DataFrame(rows, columns=["to", "block", "sizes"])

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in by_range(batches):
            yield from _prefixes([b for b, _ in rows if b is not None], [x for _, x in rows if x is not None], percent)
            hand_back()

    dealt = finer(docs.select("text").mapInPandas(deal, "to long, block binary"), ranges, step, parts, False)
    back = finer(in_ranges(dealt, parts).mapInPandas(count, "to long, block binary"), ranges, step, parts, True)
    own = classes.select("ref", "n").mapInPandas(sizes, "to long, block binary, sizes binary")
    both = in_ranges(back.withColumn("sizes", F.lit(None).cast("binary")).unionByName(own), parts)
    return materialise(both.mapInPandas(order, "ref long, n long, single long, tokens binary, prefix binary, sketch binary"), "sets")


def postings(groups: DataFrame) -> DataFrame:
    """(token, g, at) of every group's prefix, ``at`` the token's place in it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                tokens = [np.frombuffer(p, dtype=np.int64) for p in part["prefix"]]
                lengths = [len(t) for t in tokens]
                yield pd.DataFrame({"token": np.concatenate(tokens), "g": np.repeat(part["g"].to_numpy(), lengths), "at": np.concatenate([np.arange(n) for n in lengths])})

    return groups.select("g", "prefix").mapInPandas(run, "token long, g long, at long")


def grouped(sets: DataFrame) -> DataFrame:
    """(ref, g, members): the group of every class, named by its least reference.

    A group is told by its size and 128 bits of its prefix.  A class with shingles of its own in its prefix is alone.
    """
    key = ["n", "h1", "h2"]
    told = sets.select("ref", "n", "single", F.xxhash64("prefix").alias("h1"), F.xxhash64(F.lit("again"), "prefix").alias("h2"))
    many = told.where("single = 0").select("ref", *key)
    groups = many.groupBy(*key).agg(F.min("ref").alias("g"), F.count("*").alias("members"))
    alone = told.where("single <> 0").select("ref", F.col("ref").alias("g"), F.lit(1).cast("long").alias("members"))
    return materialise(many.join(groups, key).select("ref", "g", "members").unionByName(alone), "grouped")


def candidate_lists(sets: DataFrame) -> DataFrame:
    """Step 4: (list, ref, g, n, pos, share, at) of every class in every list of two classes or more.

    ``pos``: how many shingles the class has before the list's token, ``at``: how many of those are shared.
    """
    named = grouped(sets)
    groups = materialise(named.where("ref = g").select("g", "members").join(sets.select(F.col("ref").alias("g"), "prefix"), "g"), "groups")
    posted = materialise(postings(groups).join(groups.select("g", "members"), "g"), "postings")
    # Equal sums of two hashes: the same groups.  Of their tokens the first in the order of any of the groups is kept.
    number = lambda *c: F.sum(F.xxhash64(*c, "g").cast("decimal(20,0)"))
    tokens = posted.groupBy("token").agg(F.sum("members").alias("classes"), number().alias("a"), number(F.lit("b")).alias("b"), F.min(F.struct("g", "at"))["at"].alias("at")).where("classes > 1")
    lists = tokens.groupBy("classes", "a", "b").agg(F.min(F.struct("at", "token"))["token"].alias("list")).select("list")
    kept = posted.join(lists, F.col("token") == F.col("list")).select("list", "g", "at")
    narrow = sets.select("ref", "n", "single", (F.col("single") / F.col("n")).alias("share")).join(named.select("ref", "g"), "ref")
    out = materialise(kept.join(narrow, "g").select("list", "ref", "g", "n", (F.col("single") + F.col("at")).alias("pos"), "share", "at"), "lists")
    discard(named, groups, posted)
    return out


def may_link(n: str, pos: str, m: str, other: str, percent: int) -> Column:
    """Size filter, and positional filter for a pair whose first common shingle has ``pos`` and ``other`` shingles before it."""
    a, b, x, y = F.col(n), F.col(m), F.col(pos), F.col(other)
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (F.least(a - x, b - y) * (100 + percent) >= percent * (a + b))


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes, those whose sets are similar enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            links = np.zeros(len(batch), dtype=bool)
            for i, (x, y, n, m) in enumerate(zip(batch["x"], batch["y"], batch["n"], batch["m"], strict=True)):
                both = np.concatenate((np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                links[i] = 100 * common >= percent * (n + m - common)
            yield batch.loc[links, ["a", "b"]]

    left, right = sets.select(F.col("ref").alias("a"), F.col("n"), F.col("tokens").alias("x")), sets.select(F.col("ref").alias("b"), F.col("n").alias("m"), F.col("tokens").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "x", "y").mapInPandas(run, "a long, b long")


def with_roots(lists: DataFrame, roots: DataFrame | None) -> tuple[DataFrame, int]:
    """Adds ``root``, the component of the class so far, and ``main``, that of the list's pivot; lists of one component go. And how many lists stay."""
    rows = lists.withColumn("root", F.col("ref")) if roots is None else lists.join(roots.select(F.col("node").alias("ref"), F.col("root").alias("__root")), "ref", "left").withColumn("root", F.coalesce("__root", "ref")).drop("__root")
    main = rows.groupBy("list").agg(F.min(F.struct("share", "ref", "root"))["root"].alias("main"), F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("list", "main")
    main = materialise(main, "mains")
    n_lists = main.count()
    return materialise(rows.join(small(main, n_lists, 32), "list"), "rooted"), n_lists


def star_links(rooted: DataFrame, n_lists: int, sets: DataFrame, percent: int, of_main: bool) -> DataFrame:
    """Step 5: links of every member with its list's pivot, the least of the main component or of the others."""
    own = (F.col("root") == F.col("main")) == F.lit(of_main)
    pivot = rooted.where(own).groupBy("list").agg(F.min(F.struct("share", "ref", "root", "n", "pos")).alias("p")).select("list", F.col("p.ref").alias("b"), F.col("p.root").alias("to"), F.col("p.n").alias("m"), F.col("p.pos").alias("other"))
    pairs = rooted.join(small(pivot, n_lists, 64), "list").where((F.col("root") != F.col("to")) & may_link("n", "pos", "m", "other", percent)).select(F.col("ref").alias("a"), "b").distinct()
    return linked(pairs, sets, percent)


def cell_links(refs: list[int], groups: list[int], roots: np.ndarray, sizes: np.ndarray, places: np.ndarray, tokens: list[np.ndarray], before: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows ``left`` and rows ``right`` of a cell."""
    root = list(range(len(refs)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    values, ids = np.unique(np.concatenate(tokens), return_inverse=True)
    cuts = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))
    own = [ids[cuts[i] : cuts[i + 1]] for i in range(len(tokens))]
    # Groups of the right side, each by its first member.
    first: dict[int, int] = {}
    heads: list[int] = []
    for i in right:
        if groups[i] not in first:
            first[groups[i]] = len(heads)
            heads.append(i)
    of = np.array([first[groups[i]] for i in right])
    head_ids = [np.searchsorted(values, before[i]) for i in heads]
    lengths = np.array([len(x) for x in head_ids])
    head_of, head_all = np.repeat(np.arange(len(heads)), lengths), np.concatenate(head_ids)
    head_sizes, head_places = sizes[heads], places[heads]
    mark = np.zeros(len(values), dtype=bool)
    met: dict[int, np.ndarray] = {}
    out = []
    for x in left:
        rows = met.get(groups[x])
        if rows is None:  # the group's partners: no earlier common token, sizes and places that allow the similarity
            at = np.searchsorted(values, before[x])
            mark[at] = True
            earlier = np.bincount(head_of[mark[head_all]], minlength=len(heads)) > 0
            mark[at] = False
            n, m = sizes[x], head_sizes
            fits = ~earlier & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (np.minimum(n - places[x], m - head_places) * (100 + percent) >= percent * (n + m))
            rows = met[groups[x]] = right[fits[of]]
        partners = rows[roots[rows] != roots[x]]
        if not len(partners):
            continue
        mark[own[x]] = True
        lengths = np.array([len(own[y]) for y in partners])
        starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        common = np.add.reduceat(mark[np.concatenate([own[y] for y in partners])].astype(np.int64), starts)
        mark[own[x]] = False
        for y in partners[100 * common >= percent * (sizes[x] + sizes[partners] - common)]:
            a, b = top(x), top(int(y))
            if a != b:
                root[b] = a
                out.append((refs[x], refs[y]))
    return out


def cells_of(batches: Iterator[pd.DataFrame]) -> Iterator[list]:
    """The rows of one cell (list, i, j) after the other, of rows sorted by cell."""
    held: list = []
    for batch in batches:
        for row in batch.itertuples(index=False, name=None):
            if held and held[0][:3] != row[:3]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def in_frames(rows: Iterator[tuple], columns: list[str], size: int = 5000) -> Iterator[pd.DataFrame]:
    while part := list(islice(rows, size)):
        yield pd.DataFrame(part, columns=columns)


def in_cells(rooted: DataFrame, n_lists: int, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Step 6: links (a, b) of members outside their list's main component, with each other and with the rest of the list."""
    rooted = rooted.withColumn("held", F.col("root") == F.col("main"))
    blocks = lambda side: F.ceil(F.greatest(F.count_if(side) / block, F.sum(F.when(side, F.col("n")).otherwise(0)) / BLOCK_SHINGLES)).cast("int")
    sizes = rooted.groupBy("list").agg(blocks(~F.col("held")).alias("ni"), blocks(F.col("held")).alias("nj"))
    rows = rooted.join(small(sizes, n_lists, 32), "list")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("ref"), F.when(F.col("held"), F.col("nj")).otherwise(F.col("ni"))).cast("int"))
    up_to = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    b, none = F.col("block"), F.array().cast("array<struct<i: int, j: int, side: int>>")
    # Cells (i, j) of two blocks outside have j >= 0; (i, -1 - j) pairs a block outside with one of the main component.
    among = F.transform(up_to(F.col("ni")), lambda k: F.struct(F.least(k, b).alias("i"), F.greatest(k, b).alias("j"), F.when(k >= b, 0).otherwise(1).alias("side")))
    aside = F.when(F.col("nj") > 0, F.transform(up_to(F.greatest("nj", F.lit(1))), lambda k: cell(b, -1 - k, 0))).otherwise(none)
    held = F.transform(up_to(F.col("ni")), lambda k: cell(k, -1 - b, 1))
    cells = F.when(F.col("held"), held).otherwise(F.concat(among, aside))
    kept = ["list", "i", "j", "side", "ref", "g", "root", "n", "pos"]
    dealt = rows.join(sets.select("ref", "sketch"), "ref").select("list", F.explode(cells).alias("c"), "ref", "g", "root", "n", "pos", "at", "sketch").select("list", "c.i", "c.j", "c.side", "ref", "g", "root", "n", "pos", "at", "sketch")
    in_order = lambda df: df.repartition(partitions(df.sparkSession), "list", "i", "j").sortWithinPartitions("list", "i", "j")
    names = [*kept, "at"]

    def partnered(rows: list) -> list[tuple]:
        number = lambda k: np.array([r[k] for r in rows], dtype=np.int64)
        side, root, n, pos, shared = number(3), number(6), number(7), number(8), sketches([r[10] for r in rows])
        same = rows[0][1] == rows[0][2]
        right = np.arange(len(rows)) if same else np.flatnonzero(side == 1)
        has = np.zeros(len(rows), dtype=bool)
        for x in np.arange(len(rows)) if same else np.flatnonzero(side == 0):
            m = n[right]
            least = np.minimum(n[x] - pos[x], m - pos[right])
            own = right[(root[right] != root[x]) & (100 * np.minimum(n[x], m) >= percent * np.maximum(n[x], m)) & (least * (100 + percent) >= percent * (n[x] + m))]
            own = own[np.minimum(shared[own], shared[x]).sum(1) * (100 + percent) >= percent * (n[x] + n[own])]
            has[own] = True
            has[x] |= len(own) > 0
        return [r[:10] for r, ok in zip(rows, has, strict=True) if ok]

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from in_frames((row for held in cells_of(batches) for row in partnered(held)), names)

    dealt = in_order(dealt).mapInPandas(thin, "list long, i int, j int, side int, ref long, g long, root long, n long, pos long, at long")
    dealt = materialise(dealt, "partnered")
    dealt = in_order(dealt.join(sets.select("ref", "tokens", "prefix"), "ref").select(*kept, "tokens", F.substring("prefix", 1, 8 * F.col("at")).alias("before")))

    def solve(rows: list) -> list[tuple[int, int]]:
        side = np.array([r[3] for r in rows])
        every = np.arange(len(rows))
        same = rows[0][1] == rows[0][2]  # one block with itself
        left, right = (every, every) if same else (every[side == 0], every[side == 1])
        if not len(left) or not len(right) or len(rows) < 2:
            return []
        number = lambda k: np.array([r[k] for r in rows], dtype=np.int64)
        words = lambda k: [np.frombuffer(r[k], dtype=np.uint64) for r in rows]
        return cell_links([r[4] for r in rows], [r[5] for r in rows], number(6), number(7), number(8), words(9), words(10), left, right, percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from in_frames((link for held in cells_of(batches) for link in solve(held)), ["a", "b"])

    return dealt.mapInPandas(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge, root the least node reachable; alternating large and small stars."""
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        large = both.where("v > u").join(least, "u").select(F.col("w").alias("u"), "v").where("u <> v").distinct()
        large = materialise(large, "large-star")
        down = large.groupBy("v").agg(F.min("u").alias("w"))
        small_ = large.join(down, "v").select(F.explode(F.array(F.struct(F.col("w").alias("u"), F.col("v")), F.struct(F.col("w").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        done, edges = edges, materialise(small_, "small-star")
        discard(done, large)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def joined(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bits: int = REF_BITS) -> DataFrame:
    """(n, root, component) of every row beside its columns other than the text.

    ``docs`` has id, text and what else is to be carried.  Rows that are linked or have equal sets share their root; it
    is null for a row that has no other such row.  component is the root's least id.
    """
    spark = docs.sparkSession
    rows = signatures(docs, words, bits)
    classes = materialise(rows.where("n > 0").groupBy("sig", "ref").agg(F.min("id").alias("least"), F.count("*").alias("rows"), F.first("n").alias("n")), "classes")
    renamed = new_references(classes)
    if renamed:
        new = small(spark.createDataFrame(list(renamed.items()), "sig binary, new long"), len(renamed), 32)
        rows, classes = (x.join(new, "sig", "left").withColumn("ref", F.coalesce("new", "ref")).drop("new") for x in (rows, classes))

    sets = shared_sets(docs, classes, words, percent, bits, renamed)
    lists = candidate_lists(sets)
    found, roots = [], None
    for of_main in (True, False):
        rooted, n_lists = with_roots(lists, roots)
        found.append(materialise(star_links(rooted, n_lists, sets, percent, of_main), "stars"))
        discard(rooted)
        links = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        roots = components(links)
    rooted, n_lists = with_roots(lists, roots)
    block = min(BLOCK_MOST, max(BLOCK_LEAST, rooted.count() // (2 * partitions(docs.sparkSession))))
    final = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(in_cells(rooted, n_lists, sets, percent, block)))
    named = classes.select("ref", "sig", "least", "rows").join(final.select(F.col("node").alias("ref"), "root"), "ref", "left")
    lowest = named.where("root is not null").groupBy("root").agg(F.min("least").alias("lowest"))
    named = named.join(lowest, "root", "left").where("rows > 1 or root is not null").select("ref", F.coalesce("root", "ref").alias("root"), F.coalesce("lowest", "least").alias("component"))
    named = materialise(named, "components")
    discard(lists, rooted, *found)
    return rows.join(named, "ref", "left").drop("ref", "sig")


def near_duplicates(documents: DataFrame, words: int = WORDS, percent: int = PERCENT, text_col: str = "text", id_col: str = "doc_id", bits: int = REF_BITS) -> DataFrame:
    """(id, n_shingles, component_id) of every row; component_id is the least id reachable by links."""
    out = joined(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), words, percent, bits)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one row stays, whatever ids are null or repeated; columns stay as they are.

    It is a row with the least id; of several texts with that id, the one of the least hash.  Rows are told apart by id
    and hash of the text; of rows equal in both, any one stays.
    """
    with small_batches(spark):
        rows = joined(docs.select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("fp"))).where("root is not null")
    rows = materialise(rows.groupBy("root", "id", "fp").agg(F.count("*").alias("rows")), "near")
    best = materialise(rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "fp")).alias("best")), "near-best")
    rows = rows.join(small(best, best.count(), 64), "root").withColumn("stays", F.col("id").eqNullSafe(F.col("best.id")) & (F.col("fp") == F.col("best.fp")))
    id_, fp, n = (fresh(c, docs) for c in ("of_id", "of_fp", "own_rank"))
    rows = materialise(rows.select(F.col("id").alias(id_), F.col("fp").alias(fp), F.col("rows").alias("n_rows"), F.col("stays").alias("is_kept")), "near-decided")
    gone, again = rows.where("not is_kept").select(id_, fp), rows.where("is_kept and n_rows > 1").select(id_, fp)
    own = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(fp))
    kept = docs.join(small(gone, gone.count(), 24), own, "left_anti")
    n_again = again.count()
    if not n_again:
        return kept
    again = small(again, n_again, 24)
    text = F.xxhash64("text")
    one = kept.withColumn(n, F.row_number().over(Window.partitionBy("doc_id", text).orderBy(text))).where(F.col(n) == 1).drop(n)
    return kept.join(again, own, "left_anti").unionByName(one.join(again, own, "left_semi"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i + 1 : i + 5], ' ')) AS s FROM d, unnest(range(greatest(len(w) - 4, 1))) AS t(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT x AS doc_id, y AS other FROM both_ways UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON r.other = b.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(r.other), d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach r USING (doc_id) GROUP BY d.doc_id, n.n
"""
