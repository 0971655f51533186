"""SentencePiece encoding and decoding through a merge-type prefix table.

For every prefix of a segment the table holds the last token of that prefix's
one valid encoding.  Candidates are the vocabulary pieces that an Aho-Corasick
automaton finds ending there; the right one is the only one that is
pair-compatible with the last token of the shorter prefix, that is, the two
pieces encode to themselves when they stand next to each other.  Ids are then
recovered backwards from the end of the table.  Work is linear in the text.

The pair test walks the two pieces' merges backwards from the latest, and asks
at every step whether what touches at the boundary would have merged earlier.
It needs merges to come in the order of their rank; the few pieces built
otherwise (runs of spaces, which share one score) are tested by merging.

No piece of the vocabulary has a space mark after another character (checked
when the model is loaded), so no merge crosses such a place and the text is cut
there; segments repeat, and those of up to ``CACHED_CHARS`` are kept in a bounded cache.

Characters outside the vocabulary fall back to one id per UTF-8 byte.

Edge cases: null counts as empty, which encodes to the end id alone; texts of
any length are encoded whole; an empty table gives no rows.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hand_back, materialise, small_batches, table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*")
CACHED_CHARS, CACHED_SEGMENTS, CACHED_PAIRS = 64, 300_000, 200_000
#: Segments kept in the pipeline.
STAGE_SEGMENTS = 60_000
#: Tables of segment beginnings of so many characters are kept too: a prefix's entry does not depend on what follows.
HEAD_CHARS, CACHED_HEADS = 8, 100_000
#: Characters of text encoded before a batch of results is passed on.
BATCH_CHARS = 1 << 20


class PieceEncoder:
    """Encodes as the library does: identity normaliser, dummy prefix, highest score first, leftmost among equals."""

    def __init__(self, path: str):
        self.cached = CACHED_SEGMENTS
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end = sp.eos_id()
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.piece: list[str] = []
        self.automaton = ahocorasick.Automaton()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.piece.append(piece)
            if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                continue
            if SPACE in piece.lstrip(SPACE):
                raise ValueError(f"piece {piece!r} crosses a segment boundary")
            self.score[piece], self.id[piece] = sp.get_score(i), i
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.splits: dict[str, tuple] = {}
        self.pairs: dict[int, bool] = {}
        self.heads: dict[str, list[int]] = {}
        self.shift = len(self.piece).bit_length()
        self.length = [len(p) for p in self.piece]
        # Two generations: a full young one replaces the old one, and what is used again moves back.
        self.segments: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The defining merge loop, used only on the few characters of one or two pieces."""
        return [p for p, *_ in self._merge(text)[0]]

    def _merge(self, text: str) -> tuple[list[tuple[str, float, bool]], tuple | None]:
        """Parts as (text, rank of the merge that made it, out of order), and the last merge."""
        parts, last = [(c, -1.0, False) for c in text], None
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i][0] + parts[i + 1][0])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            left, right = parts[at : at + 2]
            odd = left[2] or right[2] or max(left[1], right[1]) >= -best
            last = (left[0], right[0])
            parts[at : at + 2] = [(left[0] + right[0], -best, odd)]
        return parts, last

    def split(self, piece: str) -> tuple[float, str, str, bool, bool]:
        """(rank, left part, right part, merges out of order, encodes to itself); rank -1: a single character."""
        found = self.splits.get(piece)
        if found is None:
            parts, last = self._merge(piece)
            whole = len(parts) == 1
            found = self.splits[piece] = (parts[0][1] if whole else -1.0, *(last if whole and last else (piece, piece)), whole and parts[0][2], whole)
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two pieces, side by side, encode to themselves; ``left`` -1: nothing or an unknown character."""
        key = (left + 1) << self.shift | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.split(self.piece[right])[4] if left < 0 else self._stand(self.piece[left], self.piece[right])
        return found

    def _stand(self, x: str, y: str) -> bool:
        own, other = self.split(x), self.split(y)
        if not (own[4] and other[4]):
            return False
        if own[3] or other[3]:
            return self.merged(x + y) == [x, y]
        limit, also_equal, score = float("inf"), False, self.score
        while True:
            crossing = score.get(x + y)
            if crossing is not None and (-crossing < limit or also_equal and -crossing == limit):
                return False
            if own[0] < 0 and other[0] < 0:
                return True
            # Undo the later merge; of equal ones the right one came later, and a crossing merge would have come before it.
            if own[0] > other[0]:
                limit, also_equal, x = own[0], False, own[2]
                own = self.split(x)
            else:
                limit, also_equal, y = other[0], True, other[1]
                other = self.split(y)

    def segment(self, text: str) -> array:
        size = len(text)
        head = text[:HEAD_CHARS] if size > HEAD_CHARS else None
        known = self.heads.get(head) if head else None
        if known is None:
            last, done = [-1] * (size + 1), 0
        else:
            last, done = known + [-1] * (size - HEAD_CHARS), HEAD_CHARS
        pairs, test, shift = self.pairs, self.compatible, self.shift
        for end, (token, length) in self.automaton.iter(text):
            if end < done:
                continue
            end += 1
            if last[end] < 0:  # else found already; -1 stays for a character outside the vocabulary
                before = last[end - length]
                fits = pairs.get((before + 1) << shift | token)
                if test(before, token) if fits is None else fits:
                    last[end] = token
        if head and known is None:
            if len(self.heads) >= CACHED_HEADS:
                self.heads.clear()
            self.heads[head] = last[: HEAD_CHARS + 1]
        out, at, width = [], size, self.length
        while at:
            token = last[at]
            if token >= 0:
                out.append(token)
                at -= width[token]
            else:
                out += [self.byte[b] for b in reversed(text[at - 1].encode("utf-8"))]
                at -= 1
        return array("i", out[::-1])

    def fetch(self, piece: str) -> bytes:
        """The ids, as bytes, of a segment that the young generation does not hold."""
        ids = self.segments.get(piece) or self.older.get(piece)
        if ids is None:
            ids = self.segment(piece).tobytes()
        if len(piece) <= CACHED_CHARS:
            if len(self.segments) >= self.cached:
                self.older, self.segments = self.segments, {}
            self.segments[piece] = ids
        return ids

    def encode(self, text: str) -> array:
        out = array("i")
        if text:
            known, fetch = self.segments.get, self.fetch
            out.frombytes(b"".join([known(piece) or fetch(piece) for piece in SEGMENT.findall(SPACE + text.replace(" ", SPACE))]))
        out.append(self.end)
        return out

    def decode(self, ids) -> str:
        return self.library.decode(list(ids))


_loaded: dict[str, PieceEncoder] = {}


def encoder(path: str, cached: int = CACHED_SEGMENTS) -> PieceEncoder:
    """One per worker process: the automaton and the caches, of ``cached`` segments a generation, outlive a batch."""
    if path not in _loaded:
        _loaded[path] = PieceEncoder(path)
    _loaded[path].cached = cached
    return _loaded[path]


def model_path(name: str = MODEL) -> str:
    return public_tokenizers.path(name)


def encode_documents(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id", path: str | None = None, cached: int = CACHED_SEGMENTS, keep: bool = True) -> DataFrame:
    """(id, ids, decoded): ids with the end id, and the text they decode to; ``keep``: workers keep caches from task to task."""
    path = path or model_path()
    docs = documents.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, cached) if keep else PieceEncoder(path)
        own.cached = cached
        for batch in batches:
            texts = batch.column(1)
            ids, offsets, decoded, first, chars = array("i"), [0], [], 0, 0
            for i in range(len(texts)):
                text = texts[i].as_py()
                one = own.encode(text)
                ids.extend(one)
                offsets.append(len(ids))
                decoded.append(own.decode(one))
                chars += len(text)
                if chars >= BATCH_CHARS or i == len(texts) - 1:
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(ids, dtype=np.int32)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, i + 1 - first), lists, pa.array(decoded, pa.string())], names=[id_col, "ids", "decoded"])
                    ids, offsets, decoded, first, chars = array("i"), [0], [], i + 1, 0
        del own
        hand_back()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def decode_documents(encoded: DataFrame, ids_col: str = "ids", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """(id, decoded) from arrays of ids; null decodes to the empty text."""
    path = path or model_path()

    @F.pandas_udf("string")
    def decoded(lists):
        own = encoder(path)
        return lists.map(lambda ids: "" if ids is None else own.decode([int(i) for i in ids]))

    return encoded.select(id_col, decoded(F.col(ids_col)).alias("decoded"))


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return encoded.select(id_col, F.size("ids").cast("long").alias("n_tokens"), sha(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(table(spark, sf_dir, "documents")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: id and text digests of every document kept.

    Its workers also serve what comes after, so a task's caches are small and end with it.
    """
    with small_batches(spark):
        return materialise(digests(encode_documents(docs, cached=STAGE_SEGMENTS, keep=False)), "encoded")
