"""Overlapping text chunks: an Arrow-batched UDF, since each chunk seeds the next."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS, OVERLAP_CHARS = 1500, 200
#: Coarse to fine; text without any of them is cut hard.
SEPARATORS = ("\n\n", "\n", ". ", " ")


def segments(text: str, limit: int) -> Iterator[str]:
    """Pieces of at most ``limit`` characters whose concatenation is the text.

    A worklist holds (piece, next separator): a piece that is too long is cut
    after every occurrence of the first separator it contains, its parts going
    on with the finer ones.
    """
    work = [(text, 0)]
    while work:
        piece, level = work.pop()
        if len(piece) <= limit:
            yield piece
            continue
        while level < len(SEPARATORS) and SEPARATORS[level] not in piece:
            level += 1
        if level == len(SEPARATORS):
            yield from (piece[i : i + limit] for i in range(0, len(piece), limit))
            continue
        mark, parts, at = SEPARATORS[level], [], 0
        while (end := piece.find(mark, at)) >= 0:
            parts.append(piece[at : end + len(mark)])
            at = end + len(mark)
        if at < len(piece):
            parts.append(piece[at:])
        work.extend((p, level + 1) for p in reversed(parts))


def chunk_text(text: str | None, limit: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[str]:
    """Chunks of up to ``limit`` characters beyond the overlap carried from the chunk before."""
    out: list[str] = []
    held, size = [], 0
    for piece in segments(text, limit) if text and not text.isspace() else ():
        if size and size + len(piece) > limit:
            out.append("".join(held))
            held = [out[-1][-overlap:]] if overlap else []
            size = sum(map(len, held))
        held.append(piece)
        size += len(piece)
    if size:
        out.append("".join(held))
    return [c for c in (x.strip() for x in out) if c]


def chunk_documents(documents: DataFrame, id_col: str = "id", text_col: str = "extracted_text", limit: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(document_id, chunk_index, text): one row per chunk, numbered from 0."""

    @F.pandas_udf("array<string>")
    def chunked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunk_text(t, limit, overlap))

    return documents.select(F.col(id_col).alias("document_id"), F.posexplode(chunked(F.col(text_col))).alias("chunk_index", "text"))
