"""Text extraction from file bytes: dispatch by extension, then by mime type."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from importlib.util import find_spec
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col, extension, mime_base, strip

# Handler of every supported extension and mime type.
BY_EXTENSION = {".txt": "plain", ".md": "plain", ".pdf": "pdf", ".docx": "docx", ".png": "image", ".jpg": "image", ".jpeg": "image", ".webp": "image"}
BY_MIME = {"text/plain": "plain", "text/markdown": "plain", "application/pdf": "pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "image/png": "image", "image/jpeg": "image", "image/webp": "image"}
MAX_BYTES = 20 * 1024 * 1024
LEAST_CHARS = 20
RESULT = "text string, method string, confidence int"


def handler(name: Column | str, mime: Column | str) -> Column:
    """plain, pdf, docx or image; null when neither extension nor mime type is supported."""
    look = lambda table, key: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]
    return F.coalesce(look(BY_EXTENSION, extension(name)), look(BY_MIME, mime_base(mime)))


def vision_path(handler_col: Column | str) -> Column:
    return F.when(col(handler_col).isin("image", "pdf"), col(handler_col))


def plain_text(data: bytes) -> str | None:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    return text.strip() or None


def native_or_vision(text: Column | str) -> Column:
    """The rule for paged files: over 20 characters that are not white space are native text, else vision is needed."""
    enough = F.length(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?U)\s", "")) > LEAST_CHARS
    return F.when(enough, F.struct(strip(text).alias("text"), F.lit("native_text").alias("method"), F.lit(5).alias("confidence"))).otherwise(F.struct(F.lit(None).cast("string").alias("text"), F.lit("needs_vision").alias("method"), F.lit(0).alias("confidence")))


def _need(library: str) -> None:
    """Missing software must not look like a file without text."""
    if not find_spec(library):
        raise ModuleNotFoundError(f"reading this kind of file needs {library}", name=library)


def _pages(data: bytes) -> str | None:
    _need("pypdf")
    from pypdf import PdfReader

    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)


def _paragraphs(data: bytes) -> str | None:
    _need("docx")
    from docx import Document

    return "\n".join(p.text for p in Document(io.BytesIO(data)).paragraphs).strip() or None


def read_one(kind: str, data: bytes) -> tuple[str | None, str, int]:
    if kind == "image":
        return None, "needs_vision", 0
    if kind == "pdf":
        text = _pages(data)
        return (text.strip(), "native_text", 5) if text and len("".join(text.split())) > LEAST_CHARS else (None, "needs_vision", 0)
    return (plain_text(data) if kind == "plain" else _paragraphs(data)), "native_text", 5


MOST_PAGES = 25


def seen_text(data: bytes, kind: str, vision: Callable[[bytes], str | None], pages: Callable[[bytes], Iterator[bytes]] | None = None) -> str | None:
    """What ``vision`` reads from an image or the first ``MOST_PAGES`` page images of a file, a blank line between; a page that fails is passed over."""
    found = []
    for page in islice(pages(data) if pages and kind == "pdf" else iter([data]), MOST_PAGES):
        try:
            text = vision(page)
        except Exception:  # noqa: BLE001 - a model may fail in any way
            continue
        if text and text.strip():
            found.append(text.strip())
    return "\n\n".join(found) or None


def extract_files(files: DataFrame, vision: Callable[[bytes], str | None] | None = None, pages: Callable[[bytes], Iterator[bytes]] | None = None) -> DataFrame:
    """Adds ``extracted`` (text, method, confidence) to (name, mime, content); unsupported kinds and missing libraries raise.

    ``vision`` reads a page image where native text is missing, ``pages`` makes page images of a paged file; what is read so has confidence 4.
    """

    @F.pandas_udf(RESULT)
    def extracted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for kinds, contents in batches:
            rows = []
            for kind, data in zip(kinds, contents, strict=True):
                if kind is None:
                    raise ValueError("unsupported file type")
                row = read_one(kind, data)
                if row[1] == "needs_vision" and vision:
                    seen = seen_text(data, kind, vision, pages)
                    row = (seen, "vision_ocr", 4) if seen else row
                rows.append(row)
            yield pd.DataFrame(rows, columns=["text", "method", "confidence"])

    return files.withColumn("extracted", extracted(handler("name", "mime"), "content"))


def upload_errors(name: Column | str, size: Column | str) -> Column:
    """Why an upload is refused; null when it is accepted."""
    n = col(name)
    return F.when(n.rlike(r"\.\.|/|\\") | (n == ""), "bad_name").when(~extension(n).isin(*BY_EXTENSION), "unsupported_type").when(col(size) > MAX_BYTES, "too_large")
