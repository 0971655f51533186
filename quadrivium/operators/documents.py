"""Document and chunk stores: filters, look-ups, bulk loading and mutations as functions of (table, change)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunking import CHUNK_CHARS, OVERLAP_CHARS, chunk_documents
from ..functions.text import blank, filled, uuid_id

# Store type of each kind of page item.
CONTENT_TYPES = {"Assignment": "assignment", "Test": "assignment", "Discussion": "discussion", "PDF": "document", "Text Document": "document", "Presentation": "document", "Link": "other", "Video": "other", "Photo": "other", "Learning Module": "other", "Open Folder": "other"}
TENANT = {"user_id": "local", "school_id": "default"}
DOCUMENT_FIELDS = ("source_type", "course_id", "content_type", "semester_id")


def equal_to(rows: DataFrame, **wanted) -> DataFrame:
    """Conjunction of the equalities whose value is given; they reach the scan as pushed filters."""
    for name, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(name) == F.lit(value))
    return rows


def list_documents(documents: DataFrame, include_deleted: bool = False, **wanted) -> DataFrame:
    rows = equal_to(documents, **wanted)
    return rows if include_deleted else rows.where(F.col("deleted_at").isNull())


def list_chunks(chunks: DataFrame, with_embedding_only: bool = False, metadata: dict | None = None, **wanted) -> DataFrame:
    """Chunks of soft-deleted documents stay in the list, as in the store this follows."""
    rows = equal_to(chunks, **wanted, **{f"metadata.{k}": v for k, v in (metadata or {}).items()})
    return rows.where(F.size("embedding") > 0) if with_embedding_only else rows


def live_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The repaired form: without chunks of soft-deleted documents."""
    return chunks.join(documents.where(F.col("deleted_at").isNotNull()).select(F.col("id").alias("document_id")), "document_id", "left_anti")


def point(rows: DataFrame, key: str, column: str = "id") -> DataFrame:
    """First row with the id; deleted ones too."""
    return rows.where(F.col(column) == key).limit(1)


def chunks_of(chunks: DataFrame, document_id: str) -> DataFrame:
    return chunks.where(F.col("document_id") == document_id).orderBy(F.coalesce("chunk_index", F.lit(0)))


def content_type(raw: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CONTENT_TYPES.items() for x in kv])
    return F.coalesce(table[F.col(raw) if isinstance(raw, str) else raw], F.lit("other"))


def meta(documents: DataFrame) -> DataFrame:
    return documents.select("id", "title", "content_type", "original_filename")


def title_of(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds ``doc_title``, 'document' where none is live."""
    titles = documents.where(F.col("deleted_at").isNull()).select(F.col("id").alias("document_id"), F.col("title").alias("doc_title"))
    return hits.join(titles, "document_id", "left").withColumn("doc_title", F.coalesce("doc_title", F.lit("document")))


def new_items(items: DataFrame, existing: DataFrame) -> DataFrame:
    """Items with an ``outcome``: created, skipped_empty or skipped_existing.

    Blank title or text: empty.  Else the key is the URL, or the title where
    there is none; known keys and later repeats (by ``pos``) exist.  Titles of
    stored documents that have a URL do not count.  First-in-run is one
    aggregation per key, so a key with very many items does not gather them.
    """
    url = filled("url")
    keyed = items.withColumn("__empty", blank("title") | blank("text")).withColumn("__key", F.when(url.isNotNull(), F.concat(F.lit("u:"), url)).otherwise(F.concat(F.lit("t:"), "title")))
    stored = filled(F.col("user_provided_metadata")["source_url"])
    known = existing.select("course_id", F.when(stored.isNotNull(), F.concat(F.lit("u:"), stored)).otherwise(F.concat(F.lit("t:"), "title")).alias("__key")).distinct().withColumn("__known", F.lit(True))
    first = keyed.where("not __empty").groupBy("course_id", "__key").agg(F.min("pos").alias("__first"))
    out = keyed.join(known, ["course_id", "__key"], "left").join(first, ["course_id", "__key"], "left")
    outcome = F.when(F.col("__empty"), "skipped_empty").when(F.col("__known") | (F.col("pos") != F.col("__first")), "skipped_existing").otherwise("created")
    return out.withColumn("outcome", outcome).drop("__empty", "__key", "__known", "__first")


def new_summaries(summaries: DataFrame, existing: DataFrame) -> DataFrame:
    """One summary document per course: courses without one, blank texts left out."""
    have = existing.where(F.col("content_type") == "course_summary").select("course_id").distinct()
    return summaries.where(~blank("summary")).join(have, "course_id", "left_anti")


def outcomes(loaded: DataFrame) -> DataFrame:
    return loaded.groupBy("outcome").agg(F.count("*").alias("n"))


def create(rows: DataFrame, now: str) -> DataFrame:
    """Documents from (title, extracted_text, ...): defaults filled in, ids from the natural key and ``now``."""
    has = set(rows.columns)
    get = lambda c, default=None: (F.coalesce(F.col(c), F.lit(default)) if default is not None else F.col(c)) if c in has else F.lit(default)
    text = lambda c, default=None: get(c, default).cast("string").alias(c)
    ids = uuid_id("doc_", *[c for c in ("course_id", "title", "url", "pos") if c in has], F.lit(now))
    return rows.select(
        ids.alias("id"), text("user_id", TENANT["user_id"]), text("school_id", TENANT["school_id"]), text("source_type", "upload"), text("course_id"), text("topic"), text("title"), text("original_filename"),
        text("content_type", "document"), text("extracted_text"), text("extraction_method", "native_text"), get("extraction_confidence", 5).cast("int").alias("extraction_confidence"), text("original_file_path"),
        text("mime_type"), get("file_size_bytes").cast("bigint").alias("file_size_bytes"), text("thread_id"), text("semester_id"), F.lit("pending").alias("embeddings_status"), F.lit(None).cast("string").alias("embedding_model"),
        F.lit(0).alias("chunk_count"), (F.col("user_provided_metadata") if "user_provided_metadata" in has else F.create_map().cast("map<string, string>")).alias("user_provided_metadata"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"), F.lit(None).cast("string").alias("deleted_at"),
    )


def update(documents: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """Overwrite fields by id; ``changes`` has id and any fields but id and created_at, null leaves a field."""
    fields = [c for c in changes.columns if c not in ("id", "created_at", "updated_at")]
    new = changes.select("id", F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in fields])
    out = documents.join(new, "id", "left").withColumn("updated_at", F.when(F.col("__hit"), F.lit(now)).otherwise(F.col("updated_at")))
    return out.withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in fields}).select(*documents.columns)


def soft_delete(documents: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """Sets deleted_at; updated_at stays."""
    return _marked(documents, ids, lambda hit: {"deleted_at": F.when(hit, F.lit(now)).otherwise(F.col("deleted_at"))})


def restore(documents: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """Clears deleted_at and bumps updated_at."""
    return _marked(documents, ids, lambda hit: {"deleted_at": F.when(~hit, F.col("deleted_at")), "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))})


def _marked(rows: DataFrame, ids: DataFrame, change: Callable[[Column], dict]) -> DataFrame:
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    return rows.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left").withColumns(change(hit)).select(*rows.columns)


def expired(rows: DataFrame, as_of: str, days: int) -> DataFrame:
    """Deleted more than ``days`` before ``as_of``; times that do not parse are kept."""
    limit = F.to_timestamp(F.lit(as_of)) - F.expr(f"interval {days} days")
    return rows.where(F.coalesce(F.try_to_timestamp("deleted_at") < limit, F.lit(False)))


def purge(documents: DataFrame, chunks: DataFrame, as_of: str, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """Documents deleted long ago and their chunks go."""
    gone = expired(documents, as_of, days).select("id")
    return documents.join(gone, "id", "left_anti"), chunks.join(gone.select(F.col("id").alias("document_id")), "document_id", "left_anti")


def add_chunks(documents: DataFrame, pieces: DataFrame, now: str) -> DataFrame:
    """Chunk rows of (document_id, chunk_index, text): tenancy and metadata from the parent.

    A piece without a parent document is an error when the result is computed.
    """
    parent = documents.select(F.col("id").alias("document_id"), "user_id", "school_id", F.struct(*DOCUMENT_FIELDS).alias("metadata"), F.lit(True).alias("__parent"))
    rows = pieces.join(parent, "document_id", "left")
    checked = F.when(F.col("__parent").isNull(), F.raise_error(F.concat(F.lit("no document "), F.col("document_id"))).cast("string")).otherwise(uuid_id("chunk_", "document_id", "chunk_index"))
    return rows.select(checked.alias("id"), "document_id", "user_id", "school_id", F.col("chunk_index").cast("int").alias("chunk_index"), "text", F.lit(None).cast("array<double>").alias("embedding"), "metadata", F.lit(now).alias("created_at"))


def delete_chunks(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids.select(F.col("id").alias("document_id")), "document_id", "left_anti")


def chunk_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with ``chunk_count`` derived from the chunks, never stored apart."""
    n = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count("*").cast("int").alias("__n"))
    return documents.join(n, "id", "left").withColumn("chunk_count", F.coalesce("__n", F.lit(0))).select(*documents.columns)


def pending_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.coalesce(F.size("embedding"), F.lit(0)) <= 0)


def pending_documents(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("embeddings_status") == "pending")


def set_embeddings(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Merge (id, vector) into the chunks."""
    return chunks.join(vectors.select("id", F.col("vector").alias("__vector")), "id", "left").withColumn("embedding", F.coalesce("__vector", "embedding")).select(*chunks.columns)


def embed_chunks(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 64, tries: int = 3) -> DataFrame:
    """(id, vector) of pending chunks by an injected embedder; null for a batch that failed every try."""
    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), batch):
                part, vectors = frame.iloc[at : at + batch], None
                for _ in range(tries):
                    try:
                        vectors = [[float(x) for x in v] for v in embed(part["text"].tolist())]
                        break
                    except Exception:  # noqa: BLE001 - an embedder may fail in any way
                        continue
                yield pd.DataFrame({"id": part["id"], "vector": vectors if vectors is not None else [None] * len(part)})

    return pending_chunks(chunks).select("id", "text").mapInPandas(run, "id string, vector array<double>")


def embedding_status(documents: DataFrame, chunks: DataFrame, model: str) -> DataFrame:
    """'embedded' where any chunk has a vector, else 'failed' and no model."""
    any_ = chunks.groupBy(F.col("document_id").alias("id")).agg(F.bool_or(F.size("embedding") > 0).alias("__any"))
    hit = F.coalesce(F.col("__any"), F.lit(False))
    out = documents.join(any_, "id", "left").withColumns({"embeddings_status": F.when(hit, "embedded").otherwise("failed"), "embedding_model": F.when(hit, F.lit(model))})
    return out.select(*documents.columns)


def embedding_totals(chunks: DataFrame) -> DataFrame:
    has = F.coalesce(F.size("embedding") > 0, F.lit(False))
    return chunks.agg(F.count("*").alias("processed"), F.count_if(has).alias("embedded"), F.count_if(~has).alias("failed"))


def ingest(rows: DataFrame, now: str, embed: Callable | None = None, limit: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks of non-blank texts, embedded when an embedder is given."""
    docs = create(rows.where(~blank("extracted_text")), now)
    chunks = add_chunks(docs, chunk_documents(docs, limit=limit, overlap=overlap), now)
    if embed:
        chunks = set_embeddings(chunks, embed_chunks(chunks, embed))
    return chunk_counts(docs, chunks), chunks


def attachment_texts(ids: DataFrame, documents: DataFrame, chunks: DataFrame, limit: int = 12_000) -> DataFrame:
    """(pos, doc_id, title, text) of attached ids in their order: chunks joined by newlines, cut with a mark.

    Only the chunks that begin within the limit, or right behind it, are gathered, whatever the length of the document:
    one that begins behind a newline at the limit is not shown, but it is what is cut.
    """
    earlier = Window.partitionBy("document_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    attached = chunks.join(ids.select(F.col("doc_id").alias("document_id")).distinct(), "document_id", "left_semi")
    needed = attached.withColumn("__before", F.coalesce(F.sum(F.length("text") + 1).over(earlier), F.lit(0))).where(F.col("__before") <= limit + 1)
    joined = needed.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda c: c["text"]), "\n").alias("text"))
    rows = ids.join(documents.select(F.col("id").alias("doc_id"), "title"), "doc_id").join(joined.withColumnRenamed("document_id", "doc_id"), "doc_id")
    cut = F.when(F.length("text") > limit, F.concat(F.left("text", F.lit(limit)), F.lit("\n[... truncated]"))).otherwise(F.col("text"))
    return rows.select("pos", "doc_id", "title", cut.alias("text"))


def latest_by(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """First row per key in an order; the window keeps rank 1 only, so ranks are limited before the shuffle."""
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__rank = 1").drop("__rank")
