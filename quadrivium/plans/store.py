"""Store, retrieval and content queries: ``documents`` and ``embeddings`` stand for the stores, ``pages`` for scraped items."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import extraction, text
from ..functions.chunking import chunk_documents
from ..functions.html import html_text
from ..operators import audit, content, context, documents, retrieval, threads
from .tables import table

QUERY = [round(math.cos(i), 3) for i in range(64)]
NOW = "2024-01-01T00:00:00+00:00"


def stored(spark, sf_dir):
    """documents in the store's schema: source is the course, lang the content type, the first 60 characters the title."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("pos"), F.left("text", F.lit(60)).alias("title"), F.col("source").alias("course_id"), F.col("lang").alias("content_type"), F.col("text").alias("extracted_text"), F.lit(None).cast("string").alias("deleted_at"))


def filter_lang_source(spark, sf_dir):
    return documents.list_documents(stored(spark, sf_dir), course_id="src3", content_type="en").select("id", F.length("extracted_text").cast("long").alias("n_chars"))


def first_by_text(spark, sf_dir):
    """First row of every distinct text, by two aggregations without a window."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


def page_items(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    clean = F.regexp_replace("url", "[?#].*$", "")
    return p.select("page_id", F.col("page_id").alias("pos"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("course_id"), clean.alias("url"), F.col("url").alias("title"), F.col("html").alias("text"), F.when(F.contains("url", F.lit("?")), "Photo").when(F.contains("url", F.lit("#")), "Video").otherwise("PDF").alias("content_type"))


def loaded(spark, sf_dir):
    items = page_items(spark, sf_dir)
    held = items.where(F.startswith("url", F.lit("https://www."))).select("course_id", "title", F.create_map(F.lit("source_url"), F.col("url")).alias("user_provided_metadata"))
    return documents.new_items(items, held)


def pages_new_by_url(spark, sf_dir):
    return loaded(spark, sf_dir).select("page_id", "outcome")


def pages_load_outcomes(spark, sf_dir):
    return documents.outcomes(loaded(spark, sf_dir))


def pages_classify(spark, sf_dir):
    u = F.concat(F.regexp_replace("url", "/[0-9]+$", "/outline/"), F.when(F.col("page_id") % 4 == 0, "file/").when(F.col("page_id") % 4 == 1, "edit/document/").when(F.col("page_id") % 4 == 2, "assessment/").otherwise(""))
    rows = page_items(spark, sf_dir).withColumn("url", u)
    return rows.select("page_id", content.classify("example.com").alias("class"), documents.content_type("content_type").alias("kind"))


def pages_read_rollup(spark, sf_dir):
    status = F.when(F.col("content_type") == "Photo", "image_based").when(F.col("content_type") == "Video", "skipped").otherwise(content.read_status("text", "failed"))
    return audit.read_rollup(page_items(spark, sf_dir).withColumn("failed", F.lit(False)).withColumn("read_status", status))


def pages_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html_text("html").alias("text"))


def pages_handlers(spark, sf_dir):
    name = F.concat(F.lit("page"), F.element_at(F.array(*[F.lit(x) for x in (".PDF", ".txt", ".docx", ".jpeg", ".bin")]), (F.col("page_id") % 5 + 1).cast("int")))
    rows = table(spark, sf_dir, "pages").select("page_id", name.alias("name"), F.lit("Text/Plain; charset=utf-8").alias("mime"), F.length("html").alias("size"))
    return rows.select("page_id", extraction.handler("name", "mime").alias("handler"), extraction.upload_errors("name", "size").alias("error"))


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def vector_top8(spark, sf_dir):
    return retrieval.search(vectors(spark, sf_dir), QUERY, key="vec_id").select("vec_id", "label", F.round("score", 6).alias("score"))


def vector_topk_per_label(spark, sf_dir):
    return retrieval.search_each(vectors(spark, sf_dir), QUERY, "label", key="vec_id").select("label", "rank", "vec_id", F.round("score", 6).alias("score"))


def embeddings_status(spark, sf_dir):
    e = vectors(spark, sf_dir)
    docs = e.select(F.col("label").cast("string").alias("id")).distinct().withColumns({"embeddings_status": F.lit("pending"), "embedding_model": F.lit(None).cast("string")})
    return documents.embedding_status(docs, e.select(F.col("label").cast("string").alias("document_id"), F.when(F.col("label") > 2, F.col("embedding")).alias("embedding")), "local")


def embedding_merge(spark, sf_dir):
    """Vectors written into the chunks that lack one, then counted."""
    e = vectors(spark, sf_dir).select(F.col("vec_id").cast("string").alias("id"), "label", "embedding")
    held = e.withColumn("embedding", F.when(F.col("label") < 5, F.col("embedding")))
    new = e.where(F.col("label").isin(5, 6)).select("id", F.col("embedding").alias("vector"))
    return documents.embedding_totals(documents.set_embeddings(held, new))


def chunks(spark, sf_dir):
    return chunk_documents(stored(spark, sf_dir))


def chunk_counts(spark, sf_dir):
    return chunks(spark, sf_dir).groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.max(F.length("text")).alias("longest"))


def attachment_texts(spark, sf_dir):
    docs = stored(spark, sf_dir)
    return documents.attachment_texts(docs.select("pos", F.col("id").alias("doc_id")), docs, chunks(spark, sf_dir))


def key_documents(spark, sf_dir):
    """orders as items: status gives the type, priority the title, every third customer's text names a due date."""
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "P", "Discussion board").when(F.col("o_orderstatus") == "F", "Text Document").otherwise("PDF")
    body = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("The DUE DATE of "), F.col("o_orderkey"))).otherwise(F.repeat("o_orderpriority", F.col("o_custkey").cast("int") % 1000))
    items = o.select("o_orderkey", F.concat(F.when(F.col("o_orderkey") % 10 == 0, "Course Outline ").otherwise("Order "), F.col("o_orderpriority")).alias("title"), kind.alias("content_type"), body.alias("extracted_text"))
    return items.where(content.is_key_item()).select("o_orderkey")


def doc_snippets(spark, sf_dir):
    return stored(spark, sf_dir).select("id", text.snippet("extracted_text").alias("snippet"))


def compact_index(spark, sf_dir):
    """Customers as the items of their nation."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    items = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_nationkey").cast("string").alias("course_id"), F.col("n_name").alias("course_name"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("content_type"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("container_name"), *[F.lit(None).cast("string").alias(x) for x in ("due_date", "due_date_raw", "description", "subtext")], F.col("c_name").alias("extracted_text"))
    return content.compact_index(items).select("course_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


def carried_containers(spark, sf_dir):
    """System turns as containers, every third turn nested."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("role", F.lit(" "), F.col("turn").cast("string")).alias("title"), (F.col("role") == "system").alias("is_container"), (F.col("turn") % 3 == 0).alias("is_nested"), F.lit(None).cast("string").alias("parent_container"))
    return content.carried_containers(rows, course="conv_id", pos="turn").select("conv_id", "turn", "container_name")


def spoken(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("pos"), "role", F.col("text").alias("content"))


def thread_titles(spark, sf_dir):
    return threads.titles(spoken(spark, sf_dir))


def thread_roles(spark, sf_dir):
    return threads.roles(spoken(spark, sf_dir))


def thread_first_messages(spark, sf_dir):
    return threads.first_messages(spoken(spark, sf_dir)).select("thread_id", "pos", "role")


def thread_attachments(spark, sf_dir):
    """Roles as attached files: every thread's distinct ones in first-seen order."""
    m = spoken(spark, sf_dir).withColumn("attachments", F.array(F.struct(F.col("role").alias("doc_id"), F.col("role").alias("name"))))
    return threads.attachments(m).select("thread_id", F.array_join("doc_ids", ",").alias("doc_ids"))


def thread_list(spark, sf_dir):
    t = spoken(spark, sf_dir).groupBy(F.col("thread_id").alias("id")).agg(F.max("content").alias("updated_at"), F.count("*").alias("turns"))
    return threads.list_threads(t.withColumn("deleted_at", F.when(F.col("turns") < 4, F.lit(NOW)))).select("id", "turns")


def prompt_context(spark, sf_dir):
    """Context for one question over the labels as courses, with summaries, excerpts and an attachment."""
    e = vectors(spark, sf_dir)
    chunk = e.select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").cast("string").alias("document_id"), F.concat(F.lit("text "), F.col("vec_id")).alias("text"), "embedding", F.struct(F.col("label").cast("string").alias("course_id"), F.when(F.col("label") == 1, "course_summary").otherwise("document").alias("content_type")).alias("metadata"))
    courses = e.groupBy("label").agg(F.count("*").alias("n")).select(F.col("label").alias("pos"), F.col("label").cast("string").alias("course_id"), F.concat(F.lit("Course "), F.col("label")).alias("course_name"))
    found = context.excerpts(chunk, stored(spark, sf_dir), QUERY, courses)
    return context.build_context(courses, courses.select("course_id", F.concat(F.lit("Summary "), F.col("course_id")).alias("summary")), found)


QUERIES = {
    "docs_filter_lang_source": filter_lang_source, "docs_first_by_text": first_by_text, "pages_new_by_url": pages_new_by_url, "pages_load_outcomes": pages_load_outcomes, "pages_classify_url": pages_classify,
    "pages_read_rollup": pages_read_rollup, "pages_html_text": pages_text, "pages_handlers": pages_handlers, "vector_top8": vector_top8, "vector_topk_per_label": vector_topk_per_label, "embeddings_status": embeddings_status,
    "embedding_merge": embedding_merge, "chunk_documents": chunks, "chunk_counts": chunk_counts, "attachment_texts": attachment_texts, "key_documents": key_documents, "doc_snippets": doc_snippets, "compact_index": compact_index,
    "container_carry_forward": carried_containers, "thread_titles": thread_titles, "thread_role_rollup": thread_roles, "thread_first_messages": thread_first_messages, "thread_attachments": thread_attachments, "thread_list": thread_list, "prompt_context": prompt_context,
}

_VECTOR = f"{QUERY}::DOUBLE[]"
_SCORE = f"round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_VECTOR}), 6)"
_ITEMS = """items AS (
  SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS course_id, regexp_replace(url, '[?#].*$', '') AS clean, url AS title, html FROM pages
), known AS (SELECT DISTINCT course_id, clean FROM items WHERE clean LIKE 'https://www.%'),
done AS (
  SELECT page_id, CASE WHEN NOT regexp_matches(coalesce(html, ''), '\\S') THEN 'skipped_empty'
    WHEN k.clean IS NOT NULL OR page_id <> min(page_id) FILTER (regexp_matches(coalesce(html, ''), '\\S')) OVER (PARTITION BY i.course_id, i.clean) THEN 'skipped_existing' ELSE 'created' END AS outcome
  FROM items i LEFT JOIN known k ON i.course_id = k.course_id AND i.clean = k.clean
)"""


def _any(column: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{n}')" for n in needles) + ")"


SQL = {
    "docs_filter_lang_source": "SELECT CAST(doc_id AS VARCHAR) AS id, CAST(length(text) AS BIGINT) AS n_chars FROM documents WHERE source = 'src3' AND lang = 'en'",
    "docs_first_by_text": "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text",
    "pages_new_by_url": f"WITH {_ITEMS} SELECT page_id, outcome FROM done",
    "pages_load_outcomes": f"WITH {_ITEMS} SELECT outcome, count(*) AS n FROM done GROUP BY outcome",
    "pages_classify_url": """
        WITH p AS (SELECT page_id, CASE WHEN contains(url, '?') THEN 'Photo' WHEN contains(url, '#') THEN 'Video' ELSE 'PDF' END AS kind,
          regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[0-9]+$', '/outline/') || CASE page_id % 4 WHEN 0 THEN 'file/' WHEN 1 THEN 'edit/document/' WHEN 2 THEN 'assessment/' ELSE '' END AS u FROM pages)
        SELECT page_id, CASE WHEN kind = 'Photo' THEN 'image_based' WHEN kind = 'Video' THEN 'skip' WHEN u IN ('', '#') THEN 'skip' WHEN u LIKE 'http%' AND NOT contains(u, 'example.com') THEN 'skip' WHEN rtrim(u, '/') LIKE '%/outline' THEN 'skip'
          WHEN contains(u, '/outline/file/') THEN 'file' WHEN contains(u, '/outline/edit/document/') THEN 'document' WHEN contains(u, '/outline/assessment/') THEN 'assessment' WHEN contains(u, '/outline/discussion/') THEN 'discussion' ELSE 'skip' END AS class,
          CASE kind WHEN 'PDF' THEN 'document' ELSE 'other' END AS kind FROM p""",
    "pages_read_rollup": "SELECT count(*) AS total, count(*) FILTER (NOT contains(url, '?') AND NOT contains(url, '#') AND html IS NOT NULL) AS read, count(*) FILTER (contains(url, '?') OR contains(url, '#')) AS skipped FROM pages",
    "pages_handlers": "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'pdf' WHEN 2 THEN 'docx' WHEN 3 THEN 'image' ELSE 'plain' END AS handler, CASE WHEN page_id % 5 = 4 THEN 'unsupported_type' END AS error FROM pages",
    "vector_top8": f"SELECT vec_id, label, {_SCORE} AS score FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_VECTOR}) DESC, vec_id LIMIT 8",
    "vector_topk_per_label": f"SELECT label, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT label, vec_id, {_SCORE} AS score, row_number() OVER (PARTITION BY label ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_VECTOR}) DESC, vec_id) AS rank FROM embeddings) WHERE rank <= 10",
    "embeddings_status": "SELECT CAST(label AS VARCHAR) AS id, CASE WHEN label > 2 THEN 'embedded' ELSE 'failed' END AS embeddings_status, CASE WHEN label > 2 THEN 'local' END AS embedding_model FROM embeddings GROUP BY label",
    "embedding_merge": "SELECT count(*) AS processed, count(*) FILTER (label < 7) AS embedded, count(*) FILTER (label >= 7) AS failed FROM embeddings",
    "key_documents": f"""
        WITH i AS (SELECT o_orderkey, lower(CASE WHEN o_orderkey % 10 = 0 THEN 'Course Outline ' ELSE 'Order ' END || o_orderpriority) AS title, CASE o_orderstatus WHEN 'P' THEN 'discussion board' WHEN 'F' THEN 'text document' ELSE 'pdf' END AS kind,
          lower(CASE WHEN o_custkey % 3 = 0 THEN 'The DUE DATE of ' || o_orderkey ELSE repeat(o_orderpriority, o_custkey % 1000) END) AS body FROM orders)
        SELECT o_orderkey FROM i WHERE {_any('title', content.KEY_TITLES)} OR {_any('kind', content.KEY_TYPES)} OR (kind IN ('text document', 'pdf') AND length(body) > 3000) OR {_any('body', content.KEY_PHRASES)}""",
    "doc_snippets": "SELECT CAST(doc_id AS VARCHAR) AS id, left(text, 500) || CASE WHEN length(text) > 500 THEN '…' ELSE '' END AS snippet FROM documents",
    "compact_index": """
        WITH t AS (SELECT CAST(n_nationkey AS VARCHAR) AS course_id, 'Course: ' || any_value(n_name) || chr(10) || chr(10) || chr(10) || string_agg('- [' || c_mktsegment || '] ' || c_name || CASE WHEN c_acctbal > 0 THEN chr(10) || '  Container: ' || c_mktsegment ELSE '' END || chr(10) || '  Content: ' || c_name, chr(10) || chr(10) ORDER BY c_custkey) AS text
          FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey)
        SELECT course_id, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n_chars FROM t""",
    "container_carry_forward": """
        WITH r AS (SELECT conv_id, turn, role, role || ' ' || turn AS title, CASE WHEN role = 'system' THEN role || ' ' || turn WHEN turn % 3 <> 0 THEN '' END AS event FROM conversations)
        SELECT conv_id, turn, CASE WHEN role = 'system' THEN NULL ELSE nullif(last_value(event IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS container_name FROM r""",
    "thread_titles": r"""
        WITH f AS (SELECT conv_id, arg_min(role, turn) AS role, regexp_replace(arg_min(text, turn), '^\s+|\s+$', '', 'g') AS text FROM conversations GROUP BY conv_id)
        SELECT conv_id AS thread_id, CASE WHEN role = 'user' THEN CASE WHEN length(text) > 50 THEN left(replace(replace(text, chr(10), ' '), chr(13), ''), 49) || '…' ELSE replace(replace(text, chr(10), ' '), chr(13), '') END ELSE 'New chat' END AS title FROM f""",
    "thread_role_rollup": "SELECT conv_id AS thread_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, count(*) FILTER (role = 'assistant') AS assistant_turns, count(*) FILTER (role = 'system') AS system_turns FROM conversations GROUP BY conv_id",
    "thread_first_messages": "SELECT conv_id AS thread_id, turn AS pos, role FROM conversations QUALIFY turn = min(turn) OVER (PARTITION BY conv_id)",
    "thread_attachments": "SELECT thread_id, string_agg(role, ',' ORDER BY first) AS doc_ids FROM (SELECT conv_id AS thread_id, role, min(turn) AS first FROM conversations GROUP BY ALL) GROUP BY thread_id",
    "thread_list": "SELECT conv_id AS id, count(*) AS turns FROM conversations GROUP BY conv_id HAVING count(*) >= 4",
}
