"""Queries of the remaining operators: mutations, discovery, scalar groups and set functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import content, documents, threads
from ..sources import readers, schemas
from .tables import table

NOW = "2024-01-01T00:00:00+00:00"


def full_texts(spark, sf_dir):
    """Customers as items of their nation, the segment as title: of a repeated title the last text."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("course_id"), F.col("c_mktsegment").alias("title"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("extracted_text"))
    return content.full_texts(c)


def courses_discovered(spark, sf_dir):
    """Orders as links of a scan: the first clerk name of every customer, those of the term."""
    links = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("course_id"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("Term "), F.date_format("o_orderdate", "yyyy")).alias("course_name"))
    return content.discovered(links, "Term 1995").select("course_id", "course_name")


def unread_items(spark, sf_dir):
    status = F.element_at(F.array(F.lit("success"), F.lit("skipped"), F.lit("image_based"), F.lit("error"), F.lit(None)), (F.col("page_id") % 5 + 1).cast("int"))
    return content.unread(table(spark, sf_dir, "pages").withColumn("read_status", status)).select("page_id", "read_status")


def thread_appends(spark, sf_dir):
    """Every conversation appended to an empty thread."""
    said = table(spark, sf_dir, "conversations")
    empty = threads.create(said.select(F.col("conv_id").cast("string").alias("key"), F.lit(False).alias("incognito")).distinct(), NOW)
    keys = said.select("conv_id").distinct().select(text.uuid_id("thread_", F.col("conv_id").cast("string"), F.lit(NOW)).alias("thread_id"), "conv_id")
    new = said.join(keys, "conv_id").select("thread_id", F.col("turn").alias("seq"), "role", F.col("text").alias("content"), F.array().cast("array<struct<doc_id: string, name: string>>").alias("attachments"))
    after = threads.append(empty, new, "2024-02-01T00:00:00+00:00")
    return after.join(keys, F.col("id") == F.col("thread_id")).select("conv_id", F.size("messages").alias("n_messages"), (F.col("title") == threads.NEW_TITLE).alias("untitled"), "updated_at")


def store_changes(spark, sf_dir):
    """Finished orders deleted, the urgent ones of them restored, dear ones retitled."""
    o = table(spark, sf_dir, "orders")
    docs = o.select(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("Order "), F.col("o_orderkey")).alias("title"), F.lit(NOW).alias("created_at"), F.lit(NOW).alias("updated_at"), F.lit(None).cast("string").alias("deleted_at"))
    key = F.col("o_orderkey").cast("string").alias("id")
    gone = documents.soft_delete(docs, o.where("o_orderstatus = 'F'").select(key), "2024-02-01")
    back = documents.restore(gone, o.where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select(key), "2024-03-01")
    return documents.update(back, o.where("o_totalprice > 200000").select(key, F.lit("Dear").alias("title")), "2024-04-01")


def ingest_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("source").alias("course_id"), F.left("text", F.lit(40)).alias("title"), F.col("text").alias("extracted_text"))
    docs, _ = documents.ingest(rows, NOW)
    return docs.select("course_id", "title", "chunk_count", "embeddings_status")


def attachment_names(spark, sf_dir):
    """Ordered parts as attachments; only small parts have a file name."""
    ids = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("doc_id"))
    named = table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("original_filename"))
    return threads.attachment_names(ids, named).select("l_orderkey", "l_linenumber", "name")


def due_notes(spark, sf_dir):
    note = F.concat(F.lit("Points 10. Due date: "), F.date_format("o_orderdate", "M/d/yyyy"), F.lit(" at noon"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.parse_due(dates.due_in_note(note)).alias("due"), dates.leading_date(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("leading"))


def effective_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    raw = F.when(F.col("o_orderkey") % 3 == 0, "Week 3 at 9:30 pm").when(F.col("o_orderkey") % 3 == 1, "TBD").otherwise("n/a")
    resolved = F.when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "yyyy-MM-dd'T'10:30")).otherwise("UNRESOLVED")
    rows = o.select("o_orderkey", raw.alias("raw"), resolved.alias("resolved"))
    rows = rows.withColumn("category", dates.effective_category("raw", "resolved"))
    return rows.select("o_orderkey", "category", dates.resolved_category("resolved").alias("resolved_category"), dates.has_time("raw", "category").alias("timed"))


def semester_anchors(spark, sf_dir):
    term = '{"default": {"semester_start": "1995-01-10", "term_name": "Default"}, "courses": {"3": {"semester_start": "1995-02-01", "term_name": "Own"}}}'
    config = spark.range(1).select(F.from_json(F.lit(term), schemas.SEMESTER).alias("c")).select("c.*")
    courses = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("course_id"))
    return readers.semester_anchor(config, courses).select("course_id", F.col("anchor.semester_start").alias("start"), F.col("anchor.term_name").alias("term"))


def title_sets(spark, sf_dir):
    """Token set of a name without stop words, and what it shares with the type's."""
    p = table(spark, sf_dir, "part")
    low = text.title_tokens(F.lower(F.concat(F.lit("the "), F.col("p_name"), F.lit(" of a "), F.col("p_name"))))
    return p.select("p_partkey", F.array_join(F.array_sort(low), ",").alias("tokens"), F.size(F.array_intersect(low, text.title_tokens(F.lower("p_type")))).alias("shared"))


def url_parts(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    path = F.regexp_replace("url", "^https?://[^/]+", "")
    return p.select("page_id", text.absolute_url(path, "https://base.org", F.lit("https://course")).alias("absolute"), text.course_id_of_href(F.concat(F.lit("/ultra/courses/_"), F.col("page_id"), F.lit("_1/outline"))).alias("course_id"), text.extension(F.concat(path, F.lit(".HTML"))).alias("extension"), text.mime_base(F.concat(F.lit(" Text/HTML ; v="), F.col("page_id"))).alias("mime"))


def ledger_display(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", text.shown_time(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("shown"), text.shown_money("value").alias("money"), text.shown_count(F.col("event_id") * 1000).alias("count"), text.shown_id(F.sha2(F.col("event_id").cast("string").cast("binary"), 256)).alias("short_id"))


QUERIES = {
    "content_full_texts": full_texts, "courses_discovered": courses_discovered, "unread_items": unread_items, "thread_appends": thread_appends, "store_changes": store_changes, "ingest_counts": ingest_counts, "attachment_names": attachment_names,
    "due_notes": due_notes, "effective_dates": effective_dates, "semester_anchors": semester_anchors, "title_sets": title_sets, "url_parts": url_parts, "ledger_display": ledger_display,
}

_STOP = "['the','a','an','of','for','and','or','in','on','to','is','it','at','by','be','as','my','me']"
SQL = {
    "content_full_texts": "SELECT c_nationkey AS course_id, c_mktsegment AS title, arg_max(c_name, c_custkey) AS text FROM customer GROUP BY ALL",
    "courses_discovered": "SELECT o_custkey AS course_id, 'Term ' || strftime(arg_min(o_orderdate, o_orderkey), '%Y') AS course_name FROM orders GROUP BY o_custkey HAVING strftime(arg_min(o_orderdate, o_orderkey), '%Y') = '1995'",
    "unread_items": "SELECT page_id, CASE WHEN page_id % 5 = 3 THEN 'error' END AS read_status FROM pages WHERE page_id % 5 >= 3",
    "thread_appends": "SELECT conv_id, CAST(count(*) AS INTEGER) AS n_messages, arg_min(role, turn) <> 'user' AS untitled, '2024-02-01T00:00:00+00:00' AS updated_at FROM conversations GROUP BY conv_id",
    "store_changes": """
        SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_totalprice > 200000 THEN 'Dear' ELSE 'Order ' || o_orderkey END AS title, '2024-01-01T00:00:00+00:00' AS created_at,
               CASE WHEN o_totalprice > 200000 THEN '2024-04-01' WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN '2024-03-01' ELSE '2024-01-01T00:00:00+00:00' END AS updated_at,
               CASE WHEN o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' THEN '2024-02-01' END AS deleted_at FROM orders""",
    "attachment_names": "SELECT l_orderkey, l_linenumber, coalesce(p_name, CAST(l_partkey AS VARCHAR)) AS name FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 10) ON l_partkey = p_partkey",
    "due_notes": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS due, strftime(o_orderdate, '%Y-%m-%d') AS leading FROM orders",
    "effective_dates": """
        WITH r AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'iso_date' WHEN 'P' THEN 'iso_datetime' ELSE 'unresolved' END AS resolved_category, CASE o_orderkey % 3 WHEN 0 THEN 'relative' WHEN 1 THEN 'vague' ELSE 'missing' END AS raw FROM orders)
        SELECT o_orderkey, CASE WHEN resolved_category = 'unresolved' THEN raw ELSE resolved_category END AS category, resolved_category, resolved_category = 'iso_datetime' OR o_orderkey % 3 = 0 AS timed FROM r""",
    "semester_anchors": "SELECT CAST(n_nationkey AS VARCHAR) AS course_id, CASE n_nationkey WHEN 3 THEN '1995-02-01' ELSE '1995-01-10' END AS start, CASE n_nationkey WHEN 3 THEN 'Own' ELSE 'Default' END AS term FROM nation",
    "title_sets": f"""
        WITH t AS (SELECT p_partkey, list_sort(list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda x: NOT list_contains({_STOP}, x)))) AS n, list_distinct(list_filter(regexp_extract_all(lower(p_type), '[a-z0-9]+'), lambda x: NOT list_contains({_STOP}, x))) AS k FROM part)
        SELECT p_partkey, array_to_string(n, ',') AS tokens, CAST(len(list_intersect(n, k)) AS INTEGER) AS shared FROM t""",
    "url_parts": """
        WITH p AS (SELECT page_id, regexp_replace(url, '^https?://[^/]+', '') AS path FROM pages)
        SELECT page_id, CASE WHEN path LIKE '/%' THEN 'https://base.org' || path WHEN path = '' THEN 'https://course' ELSE path END AS absolute, '_' || page_id || '_1' AS course_id, CASE WHEN path LIKE '%/' OR path = '' THEN '' ELSE '.html' END AS extension, 'text/html' AS mime FROM p""",
    "ledger_display": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown, printf('%.4f', value) AS money, format('{:,}', event_id * 1000) AS count, left(sha256(CAST(event_id AS VARCHAR)), 16) AS short_id FROM events",
}
