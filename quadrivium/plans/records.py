"""Queries of stores written and read again, look-ups, chunk texts, the override log and prompt parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, extraction, markdown, text
from ..operators import content, context, deadlines, documents, ordered, overrides, retrieval, threads
from ..sources import readers, schemas, writers
from . import deadlines as d
from . import store
from .tables import scratch, table

NOW, LATER = "2024-01-01T00:00:00+00:00", "2024-02-01T00:00:00+00:00"
ORDER = "o_orderkey"


def key(column: str, name: str = "id"):
    return F.col(column).cast("string").alias(name)


# --- files -----------------------------------------------------------------------------------


def content_file(spark, sf_dir):
    """Nations as courses and their customers as items: a content store, replaced once and read again with its order."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    items = c.join(n, c.c_nationkey == n.n_nationkey).select(key("n_nationkey", "course_id"), F.col("n_name").alias("course_name"), F.col("c_custkey").alias("place"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("content_type"), F.when(F.col("c_acctbal") > 0, F.lit("2026-01-01")).alias("due_date"), F.lit("success").alias("read_status"))
    items = ordered.numbered(items, ["course_id"], "place", "pos").withColumn("pos", F.col("pos").cast("int")).drop("place")
    path = scratch(spark, "content")
    writers.write_store(items.limit(0), path, "content")
    writers.write_store(items, path, "content")
    return readers.content_text(spark, path).select("course_id", "course_name", "pos", "title", "content_type", "due_date", "read_status")


def summaries_file(spark, sf_dir):
    """A store of summaries, some of which are no text; those of failed courses are left out."""
    n = table(spark, sf_dir, "nation")
    place = F.col("n_nationkey") % 4
    value = F.when(place == 0, F.lit("17")).when(place == 1, F.lit('"Pre-Processing FAILED: no reply"')).otherwise(F.concat(F.lit('"Summary of '), F.col("n_name"), F.lit('"')))
    variant = F.try_parse_json(value)
    rows = n.select(F.col("n_nationkey").alias("pos"), key("n_nationkey", "course_id"), F.when(F.schema_of_variant(variant) == "STRING", F.variant_get(variant, "$", "string")).alias("summary"))
    path = scratch(spark, "summaries")
    writers.write_store(rows, path, "summaries")
    found = readers.summaries(spark, path)
    return found.where(~markdown.failed("summary")).select("course_id", "summary")


def stores_read(spark, sf_dir):
    """Document, chunk and thread stores written and read again; a store that is not there is empty."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0")
    docs = documents.create(o.select(F.concat(F.lit("Order "), F.col(ORDER)).alias("title"), F.col(ORDER).alias("pos"), key("o_custkey", "course_id"), F.col("o_orderpriority").alias("extracted_text")), NOW)
    chunks = documents.add_chunks(docs, docs.select(F.col("id").alias("document_id"), F.lit(0).alias("chunk_index"), F.col("extracted_text").alias("text")), NOW)
    path, out = scratch(spark, "stores"), None
    for name, rows in (("documents", docs), ("chunks", chunks), ("threads", threads.create(o.select(key(ORDER, "key"), F.lit(True).alias("incognito")), NOW))):
        writers.write_store(rows, f"{path}/{name}", name)
        read = getattr(readers, name)
        for place in (f"{path}/{name}", f"{path}/none"):
            part = read(spark, place).agg(F.lit(name).alias("store"), F.lit(place.endswith("none")).alias("missing"), F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.min("created_at").alias("created_at"))
            out = part if out is None else out.unionByName(part)
    return out


def overrides_file(spark, sf_dir):
    """The overrides store, replaced once and read again with the comment of the version before."""
    path = scratch(spark, "overrides")
    rows = d.changes(spark, sf_dir)
    writers.write_overrides(rows.limit(0), path, comment="kept")
    writers.write_overrides(rows, path, comment=writers.read_comment(spark, path))
    read = readers.overrides(spark, path).withColumn("comment", F.lit(writers.read_comment(spark, path)))
    value = lambda f: overrides.edit(f)
    return read.select("id", "dismissed", "manual_add", value("title").alias("title"), value("due_date_resolved").alias("due"), "comment")


def ledger_file(spark, sf_dir):
    """Calls appended in two batches; those without a request get an id of their own."""
    e = table(spark, sf_dir, "events")
    whole = e.select(key("event_id", "event_id"), F.when(F.col("event_id") % 3 > 0, F.col("user_id").cast("string")).alias("request_id"), F.col("event_type").alias("operation"), F.col("event_id").alias("input_tokens"), F.col("value").alias("cost_usd"))
    whole = whole.withColumns({c: F.lit(None).cast("string") for c in schemas.LEDGER_COLUMNS if c not in whole.columns})
    path = scratch(spark, "ledger")
    for part in (0, 1):
        writers.append_ledger(whole.where(F.col("event_id").cast("long") % 2 == part), path)
    read = readers.ledger(spark, path)
    own = F.length("request_id") == 36
    return read.groupBy("operation").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.count_if(F.col("request_id").isNull()).alias("without"), F.count_distinct(F.when(own, F.col("request_id"))).alias("own_ids"))


def newest_files(spark, sf_dir):
    """Orders as cached files: the newest, with and without the old ones, and the file each was made from."""
    o = table(spark, sf_dir, "orders")
    found = o.select(F.concat(F.lit("data/preprocessed_"), F.col(ORDER), F.when(F.col(ORDER) % 2 == 0, ".OLD.json").otherwise(".json")).alias("path"), F.col("o_orderdate").alias("modificationTime"))
    out = readers.newest(found).withColumn("kind", F.lit("live")).unionByName(readers.newest(found, keep_old=True).withColumn("kind", F.lit("any")))
    return out.withColumn("paired", readers.paired("path"))


def files_extracted(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    files = p.select("page_id", F.concat(F.lit("page"), F.when(F.col("page_id") % 3 == 0, ".MD").when(F.col("page_id") % 3 == 1, ".png").otherwise("")).alias("name"), F.lit("text/plain; charset=x").alias("mime"), F.coalesce("html", F.lit("")).cast("binary").alias("content"))
    return extraction.extract_files(files).select("page_id", "extracted.*", extraction.vision_path(extraction.handler("name", "mime")).alias("vision"))


# --- look-ups and mutations --------------------------------------------------------------------


def embedded_chunks(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    vector = F.when(F.col("vec_id") % 5 > 0, F.col("embedding")).when(F.col("vec_id") % 2 == 0, F.array().cast("array<float>"))
    meta = F.struct(F.lit("upload").alias("source_type"), key("label", "course_id"), F.when(F.col("vec_id") % 3 == 0, "course_summary").otherwise("document").alias("content_type"), F.lit(None).cast("string").alias("semester_id"))
    return e.select(key("vec_id"), (F.col("vec_id") % 40).cast("string").alias("document_id"), F.when(F.col("vec_id") >= 40, (F.col("vec_id") / 40).cast("int")).alias("chunk_index"), F.concat(F.lit("text "), F.col("vec_id")).alias("text"), vector.alias("embedding"), meta.alias("metadata"), F.lit("local").alias("user_id"))


def forty_documents(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_partkey < 40")
    return p.select(key("p_partkey"), F.col("p_name").alias("title"), F.col("p_brand").alias("course_id"), F.lit("upload").alias("source_type"), F.lit("document").alias("content_type"), F.concat("p_name", F.lit(".pdf")).alias("original_filename"), F.when(F.col("p_partkey") % 4 == 0, LATER).alias("deleted_at"))


def chunk_lists(spark, sf_dir):
    """Chunks by several filters; those of deleted documents stay but in the repaired form."""
    c, docs = embedded_chunks(spark, sf_dir), forty_documents(spark, sf_dir)
    lists = {
        "embedded": documents.list_chunks(c, with_embedding_only=True, user_id="local"), "pending": documents.pending_chunks(c), "course": documents.list_chunks(c, metadata={"course_id": "3", "content_type": "document"}),
        "live": documents.live_chunks(c, docs), "one": documents.chunks_of(c, "7"), "none": documents.list_chunks(c, user_id="other"),
    }
    out = None
    for name, rows in lists.items():
        rows = rows.select(F.lit(name).alias("list"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


def document_points(spark, sf_dir):
    """Documents by id, deleted ones too, their short form, and titles of hits."""
    docs, c = forty_documents(spark, sf_dir), embedded_chunks(spark, sf_dir)
    both = documents.point(docs, "8").unionByName(documents.point(docs, "9")).unionByName(documents.point(docs, "none"))
    short = documents.meta(both).select(F.lit("meta").alias("kind"), "id", F.concat_ws("|", "title", "content_type", "original_filename").alias("value"))
    return short.unionByName(documents.title_of(c, docs).select(F.lit("hit").alias("kind"), "id", F.col("doc_title").alias("value")))


def threads_changed(spark, sf_dir):
    """Threads renamed, removed for good, then all of them cleared: the deleted ones and how many that were."""
    said = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    held = said.select(key("conv_id"), F.lit("New chat").alias("title"), F.when(F.col("conv_id") % 3 == 0, NOW).alias("deleted_at"), F.lit(NOW).alias("updated_at"))
    renamed = threads.rename(held, said.where("conv_id % 2 = 0").select(key("conv_id"), F.repeat(F.concat(F.lit("Title "), F.col("conv_id"), F.lit(" ")), 9).alias("title")), LATER)
    left = threads.delete_forever(renamed, said.where("conv_id % 5 = 0").select(key("conv_id")))
    before = threads.deleted_threads(left).select(F.lit("deleted").alias("kind"), "id", "title", "updated_at")
    after, count = threads.clear(left, LATER)
    kept = threads.purge(after, "2024-02-15T00:00:00", 30).select(F.lit("kept").alias("kind"), "id", "title", "updated_at")
    return before.unionByName(kept).unionByName(count.select(F.lit("cleared").alias("kind"), key("cleared"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("updated_at")))


def summaries_new(spark, sf_dir):
    """One summary document a course: not where one is stored, not where the text is blank."""
    n = table(spark, sf_dir, "nation")
    made = n.select(key("n_nationkey", "course_id"), F.when(F.col("n_nationkey") % 5 == 0, " \n ").otherwise(F.col("n_name")).alias("summary"))
    held = n.where("n_nationkey % 2 = 0").select(key("n_nationkey", "course_id"), F.when(F.col("n_nationkey") % 4 == 0, "course_summary").otherwise("document").alias("content_type"))
    return documents.new_summaries(made, held).select("course_id", "summary")


def summaries_irregular(spark, sf_dir):
    """Blocks without a name line, with links and other headings; the last field takes in what follows, what is no assignment is passed over."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0")
    head = F.concat(F.when(F.col(ORDER) % 2 == 0, F.lit("## Quiz 4: Order ")).otherwise(F.lit("### Homework 2. Order ")), F.col(ORDER))
    body = F.concat(F.lit("\n- **Due:** "), F.date_format("o_orderdate", "MMM d"), F.lit("\n- **Points:** N/A\n- see https://host.org/"), F.col(ORDER), F.lit(" now\n#### Remark\nno assignment\n"))
    rows = o.select(key(ORDER, "course_id"), F.lit("C").alias("course_name"), F.concat(head, body).alias("summary"))
    return markdown.parse_assignments(rows).select("course_id", "title", "due_date_raw", "point_value", "source_link", "pos")


def known_ids(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(key(ORDER)).unionByName(table(spark, sf_dir, "nation").select(F.concat(F.lit("x"), F.col("n_nationkey")).alias("id")))
    return overrides.known_ids(asked, d.bucketed(spark, sf_dir), d.changes(spark, sf_dir).where("not dismissed"))


def course_labels(spark, sf_dir):
    """Courses in first-seen order with their short label, and how many resolved dates each has."""
    rows = d.bucketed(spark, sf_dir).withColumn("pos", F.coalesce("pos", F.lit(0)))
    dated = rows.where("bucket = 'resolved'").groupBy("course_id").agg(F.count_distinct("due_date_resolved").alias("dates"))
    return deadlines.course_list(rows).join(dated, "course_id", "left").select("course_id", text.short_label(F.concat(F.lit("Spring 2026 "), F.col("course_name"), F.lit(" (C)")), 12).alias("label"), F.coalesce("dates", F.lit(0)).alias("dates"))


def resolved_dates(spark, sf_dir):
    return deadlines.resolved_dates(d.bucketed(spark, sf_dir)).groupBy("due").agg(F.count("*").alias("n"))


def text_rest(spark, sf_dir):
    """Colours stripped, fields of a log line, and texts as instants."""
    e = table(spark, sf_dir, "events")
    line = F.concat(F.lit("op="), F.col("event_type"), F.lit(" user="), F.col("user_id"))
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    shifted = dates.as_instant(F.concat(at, F.when(F.col("event_id") % 2 == 0, "+02:00").otherwise("")))
    return e.select("event_id", text.without_colours(F.concat(F.lit("\x1b[31m"), F.col("event_type"), F.lit("\x1b[0;1m!"))).alias("plain"), text.log_fields(line)["user"].alias("user"), F.date_format(shifted, "yyyy-MM-dd HH:mm:ss").alias("at"))


# --- texts -----------------------------------------------------------------------------------


def read_attachments(spark, sf_dir):
    """Turns as attachment rows of their conversation; every third has no text but a reason."""
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").alias("item_id"), F.col("turn").alias("pos"), F.concat("role", F.lit(".txt")).alias("name"), F.when((F.col("conv_id") % 2 == 0) & (F.col("turn") % 3 > 0), F.left("text", F.lit(20))).alias("text"), F.when(F.col("turn") % 2 == 0, "too large").alias("reason"))
    return content.attachment_join(rows)


def preprocess_messages(spark, sf_dir):
    """Customers as the items of their nation, some of them key items."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    items = c.join(n, c.c_nationkey == n.n_nationkey).select(key("n_nationkey", "course_id"), F.col("n_name").alias("course_name"), F.col("c_custkey").alias("pos"), F.concat(F.when(F.col("c_custkey") % 9 == 0, "Syllabus ").otherwise(""), F.col("c_name")).alias("title"), F.lit("Link").alias("content_type"), F.lit(None).cast("string").alias("container_name"), F.when(F.col("c_acctbal") > 0, "2026-01-01").alias("due_date"), F.lit("soon").alias("due_date_raw"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("subtext"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("extracted_text"))
    return content.preprocess_messages(items).select("course_id", F.md5(F.col("message").cast("binary")).alias("message_md5"), F.length("message").cast("long").alias("n_chars"))


def usable_vectors(spark, sf_dir):
    """Vectors that are null, empty, zero or have a null or NaN element are no candidates."""
    e = table(spark, sf_dir, "embeddings")
    m = F.col("vec_id") % 7
    v = F.col("embedding").cast("array<double>")
    broken = F.when(m == 0, F.lit(None)).when(m == 1, F.array().cast("array<double>")).when(m == 2, F.transform(v, lambda x: F.lit(0.0))).when(m == 3, F.transform(v, lambda x, i: F.when(i != 5, x))).when(m == 4, F.transform(v, lambda x, i: F.when(i == 5, F.lit(float("nan"))).otherwise(x))).otherwise(v)
    return retrieval.search(e.withColumn("embedding", broken), store.QUERY, top_k=50, key="vec_id").select("vec_id", F.round("score", 6).alias("score"))


def excerpts(spark, sf_dir):
    """The best of every course, of which summaries are dropped after the ranking."""
    c = embedded_chunks(spark, sf_dir)
    courses = c.select("metadata.course_id").distinct()
    return context.excerpts(c, forty_documents(spark, sf_dir), store.QUERY, courses, 6)


QUERIES = {
    "content_file": content_file, "summaries_file": summaries_file, "stores_read": stores_read, "overrides_file": overrides_file, "ledger_file": ledger_file, "newest_files": newest_files, "files_extracted": files_extracted,
    "chunk_lists": chunk_lists, "document_points": document_points, "threads_changed": threads_changed, "summaries_new": summaries_new, "summaries_irregular": summaries_irregular, "known_ids": known_ids, "course_labels": course_labels,
    "resolved_dates": resolved_dates, "text_rest": text_rest, "read_attachments": read_attachments, "preprocess_messages": preprocess_messages, "usable_vectors": usable_vectors, "excerpts": excerpts,
}

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
#: Pieces of a text of at most 1500 characters: cut after separators, coarse to fine, the rest hard.
_PIECES = "[text]"
for _mark in ("chr(10) || chr(10)", "chr(10)", "'. '", "' '"):
    _PIECES = f"flatten(list_transform({_PIECES}, lambda p: CASE WHEN length(p) > 1500 AND contains(p, {_mark}) THEN list_filter(list_transform(string_split(p, {_mark}), lambda x, i: CASE WHEN i < len(string_split(p, {_mark})) THEN x || {_mark} ELSE x END), lambda x: x <> '') ELSE [p] END))"
_PIECES = f"flatten(list_transform({_PIECES}, lambda p: CASE WHEN length(p) > 1500 THEN list_transform(range(0, length(p), 1500), lambda i: p[i + 1 : i + 1500]) ELSE [p] END))"
_CHUNKS = f"""pieces AS (
  SELECT doc_id, source, text, CASE WHEN regexp_matches(text, '\\S') THEN {_PIECES} ELSE [] END AS p FROM (SELECT doc_id, source, coalesce(text, '') AS text FROM documents)
), packed AS (
  SELECT doc_id, source, text, list_reduce(list_transform(p, lambda x: [x]), lambda a, x: CASE WHEN length(a[-1]) > 0 AND length(a[-1]) + length(x[1]) > 1500 THEN list_append(a, right(a[-1], 200) || x[1]) ELSE list_append(a[:-2], a[-1] || x[1]) END, ['']) AS c FROM pieces
), chunked AS (
  SELECT doc_id, source, text, list_filter(list_transform(c, lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS c FROM packed
)"""
_EMBEDDED = "e AS (SELECT *, CAST(vec_id AS VARCHAR) AS id, vec_id % 40 AS doc, vec_id % 5 > 0 AS has, CASE WHEN vec_id % 3 = 0 THEN 'course_summary' ELSE 'document' END AS kind FROM embeddings)"
_SIM = f"list_cosine_similarity(CAST(embedding AS DOUBLE[]), {store.QUERY}::DOUBLE[])"

SQL = {
    "content_file": "SELECT CAST(c_nationkey AS VARCHAR) AS course_id, n_name AS course_name, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INTEGER) AS pos, c_name AS title, c_mktsegment AS content_type, CASE WHEN c_acctbal > 0 THEN '2026-01-01' END AS due_date, 'success' AS read_status FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "summaries_file": "SELECT CAST(n_nationkey AS VARCHAR) AS course_id, 'Summary of ' || n_name AS summary FROM nation WHERE n_nationkey % 4 > 1",
    "stores_read": "SELECT store, missing, CASE WHEN missing THEN 0 ELSE n END AS n, CASE WHEN missing THEN 0 ELSE n END AS ids, CASE WHEN NOT missing THEN '2024-01-01T00:00:00+00:00' END AS created_at FROM (SELECT count(*) AS n FROM orders WHERE o_orderkey % 7 = 0), (SELECT unnest(['documents', 'chunks', 'threads']) AS store), (SELECT unnest([true, false]) AS missing)",
    "overrides_file": r"""
        SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice > 300000 AS dismissed, o_totalprice < 5000 AS manual_add, CASE WHEN o_totalprice > 250000 THEN 'Renamed ' || o_orderkey END AS title, CASE WHEN o_totalprice > 200000 AND o_totalprice <= 300000 THEN '1995-06-17' END AS due, 'kept' AS comment FROM orders WHERE o_totalprice > 200000 OR o_totalprice < 20000
        UNION ALL
        SELECT 's' || s_suppkey || '__' || regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9_ -]', '', 'g'), '[ _]+', '-', 'g') || '__0', s_acctbal > 8000, true, s_name, CASE WHEN s_acctbal > 0 THEN '1996-02-03T10:30:00' ELSE 'soon' END, 'kept' FROM supplier""",
    "ledger_file": "SELECT event_type AS operation, count(*) AS calls, CAST(sum(event_id) AS BIGINT) AS input_tokens, CAST(0 AS BIGINT) AS without, count(*) FILTER (event_id % 3 = 0) AS own_ids FROM events GROUP BY event_type",
    "newest_files": """
        WITH f AS (SELECT o_orderdate AS t, o_orderkey % 2 = 0 AS old, 'data/preprocessed_' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '.OLD.json' ELSE '.json' END AS path FROM orders)
        SELECT kind, path, replace(path, 'preprocessed_', '') AS paired FROM (SELECT 'live' AS kind, (SELECT path FROM f WHERE NOT old ORDER BY t DESC, path DESC LIMIT 1) AS path UNION ALL SELECT 'any', (SELECT path FROM f ORDER BY t DESC, path DESC LIMIT 1))""",
    "files_extracted": rf"""
        SELECT page_id, CASE WHEN page_id % 3 <> 1 THEN nullif({_STRIP.format("coalesce(html, '')")}, '') END AS text, CASE WHEN page_id % 3 = 1 THEN 'needs_vision' ELSE 'native_text' END AS method, CASE WHEN page_id % 3 = 1 THEN 0 ELSE 5 END AS confidence, CASE WHEN page_id % 3 = 1 THEN 'image' END AS vision FROM pages""",
    "chunk_lists": f"""
        WITH {_EMBEDDED} SELECT 'embedded' AS list, id FROM e WHERE has UNION ALL SELECT 'pending', id FROM e WHERE NOT has UNION ALL SELECT 'course', id FROM e WHERE label = 3 AND kind = 'document' UNION ALL SELECT 'one', id FROM e WHERE doc = 7
        UNION ALL SELECT 'live', id FROM e WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = doc AND p_partkey % 4 = 0)""",
    "document_points": f"""
        WITH {_EMBEDDED} SELECT 'meta' AS kind, CAST(p_partkey AS VARCHAR) AS id, p_name || '|document|' || p_name || '.pdf' AS value FROM part WHERE p_partkey IN (8, 9)
        UNION ALL SELECT 'hit', id, coalesce(p_name, 'document') FROM e LEFT JOIN part ON p_partkey = doc AND p_partkey % 4 > 0""",
    "threads_changed": """
        WITH t AS (SELECT DISTINCT conv_id AS c, CAST(conv_id AS VARCHAR) AS id, CASE WHEN conv_id % 2 = 0 THEN left(repeat('Title ' || conv_id || ' ', 9), 50) ELSE 'New chat' END AS title, CASE WHEN conv_id % 2 = 0 THEN '2024-02-01T00:00:00+00:00' ELSE '2024-01-01T00:00:00+00:00' END AS updated_at FROM conversations WHERE conv_id % 5 > 0)
        SELECT 'deleted' AS kind, id, title, updated_at FROM t WHERE c % 3 = 0 UNION ALL SELECT 'kept', id, title, updated_at FROM t WHERE c % 3 > 0 UNION ALL SELECT 'cleared', CAST(count(*) AS VARCHAR), NULL, NULL FROM t WHERE c % 3 > 0""",
    "summaries_new": "SELECT CAST(n_nationkey AS VARCHAR) AS course_id, n_name AS summary FROM nation WHERE n_nationkey % 5 > 0 AND n_nationkey % 4 > 0",
    "summaries_irregular": "SELECT CAST(o_orderkey AS VARCHAR) AS course_id, 'Order ' || o_orderkey AS title, strftime(o_orderdate, '%b %-d') AS due_date_raw, 'N/A; see https://host.org/' || o_orderkey || ' now' AS point_value, 'https://host.org/' || o_orderkey AS source_link, 0 AS pos FROM orders WHERE o_orderkey % 3 = 0",
    "known_ids": f"WITH {d._ROWS} SELECT id FROM done JOIN orders ON id = CAST(o_orderkey AS VARCHAR) WHERE bucket <> 'dismissed'",
    "course_labels": f"""
        WITH {d._ROWS}, n AS (SELECT course_id, count(DISTINCT due_date_resolved) FILTER (bucket = 'resolved') AS dates FROM done GROUP BY course_id)
        SELECT course_id, left(CASE WHEN course_id LIKE 's%' THEN course_id ELSE 'Customer ' || course_id END, 12) AS label, dates FROM n""",
    "resolved_dates": f"WITH {d._ROWS} SELECT due_date_resolved AS due, count(*) AS n FROM done WHERE bucket = 'resolved' GROUP BY due_date_resolved",
    "text_rest": "SELECT event_id, event_type || '!' AS plain, CAST(user_id AS VARCHAR) AS user, strftime(date_trunc('second', ts) - CASE WHEN event_id % 2 = 0 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%d %H:%M:%S') AS at FROM events",
    "read_attachments": """
        WITH r AS (SELECT conv_id, turn, role, nullif(CASE WHEN conv_id % 2 = 0 AND turn % 3 > 0 THEN left(text, 20) END, '') AS text FROM conversations),
        t AS (SELECT conv_id, string_agg('--- ' || role || '.txt ---' || chr(10) || coalesce(text, CASE WHEN turn % 2 = 0 THEN '[too large]' ELSE '[no text]' END), chr(10) || chr(10) ORDER BY turn) AS whole, bool_or(text IS NOT NULL) AS has FROM r GROUP BY conv_id)
        SELECT conv_id AS item_id, CASE WHEN has THEN whole END AS text, CASE WHEN has THEN 'success' ELSE 'image_based' END AS status FROM t""",
    "preprocess_messages": """
        WITH i AS (SELECT n_nationkey, n_name, c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'Syllabus ' ELSE '' END || c_name AS title, CASE WHEN c_acctbal > 0 THEN '2026-01-01' ELSE 'soon' END AS due, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS body FROM customer JOIN nation ON c_nationkey = n_nationkey),
        t AS (SELECT n_nationkey, 'KEY ITEMS' || chr(10) || chr(10) || coalesce(string_agg('[Link] ' || title || chr(10) || 'Due: ' || due || chr(10) || coalesce(body, '(no text)'), chr(10) || chr(10) ORDER BY c_custkey) FILTER (title LIKE 'Syllabus%'), '(none)') || chr(10) || chr(10) || 'ALL ITEMS' || chr(10) || chr(10)
          || 'Course: ' || any_value(n_name) || chr(10) || chr(10) || chr(10) || string_agg('- [Link] ' || title || chr(10) || '  Due: ' || due || CASE WHEN body IS NOT NULL THEN chr(10) || '  Content: ' || body ELSE '' END, chr(10) || chr(10) ORDER BY c_custkey) AS m FROM i GROUP BY n_nationkey)
        SELECT CAST(n_nationkey AS VARCHAR) AS course_id, md5(m) AS message_md5, CAST(length(m) AS BIGINT) AS n_chars FROM t""",
    "usable_vectors": f"SELECT vec_id, round({_SIM}, 6) AS score FROM embeddings WHERE vec_id % 7 > 4 ORDER BY {_SIM} DESC, vec_id LIMIT 50",
    "excerpts": f"""
        WITH {_EMBEDDED}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY {_SIM} DESC, id) AS INTEGER) AS rank FROM e WHERE has)
        SELECT CAST(label AS VARCHAR) AS course_id, rank, '[Relevant excerpt from ' || coalesce(p_name, 'document') || ']' || chr(10) || 'text ' || vec_id AS part FROM r LEFT JOIN part ON p_partkey = doc AND p_partkey < 40 AND p_partkey % 4 > 0 WHERE rank <= 6 AND kind <> 'course_summary'""",
    # Queries registered elsewhere.
    "chunk_documents": f"WITH {_CHUNKS} SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(i - 1 AS INTEGER) AS chunk_index, c[i] AS text FROM chunked, unnest(range(1, len(c) + 1)) AS t(i)",
    "chunk_counts": f"WITH {_CHUNKS} SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(len(c) AS BIGINT) AS n_chunks, CAST(list_max(list_transform(c, lambda x: length(x))) AS INTEGER) AS longest FROM chunked WHERE len(c) > 0",
    "ingest_counts": f"WITH {_CHUNKS} SELECT source AS course_id, left(text, 40) AS title, CAST(len(c) AS INTEGER) AS chunk_count, 'pending' AS embeddings_status FROM chunked WHERE regexp_matches(text, '\\S')",
    "attachment_texts": f"""
        WITH {_CHUNKS}, j AS (SELECT doc_id, text, array_to_string(c, chr(10)) AS whole FROM chunked WHERE len(c) > 0)
        SELECT doc_id AS pos, CAST(doc_id AS VARCHAR) AS doc_id, left(text, 60) AS title, CASE WHEN length(whole) > 12000 THEN left(whole, 12000) || chr(10) || '[... truncated]' ELSE whole END AS text FROM j""",
    "summaries_rewritten": f"""
        WITH {d._ROWS}, b AS (
          SELECT o_custkey, o_orderkey, o_totalprice > 300000 AS gone, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1 AS last,
                 '### Assignment' || chr(10) || '- **Name:** ' || a.title || chr(10) || '- **Type:** ' || a.type || chr(10) || '- **Due Date:** ' || raw || chr(10) || '- **Due Date Resolved:** ' || CASE WHEN a.dated THEN '1995-06-17' ELSE raw END || chr(10) || '- **Weight:** not mentioned' || chr(10) || '- **Confidence:** ' || o_orderpriority || chr(10) AS block
          FROM (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'UNRESOLVED' ELSE 'by ' || strftime(o_orderdate, '%Y-%m-%d') END AS raw FROM orders) JOIN applied a ON a.id = CAST(o_orderkey AS VARCHAR))
        SELECT CAST(o_custkey AS VARCHAR) AS course_id, '## 1. ASSIGNMENTS' || chr(10) || chr(10) || coalesce(string_agg(block || CASE WHEN last THEN '## 2. GRADING' || chr(10) || 'none' || chr(10) ELSE '' END, '' ORDER BY o_orderkey) FILTER (NOT gone), '') AS summary FROM b GROUP BY o_custkey""",
    "override_log": """
        WITH RECURSIVE l AS (
          SELECT CAST(user_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, CASE event_type WHEN 'error' THEN 'clear' WHEN 'signup' THEN 'dismiss' WHEN 'purchase' THEN 'manual' ELSE 'set' END AS op, event_id % 3 = 0 AS title FROM events
        ), s(id, k, there, t, n, dismissed, manual) AS (
          SELECT DISTINCT id, CAST(0 AS BIGINT), false, false, false, false, false FROM l
          UNION ALL
          SELECT s.id, l.k,
            CASE WHEN op <> 'clear' THEN true ELSE there AND ((CASE WHEN title THEN n ELSE t END) OR dismissed) END,
            CASE WHEN op = 'set' THEN t OR title WHEN op = 'clear' THEN t AND NOT title AND there ELSE t END, CASE WHEN op = 'set' THEN n OR NOT title WHEN op = 'clear' THEN n AND title AND there ELSE n END,
            CASE WHEN op = 'dismiss' THEN true WHEN op = 'clear' THEN dismissed AND there ELSE dismissed END,
            CASE WHEN op = 'manual' THEN true WHEN op = 'clear' THEN manual AND there AND ((CASE WHEN title THEN n ELSE t END) OR dismissed) ELSE manual END
          FROM s JOIN l ON l.id = s.id AND l.k = s.k + 1
        )
        SELECT id, CAST(t AS INTEGER) + CAST(n AS INTEGER) AS n_edits, dismissed, manual AS manual_add FROM s QUALIFY k = max(k) OVER (PARTITION BY id) AND there""",
    "prompt_context": f"""
        WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY {_SIM} DESC, CAST(vec_id AS VARCHAR)) AS rank FROM embeddings),
        p AS (SELECT label, string_agg('[Relevant excerpt from ' || coalesce(left(d.text, 60), 'document') || ']' || chr(10) || 'text ' || vec_id, chr(10) || chr(10) ORDER BY rank) AS parts FROM r LEFT JOIN documents d ON d.doc_id = vec_id WHERE rank <= 10 AND label <> 1 GROUP BY label)
        SELECT string_agg('[Pre-processed Course Summary: Course ' || label || ']' || chr(10) || 'Summary ' || label || coalesce(chr(10) || chr(10) || parts, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY label) AS text FROM (SELECT DISTINCT label FROM embeddings) LEFT JOIN p USING (label)""",
}
