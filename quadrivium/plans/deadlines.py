"""Deadline, override, title and audit queries: ``orders`` stand for deadlines, ``part`` for titles, ``nation`` for courses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, markdown, text
from ..operators import audit, content, deadlines, documents, overrides, similar
from .tables import table

WINDOW = ("1993-01-01", "1997-12-31")
EDITS = "array<struct<field: string, value: string>>"
KNOWN = ["click", "purchase", "signup"]


def window():
    return F.lit(WINDOW[0]).cast("date"), F.lit(WINDOW[1]).cast("date")


def assignments(spark, sf_dir):
    """orders as extracted deadlines: priority gives the confidence, status the type, pending ones have no date."""
    o = table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("course_id"), F.concat(F.lit("Customer "), F.col("o_custkey")).alias("course_name"), F.concat(F.lit("Order "), F.col("o_orderkey")).alias("title"),
        F.when(F.col("o_orderstatus") == "O", "discussion").otherwise("essay").alias("type"), F.when(F.col("o_orderstatus") == "P", "UNRESOLVED").otherwise(F.concat(F.lit("by "), day)).alias("due_date_raw"), F.col("o_orderpriority").alias("confidence"),
        F.col("o_orderkey").alias("pos"), "o_totalprice", "o_orderdate",
    )


def deadline_rows(spark, sf_dir):
    a = assignments(spark, sf_dir)
    return a.select("id", "course_id", "course_name", "title", "type", "due_date_raw", dates.resolved_date("due_date_raw").alias("due_date_resolved"), dates.confidence("confidence").alias("confidence_score"), "pos")


def changes(spark, sf_dir):
    """Overrides made from prices: very dear orders dismissed, dear ones dated, some renamed; the cheapest marked as added by hand though they were extracted, and suppliers added by hand."""
    a = assignments(spark, sf_dir)
    price = F.col("o_totalprice")
    edit = lambda f, v: F.array(F.struct(F.lit(f).alias("field"), v.cast("string").alias("value"))).cast(EDITS)
    none = F.array().cast(EDITS)
    edits = F.concat(F.when((price > 200_000) & (price <= 300_000), edit("due_date_resolved", F.lit("1995-06-17"))).otherwise(none), F.when(price > 250_000, edit("title", F.concat(F.lit("Renamed "), F.col("id")))).otherwise(none), F.when(price < 20_000, edit("notes", F.lit(None))).otherwise(none))
    own = a.where((price > 200_000) | (price < 20_000)).select("id", edits.alias("edits"), (price > 300_000).alias("dismissed"), F.lit(None).cast("string").alias("edited_at"), (price < 5_000).alias("manual_add"))
    due = F.when(F.col("s_acctbal") > 0, F.lit("1996-02-03T10:30:00")).otherwise(F.lit("soon"))
    made = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey"), F.lit("__"), text.slugify("s_name"), F.lit("__0")).alias("id"), F.concat(edit("title", F.col("s_name")), edit("due_date_resolved", due)).alias("edits"), (F.col("s_acctbal") > 8000).alias("dismissed"), F.lit(None).cast("string").alias("edited_at"), F.lit(True).alias("manual_add"))
    return own.unionByName(made)


def bucketed(spark, sf_dir):
    start, end = window()
    rows, over = deadline_rows(spark, sf_dir), changes(spark, sf_dir)
    kept = deadlines.bucketed(overrides.apply(rows, over), start, end).withColumn("manual_add", F.lit(False))
    courses = rows.select("course_id", "course_name").distinct()
    adds = overrides.manual_adds(over, rows)
    return kept.unionByName(deadlines.manual(adds, courses), allowMissingColumns=True)


def deadlines_bucketed(spark, sf_dir):
    return bucketed(spark, sf_dir).select("id", "course_id", "title", "type", "due_date_resolved", "confidence_score", "bucket", "flag_reason")


def deadline_counts(spark, sf_dir):
    return deadlines.header(bucketed(spark, sf_dir), changes(spark, sf_dir))


def attention_groups(spark, sf_dir):
    return deadlines.attention_groups(bucketed(spark, sf_dir))


def calendar_events(spark, sf_dir):
    all_ = bucketed(spark, sf_dir)
    events = deadlines.calendar(all_, deadlines.colours(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("course_id"))))
    return events.select("id", "title", "start", "allDay", "backgroundColor", F.col("extendedProps.type").alias("type"))


def override_apply(spark, sf_dir):
    out = overrides.apply(deadline_rows(spark, sf_dir), changes(spark, sf_dir))
    before = F.get(F.filter("ai_original", lambda e: e["field"] == "due_date_resolved"), 0)["value"]
    return out.select("id", "title", "due_date_resolved", "dismissed", "user_edited", F.array_join("user_edited_fields", ",").alias("fields"), before.alias("due_before"))


def manual_add_anti(spark, sf_dir):
    return overrides.manual_adds(changes(spark, sf_dir), deadline_rows(spark, sf_dir)).select("id", text.course_of_id("id").alias("course_id"))


def course_colours(spark, sf_dir):
    return deadlines.colours(table(spark, sf_dir, "nation"), "n_name")


def date_anomaly(spark, sf_dir):
    start, end = window()
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("course_id"), F.to_date("o_orderdate").alias("due"))
    return deadlines.anomalies(rows, start, end)


def summaries(spark, sf_dir):
    """One markdown summary per customer, its orders as assignments in key order."""
    a = assignments(spark, sf_dir)
    block = F.concat(F.lit("### Assignment\n- **Name:** "), F.col("title"), F.lit("\n- **Type:** "), F.col("type"), F.lit("\n- **Due Date:** "), F.col("due_date_raw"), F.lit("\n- **Due Date Resolved:** "), F.col("due_date_raw"), F.lit("\n- **Weight:** not mentioned\n- **Confidence:** "), F.col("confidence"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))), lambda x: x["b"]), "\n")
    return a.groupBy("course_id", "course_name").agg(F.concat(F.lit("## 1. ASSIGNMENTS\n\n"), lines, F.lit("\n## 2. GRADING\nnone\n")).alias("summary"))


def summaries_parsed(spark, sf_dir):
    found = deadlines.extracted(markdown.parse_assignments(summaries(spark, sf_dir)))
    return found.select("id", "title", "type", "due_date_resolved", "confidence_score")


def summaries_rewritten(spark, sf_dir):
    rows = overrides.apply(deadline_rows(spark, sf_dir), changes(spark, sf_dir)).withColumn("manual_add", F.lit(False))
    return overrides.apply_to_markdown(summaries(spark, sf_dir).select("course_id", "summary"), rows)


def overrides_block(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    items = n.select(F.col("n_regionkey").cast("string").alias("course_id"), F.col("n_nationkey").alias("pos"), F.col("n_name").alias("title"), F.lit("exam").alias("type"), F.when(F.col("n_nationkey") % 2 == 0, "2026-03-01").alias("due_date_resolved"), (F.col("n_nationkey") % 5 == 0).alias("dismissed"), (F.col("n_nationkey") % 5 == 1).alias("manual_add"), (F.col("n_nationkey") % 5 == 2).alias("user_edited"), F.array().cast(EDITS).alias("ai_original"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("course_id"), F.col("r_name").alias("course_name"))
    return overrides.overrides_block(items, r)


def override_log(spark, sf_dir):
    """events as a change log per user; the state reached."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "clear").when(F.col("event_type") == "signup", "dismiss").when(F.col("event_type") == "purchase", "manual").otherwise("set")
    log = e.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("id"), op.alias("op"), F.when(F.col("event_id") % 3 == 0, "title").otherwise("notes").alias("field"), F.col("event_id").cast("string").alias("value"), F.col("ts").cast("string").alias("at"))
    return overrides.fold(log).select("id", F.size("edits").alias("n_edits"), "dismissed", "manual_add")


def purge_expired(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_orderstatus", F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.when(F.col("o_orderstatus") == "P", "unknown")).alias("deleted_at"))
    pieces = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("document_id"))
    docs, kept = documents.purge(o, pieces, "1995-01-01T00:00:00")
    return docs.groupBy("o_orderstatus").agg(F.count("*").alias("n")).join(kept.join(o.select(F.col("id").alias("document_id"), "o_orderstatus"), "document_id").groupBy("o_orderstatus").agg(F.count("*").alias("pieces")), "o_orderstatus", "left")


def title_slug_index(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    return deadlines.with_ids(p, "p_brand", "p_name", "p_partkey").select("p_partkey", "id")


def title_scalars(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    named = F.concat(F.lit("Spring 2026 Chapter "), F.col("p_size"), F.lit(" "), F.col("p_name"), F.lit(" (CODE 1)"))
    return p.select("p_partkey", text.short_label(named, 55).alias("label"), text.normalize_chapter(F.lower(named)).alias("chapter"), text.without_numbers(named).alias("plain"), text.auto_title(F.concat(named, named)).alias("auto"), text.percent("p_size", F.lit(50)).alias("share"))


def fuzzy_titles(spark, sf_dir):
    """Questions with the distinct titles they name."""
    titles = table(spark, sf_dir, "part").select("p_name").distinct()
    words = F.split("p_name", " ")
    questions = titles.select(F.concat(F.lit("Chapter 7: where is the "), F.array_join(F.reverse(words), " and ")).alias("question"))
    return content.matched_titles(questions, titles, "question", "p_name")


def duplicate_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return audit.duplicate_pairs(p, group="p_brand", key="p_partkey", title="p_name")


def duplicate_pairs_edit(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return audit.duplicate_pairs(p, least=70.0, group="p_brand", key="p_partkey", title="p_name", exact=False, digits=4)


def duplicate_totals(spark, sf_dir):
    """Pairs of similar names of a type's first word, counted without being made."""
    p = table(spark, sf_dir, "part").withColumn("kind", F.split_part("p_type", F.lit(" "), F.lit(1)))
    return audit.duplicate_total(p, 70.0, "kind", "p_partkey", "p_name", exact=False)


def similar_title_classes(spark, sf_dir):
    """Pairs of similar names of a type's first word, each once for all parts that have them."""
    p = table(spark, sf_dir, "part").withColumn("kind", F.split_part("p_type", F.lit(" "), F.lit(1)))
    return similar.title_classes(p, 70.0, "kind", "p_partkey", "p_name", exact=False).withColumn("similarity", F.round("similarity", 4))


def similar_title_ratios(spark, sf_dir):
    """The same by the ratio of matched characters, at the level of duplicates."""
    p = table(spark, sf_dir, "part").withColumn("kind", F.split_part("p_type", F.lit(" "), F.lit(1)))
    return similar.title_classes(p, group="kind", key="p_partkey", title="p_name")


def date_category_histogram(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(dates.date_category("text").alias("category"))
    return audit.histogram(rows)


def due_formats(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    forms = [F.date_format("o_orderdate", f) for f in ("MMM d, yyyy", "MMMM d, yyyy", "M/d/yyyy", "yyyy-MM-dd", "MMM d, yyyy h:mm a")]
    raw = F.concat(F.lit("Due: "), F.element_at(F.array(*forms), (F.col("o_orderkey") % 5 + 1).cast("int")))
    return o.select("o_orderkey", dates.parse_due(raw).alias("due"), dates.date_category(raw).alias("category"))


def week_dates(spark, sf_dir):
    week = (F.col("o_orderkey") % 15 + 1).cast("int")
    c = dates.date_category(F.concat(F.lit("Week "), week))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.week_day(F.lit("2026-01-14").cast("date"), week).cast("string").alias("due"), dates.rubric(c, F.lit(False)).alias("confidence"))


def rubric_branches(spark, sf_dir):
    """Written dates of every category, on the page and elsewhere, with their weekday in the week named or the next meeting day."""
    k = F.col("o_orderkey")
    week = (k % 15 + 1).cast("int")
    raw = F.element_at(F.array(F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "MMMM d"), F.concat(F.lit("Week "), week, F.lit(" Friday")), F.concat(F.lit("before class, week "), week), F.lit("TBD"), F.lit("none"), F.lit("by Tuesday of week 3"), F.lit("see syllabus")), (k % 8 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"), dates.date_category(raw).alias("category"))
    day = dates.week_resolved("raw", F.lit("2026-01-14").cast("date"), F.array(F.lit("Monday"), F.lit("Wednesday")))
    return rows.select("o_orderkey", "category", dates.rubric("category", k % 2 == 0).alias("confidence"), F.coalesce(day.cast("string"), F.lit("UNRESOLVED")).alias("day"))


def router_fail_open(spark, sf_dir):
    known = F.array(*[F.lit(k) for k in KNOWN])
    reply = F.when(F.col("event_type") == "click", F.col("props")).when(F.col("event_type") == "error", "[]").otherwise(F.concat(F.lit('["zz", "'), F.col("event_type"), F.lit('"]')))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(text.routed(reply, known), ",").alias("courses"))


def audited(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "left").select("text", "lang", "source", "quality", "toxic")


def audit_missing(spark, sf_dir):
    return audit.missing(audited(spark, sf_dir), ["text", "lang", "source", "quality", "toxic"], ["text", "source"])


def audit_verdict(spark, sf_dir):
    a = assignments(spark, sf_dir).withColumn("category", dates.date_category("due_date_raw"))
    gaps = audit.missing(a, ["title", "course_id", "due_date_raw"], ["title", "course_id", "due_date_raw"])
    return audit.verdict_of(audit.histogram(a), gaps, audit.duplicate_total(a))


def audit_verdict_titles(spark, sf_dir):
    """Parts as assignments of their brand, some without a title or a date: gaps and similar titles (by edit distance) count."""
    p = table(spark, sf_dir, "part")
    raw = F.when(F.col("p_size") % 10 == 0, "").when(F.col("p_size") % 10 < 8, F.concat(F.lit("Oct "), F.col("p_size") % 28 + 1)).otherwise("TBD")
    a = p.select(F.when(F.col("p_partkey") % 50 == 0, "").otherwise(F.col("p_name")).alias("title"), F.col("p_brand").alias("course_id"), F.col("p_partkey").alias("pos"), raw.alias("due_date_raw"))
    a = a.withColumn("category", dates.date_category("due_date_raw"))
    gaps = audit.missing(a, ["title", "course_id", "due_date_raw"], ["title", "course_id", "due_date_raw"])
    return audit.verdict_of(audit.histogram(a), gaps, audit.duplicate_total(a, least=70.0, exact=False))


def audit_per_course(spark, sf_dir):
    courses = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("course_id"), (F.col("c_acctbal") < 0).alias("failed"))
    return audit.per_course(courses, assignments(spark, sf_dir))


def audit_confidence(spark, sf_dir):
    out = audit.confidence_presence(assignments(spark, sf_dir))
    return out.select("n", F.array_join("first", ",").alias("first"))


QUERIES = {
    "deadlines_bucketed": deadlines_bucketed, "deadline_counts": deadline_counts, "attention_groups": attention_groups, "calendar_events": calendar_events, "override_apply": override_apply, "manual_add_anti": manual_add_anti,
    "course_colors": course_colours, "date_anomaly": date_anomaly, "summaries_parsed": summaries_parsed, "summaries_rewritten": summaries_rewritten, "overrides_block": overrides_block, "override_log": override_log, "purge_expired": purge_expired,
    "title_slug_index": title_slug_index, "title_scalars": title_scalars, "fuzzy_titles": fuzzy_titles, "duplicate_pairs": duplicate_pairs, "duplicate_pairs_edit": duplicate_pairs_edit, "duplicate_totals": duplicate_totals, "similar_title_classes": similar_title_classes, "similar_title_ratios": similar_title_ratios, "date_category_histogram": date_category_histogram,
    "due_formats": due_formats, "week_dates": week_dates, "router_fail_open": router_fail_open, "audit_missing": audit_missing, "audit_verdict": audit_verdict, "audit_verdict_titles": audit_verdict_titles, "rubric_branches": rubric_branches, "audit_per_course": audit_per_course, "audit_confidence": audit_confidence,
}

_ROWS = """a AS (
  SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS course_id, 'Order ' || o_orderkey AS title, CASE WHEN o_orderstatus = 'O' THEN 'discussion' ELSE 'essay' END AS type,
         CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS due, CAST(left(o_orderpriority, 1) AS INTEGER) AS confidence_score, o_totalprice AS price FROM orders
), applied AS (
  SELECT id, course_id, CASE WHEN price > 250000 THEN 'Renamed ' || id ELSE title END AS title, type, CASE WHEN price > 200000 AND price <= 300000 THEN '1995-06-17' ELSE due END AS due, due AS due_before, confidence_score,
         price > 300000 AS dismissed, price > 200000 AS user_edited, price > 200000 AND price <= 300000 AS dated, price > 250000 AS renamed, price > 200000 OR price < 20000 AS touched FROM a
), hand AS (
  SELECT 's' || s_suppkey || '__' || regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9_ -]', '', 'g'), '[ _]+', '-', 'g') || '__0' AS id, 's' || s_suppkey AS course_id, s_name AS title, 'manual' AS type,
         CASE WHEN s_acctbal > 0 THEN '1996-02-03T10:30' END AS due, 5 AS confidence_score, s_acctbal > 8000 AS dismissed FROM supplier
), flagged AS (
  SELECT *, CASE WHEN dismissed THEN NULL WHEN due IS NOT NULL AND NOT user_edited AND (CAST(due AS DATE) < DATE '1993-01-01' - 7 OR CAST(due AS DATE) > DATE '1997-12-31' + 30) THEN 'outside_semester_window' WHEN due IS NULL THEN 'unresolved_date'
         WHEN (CASE WHEN dated THEN 5 ELSE confidence_score END) < (CASE WHEN type = 'discussion' THEN 4 ELSE 3 END) THEN 'low_confidence' END AS flag_reason FROM applied
), done AS (
  SELECT id, course_id, title, type, due AS due_date_resolved, confidence_score, CASE WHEN dismissed THEN 'dismissed' WHEN flag_reason IS NOT NULL THEN 'needs_attention' ELSE 'resolved' END AS bucket, flag_reason, touched FROM flagged
  UNION ALL
  SELECT id, course_id, title, type, due, confidence_score, CASE WHEN dismissed THEN 'dismissed' WHEN due IS NULL THEN 'needs_attention' ELSE 'resolved' END, CASE WHEN dismissed THEN NULL WHEN due IS NULL THEN 'unresolved_date' ELSE 'user_added' END, true FROM hand
)"""
_COLOUR = "['#2563eb', '#16a34a', '#dc2626', '#ea580c', '#9333ea', '#0891b2']"
_SHARE = "CASE WHEN (SELECT count(*) FROM c) = 0 THEN '0.0%' ELSE printf('%.1f', 100.0 * count(c.category) / (SELECT count(*) FROM c)) || '%' END"
_STOP = "['the','a','an','of','for','and','or','in','on','to','is','it','at','by','be','as','my','me']"

SQL = {
    "deadlines_bucketed": f"WITH {_ROWS} SELECT id, course_id, title, type, due_date_resolved, confidence_score, bucket, flag_reason FROM done",
    "deadline_counts": f"WITH {_ROWS} SELECT count(DISTINCT course_id) AS course_count, count(*) AS total, count(*) FILTER (bucket = 'resolved') AS resolved, count(*) FILTER (bucket = 'needs_attention') AS needs_attention, count(*) FILTER (bucket = 'dismissed') AS dismissed, count(*) FILTER (flag_reason = 'outside_semester_window') AS flagged_outside_window, count(*) FILTER (touched) AS overrides_applied FROM done",
    "attention_groups": f"WITH {_ROWS} SELECT flag_reason, count(*) AS n FROM done WHERE bucket = 'needs_attention' GROUP BY flag_reason",
    "calendar_events": f"""WITH {_ROWS}, colour AS (SELECT CAST(n_nationkey AS VARCHAR) AS course_id, ({_COLOUR})[1 + (row_number() OVER (ORDER BY CAST(n_nationkey AS VARCHAR)) - 1) % 6] AS colour FROM nation)
        SELECT id, title, due_date_resolved AS start, NOT contains(due_date_resolved, 'T') AS "allDay", coalesce(colour, '#2563eb') AS "backgroundColor", type FROM done LEFT JOIN colour USING (course_id) WHERE bucket = 'resolved'""",
    "override_apply": f"WITH {_ROWS} SELECT id, title, due AS due_date_resolved, dismissed, user_edited, CASE WHEN dated AND renamed THEN 'due_date_resolved,title' WHEN dated THEN 'due_date_resolved' WHEN renamed THEN 'title' ELSE '' END AS fields, CASE WHEN dated THEN due_before END AS due_before FROM applied",
    "manual_add_anti": f"WITH {_ROWS} SELECT id, course_id FROM hand",
    "course_colors": f"SELECT n_name, ({_COLOUR})[1 + (row_number() OVER (ORDER BY n_name) - 1) % 6] AS colour FROM nation",
    "date_anomaly": """
        WITH o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS due, o_custkey, count(*) OVER (PARTITION BY o_custkey) AS n, lag(CAST(o_orderdate AS DATE)) OVER w AS back, lead(CAST(o_orderdate AS DATE)) OVER w AS ahead FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey)),
        g AS (SELECT *, CAST(least(due - back, ahead - due) AS INTEGER) AS gap_days FROM o)
        SELECT id, due < DATE '1993-01-01' - 7 OR due > DATE '1997-12-31' + 30 AS outside, gap_days, n > 2 AND gap_days > 21 AS outlier FROM g""",
    "summaries_parsed": "SELECT o_custkey || '__order-' || o_orderkey || '__0' AS id, 'Order ' || o_orderkey AS title, CASE WHEN o_orderstatus = 'O' THEN 'discussion' ELSE 'essay' END AS type, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS due_date_resolved, CAST(left(o_orderpriority, 1) AS INTEGER) AS confidence_score FROM orders",
    "overrides_block": """
        WITH i AS (SELECT n_regionkey, n_nationkey, '- "' || n_name || '"' || chr(10) || CASE n_nationkey % 5 WHEN 0 THEN '    Status: User dismissed (not a real deadline; ignore)' ELSE '    Due: ' || CASE WHEN n_nationkey % 2 = 0 THEN '2026-03-01' ELSE 'UNRESOLVED' END || chr(10) || '    Type: exam' || chr(10) || CASE n_nationkey % 5 WHEN 1 THEN '    Status: User-added manually' ELSE '    Status: User-edited' END END AS line FROM nation WHERE n_nationkey % 5 < 3),
        c AS (SELECT min(n_nationkey) AS first, 'Course: ' || any_value(r_name) || chr(10) || string_agg(line, chr(10) ORDER BY n_nationkey) AS part FROM i JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey)
        SELECT '[USER-CONFIRMED OVERRIDES — AUTHORITATIVE]' || chr(10) || 'The user has manually corrected the following deadlines. These supersede any' || chr(10) || 'conflicting information in summaries, document text, or the item index below.' || chr(10) || chr(10) || string_agg(part, chr(10) || chr(10) ORDER BY first) || chr(10) AS text FROM c""",
    "purge_expired": """
        WITH kept AS (SELECT * FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1995-01-01' - INTERVAL 30 DAY)),
        p AS (SELECT o_orderstatus, count(*) AS pieces FROM kept JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderstatus)
        SELECT k.o_orderstatus, count(*) AS n, any_value(pieces) AS pieces FROM kept k LEFT JOIN p USING (o_orderstatus) GROUP BY k.o_orderstatus""",
    "title_slug_index": r"""
        WITH s AS (SELECT p_partkey, p_brand, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name), '[^\pL\pN_\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-{2,}', '-', 'g'), '-'), ''), 'untitled') AS slug FROM part)
        SELECT p_partkey, p_brand || '__' || slug || '__' || (row_number() OVER (PARTITION BY p_brand, slug ORDER BY p_partkey) - 1) AS id FROM s""",
    "title_scalars": r"""
        WITH n AS (SELECT p_partkey, p_size, 'Chapter ' || p_size || ' ' || p_name AS label, 'Spring 2026 Chapter ' || p_size || ' ' || p_name || ' (CODE 1)' AS named FROM part)
        SELECT p_partkey, left(label, 55) AS label, regexp_replace(lower(named), 'chapter (\d+)', 'ch\1') AS chapter, 'spring ' || lower(split_part(named, 'Chapter ' || p_size || ' ', 2)) AS plain0,
               left(named || named, 49) || '…' AS auto, printf('%.1f', 100.0 * p_size / 50) || '%' AS share FROM n""",
    "fuzzy_titles": f"""
        WITH t AS (SELECT DISTINCT p_name, lower(p_name) AS low FROM part), b AS (SELECT 'Chapter 7: where is the ' || array_to_string(list_reverse(string_split(p_name, ' ')), ' and ') AS question FROM t),
        tt AS (SELECT *, list_distinct(list_filter(regexp_extract_all(low, '[a-z0-9]+'), lambda x: NOT list_contains({_STOP}, x))) AS tk FROM t),
        bq AS (SELECT question, replace(lower(question), 'chapter 7', 'ch7') AS q FROM b), bb AS (SELECT *, list_distinct(list_filter(regexp_extract_all(q, '[a-z0-9]+'), lambda x: NOT list_contains({_STOP}, x))) AS qk FROM bq)
        SELECT question, p_name FROM tt, bb WHERE contains(q, low) OR contains(low, q) OR (len(tk) > 0 AND len(qk) > 0 AND len(list_intersect(tk, qk)) >= greatest(2, len(tk) // 2))""",
    "duplicate_pairs_edit": """
        SELECT a.p_brand, a.p_partkey AS a, b.p_partkey AS b, round(100.0 * (1 - levenshtein(lower(a.p_name), lower(b.p_name)) / greatest(length(a.p_name), length(b.p_name))), 4) AS similarity
        FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey
        WHERE 200.0 * least(length(a.p_name), length(b.p_name)) >= 70.0 * (length(a.p_name) + length(b.p_name)) AND 100.0 * (1 - levenshtein(lower(a.p_name), lower(b.p_name)) / greatest(length(a.p_name), length(b.p_name))) >= 70.0""",
    "duplicate_totals": """
        WITH t AS (SELECT split_part(p_type, ' ', 1) AS kind, p_name, count(*) AS n FROM part GROUP BY ALL)
        SELECT a.kind, CAST(sum(CASE WHEN a.p_name = b.p_name THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END) AS BIGINT) AS duplicates FROM t a JOIN t b ON a.kind = b.kind AND a.p_name <= b.p_name
        WHERE a.p_name = b.p_name OR (200.0 * least(length(a.p_name), length(b.p_name)) >= 70.0 * (length(a.p_name) + length(b.p_name)) AND 100.0 * (1 - levenshtein(lower(a.p_name), lower(b.p_name)) / greatest(length(a.p_name), length(b.p_name))) >= 70.0)
        GROUP BY a.kind HAVING sum(CASE WHEN a.p_name = b.p_name THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END) > 0""",
    "similar_title_classes": """
        WITH t AS (SELECT split_part(p_type, ' ', 1) AS kind, p_name, count(*) AS n FROM part GROUP BY ALL),
        s AS (SELECT a.kind, a.p_name AS ta, b.p_name AS tb, round(CASE WHEN a.p_name = b.p_name THEN 100.0 ELSE 100.0 * (1 - levenshtein(lower(a.p_name), lower(b.p_name)) / greatest(length(a.p_name), length(b.p_name))) END, 4) AS similarity, a.n AS na, b.n AS nb FROM t a JOIN t b ON a.kind = b.kind AND a.p_name <= b.p_name)
        SELECT kind, ta, tb, similarity, na, nb, CAST(CASE WHEN ta = tb THEN na * (na - 1) // 2 ELSE na * nb END AS BIGINT) AS pairs FROM s WHERE similarity >= 70.0 AND (ta < tb OR na > 1)""",
    "date_category_histogram": rf"""
        WITH m AS (SELECT string_agg(lower(strftime(make_date(2001, i, 1), '%B')) || '|' || lower(strftime(make_date(2001, i, 1), '%b')), '|') AS months FROM range(1, 13) AS t(i)),
        w AS (SELECT string_agg(lower(strftime(make_date(2001, 1, i), '%A')), '|') AS days FROM range(1, 8) AS t(i)),
        t AS (SELECT lower(text) AS x, text, months, days FROM documents, m, w),
        c AS (SELECT CASE WHEN text IS NULL OR regexp_matches(x, '^\s*(none|null|n/a)?\s*$') THEN 'missing' WHEN regexp_matches(text, '[0-9]{{4}}(-[0-9][0-9]){{2}}[T ][0-9][0-9]:[0-9][0-9]') THEN 'iso_datetime' WHEN regexp_matches(x, '\b[0-9]{{4}}(-[0-9][0-9]){{2}}\b') THEN 'iso_date'
            WHEN regexp_matches(x, '(' || months || ')\s+[0-9]') OR regexp_matches(x, '\b[0-9][0-9]?/[0-9][0-9]?(/[0-9]{{2,4}})?\b') OR regexp_matches(x, '\b[0-9][0-9]?-[0-9][0-9]?(-[0-9]{{2,4}})?\b') THEN 'date_string'
            WHEN regexp_matches(x, '\b(week|class|session|lecture|module|unit|lab)\s*[0-9]+\b') OR regexp_matches(x, '\bnext\s+(' || days || ')\b') OR regexp_matches(x, '\b(before|by|during)\s+class\b') THEN 'relative'
            WHEN NOT regexp_matches(x, '[0-9]') OR list_bool_or(list_transform(['tbd', 'tba', 'not specified', 'end of semester', 'end of term', 'end of year', 'end of course', 'before spring break', 'before fall break', 'before winter break', 'before summer break', 'to be announced', 'to be determined', 'flexible', 'ongoing',
              'see syllabus', 'see instructor', 'see course page', 'check blackboard', 'check canvas', 'check course page', 'varies', 'rolling', 'as assigned'], lambda p: contains(x, p) AND regexp_matches(x, '\b' || p || '\b'))) THEN 'vague' ELSE 'relative' END AS category FROM t),
        names AS (SELECT unnest([0, 1, 2, 3, 4, 5]) AS place, unnest(['iso_datetime', 'iso_date', 'date_string', 'relative', 'vague', 'missing']) AS category)
        SELECT place, names.category, count(c.category) AS n, {_SHARE} AS share, place < 3 AS parseable FROM names LEFT JOIN c USING (category) GROUP BY ALL""",
    "due_formats": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS due, CASE o_orderkey % 5 WHEN 3 THEN 'iso_date' ELSE 'date_string' END AS category FROM orders",
    "week_dates": "SELECT o_orderkey, CAST(DATE '2026-01-14' + CAST(7 * (o_orderkey % 15) AS INTEGER) AS VARCHAR) AS due, 3 AS confidence FROM orders",
    "router_fail_open": "SELECT event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN event_type ELSE 'click,purchase,signup' END AS courses FROM events",
    "audit_missing": "SELECT unnest(['text', 'lang', 'source', 'quality', 'toxic']) AS field, unnest([count(*) FILTER (coalesce(text, '') = ''), count(*) FILTER (coalesce(lang, '') = ''), count(*) FILTER (coalesce(source, '') = ''), count(*) FILTER (quality IS NULL), count(*) FILTER (toxic IS NULL)]) AS n, unnest([true, false, true, false, false]) AS critical FROM documents LEFT JOIN labels USING (doc_id)",
    "audit_verdict": r"""
        WITH o AS (SELECT o_custkey, o_orderstatus, 'Order ' || o_orderkey AS title FROM orders),
        t AS (SELECT count(*) AS total, count(*) FILTER (o_orderstatus <> 'P') AS parseable, count(*) FILTER (title IS NULL) + count(*) FILTER (o_custkey IS NULL) + count(*) FILTER (o_orderstatus IS NULL) AS gaps FROM o),
        n AS (SELECT o_custkey, title, count(*) AS n FROM o GROUP BY ALL),
        d AS (SELECT (SELECT coalesce(sum(n * (n - 1) // 2), 0) FROM n) + (SELECT count(*) FROM n x JOIN n y ON x.o_custkey = y.o_custkey AND x.title < y.title AND trim(regexp_replace(x.title, '\d+', '', 'g')) <> trim(regexp_replace(y.title, '\d+', '', 'g'))) AS duplicates)
        SELECT total, parseable, CAST(gaps AS BIGINT) AS gaps, CAST(duplicates AS BIGINT) AS duplicates, CASE WHEN 100.0 * parseable / total >= 80 AND gaps = 0 AND duplicates = 0 THEN 'GREEN' WHEN 100.0 * parseable / total >= 60 THEN 'YELLOW' ELSE 'RED' END AS verdict FROM t, d""",
    "audit_verdict_titles": """
        WITH a AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 50 = 0 THEN '' ELSE p_name END AS t, p_size % 10 AS m FROM part),
        d AS (SELECT count(*) AS duplicates FROM a x JOIN a y ON x.p_brand = y.p_brand AND x.p_partkey < y.p_partkey WHERE x.t = y.t OR (x.t <> '' AND y.t <> '' AND 200.0 * least(length(x.t), length(y.t)) >= 70.0 * (length(x.t) + length(y.t)) AND 100.0 * (1 - levenshtein(lower(x.t), lower(y.t)) / greatest(length(x.t), length(y.t))) >= 70.0)),
        c AS (SELECT count(*) AS total, count(*) FILTER (m BETWEEN 1 AND 7) AS parseable, count(*) FILTER (t = '') + count(*) FILTER (m = 0) AS gaps FROM a)
        SELECT total, parseable, gaps, duplicates, CASE WHEN 100.0 * parseable / total >= 80 AND gaps = 0 AND duplicates = 0 THEN 'GREEN' WHEN 100.0 * parseable / total >= 60 THEN 'YELLOW' ELSE 'RED' END AS verdict FROM c, d""",
    "rubric_branches": """
        WITH r AS (SELECT o_orderkey, o_orderkey % 8 AS k, CAST(o_orderkey % 15 AS INTEGER) AS w, o_orderkey % 2 = 0 AS page FROM orders)
        SELECT o_orderkey, CASE k WHEN 0 THEN 'iso_date' WHEN 1 THEN 'date_string' WHEN 4 THEN 'vague' WHEN 5 THEN 'missing' WHEN 7 THEN 'vague' ELSE 'relative' END AS category,
               CASE WHEN k IN (0, 1) THEN CASE WHEN page THEN 5 ELSE 4 END WHEN k IN (2, 3, 6) THEN 3 WHEN k IN (4, 7) THEN 2 ELSE 1 END AS confidence,
               CASE k WHEN 2 THEN CAST(DATE '2026-01-16' + 7 * w AS VARCHAR) WHEN 3 THEN CAST(DATE '2026-01-14' + 7 * w AS VARCHAR) WHEN 6 THEN '2026-02-03' ELSE 'UNRESOLVED' END AS day FROM r""",
    "audit_per_course": "SELECT CAST(c_custkey AS VARCHAR) AS course_id, count(o_orderkey) AS n, count(o_orderkey) < 5 AS low FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE c_acctbal >= 0 GROUP BY c_custkey",
    "audit_confidence": "SELECT (SELECT count(*) FROM orders) AS n, string_agg(o_orderpriority, ',' ORDER BY o_orderkey) AS first FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 8)",
}
SQL["title_scalars"] = SQL["title_scalars"].replace("plain0", "plain").replace("'spring ' || lower(split_part(named, 'Chapter ' || p_size || ' ', 2))", r"regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower(named), 'chapter \d+', ''), '\b\d+\b', '', 'g'), '\s+', ' ', 'g')), ' +', ' ', 'g')")
