"""Chat threads and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import auto_title, renamed_title, uuid_id
from .documents import expired

NEW_TITLE = "New chat"


def messages(threads: DataFrame) -> DataFrame:
    """One row per message, ``pos`` its place in the thread."""
    return threads.select(F.col("id").alias("thread_id"), F.posexplode("messages").alias("pos", "m")).select("thread_id", "pos", "m.*")


def list_threads(threads: DataFrame, include_deleted: bool = False) -> DataFrame:
    rows = threads if include_deleted else threads.where(F.col("deleted_at").isNull())
    return rows.orderBy(F.desc("updated_at"))


def deleted_threads(threads: DataFrame) -> DataFrame:
    return threads.where(F.col("deleted_at").isNotNull()).orderBy(F.desc("deleted_at"))


def titles(messages: DataFrame, thread: str = "thread_id") -> DataFrame:
    """(thread, title): from the first message if a user wrote it, else the title of a new chat."""
    first = messages.groupBy(thread).agg(F.min(F.struct("pos", "role", "content")).alias("m"))
    return first.select(thread, F.when(F.col("m.role") == "user", auto_title("m.content")).otherwise(NEW_TITLE).alias("title"))


def first_messages(messages: DataFrame) -> DataFrame:
    """Messages without an earlier one in their thread."""
    first = messages.groupBy("thread_id").agg(F.min("pos").alias("pos"))
    return messages.join(first, ["thread_id", "pos"], "left_semi")


def create(rows: DataFrame, now: str) -> DataFrame:
    """New threads of (incognito, key); ``at_head`` gives them their place."""
    empty = "array<struct<role: string, content: string, timestamp: string, attachments: array<struct<doc_id: string, name: string>>>>"
    return rows.select(uuid_id("thread_", "key", F.lit(now)).alias("id"), F.lit(NEW_TITLE).alias("title"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"), F.coalesce("incognito", F.lit(False)).alias("incognito"), F.lit(None).cast("string").alias("deleted_at"), F.array().cast(empty).alias("messages"), F.array().cast("array<string>").alias("documents"))


def at_head(stored: DataFrame, new: DataFrame, seq: str = "seq") -> DataFrame:
    """Adds ``pos`` to new threads: before all stored ones, the newest (by the whole number ``seq``) first."""
    first, last = (frame.agg(f(c)).first()[0] for frame, f, c in ((stored, F.min, "pos"), (new, F.min, seq)))
    return new.withColumn("pos", F.lit(first if first is not None else 0).cast("long") - 1 - (F.col(seq) - F.lit(last if last is not None else 0)))


def rename(threads: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    new = changes.select("id", renamed_title("title").alias("__title"))
    out = threads.join(new, "id", "left").withColumn("updated_at", F.when(F.col("__title").isNotNull(), F.lit(now)).otherwise(F.col("updated_at")))
    return out.withColumn("title", F.coalesce("__title", "title")).select(*threads.columns)


def append(threads: DataFrame, new: DataFrame, now: str, memory_enabled: bool = True) -> DataFrame:
    """Append messages (thread_id, seq, role, content, attachments) in ``seq`` order.

    Nothing happens with memory off or for unknown threads; only user rows keep attachments; an empty
    thread that is still untitled takes its title from a first message by the user.
    """
    if not memory_enabled:
        return threads
    kept = F.when((F.col("role") == "user") & (F.size("attachments") > 0), F.col("attachments"))
    rows = new.select("thread_id", "seq", F.struct("role", "content", F.lit(now).alias("timestamp"), kept.alias("attachments")).alias("m"))
    added = rows.groupBy(F.col("thread_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "m"))), lambda x: x["m"]).alias("__new"))
    out = threads.join(added, "id", "left")
    first = F.get("__new", 0)
    named = (F.size("messages") == 0) & (F.col("title") == NEW_TITLE) & (first["role"] == "user")
    return out.withColumns({
        "title": F.when(F.col("__new").isNotNull() & named, auto_title(first["content"])).otherwise(F.col("title")),
        "updated_at": F.when(F.col("__new").isNotNull(), F.lit(now)).otherwise(F.col("updated_at")),
        "messages": F.when(F.col("__new").isNull(), F.col("messages")).otherwise(F.concat("messages", "__new")),
    }).select(*threads.columns)


BUCKETS = 64


def append_log(heads: DataFrame, log: DataFrame, new: DataFrame, now: str, memory_enabled: bool = True) -> tuple[DataFrame, DataFrame]:
    """The heads after ``new`` messages (thread_id, seq, role, content, attachments), and the rows to add to the message log.

    The rules of ``append``, on threads whose messages are rows of a log of their own: nothing that is there is read but
    which of the named threads have a message, and nothing of it is written again, however long a thread is.
    """
    if not memory_enabled:
        return heads, _log_rows(new.limit(0), now)
    known = new.join(heads.select(F.col("id").alias("thread_id")), "thread_id", "left_semi")
    first = known.groupBy(F.col("thread_id").alias("id")).agg(F.min_by(F.struct("role", "content"), "seq").alias("__first"))
    begun = log.join(first.select(F.col("id").alias("thread_id")), "thread_id", "left_semi").select(F.col("thread_id").alias("id")).distinct().withColumn("__begun", F.lit(True))
    out = heads.join(first.join(begun, "id", "left"), "id", "left")
    named = F.col("__begun").isNull() & (F.col("title") == NEW_TITLE) & (F.col("__first.role") == "user")
    after = out.withColumns({"title": F.when(named, auto_title("__first.content")).otherwise(F.col("title")), "updated_at": F.when(F.col("__first").isNotNull(), F.lit(now)).otherwise(F.col("updated_at"))})
    return after.select(*heads.columns), _log_rows(known, now)


def _log_rows(new: DataFrame, now: str) -> DataFrame:
    """Rows of the message log: ``at`` and ``seq`` are their order in a thread; only user rows keep attachments."""
    kept = F.when((F.col("role") == "user") & (F.size("attachments") > 0), F.col("attachments"))
    return new.select("thread_id", F.lit(now).alias("at"), F.col("seq").cast("long").alias("seq"), "role", "content", kept.alias("attachments"))


def write_log(rows: DataFrame, path: str) -> None:
    """Append to a message log that is kept in buckets of threads, so that a thread's messages are read from one of them."""
    bucket = F.pmod(F.xxhash64("thread_id"), F.lit(BUCKETS)).cast("int")
    rows.withColumn("bucket", bucket).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def of_thread(log: DataFrame, thread_id: str) -> DataFrame:
    """The messages of one thread, in order, from its bucket."""
    bucket = F.pmod(F.xxhash64(F.lit(thread_id)), F.lit(BUCKETS)).cast("int")
    at = log.sparkSession.range(1).select(bucket).first()[0]
    return log.where((F.col("bucket") == at) & (F.col("thread_id") == thread_id)).orderBy("at", "seq")


def exported(heads: DataFrame, log: DataFrame) -> DataFrame:
    """Threads with their messages nested: the form of an export, a thread a row."""
    m = F.struct("at", "seq", F.struct("role", "content", F.col("at").alias("timestamp"), "attachments").alias("m"))
    nested = log.groupBy(F.col("thread_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(m)), lambda x: x["m"]).alias("__messages"))
    return heads.join(nested, "id", "left").withColumn("messages", F.coalesce("__messages", "messages")).select(*heads.columns)


def with_incognito(messages: DataFrame, turns: DataFrame) -> DataFrame:
    """Stored messages with the turns of incognito threads, which are in this view and never written.

    ``turns``: (thread_id, pos, role, content) of the session.
    """
    return messages.select("thread_id", "pos", "role", "content").withColumn("incognito", F.lit(False)).unionByName(turns.select("thread_id", "pos", "role", "content").withColumn("incognito", F.lit(True)))


def settings(changes: DataFrame) -> DataFrame:
    """(name, value) after a log of (seq, name, value): the last value of every setting."""
    return changes.groupBy("name").agg(F.max_by("value", "seq").alias("value"))


def attachments(messages: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """(thread_id, doc_ids): all attached ids in first-seen order, prior messages before the current ones."""
    rows = messages.select("thread_id", F.lit(0).alias("turn"), "pos", F.posexplode("attachments").alias("at", "a")).select("thread_id", "turn", "pos", "at", F.col("a.doc_id").alias("doc_id"))
    if current is not None:
        rows = rows.unionByName(current.select("thread_id", F.lit(1).alias("turn"), F.lit(0).alias("pos"), F.col("pos").alias("at"), "doc_id"))
    first = rows.groupBy("thread_id", "doc_id").agg(F.min(F.struct("turn", "pos", "at")).alias("seen"))
    return first.groupBy("thread_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "doc_id"))), lambda x: x["doc_id"]).alias("doc_ids"))


def attachment_names(ids: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds ``name``: the original file name, else the id."""
    names = documents.select(F.col("id").alias("doc_id"), F.col("original_filename").alias("name"))
    return ids.join(names, "doc_id", "left").withColumn("name", F.coalesce("name", "doc_id"))


def purge(threads: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return threads.join(expired(threads, as_of, days).select("id"), "id", "left_anti")


def delete_forever(threads: DataFrame, ids: DataFrame) -> DataFrame:
    return threads.join(ids.select("id"), "id", "left_anti")


def clear(threads: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Every live thread marked deleted, and how many that were."""
    live = F.col("deleted_at").isNull()
    return threads.withColumn("deleted_at", F.coalesce("deleted_at", F.lit(now))), threads.agg(F.count_if(live).alias("cleared"))


def roles(messages: DataFrame) -> DataFrame:
    """Turns per thread, in all and by role."""
    return messages.groupBy("thread_id").agg(F.count("*").alias("turns"), *[F.count_if(F.col("role") == r).alias(f"{r}_turns") for r in ("user", "assistant", "system")])
