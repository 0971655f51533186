"""WARC archives: writer, monolithic-gzip normaliser with a sidecar index, and reader.

The writer makes archives in the form crawlers often deliver: one gzip stream
over a whole file.  Such a file cannot be read from the middle, so the
normaliser inflates the stream once, in pieces of bounded size, rewrites every
record as a gzip member of its own, and writes an index of member offsets
beside the archive.  The reader seeks by that index and checks payload digests.

Records with equal payloads (of at least ``least_bytes``) are one response,
that of the smallest page id, and revisits that name it; a revisit keeps the
HTTP header, whose Content-Length is that of the full payload.

Files go through ``pyarrow.fs``, which reaches the shared folder whatever its
scheme.  Each attempt of a task writes under a new name and only names in the
manifest count, so retried and lost tasks leave no double records.

Edge cases: null html is the empty payload; null urls give records without
target; a null page id is never a response if an equal payload has an id; rows
that repeat a page id and payload are all responses; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, materialise, new_path, partitions, small, table

CHUNK = 1 << 20
FILE_BYTES = 64 << 20
LEVEL = 6
#: What a reader gathers before it hands rows on.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20
MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64())])
NORMALISED = pa.schema([("path", pa.string()), ("index", pa.string()), ("records", pa.int64())])
RECORD = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def store(uri: str):
    """The file system and path of a folder as Hadoop names it: what ``pyarrow`` calls otherwise is mapped to it."""
    scheme, colon, rest = uri.partition(":")
    if not colon:
        return fs.FileSystem.from_uri(f"file://{uri}")
    if scheme in ("s3a", "s3n"):
        scheme = "s3"
    elif scheme == "dbfs":  # mounted in the local tree of every worker
        scheme, rest = "file", "///dbfs/" + rest.lstrip("/")
    elif scheme == "file":
        rest = "///" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{scheme}:{rest}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; with ``refers_to`` a revisit, whose block ends after the HTTP header."""
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if revisit:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


class Inflated:
    """Bytes of a gzip file of one or many members, inflated a chunk at a time."""

    def __init__(self, source):
        self.source, self.buffer, self.inflate, self.raw, self.ended = source, bytearray(), zlib.decompressobj(31), b"", False

    def more(self) -> bool:
        while not self.ended:
            if self.inflate.eof:
                self.raw = self.inflate.unused_data
                self.inflate = zlib.decompressobj(31)
            raw = self.inflate.unconsumed_tail or self.raw or self.source.read(CHUNK)
            self.raw = b""
            if not raw:
                self.ended = True
                self.buffer += self.inflate.flush()
                return bool(self.buffer)
            data = self.inflate.decompress(raw, CHUNK)
            if data:
                self.buffer += data
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with ``mark``; None at the end of the file."""
        seen = 0
        while (at := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - len(mark) + 1)
            if not self.more():
                if self.buffer.strip():
                    raise ValueError("archive ends inside a record")
                return None
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self.more():
                raise ValueError("archive ends inside a record")
            piece = self.take(min(n, len(self.buffer), CHUNK))
            n -= len(piece)
            yield piece


def normalise_file(source, archive, index) -> int:
    """Rewrite a gzip WARC stream as one member per record; an index line has offset, length, id and type."""
    stream, at, n = Inflated(source), 0, 0
    while (head := stream.until(b"\r\n\r\n")) is not None:
        head = head.lstrip(b"\r\n")
        if not head.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        fields = headers(head[:-4])
        member, length = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
        length += archive.write(member.compress(head))
        for piece in stream.pieces(int(fields["content-length"]) + 4):
            length += archive.write(member.compress(piece))
        length += archive.write(member.flush())
        index.write((json.dumps({"offset": at, "length": length, "id": fields["warc-record-id"], "type": fields["warc-type"]}) + "\n").encode())
        at, n = at + length, n + 1
    return n


def read_member(raw: bytes) -> dict:
    """The record in one member; a response's payload is checked against its digest and length."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = headers(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    size, found = int(headers(http)["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(payload) != size or digest(payload) != found):
        raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
    own = lambda x: int(v) if (v := x[len("<urn:page:") : -1]) else None
    return {"page_id": own(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": found, "record_type": fields["warc-type"], "refers_to": own(fields["warc-refers-to"]) if "warc-refers-to" in fields else None, "payload": payload if fields["warc-type"] == "response" else None}


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): the smallest page id of equal payloads is the response."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("key", F.sha2(F.col("html").cast("binary"), 256))
    equal = rows.where(F.octet_length("html") >= least_bytes).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    equal = materialise(equal, "equal")
    out = rows.join(small(equal, equal.count(), 96), "key", "left")
    return out.select("page_id", "url", "html", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write one-stream gzip archives of up to about ``FILE_BYTES`` of text each; manifest (path, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = store(folder)
        out, done = None, []
        for batch in batches:
            for page_id, url, html, refers_to in _rows(batch):
                if out is None:
                    system.create_dir(base, recursive=True)
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, gz = system.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = record(page_id, url, html.encode("utf-8"), refers_to)
                out.write(gz.compress(data))
                n, size = n + 1, size + len(data)
                if size >= FILE_BYTES:
                    out.write(gz.flush())
                    out.close()
                    done.append((f"{folder}/{name}", n))
                    out = None
        if out is not None:
            out.write(gz.flush())
            out.close()
            done.append((f"{folder}/{name}", n))
        yield _batch(done, MANIFEST)

    return materialise(records.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, records long"), "manifest")


def normalise_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Normalise every file of the manifest; (path, index, records) of the new archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = store(folder)
        for batch in batches:
            for path, records in _rows(batch):
                system.create_dir(base, recursive=True)
                name = uuid.uuid4().hex
                from_system, from_path = store(path)
                with from_system.open_input_stream(from_path, compression=None) as source, system.open_output_stream(f"{base}/{name}.warc.gz", compression=None) as archive, system.open_output_stream(f"{base}/{name}.idx", compression=None) as index:
                    n = normalise_file(source, archive, index)
                if n != records:
                    raise ValueError(f"{path}: {n} records, {records} expected")
                yield _batch([(f"{folder}/{name}.warc.gz", f"{folder}/{name}.idx", n)], NORMALISED)

    return materialise(_spread(manifest).mapInArrow(run, "path string, index string, records long"), "normalised")


def read_archives(normalised: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of the archives, found through the sidecar indexes; with ``payloads`` a batch ends at ``BATCH_BYTES`` of them."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    fields = pa.schema([*RECORD, *([("payload", pa.binary())] * payloads)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index, _ in _rows(batch):
                rows, held = [], 0
                index_system, index_at = store(index)
                system, at = store(path)
                with system.open_input_file(at) as archive:
                    for entry in _lines(index_system, index_at):
                        row = read_member(archive.read_at(entry["length"], entry["offset"]))
                        payload = row.pop("payload")  # checked against its digest; kept only where asked for
                        rows.append((*row.values(), payload) if payloads else tuple(row.values()))
                        held += len(payload or b"") if payloads else 0
                        if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                            yield _batch(rows, fields)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, fields)

    return _spread(normalised.select("path", "index", "records")).mapInArrow(run, schema)


def _lines(system, path: str) -> Iterator[dict]:
    """The entries of an index, a piece of the file at a time."""
    rest = b""
    with system.open_input_stream(path, compression=None) as source:
        while piece := source.read(CHUNK):
            *whole, rest = (rest + piece).split(b"\n")
            yield from map(json.loads, whole)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of plain Python values: ids stay whole numbers, which nullable columns of pandas do not keep."""
    for row in zip(*batch.columns, strict=True):
        yield tuple(x.as_py() for x in row)


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, fields, strict=True)], schema=fields)


def _spread(files: DataFrame) -> DataFrame:
    """A file a row: dealt round robin so that as many tasks as there are slots have one."""
    return files.repartition(partitions(files.sparkSession))


def round_trip(pages: DataFrame, least_bytes: int = 0, payloads: bool = False) -> DataFrame:
    """Write ``pages`` as archives, normalise them and read them back; the one-stream files go once rewritten."""
    spark = pages.sparkSession
    raw, clean = new_path(spark, "warc-raw"), new_path(spark, "warc")
    normalised = normalise_archives(write_archives(plan_records(pages, least_bytes), raw), clean)
    delete(spark, raw)
    return read_archives(normalised, payloads)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), bits AS (
  SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', hex[i])]), 'string_agg', '') AS b,
         min(page_id) OVER (PARTITION BY html) AS first
  FROM p
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * CAST(b[5*i+1] AS INT) + 8 * CAST(b[5*i+2] AS INT) + 4 * CAST(b[5*i+3] AS INT) + 2 * CAST(b[5*i+4] AS INT) + CAST(b[5*i+5] AS INT)]), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM bits
"""
