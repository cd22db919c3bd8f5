"""WARC archives with an index written first and coalesced range reads.

Writing: each task appends gzip members, one per record, to archives in a shared folder and returns an
index row (file, offset, length, url, digest) per record. The index is a table of its own and the only way to
a record, so archives left by a failed or doubled attempt are never read. Reading: the selected index
rows are range-sorted by file and offset, neighbouring byte ranges are joined into one read, and each record is
parsed from its slice.

Of records with equal payloads the one with the smallest page_id carries the payload (response), the others
refer to it (revisit). Only digests and ids are aggregated for that; a digest that many pages share
is combined before the shuffle.

Nulls: a null payload is empty; a null url or page_id leaves its header out and reads back as null; a null
page_id is the largest. Repeated rows that share the smallest page_id and the payload are all responses.
Empty table: no archive and no rows. CR, LF and other control characters in a url are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.llm.common import materialise, ready, scratch_path, table

#: Bytes after which a task starts another archive, and the most that one range read takes in.
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 8 << 20
#: Unwanted bytes between two records that are read along rather than split the read.
GAP_BYTES = 64 << 10
#: Stored bytes that one reading task takes.
TASK_BYTES = 64 << 20
LEVEL = 1
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string"


def open_store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a shared folder; local ones, S3, GCS and HDFS go by their scheme."""
    uri = re.sub(r"^file:/+", "file:///", uri)
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One record; of a revisit the payload itself is left out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _clean(url)))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}")]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page", refers_to)]
    fields += [("X-Page-Id", page_id)] * (page_id is not None)
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = LEVEL) -> bytes:
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def parse_record(member: bytes) -> dict:
    """Header fields in lower case, and ``http`` fields and ``payload`` of the block; raises if lengths or digest don't hold."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no record here: {first[:20]!r}")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("the record is cut off")
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["http"] = dict(line.split(": ", 1) for line in http.decode("latin-1").split("\r\n")[1:])
    fields["payload"] = payload
    if fields["warc-type"] == "response" and fields["warc-payload-digest"] != f"sha1:{base32_sha1(payload)}":
        raise ValueError("the payload doesn't match its digest")
    return fields


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, level: int = LEVEL, date: str = DATE) -> DataFrame:
    """Writes ``pages(page_id, url, html)`` under ``folder`` and returns the index table, already stored there."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("large", F.octet_length("payload") >= min_bytes)
    # Payloads that occur once need no partner; of known size, the others are broadcast where they are few.
    first = rows.where("large").groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("k")).where("k > 1")
    first = materialise(first.select("sha1", "first_id", F.lit(True).alias("repeated")), "warc-repeated")
    rows = rows.join(first, "sha1", "left")
    rows = rows.withColumn("revisit", F.col("large") & F.coalesce("repeated", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first_id")))
    rows = rows.select("page_id", "url", "sha1", "first_id", "revisit", F.octet_length("payload").alias("n"), F.when(~F.col("revisit"), F.col("payload")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                index = []
                for page_id, url, sha1, first_id, revisit, n, payload in zip(*(batch.column(i) for i in range(7))):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    page_id, url, revisit = page_id.as_py(), url.as_py(), revisit.as_py()
                    digest = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                    body = bytes(n.as_py()) if revisit else payload.as_py()
                    member = gzip_member(build_record(page_id, url, body, digest, first_id.as_py(), revisit, date), level)
                    out.write(member)
                    index.append((page_id, name, at, len(member), url, digest, "revisit" if revisit else "response"))
                    at += len(member)
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                columns = zip(*index) if index else [()] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[f.split()[0] for f in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return materialise(rows.mapInArrow(run, INDEX), "warc-index")


def ranges(rows: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> list[tuple[int, int, list[int]]]:
    """Sorted (offset, length) -> (offset, length, positions) of the joined reads."""
    out: list[tuple[int, int, list[int]]] = []
    for i, (offset, length) in enumerate(rows):
        if out and offset - (out[-1][0] + out[-1][1]) <= gap and offset + length - out[-1][0] <= most:
            start, had, members = out[-1]
            out[-1] = (start, max(had, offset + length - start), [*members, i] if len(members) < 2 else (members.append(i) or members))
        else:
            out.append((offset, length, [i]))
    return out


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of the selected ``index`` rows: header facts, digest and payload as stored (null for a revisit)."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [f.split()[0] for f in schema.split(", ")]

    def parsed(member: bytes) -> tuple:
        r = parse_record(member)
        revisit = r["warc-type"] == "revisit"
        number = lambda k: int(r[k]) if k in r else None
        n = int(r["http"]["Content-Length"]) if revisit else len(r["payload"])
        return number("x-page-id"), r.get("warc-target-uri"), n, r["warc-payload-digest"].removeprefix("sha1:"), r["warc-type"], number("x-refers-to-page"), None if revisit else r["payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        name, source = None, None
        for batch in batches:
            files, offsets, lengths = (batch.column(i).to_pylist() for i in range(3))
            start = 0
            while start < len(files):
                end = next((i for i in range(start, len(files)) if files[i] != files[start]), len(files))
                if files[start] != name:
                    name = files[start]
                    source = store.open_input_file(f"{root}/{name}")
                for offset, length, members in ranges(list(zip(offsets[start:end], lengths[start:end]))):
                    data = source.read_at(length, offset)
                    rows = [parsed(data[offsets[start + i] - offset : offsets[start + i] - offset + lengths[start + i]]) for i in members]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                start = end

    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    wanted = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return wanted.mapInArrow(run, schema)


def op7_warc_index_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    folder = scratch_path(spark, "warc")
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL_OP7 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, upper(sha1(payload)) AS x FROM p),
b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 8), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(x, 5 * i + 1, 5))::BIGINT // 32768 % 32 + 1)::BIGINT, 1)
     || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(x, 5 * i + 1, 5))::BIGINT // 1024 % 32 + 1)::BIGINT, 1)
     || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(x, 5 * i + 1, 5))::BIGINT // 32 % 32 + 1)::BIGINT, 1)
     || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(x, 5 * i + 1, 5))::BIGINT % 32 + 1)::BIGINT, 1)), '') AS payload_digest
  FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM b)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""
