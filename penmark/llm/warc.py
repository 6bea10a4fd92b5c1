"""WARC archives with an index of byte ranges.

Write: pages equal in digest and length (of at least ``MIN_REVISIT`` bytes)
form a group; the largest page_id is the response, the others are revisits
without a payload. The group's winner is a maximum combined map-side, and the
winners are joined back with salted keys, so a large group of copies is split
over tasks. Each task writes one archive, a gzip member per record, in
page_id order, and hands out an index row per record: file, offset, length,
url, digest.

Read: the selected index rows are range-partitioned and sorted by file and
offset; neighbouring ranges are read in one request, members are unpacked and
parsed, and each response's payload is checked against its digest.

Defined cases: a null html is an empty payload; a null url is left out of the
record; control characters and spaces in urls are percent-encoded in the
header, and the index keeps the url as it was; rows that repeat the winner's
page_id and payload are responses too; null page ids are kept, and win only
among themselves; an empty table gives an empty index; other columns are not
read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, ship, written
from .files import NewFile, make_folder, open_fs

MIN_REVISIT = 1000
SALTS = 16
GAP = 64 << 10
TASK = 32 << 20  # bytes of archives that a reading task is dealt, about
READ = 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, payload_digest string, payload_bytes long, record_type string, file string, offset long, length long"
ROW = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _uri(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url)


def _record_id(page_id: int | None, digest: str) -> str:
    h = hashlib.sha1(f"{page_id}:{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:32]}>"


def _base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, not compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}",
        "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{_base32(digest)}", f"X-Payload-Length: {size}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    block = http + (payload if refers_to is None else b"")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The record's fields; a response's payload must match its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    named = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(named["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    digest = base64.b32decode(named["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind, size = named["WARC-Type"], int(named["X-Payload-Length"])
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    if payload is not None and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
        raise ValueError("a payload does not match its digest")
    number = lambda k: int(named[k]) if k in named else None
    return {
        "page_id": number("X-Page-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": number("X-Refers-To-Page-ID"), "url": named.get("WARC-Target-URI"), "payload": payload,
    }


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the archives; returns the index (a table in the shared folder)."""
    spark = pages.sparkSession
    ship(spark)
    folder = make_folder(folder or fresh_path(spark, "warc"))
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("body"))
    rows = rows.withColumn("digest", F.sha1("body")).withColumn("size", F.octet_length("body").cast("long"))
    groups = rows.where(F.col("size") >= MIN_REVISIT).groupBy("digest", "size").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first"))
    groups = groups.where("n > 1 AND first IS NOT NULL").select(
        F.col("digest").alias("g_digest"), F.col("size").alias("g_size"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("g_salt")
    )
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    same = (F.col("digest") == F.col("g_digest")) & (F.col("size") == F.col("g_size")) & (F.col("salt") == F.col("g_salt"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.join(groups, same, "left").select("page_id", "url", "body", "digest", "size", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # every attempt of a task has files of its own, which its index rows name
        out, name = None, f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            found = []
            cols = [batch.column(n) for n in ("page_id", "url", "body", "digest", "size", "refers_to")]
            for i in range(batch.num_rows):
                page, url, body, digest, size, refers = (c[i].as_py() for c in cols)
                member = gzip.compress(record(page, url, body, digest, size, refers), 4, mtime=0)
                out = out or NewFile(folder, name)
                kind = "response" if refers is None else "revisit"
                found.append((page, url, digest, size, kind, f"{folder}/{name}", out.write(member), len(member)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _schema(INDEX))] if found else [pa.array([], f.type) for f in _schema(INDEX)], schema=_schema(INDEX))
        if out:
            out.close()

    return written(rows.sortWithinPartitions("page_id", "url", "digest").mapInArrow(write, INDEX), "warc-index")


def ranges(rows: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Runs of sorted (offset, length) to be read in one request: gaps up to
    GAP, and READ bytes unless a record alone is longer."""
    run: list[tuple[int, int]] = []
    for offset, length in rows:
        if run and (offset - sum(run[-1]) > GAP or offset + length - run[0][0] > READ):
            yield run
            run = []
        run.append((offset, length))
    if run:
        yield run


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Read the records that the rows of ``index`` (any selection) name."""

    ship(index.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            files, at, n = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
            first = 0
            while first < len(files):
                last = first
                while last < len(files) and files[last] == files[first]:
                    last += 1
                if files[first] != name:
                    name = files[first]
                    fs, path = open_fs(name)
                    source = fs.open_input_file(path)
                for run in ranges(list(zip(at[first:last], n[first:last]))):
                    start = run[0][0]
                    data = source.read_at(sum(run[-1]) - start, start)
                    got = []
                    for offset, length in run:
                        row = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                        got.append(row if payloads else row | {"payload": None})
                    yield pa.RecordBatch.from_pylist(got, schema=_schema(ROW))
                first = last

    index = index.select("file", "offset", "length")
    # the rows are slim, the records are not: tasks by the bytes that they read
    tasks = 1 + (index.agg(F.sum("length")).first()[0] or 0) // TASK
    ordered = index.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(read, ROW)


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes
  FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY body) AS first FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM g
"""
