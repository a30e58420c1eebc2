"""Operator 5, WARC: archives with an index first, and coalesced range reads.

``write_archives`` writes one gzip member per record and returns the index:
file, offset, length, URL and digest of each record.  ``read_records`` takes the
rows of an index that are wanted, sorts them by file and offset, joins ranges that
lie close together into one read each, and parses the records out of these.

A task writes files under names of its own attempt, and the index holds what the
attempts that counted have written; files of lost attempts are never read.

Defined results: a null payload is empty; a null URL leaves the header out; control
characters and white space in a URL are percent-encoded; payloads of any length
are kept whole; of records with equal payloads of ``least`` bytes or more, those
with the largest page_id are responses and the others revisits of it (so rows
with equal id and payload are all responses); rows without an id are responses; an
empty table gives no archive and an empty result; only id, URL and payload are
read.  Every record's WARC-Record-ID is its own, from its file and offset; a revisit names
the page it refers to and that page's URL (of several, the last in the alphabet).

``folder`` is a path or URI that both Spark and Arrow's file systems can open: a local or
mounted path, or file, hdfs, s3, gs or abfs (s3a and s3n are taken for s3).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .scratch import Scratch, checkpointed
from .skew import light

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a file from which a new one is begun; the largest hole that is read along; bytes of one read.
FILE_BYTES, GAP, RUN = 64 << 20, 64 << 10, 4 << 20
#: Archived bytes that one task reads back, about, and the most tasks: beyond them, tasks grow with the archives.
TASK_BYTES, MOST_TASKS = 16 << 20, 100_000
#: Rows that are Python objects at a time.
ROWS = 64

INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string, refers_to long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for ``folder``, and the path in it."""
    scheme, _, rest = folder.partition(":")
    if scheme in ("s3a", "s3n"):
        folder = f"s3:{rest}"
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _clean(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(name: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """A WARC/1.1 record; a revisit keeps the HTTP headers, with the full payload's length, alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}", f"WARC-Record-ID: {_urn(name)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Date: {DATE}", f"Refers-To-Page-ID: {refers_to}"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_clean(refers_url)}")
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def warcinfo(name: str) -> bytes:
    """The first record of the file ``name``, compressed."""
    body = "software: lodestack\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Date: {DATE}", f"WARC-Record-ID: {_urn(name)}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return gzip.compress(("\r\n".join(head) + f"\r\n\r\n{body}\r\n\r\n").encode(), 1, mtime=0)


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (names in lower case) and what follows these."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    warc = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(warc["content-length"])]
    http_head, _, payload = block.partition(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http_head.decode("latin-1").split("\r\n")[1:])}
    return warc, http, payload


def equal_payloads(pages: DataFrame, payload: str, least: int) -> tuple[DataFrame, DataFrame]:
    """Id and digest of each record that counts, and per digest that several ids have the largest of them with its URL."""
    narrow = pages.where("page_id IS NOT NULL").where(F.octet_length(payload) >= least).select("page_id", "url", F.sha1(F.col(payload).cast("binary")).alias("digest_hex"))
    groups = narrow.groupBy("digest_hex").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least"), F.max(F.struct("page_id", "url")).alias("last"))
    groups = groups.where("least <> refers_to").select("digest_hex", "refers_to", F.col("last.url").alias("refers_url"))
    return narrow.drop("url"), groups


def write_archives(pages: DataFrame, folder: str, scratch: Scratch, least: int = 0, file_bytes: int = FILE_BYTES, id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes the archives into ``folder``, which all executors reach, and returns the index, saved in ``scratch``."""
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))
    narrow, groups = equal_payloads(rows, "payload", least)
    groups = scratch.save(groups, "groups")
    old = narrow.join(light(groups), "digest_hex").where("page_id <> refers_to").select("page_id", "digest_hex", "refers_to", "refers_url").distinct()
    old = scratch.save(old, "revisits")
    rows = rows.withColumn("digest_hex", F.sha1(F.col("payload").cast("binary"))).join(light(old), ["page_id", "digest_hex"], "left")
    rows = rows.select("page_id", "url", "payload", "refers_to", "refers_url")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        stream, name, at = None, "", 0
        for part in (batch.slice(i, ROWS) for batch in batches for i in range(0, batch.num_rows, ROWS)):
            out: list[tuple] = []
            for page_id, target, text, refers_to, refers_url in zip(*(c.to_pylist() for c in part.columns), strict=True):
                body = text.encode()
                digest = digest_of(body)
                if stream is None:
                    name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    system.create_dir(root, recursive=True)
                    stream = system.open_output_stream(f"{root}/{name}", compression=None)
                    info = warcinfo(name)
                    stream.write(info)
                    at = len(info)
                member = gzip.compress(record(f"{name}#{at}", page_id, target, body, digest, refers_to, refers_url), 1, mtime=0)
                stream.write(member)
                out.append((name, at, len(member), target, digest, page_id, "response" if refers_to is None else "revisit", refers_to))
                at += len(member)
                if at >= file_bytes:
                    stream.close()
                    stream = None
            columns = list(zip(*out, strict=True)) or [[]] * 8
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["file", "offset", "length", "url", "digest", "page_id", "record_type", "refers_to"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
        if stream is not None:
            stream.close()

    ship(pages.sparkSession)
    return scratch.save(rows.mapInArrow(work, INDEX), "index")


def runs(entries: Iterator[tuple[str, int, int]], gap: int = GAP, most: int = RUN) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(file, start, end, members) of reads: sorted ranges no more than ``gap`` apart, up to ``most`` bytes together."""
    now: tuple[str, int, int, list] | None = None
    for file, offset, length in entries:
        if now and (file != now[0] or offset - now[2] > gap or offset + length - now[1] > most):
            yield now
            now = None
        if now is None:
            now = (file, offset, offset, [])
        now[3].append((offset, length))
        now = (file, now[1], max(now[2], offset + length), now[3])
    if now:
        yield now


def read_records(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records that ``index`` selects; with ``payloads`` also their bytes (null in revisits)."""
    schema = RECORD + (", payload binary" if payloads else "")
    spread = index.select("file", "offset", "length", F.floor(F.col("offset") / RUN).alias("piece"))
    # Each piece of a file holds RUN bytes at most, however many records are wanted from it.  The number of
    # tasks follows the archived bytes: the index rows, by which Spark would choose it, are small.
    wanted = index.agg(F.sum("length").alias("n")).first()["n"] or 0
    tasks = max(1, min(MOST_TASKS, -(-wanted // TASK_BYTES)))
    sorted_rows = spread.repartition(tasks, "file", "piece").sortWithinPartitions("file", "offset")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        entries = ((f, o, n) for b in batches for f, o, n in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True))
        source, name = None, None
        for file, start, end, members in runs(entries):
            if file != name:
                source, name = system.open_input_file(f"{root}/{file}"), file
            data = source.read_at(end - start, start)
            out = []
            for offset, length in members:
                warc, http, payload = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                digest = warc["warc-payload-digest"].removeprefix("sha1:")
                if warc["warc-type"] == "response" and digest_of(payload) != digest:
                    raise ValueError(f"{file}, offset {offset}: the payload's digest is not the one in the header")
                number = lambda k: int(warc[k]) if k in warc else None  # noqa: B023, E731
                size = len(payload) if warc["warc-type"] == "response" else int(http["content-length"])
                out.append((number("page-id"), warc.get("warc-target-uri"), size, digest, warc["warc-type"], number("refers-to-page-id"), payload if warc["warc-type"] == "response" else None))
            columns = list(zip(*out, strict=True))
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            keep = 7 if payloads else 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:keep], types[:keep], strict=True)], names=names[:keep])

    ship(index.sparkSession)
    return sorted_rows.select("file", "offset", "length").mapInArrow(work, schema)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archives ``pages`` in the shared folder and reads every record back."""
    with Scratch(pages.sparkSession) as scratch:
        folder = f"{scratch.path}/archives"
        index = write_archives(pages, folder, scratch, least)
        return checkpointed(read_records(index, folder).drop("url"))


def sql() -> str:
    """The result over ``pages``, for DuckDB."""
    letters = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {1 + 5 * i}, 5))::BIGINT >> {s}) & 31)::BIGINT + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {letters} AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM d"""
