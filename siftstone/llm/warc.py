"""WARC archives: writing pages as segmented, chunked records, and reading and reassembling them.

A page's payload is framed in chunks behind HTTP headers. A block longer than ``SEGMENT`` bytes is split over a
first record and continuation records, which name the first as their origin and carry a segment number; the last also has the total
length. Of pages with equal payloads of at least ``LEAST`` bytes, one is a response and the others are revisits that refer
to it. The reader groups segments by origin, orders them by number, verifies count and total length and undoes the chunks.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder
from .common import tidy
LEAST = 1_000
SEGMENT = 1 << 15
CHUNK = 1 << 12
#: Most records in one archive file, which bounds it at 64 MB before compression.
FILE_RECORDS = 2_048
#: Bytes of records (counted as html, url and ``HEADER`` each) for every task that writes, unless the session's cores need more tasks.
TASK_BYTES = 8 << 20
HEADER = 1 << 10
#: Copies of the table of repeated payloads, over which the pages of one payload are spread.
SALTS = 16
DATE = "2024-01-01T00:00:00Z"
_END = "\r\n\r\n"


# --- which pages are responses ---------------------------------------------------------------------------------------


def with_roles(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``page_id, url, html, refers_to``: null for a response, else the page that this one revisits.

    The response of equal payloads is the page with the largest id; a repeated row of that page is a response too. Pages without id refer to the page
    with one, if there is any. Null html is an empty payload.
    """
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    keyed = own.withColumn("key", F.when(F.octet_length("html") >= least, F.sha2("html", 256)))
    repeated = keyed.filter("key IS NOT NULL").groupBy("key").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    salted = repeated.select(F.col("key").alias("k"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    # pages without key or repetition spread by the salt alone would meet in few tasks: a hash stands in for their key
    key = F.coalesce("key", F.xxhash64("page_id", "url", "html").cast("string"))
    joined = keyed.withColumn("key", key).withColumn("salt", salt).join(salted, (F.col("key") == F.col("k")) & (F.col("salt") == F.col("s")), "left")
    return joined.select("page_id", "url", "html", F.when(F.col("first") != F.coalesce("page_id", F.col("first") - 1), F.col("first")).alias("refers_to"))


# --- writing ---------------------------------------------------------------------------------------------------------


def _pieces(data: bytes, size: int):
    """Cuts of at most ``size`` bytes that split no UTF-8 character."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[at:end]
        at = end


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    return b"".join([b"%x\r\n%s\r\n" % (len(p), p) for p in _pieces(payload, size)]) + b"0\r\n\r\n"


def _header(fields) -> str:
    return "WARC/1.1\r\n" + "\r\n".join(f"{k}: {v}" for k, v in fields if v is not None)


def _one_line(url):
    """A URL that can stand in a header."""
    return None if url is None else "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _records(page_id, url, html, refers_to, name, segment):
    """The records of one page as texts, without the empty lines that end a record."""
    payload = html.encode()
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    common = [("WARC-Date", DATE), ("WARC-Target-URI", _one_line(url)), ("WARC-Payload-Digest", digest), ("X-Page-ID", page_id), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}{_END}".encode()
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        return [_header([*fields, *common, ("Content-Length", len(block))]) + _END + block.decode()]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked{_END}".encode() + chunked(payload)
    parts = list(_pieces(block, segment))
    out = []
    for i, part in enumerate(parts, 1):
        if i == 1:
            fields = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{name}>"), *common, ("WARC-Segment-Number", 1 if len(parts) > 1 else None)]
        else:
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{name}:{i}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", i)]
            fields += [("WARC-Segment-Total-Length", len(block))] * (i == len(parts))
        out.append(_header([*fields, ("Content-Length", len(part))]) + _END + part.decode())
    return out


def writing_tasks(pages: DataFrame) -> int:
    """How many tasks write the archives (one narrow scan): by the bytes, and enough for all cores."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)).cast("long") for c in ("html", "url")), F.lit(HEADER))
    total = pages.agg(F.sum(size)).first()[0] or 0
    return max(pages.sparkSession.sparkContext.defaultParallelism, math.ceil(total / TASK_BYTES))


def write_archives(pages: DataFrame, path: str, least: int = LEAST, segment: int = SEGMENT) -> None:
    """Writes WARC records for each row of ``pages(page_id, url, html)`` below ``path``, at most ``FILE_RECORDS`` in a gzip-compressed file.

    Spark's text writer commits the files, so a lost task leaves none behind; its line separator is the end of a record. Record
    ids come from the task's partition and a counter: they are unique, also for repeated rows. Small partitions are written
    together, as every file costs its executor more than its bytes: on local disks, Hadoop starts a program for each right that it sets.
    """
    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                records = []
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    number += 1
                    records += _records(page_id, url, html, refers_to, f"urn:record:{part}:{number}", segment)
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.string())], names=["value"])

    records = with_roles(pages, least).coalesce(writing_tasks(pages)).mapInArrow(tidy(run), "value string")
    records.write.option("lineSep", _END).option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(path)


# --- reading ---------------------------------------------------------------------------------------------------------


def parse_records(data: bytes):
    """(headers, block) of every record of one uncompressed archive; header names in lower case."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start, length = end + 4, int(headers["content-length"])
        block = data[start : start + length]
        if len(block) < length or data[start + length : start + length + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut off")
        yield headers, block
        at = start + length + 4


def unchunked(data: bytes) -> bytes:
    """Undoes chunked transfer framing (chunk extensions and trailers are skipped)."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + size])
        at = end + 2 + size
        if len(out[-1]) < size or data[at : at + 2] != b"\r\n":
            raise ValueError("a chunk is cut off")
        at += 2


def http_payload(block: bytes) -> tuple[dict, bytes]:
    """HTTP headers (lower case) and the payload without transfer framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("latin-1").split("\r\n")[1:])}
    return headers, unchunked(body) if headers.get("transfer-encoding", "").lower() == "chunked" else body


_SEGMENTS = "record string, origin string, segment int, total long, type string, page_id long, digest string, refers_to string, block binary"
_PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all archives below ``path``: ids, segment number (1 if unsegmented), total length, headers, block."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                whole = content.as_py()
                for headers, block in parse_records(gzip.decompress(whole) if whole[:2] == b"\x1f\x8b" else whole):
                    number = headers.get("warc-segment-number")
                    origin = headers.get("warc-segment-origin-id") or (headers["warc-record-id"] if number else None)
                    total, page = headers.get("warc-segment-total-length"), headers.get("x-page-id")
                    rows.append((
                        headers["warc-record-id"], origin, int(number or 1), int(total) if total else None, headers["warc-type"],
                        int(page) if page else None, headers.get("warc-payload-digest"), headers.get("warc-refers-to"), block,
                    ))
                    if len(rows) == 256:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(tidy(run), _SEGMENTS)


def _batch(rows):
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in _SEGMENTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)


def reassembled(records: DataFrame) -> DataFrame:
    """Whole records: segments grouped by their origin's id, ordered by number and joined; others pass without a shuffle.

    A record whose segments are not 1, 2, … or do not add up to the stated total raises an error. A group holds the segments of one
    record.
    """
    single = records.filter("origin IS NULL").select("type", "page_id", "digest", "refers_to", "block")
    parts = F.sort_array(F.collect_list(F.struct("segment", "total", "type", "page_id", "digest", "refers_to", "block")))
    grouped = records.filter("origin IS NOT NULL").groupBy("origin").agg(parts.alias("parts"))
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p["block"]))
    sound = (F.col("parts.segment") == F.sequence(F.lit(1), F.size("parts"))) & (F.element_at("parts", -1)["total"] == length)
    first = F.element_at("parts", 1)
    block = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["block"]))
    joined = grouped.select(
        first["type"].alias("type"), first["page_id"].alias("page_id"), first["digest"].alias("digest"), first["refers_to"].alias("refers_to"),
        F.when(F.coalesce(sound, F.lit(False)), block).otherwise(F.raise_error(F.concat(F.lit("segments missing of "), "origin")).cast("binary")).alias("block"),
    )
    return single.unionByName(joined)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, payload`` per page of the archives below ``path``.

    A response's payload is decoded and checked against its digest (an error, if it differs); a revisit has no payload, and length and
    digest of the one it refers to come from its headers. Digests are bare lower-case hexadecimal SHA-1.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for kind, page, digest, refers_to, block in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    headers, payload = http_payload(block)
                    stated = base64.b32decode(digest.removeprefix("sha1:")).hex()
                    if kind == "revisit":
                        rows.append((page, int(headers["content-length"]), stated, kind, int(refers_to.strip("<>").rpartition(":")[2]), None))
                        continue
                    if hashlib.sha1(payload).hexdigest() != stated:
                        raise ValueError(f"the payload of page {page} does not have the digest {stated}")
                    rows.append((page, len(payload), stated, kind, None, payload))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in _PAGES.split(", ")])

    return reassembled(read_records(spark, path)).mapInArrow(tidy(run), _PAGES)


def round_trip(pages: DataFrame) -> DataFrame:
    """The pages as read back from archives written in the shared folder, without the payloads."""
    path = new_folder(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_pages(pages.sparkSession, path).drop("payload")
