import gzip
import hashlib
import random

import pytest
from llm.helpers import clashing

from siftstone.llm import warc
from siftstone.session import new_folder

SCHEMA = "page_id long, url string, html string"


def pages():
    random_ = random.Random(4)
    rows = [(i, f"http://h/{i}", "".join(random_.choice("<p>é你\r\n x") for _ in range(random_.choice([0, 5, 900, 3_000, 50_000])))) for i in range(40)]
    long = "copied page " * 200
    rows += [(50, "http://a b\r\nX: y", long), (51, None, long), (52, "u", long), (53, "u", "short"), (54, "u", "short"), (55, None, None), (56, "u", "x" * 1000), (57, "u", "x" * 1000)]
    rows += [(58, "u", "line\r\n\r\nWARC/1.1\r\n\r\n" * 60), (59, "u", "y" * 999), (60, "u", "y" * 999)]
    return rows


def expected(rows):
    largest = {}
    for i, _, html in rows:
        if html and len(html.encode()) >= 1000:
            largest[html] = max(i, largest.get(html, i))
    out = {}
    for i, _, html in rows:
        data = (html or "").encode()
        first = largest.get(html, i)
        out[i] = (len(data), hashlib.sha1(data).hexdigest(), "response" if first == i else "revisit", None if first == i else first)
    return out


def test_round_trip(spark):
    rows = pages()
    found = warc.round_trip(clashing(spark.createDataFrame(rows, SCHEMA).drop("html")).drop("html").join(spark.createDataFrame(rows, SCHEMA).select("page_id", "html"), "page_id")).collect()
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found} == expected(rows)


def test_payloads_and_segments(spark):
    rows = pages()
    path = new_folder(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), path, segment=700)
    records = warc.read_records(spark, path)
    assert records.filter("type = 'continuation'").count() > 50
    whole = {r["page_id"]: r["payload"] for r in warc.read_pages(spark, path).collect() if r["record_type"] == "response"}
    assert all(bytes(v) == (dict((i, h) for i, _, h in rows)[k] or "").encode() for k, v in whole.items())
    lost = records.filter("NOT (type = 'continuation' AND segment = 2)")
    with pytest.raises(Exception, match="segments missing"):
        warc.reassembled(lost).collect()


def test_records_are_plain_warc():
    (first, *rest) = warc._records(7, "http://x/", "é" * 400, None, "urn:r:1", 300)
    archive = b"".join(r.encode() + b"\r\n\r\n" for r in [first, *rest])
    parsed = list(warc.parse_records(archive))
    assert [h["warc-segment-number"] for h, _ in parsed] == [str(i + 1) for i in range(len(parsed))]
    headers, payload = warc.http_payload(b"".join(b for _, b in parsed))
    assert payload.decode() == "é" * 400 and headers["transfer-encoding"] == "chunked"
    assert int(parsed[-1][0]["warc-segment-total-length"]) == sum(len(b) for _, b in parsed)
    with pytest.raises(ValueError):
        list(warc.parse_records(archive[:-9]))
    assert gzip.decompress(gzip.compress(archive)) == archive


def test_odd_tables(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "z" * 2_000
    rows = [(1, "u", long), (1, "u", long), (None, "u", long), (None, None, None)]
    found = warc.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in found) == [(0, "response", 0), (0, "revisit", 1), (1, "response", 0), (1, "response", 0)]


def test_archives_go_by_bytes_not_by_partitions(spark, monkeypatch):
    rows = [(i, f"http://h/{i}", f"page {i} " * 300) for i in range(400)]
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    cores = spark.sparkContext.defaultParallelism
    files = []
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for task_bytes in (warc.TASK_BYTES, 30_000):
            monkeypatch.setattr(warc, "TASK_BYTES", task_bytes)
            path = new_folder(spark, "warc-test")
            warc.write_archives(spark.createDataFrame(rows, SCHEMA), path)
            files.append(spark.read.format("binaryFile").load(path).count())
            found = warc.read_pages(spark, path).collect()
            assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found} == expected(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert files[0] <= cores < files[1]
