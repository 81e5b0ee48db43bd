import csv
import io
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.sources import files, ranges, records


def plain_states(data, state, before, separator):
    """The automaton a byte at a time: inside flags and the state behind."""
    inside = []
    for byte in data:
        inside.append(state == records.IN)
        at_start = before in (separator, 10, 13)
        if byte != 0x22:
            state = records.IN if state == records.IN else records.OUT
        elif state == records.OUT:
            state = records.IN if at_start else records.OUT
        else:
            state = records.BEHIND if state == records.IN else records.IN
        before = byte
    return inside, state


@pytest.mark.parametrize("window", [1, 2, 5, 1 << 14])
def test_quote_states(monkeypatch, window):
    monkeypatch.setattr(records, "_WINDOW", window)
    random_ = random.Random(window)
    for _ in range(400):
        data = bytes(random_.choice(b'""",\n\rab') for _ in range(random_.randrange(40)))
        for state in records.STATES:
            before = 0x22 if state == records.BEHIND else random_.choice(b'",\na')
            inside, end = records.inside_quotes(np.frombuffer(data, np.uint8), state, before, ord(","))
            expected, last = plain_states(data, state, before, ord(","))
            assert end == last, (data, state, before)
            # a value's own quotes may count as either
            assert [i for i, b, e in zip(inside, data, expected) if b != 0x22 and bool(i) != e] == [], (data, state, before)


def test_utf8_of_blocks():
    """Blocks of any size answer for the whole together."""
    random_ = random.Random(4)
    for _ in range(600):
        data = b"".join(random_.choice([b"a", "é".encode(), "日".encode(), "😀".encode()]) for _ in range(random_.randrange(1, 12)))
        if random_.random() < 0.6:
            i = random_.randrange(len(data))
            data = data[:i] + random_.choice([b"\xe9", b"\x80", b"", b"\xf0\x80"]) + data[i + 1 :]
        try:
            data.decode()
            valid = True
        except UnicodeDecodeError:
            valid = False
        for size in (1, 2, 3, 5):
            parts = []
            for start in range(0, len(data), size):
                own = data[start : start + size + 4]
                parts.append(ranges.is_utf8(own, start == 0, start + len(own) >= len(data), max(0, len(own) - size)))
            assert all(parts) == valid, (data, size)


def table_of(seed, rows):
    random_ = random.Random(seed)
    values = ["plain", "with, comma", "two\nlines", 'a "quoted" word', "", "é ü", "crlf\r\nin it", '"', "\n\n", "x" * 30]
    return [[str(i), random_.choice(values), random_.choice(values)] for i in range(rows)]


def write_csv(path, rows, encoding="utf-8", end="\n", header=("id", "a", "b")):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end).writerows([header, *rows])
    path.write_bytes(out.getvalue().encode(encoding))


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_records_across_blocks(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(ranges, "BLOCK_BYTES", size)
    written = {}
    for k, (encoding, end) in enumerate([("utf-8", "\n"), ("latin-1", "\r\n"), ("utf-8-sig", "\n")]):
        rows = [[f"{k}-{r[0]}", *r[1:]] for r in table_of(k, 60 if size < 10 else 300)]
        write_csv(tmp_path / f"f{k}.csv", rows, encoding, end)
        written.update({r[0]: tuple(v or None for v in r[1:]) for r in rows})
    got = files.read_csv(spark, str(tmp_path), null_tokens=("",), schema="id string, a string, b string")
    assert {r.id: (r.a, r.b) for r in got.collect()} == written


def test_late_quoted_break_and_late_latin1(spark, tmp_path):
    lines = ["id,name"] + [f"{i},plain{i}" for i in range(3000)]
    (tmp_path / "late.csv").write_text("\n".join([*lines, '3000,"two\nlines"']) + "\n")
    got = files.load_dataset(spark, str(tmp_path / "late.csv"))
    assert got.count() == 3001 and dict(got.dtypes)["id"] == "bigint"
    assert got.where("id = 3000").first().name == "two\nlines"
    (tmp_path / "latin.csv").write_bytes(("\n".join([*lines, "3000,Müller"]) + "\n").encode("latin-1"))
    got = files.load_dataset(spark, str(tmp_path / "latin.csv"))
    assert got.count() == 3001 and got.where("id = 3000").first().name == "Müller"


def test_stray_quotes_and_short_rows(spark, tmp_path):
    (tmp_path / "s.csv").write_text('size,note\n5" pipe,"a\nb"\n6" pipe,x,extra\n7" pipe\n\n"8""",""\n')
    rows = files.read_csv(spark, str(tmp_path / "s.csv")).collect()
    assert [tuple(r) for r in sorted(rows, key=lambda r: r["size"])] == [('5" pipe', "a\nb"), ('6" pipe', "x"), ('7" pipe', None), ('8"', None)]


def test_one_file_is_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "BLOCK_BYTES", 1000)
    write_csv(tmp_path / "one.csv", [[str(i), "x\ny", "z"] for i in range(2000)])
    states = records.block_states(ranges.listing(spark, str(tmp_path)), str(tmp_path))
    assert states.count() > 15
    cut = records.cut_records(states.withColumn("encoding", F.lit("utf-8")), str(tmp_path))
    assert cut.select(F.spark_partition_id().alias("p")).distinct().count() > 8 and cut.count() == 2001


def test_sparse_file_costs_few_bytes(spark, tmp_path):
    with open(tmp_path / "big.csv", "wb") as file:
        file.write(b"a,b\n1,2\n")
        file.truncate(1 << 30)
    row = ranges.with_samples(ranges.listing(spark, str(tmp_path)), str(tmp_path)).first()
    assert row.length == 1 << 30 and row.bytes_read < 1 << 20 and row.head.startswith(b"a,b")
    assert files.catalog_files(spark, str(tmp_path)).first().format == "csv"


def test_listing_of_nested_folders(spark, tmp_path, monkeypatch):
    for limit in (1, 3, 200):
        monkeypatch.setattr(ranges, "LISTING_PARTITIONS", limit)
        root = tmp_path / str(limit)
        wanted = {}
        for i, name in enumerate(["a.csv", "x/b.csv", "x/y/c d.csv", "z/e.csv", "z/w/v/f.csv"]):
            (root / name).parent.mkdir(parents=True, exist_ok=True)
            (root / name).write_text("1" * i)
            wanted[f"file:{root / name}"] = i
        for hidden in ("_SUCCESS", "x/.crc", "_temporary/part.csv"):
            (root / hidden).parent.mkdir(parents=True, exist_ok=True)
            (root / hidden).write_text("")
        assert {r.path: r.length for r in ranges.listing(spark, str(root)).collect()} == wanted
        assert ranges.listing(spark, f"file:{root}/a.csv").count() == 1
    with pytest.raises(FileNotFoundError):
        ranges.listing(spark, str(tmp_path / "none"))


def test_a_store_that_only_spark_opens(spark, tmp_path, monkeypatch):
    write_csv(tmp_path / "a.csv", [["1", "x\ny", "z"], ["2", "", "é"]])
    (tmp_path / "copy.csv").write_bytes((tmp_path / "a.csv").read_bytes())
    monkeypatch.setattr(ranges, "open_store", lambda uri: None)
    assert files.load_dataset(spark, str(tmp_path), has_header=True).count() == 4
    assert files.check_uploads(spark, str(tmp_path)).where("accepted").count() == 1
    assert {r.encoding for r in files.catalog_files(spark, str(tmp_path)).collect()} == {"utf-8"}


def test_utf16_and_lone_returns(spark, tmp_path):
    (tmp_path / "wide.csv").write_bytes("id,b\n1,é\n2,y\n".encode("utf-16"))
    assert [tuple(r) for r in files.load_dataset(spark, str(tmp_path / "wide.csv"), has_header=True).orderBy("id").collect()] == [(1, "é"), (2, "y")]
    (tmp_path / "mac.csv").write_bytes(b"id,b\r1,x\r2,y\r")
    assert files.load_dataset(spark, str(tmp_path / "mac.csv"), has_header=True).count() == 2


def test_uploads_of_a_folder(spark, tmp_path):
    for name, text in (("a.csv", "1"), ("b/c.csv", "1"), ("d.csv", ""), ("e.bin", "1")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = {os.path.relpath(r.path[5:], tmp_path): (r.reject_reason, r.length) for r in files.check_uploads(spark, str(tmp_path)).collect()}
    assert rows == {"a.csv": (None, 1), "b/c.csv": ("duplicate", 1), "d.csv": ("empty", 0), "e.bin": ("unsupported", 1)}
