import pytest
from pyspark.sql import functions as F

from siftstone.functions import columns
from siftstone.sources import files, sinks
from siftstone.streaming import events as streams

CSV = "col_a,col_b,when\n1,hello,2024-01-01\n2,N/A,2024-02-01\nNone,world,null\n"


@pytest.fixture()
def landing(tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    (tmp_path / "copy.csv").write_text(CSV)
    (tmp_path / "b.tsv").write_text("x\ty\n1\t2\n3\t4\n")
    (tmp_path / "c.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "d.json").write_text('[{"a": 1}, {"a": 2}, {"a": 3}]')
    (tmp_path / "e.txt").write_bytes(b"\xef\xbb\xbfp;q\n1;2\n3;4\n")
    (tmp_path / "f.csv").write_bytes(b"PK\x03\x04rest")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "g.exe").write_text("zz")
    return tmp_path


def test_catalog(spark, landing):
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.catalog_files(spark, str(landing)).collect()}
    assert rows["a.csv"].format == "csv" and rows["a.csv"].delimiter == ","
    assert rows["b.tsv"].delimiter == "\t" and rows["e.txt"].delimiter == ";" and rows["e.txt"].encoding == "utf-8-sig"
    assert rows["c.jsonl"].is_newline_json and not rows["d.json"].is_newline_json
    assert rows["f.csv"].format == "excel" and rows["g.exe"].format == "csv"


def test_upload_checks(spark, landing):
    known = spark.createDataFrame([("00",)], "checksum string")
    rows = {r.path.rsplit("/", 1)[1]: r.reject_reason for r in files.check_uploads(spark, str(landing), known).collect()}
    assert rows["a.csv"] is None and rows["copy.csv"] == "duplicate"
    assert rows["empty.csv"] == "empty" and rows["g.exe"] == "unsupported"
    again = files.check_uploads(spark, str(landing)).where("accepted").select("checksum")
    assert files.check_uploads(spark, str(landing), again).where("accepted").count() == 0


def test_readers(spark, landing):
    df = files.load_dataset(spark, str(landing / "a.csv"), has_header=True)
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "string", "date"]
    assert df.where("col_a is null").count() == 1 and df.where("col_b is null").count() == 1
    assert files.load_dataset(spark, str(landing / "d.json")).count() == 3
    assert files.load_dataset(spark, str(landing / "c.jsonl")).count() == 2
    assert files.load_dataset(spark, str(landing / "e.txt")).columns == ["p", "q"]
    assert files.load_dataset(spark, str(landing / "a.csv"), has_header=True, sample_rows=2).count() == 2
    typed = files.load_dataset(spark, str(landing / "a.csv"), "csv", schema="a int, b string, c date")
    assert typed.columns == ["a", "b", "c"] and typed.agg(F.sum("a")).first()[0] == 3
    with pytest.raises(ValueError):
        files.load_dataset(spark, str(landing / "f.csv"))


def test_audit(spark):
    df = spark.createDataFrame([("x.y", "secret.csv", None)], "event_type string, filename string, user_id string")
    row = sinks.audit_records(df).first()
    assert "secret" not in row.record and "user_id" not in row.record and len(row.audit_id) == 36


def test_report_and_json_sinks(spark, tmp_path):
    df = spark.range(3).toDF("n")
    sinks.write_report({"kpis": df, "insights": df}, str(tmp_path / "r"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "r" / "kpis")).count() == 3


def test_keys(spark):
    row = spark.range(1).select(
        columns.short_hash(F.lit("abc"), 8).alias("s"),
        columns.canonical_json({"b": F.lit("x"), "a": F.lit(1)}).alias("j"),
    ).first()
    assert row.s == "ba7816bf" and row.j == '{"a": 1, "b": "x"}'
    with pytest.raises(ValueError):
        columns.short_hash(F.lit("x"), 0)


# ── streams ─────────────────────────────────────────────────────────────────


def test_new_files_update_the_profile(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    spark.range(0, 50).selectExpr("double(id) as v").write.parquet(str(source / "one"))
    stream = files.stream_dataset(spark, str(source) + "/*", "v double")
    streams.update_to(streams.running_profile(stream, ["v"]), out, "complete")
    assert streams.newest(spark, out, ["column_name"]).first().row_count == 50
    spark.range(50, 80).selectExpr("double(id) as v").write.parquet(str(source / "two"))
    stream = files.stream_dataset(spark, str(source) + "/*", "v double")
    streams.update_to(streams.running_profile(stream, ["v"]), out, "complete")
    row = streams.newest(spark, out, ["column_name"]).withColumn("m", streams.sketch_quantile("sketch", 0.5)).first()
    assert row.row_count == 80 and row.max_val == 79 and abs(row.m - 39.5) < 2


def test_two_consumers_read_the_same_events(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(20).write.parquet(source)
    seen = {}
    queries = [
        streams.consume(
            files.stream_dataset(spark, source, "id long"), name,
            lambda batch, _, name=name: seen.__setitem__(name, seen.get(name, 0) + batch.count()), str(tmp_path / "cp"),
        )
        for name in ("first", "second")
    ]
    for q in queries:
        q.processAllAvailable()
        q.stop()
    assert seen == {"first": 20, "second": 20}


def test_decode_problems(spark):
    good = '{"event_id": "1", "dataset_id": "d", "storage_key": "k"}'
    df = spark.createDataFrame(
        [(good.encode(),), (b"\x00\x00\x00\x00\x00" + good.encode(),), (b"\x00\x00\x00\x00\x07xx",), (b"oops",),
         (b'{"event_id": "2"}',)], "value binary",
    )
    got = [r.problem for r in streams.decode_values(df, "value", streams.UPLOADED).collect()]
    assert got == [None, None, "avro schema", "unreadable", "missing field"]


# ── layouts of CSV files ────────────────────────────────────────────────────


def _written(tmp_path, name, data):
    (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def test_timestamps_keep_the_time_of_day(spark, tmp_path):
    path = _written(tmp_path, "a.csv", b"id,at,day\n1,2024-01-01 10:05:00,2024-01-01\n2,2024-01-02 00:00:00,2024-01-02\n3,2024-01-03 07:00:00,2024-01-05\n")
    df = files.load_dataset(spark, path)
    assert dict(df.dtypes) == {"id": "bigint", "at": "timestamp", "day": "date"}
    assert df.orderBy("id").first().at.hour == 10


def test_quoted_newlines(spark, tmp_path):
    path = _written(tmp_path, "a.csv", b'id,note\n1,"two\nlines, and ""quotes"""\n2,"one"\n3,"x"\n')
    rows = files.load_dataset(spark, path).orderBy("id").collect()
    assert [r.id for r in rows] == [1, 2, 3] and rows[0].note == 'two\nlines, and "quotes"'


@pytest.mark.parametrize("encoding", ["latin-1", "utf-8", "utf-8-sig", "utf-16"])
def test_encodings(spark, tmp_path, encoding):
    text = "id,name\n" + "".join(f"{i},Müller {i}\n" for i in range(20))
    path = _written(tmp_path, "a.csv", text.encode(encoding))
    rows = files.load_dataset(spark, path)
    assert rows.columns == ["id", "name"] and rows.where("name = 'Müller 7'").count() == 1


def test_long_utf8_heads(spark, tmp_path):
    text = "id,name\n" + "".join(f"{i},{'ü' * (i % 7)}\n" for i in range(4000))
    path = _written(tmp_path, "a.csv", text.encode())
    assert files.catalog_files(spark, path).first().encoding == "utf-8"


def test_mixed_layouts_are_an_error(spark, tmp_path):
    _written(tmp_path, "a.csv", b"id,name\n1,a\n2,b\n3,c\n")
    path = _written(tmp_path, "b.csv", b"id;name\n1;a\n2;b\n3;c\n")
    with pytest.raises(ValueError, match="different layouts"):
        files.load_dataset(spark, path)


def test_retry_then_dead_letter(spark, tmp_path):
    calls = []

    def fails_twice(batch, number):
        calls.append(number)
        if number == 1 or len(calls) < 3:
            raise RuntimeError("not now")

    handle = streams.retried(fails_twice, str(tmp_path / "dead"), 3, 0.0)
    handle(spark.range(4), 0)
    assert calls == [0, 0, 0] and not (tmp_path / "dead").exists()
    handle(spark.range(4), 1)
    rows = spark.read.parquet(str(tmp_path / "dead")).collect()
    assert len(rows) == 4 and {r.batch for r in rows} == {1} and "not now" in rows[0].error
    handle(spark.range(4), 1)
    assert spark.read.parquet(str(tmp_path / "dead")).count() == 4
